"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"
_LOCAL: dict[str, str] = {}  # folder of a local session that names none


def local_session(cores: str = "*", name: str = "parcelscope") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    n = os.cpu_count() if cores == "*" else int(cores)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workers_import(spark: SparkSession) -> None:
    """Let Python workers started from now on import this package."""
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """The name of a new folder, not made yet, under the shared folder the cluster names.

    The setting is read from the session. Only a local master may fall back to a
    folder of its own; on a cluster a machine-local folder would not be visible to
    the other executors, so a missing setting is an error there. What is written there goes
    when the session's process ends.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="parcelscope-")
            atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
        root = _LOCAL[app]
    own = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}")
    files = own.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(own)
    files.deleteOnExit(own)
    return f"{own.toString()}/data"


def made_folder(spark: SparkSession, path: str) -> str:
    """The folder, made if it is not there yet, in whatever store the path names."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(folder)
    return path


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by a hash of ``keys`` over enough tasks for costly steps, however few row groups their files have.

    The number is given, as adaptive execution would else merge small partitions: it goes by bytes, not by the work a row takes.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are worked out once a row, however many later columns and filters read them.

    The optimizer copies a costly expression into each filter that it moves below a projection, and interpreted ones into each
    reader. It does neither across a generator, so the columns leave one as the fields of a single entry. They are worked
    out even if nothing reads them.
    """
    made = F.explode_outer(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select("*", made.alias("_once")).select(*kept, *[F.col(f"_once.{n}") for n in columns])


def apart(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns worked out in a projection outside whole-stage code, for later columns that read them more than once.

    Whole-stage code makes a projection one method, and the JVM compiles none of over 8,000 bytes; outside, it is cut into
    small ones and terms that recur are worked out once. A lambda keeps it there, as one struct's field, so that it stays.
    """
    outside = F.transform(F.array(df.columns[0]), lambda v: v).alias("_outside")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(n) for n, c in columns.items()], outside)
    return df.select("*", made.alias("_apart")).select(*kept, *[F.col(f"_apart.{n}") for n in columns])


def settle(df: DataFrame, purpose: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back.

    Lineage ends at files that survive a lost executor, and the planner knows the table's
    size: joins broadcast it when it is under the broadcast threshold and shuffle it
    otherwise.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
