"""Written intermediate tables go with the session."""

import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from parcelscope.session import settle
builder = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false")
if len(sys.argv) > 2:
    builder = builder.config("spark.checkpoint.dir", sys.argv[2])
spark = builder.getOrCreate()
kept = settle(spark.range(3).toDF("n"), "test")
assert kept.count() == 3
print("WROTE", kept.inputFiles()[0].removeprefix("file://"))
spark.stop()
"""


def test_no_folder_is_left_behind(tmp_path):
    for args in ([], [f"file://{tmp_path}"]):
        run = subprocess.run([sys.executable, "-c", CODE, str(Path(__file__).resolve().parents[1]), *args], capture_output=True, text=True, check=True, timeout=120)
        written = Path(run.stdout.split("WROTE ")[1].split()[0])
        assert not written.exists() and not written.parents[1].exists()
    assert not list(tmp_path.glob("test-*"))  # Spark makes a folder of its own there
