"""Data sources by name."""

import json

import pytest

from parcelscope.sources import connectors as C


def written(folder, name, lines):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(lines), encoding="utf-8")
    return str(folder)


@pytest.mark.parametrize("part_bytes", [1, 7, 64, 1000, 10**9])
def test_every_page_is_read_once_wherever_files_are_cut(spark, tmp_path, part_bytes):
    C.register(spark)
    pages = [{"url": f"u{i}", "html": "é" * (i * 7 % 50)} for i in range(40)] + [{"url": None, "html": None}, {}]
    lines = [json.dumps(p, ensure_ascii=False) for p in pages]
    folder = written(tmp_path / "c", "a.jsonl", [*lines[:30], ""])
    written(tmp_path / "c", "b.txt", lines[30:])
    written(tmp_path / "c", "one.html", ["<b>x</b>", "y"])
    written(tmp_path / "c", "_SUCCESS", ["z"])
    whole = C.CapturedReader(folder, part_bytes)
    got = [p for part in whole.partitions() for p in whole.pages(part)]
    expected = [(p.get("url"), p.get("html")) for p in pages] + [(f"{folder}/one.html", "<b>x</b>\ny")]
    assert sorted(got, key=str) == sorted(expected, key=str)
    if part_bytes in (64, 10**9):
        rows = spark.read.format("captured_folder").option("part_bytes", part_bytes).load(folder)
        assert sorted((tuple(r) for r in rows.collect()), key=str) == sorted(expected, key=str)
        assert (rows.rdd.getNumPartitions() == 1) == (part_bytes > 64)


def test_parts_are_near_their_size():
    files = [("a.txt", 1000), ("b.html", 900), ("c.txt", 0), *((f"d{i}.html", 10) for i in range(50))]
    parts = C.planned(files, 300)
    sizes = [sum(b - a for _, a, b in p.ranges) for p in parts]
    assert sum(sizes) == 2400 and max(sizes) <= 300 + 900 and len(parts) == 6
    assert C.planned([], 300) == []


def test_searches_are_enabled_unless_they_say_no(spark, tmp_path):
    C.register(spark)
    hunts = [{"name": "a", "filters": {"mode": "sale", "suburbs": ["X"], "price_max": 5, "odd": 1}}, {"name": "b", "enabled": False}, {"name": "c", "enabled": None, "max_items": 3}]
    folder = written(tmp_path / "d", "one.json", [json.dumps({"hunts": hunts}, indent=1)])
    written(tmp_path / "d", "two.json", [json.dumps({"hunts": [{"name": "d", "enabled": True}]}), json.dumps({"other": 1}), json.dumps({"hunts": None})])
    rows = {r.name: r for r in spark.read.format("saved_searches").load(folder).collect()}
    assert set(rows) == {"a", "c", "d"} and rows["c"].max_items == 3 and rows["d"].filters is None
    assert (rows["a"].filters.mode, rows["a"].filters.suburbs, rows["a"].filters.price_max, rows["a"].filters.sort) == ("sale", ["X"], 5, None)
    assert spark.read.format("saved_searches").option("disabled", "include").load(folder).count() == 4


def test_missing_and_empty_folders(spark, tmp_path):
    C.register(spark)
    empty = written(tmp_path / "e", "_SUCCESS", [])
    assert spark.read.format("captured_folder").load(empty).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("saved_searches").load(str(tmp_path / "nowhere")).count()


def test_a_large_file_of_definitions_is_read_in_one_pass(tmp_path):
    """The text that is left must not be copied for each definition."""
    import time

    def seconds(n):
        lines = [json.dumps({"hunts": [{"name": f"s{i}", "filters": {"mode": "sale", "suburbs": ["X"]}}]}) for i in range(n)]
        folder = written(tmp_path / f"n{n}", "one.json", [" ", *lines, ""])
        reader = C.SearchReader(folder, C.StructType.fromDDL("name string"), False, 10**9)
        began = time.perf_counter()
        assert [r[0] for p in reader.partitions() for r in reader.read(p)] == [f"s{i}" for i in range(n)]
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(160_000) < 40 * seconds(10_000)
