"""SRC1: a file with line breaks in fields, read by many tasks."""
import csv
import random

import pytest
from pyspark.sql import functions as F

from propcube.session import scratch_path
from propcube.sources import csvfiles


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: (spark.conf.set("spark.sql.files.maxPartitionBytes", size), spark.conf.set("spark.sql.files.openCostInBytes", "1"))
    for k, v in old.items():
        spark.conf.set(k, v)


def _write(tmp_path, rows, name="city.csv", end="\n", tail=""):
    path = tmp_path / name
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(["PROP_ID", "DESCRIPTION", "PRICE"])
        w.writerows(rows)
        f.write(tail)
    return str(path)


def _rows(n, seed=1):
    rng = random.Random(seed)
    texts = ["plain", "two\nlines", 'he said "hi"', 'a,"b"\n\n"c"', "é日🙂\nx", "", '"', '\n"\n', "tab\there", "\n" * 40, "crlf\r\ninside"]
    return [[f"P{i}", rng.choice(texts) + rng.choice(["", "!", " " * 30]), str(i)] for i in range(n)]


@pytest.mark.parametrize("size, end", [(64, "\n"), (1000, "\n"), (700, "\r\n"), (1 << 20, "\n")])
def test_many_tasks_equal_one_task(spark, tmp_path, small_splits, size, end):
    path = _write(tmp_path, _rows(200 if size == 64 else 1500), end=end)
    one = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    # with CRLF ends the one-task reader writes those inside fields as line feeds
    same = lambda r: tuple(v and v.replace("\r\n", "\n") for v in r)
    want = [same(r) for r in one.collect()]
    small_splits(str(size))
    lines = spark.read.text(path)
    assert lines.rdd.getNumPartitions() > 8 or size > 1000
    rows, rejects = csvfiles.read_csv(spark, path)
    got = [same(r) for r in rows.orderBy("line").select("PROP_ID", "DESCRIPTION", "PRICE").collect()]
    assert got == want
    assert rejects.count() == 0


def test_malformed_records_are_kept_apart(spark, tmp_path, small_splits):
    small_splits("50")
    path = _write(tmp_path, [["P1", "a\nb", "1"], ["P2", "c", "2", "extra"], ["P3"]], tail='P4,"never\nclosed,4\nP5,x,5\n')
    rows, rejects = csvfiles.read_csv(spark, path)
    assert sorted(tuple(r) for r in rows.select("PROP_ID", "DESCRIPTION", "PRICE").collect()) == [("P1", "a\nb", "1"), ("P3", None, None)]
    got = sorted((r.line, r.record, r.reason) for r in rejects.collect())
    assert [g[2] for g in got] == ["too many fields"] + ["unclosed quote"] * 3
    assert got[0][1] == "P2,c,2,extra" and [g[1] for g in got[1:]] == ['P4,"never', "closed,4", "P5,x,5"]


def test_part_files_keep_their_own_order_and_empty_files_are_fine(spark, tmp_path, small_splits):
    folder = tmp_path / "parts"
    folder.mkdir()
    for i in range(3):
        _write(folder, _rows(60, i), name=f"part-{i}.csv")
    (folder / "part-9.csv").write_text("PROP_ID,DESCRIPTION,PRICE\n")
    small_splits("300")
    rows, _ = csvfiles.read_csv(spark, str(folder))
    for i in range(3):
        mine = rows.where(F.col("file").endswith(f"part-{i}.csv")).orderBy("line").collect()
        assert [r.PROP_ID for r in mine] == [f"P{j}" for j in range(60)]
        assert [r.DESCRIPTION or "" for r in mine] == [r[1] for r in _rows(60, i)]
    assert rows.count() == 180


def test_a_record_without_end_does_not_gather_the_file(spark, tmp_path, small_splits, monkeypatch):
    monkeypatch.setattr(csvfiles, "RECORD_LINES", 5)
    path = _write(tmp_path, [["P1", "\n" * 20, "1"], ["P2", "x", "2"]])
    rows, rejects = csvfiles.read_csv(spark, path)
    assert [r.PROP_ID for r in rows.collect() if r.PROP_ID == "P2"] == ["P2"]
    assert {r.reason for r in rejects.collect()} >= {"record too long"}
