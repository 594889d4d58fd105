"""Quoted CSV in many splits: line breaks, doubled quotes, records longer than a split, several files."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from earshot.sources import plays, records

CONF = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "1"}


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in CONF}
    for k, v in CONF.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def write(path, rows, end="\n", names=("id", "text", "last")):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator=end)
        w.writerow(names)
        w.writerows(rows)


def made(seed, n):
    r = random.Random(seed)
    texts = ["plain", 'say "hi"', "two\nlines", "a,b", "crlf\r\ninside", 'q"\n"q', "é ü", "\n", '"', "x" * 300, "\n\n,\n"]
    return [(f"{seed}-{i}", r.choice(texts) + str(i), "end") for i in range(n)]


def read(spark, path):
    return sorted(tuple(r) for r in records.read_csv(spark, str(path), ["id", "text", "last"]).collect())


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_records_across_splits(small_splits, tmp_path, end):
    rows = made(1, 600) + [("long", "\n".join(['line with "quotes", and more'] * 500), "end")] + made(2, 300)
    write(tmp_path / "a.csv", rows, end)
    write(tmp_path / "b.csv", more := made(3, 200), end)
    write(tmp_path / "empty.csv", [], end)
    assert read(small_splits, tmp_path) == sorted(rows + more)
    lines = small_splits.read.text(str(tmp_path / "a.csv"))
    assert lines.select(F.spark_partition_id()).distinct().count() > 5
    assert records.records(small_splits, str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 5


def test_every_place_of_a_split(spark, tmp_path):
    """The same file, cut at every size from a few bytes on."""
    rows = [("1", 'a\n"b"', "x"), ("2", "", "y"), ("3", "\n\n", "z"), ("4", "c,\nd", "é")]
    write(tmp_path / "a.csv", rows)
    before = {k: spark.conf.get(k) for k in CONF}
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        for size in (14, 15, 17, 20, 23, 29, 37, 64):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            got = [tuple(r) for r in records.read_csv(spark, str(tmp_path / "a.csv"), ["id", "text", "last"]).na.fill("").orderBy("id").collect()]
            assert got == rows, size
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_gzip_blank_lines_and_short_rows(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.csv.gz", "wt", newline="") as f:
        f.write('\n"id","text","last"\n\n1,"a\nb"\n  \n2,c,d,e\n3,"open to the end\nof file"')
    got = sorted((r.id, r.text, r.last) for r in records.read_csv(spark, str(tmp_path), ["id", "text", "last"]).collect())
    assert got == [("1", "a\nb", None), ("2", "c", "d"), ("3", "open to the end\nof file", None)]


def test_headers_must_agree(spark, tmp_path):
    write(tmp_path / "a.csv", [("1", "2", "3")])
    write(tmp_path / "b.csv", [("1", "2", "3")], names=("id", "last", "text"))
    assert records.header(spark, str(tmp_path / "b.csv")) == ["id", "last", "text"]
    with pytest.raises(Exception, match="another header"):
        read(spark, tmp_path)
    write(tmp_path / "b.csv", [], names=("id", "line\nbreak", "more"))
    assert records.header(spark, str(tmp_path / "b.csv")) == ["id", "line\nbreak", "more"]


def test_missing_columns_stop_the_reader(spark, tmp_path):
    write(tmp_path / "a.csv", [("1", "2", "3")])
    with pytest.raises(plays.MissingColumns):
        plays.read_plays(spark, str(tmp_path))
    assert plays.read_plays(spark, str(tmp_path), ("last", "id")).collect()[0] == ("3", "1")
