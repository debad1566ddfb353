import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirelake.sources import files

SMALL = "/root/testdata/sf0.001"


def test_listing(spark, tmp_path):
    for name in ("a/B.PDF", "a/c.pdf", "d.txt", "out/e.pdf"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"%PDF-1.7 x" if "B" in name else b"x")
    got = files.list_files(spark, str(tmp_path), exclude=str(tmp_path / "out")).collect()
    assert [Path(r["path"]).name for r in got] == ["B.PDF", "c.pdf"]
    both = spark.read.format("binaryFile").load(str(tmp_path / "a")).select(files.looks_like_pdf(F.col("content")), files.content_hash(F.col("content")))
    assert sorted(r[0] for r in both.collect()) == [False, True]


def test_report_lines_and_summary(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_bytes(b"not json\n[]\n" + json.dumps({"source": "a", "n": 1}).encode() + b'\n{"source": 5}\n{"source": ""}\n\xff\n' + json.dumps({"source": "a", "n": 2}).encode() + b"\n")
    rows = files.read_report(spark, str(p)).orderBy("seq").selectExpr("seq.row as seq", "source").collect()
    assert [(r["seq"], r["source"]) for r in rows] == [(2, "a"), (6, "a")]
    df = spark.createDataFrame([("a", "目"), ("b", None)], "source string, t string")
    files.write_summary(df, str(tmp_path / "s"))
    assert any(f.read_bytes().startswith("﻿".encode()) for f in (tmp_path / "s").glob("part-*"))
    assert sorted(map(tuple, files.read_summary(spark, str(tmp_path / "s")).collect())) == [("a", "目"), ("b", None)]
    with pytest.raises(ValueError):
        files.read_summary(spark, str(tmp_path / "s"), "other")


def test_outline_source_without_its_library(spark):
    spark.dataSource.register(files.OutlineSource)
    r = spark.read.format("pdf_outline").option("paths", "/nowhere.pdf").load().collect()
    assert len(r) == 1 and r[0]["error"]


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    names, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(names) and {"p1_found", "p2_found", "p5_found"} <= set(names)


def test_report_in_several_splits(spark, tmp_path):
    p = tmp_path / "long.jsonl"
    p.write_text("".join(f'{{"source": "s{i}", "n": {i}}}\n' for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = files.read_report(spark, str(p))
        assert df.rdd.getNumPartitions() > 3
        assert [r["source"] for r in df.orderBy("seq").collect()] == [f"s{i}" for i in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
