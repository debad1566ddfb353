"""Joins of anchors whose sides look small to Spark and aren't: pieces of pages, collected texts, sampled pages."""

import pytest
from pyspark.sql import functions as F

from quirelake.operators import offsets
from quirelake.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    """Tables read from files, whose sizes Spark estimates."""

    def store(name, data, shape):
        spark.createDataFrame(data, shape).write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    return store


def test_title_anchors_without_broadcast(stored):
    long = " ".join(f"word{i}" for i in range(300))
    rows = stored("rows", [(1, "b", 1, "Heat Flow", 3, "arabic"), (2, "b", 2, "word298 word299", 5, "arabic")], "toc_id int, book string, seq int, title string, printed_page int, numbering string")
    pages = stored("pages", [("b", 2, "Heat Flow 3"), ("b", 9, f"so heat flow begins {long}")], "book string, page int, text string")
    df = offsets.title_anchors(rows, pages, stored("contents", [("b", 2)], "book string, page int"))
    assert "Broadcast" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [("b", 1, 9, 3, 6), ("b", 2, 9, 5, 4)]


def test_collected_without_broadcast(stored):
    labels = stored("labels", [("a", "arabic", p, p - 2) for p in (3, 4, 5)] + [("b", "arabic", 3, 1)], "book string, numbering string, pdf_page int, printed_page int")
    sample = stored("sample", [(b, p) for b in "ab" for p in (3, 4, 5)], "book string, page int")
    titles = stored("titles", [("a", 1, 7, 5, 2), ("b", 2, 8, 5, 3)], "book string, toc_id int, pdf_page int, printed_page int, offset int")
    df = offsets.collected(sample, labels, stored("counts", [("a", 20), ("b", 20)], "book string, page_count int"), titles)
    assert "Broadcast" not in plan(df)
    assert sorted(map(tuple, df.collect())) == [("a", "arabic", p, p - 2, 2, "page-label") for p in (3, 4, 5)] + [("b", "arabic", 3, 1, 2, "page-label"), ("b", "arabic", 8, 5, 3, "chapter-title")]


def test_collected_fit_collects_once(spark, rows):
    df = catalog.collected_fit(spark, SF)
    told = plan(df)
    assert "toc_rows.parquet" not in told and told.count("page_lines.parquet") <= 1
    anchors = catalog.collected_anchors(spark, SF)
    held = spark.createDataFrame(anchors.collect(), anchors.schema)
    labels = catalog.edge_page_labels(spark, SF).select("book", "numbering", F.col("page").alias("pdf_page"), F.col("value").alias("printed_page"))
    wanted = offsets.fit(held, labels).select("book", "numbering", "offset", F.to_json("segments").alias("segments"), "warning")
    assert rows(df) == rows(wanted) and df.count() > 0
