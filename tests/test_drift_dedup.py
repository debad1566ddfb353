import json
from datetime import datetime

import pytest

from quirelake.operators import dedup, drift

A, B = "0123456789abcdef0123456789abcdef", "ffffffffffffffffffffffffffffffff"
DASHED = "01234567-89AB-CDEF-0123-456789ABCDEF"


def log(spark, files):
    data = [(i, j, f, p if isinstance(p, str) or p is None else json.dumps(p)) for i, (j, f, p) in enumerate(files)]
    return spark.createDataFrame(data, "log_id long, job_id string, file_no int, payload string")


def test_changes(spark, rows):
    df = log(spark, [
        ("j", 1, {"toc_bookmark": {"title": "a"}, "toc_corrections": None}), ("j", 1, "broken {"), ("j", 2, {"TocBookmark": ["a", 1], "acceptable": True}), ("j", 3, {"TocBookmark": ["b", 2], "review_ok": 1}),
        ("j", 4, "broken"), ("j", 6, {"review_ok": 1}), ("k", 1, {"toc_bookmark": 1}), (None, 2, {"toc_bookmark": 1}), ("j", None, {"toc_bookmark": 1}), ("j", 3, None),
    ])
    assert rows(drift.changes(df)) == sorted([
        ("j", 2, "toc_bookmark", "renamed"), ("j", 2, "toc_bookmark", "retyped"), ("j", 2, "review_acceptable", "added"), ("j", 3, "review_acceptable", "renamed"), ("j", 3, "review_acceptable", "retyped"),
        ("j", 4, "toc_bookmark", "removed"), ("j", 4, "review_acceptable", "removed"),
    ], key=repr)
    assert drift.changes(df.where("log_id < 0")).count() == 0


def test_every_alias_and_no_other_member():
    for r in drift.RENAMES:
        assert {drift.canonical(n) for n in r.names} == {r.field}
    assert [drift.canonical(n) for n in ("review_accepted", "existing_bookmarks", "toc_pages", "entries", "options")] == [None] * 5
    steps = drift.plan_of("toc_bookmark", "tocBookmark", "array")
    assert [type(s).__name__ for s in steps] == ["Rename", "Cast"]
    assert [type(s).__name__ for s in drift.plan_of("review_acceptable", None, None)] == ["Default"]


def test_unify(spark):
    df = log(spark, [
        ("j", 1, {"toc_bookmark": {"title": "T", "pdf_page": 4}, "review_acceptable": "是", "toc_corrections": [{"action": "x", "pages": [1]}]}), ("j", 1, {"tocBookmark": ["T", 4], "acceptable": 0, "corrections": "none"}),
        ("j", 1, {"toc_mark": "T@4", "review_ok": "N", "toc_fixes": {"x": [1]}}), ("j", 1, {"contents_bookmark": "T (p. 4)", "review-acceptable": True, "toc_corr": "x:1"}),
        ("j", 1, {"toc-bookmark": json.dumps({"title": "T", "pdf_page": 4})}), ("j", 1, "broken"), ("j", 1, None),
    ]).withColumnRenamed("log_id", "n")
    out = {r["n"]: r for r in drift.unify(df, row_id="n").collect()}
    assert all(tuple(out[i]["toc_bookmark"]) == ("T", 4) for i in range(5))
    assert [out[i]["review_acceptable"] for i in range(7)] == [True, False, False, True, False, None, None]
    assert [[tuple(c) for c in out[i]["toc_corrections"]] for i in range(5)] == [[("x", "[1]")], [], [("x", "[1]")], [("x", "1")], []]
    assert "rename tocBookmark -> toc_bookmark" in out[1]["steps"] and "default review_acceptable" in out[4]["steps"]
    assert not out[5]["readable"] and out[6]["toc_corrections"] is None


def messages(spark):
    t = lambda h: datetime(2024, 1, 1, h)
    data = [
        (1, A, t(3), "a"), (2, DASHED, t(2), "b"), (3, "{" + DASHED + "}", t(2), "c"), (4, "urn:uuid:" + DASHED.lower() + "\t", None, "d"), (5, " " + B, t(1), "e"), (6, None, t(1), "f"), (7, None, t(1), "g"),
        (8, "  ", t(1), "h"), (9, "not an id", t(1), "i"), (10, "not an id", t(1), "j"), (11, "", t(1), "k"), (12, "0x" + A.upper(), t(9), "l"),
    ]
    return spark.createDataFrame(data, "log_id long, message_id string, delivered_at timestamp, source string").withColumn("status", __import__("pyspark.sql.functions", fromlist=["lit"]).lit("s"))


@pytest.mark.parametrize("hot", [1, 3, 5000])
def test_one_copy_of_each_message(spark, hot):
    df = messages(spark)
    assert sorted(r[0] for r in dedup.superfluous(df, hot_rows=hot).collect()) == [1, 3, 4, 12]
    kept = {r["log_id"]: r["message_key"] for r in dedup.deduplicate(df).collect()}
    assert sorted(kept) == [2, 5, 6, 7, 8, 9, 10, 11] and kept[2] == A and kept[9] is None
    again = dedup.deduplicate(df.where("log_id < 3"), df.where("log_id >= 3"))
    assert sorted(r["log_id"] for r in again.collect()) == sorted(kept)
    assert dedup.superfluous(df.where("log_id < 0")).count() == 0


def test_clashing_extra_columns(spark):
    df = messages(spark).withColumnsRenamed({"source": "_key", "status": "_rank"}).selectExpr("*", "1 as _join", "2 as _again", "3 as raw", "4 as time")
    assert sorted(r[0] for r in dedup.superfluous(df).collect()) == [1, 3, 4, 12]


@pytest.mark.parametrize("hot", [1, 5000])
def test_rows_alike_in_everything(spark, hot):
    t = datetime(2024, 1, 1)
    data = [(7, A, t, "a", "s")] * 3 + [(None, B, None, "b", "s")] * 2 + [(8, A, t, "c", "s")] * 2 + [(None, None, None, None, None)] * 2
    df = spark.createDataFrame(data, "log_id long, message_id string, delivered_at timestamp, source string, status string")
    assert sorted([r[0] for r in dedup.superfluous(df, hot_rows=hot).collect()], key=str) == [7, 7, 8, 8, None]
    kept = sorted([(r["log_id"], r["message_key"]) for r in dedup.deduplicate(df).collect()], key=str)
    assert kept == [(7, A), (None, B), (None, None), (None, None)]


def test_route_by_version(spark):
    """A file whose version takes rename and cast, a record in it that lacks the field, and one of another shape."""
    df = log(spark, [("j", 1, {"tocBookmark": ["T", 4], "review_ok": "yes"})] * 3 + [("j", 1, {"tocBookmark": ["U", 5]}), ("j", 1, {"toc_bookmark": {"title": "V", "pdf_page": 6}, "review_ok": 1})])
    out = {r["log_id"]: r for r in drift.unify(df).collect()}
    steps = ["rename tocBookmark -> toc_bookmark", "cast toc_bookmark from array"]
    assert list(out[0]["steps"]) == [*steps, "rename review_ok -> review_acceptable", "cast review_acceptable from string", "default toc_corrections"]
    assert list(out[3]["steps"]) == [*steps, "default review_acceptable", "default toc_corrections"] and out[3]["review_acceptable"] is False
    assert tuple(out[4]["toc_bookmark"]) == ("V", 6) and out[4]["review_acceptable"] is True and "cast review_acceptable from number" in out[4]["steps"]
    assert len({r["version"] for r in out.values()}) == 1
