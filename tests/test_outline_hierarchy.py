import random

from pyspark.sql import functions as F

from quirelake.functions import text as X
from quirelake.operators import hierarchy, ordered, outline


def test_unique_rows_breaks_and_bookmark(spark):
    data = [(1, "b", 1, "3.4 甲", 44, "arabic", 1), (2, "b", 2, "3.4甲", 44, "arabic", 1), (3, "b", 3, "3.5", 48, "arabic", 2), (4, "b", 4, "4.2", 50, "arabic", 3), (5, "b", 5, None, None, None, None), (6, "b", 6, None, None, None, None)]
    df = spark.createDataFrame(data, "toc_id int, book string, seq int, title string, printed_page int, numbering string, source_page int")
    assert sorted(r["toc_id"] for r in hierarchy.unique_rows(df).collect()) == [1, 3, 4, 5]
    assert sorted((r["page"], r["continues"]) for r in hierarchy.page_breaks(df).collect()) == [(1, True), (2, False)]
    assert hierarchy.contents_bookmark(df).collect()[0]["title"] == "Contents"


def test_nesting_equals_a_loop(spark):
    rnd = random.Random(3)
    data = [(i, f"b{rnd.randrange(4)}", rnd.randrange(60), rnd.choice([None, 0, 1, 1, 2, 3, 4, 7, 9])) for i in range(600)]
    df = spark.createDataFrame(data, "node_id int, book string, seq int, level int").repartition(5)
    want = {}
    for b in {d[1] for d in data}:
        last, stack = 0, {}
        for i, _, _, lv in sorted((d for d in data if d[1] == b), key=lambda d: (d[2], d[0])):
            last = max(1, min(max(lv or 1, 1), last + 1, 6))
            want[i] = (last, stack.get(last - 1))
            stack[last] = i
    for chunk in (7, 4096):
        old, ordered.chunked.__defaults__ = ordered.chunked.__defaults__, (chunk,)
        try:
            assert {r["node_id"]: (r["nested"], r["parent"]) for r in outline.with_parents(df).collect()} == want
        finally:
            ordered.chunked.__defaults__ = old


def test_steps_and_runs(spark):
    data = [(1, "b", 1, 5, 15), (2, "b", 2, 6, 16), (3, "b", 3, None, 1), (4, "b", 4, 7, 17), (5, "b", 5, 3, 18), (6, "b", 6, 4, 19), (7, "c", 1, None, None)]
    df = spark.createDataFrame(data, "toc_id int, book string, seq int, printed_page int, pdf_page int")
    assert {r["book"]: (r["rows"], r["steps"]) for r in outline.backward_steps(df).collect()} == {"b": (5, 1)}
    assert {r["book"]: r["longest"] for r in outline.longest_run(df).collect()} == {"b": 3}


def sides(spark, old, new):
    schema = "book string, key string, page int, level int, ord int, id int"
    make = lambda rows: spark.createDataFrame([("b", k, p, lv, i, i) for i, (k, p, lv) in enumerate(rows)], schema)
    return make(old), make(new)


def test_compare(spark):
    base = [("a", 1, 1), ("b", 2, 2), ("b", 3, 2), ("c", None, 1)]
    check = lambda old, new, toc=None: outline.compare(*sides(spark, old, new), toc).collect()[0].asDict()
    assert check(base, base)["matches"]
    swapped = check([base[0], base[3], base[1], base[2]], base)
    assert swapped["wrong_order"] and not swapped["matches"] and swapped["matched_titles"] == 4
    other = check([("a", 9, 1), ("b", 2, 1), ("x", 1, 1)], base)
    assert (other["missing_titles"], other["unexpected_titles"], other["wrong_pages"], other["wrong_levels"]) == (2, 1, 1, 1)
    contents = spark.createDataFrame([("b", 7)], "book string, page int")
    assert check([("目录", 7, 1), *base], base, contents)["matches"]


def test_quality(spark):
    titles = ["（第 12 页）", "Page 13", "P.14", "第十五页", "一百零一", "1.2", "绪论"]
    df = spark.createDataFrame([("b", t) for t in titles] + [("c", None), ("d", "book.pdf")], "book string, title string")
    out = {r["book"]: r for r in outline.quality(df).collect()}
    assert out["b"]["page_title_ratio"] == 6 / 7 and out["b"]["quality"] == 1 / 7 and out["c"]["quality"] == 0 and out["d"]["useful"] == 0


def test_page_titles_of_numbers(spark):
    df = spark.createDataFrame([("b", str(i)) for i in range(181)] + [("b", "Chapter %s here" % c) for c in "vwxyz"], "book string, title string")
    out = outline.quality(df).collect()[0]
    assert (out["bookmarks"], out["page_titles"], out["useful"]) == (186, 181, 5)
    assert df.where(X.is_page_title(F.col("title"))).count() == 181
