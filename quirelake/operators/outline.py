"""Existing outlines: nesting, quality, comparison with the printed contents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text as X
from quirelake.operators.ordered import chunked, scans

DEEPEST = 6


def nested_levels(df: DataFrame, key: str = "book", order: str = "seq", tie: str = "node_id", level: str = "level", cap: int | None = DEEPEST) -> DataFrame:
    """df with _pos and `nested`: no row lies more than one level below the row before it, the first one at level 1.

    Closed form of the clamp: pos + min over all rows so far of (min(level, cap) - pos), or pos itself if that is smaller.
    Null levels and ones below 1 count as 1.
    """
    raw = F.greatest(F.coalesce(F.col(level), F.lit(1)), F.lit(1)).cast("bigint")
    if cap is not None:
        raw = F.least(raw, F.lit(cap))
    rows = chunked(df, key, order, tie)
    rows = scans(rows, key, {"_low": (raw - F.col("_pos"), "min", True)})
    return rows.withColumn("nested", F.least(F.col("_pos"), F.col("_pos") + F.col("_low"))).drop("_low")


def with_parents(df: DataFrame, key: str = "book", order: str = "seq", tie: str = "node_id", level: str = "level") -> DataFrame:
    """(key, order, tie, nested, parent): parent is the latest earlier row one level up, null at level 1."""
    rows = nested_levels(df, key, order, tie, level).select(key, order, tie, "_chunk", "_pos", "nested")
    rows = scans(rows, key, {f"_at{d}": (F.when(F.col("nested") == d, F.col(tie)), "last", False) for d in range(1, DEEPEST)})
    parent = F.lit(None).cast(dict(df.dtypes)[tie])
    for depth in range(1, DEEPEST):
        parent = F.when(F.col("nested") == depth + 1, F.col(f"_at{depth}")).otherwise(parent)
    return rows.select(key, order, tie, "nested", parent.alias("parent"))


def quality(df: DataFrame, book: str = "book", title: str = "title") -> DataFrame:
    """(book, bookmarks, useful, page_titles, quality, page_title_ratio) of each outline. A null title counts as empty."""
    t = F.coalesce(F.col(title), F.lit(""))
    page = X.is_page_title(t)
    key = X.title_key(t)
    long = (F.length(key) >= 3) | (F.length(F.regexp_replace(key, f"[^{X.HAN}]", "")) >= 2)
    file = X.clean_text(t).rlike(r"(?i)\.(?:pdf|djvu)$")
    marked = df.select(F.col(book).alias("book"), page.alias("p"), (~page & ~file & long).alias("u"))
    out = marked.groupBy("book").agg(F.count(F.lit(1)).alias("bookmarks"), F.count_if("u").alias("useful"), F.count_if("p").alias("page_titles"))
    return out.withColumns({"quality": F.col("useful") / F.col("bookmarks"), "page_title_ratio": F.col("page_titles") / F.col("bookmarks")}).withColumnRenamed("book", book)


def _numbered(df: DataFrame, order: str, tie: str) -> DataFrame:
    """df (book, key, page, level, order, tie) with n, the how-manieth row of its (book, key) it is.

    A title that is repeated very often is numbered within chunks of the order, like any other ordered scan.
    """
    keyed = df.withColumn("_title", F.struct("book", "key"))
    return chunked(keyed, "_title", order, tie).withColumnRenamed("_pos", "n").drop("_title", "_chunk")


def occurrence_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
    """(book, key, n, old_page, new_page, old_level, new_level): the k-th rows of a title on both sides.

    Inputs have the columns book, key, page, level, ord, id.
    """
    sides = [
        _numbered(d, "ord", "id").select("book", "key", "n", F.col("page").alias(f"{s}_page"), F.col("level").alias(f"{s}_level"))
        for s, d in (("old", old), ("new", new))
    ]
    return sides[0].join(sides[1], ["book", "key", "n"])


def compare(old: DataFrame, new: DataFrame, contents: DataFrame | None = None) -> DataFrame:
    """(book, matches, expected, existing, matched_titles, missing_titles, unexpected_titles, wrong_pages, wrong_levels, wrong_order).

    Ordered lists of (key, page, level), compared as multisets of titles, by occurrence, and in order. Inputs have the
    columns book, key, page, level, ord, id; `contents` (book, page) names contents pages: a first-level old row to one of
    them under a title for contents is left out. Nulls equal nulls. Books on one side only are compared with an empty list.
    """
    if contents is not None:
        pages = contents.select("book", F.col("page").alias("page")).distinct().withColumn("_toc", F.lit(True))
        old = old.join(pages, ["book", "page"], "left")
        skip = F.coalesce(F.col("_toc") & (F.col("level") == 1) & F.col("key").isin(*X.CONTENTS_KEYS), F.lit(False))
        old = old.where(~skip).drop("_toc")
    titles = None
    for s, d in (("old", old), ("new", new)):
        counts = d.groupBy("book", "key").agg(F.count(F.lit(1)).alias(s))
        titles = counts if titles is None else titles.join(counts, ["book", "key"], "full").fillna(0, ["old", "new"])
    by_title = titles.groupBy("book").agg(
        F.sum("new").alias("expected"), F.sum("old").alias("existing"), F.sum(F.least("old", "new")).alias("matched_titles"),
        F.sum(F.greatest(F.col("new") - F.col("old"), F.lit(0))).alias("missing_titles"), F.sum(F.greatest(F.col("old") - F.col("new"), F.lit(0))).alias("unexpected_titles"),
    )
    differ = lambda c: (~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))).cast("bigint")
    pairs = occurrence_pairs(old, new).groupBy("book").agg(F.sum(differ("page")).alias("wrong_pages"), F.sum(differ("level")).alias("wrong_levels"))
    # same length and the same row at every position
    placed = [chunked(d, "book", "ord", "id").select("book", "_pos", F.struct("key", "page", "level").alias(s)) for s, d in (("old", old), ("new", new))]
    off = placed[0].join(placed[1], ["book", "_pos"], "full").where(~F.col("old").eqNullSafe(F.col("new"))).groupBy("book").agg(F.count(F.lit(1)).alias("_off"))
    out = by_title.join(pairs, "book", "left").join(off, "book", "left").fillna(0, ["wrong_pages", "wrong_levels", "_off"])
    same = F.col("_off") == 0
    none = (F.col("missing_titles") + F.col("unexpected_titles") + F.col("wrong_pages") + F.col("wrong_levels")) == 0
    return out.withColumn("matches", same).withColumn("wrong_order", ~same & none).drop("_off")


def keyed(df: DataFrame, key: Column, page: str, order: str, tie: str, book: str = "book", level: str = "level") -> DataFrame:
    """The columns the comparison reads."""
    return df.select(F.col(book).alias("book"), F.coalesce(key, F.lit("")).alias("key"), F.col(page).alias("page"), F.col(level).alias("level"), F.col(order).alias("ord"), F.col(tie).alias("id"))


def backward_steps(df: DataFrame, key: str = "book", order: str = "seq", tie: str = "toc_id", value: str = "printed_page") -> DataFrame:
    """(key, rows, steps): how often a value is smaller than the one of the row before it. Rows with a null value are passed over."""
    rows = chunked(df.where(F.col(value).isNotNull()).select(key, order, tie, value), key, order, tie)
    rows = scans(rows, key, {"_before": (F.col(value), "last", False)})
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(value) < F.col("_before")).alias("steps"))


def longest_run(df: DataFrame, key: str = "book", order: str = "seq", tie: str = "toc_id", first: str = "printed_page", second: str = "pdf_page") -> DataFrame:
    """(key, longest): the most rows in a row in which both values rise by exactly 1. Rows with a null value are passed over."""
    rows = chunked(df.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(key, order, tie, first, second), key, order, tie)
    rows = scans(rows, key, {"_before": (F.struct(first, second), "last", False)})
    step = (F.col(first) == F.col("_before")[first] + 1) & (F.col(second) == F.col("_before")[second] + 1)
    rows = scans(rows, key, {"_run": (F.when(F.coalesce(step, F.lit(False)), 0).otherwise(1), "sum", True)})
    runs = rows.groupBy(key, "_run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(key).agg(F.max("n").alias("longest"))
