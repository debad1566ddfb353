"""Page layout: words to lines, page labels at the edges, letters by column."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as X


def letters(text: Column) -> Column:
    """How many letters a text has."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", ""))


def letter_columns(df: DataFrame, width: float, book: str = "book", page: str = "page_number", x: str = "x", text: str = "text") -> DataFrame:
    """(book, page, left_letters, middle_letters, right_letters, two_columns) of each page of that width.

    Left of 45 % and right of 55 % of the width; rows without a place count as middle.
    """
    n = letters(F.col(text)).cast("bigint")
    left, right = F.coalesce(F.col(x) < 0.45 * width, F.lit(False)), F.coalesce(F.col(x) > 0.55 * width, F.lit(False))
    some = lambda when: F.coalesce(F.sum(F.when(when, n)), F.lit(0))
    out = df.groupBy(book, page).agg(some(left).alias("left_letters"), some(~left & ~right).alias("middle_letters"), some(right).alias("right_letters"))
    two = (F.col("left_letters") >= 18) & (F.col("right_letters") >= 18) & (F.col("middle_letters") < F.least("left_letters", "right_letters") * 0.23)
    return out.withColumn("two_columns", two)


def line_numbers(mids: list[float], near: float) -> list[int]:
    """The line of each word, words given by rising centre: a word stays in the last line while it is within `near` of the middle of
    that line's centres. Centres rise, so the middle of a line is found by position."""
    out, start, line = [], 0, 0
    for i, mid in enumerate(mids):
        size = i - start
        if size:
            a, b = mids[start + (size - 1) // 2], mids[start + size // 2]
            if mid - (a + b) / 2 > near:
                start, line = i, line + 1
        out.append(line)
    return out


def group_words(words: DataFrame, width: float) -> DataFrame:
    """(book, page, line, text, x, y, right_edge, bottom): the words of each page in lines, column by column.

    words: (book, page, text, x, y, width, height). A page is read in two columns if both have letters and the middle is
    nearly empty. Words without text, x, y or height are left out; a word without a width gets that of its characters, each as wide as
    the median of the page's other words, or half its height where no word has a width. A page is a bounded group. Columns, sizes and
    the text of a line are made JVM-side; only the line number of a word, which depends on the words before it, comes from Python, for pages
    sorted within their partition.
    """
    slim = words.select("book", F.col("page").cast("bigint").alias("page"), "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")])
    slim = slim.dropna(subset=["text", "x", "y", "height"])
    page = Window.partitionBy("book", "page")
    n = letters(F.col("text"))
    side = lambda when: F.coalesce(F.sum(F.when(when, n)).over(page), F.lit(0))
    left, right = side(F.col("x") < 0.45 * width), side(F.col("x") > 0.55 * width)
    middle = F.sum(n).over(page) - left - right
    chars = F.length("text")
    each = F.median(F.when(chars > 0, F.col("width") / chars)).over(page)
    placed = slim.withColumns({"_split": (left >= 18) & (right >= 18) & (middle < 0.23 * F.least(left, right)), "_width": F.coalesce("width", chars * F.coalesce(each, F.col("height") * 0.5))})
    placed = placed.select("book", "page", F.when(F.col("_split") & (F.col("x") >= width / 2), 1).otherwise(0).alias("half"), "text", "x", "y", F.col("_width").alias("width"), "height", (F.col("y") + F.col("height") * 0.5).alias("mid"))
    size = F.median(F.greatest("height", F.lit(1.0))).over(Window.partitionBy("book", "page", "half"))
    placed = placed.withColumn("size", size).sortWithinPartitions("book", "page", "half", "mid", "x", "text")

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def numbered() -> pd.DataFrame:
            pdf = pd.concat(held) if len(held) > 1 else held[0]
            book, page, half, mids, sizes = (pdf[c].tolist() for c in ("book", "page", "half", "mid", "size"))
            row: list[int] = []
            at = 0
            for i in range(1, len(mids) + 1):
                if i == len(mids) or (half[i], page[i], book[i]) != (half[at], page[at], book[at]):
                    row += line_numbers(mids[at:i], max(3.0, 0.6 * sizes[at]))
                    at = i
            return pdf.assign(row=row)[["book", "page", "half", "row", "text", "x", "y", "width", "height", "size"]]

        for pdf in batches:
            # whole pages go on; the last one may not be complete
            last = (pdf["book"].eq(pdf["book"].iloc[-1]) | (pdf["book"].isna() & pd.isna(pdf["book"].iloc[-1]))) & (pdf["page"].eq(pdf["page"].iloc[-1]) | (pdf["page"].isna() & pd.isna(pdf["page"].iloc[-1])))
            if not last.all():
                held.append(pdf[~last])
                yield numbered()
                held = []
            held.append(pdf[last])
        if held:
            yield numbered()

    kind = dict(slim.dtypes)["book"]
    rows = placed.mapInPandas(number, f"book {kind}, page bigint, half int, row int, text string, x double, y double, width double, height double, size double")
    word = F.struct("x", "y", "text", (F.col("x") + F.col("width")).alias("end"))
    lines = rows.groupBy("book", "page", "half", "row").agg(
        F.array_sort(F.collect_list(word)).alias("words"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right_edge"), F.max(F.col("y") + F.col("height")).alias("bottom"), F.first("size").alias("size"),
    )
    first = F.element_at("words", 1)
    start = F.struct(first["text"].alias("text"), first["end"].alias("end"))
    joined = F.aggregate(
        F.slice("words", 2, F.size("words")), start,
        lambda acc, w: F.struct(F.concat(acc["text"], F.when(w["x"] - acc["end"] > 1.7 * F.col("size"), "   ").otherwise(" "), w["text"]).alias("text"), w["end"].alias("end")),
    )["text"]
    line = F.row_number().over(Window.partitionBy("book", "page").orderBy("half", "row")).cast("bigint")
    return lines.select("book", "page", line.alias("line"), X.clean_text(joined).alias("text"), "x", "y", "right_edge", "bottom")


def edge_labels(lines: DataFrame, height: float, width: float, book: str = "book", page: str = "page_number") -> DataFrame:
    """(book, page, numbering, value): printed page labels in the upper and lower 16 % of pages of that size, each once.

    A line that is a label as a whole, else its first and last word where they stand left of 20 % or right of 78 % of the width. A line's last
    word begins where its share of the line's characters says; without a right edge, or a word without a place, there is none.
    """
    edge = ~((F.col("y") > 0.16 * height) & (F.col("bottom") < 0.84 * height))
    rows = lines.where(edge & (F.trim("text") != "")).select(F.col(book).alias("book"), F.col(page).alias("page"), F.trim("text").alias("text"), F.col("x").alias("x"), F.col("right_edge").alias("end"))
    words = F.split("text", r"(?U)\s+")
    parts = rows.select("book", "page", X.page_label(F.col("text")).alias("whole"), F.element_at(words, 1).alias("a"), F.element_at(words, -1).alias("b"), "x", "end", F.length("text").alias("n"))
    outer = lambda x: (x < 0.2 * width) | (x > 0.78 * width)
    begins = F.col("end") - (F.col("end") - F.col("x")) * F.length("b") / F.col("n")
    ends = F.array_compact(F.array(F.when(outer(F.col("x")), X.page_label(F.col("a"))), F.when(outer(begins), X.page_label(F.col("b")))))
    found = parts.select("book", "page", F.explode(F.when(F.col("whole").isNotNull(), F.array("whole")).otherwise(ends)).alias("l"))
    return found.select("book", "page", "l.numbering", "l.value").distinct()
