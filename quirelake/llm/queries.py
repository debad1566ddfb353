"""The queries of the problems on text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.llm import charform, mixing, mojibake, packing, residue
from quirelake.session import table


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = charform.cases(table(spark, sf, "toc_rows"), "toc_id", ["title", "raw"], "toc_rows")
    return rows.unionAll(charform.cases(table(spark, sf, "page_lines"), "line_id", ["text"], "page_lines"))


def p3_rows(spark: SparkSession, sf: str) -> DataFrame:
    """All contents rows in the consistent form."""
    return charform.normalize(table(spark, sf, "toc_rows"), ["title", "raw"]).select("toc_id", "title", "title_changed", "raw", "raw_changed")


def p3_lines(spark: SparkSession, sf: str) -> DataFrame:
    return charform.normalize(table(spark, sf, "page_lines"), ["text"]).select("line_id", "text", "text_changed")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    # scripts tell what the original was, not whether a title is garbled
    return mojibake.found(table(spark, sf, "outline"), "node_id", "title", frozenset()).select(F.col("row_id").alias("node_id"))


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    out = mojibake.found(table(spark, sf, "outline"), "node_id", "title")
    return out.select(F.col("row_id").alias("node_id"), F.col("text").alias("title"), "restored", "layers")


def p6_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), table(spark, sf, "pack_sizes"))


def p6_room(spark: SparkSession, sf: str) -> DataFrame:
    return packing.room(p6_packed(spark, sf))


def p7_positions(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"))[0]


def p7_uses(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.counted(p7_positions(spark, sf))


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.shares(*mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets")))


def p7_shares_of_all(spark: SparkSession, sf: str) -> DataFrame:
    """The shares when as many tokens are asked for as all listed texts have: large sources are cut, small ones repeated up to their cap and short."""
    return mixing.shares(*mixing.mix(table(spark, sf, "documents"), table(spark, sf, "mix_targets"), total_tokens="all"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return residue.judged(table(spark, sf, "documents")).where("kind is not null").select(F.col("row_id").alias("doc_id"))


def p8_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return residue.judged(table(spark, sf, "documents")).select(F.col("row_id").alias("doc_id"), "kind")


def p8_usable(spark: SparkSession, sf: str) -> DataFrame:
    return residue.usable(table(spark, sf, "documents")).select("doc_id", "n_chars", "lang", "source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p3_found, p3_rows, p3_lines, p4_found, p4_restored, p6_packed, p6_room, p7_positions, p7_uses, p7_shares, p7_shares_of_all, p8_found, p8_kinds, p8_usable)
}

#: No SQL: normalization forms, encodings, tokenizers and packing can't be written in it; tests/llm compares with brute force.
SQL: dict[str, str] = {}
