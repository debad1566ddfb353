"""Checks of model responses in JSON: contents pages, page labels, and labels that earlier batches hold already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.functions import text as X
from quirelake.operators.nested import whole_json


def kind(v: Column) -> Column:
    """JSON kind of a variant: object, array, string, number, boolean; null for JSON null and absent values."""
    head = F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1)
    return (
        F.when(head.isin("OBJECT", "ARRAY", "STRING", "BOOLEAN"), F.lower(head)).when(head.isNull() | (head == "VOID"), F.lit(None)).otherwise("number")
    )


def strict_int(v: Column) -> Column:
    """A whole JSON number, or a text of 1 to 5 digits with space around it; booleans and fractions give null."""
    whole = F.schema_of_variant(v) == "BIGINT"
    text = F.trim(F.try_variant_get(v, "$", "string"))
    return F.when(whole, F.try_variant_get(v, "$", "bigint")).when((kind(v) == "string") & text.rlike("^[0-9]{1,5}$"), text.try_cast("bigint"))


def contents_entries(df: DataFrame, json_col: str, row_id: str, page_count: str) -> DataFrame:
    """(row_id, position, title, printed_page, level, outcome): the entries of contents-page responses.

    outcome is 'keep', 'drop' (no Arabic page label) or the reason that makes the whole response unusable: 'title', 'label',
    'level', 'range'; response-level errors give one row with a null position: 'json', 'is_toc', 'uncertain', 'entries'. The checks
    of an entry apply in this order: title, kind of the label, label (which drops), level, range.
    """
    rows = df.select(F.col(row_id).alias("row_id"), F.col(page_count).alias("pages"), whole_json(F.col(json_col).cast("string")).alias("d"))
    get = lambda path: F.try_variant_get("d", f"$.{path}", "variant")
    entries = F.try_variant_get("d", "$.entries", "array<variant>")
    bad = (
        F.when(F.coalesce(kind(F.col("d")) != "object", F.lit(True)), "json").when(~kind(get("is_toc")).eqNullSafe(F.lit("boolean")), "is_toc")
        .when(F.coalesce(kind(get("uncertain")), F.lit("boolean")) != "boolean", "uncertain").when(entries.isNull(), "entries")
    )
    rows = rows.withColumn("bad", bad).withColumn("is_toc", F.try_variant_get("d", "$.is_toc", "boolean"))
    errors = rows.where("bad is not null").select("row_id", F.lit(None).cast("bigint").alias("position"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("bigint").alias("printed_page"), F.lit(None).cast("int").alias("level"), F.col("bad").alias("outcome"))
    each = rows.where("bad is null and is_toc").select("row_id", "pages", F.posexplode(entries).alias("i", "e"))
    part = lambda path: F.try_variant_get("e", f"$.{path}", "variant")
    title = F.when(kind(part("title")) == "string", F.try_variant_get("e", "$.title", "string"))
    clean = F.regexp_replace(F.regexp_replace(title, r"(?U)\s+", " "), r"^[ .…·\t]+|[ .…·\t]+$", "")
    label = part("printed_page")
    shown = F.when(kind(label) == "number", F.try_variant_get(label, "$", "string")).otherwise(F.try_variant_get(label, "$", "string"))
    whole = (F.schema_of_variant(label) == "BIGINT") | (kind(label) == "string") | kind(label).isNull()
    each = each.select(
        "row_id", (F.col("i") + 1).cast("bigint").alias("position"), "pages", clean.alias("title"), F.length(title).alias("long"), whole.alias("whole"),
        F.regexp_replace(X.clean_text(shown), r"(?U)\s+", "").alias("shown"), F.when(F.schema_of_variant(part("level")) == "BIGINT", F.try_variant_get("e", "$.level", "int")).alias("level"),
    )
    digits = F.regexp_extract("shown", r"^\(?([0-9]+)\)?$", 1)
    paired = F.col("shown").rlike(r"^(?:[0-9]+|\([0-9]+\))$")
    value = F.when(paired, digits.try_cast("bigint"))
    outcome = (
        F.when(F.coalesce((F.col("title") == "") | (F.col("long") > 200), F.lit(True)), "title").when(~F.col("whole"), "label").when(~F.coalesce(paired, F.lit(False)), "drop")
        .when(F.coalesce(~F.col("level").between(1, 6), F.lit(True)), "level").when(F.coalesce((F.length(digits) > 4) | (value < 1) | (value > F.col("pages") + 200), F.lit(True)), "range").otherwise("keep")
    )
    out = each.select("row_id", "position", "title", value.alias("printed_page"), "level", outcome.alias("outcome"))
    return out.unionByName(errors)


def reusable_labels(needed: DataFrame, batches: DataFrame) -> DataFrame:
    """(book, page, state, numbering, value): what earlier batches tell about needed pages.

    batches: (book, pages array<int>, labels array<struct<page, numbering, value>>). state is 'known', 'empty' (covered, without a
    label), 'conflict' (batches disagree on the labels of the page) or 'missing'. A known page has a row for each of its labels.
    """
    covered = batches.select("book", F.explode("pages").alias("page"), F.coalesce("labels", F.array()).alias("labels"))
    own = F.transform(F.filter("labels", lambda x: x["page"] == F.col("page")), lambda x: F.struct(x["numbering"].alias("numbering"), x["value"].alias("value")))
    told = covered.select("book", "page", F.array_sort(F.array_distinct(own)).alias("l"))
    seen = told.groupBy("book", "page").agg(F.min("l").alias("one"), F.max("l").alias("other"))
    joined = needed.select("book", "page").distinct().join(seen, ["book", "page"], "left")
    state = F.when(F.col("one").isNull(), "missing").when(F.col("one") != F.col("other"), "conflict").when(F.size("one") == 0, "empty").otherwise("known")
    out = joined.select("book", "page", state.alias("state"), F.explode_outer(F.when(state == "known", F.col("one"))).alias("l"))
    return out.select("book", "page", "state", "l.numbering", "l.value")
