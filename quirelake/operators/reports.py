"""Run reports: latest rows, merges, upserts, usage sums, what has to be done again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.operators.nested import _as_list, whole_json

USAGE = ("prompt_tokens", "completion_tokens", "total_tokens", "reported_responses", "unreported_responses")


def latest(df: DataFrame, key: str = "source", order: str = "log_id", keep: tuple[str, ...] = ("status", "source_size", "source_mtime_ns")) -> DataFrame:
    """The last row of each key by `order`: (key, order, *keep). Null and blank keys have none. Map-side combined, no window."""
    rows = df.where(F.trim(F.col(key)) != "")
    best = F.max(F.struct(F.col(order).alias("_o"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])).alias("b")
    out = rows.groupBy(F.col(key).alias("_key")).agg(best)
    return out.select(F.col("_key").alias(key), F.col("b._o").alias(order), *[F.col(f"b._k{i}").alias(c) for i, c in enumerate(keep)])


def status_counts(rows: DataFrame, status: str = "status") -> DataFrame:
    return rows.groupBy(F.lower(F.trim(F.col(status))).alias("status")).agg(F.count(F.lit(1)).alias("books"))


def usage_totals(df: DataFrame, payload: str = "payload", group: str = "job_id") -> DataFrame:
    """(group, rows, with_usage, *USAGE): sums of the usage counters; values that are no whole numbers of 0 and more don't count.

    Text that holds JSON counts as what it holds.
    """
    doc = F.try_variant_get(whole_json(F.col(payload).cast("string")), "$.api_usage", "variant")
    inner = F.coalesce(F.try_variant_get(doc, "$", "map<string,variant>"), F.try_variant_get(whole_json(F.try_variant_get(doc, "$", "string")), "$", "map<string,variant>"))
    rows = df.select(F.col(group).alias("g"), F.when(F.size(inner) > 0, inner).alias("u"))

    def counted(name: str) -> Column:
        v = F.try_element_at(F.col("u"), F.lit(name))
        whole = F.schema_of_variant(v) == "BIGINT"
        n = F.try_variant_get(v, "$", "bigint")
        return F.coalesce(F.sum(F.when(whole & (n >= 0), n)), F.lit(0)).alias(name)

    return rows.groupBy("g").agg(F.count(F.lit(1)).alias("rows"), F.count("u").alias("with_usage"), *[counted(n) for n in USAGE]).withColumnRenamed("g", group)


def accepted_usage(df: DataFrame, payload: str = "payload", group: str = "job_id") -> DataFrame:
    """(group, reported, unreported, prompt_tokens, completion_tokens, total_tokens): usage records that hold together.

    A record counts as reported if its three token counts are whole numbers of 0 and more and the first two make up the third; any other
    readable record, one without usage included, is unreported. Unreadable payloads are neither.
    """
    doc = whole_json(F.col(payload).cast("string"))
    rows = df.select(F.col(group).alias("g"), doc.alias("d")).where("d is not null")
    part = lambda name: F.try_variant_get("d", f"$.api_usage.{name}", "variant")
    whole = lambda name: F.when(F.schema_of_variant(part(name)) == "BIGINT", F.try_variant_get(part(name), "$", "bigint"))
    rows = rows.select("g", *[whole(n).alias(n) for n in USAGE[:3]])
    fits = F.coalesce((F.least(*USAGE[:2]) >= 0) & (F.col("prompt_tokens") + F.col("completion_tokens") == F.col("total_tokens")), F.lit(False))
    fits = fits & F.col("prompt_tokens").isNotNull() & F.col("completion_tokens").isNotNull()
    some = lambda n: F.coalesce(F.sum(F.when(fits, F.col(n))), F.lit(0)).alias(n)
    return rows.groupBy("g").agg(F.count_if(fits).alias("reported"), F.count_if(~fits).alias("unreported"), *[some(n) for n in USAGE[:3]]).withColumnRenamed("g", group)


def usage_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, *USAGE): what was used between two readings of the counters, never less than 0. A key that is missing before counts from 0."""
    old = before.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in USAGE])
    both = after.join(old, after[key].eqNullSafe(old["_k"]), "left")
    return both.select(after[key], *[F.greatest(F.coalesce(after[c], F.lit(0)) - F.coalesce(F.col(f"_{c}"), F.lit(0)), F.lit(0)).cast("bigint").alias(c) for c in USAGE])


def merge_lines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines of both as multisets: what `old` has beyond `new`, and all of `new`. Doing it again with the result changes nothing."""
    return old.exceptAll(new).unionAll(new)


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """One row per key of both sides, `new` first; a column only one side has is null for rows of the other.

    A key that is repeated on one side gives its smallest row (by all columns). Rows with a null or blank key all stay.
    """
    both = new.withColumn("_side", F.lit(0)).unionByName(old.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    named = F.trim(F.col(key).cast("string")) != ""
    rest = [c for c in both.columns if c not in (key, "_side")]
    first = F.min(F.struct("_side", *rest)).alias("_f")
    kept = both.where(named).groupBy(key).agg(first).select(key, *[F.col(f"_f.{c}").alias(c) for c in rest])
    return kept.unionByName(both.where(~F.coalesce(named, F.lit(False))).drop("_side"))


def unchanged(listing: DataFrame, done: DataFrame, key: str, same: tuple[str, ...]) -> DataFrame:
    """Rows of the listing whose key was done with equal values in the columns `same` (nulls equal nulls)."""
    d = done.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_d{i}") for i, c in enumerate(same)])
    ok = listing[key] == d["_k"]
    for i, c in enumerate(same):
        ok = ok & listing[c].eqNullSafe(d[f"_d{i}"])
    return listing.join(d, ok, "left_semi")


def gaps(df: DataFrame, key: str = "book", page: str = "source_page") -> DataFrame:
    """(key, missing): the pages strictly between two contents pages in a row."""
    w = Window.partitionBy(key).orderBy(page)  # one row per contents page
    pages = df.where(F.col(page).isNotNull()).select(key, page).distinct().withColumn("_next", F.lead(page).over(w))
    return pages.where(F.col("_next") > F.col(page) + 1).select(key, F.explode(F.sequence(F.col(page) + 1, F.col("_next") - 1)).alias("missing"))


def flat_summary(df: DataFrame, payload: str = "payload", row_id: str = "log_id") -> DataFrame:
    """One flat row per readable record: lists joined to text, counts of lists, nested members pulled out.

    Entries held as JSON text count as what it holds, a bare object as a list of one.
    """
    doc = whole_json(F.col(payload).cast("string"))
    rows = df.select(F.col(row_id).alias(row_id), doc.alias("d")).where("d is not null")
    get = lambda path, kind: F.try_variant_get("d", f"$.{path}", kind)
    return rows.select(
        row_id, get("source", "string").alias("source"), get("status", "string").alias("status"), get("page_count", "bigint").alias("page_count"),
        F.array_join(get("toc_pages", "array<bigint>"), ",").alias("toc_pages"), F.coalesce(F.size(_as_list(get("entries", "variant"))), F.lit(0)).cast("bigint").alias("entry_count"),
        F.array_join(get("warnings", "array<string>"), "; ").alias("warnings"), get("offsets.arabic", "bigint").alias("arabic_offset"), get("error", "string").alias("error"),
    )
