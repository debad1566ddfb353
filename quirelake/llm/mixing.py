"""Mixing texts of several sources to target shares of all tokens, along a curriculum that varies in time.

Each source has a weight over training time t in [0, 1]: share * (1 + tilt * (2t - 1)); the tilts balance, so the weights add up
to one at every time, and the integral of a source's weight over the whole time is its share. Integrated, the weights give each
source's cumulative token demand; inverting it assigns every use of a text the time at which its tokens are demanded. Uses are
then sorted by range of that position.

A source's order is that of a hash. Its running token sums are built in two steps, over hash buckets and within
one bucket, so a source with any share of all rows is spread over all tasks. Texts stay at the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.llm.tokens import TOKENIZER, n_tokens
from quirelake.session import cut_lineage

#: Texts of one hash bucket of a source, on average; and the most buckets.
BUCKET_TEXTS, MAX_BUCKETS = 20_000, 1 << 16
#: How far the shortest and the longest texts' sources lean to the start and the end of training.
LEAN = 0.5
#: Sources up to which the table of targets is broadcast.
MAX_SOURCES = 10_000


def source_key(source: Column) -> Column:
    """A source's name in one spelling: lower case, without space around it, words joined by an underscore."""
    return F.lower(F.regexp_replace(F.regexp_replace(source, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""), r"[\s\p{Z}_-]+", "_"))


def wanted_sources(targets: DataFrame) -> DataFrame:
    """(source, share, max_repeats) of each listed source with a share, spellings of a source united: shares add up, the most repeats count."""
    return (
        targets.select(source_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("bigint").alias("max_repeats"))
        .where("source is not null and share > 0")
        .groupBy("source")
        .agg(F.sum("share").alias("share"), F.max(F.greatest("max_repeats", F.lit(0))).alias("max_repeats"))
    )


def small(df: DataFrame) -> DataFrame:
    """df to be broadcast if it has few rows, else as it is."""
    return F.broadcast(df) if df.limit(MAX_SOURCES + 1).count() <= MAX_SOURCES else df


def sized(docs: DataFrame, listed: DataFrame, row_id: str, text: str, source: str, tokenizer: str) -> DataFrame:
    """(id, source, tokens): one row per distinct text of the listed sources that has tokens, under its smallest id and that row's source."""
    mine = docs.select(F.col(row_id).alias("id"), source_key(F.col(source)).alias("source"), F.col(text).cast("string").alias("text"))
    mine = mine.join(small(listed.select("source")), "source", "left_semi")
    slim = mine.select("id", "source", F.md5(F.col("text").cast("binary")).alias("same"), n_tokens(F.col("text"), tokenizer).alias("tokens")).where("tokens > 0")
    return slim.groupBy("same").agg(F.min(F.struct("id", "source", "tokens")).alias("first")).select("first.*")


def plan(docs: DataFrame, wanted: DataFrame, total_tokens: int | str | None) -> DataFrame:
    """(source, share, max_repeats, tokens, texts, demand, supply, use, tilt) of each listed source; as many rows as targets.

    demand = share * total; supply = tokens * max_repeats; use = the smaller one. The total is `total_tokens`, by default the
    largest one at which every source that has texts reaches its share; beyond it small sources fall short. "all" stands for the tokens of
    all texts of listed sources, each counted once.
    """
    have = docs.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    out = wanted.join(have, "source", "left").fillna(0, ["tokens", "texts", "max_repeats"])
    every = Window.partitionBy(F.lit(1))  # over the sources
    most = F.when(F.col("tokens") * F.col("max_repeats") > 0, F.col("tokens") * F.col("max_repeats") / F.col("share"))
    if total_tokens == "all":
        total = F.sum("tokens").over(every).cast("double")
    else:
        total = F.lit(total_tokens).cast("double") if total_tokens is not None else F.coalesce(F.min(most).over(every), F.lit(0.0))
    rank = F.percent_rank().over(every.orderBy(F.col("tokens") / F.greatest("texts", F.lit(1)), "source"))
    lean = LEAN * (2 * rank - 1)
    out = out.withColumn("total", total).withColumn("lean", lean)
    middle = F.sum(F.col("share") * F.col("lean")).over(every) / F.sum("share").over(every)
    return out.select(
        "source", "share", "max_repeats", "tokens", "texts", (F.col("share") * F.col("total")).alias("demand"), (F.col("tokens") * F.col("max_repeats")).cast("double").alias("supply"),
        F.least(F.col("share") * F.col("total"), F.col("tokens") * F.col("max_repeats")).alias("use"), (F.col("lean") - middle).alias("tilt"),
    )


def when_demanded(y: Column, tilt: Column) -> Column:
    """The time t at which the share y of a source's tokens is demanded: the inverse of t + tilt * (t^2 - t)."""
    below = (1 - tilt) + F.sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * y)
    return F.when(below > 0, 2 * y / below).otherwise(F.lit(0.0))


def mix(
    docs: DataFrame,
    targets: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total_tokens: int | str | None = None,
    tokenizer: str = TOKENIZER,
) -> tuple[DataFrame, DataFrame]:
    """(uses, plan). uses: (row_id, source, tokens, pass, position), sorted by range of position, a row per use of a text.

    A source uses whole texts in hash order, again from the start in each further pass, until its use is reached; the
    text that reaches it belongs in if at least half of it does. A source that can't reach its share is used
    max_repeats times and falls short; the others keep their own amounts. Texts of unlisted or null sources and texts without
    tokens aren't used. The same text under several ids counts once, under the smallest id. Ties in the hash order are
    broken by the id. An empty table gives no uses.
    """
    wanted = wanted_sources(targets)
    ready = cut_lineage(sized(docs, wanted, row_id, text, source, tokenizer))
    n = ready.count()
    per_source = plan(ready, wanted, total_tokens)
    buckets = min(MAX_BUCKETS, max(16, 1 << (n // BUCKET_TEXTS).bit_length()))
    order = F.xxhash64(F.lit("mix"), F.col("id"))
    bucket = F.pmod(F.shiftrightunsigned(order, 40), F.lit(buckets)).cast("int")
    placed = ready.join(small(per_source.select("source", "use", "tilt", F.col("tokens").alias("all"), "max_repeats")), "source").withColumn("b", bucket)
    # running sums: over the buckets of a source (a table of sources x buckets), then within a bucket
    sums = placed.groupBy("source", "b").agg(F.sum("tokens").alias("n"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "b").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, -1)
    run = placed.withColumn("run", F.coalesce(F.sum("tokens").over(inside), F.lit(0)))
    run = run.join(starts, ["source", "b"]).withColumn("at", F.col("start") + F.col("run"))
    # uses: passes k = 1, 2, ... whose middle token is still within the use of the source
    passes = F.least(F.floor((F.col("use") - F.col("at") - F.col("tokens") / 2) / F.col("all")) + 1, F.col("max_repeats")).cast("int")
    used = run.withColumn("uses", passes).where("uses >= 1")
    each = used.select("id", "source", "tokens", "tilt", "use", "all", "at", F.explode(F.sequence(F.lit(1), F.col("uses"))).alias("pass"))
    y = F.least(((F.col("pass") - 1) * F.col("all") + F.col("at")) / F.col("use"), F.lit(1.0))
    out = each.select(F.col("id").alias(row_id), "source", "tokens", "pass", F.greatest(when_demanded(y, F.col("tilt")), F.lit(0.0)).alias("position"))
    return out.repartitionByRange("position").sortWithinPartitions("position", row_id, "pass"), per_source


def counted(uses: DataFrame, row_id: str = "doc_id") -> DataFrame:
    """(row_id, source, tokens, uses): the chosen texts with their number of uses."""
    return uses.groupBy(row_id, "source", "tokens").agg(F.max("pass").cast("bigint").alias("uses"))


def shares(uses: DataFrame, per_source: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens_used, texts_used, most_uses, reached): one row per listed source."""
    got = uses.groupBy("source").agg(F.sum("tokens").alias("tokens_used"), F.countDistinct("doc_id").alias("texts_used"), F.max("pass").alias("most_uses"))
    out = per_source.join(got, "source", "left").fillna(0, ["tokens_used", "texts_used", "most_uses"])
    total = F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))
    return out.select(
        "source", F.col("share").alias("target_share"), (F.col("tokens_used") / F.greatest(total, F.lit(1))).alias("actual_share"), "tokens_used", "texts_used", "most_uses",
        (F.col("supply") >= F.col("demand")).alias("reached"),
    )
