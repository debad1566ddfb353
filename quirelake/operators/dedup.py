"""One copy of each message that was delivered at least once.

Identifiers are split by their frequency, from one aggregation with partial sums map-side, so that an identifier with a
third of all rows is one row per task in the shuffle. Messages seen once pass right out of that aggregation; only the repeated groups
are ranked. Of a repeated group the first row by (time, order) is kept, by a map-side-combining minimum, so no task ever
holds one identifier's rows. To list the superfluous rows, rows meet the repeated groups: the identifiers with the most rows (`HOT_IDS`
at most, of proven size) by broadcast, which keeps their rows where they are. A key beyond those has at most one row in HOT_IDS + 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most identifiers that are matched by broadcast; the rest goes through a shuffled join.
HOT_IDS = 1000
#: Rows from which an identifier may count as hot.
HOT_ROWS = 5000
_LATE = "9999-12-31 23:59:59.999999"


def message_key(raw: Column) -> Column:
    """The 128-bit number of an identifier as 32 lower-case digits, however it is written; null where there is none.

    Letter case, hyphens, braces, white space around it and the prefixes urn:uuid: and 0x don't matter. Blank, null and other texts have no number.
    """
    bare = F.regexp_replace(raw, r"[\s\p{Z}\p{Cf}{}()\[\]\"'-]+", "")
    text = F.lower(F.regexp_replace(bare, r"^(?i:(urn:)?(uuid|guid):|0x)", ""))
    return F.when(text.rlike("^[0-9a-f]{32}$"), text)


def _rank(time: Column, order: Column) -> Column:
    return F.struct(F.coalesce(time.cast("timestamp"), F.lit(_LATE).cast("timestamp")).alias("at"), order.isNull().alias("no"), order.alias("id"))


def superfluous(df: DataFrame, raw_id: str = "message_id", time: str = "delivered_at", order: str = "log_id", hot_rows: int = HOT_ROWS) -> DataFrame:
    """The rows to drop: (order), one per delivery beyond the first.

    Of a message the row with the earliest `time`, then the smallest `order`, stays; a null time counts as
    latest, a null `order` behind all others. Rows without an identifier are never superfluous. Of rows that agree in all three one
    stays. Only the three named columns are read.
    """
    rows = df.select(message_key(F.col(raw_id)).alias("key"), _rank(F.col(time), F.col(order)).alias("rank")).where("key is not null")
    repeated = rows.groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("rank").alias("first")).where("times > 1")
    hot = F.broadcast(repeated.where(F.col("times") >= hot_rows).orderBy(F.desc("times"), "key").limit(HOT_IDS).select("key", F.col("first").alias("hot_first")))
    marked = rows.join(hot, "key", "left")
    calm = marked.where("hot_first is null").select("key", "rank").join(repeated.select("key", "first"), "key")
    again = calm.unionByName(marked.where("hot_first is not null").select("key", "rank", F.col("hot_first").alias("first")))
    # rows that agree in everything are counted, and one less than their number is dropped where they come first
    alike = again.groupBy("key", "rank", "first").agg(F.count(F.lit(1)).alias("n"))
    drop = F.col("n") - (F.col("rank") == F.col("first")).cast("bigint")
    return alike.where(drop > 0).select(F.explode(F.sequence(F.lit(1), drop)), F.col("rank.id").alias(order)).select(order)


def deduplicate(
    stored: DataFrame,
    new: DataFrame | None = None,
    raw_id: str = "message_id",
    time: str = "delivered_at",
    order: str = "log_id",
    keep: tuple[str, ...] = ("source", "status"),
) -> DataFrame:
    """Exactly one row per message over stored and new messages: (order, message_key, *keep).

    Rows without an identifier (null, blank or no 128-bit number) stay, with a null key. Rows that agree in identifier, time and
    order are one message; the smallest by `keep` stays. Further columns, also ones with clashing names, are not read.
    """
    cols = [message_key(F.col(raw_id)).alias("key"), _rank(F.col(time), F.col(order)).alias("rank"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]]
    both = stored.select(*cols)
    if new is not None:
        both = both.unionByName(new.select(*cols))
    kept = [f"k{i}" for i in range(len(keep))]
    groups = both.where("key is not null").groupBy("key").agg(F.min(F.struct("rank", *kept)).alias("first"))
    out = groups.select("key", "first.*").unionByName(both.where("key is null"))
    return out.select(F.col("rank.id").alias(order), F.col("key").alias("message_key"), *[F.col(k).alias(c) for k, c in zip(kept, keep)])
