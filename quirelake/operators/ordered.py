"""Ordered scans per key that stay spread over tasks when one key holds a large part of all rows.

A key's rows are cut into chunks by their order number. Chunks are summed up on their own, the sums are scanned (a table
smaller by the factor CHUNK), and each chunk is scanned again with what came before it, or after it. Windows are
partitioned by (key, chunk) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Order numbers per chunk.
CHUNK = 4096
#: Where the chunks of rows without an order begin; they come first, in chunks of their tie numbers.
_UNORDERED = -(1 << 61)


def chunked(df: DataFrame, key: str, order: str, tie: str, chunk: int = CHUNK) -> DataFrame:
    """df with _chunk and _pos, the 1-based position of a row in its key by (order, tie). Null orders come first."""
    whole = dict(df.dtypes)[tie] in ("tinyint", "smallint", "int", "bigint")
    unordered = F.coalesce(F.floor(F.col(tie) / chunk), F.lit(0)) + F.lit(_UNORDERED) if whole else F.lit(_UNORDERED)
    df = df.withColumn("_chunk", F.coalesce(F.floor(F.col(order) / chunk), unordered).cast("bigint"))
    counts = df.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    df = df.join(starts, df[key].eqNullSafe(starts["_k"]) & (df["_chunk"] == starts["_c"])).drop("_k", "_c")
    inside = Window.partitionBy(key, "_chunk").orderBy(F.col(order), F.col(tie))
    return df.withColumn("_pos", F.col("_start") + F.row_number().over(inside)).drop("_start")


_LAST, _FIRST = (lambda c: F.last(c, ignorenulls=True)), (lambda c: F.first(c, ignorenulls=True))
_OVER = {"min": F.min, "max": F.max, "sum": F.sum, "last": _LAST, "next": _FIRST, "least": F.min, "most": F.max}


def scans(df: DataFrame, key: str, wanted: dict[str, tuple[Column, str, bool]]) -> DataFrame:
    """df of `chunked` with values over other rows of its key, all in one pass: name -> (value, how, inclusive).

    how is 'min', 'max', 'sum' or 'last' over the rows so far ('last': the latest non-null value), 'next', the first non-null value of the
    rows behind, or 'least' and 'most' over all rows of the key. `inclusive` says whether the row itself counts.
    """
    df = df.withColumns({f"_v_{n}": v for n, (v, _, _) in wanted.items()})
    at = lambda n: F.when(F.col(f"_v_{n}").isNotNull(), F.col("_pos"))
    whole = {"last": lambda n: F.max_by(f"_v_{n}", at(n)), "next": lambda n: F.min_by(f"_v_{n}", at(n))}
    sums = [whole.get(how, lambda n, how=how: _OVER[how](f"_v_{n}"))(n).alias(f"_w_{n}") for n, (_, how, _) in wanted.items()]
    by = Window.partitionBy(key)
    others = {
        "next": by.orderBy("_chunk").rowsBetween(1, Window.unboundedFollowing), "least": by, "most": by,
    }
    earlier = by.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = [_OVER[how](F.col(f"_w_{n}")).over(others.get(how, earlier)).alias(f"_carry_{n}") for n, (_, how, _) in wanted.items()]
    carry = df.groupBy(key, "_chunk").agg(*sums).select(F.col(key).alias("_k"), F.col("_chunk").alias("_c"), *carried)
    df = df.join(carry, df[key].eqNullSafe(carry["_k"]) & (df["_chunk"] == carry["_c"])).drop("_k", "_c")
    inside = Window.partitionBy(key, "_chunk").orderBy("_pos")
    out = {}
    for n, (_, how, inclusive) in wanted.items():
        beyond = F.col(f"_carry_{n}")
        frame = inside.rowsBetween(0 if inclusive else 1, Window.unboundedFollowing) if how == "next" else inside.rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        here = beyond if how in ("least", "most") else _OVER[how](F.col(f"_v_{n}")).over(frame)
        joined = {"min": F.least, "max": F.greatest, "last": F.coalesce, "next": F.coalesce, "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))}
        out[n] = joined[how](here, beyond) if how in joined else beyond
    return df.withColumns(out).drop(*[f"_v_{n}" for n in wanted], *[f"_carry_{n}" for n in wanted])
