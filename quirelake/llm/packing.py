"""Filling containers of fixed capacity with texts, with little unused room.

Sum-of-squares online packing: a container's fill level is the tokens in it, N(h) the number of open containers at level h.
Each text goes to the level (or an empty container) that gives the smallest sum of N(h)^2 over the partly filled levels,
which keeps all levels thinly populated so that a fit for any coming size is at hand. The level array has one cell per token of capacity.
At the end, when nothing more will come, the containers that are still open are closed up by best fit, largest first.

The order of decisions is inherent, so texts are first spread over shards of bounded size by a hash, each shard packs on
its own and costs at most its open containers. Only (id, size) pairs travel; the texts stay at the scan.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirelake.llm.tokens import TOKENIZER, n_tokens
from quirelake.session import cut_lineage

#: Texts that are packed together by one task.
SHARD_TEXTS = 100_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, in order of arrival. Sizes are 1..capacity."""
    counts = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out = np.empty(len(sizes), dtype=np.int64)
    containers = 0
    for i, s in enumerate(sizes.tolist()):
        if s == capacity:
            out[i] = containers
            containers += 1
            continue
        # change of the sum when an open container at level h goes to h + s; at capacity it is open no longer
        levels = counts[1 : capacity - s + 1]
        change = 2 * (counts[s + 1 : capacity + 1] - levels) + 2
        change[-1:] = 1 - 2 * levels[-1:]
        change = np.where(levels > 0, change, np.iinfo(np.int64).max)
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] <= 2 * counts[s] + 1:
            h = best + 1
            box = open_at[h].pop()
            counts[h] -= 1
            to = h + s
        else:
            box, to = containers, s
            containers += 1
        out[i] = box
        if to < capacity:
            open_at[to].append(box)
            counts[to] += 1
    return _closed(out, sizes, {b for boxes in open_at for b in boxes}, capacity)


def _closed(boxes: np.ndarray, sizes: np.ndarray, still_open: set[int], capacity: int) -> np.ndarray:
    """At the end nothing more will come: the items of containers still open are placed anew, the largest first, each where the
    least room is left. That stands only if it takes fewer containers."""
    items = np.flatnonzero(np.isin(boxes, list(still_open)))
    if len(items) < 2:
        return boxes
    names = sorted(still_open)
    rooms: list[tuple[int, int]] = []  # (room, container), sorted
    placed = {}
    used = 0
    for i in sorted(items.tolist(), key=lambda i: (-sizes[i], i)):
        s = int(sizes[i])
        k = bisect.bisect_left(rooms, (s, -1))
        if k < len(rooms):
            room, box = rooms.pop(k)
        elif used == len(names) - 1:
            return boxes
        else:
            room, box = capacity, names[used]
            used += 1
        placed[i] = box
        bisect.insort(rooms, (room - s, box))
    out = boxes.copy()
    for i, box in placed.items():
        out[i] = box
    return out


def pieces(sizes: pd.Series, capacity: int) -> pd.DataFrame:
    """(row, part, first, size): texts as they are, longer ones than the capacity in full parts and a rest."""
    n = sizes.to_numpy(dtype=np.int64)
    parts = np.maximum((n + capacity - 1) // capacity, 1)
    row = np.repeat(np.arange(len(n)), parts)
    part = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = part * capacity
    return pd.DataFrame({"row": row, "part": part + 1, "first": first, "size": np.minimum(n[row] - first, capacity)})


def pack(
    docs: DataFrame,
    sizes: DataFrame,
    row_id: str = "doc_id",
    text: str = "text",
    pack_id: str = "pack_id",
    capacity: str = "capacity_tokens",
    tokenizer: str = TOKENIZER,
    shard_texts: int = SHARD_TEXTS,
) -> DataFrame:
    """(pack_id, row_id, part, parts, first_token, tokens, container_id, capacity): each text's container for each capacity.

    Texts without a token (null, empty) take no room and get no row. A text longer than the capacity is cut into full
    parts and a rest, the rest being packed like any other item; no other text is split. Rows that hold the same
    text are packed each. A capacity that is null or below 1 has no containers. `row_id` is unique and hashable.
    """
    kind = dict(docs.dtypes)[row_id]
    counted = docs.select(F.col(row_id).alias("_id"), n_tokens(F.col(text).cast("string"), tokenizer).alias("_n")).where("_n > 0")
    counted = cut_lineage(counted)
    shards = max(1, -(-counted.count() // shard_texts))
    caps = sizes.select(F.col(pack_id).cast("string").alias("_pack"), F.col(capacity).cast("bigint").alias("_cap")).where("_cap >= 1")
    caps = [(r["_pack"], r["_cap"]) for r in caps.distinct().limit(MAX_CAPACITIES + 1).collect()]
    if len(caps) > MAX_CAPACITIES:
        raise ValueError(f"more than {MAX_CAPACITIES} capacities")
    each = F.array(*[F.struct(F.lit(p).cast("string").alias("_pack"), F.lit(c).cast("bigint").alias("_cap")) for p, c in caps])
    if not caps:
        each = F.array().cast("array<struct<_pack:string,_cap:bigint>>")
    keyed = counted.select("_id", "_n", F.pmod(F.xxhash64("_id", "_n"), F.lit(shards)).alias("_shard"), F.inline(each))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        cap, shard, name = int(pdf["_cap"].iloc[0]), int(pdf["_shard"].iloc[0]), pdf["_pack"].iloc[0]
        pdf = pdf.sort_values("_id", kind="stable").reset_index(drop=True)
        items = pieces(pdf["_n"], cap)
        box = sum_of_squares(items["size"].to_numpy(), cap)
        total = items.groupby("row")["part"].transform("max")
        return pd.DataFrame(
            {
                "pack_id": name, "row_id": pdf["_id"].to_numpy()[items["row"]], "part": items["part"], "parts": total, "first_token": items["first"],
                "tokens": items["size"], "container_id": [f"{name}-{shard}-{b}" for b in box.tolist()], "capacity": cap,
            }
        )

    schema = f"pack_id string, row_id {kind}, part bigint, parts bigint, first_token bigint, tokens bigint, container_id string, capacity bigint"
    return keyed.groupBy("_pack", "_cap", "_shard").applyInPandas(fill, schema).withColumnRenamed("row_id", row_id)


#: Most rows of the table of capacities.
MAX_CAPACITIES = 1000


def room(packed: DataFrame) -> DataFrame:
    """(pack_id, containers, tokens, least_containers, unused): how full the containers are.

    `least_containers` is what the tokens would need without any unused room.
    """
    boxes = packed.groupBy("pack_id", "capacity", "container_id").agg(F.sum("tokens").alias("tokens"))
    out = boxes.groupBy("pack_id", "capacity").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    least = F.ceil(F.col("tokens") / F.col("capacity"))
    return out.withColumn("least_containers", least).withColumn("unused", 1 - F.col("tokens") / (F.col("containers") * F.col("capacity")))
