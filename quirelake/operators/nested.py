"""Deeply nested JSON records -> related flat tables.

The shape is not declared: a first distributed pass walks the records and merges what it sees into one
schema (path pattern -> JSON kinds), a table of its own. One figure of it drives the plan: how often a
self-containing list has to be exploded. The second pass is a chain of narrow explodes, one per array level, in which
every row carries its parent's key and its own ordinal; there is no shuffle and no join. Trees of more than ROUND
levels are exploded in rounds: only the nodes at the last level that still have children go on, from a checkpoint.

Reading rules: text that holds JSON counts as what it holds; a bare object where a list belongs is a list
of one; ordinals start at 1 and count null elements; nulls, absent members, empty lists and empty objects,
elements that are no objects, and records that are not readable JSON as a whole give no row. JSON nested deeper than
the 1000 levels of Spark's own parser is not readable.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.session import cut_lineage

#: Levels of a self-containing list that are exploded in one plan.
ROUND = 24
_KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", int: "number", float: "number", type(None): "null"}


@dataclass(frozen=True)
class Member:
    """A nested member of a record. `again` names the member of each element that holds elements of the same kind."""

    name: str
    many: bool = True
    again: str | None = None


def _loaded(value):
    """The value a JSON text holds, also where it is wrapped in another JSON text."""
    for _ in range(2):
        if not isinstance(value, str):
            return value
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return None if isinstance(value, str) else value


def _walk(value, path: str, seen: set[tuple[str, str]]) -> None:
    todo = [(value, path)]
    while todo:
        value, path = todo.pop()
        seen.add((path, _KINDS[type(value)]))
        if isinstance(value, str) and value[:1] in '[{"':
            inner = _loaded(value)
            if isinstance(inner, (dict, list)):
                value = inner
        if isinstance(value, dict):
            todo += [(v, f"{path}.{k}" if path else k) for k, v in value.items()]
        elif isinstance(value, list):
            todo += [(v, f"{path}[]") for v in value]


def infer_schema(df: DataFrame, json_col: str, only: Sequence[str] | None = None) -> DataFrame:
    """Merged schema of a JSON column: (path, kind), the JSON kinds met at each path pattern, a row for each.

    `only` limits the walk to those members of the record. Lists add "[]" to a path. Unreadable records and nulls
    add nothing; an empty table gives an empty schema. Each task merges what it sees before the shuffle; the result stays a table,
    however many paths there are.
    """
    wanted = set(only) if only is not None else None

    def batches(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[str, str]] = set()
        for pdf in it:
            for text in pdf["_json"]:
                if text is None:
                    continue
                value = _loaded(text)
                if wanted is not None:
                    value = {k: v for k, v in value.items() if k in wanted} if isinstance(value, dict) else None
                if value is not None:
                    _walk(value, "", seen)
            if len(seen) > FLUSH:
                yield pd.DataFrame(sorted(seen), columns=["path", "kind"])
                seen = set()
        yield pd.DataFrame(sorted(seen), columns=["path", "kind"])

    return df.select(F.col(json_col).cast("string").alias("_json")).mapInPandas(batches, "path string, kind string").distinct()


#: Paths that a task holds before it hands them on.
FLUSH = 100_000


def levels_of(schema: DataFrame, members: Sequence[Member], record: bool = True) -> int:
    """How many array levels the members have in a merged schema: 1, or more where one contains itself.

    In a schema of records only paths under a member count for it, in one of bare members all paths do. One number reaches the driver.
    """
    parts = F.split(F.regexp_replace("path", r"\[\]", ""), r"\.")
    times = lambda name: F.size(F.filter(parts, lambda p: p == name))
    deep = [F.when(F.lit(not record) | (F.element_at(parts, 1) == m.name), times(m.again)) for m in members if m.again]
    if not deep:
        return 1
    return 1 + (schema.agg(F.max(F.greatest(*deep) if len(deep) > 1 else deep[0]).alias("n")).collect()[0]["n"] or 0)


#: Fixed value. Put behind a text before parsing, since the parser itself stops at the end of the first value.
_END = "\u241fend\u241f"


def whole_json(text: Column) -> Column:
    """The variant of a text that is readable JSON as a whole; null if it is cut, followed by anything, blank or null."""
    both = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]'))), "$", "array<variant>")
    last = lambda x: F.try_variant_get(F.try_element_at(x, F.lit(2)), "$", "string")
    return _let(both, lambda x: F.when((F.size(x) == 2) & (last(x) == _END), F.try_element_at(x, F.lit(1))))


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _arr(v: Column) -> Column:
    return F.try_variant_get(v, "$", "array<variant>")


def _obj(v: Column) -> Column:
    return F.try_variant_get(v, "$", "map<string,variant>")


def _parsed(v: Column) -> Column:
    return whole_json(F.try_variant_get(v, "$", "string"))


def _as_object(v: Column) -> Column:
    return _let(v, lambda x: F.coalesce(_obj(x), _obj(_parsed(x))))


def _as_list(v: Column) -> Column:
    plain = lambda x: F.coalesce(_arr(x), F.when(_obj(x).isNotNull(), F.array(x)))
    return _let(v, lambda x: F.coalesce(plain(x), _let(_parsed(x), plain)))


def _items(table: Column, prefix: Column, parent: Column, values: Column) -> Column:
    """Array of child rows of one node, null and empty elements left out after they were counted."""
    rows = F.transform(
        values,
        lambda x, i: F.struct(
            table.alias("table"),
            F.concat(prefix, F.lit("["), (i + 1).cast("string"), F.lit("]")).alias("path"),
            parent.alias("parent_path"),
            (i + 1).cast("bigint").alias("ordinal"),
            _as_object(x).alias("node"),
        ),
    )
    return F.filter(rows, lambda r: F.size(r["node"]) > 0)


def flatten(df: DataFrame, json_col: str, row_id: str, members: Sequence[Member], record: bool = True, levels: int | None = None) -> DataFrame:
    """All nested items of all records: (row_id, table, path, parent_path, ordinal, depth, node).

    `record=True`: the column holds an object with those members. `record=False`: it holds the value of the single member
    itself. `node` is the item as map<string,variant>; (row_id, path) is the item's key and (row_id, parent_path)
    its parent's, the empty path standing for the record. Every input row counts, repeated ones too; other columns
    of `df` are ignored, whatever their names. Rows with a null or unreadable text give nothing. `levels` is the depth of the merged
    schema where it is known.
    """
    if not record and len(members) != 1:
        raise ValueError("a column without a record around it holds one member")
    if levels is None:
        again = any(m.again for m in members)
        levels = levels_of(infer_schema(df, json_col, [m.name for m in members] if record else None), members, record) if again else 1
    raw = whole_json(F.col(json_col).cast("string"))
    rows = df.select(F.col(row_id).alias("row_id"), raw.alias("_doc"))
    if record:
        rows = rows.select("row_id", F.explode(F.array(_as_object(F.col("_doc")))).alias("_doc")).where("_doc is not null")
        values = [F.element_at("_doc", m.name) for m in members]
    else:
        values = [F.col("_doc")]
    rows = rows.select("row_id", *[v.alias(f"_m{i}") for i, v in enumerate(values)])
    none = F.lit("")
    parts = []
    for i, m in enumerate(members):
        if m.many:
            parts.append(F.coalesce(_items(F.lit(m.name), F.lit(m.name), none, _as_list(F.col(f"_m{i}"))), F.array()))
        else:
            one = F.struct(
                F.lit(m.name).alias("table"), F.lit(m.name).alias("path"), none.alias("parent_path"),
                F.lit(1).cast("bigint").alias("ordinal"), _as_object(F.col(f"_m{i}")).alias("node"),
            )
            parts.append(F.filter(F.array(one), lambda r: F.size(r["node"]) > 0))
    rows = rows.select("row_id", F.inline(F.concat(*parts) if len(parts) > 1 else parts[0])).withColumn("depth", F.lit(1))
    children = {m.name: m.again for m in members if m.again}
    done = None
    for level in range(1, levels):
        if level % ROUND == 0:
            rows = cut_lineage(rows)
            finished = rows.where(F.col("depth") < level)
            done = finished if done is None else done.unionByName(finished)
            rows = rows.where(F.col("depth") == level)
        rows = _one_level_down(rows, level, children)
    return rows if done is None else done.unionByName(rows)


def _one_level_down(rows: DataFrame, level: int, children: dict[str, str]) -> DataFrame:
    """The rows themselves, and behind each that was found in the last step its elements one level further down."""
    inner = F.lit(None).cast("array<variant>")
    prefix = F.col("path")
    for name, child in children.items():
        mine = (F.col("table") == name) & (F.col("depth") == level)
        inner = F.when(mine, _as_list(F.element_at("node", child))).otherwise(inner)
        prefix = F.when(F.col("table") == name, F.concat("path", F.lit(f".{child}"))).otherwise(prefix)
    own = F.array(F.struct("table", "path", "parent_path", "ordinal", "node", "depth"))
    below = F.transform(
        F.coalesce(_items(F.col("table"), prefix, F.col("path"), F.col("_inner")), F.array()),
        lambda r: F.struct(r["table"], r["path"], r["parent_path"], r["ordinal"], r["node"], F.lit(level + 1).alias("depth")),
    )
    return rows.withColumn("_inner", inner).select("row_id", F.inline(F.concat(own, below)))


def child_tables(items: DataFrame, columns: dict[str, dict[str, str]]) -> dict[str, DataFrame]:
    """One flat table per member: keys, parent keys, ordinal and the typed columns named for it.

    `columns` maps a member to {column: SQL type}; a value of another kind becomes null. Column names that clash
    with the key columns get the suffix "_value".
    """
    keys = ["row_id", "path", "parent_path", "ordinal", "depth"]
    out = {}
    for name, wanted in columns.items():
        cells = [
            F.try_variant_get(F.element_at("node", c), "$", kind).alias(c if c not in keys else f"{c}_value")
            for c, kind in wanted.items()
        ]
        out[name] = items.where(F.col("table") == name).select(*keys, *cells)
    return out
