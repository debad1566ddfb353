"""Schemas that drift between files: one consistent table, and a record of every change.

Every file has a fingerprint: which of the tracked fields it holds, under which name and as which JSON kind. A fingerprint is a
schema version, and `plan_of` gives the chain of migration steps that makes it the present one: rename, then default, then cast.
`unify` routes each record through the chain of its file's version; where a record differs from its file, or its file's version lacks a field
it holds, through the chain of its own shape. Changes come from grouping each file with the one before it, so a job with a third of all
files is spread over all tasks; files are built by map-side-combining counts, so is a file with a third of all rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelake.operators.nested import whole_json

KINDS = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean"}


@dataclass(frozen=True)
class Rename:
    """`pattern` is matched against a member's name in lower case without separators."""

    version: int
    field: str
    names: tuple[str, ...]
    pattern: str


@dataclass(frozen=True)
class Default:
    version: int
    field: str
    value: str


@dataclass(frozen=True)
class Cast:
    version: int
    field: str
    kind: str
    rule: str


# The names under which the fields are known, one line a field; the pattern also takes their variants.
RENAMES = (
    Rename(1, "toc_bookmark", ("toc_bookmark", "tocBookmark", "TocBookmark", "toc-bookmark", "toc_mark", "bookmark_to_toc", "contents_bookmark"), r"^(?=.*(toc|contents))(?=.*mark).*$"),
    Rename(1, "review_acceptable", ("review_acceptable", "reviewAcceptable", "review-acceptable", "acceptable", "acceptable_after_review", "can_be_accepted", "review_ok"), r"^.*acceptable.*$|^canbeaccepted$|^reviewok$"),
    Rename(1, "toc_corrections", ("toc_corrections", "tocCorrections", "toc-corrections", "toc_corr", "toc_fixes", "corrections", "corrections_made"), r"^(toc)?(corr|corrections|fixes)(made)?$"),
)
DEFAULTS = (Default(2, "review_acceptable", "false"), Default(2, "toc_corrections", "[]"))
CASTS = (
    Cast(3, "toc_bookmark", "array", "[title, page] -> struct"),
    Cast(3, "toc_bookmark", "string", "JSON text, 'title@page' or 'title (p. page)' -> struct"),
    Cast(3, "review_acceptable", "number", "0 -> false, other -> true"),
    Cast(3, "review_acceptable", "string", "yes/no word -> boolean"),
    Cast(3, "toc_corrections", "object", "{action: items} -> list of actions"),
    Cast(3, "toc_corrections", "string", "JSON text, 'action:page,page; ...' or 'none' -> list of actions"),
)
FIELDS = tuple(r.field for r in RENAMES)
# Words for yes.
_YES = ("true", "yes", "y", "1", "ok", "t", "是", "ja", "oui", "да")
_NO = ("false", "no", "n", "0", "f", "否", "nein", "non", "нет")


def canonical(name: str) -> str | None:
    """The field a member's name stands for, None if it is none of the tracked ones."""
    bare = re.sub(r"[\W_]", "", name).lower()
    return next((r.field for r in RENAMES if name in r.names or re.match(r.pattern, bare)), None)


def plan_of(field: str, name: str | None, kind: str | None) -> list[Rename | Default | Cast]:
    """The chain of steps for a field that a file holds as (name, kind), or doesn't hold (None, None)."""
    if name is None:
        return [d for d in DEFAULTS if d.field == field]
    steps: list[Rename | Default | Cast] = [r for r in RENAMES if r.field == field and name != field]
    return steps + [c for c in CASTS if c.field == field and c.kind == kind]


def _field_of(name: Column) -> Column:
    bare = F.lower(F.regexp_replace(name, r"[\W_]", ""))
    out = F.lit(None).cast("string")
    for r in RENAMES:
        out = F.when(name.isin(*r.names) | bare.rlike(r.pattern), r.field).otherwise(out)
    return out


def _kind_of(value: Column) -> Column:
    head = F.regexp_extract(F.schema_of_variant(value), "^([A-Z]+)", 1)
    out = F.when(head == "VOID", F.lit(None)).otherwise(F.lit("number"))
    for k, v in KINDS.items():
        out = F.when(head == k, v).otherwise(out)
    return out


def held(df: DataFrame, payload: str, *keys: str) -> DataFrame:
    """(*keys, fields): the tracked members of each readable payload as array<struct<field, name, kind, value>>.

    Members that are JSON null are left out. Unreadable, null and non-object payloads give an empty array.
    """
    doc = F.try_variant_get(whole_json(F.col(payload).cast("string")), "$", "map<string,variant>")
    pairs = df.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.map_entries(doc).alias("pairs"))
    named = F.transform(
        F.filter("pairs", lambda p: _field_of(p["key"]).isNotNull()),
        lambda p: F.struct(_field_of(p["key"]).alias("field"), p["key"].alias("name"), _kind_of(p["value"]).alias("kind"), p["value"].alias("value")),
    )
    fields = F.filter(F.coalesce(named, F.array()), lambda x: x["kind"].isNotNull())
    return pairs.select(*[F.col(f"_key{i}").alias(k) for i, k in enumerate(keys)], fields.alias("fields"))


def fingerprints(df: DataFrame, payload: str = "payload", job: str = "job_id", file: str = "file_no") -> DataFrame:
    """One row per file: (job, file, held map<field, struct<name, kind>>, fingerprint).

    If a file itself is mixed, its most frequent (name, kind) of a field counts, the smallest on ties. Rows with a null
    job or file belong to no file and are left out; files without a readable payload hold nothing.
    """
    seen = held(df.where(F.col(job).isNotNull() & F.col(file).isNotNull()), payload, job, file)
    none = F.struct(F.lit("").alias("field"), F.lit("").alias("name"), F.lit("").alias("kind"))
    slim = F.transform("fields", lambda x: F.struct(x["field"].alias("field"), x["name"].alias("name"), x["kind"].alias("kind")))
    rows = seen.select(F.col(job).alias("job"), F.col(file).cast("bigint").alias("file"), F.inline(F.concat(F.array(none), slim)))
    counts = rows.groupBy("job", "file", "field", "name", "kind").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "name", "kind"))
    files = counts.groupBy("job", "file", "field").agg(best.alias("b"))
    entry = F.when(F.col("field") != "", F.struct("field", F.struct("b.name", "b.kind").alias("as")))
    out = files.groupBy("job", "file").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("held"))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("held")), lambda e: F.concat_ws(":", e["key"], e["value"]["name"], e["value"]["kind"])), ";")
    return out.withColumn("fingerprint", F.sha2(text, 256))


def changes(df: DataFrame, payload: str = "payload", job: str = "job_id", file: str = "file_no") -> DataFrame:
    """(job_id, file_no, field_name, change): what a file holds otherwise than the file before it of the same job.

    'added', 'removed', 'renamed', 'retyped'; the last two can both hold. A file without a predecessor (file_no - 1
    has no row at all) has no changes; a predecessor that holds nothing makes all fields 'added'.
    """
    files = fingerprints(df, payload, job, file)
    # each file once as itself and once as the predecessor of the next number: one grouping, the log is read once
    seats = F.array(
        F.struct(F.col("file").alias("at"), F.col("held").alias("held"), F.lit(None).cast("map<string,struct<name:string,kind:string>>").alias("old")),
        F.struct((F.col("file") + 1).alias("at"), F.lit(None).cast("map<string,struct<name:string,kind:string>>").alias("held"), F.col("held").alias("old")),
    )
    sides = files.select("job", F.inline(seats)).groupBy("job", "at").agg(F.first("held", ignorenulls=True).alias("held"), F.first("old", ignorenulls=True).alias("old"))
    pairs = sides.where("held is not null and old is not null")
    found = []
    for f in FIELDS:
        old, new = F.try_element_at("old", F.lit(f)), F.try_element_at("held", F.lit(f))
        for change, when in (
            ("added", old.isNull() & new.isNotNull()),
            ("removed", old.isNotNull() & new.isNull()),
            ("renamed", old["name"] != new["name"]),
            ("retyped", old["kind"] != new["kind"]),
        ):
            found.append(F.when(when, F.struct(F.lit(f).alias("field_name"), F.lit(change).alias("change"))))
    rows = pairs.select(F.col("job").alias("job_id"), F.col("at").alias("file_no"), F.inline(F.array_compact(F.array(*found))))
    return rows


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


_ACTIONS = "array<struct<action:string,items:string>>"
_MARK = "struct<title:string,pdf_page:int>"


def _mark_of_pair(v: Column) -> Column:
    pair = F.try_variant_get(v, "$", "array<variant>")
    at = lambda i: F.try_element_at(pair, F.lit(i))
    return F.when(pair.isNotNull(), F.struct(_text(at(1)).alias("title"), F.try_variant_get(at(2), "$", "int").alias("pdf_page")).cast(_MARK))


def _mark_of_text(v: Column) -> Column:
    text = _text(v)
    pattern = r"^(.*?)\s*(?:@|\(p\.\s*)(\d{1,9})\)?$"
    spelled = F.struct(
        F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text).alias("title"),
        F.regexp_extract(text, pattern, 2).try_cast("int").alias("pdf_page"),
    )
    return F.coalesce(F.try_variant_get(whole_json(text), "$", _MARK), F.when(text.isNotNull(), spelled.cast(_MARK)))


def _flag_of_word(v: Column) -> Column:
    word = F.lower(F.trim(_text(v)))
    return F.when(word.isin(*_YES), True).when(word.isin(*_NO), False)


def _actions_of_list(v: Column) -> Column:
    items = lambda e: F.coalesce(F.try_variant_get(e, "$.pages", "string"), F.try_variant_get(e, "$.entries", "string"))
    listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda e: F.struct(F.try_variant_get(e, "$.action", "string").alias("action"), items(e).alias("items")))
    return listed.cast(_ACTIONS)


def _actions_of_map(v: Column) -> Column:
    pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,string>"))
    return F.transform(pairs, lambda e: F.struct(e["key"].alias("action"), e["value"].alias("items"))).cast(_ACTIONS)


def _actions_of_text(v: Column) -> Column:
    text = F.trim(_text(v))
    parts = F.transform(
        F.filter(F.split(text, r"\s*;\s*"), lambda p: p != ""),
        lambda p: F.struct(F.regexp_extract(p, r"^([^:]*)", 1).alias("action"), F.nullif(F.regexp_extract(p, r"^[^:]*:(.*)$", 1), F.lit("")).alias("items")),
    )
    return F.when((text == "") | (F.lower(text) == "none"), F.array().cast(_ACTIONS)).otherwise(F.coalesce(_actions_of_list(whole_json(text)), parts.cast(_ACTIONS)))


# What reads a field in its present kind, what a cast step does, and what a default step puts in.
_READ = {
    "toc_bookmark": lambda v: F.try_variant_get(v, "$", _MARK),
    "review_acceptable": lambda v: F.try_variant_get(v, "$", "boolean"),
    "toc_corrections": _actions_of_list,
}
_CAST = {
    ("toc_bookmark", "array"): _mark_of_pair,
    ("toc_bookmark", "string"): _mark_of_text,
    ("review_acceptable", "number"): lambda v: F.try_variant_get(v, "$", "double") != 0,
    ("review_acceptable", "string"): _flag_of_word,
    ("toc_corrections", "object"): _actions_of_map,
    ("toc_corrections", "string"): _actions_of_text,
}
_PUT = {"review_acceptable": lambda: F.lit(False), "toc_corrections": lambda: F.array().cast(_ACTIONS)}


def _code(step: Rename | Default | Cast) -> str:
    return {Rename: "rename", Default: "default"}.get(type(step)) or f"cast from {step.kind}"


def _chain(field: str, name: Column, kind: Column) -> Column:
    """array<string>: the codes of the steps that `plan_of` gives for a field held as (name, kind), or not held."""
    key = F.when(name.isNull(), "-").otherwise(F.concat_ws("|", F.when(name == field, "own").otherwise("other"), kind))
    plans = {"-": plan_of(field, None, None)}
    for k in (*KINDS.values(), "number"):
        plans[f"own|{k}"], plans[f"other|{k}"] = plan_of(field, field, k), plan_of(field, "", k)
    codes = [x for k, steps in plans.items() for x in (F.lit(k), F.array(*[F.lit(_code(s)) for s in steps]).cast("array<string>"))]
    return F.element_at(F.create_map(*codes), key)


def _held_as(fields: Column, field: str) -> Column:
    """The one member that holds a field: under its present name if there is one, else under the smallest name."""
    own = F.filter(fields, lambda x: x["field"] == field)
    ranked = F.transform(own, lambda x: F.struct((x["name"] != field).alias("alias"), x["name"].alias("name")))
    name = F.array_min(ranked)["name"]
    return F.try_element_at(F.filter(own, lambda x: x["name"] == name), F.lit(1))


def _named(plan: Column, field: str, name: Column) -> Column:
    """The steps of a chain in words."""
    word = lambda c: F.when(c == "rename", F.concat(F.lit("rename "), name, F.lit(f" -> {field}"))).when(c == "default", f"default {field}").otherwise(F.concat(F.lit(f"cast {field} "), F.substring(c, 6, 99)))
    return F.transform(plan, word)


def unify(df: DataFrame, payload: str = "payload", row_id: str = "log_id", job: str = "job_id", file: str = "file_no") -> DataFrame:
    """One consistent table of the tracked fields, a row per input row:

    (row_id, job_id, file_no, readable, version, toc_bookmark struct<title, pdf_page>, review_acceptable boolean,
    toc_corrections array<struct<action, items>>, steps array<string>). `version` is the fingerprint of the row's file, null without a job or
    file. A readable record that lacks a field gets its default; an unreadable one has nulls. A value no rule can cast becomes null.
    `steps` names the steps that were applied. If one record holds a field under several names, the present name wins, then the smallest.
    """
    slim = df.select(F.col(row_id).alias("_r"), F.col(job).alias("_j"), F.col(file).cast("bigint").alias("_f"), F.col(payload).cast("string").alias("_p"))
    rows = held(slim.withColumn("_ok", F.try_variant_get(whole_json(F.col("_p")), "$", "map<string,variant>").isNotNull()), "_p", "_r", "_j", "_f", "_ok")
    for f in FIELDS:
        rows = rows.withColumn(f"_x_{f}", _held_as(F.col("fields"), f))
    rows = rows.drop("fields")
    # one row a file: its version and the chain of each field
    versions = fingerprints(df, payload, job, file).select("job", "file", "fingerprint", *[F.try_element_at("held", F.lit(f)).alias(f"_h_{f}") for f in FIELDS])
    versions = versions.withColumns({f"_plan_{f}": _chain(f, F.col(f"_h_{f}")["name"], F.col(f"_h_{f}")["kind"]) for f in FIELDS})
    routed = rows.join(versions, (rows["_j"] == versions["job"]) & (rows["_f"] == versions["file"]), "left")
    out, steps = [], []
    for f in FIELDS:
        x, h = F.col(f"_x_{f}"), F.col(f"_h_{f}")
        as_file = x["name"].eqNullSafe(h["name"]) & x["kind"].eqNullSafe(h["kind"]) & F.col("fingerprint").isNotNull()
        plan = F.when(as_file, F.col(f"_plan_{f}")).otherwise(_chain(f, x["name"], x["kind"]))
        value = _READ[f](x["value"])
        for (field, kind), rule in _CAST.items():
            if field == f:
                value = F.when(F.array_contains(plan, f"cast from {kind}"), rule(x["value"])).otherwise(value)
        if f in _PUT:
            value = F.when(F.array_contains(plan, "default"), F.when(F.col("_ok"), _PUT[f]())).otherwise(value)
        steps.append(F.when(F.col("_ok"), _named(plan, f, x["name"])).otherwise(F.array().cast("array<string>")))
        out.append(value.alias(f))
    return routed.select(
        F.col("_r").alias(row_id), F.col("_j").alias("job_id"), F.col("_f").alias("file_no"), F.col("_ok").alias("readable"), F.col("fingerprint").alias("version"), *out,
        F.concat(*steps).alias("steps"),
    )
