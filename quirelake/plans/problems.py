"""The queries of the general problems: nested records, drifting schemas, repeated deliveries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.operators import dedup, drift, nested
from quirelake.session import table

REPORT_MEMBERS = (nested.Member("entries"), nested.Member("existing_outline_check", many=False), nested.Member("api_usage", many=False))
OUTLINE_MEMBERS = (nested.Member("bookmarks", again="children"),)
REPORT_COLUMNS = {
    "entries": {"title": "string", "printed_page": "int", "numbering": "string", "level": "int", "source_page": "int", "raw": "string", "confidence": "double", "pdf_page": "int"},
    "existing_outline_check": {"matches": "boolean", "expected": "bigint", "existing": "bigint", "matched_titles": "bigint", "missing_titles": "bigint", "unexpected_titles": "bigint", "wrong_pages": "bigint", "wrong_levels": "bigint", "wrong_order": "boolean"},
    "api_usage": {"prompt_tokens": "bigint", "completion_tokens": "bigint", "total_tokens": "bigint", "reported_responses": "bigint", "unreported_responses": "bigint"},
}


def report_items(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flatten(table(spark, sf, "report_log"), "payload", "log_id", REPORT_MEMBERS)


def outline_items(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flatten(table(spark, sf, "previews"), "bookmarks", "preview_id", OUTLINE_MEMBERS, record=False)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    parts = [
        items.select(F.lit(src).alias("src_table"), "row_id", F.col("path").alias("item_path"), "parent_path")
        for src, items in (("report_log", report_items(spark, sf)), ("previews", outline_items(spark, sf)))
    ]
    return parts[0].unionAll(parts[1])


def p1_entries(spark: SparkSession, sf: str) -> DataFrame:
    return nested.child_tables(report_items(spark, sf), REPORT_COLUMNS)["entries"]


def p1_checks(spark: SparkSession, sf: str) -> DataFrame:
    return nested.child_tables(report_items(spark, sf), REPORT_COLUMNS)["existing_outline_check"]


def p1_usages(spark: SparkSession, sf: str) -> DataFrame:
    return nested.child_tables(report_items(spark, sf), REPORT_COLUMNS)["api_usage"]


def p1_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return nested.child_tables(outline_items(spark, sf), {"bookmarks": {"title": "string", "page_number": "int"}})["bookmarks"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return drift.changes(table(spark, sf, "report_log"))


def p2_table(spark: SparkSession, sf: str) -> DataFrame:
    out = drift.unify(table(spark, sf, "report_log"))
    return out.select(
        "log_id", "job_id", "file_no", "readable", F.col("toc_bookmark.title").alias("toc_title"), F.col("toc_bookmark.pdf_page").alias("toc_page"),
        "review_acceptable", F.to_json("toc_corrections").alias("toc_corrections"), F.array_join("steps", "; ").alias("steps"),
    )


def p2_versions(spark: SparkSession, sf: str) -> DataFrame:
    """How many files have which schema version."""
    files = drift.fingerprints(table(spark, sf, "report_log"))
    return files.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("files"), F.first(F.to_json("held")).alias("held"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.superfluous(table(spark, sf, "report_log"))


def p5_messages(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.deduplicate(table(spark, sf, "report_log"))


def p5_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Batches from 1000 on arrive as new messages beside the stored ones."""
    log = table(spark, sf, "report_log")
    return dedup.deduplicate(log.where("batch_id < 1000 or batch_id is null"), log.where("batch_id >= 1000"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_entries, p1_checks, p1_usages, p1_nodes, p2_found, p2_table, p2_versions, p5_found, p5_messages, p5_incremental)
}

_KEY = "regexp_replace(regexp_replace(lower(message_id), '^\\s*(urn:uuid:)?', ''), '[^0-9a-f]', '', 'g')"
_KEYED = f"select *, case when regexp_full_match({_KEY}, '[0-9a-f]{{32}}') then {_KEY} end as message_key from report_log"
_RANKED = f"select *, row_number() over (partition by message_key order by delivered_at nulls last, log_id) as rn from ({_KEYED})"
_ONE = f"select log_id, message_key, source, status from ({_RANKED}) where message_key is null or rn = 1"



def _unwrapped(v: str) -> str:
    """JSON that a text holds counts as what it holds."""
    return f"case when json_type({v}) = 'VARCHAR' then case when json_valid(json_extract_string({v}, '$')) then json_extract_string({v}, '$')::json end else {v} end"


def _listed(v: str) -> str:
    return f"case json_type({v}) when 'OBJECT' then json_array({v}) when 'ARRAY' then {v} end"


_FULL = "json_type(x) = 'OBJECT' and len(json_keys(x)) > 0"
_P1 = f"""
with recursive doc as (select log_id, case when json_valid(payload) then payload::json end as d from report_log),
member as (select log_id, m, {_unwrapped("json_extract(d, '$.' || m)")} as v from doc, (values ('entries'), ('existing_outline_check'), ('api_usage')) as t(m)),
lists as (select log_id, {_listed("v")} as l from member where m = 'entries'),
entry as (select log_id, i, json_extract(l, '$[' || (i - 1) || ']') as x from lists, unnest(generate_series(1, json_array_length(l)::bigint)) as u(i)),
tree(row_id, path, parent, l) as (
  select preview_id, 'bookmarks', '', {_listed("b")} from (select preview_id, case when json_valid(bookmarks) then bookmarks::json end as b from previews)
  union all
  select row_id, path || '[' || i || '].children', path || '[' || i || ']', {_listed("json_extract(x, '$.children')")}
  from (select row_id, path, i, json_extract(l, '$[' || (i - 1) || ']') as x from tree, unnest(generate_series(1, json_array_length(l)::bigint)) as u(i)) where {_FULL}
),
node as (select row_id, path || '[' || i || ']' as item_path, parent as parent_path, json_extract(l, '$[' || (i - 1) || ']') as x from tree, unnest(generate_series(1, json_array_length(l)::bigint)) as u(i))
select 'report_log' as src_table, log_id as row_id, 'entries[' || i || ']' as item_path, '' as parent_path from entry where {_FULL}
union all select 'report_log', log_id, m, '' from (select log_id, m, v as x from member where m <> 'entries') where {_FULL}
union all select 'previews', row_id, item_path, parent_path from node where {_FULL}
"""
_TREE = _P1[: _P1.index("select 'report_log' as src_table")]
_KEYS = "row_id, path, parent_path, ordinal, depth"


def _cells(columns: dict[str, str]) -> str:
    """A value of another kind than asked for is null."""
    as_sql = {"string": "varchar", "int": "int", "bigint": "bigint", "double": "double", "boolean": "boolean"}
    return ", ".join(f"try_cast(json_extract_string(x, '$.{c}') as {as_sql[t]}) as {c}" for c, t in columns.items())


_TABLES = {
    "p1_entries": f"{_TREE} select log_id as row_id, 'entries[' || i || ']' as path, '' as parent_path, i as ordinal, 1 as depth, {_cells(REPORT_COLUMNS['entries'])} from entry where {_FULL}",
    **{
        name: f"{_TREE} select log_id as row_id, m as path, '' as parent_path, 1::bigint as ordinal, 1 as depth, {_cells(REPORT_COLUMNS[m])} from (select log_id, m, v as x from member where m = '{m}') where {_FULL}"
        for name, m in (("p1_checks", "existing_outline_check"), ("p1_usages", "api_usage"))
    },
    "p1_nodes": f"{_TREE} select row_id, item_path as path, parent_path, regexp_extract(item_path, '\\[(\\d+)\\]$', 1)::bigint as ordinal, len(item_path) - len(replace(item_path, '[', '')) as depth, "
    f"{_cells({'title': 'string', 'page_number': 'int'})} from node where {_FULL}",
}
# The names are written out here, apart from the operator's own table.
_NAMED = """
when name in ('toc_bookmark', 'tocBookmark', 'TocBookmark', 'toc-bookmark', 'toc_mark', 'bookmark_to_toc', 'contents_bookmark') then 'toc_bookmark'
when name in ('review_acceptable', 'reviewAcceptable', 'review-acceptable', 'acceptable', 'acceptable_after_review', 'can_be_accepted', 'review_ok') then 'review_acceptable'
when name in ('toc_corrections', 'tocCorrections', 'toc-corrections', 'toc_corr', 'toc_fixes', 'corrections', 'corrections_made') then 'toc_corrections'
"""
_P2 = f"""
with doc as (select job_id, file_no, payload::json as d from report_log where json_valid(payload) and json_type(payload) = 'OBJECT' and job_id is not null and file_no is not null),
names as (select job_id, file_no, d, unnest(json_keys(d)) as name from doc),
held as (select distinct job_id, file_no, case {_NAMED} end as field_name, name, case json_type(d, '$."' || name || '"') when 'OBJECT' then 'object' when 'ARRAY' then 'array' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'NULL' then null else 'number' end as kind from names),
fields as (select * from held where field_name is not null and kind is not null),
files as (select distinct job_id, file_no from report_log where job_id is not null and file_no is not null),
spare as (select 1),
pairs as (select f.job_id, f.file_no, t.field_name, o.name as old_name, o.kind as old_kind, n.name as new_name, n.kind as new_kind from files f join files g on g.job_id = f.job_id and g.file_no = f.file_no - 1
  cross join (values ('toc_bookmark'), ('review_acceptable'), ('toc_corrections')) as t(field_name)
  left join fields o on o.job_id = g.job_id and o.file_no = g.file_no and o.field_name = t.field_name left join fields n on n.job_id = f.job_id and n.file_no = f.file_no and n.field_name = t.field_name)
select job_id, file_no::bigint as file_no, field_name, 'added' as change from pairs where old_name is null and new_name is not null
union all select job_id, file_no::bigint, field_name, 'removed' from pairs where old_name is not null and new_name is null
union all select job_id, file_no::bigint, field_name, 'renamed' from pairs where old_name <> new_name
union all select job_id, file_no::bigint, field_name, 'retyped' from pairs where old_kind <> new_kind
"""

_VERSIONS = (
    _P2[: _P2.index("spare as (select 1)")]
    + """shape as (select f.job_id, f.file_no, string_agg(field_name || ':' || name || ':' || kind, ';' order by field_name) as text,
  string_agg('"' || field_name || '":{"name":"' || name || '","kind":"' || kind || '"}', ',' order by field_name) as inner_ from files f left join fields using (job_id, file_no) group by 1, 2)
select sha256(coalesce(text, '')) as fingerprint, count(*) as files, '{' || coalesce(inner_, '') || '}' as held from shape group by 1, 3"""
)

SQL: dict[str, str] = {
    "p1_found": _P1,
    **_TABLES,
    "p2_versions": _VERSIONS,
    "p2_found": _P2,
    "p5_found": f"select log_id from ({_RANKED}) where message_key is not null and rn > 1",
    "p5_messages": _ONE,
    "p5_incremental": _ONE,
}
