"""The queries of the outline pipeline over whole tables, each with the SQL that checks it where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quirelake.functions import text as X
from quirelake.operators import hierarchy, layout, offsets, outline, reports, responses
from quirelake.operators.nested import _as_list, whole_json
from quirelake.session import cut_lineage, table
from quirelake.sources.files import content_hash

#: Size in which the pages of page_lines are measured.
WIDTH, HEIGHT = 420.0, 600.0
#: Batches from here on are the current run, the ones before the legacy one.
CURRENT = 1000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, sf: str, current: bool) -> DataFrame:
    rows = table(spark, sf, "report_log")
    return rows.where(F.col("batch_id") >= CURRENT) if current else rows.where(F.coalesce(F.col("batch_id") < CURRENT, F.lit(True)))


_LATEST = "select source, log_id, status, source_size, source_mtime_ns from (select *, row_number() over (partition by source order by log_id desc) as rn from report_log where trim(source) <> '') where rn = 1"


@query(_LATEST)
def report_latest(spark, sf):
    return reports.latest(table(spark, sf, "report_log"))


@query(f"select lower(trim(status)) as status, count(*) as books from ({_LATEST}) group by 1")
def report_status_counts(spark, sf):
    return reports.status_counts(reports.latest(table(spark, sf, "report_log")))


_MEMBER = "case when json_type(payload, '$.api_usage') = 'VARCHAR' then try_cast(json_extract_string(payload, '$.api_usage') as json) else json_extract(payload, '$.api_usage') end"
_SUM = ", ".join(
    f"coalesce(sum(case when json_type(u, '$.{c}') in ('UBIGINT', 'BIGINT') and cast(json_extract_string(u, '$.{c}') as bigint) >= 0 then cast(json_extract_string(u, '$.{c}') as bigint) end), 0)::bigint as {c}"
    for c in reports.USAGE
)


@query(
    f"with r as (select job_id, case when json_valid(payload) then payload::json end as payload from report_log), m as (select job_id, {_MEMBER} as u0 from r), "
    f"o as (select job_id, case when json_type(u0) = 'OBJECT' and len(json_keys(u0)) > 0 then u0 end as u from m) select job_id, count(*) as rows, count(u) as with_usage, {_SUM} from o group by 1"
)
def report_usage_totals(spark, sf):
    return reports.usage_totals(table(spark, sf, "report_log"))


_WHOLE = lambda c: f"case when json_type(d, '$.api_usage.{c}') in ('UBIGINT', 'BIGINT') then json_extract_string(d, '$.api_usage.{c}')::bigint end as {c}"


@query(
    f"with r as (select job_id, payload::json as d from report_log where json_valid(payload)), u as (select job_id, {', '.join(_WHOLE(c) for c in reports.USAGE[:3])} from r), "
    "o as (select *, coalesce(prompt_tokens >= 0 and completion_tokens >= 0 and prompt_tokens + completion_tokens = total_tokens, false) as ok from u) "
    "select job_id, count(*) filter (ok) as reported, count(*) filter (not ok) as unreported, " + ", ".join(f"coalesce(sum({c}) filter (ok), 0)::bigint as {c}" for c in reports.USAGE[:3]) + " from o group by 1"
)
def report_usage_accepted(spark, sf):
    return reports.accepted_usage(table(spark, sf, "report_log"))


_LEGACY, _NOW = f"(batch_id is null or batch_id < {CURRENT})", f"batch_id >= {CURRENT}"


@query(
    f"select line, count(*) as times from ((select md5(payload) as line from report_log where {_LEGACY} except all select md5(payload) from report_log where {_NOW}) "
    f"union all select md5(payload) from report_log where {_NOW}) group by 1"
)
def jsonl_merge(spark, sf):
    line = F.md5(F.col("payload").cast("binary")).alias("line")
    merged = reports.merge_lines(_log(spark, sf, False).select(line), _log(spark, sf, True).select(line))
    return merged.groupBy("line").agg(F.count(F.lit(1)).alias("times"))


def _one(where: str) -> str:
    return f"select source, log_id, status, source_size from (select *, row_number() over (partition by source order by log_id desc) as rn from report_log where trim(source) <> '' and {where}) where rn = 1"


@query(
    f"with o as ({_one(_LEGACY)}), n as ({_one(_NOW)}) select coalesce(n.source, o.source) as source, case when n.source is not null then n.log_id else o.log_id end as log_id, "
    "case when n.source is not null then n.status else o.status end as status, case when n.source is null then o.source_size end as source_size from n full join o on n.source = o.source"
)
def summary_upsert(spark, sf):
    """The current summary lacks the column source_size that the legacy one has."""
    old = reports.latest(_log(spark, sf, False), keep=("status", "source_size"))
    new = reports.latest(_log(spark, sf, True), keep=("status",))
    return reports.upsert(old, new, "source").select("source", "log_id", "status", "source_size")


_LEFT = _LATEST.replace("from report_log where", f"from report_log where {_LEGACY} and")


@query(
    f"select log_id, source from report_log r where not exists (select 1 from ({_LEFT}) d "
    "where d.source = r.source and d.source_size is not distinct from r.source_size and d.source_mtime_ns is not distinct from r.source_mtime_ns)"
)
def changed_since(spark, sf):
    """Deliveries whose file isn't as the legacy run left it: to be done again."""
    log = table(spark, sf, "report_log").select("log_id", "source", "source_size", "source_mtime_ns")
    same = reports.unchanged(log, reports.latest(_log(spark, sf, False)), "source", ("source_size", "source_mtime_ns"))
    return log.join(same.select("log_id"), "log_id", "left_anti").select("log_id", "source")


_LISTED = "case json_type(e) when 'OBJECT' then 1 when 'ARRAY' then json_array_length(e) else 0 end"


@query(
    "with d as (select log_id, payload::json as d from report_log where json_valid(payload)), "
    "e as (select *, case when json_type(d, '$.entries') = 'VARCHAR' then case when json_valid(json_extract_string(d, '$.entries')) then json_extract_string(d, '$.entries')::json end else json_extract(d, '$.entries') end as e from d) "
    "select log_id, json_extract_string(d, '$.source') as source, json_extract_string(d, '$.status') as status, try_cast(json_extract_string(d, '$.page_count') as bigint) as page_count, "
    "case when json_type(d, '$.toc_pages') = 'ARRAY' then array_to_string(list_filter(json_extract_string(d, '$.toc_pages[*]'), lambda x: x is not null), ',') end as toc_pages, "
    f"coalesce({_LISTED}, 0)::bigint as entry_count, case when json_type(d, '$.warnings') = 'ARRAY' then array_to_string(list_filter(json_extract_string(d, '$.warnings[*]'), lambda x: x is not null), '; ') end as warnings, "
    "try_cast(json_extract_string(d, '$.offsets.arabic') as bigint) as arabic_offset, json_extract_string(d, '$.error') as error from e"
)
def report_summary(spark, sf):
    return reports.flat_summary(table(spark, sf, "report_log"))


def _nested_sql(src: str, tie: str) -> str:
    return (
        f"with p as (select book, seq, {tie}, least(greatest(coalesce(level, 1), 1), 6) as raw, row_number() over (partition by book order by seq nulls first, {tie}) as i from {src}) "
        f"select book, seq, {tie}, least(i, i + min(raw - i) over (partition by book order by i rows unbounded preceding)) as nested from p"
    )


@query(_nested_sql("outline", "node_id"))
def nest_clamp(spark, sf):
    return outline.nested_levels(table(spark, sf, "outline")).select("book", "seq", "node_id", "nested")


@query(
    f"with n as ({_nested_sql('outline', 'node_id')}), o as (select *, row_number() over (partition by book order by seq nulls first, node_id) as i from n) select book, seq, node_id, nested, "
    "case nested " + " ".join(f"when {d + 1} then last_value(case when nested = {d} then node_id end ignore nulls) over (partition by book order by i rows between unbounded preceding and 1 preceding)" for d in range(1, 6)) + " end as parent from o"
)
def outline_parents(spark, sf):
    return outline.with_parents(table(spark, sf, "outline"))


@query()
def outline_quality(spark, sf):
    return outline.quality(table(spark, sf, "outline"))


def _sides(spark, sf, key):
    old = outline.keyed(table(spark, sf, "outline"), key, "page_number", "seq", "node_id")
    new = outline.keyed(table(spark, sf, "toc_rows"), key, "pdf_page", "seq", "toc_id")
    return old, new


@query()
def outline_compare(spark, sf):
    contents = table(spark, sf, "toc_rows").select("book", F.col("source_page").alias("page")).distinct()
    return outline.compare(*_sides(spark, sf, X.compare_key(F.col("title"))), contents)


_OLD = "select book, coalesce(trim(title, ' '), '') as key, page_number as page, level, seq as ord, node_id as id from outline"
_NEW = "select book, coalesce(trim(title, ' '), '') as key, pdf_page as page, level, seq as ord, toc_id as id from toc_rows"
_NUMBER = "select *, row_number() over (partition by book, key order by ord nulls first, id) as n, row_number() over (partition by book order by ord nulls first, id) as pos from"
_BOTH = f"o as ({_NUMBER} ({_OLD})), n as ({_NUMBER} ({_NEW}))"


@query(
    f"with {_BOTH}, oc as (select book, key, count(*) as c from o group by 1, 2), nc as (select book, key, count(*) as c from n group by 1, 2), "
    "t as (select coalesce(oc.book, nc.book) as book, coalesce(oc.c, 0) as old, coalesce(nc.c, 0) as new from oc full join nc on oc.book = nc.book and oc.key = nc.key), "
    "s as (select book, sum(new)::bigint as expected, sum(old)::bigint as existing, sum(least(old, new))::bigint as matched_titles, sum(greatest(new - old, 0))::bigint as missing_titles, sum(greatest(old - new, 0))::bigint as unexpected_titles from t group by 1), "
    "p as (select o.book, count_if(o.page is distinct from n.page) as wrong_pages, count_if(o.level is distinct from n.level) as wrong_levels from o join n on o.book = n.book and o.key = n.key and o.n = n.n group by 1), "
    "d as (select coalesce(o.book, n.book) as book, count(*) as off from o full join n on o.book = n.book and o.pos = n.pos where o.id is null or n.id is null or o.key is distinct from n.key or o.page is distinct from n.page or o.level is distinct from n.level group by 1) "
    "select s.*, coalesce(wrong_pages, 0) as wrong_pages, coalesce(wrong_levels, 0) as wrong_levels, coalesce(off, 0) = 0 as matches, coalesce(off, 0) > 0 and missing_titles + unexpected_titles + coalesce(wrong_pages, 0) + coalesce(wrong_levels, 0) = 0 as wrong_order "
    "from s left join p on s.book = p.book left join d on s.book = d.book"
)
def outline_compare_literal(spark, sf):
    """The comparison under titles as they are written."""
    return outline.compare(*_sides(spark, sf, F.trim("title")))


@query(f"with {_BOTH} select o.book, o.key, o.n, o.page as old_page, n.page as new_page, o.level as old_level, n.level as new_level from o join n on o.book = n.book and o.key = n.key and o.n = n.n")
def outline_occurrence_pairs(spark, sf):
    return outline.occurrence_pairs(*_sides(spark, sf, F.trim("title")))


@query("select book, count(*) as rows, count_if(printed_page < before) as steps from (select *, lag(printed_page) over (partition by book order by seq nulls first, toc_id) as before from toc_rows where printed_page is not null) group by 1")
def toc_backward_steps(spark, sf):
    return outline.backward_steps(table(spark, sf, "toc_rows"))


@query(
    "with r as (select book, seq, toc_id, printed_page as a, pdf_page as b, row_number() over w as i, lag(printed_page) over w as pa, lag(pdf_page) over w as pb from toc_rows where printed_page is not null and pdf_page is not null window w as (partition by book order by seq nulls first, toc_id)), "
    "s as (select book, sum(case when a = pa + 1 and b = pb + 1 then 0 else 1 end) over (partition by book order by i rows unbounded preceding) as run from r), c as (select book, run, count(*) as n from s group by 1, 2) select book, max(n) as longest from c group by 1"
)
def longest_run(spark, sf):
    return outline.longest_run(table(spark, sf, "toc_rows"))


@query(
    "select book, seq, toc_id, printed_page, numbering from (select *, row_number() over (partition by book, lower(regexp_replace(title, '[^\\p{L}\\p{N}_]', '', 'g')), printed_page, numbering order by seq nulls first, toc_id) as rn from toc_rows) where rn = 1"
)
def toc_unique_rows(spark, sf):
    return hierarchy.unique_rows(table(spark, sf, "toc_rows")).select("book", "seq", "toc_id", "printed_page", "numbering")


@query("select book, case when count_if(coalesce(regexp_matches(title, '[\\x{3400}-\\x{9FFF}]'), false)) * 2 >= count(*) then '目录' else 'Contents' end as title, min(source_page) as pdf_page, count(*) as rows from toc_rows group by 1")
def contents_bookmark(spark, sf):
    return hierarchy.contents_bookmark(table(spark, sf, "toc_rows"))


@query()
def hierarchy_levels(spark, sf):
    return hierarchy.infer_levels(hierarchy.unique_rows(table(spark, sf, "toc_rows")))


@query()
def page_breaks(spark, sf):
    return hierarchy.page_breaks(table(spark, sf, "toc_rows"))


@query("with p as (select distinct book, source_page as p from toc_rows where source_page is not null), n as (select book, p, lead(p) over (partition by book order by p) as q from p) select book, unnest(generate_series(p + 1, q - 1))::int as missing from n where q > p + 1")
def contents_page_gaps(spark, sf):
    return reports.gaps(table(spark, sf, "toc_rows"))


_ANCHORS = "select book, numbering, pdf_page, printed_page, pdf_page - printed_page as offset_ from toc_rows where pdf_page is not null and printed_page is not null and numbering is not null"


@query(
    f"with v as (select book, numbering, offset_, count(distinct pdf_page) as votes from ({_ANCHORS}) group by 1, 2, 3) select book, numbering, offset_ as \"offset\", votes, row_number() over (partition by book, numbering order by votes desc, offset_) as rank from v"
)
def offset_votes(spark, sf):
    return offsets.votes(offsets.row_anchors(table(spark, sf, "toc_rows")))


def _fitted(spark, sf):
    return offsets.fit(offsets.row_anchors(table(spark, sf, "toc_rows")), _labels(spark, sf))


# The votes alone: where one offset has three votes and more than any other, and no other one has two on pages of its own.
_FIT = (
    f"v as (select book, numbering, offset_, count(distinct pdf_page) as votes, row_number() over (partition by book, numbering order by count(distinct pdf_page) desc, offset_) as rank from ({_ANCHORS}) group by 1, 2, 3), "
    "b as (select book, numbering, max(offset_) filter (rank = 1) as best, max(votes) filter (rank = 1) as first, coalesce(max(votes) filter (rank = 2), 0) as second from v group by 1, 2), "
    "t as (select b.book, b.numbering, case when first >= 3 and first > second then best end as off, first from b), "
    f"p as (select distinct book, numbering, offset_, pdf_page from ({_ANCHORS})), bp as (select p.book, p.numbering, min(pdf_page) as lo, max(pdf_page) as hi from p join t on p.book = t.book and p.numbering = t.numbering and offset_ = off group by 1, 2), "
    "r as (select p.* from p join t on p.book = t.book and p.numbering = t.numbering and offset_ <> off where not exists (select 1 from p q where q.book = p.book and q.numbering = p.numbering and q.pdf_page = p.pdf_page and q.offset_ = off)), "
    "o as (select book, numbering, offset_, min(pdf_page) as lo, max(pdf_page) as hi, row_number() over (partition by book, numbering order by count(*) desc, offset_) as rank from r group by 1, 2, 3)"
)


@query(
    f"with {_FIT} select t.book, t.numbering, off as \"offset\", case when off is null then '[]' else '[{{\"offset\":' || off || ',\"from_printed\":1,\"votes\":' || first || '}}]' end as segments, "
    "case when off is null then 'conflict' when o.lo > bp.hi or o.hi < bp.lo then 'edge' end as warning from t left join bp on bp.book = t.book and bp.numbering = t.numbering left join o on o.book = t.book and o.numbering = t.numbering and o.rank = 1"
)
def offset_fit(spark, sf):
    return _fitted(spark, sf).select("book", "numbering", "offset", F.to_json("segments").alias("segments"), "warning")


@query(
    f"with {_FIT}, m as (select r.book, toc_id, seq, printed_page, printed_page + off as target, page_count from toc_rows r left join t on t.book = r.book and t.numbering = r.numbering left join previews on path = r.book) "
    "select book, toc_id, seq, printed_page, target, case when target is null then 'no_offset' when target < 1 or target > page_count then 'outside' else 'mapped' end as status from m"
)
def offset_mapped_rows(spark, sf):
    return offsets.map_rows(table(spark, sf, "toc_rows"), _fitted(spark, sf), table(spark, sf, "previews"))


def _titles(spark, sf):
    rows, lines = table(spark, sf, "toc_rows"), table(spark, sf, "page_lines")
    pages = lines.select("book", F.col("page_number").alias("page"), "line_no", "line_id", "text").where("text is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line_id", "text"))), lambda x: x["text"]), " ")
    return offsets.title_anchors(rows, pages.groupBy("book", "page").agg(text.alias("text")), _contents(rows))  # lines of one page


def _contents(rows: DataFrame) -> DataFrame:
    return rows.where("source_page is not null").select("book", F.col("source_page").alias("page")).distinct()


def _counts(spark, sf):
    return table(spark, sf, "previews").select(F.col("path").alias("book"), "page_count")


def _labels(spark, sf):
    return layout.edge_labels(table(spark, sf, "page_lines"), HEIGHT, WIDTH).select("book", "numbering", F.col("page").alias("pdf_page"), F.col("value").alias("printed_page"))


def _collected(spark, sf):
    return offsets.collected(body_sample_pages(spark, sf), _labels(spark, sf), _counts(spark, sf), _titles(spark, sf))


@query()
def title_anchors(spark, sf):
    return _titles(spark, sf)


@query()
def collected_anchors(spark, sf):
    """Anchors from the labels of sampled pages, and from titles where those tell too little."""
    return _collected(spark, sf)


@query()
def collected_fit(spark, sf):
    """Offsets from collected anchors alone, without what the contents rows themselves say about pages of the file.

    The fit looks at the anchors many times; they are collected once, a few dozen rows a book.
    """
    anchors = cut_lineage(_collected(spark, sf).select("book", "numbering", "pdf_page", "offset"))
    # labels of pages come from an explode, whose size Spark takes for too small to shuffle
    return offsets.fit(anchors, _labels(spark, sf).hint("merge")).select("book", "numbering", "offset", F.to_json("segments").alias("segments"), "warning")


# Full-width digits and spaces in their ordinary form, which is all that titles of digits need.
_NUMERIC = "trim(translate(title, '０１２３４５６７８９　\u00a0', '0123456789  '))"


@query(
    f"with c as (select distinct book, source_page as page from toc_rows where source_page is not null), r as (select o.book, seq, node_id, page_number as page, page_count, c.page is not null as toc, case when regexp_full_match({_NUMERIC}, '[1-9][0-9]{{0,4}}') then {_NUMERIC}::int end as printed "
    "from outline o left join previews on path = o.book left join c on c.book = o.book and c.page = o.page_number), "
    "s as (select *, lag(printed) over w as lp, lag(page) over w as lg from r where printed is not null window w as (partition by book order by seq nulls first, node_id)), "
    "b as (select book, count(*) filter (printed <= lp or page <= lg) as back_steps from s group by 1), "
    "v as (select book, page - printed as off, count(*) as n, max(page) - min(page) + 1 as span, row_number() over (partition by book order by count(*) desc, page - printed) as rank from s where page is not null group by 1, 2), "
    "k as (select s.book, s.printed, s.page, row_number() over w as i, lag(s.printed) over w as lp, lag(s.page) over w as lg from s join v on v.book = s.book and rank = 1 and page - printed = off window w as (partition by s.book order by seq nulls first, node_id)), "
    "i as (select book, sum(case when printed = lp + 1 and page = lg + 1 then 0 else 1 end) over (partition by book order by i rows unbounded preceding) as run from k), l as (select book, max(n) as longest from (select book, run, count(*) as n from i group by 1, 2) group by 1), "
    "w as (select book, count(*) as rows, max(page_count) as n, count(printed) as numbers, count(*) filter (printed is not null and not coalesce(page between 1 and page_count, false)) as lost, count(*) filter (printed is not null and toc) as on_contents from r group by 1) "
    "select w.book, w.rows, numbers, lost, on_contents, coalesce(back_steps, 0) as back_steps, v.off as \"offset\", v.n as support, v.span, longest, "
    "coalesce(lost = 0 and numbers >= greatest(12, ceil(w.n / 10.0)) and numbers * 10 >= w.rows * 7 and back_steps = 0 and on_contents = 0 and v.n * 20 >= numbers * 19 and v.span >= greatest(12, (w.n + 4) // 5) and longest >= greatest(10, v.n // 4) and exists (select 1 from c where c.book = w.book), false) as accepted "
    "from w left join b on b.book = w.book left join v on v.book = w.book and v.rank = 1 left join l on l.book = w.book"
)
def outline_gates(spark, sf):
    return offsets.outline_gates(table(spark, sf, "outline"), _counts(spark, sf), _contents(table(spark, sf, "toc_rows")))


@query()
def outline_anchors(spark, sf):
    """Page numbers of old outlines that may serve as anchors, confirmed by the labels of their pages."""
    candidates = offsets.outline_anchors(table(spark, sf, "outline"), _counts(spark, sf), _contents(table(spark, sf, "toc_rows")))
    return offsets.verified_anchors(candidates, _labels(spark, sf))


_SPREAD = lambda base, size, parts: ", ".join(f"{base} + cast(round_even({size} * {p}::double, 0) as int)" for p in parts)


@query(
    "with t as (select book, min(source_page) as f, max(source_page) as l, list(distinct source_page) as tp from toc_rows where source_page is not null group by 1), b as (select t.*, page_count as n from t join previews on path = book where page_count >= 1), "
    f"c as (select *, case when f > n * 0.70::double then list_concat(range(1, least(12, n) + 1), [{_SPREAD('0', 'n', (0.2, 0.4, 0.6, 0.8))}]) else list_concat(range(least(l + 1, n), least(least(l + 1, n) + 10, n) + 1), "
    f"[{_SPREAD('least(l + 1, n)', 'greatest(n - least(l + 1, n), 1)', (0.2, 0.4, 0.6, 0.8, 0.97))}]) end as p from b), e as (select distinct book, n, tp, unnest(p) as page from c) select book, page::int as page from e where page between 1 and n and not list_contains(tp, page::int)"
)
def body_sample_pages(spark, sf):
    toc = table(spark, sf, "toc_rows").where("source_page is not null").groupBy("book").agg(
        F.min("source_page").alias("first_toc"), F.max("source_page").alias("last_toc"), F.collect_set("source_page").alias("toc_pages")  # contents pages of one book
    )
    return offsets.body_sample(toc.join(table(spark, sf, "previews").select(F.col("path").alias("book"), "page_count"), "book"))


# Labels as a whole line or as an outer word; full-width forms are the only ones that matter to numbers here.
_WIDE, _PLAIN = "".join(chr(0xFEE0 + i) for i in range(0x21, 0x7F)) + "\u3000\u00a0", "".join(chr(i) for i in range(0x21, 0x7F)) + "  "


def _label_sql(text: str) -> str:
    t = f"translate({text}, '{_WIDE}', '{_PLAIN.replace(chr(39), chr(39) * 2)}')"
    digits, roman = f"regexp_extract({t}, '^[\\s\\[(—–-]*([0-9]{{1,4}})[\\s\\])—–-]*$', 1)", f"lower(regexp_extract({t}, '^[\\s\\[(—–-]*([ivxlcdmIVXLCDM]{{1,8}})[\\s\\])—–-]*$', 1))"
    value = "list_transform(string_split(%s, ''), lambda c: case c when 'i' then 1 when 'v' then 5 when 'x' then 10 when 'l' then 50 when 'c' then 100 when 'd' then 500 else 1000 end)" % roman
    read = f"list_sum(list_transform({value}, lambda v, i: case when v < coalesce(list_max(list_slice({value}, i + 1, 99)), 0) then -v else v end))"
    return f"case when {digits} <> '' then case when {digits}::int > 0 then 'arabic:' || {digits}::int end when {roman} <> '' then 'roman:' || {read}::int end"


def _labels_of(lines: str, name: str = "lab") -> str:
    return _LABELS.replace("from page_lines", f"from {lines}").replace("lab as (", f"{name} as (").replace("e as (select book, page_number", f"{name}_e as (select book, page_number").replace("from e)", f"from {name}_e)").replace("w as (select *, regexp", f"{name}_w as (select *, regexp").replace("from w)", f"from {name}_w)").replace("g as (select *, ", f"{name}_g as (select *, ").replace("from g)", f"from {name}_g)").replace("u as (select", f"{name}_u as (select").replace("from u ", f"from {name}_u ")


_LABELS = (
    f"e as (select book, page_number as page, trim(text, ' ') as text, x, right_edge as e from page_lines where not (y > {0.16 * HEIGHT}::double and bottom < {0.84 * HEIGHT}::double) and trim(text, ' ') <> ''), "
    "w as (select *, regexp_extract(text, '^([^\\s\u3000\u00a0]*)', 1) as a, regexp_extract(text, '([^\\s\u3000\u00a0]*)$', 1) as b from e), "
    f"g as (select *, {_label_sql('text')} as whole, case when x < {0.2 * WIDTH}::double or x > {0.78 * WIDTH}::double then {_label_sql('a')} end as first_, "
    f"case when e - (e - x) * length(b) / length(text) < {0.2 * WIDTH}::double or e - (e - x) * length(b) / length(text) > {0.78 * WIDTH}::double then {_label_sql('b')} end as last_ from w), "
    "u as (select book, page, unnest(case when whole is not null then [whole] else [first_, last_] end) as l from g), "
    "lab as (select distinct book, page, string_split(l, ':')[1] as numbering, string_split(l, ':')[2]::int as value from u where l is not null)"
)


@query(
    f"with {_LABELS}, c as (select book, pdf_page, printed_page, exists (select 1 from lab where lab.book = a.book and lab.page = a.pdf_page and numbering = 'arabic' and value = printed_page) as ok, "
    "exists (select 1 from lab where lab.book = a.book and lab.page = a.pdf_page and not (numbering = 'arabic' and value = printed_page)) as other from (select * from toc_rows where numbering = 'arabic' and pdf_page is not null and printed_page is not null) a), "
    "s as (select book, count(*) filter (ok) as confirmed, count(*) filter (other) as contradicted, max(pdf_page) filter (ok) - min(pdf_page) filter (ok) as spread, max(pdf_page) - min(pdf_page) as whole from c group by 1) "
    "select book, confirmed, contradicted, spread, coalesce(contradicted = 0 and confirmed >= 3 and spread >= greatest(5, whole // 2), false) as verified from s"
)
def anchors_verified(spark, sf):
    rows = offsets.row_anchors(table(spark, sf, "toc_rows")).where("numbering = 'arabic'").select("book", "pdf_page", "printed_page")
    return offsets.verify(rows, _labels(spark, sf))


@query(f"with {_LABELS} select book, page, numbering, value from lab")
def edge_page_labels(spark, sf):
    return layout.edge_labels(table(spark, sf, "page_lines"), HEIGHT, WIDTH)


@query(
    f"with r as (select book, page_number, coalesce(x < {0.45 * WIDTH}::double, false) as l, coalesce(x > {0.55 * WIDTH}::double, false) as r, length(regexp_replace(coalesce(text, ''), '[^\\p{{L}}]', '', 'g')) as n from page_lines), "
    "s as (select book, page_number, coalesce(sum(n) filter (l), 0)::bigint as left_letters, coalesce(sum(n) filter (not l and not r), 0)::bigint as middle_letters, coalesce(sum(n) filter (r), 0)::bigint as right_letters from r group by 1, 2) "
    "select *, left_letters >= 18 and right_letters >= 18 and middle_letters < least(left_letters, right_letters) * 0.23 as two_columns from s"
)
def letter_columns(spark, sf):
    return layout.letter_columns(table(spark, sf, "page_lines"), WIDTH)


@query()
def title_parts(spark, sf):
    """What the titles of contents rows say about themselves."""
    t = F.col("title")
    kinds = hierarchy.classified(table(spark, sf, "toc_rows"))
    return kinds.select(
        "toc_id", F.array_join("_parts", ".").alias("number"), F.col("_number").alias("chapter"), F.col("_part").alias("is_part"), F.col("_chapter").alias("is_chapter"), F.col("_appendix").alias("is_appendix"),
        F.col("_boundary").alias("is_boundary"), X.title_key(t).alias("title_key"), X.compare_key(t).alias("compare_key"),
    )


@query("select doc_id, sha256(text) as sha256, substr(sha256(text), 1, 20) as short_id from documents")
def content_hashes(spark, sf):
    h = content_hash(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", h.alias("sha256"), F.substring(h, 1, 20).alias("short_id"))


@query()
def page_line_groups(spark, sf):
    """Lines of each page put together from their words' places; every stored line counts as a word here."""
    words = table(spark, sf, "page_lines").select(
        "book", F.col("page_number").alias("page"), "text", "x", "y", (F.col("right_edge") - F.col("x")).alias("width"), (F.col("bottom") - F.col("y")).alias("height")
    )
    return layout.group_words(words, WIDTH)


@query()
def response_entries(spark, sf):
    """The entries of each readable report, checked like a model's answer about contents pages.

    Entries held as JSON text count as what it holds, a bare object as a list of one; what is no list then stays as it is, an error.
    """
    doc = whole_json(F.col("payload"))
    held = F.try_variant_get(doc, "$.entries", "variant")
    entries = F.coalesce(F.to_json(_as_list(held)), F.to_json(held))
    answers = table(spark, sf, "report_log").select("log_id", F.try_variant_get(doc, "$.page_count", "int").alias("pages"), F.concat(F.lit('{"is_toc": true, "entries": '), entries, F.lit("}")).alias("answer"))
    return responses.contents_entries(answers.where("answer is not null"), "answer", "log_id", "pages")


def _label_batches(lines: DataFrame, shift: int) -> DataFrame:
    """(book, pages, labels): all pages of the lines in batches of four, with the labels on them."""
    shape = F.struct("page", "numbering", "value")
    labels = layout.edge_labels(lines, HEIGHT, WIDTH).groupBy("book", "page").agg(F.collect_list(shape).alias("l"))  # one page
    pages = lines.select("book", F.col("page_number").alias("page")).distinct().join(labels, ["book", "page"], "left")
    batches = pages.groupBy("book", F.floor((F.col("page") + shift) / 4).alias("b")).agg(F.collect_list("page").alias("pages"), F.flatten(F.collect_list("l")).alias("labels"))  # four pages
    return batches.select("book", "pages", "labels")


@query(
    "with early as (select * from (select *, min(loaded_at) over (partition by book, page_number) as first_at from page_lines) where coalesce(loaded_at <= first_at + interval 1 day, true)), "
    f"{_labels_of('early', 'one')}, {_labels_of('page_lines', 'two')}, covered as (select distinct book, page_number as page from page_lines), "
    "told as (select c.book, c.page, (select list(numbering || ':' || value order by numbering, value) from one where one.book = c.book and one.page = c.page) as a, (select list(numbering || ':' || value order by numbering, value) from two where two.book = c.book and two.page = c.page) as b from covered c), "
    "needed as (select distinct book, pdf_page as page from toc_rows where pdf_page is not null), "
    "s as (select n.book, n.page, case when t.book is null then 'missing' when a is distinct from b then 'conflict' when a is null then 'empty' else 'known' end as state, a from needed n left join told t on t.book = n.book and t.page = n.page), "
    "x as (select book, page, state, unnest(case when state = 'known' then a else [null] end) as l from s) select book, page, state, string_split(l, ':')[1] as numbering, string_split(l, ':')[2]::int as value from x"
)
def label_reuse(spark, sf):
    """Which labels of the pages that contents rows point to are known from batches of four pages that were read before.

    Each page was read twice, in batches that overlap: with the lines loaded within a day of its first one, and with all its lines.
    """
    lines = table(spark, sf, "page_lines")
    first = F.min("loaded_at").over(Window.partitionBy("book", "page_number"))  # lines of one page
    early = lines.withColumn("_first", first).where(F.coalesce(F.col("loaded_at") <= F.col("_first") + F.expr("interval 1 day"), F.lit(True)))
    needed = table(spark, sf, "toc_rows").where("pdf_page is not null").select("book", F.col("pdf_page").alias("page"))
    return responses.reusable_labels(needed, _label_batches(early, 0).unionByName(_label_batches(lines, 2)))
