"""From printed page numbers to pages of the file: votes, fitted offsets with one change, mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelake.functions import text as X
from quirelake.operators.ordered import chunked, scans
from quirelake.operators.outline import longest_run
from quirelake.session import cut_lineage

#: Pages that have to agree on an offset, those that make a second one, and pages a change may stay uncertain by.
LEAST, SECOND, UNSURE = 3, 2, 3
#: Shortest title key that is searched in page texts, its index prefix, and title anchors per book.
KEY_LENGTH, ANCHORS = 7, 8


def _shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is never broadcast, whatever its size is taken to be.

    Spark takes an explode for as many rows as went in and a collected text for 20 bytes, so a side of millions of rows may seem to fit.
    """
    return df.hint("merge")


def row_anchors(df: DataFrame) -> DataFrame:
    """(book, numbering, pdf_page, printed_page, offset) of contents rows that know both pages."""
    return df.where("pdf_page is not null and printed_page is not null and numbering is not null").select(
        "book", "numbering", "pdf_page", "printed_page", (F.col("pdf_page") - F.col("printed_page")).alias("offset")
    )


def votes(anchors: DataFrame) -> DataFrame:
    """(book, numbering, offset, votes, rank): distinct pages for each offset, the most first, the smallest offset on ties."""
    counts = anchors.groupBy("book", "numbering", "offset").agg(F.countDistinct("pdf_page").alias("votes"))
    w = Window.partitionBy("book", "numbering").orderBy(F.desc("votes"), "offset")  # one row per offset
    return counts.withColumn("rank", F.row_number().over(w).cast("bigint"))


def _sides(pages: DataFrame) -> DataFrame:
    """One row per (book, numbering, offset): votes, first, last and middle page."""
    return pages.groupBy("book", "numbering", "offset").agg(
        F.count(F.lit(1)).alias("votes"), F.min("pdf_page").alias("first"), F.max("pdf_page").alias("last"), F.median("pdf_page").alias("middle")
    )


def _bisected(left: Column, right: Column, low: Column, shown: Column) -> Column:
    """struct<left, right>: the gap between the last page with the lower offset and the first one with the other, narrowed down.

    `shown` maps pages to the offset their label shows. Each step looks at the middle of the gap and its neighbours; it ends where
    none of them shows anything or two pages are left. A gap of n pages takes log2(n) steps.
    """

    def step(gap: Column, _: Column) -> Column:
        middle = F.floor((gap["left"] + gap["right"]) / 2).cast("int")
        inside = F.filter(F.array(middle, middle + 1, middle - 1), lambda p: (p > gap["left"]) & (p < gap["right"]) & F.try_element_at(shown, p).isNotNull())
        page = F.try_element_at(inside, F.lit(1))
        lower = F.try_element_at(shown, page) == low
        moved = F.struct(F.when(lower, page).otherwise(gap["left"]).alias("left"), F.when(lower, gap["right"]).otherwise(page).alias("right"))
        return F.when((gap["right"] - gap["left"] > 2) & page.isNotNull(), moved).otherwise(gap)

    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(left.cast("int").alias("left"), right.cast("int").alias("right")), step)


_SEGMENTS = "array<struct<offset:int,from_printed:int,until_printed:int,votes:int>>"


def fit(anchors: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(book, numbering, offset, segments, warning) of each book and numbering that has anchors.

    A page votes for an offset once. The best offset needs three votes and more than any other ('conflict' else). Pages that have it
    are no witnesses for another one. A second offset with two and more votes makes two segments, cut where the pages' labels
    change; other outcomes have one segment, or none and a warning: 'edge' (a lone page before or behind all others), 'many',
    'interleaved', 'unsure'. `labels` (book, numbering, pdf_page, printed_page) are the printed labels that narrow the change down, by default
    the anchors. A segment is (offset, from_printed, until_printed or null, votes). Equal votes: the smaller offset.
    """
    keys = ["book", "numbering"]
    pages = anchors.where("book is not null and numbering is not null and pdf_page is not null and offset is not null").groupBy(*keys, "pdf_page", "offset").agg(F.lit(1))
    pages = pages.select(*keys, "pdf_page", "offset")
    rank = F.struct(F.col("votes").alias("votes"), (-F.col("offset")).alias("down"), "offset", "first", "last", "middle")
    sides = _sides(pages).withColumn("side", rank)
    order = Window.partitionBy(*keys).orderBy(F.desc("votes"), "offset")  # one row per offset
    two = sides.withColumn("rank", F.row_number().over(order)).where("rank <= 2")
    best = two.groupBy(*keys).agg(F.max("side").alias("best"), F.max(F.when(F.col("rank") == 2, F.col("votes"))).alias("next_votes"))
    firm = (F.col("best.votes") >= LEAST) & (F.col("best.votes") > F.coalesce("next_votes", F.lit(0)))
    best = best.withColumn("firm", firm)
    chosen = best.where("firm").select(*keys, F.col("best.offset").alias("best_offset"))
    marked = pages.join(chosen, keys).withColumn("has", F.col("offset") == F.col("best_offset"))
    taken = marked.where("has").select(*keys, "pdf_page")
    rest = _sides(marked.where(~F.col("has")).join(taken, [*keys, "pdf_page"], "left_anti")).withColumn("side", rank)
    rest = rest.groupBy(*keys).agg(F.max("side").alias("other"), F.count_if(F.col("votes") >= SECOND).alias("strong"))
    out = best.join(rest, keys, "left")
    b, o = F.col("best"), F.col("other")
    swap = b["middle"] <= o["middle"]
    before, after = F.when(swap, b).otherwise(o), F.when(swap, o).otherwise(b)
    out = out.withColumns({"strong": F.coalesce("strong", F.lit(0)), "before": before, "after": after})
    # labels are looked at in the gap between the two sides only
    apart = (F.col("before.last") < F.col("after.first")) & (F.col("after.first") > F.col("before.first"))
    gaps = out.where("firm and strong = 1").where(apart).select(*keys, F.col("before.last").alias("_from"), F.col("after.first").alias("_to"), F.col("before.offset").alias("_low"), F.col("after.offset").alias("_high"))
    seen = pages if labels is None else labels.where("pdf_page is not null and printed_page is not null").select(*keys, "pdf_page", (F.col("pdf_page") - F.col("printed_page")).alias("offset"))
    told = seen.join(gaps, keys).where("pdf_page > _from and pdf_page < _to and offset in (_low, _high)").groupBy(*keys, "pdf_page").agg(F.min("offset").alias("offset"))
    shown = told.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("pdf_page").cast("int"), F.col("offset").cast("int")))).alias("shown"))  # pages of one gap
    out = out.join(shown, keys, "left")
    gap = _bisected(F.col("before.last"), F.col("after.first"), F.col("before.offset").cast("int"), F.coalesce("shown", F.create_map().cast("map<int,int>")))
    out = out.withColumn("gap", F.when(F.col("firm") & (F.col("strong") == 1) & apart, gap))
    lone = (F.col("strong") == 0) & ((o["first"] > b["last"]) | (o["last"] < b["first"]))
    warning = (
        F.when(~F.col("firm"), "conflict").when(F.coalesce(lone, F.lit(False)), "edge").when(F.col("strong") > 1, "many").when((F.col("strong") == 1) & F.col("gap").isNull(), "interleaved")
        .when(F.col("gap.right") - F.col("gap.left") > UNSURE, "unsure")
    )
    change = F.col("gap.right") - F.col("after.offset")
    part = lambda offset, start, end, votes: F.struct(offset.cast("int").alias("offset"), start.cast("int").alias("from_printed"), end.cast("int").alias("until_printed"), votes.cast("int").alias("votes"))
    one = F.array(part(b["offset"], F.lit(1), F.lit(None), b["votes"]))
    both = F.array(part(F.col("before.offset"), F.lit(1), change - 1, F.col("before.votes")), part(F.col("after.offset"), change, F.lit(None), F.col("after.votes")))
    segments = F.when(warning.isNull() | (warning == "edge"), F.when(F.col("strong") == 0, one).otherwise(both)).otherwise(F.array().cast(_SEGMENTS))
    return out.select(*keys, F.when(F.col("firm"), b["offset"]).cast("int").alias("offset"), segments.alias("segments"), warning.alias("warning"))


def map_rows(rows: DataFrame, fitted: DataFrame, page_counts: DataFrame) -> DataFrame:
    """(book, toc_id, seq, printed_page, target, status): contents rows with the page their number stands for.

    The offset of the one segment that holds the printed page, else the book's offset for the numbering. status:
    'mapped', 'no_offset', or 'outside' the pages of the file (1..page_count; a book without a page count has no upper end).
    Segments of a book travel as one array, so this is an equi-join, not a range join.
    """
    f = fitted.select("book", "numbering", F.col("offset").alias("_offset"), "segments")
    joined = rows.join(f, ["book", "numbering"], "left").join(page_counts.select(F.col("path").alias("book"), "page_count"), "book", "left")
    p = F.col("printed_page")
    fits = F.filter("segments", lambda s: (p >= s["from_printed"]) & (p <= F.coalesce(s["until_printed"], F.lit(10**9))))
    offset = F.when(F.size(fits) == 1, F.try_element_at(fits, F.lit(1))["offset"]).otherwise(F.col("_offset"))
    target = p + offset
    status = F.when(target.isNull(), "no_offset").when((target < 1) | (target > F.col("page_count")), "outside").otherwise("mapped")
    return joined.select("book", "toc_id", "seq", "printed_page", target.alias("target"), status.alias("status"))


def title_anchors(rows: DataFrame, pages: DataFrame, contents: DataFrame) -> DataFrame:
    """(book, toc_id, pdf_page, printed_page, offset): titles whose key stands on exactly one page that is no contents page.

    rows: contents rows; pages (book, page, text); contents (book, page). Only Arabic rows, keys of 7 and more characters, the first row
    of a key, the first 8 hits of a book in row order. Containment goes through an index: hashes of every 7 characters of
    a page's key meet the first 7 of a title's key. Only hashes and page numbers are shuffled; the pairs found meet the page's text
    once more to be verified. No page meets a title without a common piece. None of these tables is broadcast.
    """
    key = X.title_key(F.col("title"))
    first = F.min(F.struct("seq", "toc_id", "printed_page")).alias("f")
    keys = rows.where("numbering = 'arabic' and printed_page is not null").select("book", "seq", "toc_id", "printed_page", key.alias("key")).where(F.length("key") >= KEY_LENGTH)
    piece = lambda text: F.xxhash64(F.col("book"), text)
    keys = keys.groupBy("book", "key").agg(first).select("book", "key", "f.*", piece(F.substring("key", 1, KEY_LENGTH)).alias("piece"))
    body = pages.join(_shuffled(contents.select("book", "page").distinct()), ["book", "page"], "left_anti").select("book", "page", X.title_key(F.col("text")).alias("body")).where(F.length("body") >= KEY_LENGTH)
    spots = F.sequence(F.lit(1), F.length("body") - KEY_LENGTH + 1)
    pieces = F.array_distinct(F.transform(spots, lambda i: piece(F.substring(F.col("body"), i, F.lit(KEY_LENGTH)))))
    index = body.select("page", F.explode(pieces).alias("piece"))
    pairs = index.join(_shuffled(keys), "piece").select("book", "page", "key", "seq", "toc_id", "printed_page")
    hits = pairs.join(_shuffled(body), ["book", "page"]).where(F.contains(F.col("body"), F.col("key")))
    single = hits.groupBy("book", "key", "seq", "toc_id", "printed_page").agg(F.countDistinct("page").alias("n"), F.min("page").alias("pdf_page")).where("n = 1")
    w = Window.partitionBy("book").orderBy("seq", "toc_id")
    kept = single.withColumn("r", F.row_number().over(w)).where(F.col("r") <= ANCHORS)
    return kept.select("book", "toc_id", "pdf_page", "printed_page", (F.col("pdf_page") - F.col("printed_page")).alias("offset"))


def collected(sample: DataFrame, labels: DataFrame, page_counts: DataFrame, titles: DataFrame) -> DataFrame:
    """(book, numbering, pdf_page, printed_page, offset, source): the anchors of each book.

    Labels on the sampled pages (book, page) with a number from 1 to page_count + 200 ('page-label'); in books where no offset has three
    of them the title anchors as well ('chapter-title'). labels: (book, numbering, pdf_page, printed_page); page_counts: (book, page_count).
    """
    near = labels.join(_shuffled(sample.select("book", F.col("page").alias("pdf_page")).distinct()), ["book", "pdf_page"]).join(_shuffled(page_counts.select("book", "page_count")), "book")
    shape = lambda d, numbering, source: d.select("book", numbering.alias("numbering"), "pdf_page", "printed_page", (F.col("pdf_page") - F.col("printed_page")).alias("offset"), F.lit(source).alias("source"))
    read = shape(near.where("printed_page between 1 and page_count + 200").select("book", "numbering", "pdf_page", "printed_page").distinct(), F.col("numbering"), "page-label")
    enough = read.groupBy("book", "numbering", "offset").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST).select("book").distinct()
    return read.unionByName(shape(titles.join(_shuffled(enough), "book", "left_anti"), F.lit("arabic"), "chapter-title"))


def outline_gates(outline: DataFrame, page_counts: DataFrame, contents: DataFrame) -> DataFrame:
    """(book, rows, numbers, lost, on_contents, back_steps, offset, support, span, longest, accepted): what an old outline's page numbers show.

    outline: (book, seq, node_id, title, page_number); page_counts: (book, page_count); contents: (book, page). Titles that are a bare number
    without a leading zero count. A book is accepted if no such title points nowhere, there are 12 and a tenth of the pages of them and they
    are 70 % of the outline, both pages rise throughout, none points to a contents page, 95 % have one offset, and those
    span 12 pages and a fifth of the book and rise by one for 10 rows and a quarter of them. Books without pages or contents are not accepted.
    """
    n = F.col("page_count")
    t = X.clean_text(F.col("title"))
    rows = outline.join(page_counts.select("book", "page_count"), "book", "left").join(contents.select("book", F.col("page").alias("page_number"), F.lit(True).alias("_toc")).distinct(), ["book", "page_number"], "left")
    rows = rows.select("book", "seq", "node_id", F.when(t.rlike("^[1-9][0-9]{0,4}$"), t.cast("int")).alias("printed"), F.col("page_number").alias("page"), "page_count", "_toc")
    valid = F.coalesce(F.col("page").between(1, n), F.lit(False))
    numbers = rows.where("printed is not null")
    steps = scans(chunked(numbers, "book", "seq", "node_id"), "book", {"_b": (F.struct("printed", "page"), "last", False)})
    back = (F.col("printed") <= F.col("_b.printed")) | (F.col("page") <= F.col("_b.page"))
    whole = rows.groupBy("book").agg(F.count(F.lit(1)).alias("rows"), F.max("page_count").alias("page_count"), F.count("printed").alias("numbers"), F.count_if(F.col("printed").isNotNull() & ~valid).alias("lost"), F.count_if(F.col("printed").isNotNull() & F.col("_toc")).alias("on_contents"))
    stepped = steps.groupBy("book").agg(F.count_if(back).alias("back_steps"))
    by_offset = numbers.where("page is not null").groupBy("book", (F.col("page") - F.col("printed")).alias("offset")).agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("lo"), F.max("page").alias("hi"))
    best = by_offset.groupBy("book").agg(F.max(F.struct("n", (-F.col("offset")).alias("down"), "offset", (F.col("hi") - F.col("lo") + 1).alias("span"))).alias("b")).select("book", F.col("b.offset").alias("offset"), F.col("b.n").alias("support"), F.col("b.span").alias("span"))
    same = numbers.join(best.select("book", "offset"), "book").where("page - printed = offset")
    runs = longest_run(same, "book", "seq", "node_id", "printed", "page")
    out = whole.join(stepped, "book", "left").join(best, "book", "left").join(runs, "book", "left").join(contents.select("book", F.lit(True).alias("_has")).distinct(), "book", "left")
    ok = (
        F.col("_has") & (F.col("lost") == 0) & (F.col("numbers") >= F.greatest(F.lit(12), F.ceil(n / 10))) & (F.col("numbers") * 10 >= F.col("rows") * 7) & (F.col("back_steps") == 0) & (F.col("on_contents") == 0)
        & (F.col("support") * 20 >= F.col("numbers") * 19) & (F.col("span") >= F.greatest(F.lit(12), F.floor((n + 4) / 5))) & (F.col("longest") >= F.greatest(F.lit(10), F.floor(F.col("support") / 4)))
    )
    return out.select("book", "rows", "numbers", "lost", "on_contents", F.coalesce("back_steps", F.lit(0)).alias("back_steps"), "offset", "support", "span", "longest", F.coalesce(ok, F.lit(False)).alias("accepted"))


def outline_anchors(outline: DataFrame, page_counts: DataFrame, contents: DataFrame) -> DataFrame:
    """(book, pdf_page, printed_page, offset): up to five page numbers of each accepted outline, spread over the book.

    Five targets, behind the contents or over the whole book if those lie in the last 30 %; each takes the nearest page not
    taken yet, the earlier one on ties. The pages of one book are one row's array.
    """
    good = outline_gates(outline, page_counts, contents).where("accepted").select("book", "offset")
    t = X.clean_text(F.col("title"))
    rows = outline.where(t.rlike("^[1-9][0-9]{0,4}$")).join(good, "book").where(F.col("page_number") - t.cast("int") == F.col("offset"))
    pages = rows.groupBy("book", "offset").agg(F.array_sort(F.collect_set("page_number")).alias("pages"))
    span = contents.where("page is not null").groupBy("book").agg(F.min("page").alias("first"), F.max("page").alias("last"))
    both = pages.join(span, "book").join(page_counts.select("book", "page_count"), "book")
    n = F.col("page_count")
    start = F.least(F.col("last") + 1, n)
    spread = lambda base, size, parts: [base + F.bround(size * F.lit(f)).cast("int") for f in parts]
    front = F.array(F.least(start + 9, n), *spread(start, F.greatest(n - start, F.lit(1)), (0.2, 0.4, 0.6, 0.97)))
    targets = F.when(F.col("first") > n * 0.70, F.array(F.lit(10), *spread(F.lit(0), n, (0.2, 0.4, 0.6, 0.8)))).otherwise(front)

    def take(chosen: Column, target: Column) -> Column:
        nearest = F.array_min(F.transform(F.array_except("pages", chosen), lambda p: F.struct(F.abs(p - target).alias("far"), p.alias("page"))))["page"]
        return F.when(nearest.isNull(), chosen).otherwise(F.array_append(chosen, nearest))

    picked = F.array_sort(F.aggregate(targets, F.array().cast("array<int>"), take))
    out = both.select("book", "offset", F.explode(picked).alias("pdf_page"))
    # five rows a book at most, behind many branches
    return cut_lineage(out.select("book", "pdf_page", (F.col("pdf_page") - F.col("offset")).alias("printed_page"), "offset"))


def body_sample(books: DataFrame) -> DataFrame:
    """(book, page): pages of the body to look at, from (book, page_count, first_toc, last_toc, toc_pages).

    Eleven pages behind the contents and five spread over the rest; if the contents lie in the last 30 %, the first twelve
    and four spread ones. Contents pages are left out. Rounding is half to even.
    """
    n, last = F.col("page_count"), F.col("last_toc")
    start = F.least(last + 1, n)
    span = F.greatest(n - start, F.lit(1))
    spread = lambda base, size, parts: F.array(*[base + F.bround(size * F.lit(f)).cast("int") for f in parts])
    front = F.concat(F.sequence(start, F.least(start + 10, n)), spread(start, span, (0.2, 0.4, 0.6, 0.8, 0.97)))
    back = F.concat(F.sequence(F.lit(1), F.greatest(F.least(F.lit(12), n), F.lit(1))), spread(F.lit(0), n, (0.2, 0.4, 0.6, 0.8)))
    picked = F.when(F.col("first_toc") > n * 0.70, back).otherwise(front)
    inside = F.filter(F.array_distinct(picked), lambda p: (p >= 1) & (p <= n))
    return books.where("page_count >= 1 and first_toc is not null").select("book", F.explode(F.array_except(inside, "toc_pages")).alias("page"))


def verify(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(book, confirmed, contradicted, spread, verified): anchors of a book held against the labels printed on their pages.

    Any other label on such a page vetoes the book; else at least three have to be confirmed, spread over at least 5 pages and
    half of the candidates' own spread.
    """
    seen = labels.groupBy("book", "pdf_page").agg(F.collect_set(F.struct("numbering", "printed_page")).alias("seen"))  # labels of one page
    joined = candidates.join(seen, ["book", "pdf_page"], "left")
    mine = F.struct(F.lit("arabic").alias("numbering"), F.col("printed_page").alias("printed_page"))
    other = F.exists(F.coalesce("seen", F.array()), lambda s: (s["numbering"] != "arabic") | (s["printed_page"] != F.col("printed_page")))
    ok = F.coalesce(F.exists("seen", lambda s: (s["numbering"] == mine["numbering"]) & (s["printed_page"] == mine["printed_page"])), F.lit(False))
    out = joined.groupBy("book").agg(
        F.count_if(ok).alias("confirmed"), F.count_if(other).alias("contradicted"), (F.max(F.when(ok, F.col("pdf_page"))) - F.min(F.when(ok, F.col("pdf_page")))).alias("spread"),
        (F.max("pdf_page") - F.min("pdf_page")).alias("whole"),
    )
    good = (F.col("contradicted") == 0) & (F.col("confirmed") >= 3) & (F.col("spread") >= F.greatest(F.lit(5), F.floor(F.col("whole") / 2)))
    return out.withColumn("verified", F.coalesce(good, F.lit(False))).drop("whole")


def verified_anchors(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(book, pdf_page, printed_page, offset): the confirmed candidates of the books that `verify` accepts."""
    good = verify(candidates, labels).where("verified").select("book")
    confirmed = labels.where("numbering = 'arabic'").select("book", "pdf_page", "printed_page").distinct()
    return candidates.join(good, "book").join(confirmed, ["book", "pdf_page", "printed_page"], "left_semi").select("book", "pdf_page", "printed_page", (F.col("pdf_page") - F.col("printed_page")).alias("offset"))
