import datetime
import json

from quirelake.operators import layout, offsets, reports, responses
from quirelake.plans import catalog
from quirelake.streaming import reports as live


def test_ladder(spark):
    """Every outcome of the fit: pages with their offsets, labels of pages between, result."""
    many = lambda off, pages: [(p, off) for p in pages]
    good = [(p, 10) for p in (12, 13, 17, 18, 91, 172)] + [(12, -39), (13, -39), (17, 16), (18, 16)]
    cases = [
        (good, {}, (10, [(10, 1, None, 6)], None)), (many(1, (1, 2)), {}, (None, [], "conflict")), (many(1, (1, 2, 3)) + many(2, (7, 8, 9)), {}, (None, [], "conflict")),
        (many(1, (1, 2, 3)) + many(2, (9,)), {}, (1, [(1, 1, None, 3)], "edge")), (many(1, (1, 2, 9)) + many(2, (5,)), {}, (1, [(1, 1, None, 3)], None)), (many(1, range(1, 9)) + many(2, (20, 21)) + many(3, (30, 31)), {}, (1, [], "many")),
        (many(1, (1, 2, 3, 30)) + many(2, (9, 10)), {}, (1, [], "interleaved")), (many(1, (1, 2, 3)) + many(4, (30, 31)), {}, (1, [], "unsure")),
        (many(1, (1, 2, 3)) + many(4, (30, 31)), {p: 1 if p < 17 else 4 for p in range(40)}, (1, [(1, 1, 12, 3), (4, 13, None, 2)], None)),
        (many(4, (30, 31, 32)) + many(1, (1, 2)), {p: 1 if p < 9 else 4 for p in range(40)}, (4, [(1, 1, 4, 2), (4, 5, None, 3)], None)),
    ]
    anchors = [(f"b{i}", "arabic", p, p - off, off) for i, (pages, _, _) in enumerate(cases) for p, off in pages * 2]
    labels = [(f"b{i}", "arabic", p, p - off) for i, (_, shown, _) in enumerate(cases) for p, off in shown.items()]
    shape = "book string, numbering string, pdf_page int, printed_page int"
    df = spark.createDataFrame(anchors + [(None, "arabic", 1, 1, 0), ("x", None, 1, 1, 0), ("y", "arabic", None, 1, None)], shape + ", offset int")
    got = {r["book"]: (r["offset"], [tuple(s) for s in r["segments"]], r["warning"]) for r in offsets.fit(df, spark.createDataFrame(labels, shape)).collect()}
    assert got == {f"b{i}": want for i, (_, _, want) in enumerate(cases)}
    assert offsets.fit(df.where("pdf_page < 0")).count() == 0


NUMBERS = [(str(n), n + 10) for n in range(1, 182)]
FRONT = [("封面", 1), ("书名", 3), ("版权", 4), ("前言", 5), ("目录", 10)]


def outlines(spark):
    swap = [*NUMBERS[:49], NUMBERS[50], NUMBERS[49], *NUMBERS[51:]]
    books = {
        "good": FRONT + NUMBERS, "twice": [*NUMBERS[:79], ("79", 90), *NUMBERS[80:]], "swapped": swap, "changed": [(str(n), n + (9 if n <= 90 else 10)) for n in range(1, 182)], "few": NUMBERS[:12], "onto contents": NUMBERS,
        "zeroes": [("0" + t, p) for t, p in NUMBERS], "sections": [(t + ".1", p) for t, p in NUMBERS], "lost": [*NUMBERS[:50], ("51", None), *NUMBERS[51:]], "no contents": NUMBERS, "nothing": [(None, None)],
    }
    data = [(b, i, len(b) * 1000 + i, t, p) for b, rows in books.items() for i, (t, p) in enumerate(rows)]
    outline = spark.createDataFrame(data, "book string, seq int, node_id int, title string, page_number int")
    pages = spark.createDataFrame([(b, 191) for b in books], "book string, page_count int")
    contents = spark.createDataFrame([(b, 60 if b == "onto contents" else 10 if b == "good" else 5) for b in books if b != "no contents"], "book string, page int")
    return outline, pages, contents


def test_outline_anchors(spark):
    outline, pages, contents = outlines(spark)
    candidates = offsets.outline_anchors(outline, pages, contents)
    found = sorted(map(tuple, candidates.collect()))
    assert len(found) == 5 and {(b, o) for b, _, _, o in found} == {("good", 10)}
    assert found[0][1] <= 25 and found[-1][1] >= 170
    gates = {r["book"]: r.asDict() for r in offsets.outline_gates(outline, pages, contents).collect()}
    assert len(gates) == 11 and gates["swapped"]["back_steps"] == 1 and gates["onto contents"]["on_contents"] == 1 and gates["lost"]["lost"] == 1 and gates["zeroes"]["numbers"] == 0
    assert offsets.outline_anchors(outline.where("seq < 0"), pages, contents).count() == 0
    label = lambda shift: spark.createDataFrame([("good", "arabic", p, p - shift(p)) for p in range(1, 192)], "book string, numbering string, pdf_page int, printed_page int")
    assert offsets.verified_anchors(candidates, label(lambda p: 10)).count() == 5
    assert offsets.verified_anchors(candidates, label(lambda p: 9)).count() == 0
    assert offsets.verified_anchors(candidates, label(lambda p: 11 if 80 <= p <= 120 else 10)).count() == 0


def test_collected_anchors(spark):
    shape = "book string, numbering string, pdf_page int, printed_page int"
    labels = spark.createDataFrame([("a", "arabic", p, p - 2) for p in (3, 4, 5, 9)] + [("b", "arabic", 3, 1), ("b", "roman", 4, 0), ("b", "arabic", 5, 999), ("c", "arabic", 3, 3)], shape)
    sample = spark.createDataFrame([(b, p) for b in "abc" for p in (3, 4, 5)], "book string, page int")
    counts = spark.createDataFrame([("a", 20), ("b", 20)], "book string, page_count int")
    titles = spark.createDataFrame([("a", 1, 7, 5, 2), ("b", 2, 8, 5, 3)], "book string, toc_id int, pdf_page int, printed_page int, offset int")
    got = sorted(map(tuple, offsets.collected(sample, labels, counts, titles).collect()))
    assert got == [("a", "arabic", p, p - 2, 2, "page-label") for p in (3, 4, 5)] + [("b", "arabic", 3, 1, 2, "page-label"), ("b", "arabic", 8, 5, 3, "chapter-title")]


def test_fit_and_map(spark):
    toc = [(i, "b", i, p, "arabic", p + (5 if p < 50 else 7)) for i, p in enumerate([1, 10, 20, 30, 49, 50, 51, 60, 70])] + [(90, "b", 90, 55, "arabic", None), (91, "b", 91, 999, "arabic", None), (92, "b", 92, 3, "roman", None), (93, "b", 93, None, "arabic", None), (94, None, 1, 1, None, 1)]
    rows = spark.createDataFrame(toc, "toc_id int, book string, seq int, printed_page int, numbering string, pdf_page int")
    fitted = offsets.fit(offsets.row_anchors(rows))
    got = fitted.where("book = 'b'").collect()[0]
    assert got["offset"] == 5 and [tuple(s) for s in got["segments"]] == [(5, 1, 49, 5), (7, 50, None, 4)]
    pages = spark.createDataFrame([("b", 100)], "path string, page_count int")
    out = {r["toc_id"]: (r["target"], r["status"]) for r in offsets.map_rows(rows, fitted, pages).collect()}
    assert out[4] == (54, "mapped") and out[5] == (57, "mapped") and out[90] == (62, "mapped") and out[91][1] == "outside" and out[92] == (None, "no_offset") and out[93] == (None, "no_offset")


def test_title_anchors_by_index(spark):
    rows = spark.createDataFrame([(1, "b", 1, "1.1 Heat Flow", 3, "arabic"), (2, "b", 2, "Short", 4, "arabic"), (3, "b", 3, "Map Projections", 5, "arabic"), (4, "b", 4, "Wave Motion", 6, "roman"), (5, "b", 5, "Not There At All", 7, "arabic")], "toc_id int, book string, seq int, title string, printed_page int, numbering string")
    pages = spark.createDataFrame([("b", 2, "1.1 Heat Flow ... 3 Map Projections"), ("b", 9, "so heat-flow begins"), ("b", 11, "Map projections"), ("b", 12, "map projections again"), ("c", 9, "Map Projections"), ("b", 13, "")], "book string, page int, text string")
    contents = spark.createDataFrame([("b", 2)], "book string, page int")
    assert [tuple(r) for r in offsets.title_anchors(rows, pages, contents).collect()] == [("b", 1, 9, 3, 6)]


def test_verify_vetoes(spark):
    rows = spark.createDataFrame([(b, p, p - 10) for b in "ab" for p in (12, 40, 90)], "book string, pdf_page int, printed_page int")
    labels = [(b, "arabic", p, p - 10) for b in "ab" for p in (12, 40, 90)] + [("b", "roman", 40, 4)]
    out = {r["book"]: r["verified"] for r in offsets.verify(rows, spark.createDataFrame(labels, "book string, numbering string, pdf_page int, printed_page int")).collect()}
    assert out == {"a": True, "b": False}


def test_merges(spark, rows):
    old, new = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "line string"), spark.createDataFrame([("a",), ("c",)], "line string")
    once = reports.merge_lines(old, new)
    assert rows(once) == rows(reports.merge_lines(old, once)) and once.count() == 5
    left = spark.createDataFrame([("x", 1, "l"), ("y", 2, "l"), ("", 3, "l"), (None, 4, "l")], "source string, n int, only_old string")
    right = spark.createDataFrame([("x", 9), (None, 8)], "source string, n int")
    got = reports.upsert(left, right, "source").select("source", "n", "only_old")
    assert rows(got) == sorted([("x", 9, None), ("y", 2, "l"), ("", 3, "l"), (None, 4, "l"), (None, 8, None)], key=repr)
    done = spark.createDataFrame([("x", None), ("y", 5)], "source string, size int")
    listing = spark.createDataFrame([("x", None), ("y", 6), ("z", 1)], "source string, size int")
    assert rows(reports.unchanged(listing, done, "source", ("size",))) == [("x", None)]


def test_usage(spark):
    use = lambda **k: json.dumps({"api_usage": k})
    good = dict.fromkeys(reports.USAGE, 2)
    data = [("j", use(**good)), ("j", json.dumps({"api_usage": json.dumps(good)})), ("j", use(**{**good, "prompt_tokens": True, "total_tokens": -1, "completion_tokens": 1.5})), ("j", use()), ("j", "bad"), ("j", None), ("j", "{}")]
    r = reports.usage_totals(spark.createDataFrame(data, "job_id string, payload string")).collect()[0]
    assert (r["rows"], r["with_usage"], r["prompt_tokens"], r["completion_tokens"], r["total_tokens"], r["reported_responses"]) == (7, 3, 4, 4, 4, 6)


def test_accepted_usage(spark):
    use = lambda *v: json.dumps({"api_usage": dict(zip(reports.USAGE, v))})
    data = [("j", use(1, 2, 3)), ("j", use(1, 2, 4)), ("j", use(True, 2, 3)), ("j", use(-1, 2, 1)), ("j", use(1.5, 2, 3.5)), ("j", use(5, 0, 5)), ("j", "{}"), ("j", "bad"), ("j", None), (None, use(1, None, 1))]
    got = {r["job_id"]: tuple(r)[1:] for r in reports.accepted_usage(spark.createDataFrame(data, "job_id string, payload string")).collect()}
    assert got == {"j": (2, 5, 6, 2, 8), None: (0, 1, 0, 0, 0)}
    shape = "source string, " + ", ".join(f"{c} long" for c in reports.USAGE)
    before, after = spark.createDataFrame([("a", 5, 1, 6, 1, 0)], shape), spark.createDataFrame([("a", 8, 0, 9, 2, 0), ("b", 1, None, 1, 1, 0)], shape)
    assert sorted(map(tuple, reports.usage_delta(before, after, "source").collect())) == [("a", 3, 0, 3, 1, 0), ("b", 1, 0, 1, 1, 0)]


def test_words_to_lines(spark):
    words = [("b", 1, t, x, y, 10.0 * len(t), 10.0) for t, x, y in (("World", 80.0, 51.0), ("Hello", 20.0, 50.0), ("Next", 20.0, 80.0), ("9", 300.0, 81.0))]
    schema = "book string, page int, text string, x double, y double, width double, height double"
    df = spark.createDataFrame([*words, ("b", 1, None, 1.0, 1.0, 1.0, 1.0)], schema)
    assert [r["text"] for r in layout.group_words(df, 400).orderBy("line").collect()] == ["Hello World", "Next   9"]
    both = [("b", 2, "lefttext", x, float(y), 60.0, 10.0) for x in (10.0, 300.0) for y in (10, 30, 50)]
    assert layout.group_words(spark.createDataFrame(both, schema), 400).count() == 6
    assert layout.group_words(df.where("page > 5"), 400).count() == 0


def test_words_without_width(spark):
    schema = "book string, page int, text string, x double, y double, width double, height double"
    words = [("b", 1, "Hello", 20.0, 50.0, None, 10.0), ("b", 1, "World", 80.0, 51.0, 50.0, 10.0), ("b", 1, "9", 300.0, 51.0, None, 10.0)]
    alone = [("b", 2, "Only", 20.0, 50.0, None, 10.0), ("b", 2, "", 90.0, 50.0, None, 10.0)]
    split = [("b", 3, "lefttext", x, float(y), None, 10.0) for x in (10.0, 300.0) for y in (10, 30, 50)]
    gone = [("b", 4, "x", None, 1.0, 1.0, 1.0), ("b", 4, "x", 1.0, None, 1.0, 1.0), ("b", 4, "x", 1.0, 1.0, 1.0, None), ("b", 4, None, 1.0, 1.0, 1.0, 1.0)]
    out = layout.group_words(spark.createDataFrame(words + alone + split + gone, schema), 400).orderBy("page", "line").collect()
    assert [(r["page"], r["text"], r["right_edge"]) for r in out[:2]] == [(1, "Hello World   9", 310.0), (2, "Only", 90.0)]
    assert [(r["page"], r["x"]) for r in out[2:]] == [(3, 10.0)] * 3 + [(3, 300.0)] * 3


def test_lines_of_words():
    """Against the definition: the middle of all centres of the last line."""
    import random
    from statistics import median

    rnd = random.Random(2)
    for _ in range(200):
        mids = sorted(rnd.choice([rnd.uniform(0, 60), rnd.randrange(12) * 5.0]) for _ in range(rnd.randrange(40)))
        want, rows = [], []
        for m in mids:
            if not rows or abs(m - median(rows[-1])) > 4:
                rows.append([])
            rows[-1].append(m)
            want.append(len(rows) - 1)
        assert layout.line_numbers(mids, 4) == want


def test_edge_labels(spark):
    rows = [
        ("b", 1, "12", 60.0, 90.0, 5.0, 15.0), ("b", 1, "12", 60.0, 90.0, 5.0, 15.0), ("b", 2, "iv Title here", 60.0, 200.0, 590.0, 600.0), ("b", 3, "13", 60.0, 90.0, 300.0, 310.0), ("b", 4, None, 60.0, 90.0, 1.0, 2.0),
        ("b", 5, "i think this is a mix", 100.0, 300.0, 1.0, 2.0), ("b", 6, "A longer title 14", 60.0, 400.0, 1.0, 2.0), ("b", 7, "Title 15", 60.0, None, 1.0, 2.0), ("b", 8, "16 Title 17", None, 400.0, 1.0, 2.0), ("b", 9, "", 1.0, 1.0, 1.0, 1.0),
        ("b", 10, "18 Title 18", 60.0, 400.0, 1.0, 2.0),
    ]
    df = spark.createDataFrame(rows, "book string, page_number int, text string, x double, right_edge double, y double, bottom double")
    assert sorted(map(tuple, layout.edge_labels(df, 600, 420).collect())) == [("b", 1, "arabic", 12), ("b", 2, "roman", 4), ("b", 6, "arabic", 14), ("b", 10, "arabic", 18)]


def test_response_checks(spark):
    entry = lambda title="T", page="3", level=1: {"title": title, "printed_page": page, "level": level}
    docs = [
        {"is_toc": True, "entries": [entry(), entry(page=" ( 12 ) "), entry(page="（１２）"), entry(page="iv", level=9), entry(page=None), entry("  "), entry(page=True), entry(level=7), entry(page="0"), entry(page=221), entry("a  b...")]},
        {"is_toc": "true", "entries": []}, {"is_toc": True, "entries": {}}, {"is_toc": True, "uncertain": "false", "entries": []}, {"is_toc": False, "entries": [entry()]}, [],
    ]
    df = spark.createDataFrame([(i, json.dumps(d), 20) for i, d in enumerate(docs)] + [(9, "bad", 20), (10, None, 20)], "id int, j string, n int")
    out = responses.contents_entries(df, "j", "id", "n").collect()
    first = [r["outcome"] for r in sorted((r for r in out if r["row_id"] == 0), key=lambda r: r["position"])]
    assert first == ["keep", "keep", "keep", "drop", "drop", "title", "label", "level", "range", "range", "keep"]
    assert {r["row_id"]: r["outcome"] for r in out if r["row_id"]} == {1: "is_toc", 2: "entries", 3: "uncertain", 5: "json", 9: "json", 10: "json"}
    assert [r["title"] for r in out if r["position"] == 11] == ["a b"]


def test_entries_in_any_shape(spark, tmp_path):
    entry = lambda title: {"title": title, "printed_page": "3", "level": 1}
    held = [[entry("a"), None, entry("b")], json.dumps([entry("a"), entry("")]), entry("a"), json.dumps(entry("a")), "no json", None, [], 5]
    data = [(i, json.dumps({"page_count": 20, "entries": h})) for i, h in enumerate(held)] + [(8, "{}"), (9, "bad"), (10, None)]
    spark.createDataFrame(data, "log_id long, payload string").write.parquet(str(tmp_path / "report_log.parquet"))
    got = sorted(((r["row_id"], r["position"], r["outcome"]) for r in catalog.response_entries(spark, str(tmp_path)).collect()), key=repr)
    assert got == [(0, 1, "keep"), (0, 2, "title"), (0, 3, "keep"), (1, 1, "keep"), (1, 2, "title"), (2, 1, "keep"), (3, 1, "keep"), (4, None, "entries"), (5, None, "entries"), (7, None, "entries")]
    counts = {r["log_id"]: r["entry_count"] for r in catalog.report_summary(spark, str(tmp_path)).collect()}
    assert counts == {0: 3, 1: 2, 2: 1, 3: 1, 4: 0, 5: 0, 6: 0, 7: 0, 8: 0}


def test_reusable_labels(spark):
    batches = spark.createDataFrame([("b", [4, 5, 6], [(4, "arabic", 1)]), ("b", [5, 7], [(5, "arabic", 9)]), ("b", [7], [(7, "arabic", 3)]), ("b", [4], [(4, "arabic", 1)])], "book string, pages array<int>, labels array<struct<page:int,numbering:string,value:int>>")
    needed = spark.createDataFrame([("b", p) for p in (4, 5, 6, 8)], "book string, page int")
    assert {r["page"]: (r["state"], r["value"]) for r in responses.reusable_labels(needed, batches).collect()} == {4: ("known", 1), 5: ("conflict", None), 6: ("empty", None), 8: ("missing", None)}


def test_label_lists_of_batches(spark, rows, tmp_path):
    labels = "book string, pages array<int>, labels array<struct<page:int,numbering:string,value:int>>"
    both = [(1, "arabic", 1), (1, "roman", 5)]
    batches = spark.createDataFrame([("b", [1, 2], [*both, (2, "arabic", 2)]), ("b", [1, 2], [*both[::-1], (2, "arabic", 2), (2, "roman", 9)])], labels)
    got = rows(responses.reusable_labels(spark.createDataFrame([("b", 1), ("b", 2)], "book string, page int"), batches))
    assert got == [("b", 1, "known", "arabic", 1), ("b", 1, "known", "roman", 5), ("b", 2, "conflict", None, None)]
    day = lambda n: datetime.datetime(2025, 1, n)
    lines = [("b", 1, "12", 5.0, 15.0, day(1)), ("b", 2, "no label here", 300.0, 310.0, day(1)), ("b", 3, "text", 300.0, 310.0, day(1)), ("b", 3, "14", 590.0, 600.0, day(20))]
    spark.createDataFrame(lines, "book string, page_number int, text string, y double, bottom double, loaded_at timestamp").selectExpr("*", "50.0D as x", "400.0D as right_edge").write.parquet(str(tmp_path / "page_lines.parquet"))
    spark.createDataFrame([("b", p) for p in (1, 2, 3, 4, None)], "book string, pdf_page int").write.parquet(str(tmp_path / "toc_rows.parquet"))
    got = rows(catalog.label_reuse(spark, str(tmp_path)))
    assert got == [("b", 1, "known", "arabic", 12), ("b", 2, "empty", None, None), ("b", 3, "conflict", None, None), ("b", 4, "missing", None, None)]


def test_stream_equals_batch(spark, rows, tmp_path):
    cols = "log_id long, source string, status string, source_size long, source_mtime_ns long"
    data = [(i, f"s{i % 5}" if i % 7 else None, "success" if i % 3 else "FAILED", i, i) for i in range(60)]
    df = spark.createDataFrame(data, cols)
    df.repartition(6).write.parquet(str(tmp_path / "log"))
    stream = live.report_stream(spark, str(tmp_path / "log"), df, 2)
    live.keep_latest(stream, str(tmp_path / "state"), str(tmp_path / "cp"), buckets=4).awaitTermination()
    state = live.current(spark, str(tmp_path / "state"))
    want = reports.latest(df)
    assert rows(state.select(*want.columns)) == rows(want)
    assert rows(live.status_counts(state)) == rows(reports.status_counts(want))
    assert live.current(spark, str(tmp_path / "none")) is None


def test_tail(tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_bytes(b'{"old": 1}\n{"part')
    t = live.Tail(str(p))
    with p.open("ab") as f:
        f.write(b'ial": 1}\n{"a": "' + "目".encode()[:2])
    assert t.lines() == []
    with p.open("ab") as f:
        f.write("目".encode()[2:] + b'"}\n')
    assert t.lines() == ['{"a": "目"}'] and t.lines() == []
    p.write_bytes(b"new\n")
    assert t.lines() == ["new"] and t.was_reset
    p.unlink()
    assert t.lines() == [] and t.was_reset
