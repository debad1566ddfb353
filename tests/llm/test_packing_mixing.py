import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quirelake.llm import mixing, packing
from quirelake.llm.tokens import TOKENIZER, load

WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


def plain_sum_of_squares(sizes, capacity):
    """The rule, tried out on every choice."""
    boxes = []
    for s in sizes:
        levels = {b for b in boxes if b < capacity and b + s <= capacity}

        def squares(h):
            new = [*boxes]
            if h is None:
                new.append(s)
            else:
                new[new.index(h)] += s
            return sum(new.count(x) ** 2 for x in {x for x in new if 0 < x < capacity})

        best = min([*sorted(levels), None], key=lambda h: (squares(h), h is None))
        if best is None:
            boxes.append(s)
        else:
            boxes[boxes.index(best)] += s
    return boxes


@settings(max_examples=150, deadline=None)
@given(st.integers(2, 12).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=30))))
def test_sum_of_squares(case):
    capacity, sizes = case
    out = packing.sum_of_squares(np.array(sizes, dtype=np.int64), capacity)
    fills = {}
    for box, s in zip(out.tolist(), sizes):
        fills[box] = fills.get(box, 0) + s
    assert sum(fills.values()) == sum(sizes) and all(f <= capacity for f in fills.values())
    assert len(fills) <= len(plain_sum_of_squares(sizes, capacity))


def docs(spark, n=300):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(WORDS, rng.integers(1, 60))) for _ in range(n)]
    sources = ["big" if i % 3 else "Small " if i % 2 else "tiny-one" for i in range(n)]
    extra = [(n, None, "big"), (n + 1, "", "big"), (n + 2, texts[0], "big"), (n + 3, "unlisted words", None), (n + 4, "other words", "elsewhere")]
    return spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, sources))] + extra, "doc_id long, text string, source string").selectExpr("*", "1 as tokens", "'x' as id")


def test_pack(spark):
    df = docs(spark)
    sizes = spark.createDataFrame([("a", 16), ("b", 64), ("none", None), ("zero", 0)], "pack_id string, capacity_tokens int")
    out = packing.pack(df, sizes, shard_texts=100).collect()
    enc = load(TOKENIZER)
    n = {r["doc_id"]: len(enc.encode_ordinary(r["text"] or "")) for r in df.collect()}
    assert {r["pack_id"] for r in out} == {"a", "b"}
    for name, cap in (("a", 16), ("b", 64)):
        mine = [r for r in out if r["pack_id"] == name]
        boxes, parts = {}, {}
        for r in mine:
            boxes[r["container_id"]] = boxes.get(r["container_id"], 0) + r["tokens"]
            parts.setdefault(r["doc_id"], []).append((r["first_token"], r["tokens"]))
        assert max(boxes.values()) <= cap
        assert {d for d, k in n.items() if k} == set(parts)
        for d, p in parts.items():
            assert sum(t for _, t in p) == n[d] and len(p) == max(1, -(-n[d] // cap)) and all(t == cap for _, t in sorted(p)[:-1])
    for r in packing.room(packing.pack(df, sizes)).collect():
        assert r["containers"] <= 1.1 * r["least_containers"] and 0 <= r["unused"] < 0.1
    assert packing.pack(df.where("doc_id < 0"), sizes).count() == 0 and packing.pack(df, sizes.where("capacity_tokens > 999")).count() == 0


def targets(spark):
    return spark.createDataFrame([("big", 0.5, 1), ("small", 0.3, 3), ("tiny_one", 0.15, 2), ("absent", 0.05, 9), (None, 0.1, 1)], "source string, target_share double, max_repeats int")


def test_mix(spark):
    df = docs(spark)
    uses, plan = mixing.mix(df, targets(spark))
    rows = uses.collect()
    assert all(0 <= r["position"] <= 1 for r in rows) and not {r["doc_id"] for r in rows} & {300, 301, 302, 303, 304}
    most = {"big": 1, "small": 3, "tiny_one": 2}
    per = {}
    for r in rows:
        per[r["doc_id"]] = per.get(r["doc_id"], 0) + 1
        assert r["pass"] <= most[r["source"]]
    assert {r["doc_id"]: r["uses"] for r in mixing.counted(uses).collect()} == per
    got = {r["source"]: r for r in mixing.shares(uses, plan).collect()}
    total = 0.95
    for s, share in (("big", 0.5), ("small", 0.3), ("tiny_one", 0.15)):
        assert got[s]["reached"] and abs(got[s]["actual_share"] - share / total) < 0.01
    assert got["absent"]["actual_share"] == 0 and not got["absent"]["reached"]


def test_mix_beyond_supply_and_empty(spark):
    df = docs(spark)
    uses, plan = mixing.mix(df, targets(spark), total_tokens=10**6)
    got = {r["source"]: r for r in mixing.shares(uses, plan).collect()}
    every = {r["source"]: r["tokens"] for r in plan.collect()}
    assert got["small"]["tokens_used"] == 3 * every["small"] and got["small"]["most_uses"] == 3 and not got["small"]["reached"]
    assert mixing.mix(df.where("doc_id < 0"), targets(spark))[0].count() == 0


@settings(max_examples=100, deadline=None)
@given(st.floats(0, 1), st.floats(-0.9, 0.9))
def test_inverse(y, tilt):
    t = 2 * y / ((1 - tilt) + ((1 - tilt) ** 2 + 4 * tilt * y) ** 0.5)
    assert abs(t + tilt * (t * t - t) - y) < 1e-9


def test_found_queries_run(spark):
    from quirelake.llm import queries

    for name in ("p3_found", "p4_found", "p8_found"):
        assert queries.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_text_shared_with_an_unlisted_source(spark):
    df = spark.createDataFrame([(1, "the same words", "elsewhere"), (2, "the same words", "big"), (3, "other words here", "big"), (4, "x y", None)], "doc_id long, text string, source string")
    uses, _ = mixing.mix(df, spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int"))
    assert sorted(r["doc_id"] for r in uses.collect()) == [2, 3]


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_SOURCES", 5)
    df = spark.createDataFrame([(i, f"text number {i}", f"s{i}") for i in range(40)], "doc_id long, text string, source string")
    targets_ = spark.createDataFrame([(f"s{i}", 1 / 40, 2) for i in range(40)], "source string, target_share double, max_repeats int")
    uses, plan = mixing.mix(df, targets_)
    assert len({r["source"] for r in uses.collect()}) == 40 == len(mixing.shares(uses, plan).collect())
    every = mixing.shares(*mixing.mix(df, targets_, total_tokens="all")).collect()
    assert sum(r["tokens_used"] for r in every) == sum(r["tokens"] for r in plan.collect())


def test_several_shards_against_one():
    """What shards cost: each leaves open containers of its own."""
    rnd = np.random.default_rng(4)
    sizes, cap = rnd.integers(1, 400, 6000), 512
    least = -(-int(sizes.sum()) // cap)
    boxes = [sum(len(set(packing.sum_of_squares(part, cap))) for part in np.array_split(sizes, k)) for k in (1, 4, 12)]
    assert boxes[0] <= 1.01 * least and boxes[1] <= 1.03 * least and boxes[2] <= 1.03 * least, (least, boxes)
