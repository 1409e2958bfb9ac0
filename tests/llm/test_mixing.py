import math
import random
import re

from pyspark.sql import functions as F

from loomwork.llm.mixing import hypergeometric, mix, mix_digest, mixed_shards, permuted_by, sides, split_quotas, targets, word_count

SCHEMA = "doc_id bigint, text string, source string, size bigint, part int, blocks string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, s, 7, 1, "x") for d, t, s in rows], SCHEMA)


def plain_targets(sizes):
    """sizes: {source: words}. Shares by weight; what is above 3 times a size goes round by weight until none is above."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, full = sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        share = (total - sum(full.values())) / max(1, sum(weight[s] for s in rest))
        over = [s for s in rest if weight[s] * share > 3 * sizes[s]]
        if not over:
            return {s: full.get(s, weight[s] * share) for s in names}
        full |= {s: 3 * sizes[s] for s in over}


def sample(seed, n, sources, hot=0.4):
    rng = random.Random(seed)
    return [(k, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), "hot" if rng.random() < hot else rng.choice(sources)) for k in range(n)]


def check(spark, rows, shards=16):
    docs = table(spark, rows)
    got = mix_digest(docs, shards).collect()
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    source = {d: s for d, _, s in rows}
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and math.isclose(r["target"], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(1.0, 0.01 * t), (s, taken[s], t)
    return got


def test_targets_and_taken_words(spark):
    check(spark, sample(1, 400, ["a", "b", "c", "d", "é", "", None]))
    check(spark, sample(2, 300, [f"s{k}" for k in range(40)], 0.8), shards=5)


def test_sources_that_fill_up(spark):
    rows = [(k, "word " * 1000, "big") for k in range(20)] + [(100 + k, "a b c", s) for k, s in enumerate(["a", "c", "d", "x", "y", "z"])]
    got = {r["doc_id"]: r for r in check(spark, rows)}
    assert got[100]["taken"] == 9 and got[100]["target"] == 9.0


def test_hard_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, " \t\n", "a"), (None, "one two", "a"), (5, "x" * 100_000, None), (6, "one two", "b"), (6, "one two", "b"), (7, "w " * 400_000, "b"), (8, "\x0bone\x0ctwo\x1cthree four five", "c")]
    got = mix_digest(table(spark, rows)).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size.setdefault(r["doc_id"], []).append(r["size"])
    assert size == {1: [0], 2: [0], 3: [0], None: [2], 5: [1], 6: [2, 2], 7: [400_000], 8: [3]}
    assert mix_digest(table(spark, rows).limit(0)).count() == 0
    none = mix_digest(table(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert [(r["taken"], r["target"], r["source_size"]) for r in none] == [(0, 0.0, 0)] * 2


def test_reruns_agree_however_rows_lie(spark):
    docs = table(spark, sample(3, 300, ["a", "b", None]))
    one = {tuple(r) for r in mix_digest(docs).collect()}
    assert one == {tuple(r) for r in mix_digest(docs.repartition(7, "text")).collect()}


def test_slots_are_gapless_and_blocks_disjoint(spark):
    docs = table(spark, sample(4, 300, ["a", "b", "c"]))
    rows = mixed_shards(docs, 6).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], set()).add(r["slot"])
    assert set(by) == set(range(6)) and all(v == set(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    source = {}
    for r in rows:  # a slot holds one block, so words of one source
        assert source.setdefault((r["shard"], r["slot"]), r["source"]) == r["source"]
    times, target = {}, {}
    for r in rows:
        for w in range(r["first"], r["first"] + r["words"]):
            times[r["doc_id"], w] = times.get((r["doc_id"], w), 0) + 1
    assert max(times.values()) <= 3
    for r in mix(docs, 6).collect():
        target[r["source"]] = r["target"] / r["source_size"]
        for w in range(r["size"]):  # all words of a source come nearly equally often
            assert math.floor(target[r["source"]] - 0.02) <= times.get((r["doc_id"], w), 0) <= math.ceil(target[r["source"]] + 0.02)


def test_quotas_are_exact(spark):
    quotas = [37, 0, 1, 500, 12, 3, 3, 44, 1000, 7]
    got = split_quotas(spark.createDataFrame(list(enumerate(quotas)), "source_no bigint, quota bigint"), 7, 3).collect()
    by_source, by_shard = {}, {}
    for r in got:
        by_source[r["source_no"]] = by_source.get(r["source_no"], 0) + r["n"]
        by_shard[r["shard"]] = by_shard.get(r["shard"], 0) + r["n"]
        assert r["n"] >= 0 and r["total"] == sum(quotas) * (r["shard"] + 1) // 7 - sum(quotas) * r["shard"] // 7
    assert by_source == dict(enumerate(quotas))
    assert by_shard == {s: sum(quotas) * (s + 1) // 7 - sum(quotas) * s // 7 for s in range(7)}


def test_hypergeometric_is_the_quantile(spark):
    cases = [(5, 7, 4), (1, 1, 1), (30, 2, 10), (0, 5, 3), (8, 0, 3), (40, 60, 50), (200, 900, 333)]
    for a, b, k in cases:
        us = [j / 97 for j in range(97)]
        df = spark.createDataFrame([(float(u),) for u in us], "u double")
        got = [r[0] for r in df.select(F.expr(hypergeometric(f"{a}L", f"{b}L", f"{k}L", "u"))).collect()]
        p = {x: math.comb(a, x) * math.comb(b, k - x) / math.comb(a + b, k) for x in range(max(0, k - b), min(a, k) + 1)}
        low, high = min(p), max(p)
        mode = min(high, max(low, math.floor((k + 1) * (a + 1) / (a + b + 2))))
        for u, g in zip(us, got, strict=True):
            order = [mode] + [x for i in range(1, high - low + 1) for x in (mode + i, mode - i) if low <= x <= high]
            total, want = 0.0, None
            for x in order:
                total += p[x]
                if want is None and u < total + 1e-12:
                    want = x
            assert g == want or abs(u - sum(p[x] for x in order[: order.index(want) + 1])) < 1e-9


def test_permutation_by_columns(spark):
    for n in (1, 2, 3, 7, 16, 17, 300, 1023):
        a, b = sides(f"{n}L")
        assert sorted(r[0] for r in spark.range(n).select(F.expr(permuted_by("id", f"{n}L", a, b, "5"))).collect()) == list(range(n))


def test_targets_alone(spark):
    sizes = {"a": 1, "b": 10, "c": 1000, "d": 0, None: 5}
    got = {r["source"]: r["target"] for r in targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    want = plain_targets(sizes)
    assert all(math.isclose(got[s], want[s], rel_tol=1e-9, abs_tol=1e-9) for s in sizes)


def test_word_count(spark):
    texts = [None, "", " ", "a", " a", "a ", " a \n b\t", "a\x1cb c", "😀 x\r\n\x0b\x0cy"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(word_count(F.col("t"))).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
