import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from loomwork.llm.common import connected_components
from loomwork.llm.simhash_dedup import drop_near_duplicates, index_keys, index_pivots, index_plan, links, pivot_table, simhash_groups
from tests.llm.fixtures import documents, hard_texts


def plain_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    runs = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, near):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in near:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {i: find(i) for i in ids}


def test_groups_equal_brute_force(spark):
    random.seed(5)
    base = " ".join(random.choice("alpha beta gamma delta eps zeta eta theta".split()) + str(k) for k in range(300))
    texts = hard_texts() + [(50 + k, base.replace(f"a{7 * k} ", "z ")) for k in range(40)] + [(200 + k, f"other {k} text of its own") for k in range(60)]
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash_groups(documents(spark, texts)).collect()}
    fps = [(k, plain_fingerprint(t)) for k, t in texts]
    named = [(k, f) for k, f in fps if k is not None]
    near = [(a, b) for a, x in named for b, y in named if a < b and (x ^ y).bit_count() <= 4]
    comp = plain_components({k for k, _ in named}, near)
    assert got == {(k, f"{f:016x}", comp.get(k)) for k, f in fps}
    assert simhash_groups(documents(spark, texts).limit(0)).count() == 0


def test_tiles_and_long_runs_lose_no_link(spark):
    rng = np.random.default_rng(3)
    core = rng.integers(0, 1 << 62, dtype=np.uint64)
    fps = {int(core)}
    while len(fps) < 900:
        x = int(rng.choice(list(fps)[-50:])) if len(fps) > 60 else int(core)
        for b in rng.integers(0, 64, rng.integers(1, 4)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps) + [int(x) for x in rng.integers(0, 1 << 63, 300, dtype=np.uint64)]
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4]
    want = plain_components(range(len(fps)), near)
    rows = [(i, f - (1 << 64) if f >= 1 << 63 else f) for i, f in enumerate(fps)]
    for tile in (64, 8192):
        made = links(spark.createDataFrame(rows, "id bigint, fp bigint"), tile=tile)
        got = {r["node"]: r["component"] for r in connected_components(made).collect()}
        assert {i: got.get(i, i) for i in range(len(fps))} == want


def test_index_is_complete_and_comes_from_pivot_distances(spark):
    rng = np.random.default_rng(1)
    refs = index_pivots()
    for rows in (10, 10_000, 10**7, 10**10):
        groups, choices = index_plan(rows, 4)
        pairs = []
        for _ in range(150):
            x = int(rng.integers(0, 1 << 63, dtype=np.uint64)) * 2
            y = x
            for b in rng.choice(64, rng.integers(0, 5), replace=False):
                y ^= 1 << int(b)
            d = pivot_table(np.array([x, y], np.uint64), refs).astype(int)
            off = set(np.flatnonzero((d[1:, 0] - d[0, 0]) != (d[1:, 1] - d[0, 1])).tolist())
            assert len(off) <= 4 and any(not off & {j for g in pick for j in groups[g]} for pick in choices)
            pairs.append(tuple(v - (1 << 64) if v >= 1 << 63 else v for v in (x, y)))
        df = spark.createDataFrame(pairs, "x bigint, y bigint")
        assert df.where(F.arrays_overlap(index_keys("x", rows, 4), index_keys("y", rows, 4))).count() == 150
    far = spark.range(2000).select(F.xxhash64("id").alias("x"), F.xxhash64("id", F.lit(1)).alias("y"))
    assert far.where(F.arrays_overlap(index_keys("x", 10**7, 4), index_keys("y", 10**7, 4))).count() < 20


def test_direct_links_lie_near(spark):
    rng = np.random.default_rng(4)
    core = int(rng.integers(0, 1 << 62))
    fps = sorted({core ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (400, 2))})
    rows = [(i, f - (1 << 64) if f >= 1 << 63 else f) for i, f in enumerate(fps)]
    got = links(spark.createDataFrame(rows, "id bigint, fp bigint"), direct=True).collect()
    assert all((fps[r["a"]] ^ fps[r["b"]]).bit_count() <= 4 for r in got) and len(got) < 40 * len(fps)


def test_one_of_each_group_stays(spark):
    docs = documents(spark, hard_texts() + [(None, "no id here"), (None, "no id here")]).withColumn("_n", F.lit(3))
    got = drop_near_duplicates(docs)
    assert got.columns == docs.columns
    named = [(k, plain_fingerprint(t)) for k, t in hard_texts() if k is not None]
    near = [(x, y) for x, f in named for y, g in named if x < y and (f ^ g).bit_count() <= 4]
    comp = plain_components({k for k, _ in named}, near)
    want = [None, *(k for k in comp if comp[k] == k)]  # the text without an id is unlike the others
    assert sorted(str(r["doc_id"]) for r in got.select("doc_id").collect()) == sorted(map(str, want))


def test_components_of_a_path_and_a_star(spark):
    path = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1001, 1500).select(F.col("id").alias("a"), F.lit(1000).cast("bigint").alias("b"))
    got = {r["node"]: r["component"] for r in connected_components(path.union(star)).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1500)}
    assert connected_components(path.where("a < 0")).count() == 0
