import random

import numpy as np

from loomwork.llm import near_copies
from loomwork.llm.near_copies import drop_near_copies, near_copy_groups, set_sketches
from loomwork.llm.simhash_dedup import drop_near_duplicates
from tests.llm.fixtures import documents, hard_texts
from tests.llm.test_simhash import plain_components


def shingles(text):
    words = bytes(text or "", "utf-8").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def edited(rng):
    base = [[f"{rng.choice('alpha beta gamma delta'.split())}{rng.randint(0, 60)}" for _ in range(150)] for _ in range(6)]
    texts = []
    for k in range(90):
        w = list(base[k % 6])
        for _ in range(k // 18):
            w[rng.randrange(len(w))] = f"new{k}"
        texts.append((100 + k, " ".join(w)))
    return texts + [(300 + k, " ".join(f"own{k}x{i}" for i in range(30))) for k in range(20)] + [(None, "never seen before"), (None, "never seen before")]


def test_sketches_never_differ_in_more_than_the_sets():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, size)) for size in (0, 1, 1, 5, 40, 44, 300, 2500) for _ in range(4)]
    sets += [np.unique(np.concatenate((x[3:], pool[:2]))) for x in sets if len(x) > 30]
    sets = [np.unique(np.where(rng.random(len(x)) < 0.3, x | np.uint64(1 << 63), x)) for x in sets]  # the mark of common shingles doesn't matter
    got = set_sketches(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))))
    plain = [{int(v) % (1 << 63) for v in x} for x in sets]
    for i, x in enumerate(plain):
        for j, y in enumerate(plain):
            assert np.bitwise_count(got[i] ^ got[j]).sum() <= len(x ^ y)
    assert not got[0].any() and got[4].any()
    assert set_sketches(np.zeros(0, np.uint64), np.zeros(1, np.int64)).shape[0] == 0


def test_groups_equal_all_pairs(spark):
    texts = hard_texts() + edited(random.Random(4))
    sets = [shingles(t) for _, t in texts]
    near = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    comp = plain_components(range(len(sets)), near)
    want = {}
    for i, (k, _) in enumerate(texts):
        want.setdefault(comp[i], []).append(k)
    for tile in (8, 8192):
        got = {}
        for r in near_copy_groups(documents(spark, texts), tile=tile).collect():
            got.setdefault(r["group"], []).append(r["doc_id"])
        assert sorted(sorted(map(str, x)) for x in got.values()) == sorted(sorted(map(str, x)) for x in want.values())
    docs = documents(spark, texts)
    kept = drop_near_copies(docs)
    first = [min((k for k in x if k is not None), default=None) for x in want.values()]
    assert kept.schema == docs.schema and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, first))
    assert drop_near_duplicates(docs).count() > len(first)  # four bits of the fingerprint leave near copies
    assert drop_near_copies(docs.limit(0)).count() == 0


def test_chunks_of_any_load_verify_the_same_pairs(spark):
    texts = edited(random.Random(5)) + [(900, "long " * 30_000 + "end"), (901, "long " * 30_000 + "end of it"), (902, " ".join(f"w{i}" for i in range(20_000))), (903, " ".join(f"w{i}" for i in range(20_100)))]
    docs = documents(spark, texts)
    sets = {k: shingles(t) for k, t in texts if k is not None}
    rows = near_copies.copy_classes(docs, np.zeros(0, np.uint64), 0.8).where("doc_id is not null")
    first = {}
    for r in rows.select("doc_id", "key").collect():
        first.setdefault(r["key"], r["doc_id"])
    every = spark.createDataFrame([(x, y) for x in first for y in first if x < y], "a bigint, b bigint")
    want = {(x, y) for x in first for y in first if x < y for p, q in [(sets[first[x]], sets[first[y]])] if len(p & q) >= 0.8 * len(p | q)}
    assert len(want) > 20
    for load in (300, 1 << 18):
        got = [(r["a"], r["b"]) for r in near_copies._verified(every, rows, docs, 0.8, load).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_one_bucket_streams_in_any_batches():
    import pyarrow as pa

    rows = sorted([(5, None, 1, 10, 0)] + [(7, None, k, 10, 0) for k in (3, 4, 4, 5, 6, 8)] + [(9, 2, 1, 10, 0), (11, None, 1, 10, 0), (11, None, 1, 10, 0)] + [(12, 3, k, 12, 1) for k in (1, 2, 3)])
    want_pairs = {(3, 4), (4, 5), (5, 6), (6, 8), (3, 5), (3, 6), (3, 8), (1, 2), (2, 3), (1, 3)}
    want_rows = [(2, 1), (3, 1), (3, 2), (3, 3)] + [(7, k) for k in (3, 4, 5, 6, 8)]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    for step in (1, 2, 3, 5, 100):
        some = [rows[k : k + step] for k in range(0, len(rows), step)]
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*x, strict=True), kinds, strict=True)], ["s", "v", "key", "n", "i"]) for x in some]
        told = [r for b in near_copies._met(iter(batches), 0.8) for r in b.to_pylist()]
        assert {(r["a"], r["b"]) for r in told if r["a"] is not None} == want_pairs
        assert sorted((r["g"], r["key"]) for r in told if r["a"] is None) == want_rows


def test_stage_drops_edited_copies(spark):
    import corpus_pipeline

    words = [f"word{i}" for i in range(120)]
    other = [w if i not in (20, 60) else "changed" for i, w in enumerate(words)]
    docs = documents(spark, [(1, " ".join(words)), (2, " ".join(other)), (3, "a text of its own stands here")])
    assert {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["simhash_dedup"](spark, docs, "").collect()} == {1, 3}


def test_the_setting_of_the_session_is_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name)
    drop_near_copies(documents(spark, [(1, "one two three"), (2, "one two three")])).count()
    assert spark.conf.get(name) == was


def test_long_texts_of_a_lower_index_are_left_out_unread(spark):
    rng = np.random.default_rng(3)
    pool = rng.integers(1, 1 << 63, 40_000, dtype=np.uint64)
    sets = [np.sort(pool[k : k + 6000]) for k in (0, 200, 1500, 3000, 20_000)] + [np.sort(pool[100 : 100 + 5000]), np.sort(pool[:120])]
    s, bounds = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    narrow, wide = near_copies.set_sketches(s, bounds).view(np.int64), near_copies.wide_sketches(s, bounds)
    assert wide[-1] is None and all(len(x) * 64 >= 2 * 5000 for x in wide[:-1])
    rows = [(k, len(x), narrow[k].tolist(), None if wide[k] is None else wide[k].tolist()) for k, x in enumerate(sets)]
    sketches = spark.createDataFrame(rows, "key bigint, n int, sketch array<bigint>, wide array<bigint>")
    every = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets))]
    index = {(i, j): len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) for i, j in every}
    got = {(r["a"], r["b"]) for r in near_copies._by_sketch(spark.createDataFrame(every, "a bigint, b bigint"), sketches, 0.8).collect()}
    assert {p for p in every if index[p] >= 0.8} <= got and not any(index[p] < 0.7 for p in got)
    assert all(near_copies._differ(wide[i], narrow[j].copy()) == np.bitwise_count((narrow[i] ^ narrow[j]).view(np.uint64)).sum() for i, j in every if j < 6)


def test_what_simhash_links_is_not_compared_again(spark, monkeypatch):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(800)]
    texts = [(k, " ".join(base[:400] + [f"x{k}"] + base[400:])) for k in range(12)] + [(50 + k, " ".join(base[: 640 + 5 * k])) for k in range(4)]
    asked, real = [], near_copies._verified

    def seen(pairs, *args):
        found = real(pairs, *args)
        asked.append(([tuple(r) for r in pairs.collect()], [tuple(r) for r in found.collect()]))
        return found

    monkeypatch.setattr(near_copies, "_verified", seen)
    groups = {r["group"] for r in near_copy_groups(documents(spark, texts)).collect()}
    linked = asked[0][1]
    comp = plain_components(sorted({x for p in linked for x in p}), linked)
    assert len(groups) == 1 and len(linked) >= 11 and len(asked) == 3
    assert not any(comp.get(a, a) == comp.get(b, b) for pairs, _ in asked[1:] for a, b in pairs)


def test_estimated_sizes_dont_grow_with_rounds(spark):
    from loomwork.llm.common import connected_components

    chain = spark.range(40).selectExpr("id as a", "id + 1 as b")
    once = connected_components(chain)
    twice = connected_components(once.selectExpr("node as a", "component as b").where("a <> b"))
    assert {r["component"] for r in twice.collect()} == {0} and twice.count() == 41
    assert twice._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 64


def test_a_pair_is_told_once_however_many_buckets_it_shares(spark, monkeypatch):
    rng = random.Random(8)
    base, texts = [f"w{rng.randint(0, 9999)}" for _ in range(300)], []
    for k in range(40):
        own = list(base)
        for j in range(4):
            own[rng.randrange(300)] = f"x{k}y{j}"
        texts.append((k, " ".join(own)))
    asked, real = [], near_copies._by_sketch

    def seen(pairs, *args):
        asked.append([tuple(r) for r in pairs.collect()])
        return real(pairs, *args)

    monkeypatch.setattr(near_copies, "_by_sketch", seen)
    got = {r["doc_id"]: r["group"] for r in near_copy_groups(documents(spark, texts)).collect()}
    assert len(asked[2]) > 50 and len(asked[2]) == len(set(asked[2]))
    sets = {k: {tuple(w[p : p + 5]) for p in range(296)} for k, t in texts for w in [t.split()]}
    linked = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    comp = plain_components(sorted(sets), linked)
    assert all((got[a] == got[b]) == (comp[a] == comp[b]) for a in sets for b in sets)


def test_long_texts_that_share_a_line_are_no_pair_of_its_bucket():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    pool = rng.integers(1, 1 << 63, 40_000, dtype=np.uint64)
    sets = [np.sort(pool[k : k + n]) for k, n in ((0, 3000), (1500, 3000), (10_000, 3000), (10_100, 3000), (20_000, 1500), (10_050, 2700))]
    s, bounds = np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets])))
    n = np.diff(bounds)
    some = near_copies.bucket_sketches(n, near_copies.set_sketches(s, bounds).view(np.int64), near_copies.wide_sketches(s, bounds))
    order = np.argsort(n, kind="stable")
    rows = [{"g": 7, "key": int(k), "n": int(n[k]), "i": 3, "label": int(k), "side": 0, "before": [5] if k in (2, 5) else [], "sketch": some[k].tolist()} for k in order]
    kinds = pa.schema([("g", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("i", pa.int32()), ("label", pa.int64()), ("side", pa.int8()), ("before", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])
    told = [(r["a"], r["b"]) for b in near_copies._pairs(pa.Table.from_pylist(rows, kinds), 0.8) for r in b.to_pylist()]
    assert sorted(told) == [(2, 3), (3, 5)]  # 2 and 5 have met in bucket 5
