import zlib

from pyspark.sql import functions as F

from loomwork.llm.sharding import permuted, shard_rows
from tests.llm.fixtures import documents, hard_texts


def test_shards_are_level_and_slots_gapless(spark):
    docs = documents(spark, hard_texts() + [(k, f"t{k}") for k in range(100, 290)])
    got = shard_rows(docs, 16).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    text = {k: t for k, t in hard_texts()}
    for r in got:
        if r["doc_id"] in text:
            raw = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 1, zlib.crc32(raw))
        assert r["law"] == "rows" and r["grown_shard"] is None


def test_same_shards_however_rows_lie(spark):
    docs = documents(spark, [(k, f"t{k}") for k in range(500)])
    a = {tuple(r) for r in shard_rows(docs).collect()}
    assert a == {tuple(r) for r in shard_rows(docs.repartition(7, "text")).collect()}
    assert shard_rows(docs.limit(0)).count() == 0


def test_permutation_is_a_bijection(spark):
    for n in (1, 2, 3, 5, 7, 17, 1000, 1023):
        got = [r[0] for r in spark.range(n).select(permuted(F.col("id"), n, 3)).collect()]
        assert sorted(got) == list(range(n))
    assert got != list(range(n))


def plain_place(row, n, seed, hashed):
    """The place of a row by the same rule in plain Python; hashed(seed, round, value) is XXH64 of the three numbers."""
    import math

    a = math.isqrt(max(n - 1, 0)) + 1
    b = max(1, -(-n // a))
    while True:
        left, right = divmod(row, b)
        for i in range(6):
            m = a if i % 2 == 0 else b
            left, right = right, (left + hashed(seed, i, right) % m) % m
        row = left * b + right
        if row < n:
            return row


def test_shards_and_slots_equal_plain_code(spark):
    import numpy as np
    import xxhash

    def hashed(seed, i, value):  # Spark hashes an int as 4 bytes, a bigint as 8, each with the hash before as seed
        h = 42
        for x, size in ((seed, 4), (i, 4), (value, 8)):
            h = xxhash.xxh64_intdigest(int(x).to_bytes(size, "little", signed=True), h)
        return int(np.uint64(h).astype(np.int64))

    for n in (1, 2, 37, 500):
        docs = documents(spark, [(3 * k, f"text {k}") for k in range(n)])
        want = {(3 * k, (p := plain_place(k, n, 20, hashed)) % 16, p // 16) for k in range(n)}
        assert {(r["doc_id"], r["shard"], r["slot"]) for r in shard_rows(docs, 16, 20).collect()} == want


def test_rows_equal_in_all_columns(spark):
    got = shard_rows(documents(spark, [(1, "same")] * 300).repartition(5), 16).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == sorted((k % 16, k // 16) for k in range(300))
