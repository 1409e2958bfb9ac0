"""Near copies: texts of which the sets of five-word shingles have a Jaccard index of 0.8 or more.

SimHash fingerprints met through pivot tables make the first groups, and what follows only looks for links between them; all links are verified
exactly, and a prefix filter finds those whose fingerprints lie farther apart (at 0.8 they differ in about ten of 64 bits)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import connected_components, deal, lean, mix, parts, pinned, shingles, short_lived, texts_buffer, words
from loomwork.llm.simhash_dedup import links as simhash_links

SHINGLE = 5
SAMPLE_ROWS = 10_000
SKETCH_BITS = 512
#: A wide sketch has at least twice as many bits as its set has shingles, up to this many.
WIDE_BITS = 1 << 14
#: A sketch by which pairs of a bucket are told has at least so many bits for each shingle, and WIDE_BITS at most.
SKETCH_SHARE = 0.6
#: Buckets before its own that a row of a bucket knows: a pair that shares one of them is left to that one.
BEFORE = 8
#: Bits of the filter that tells which texts are read again.
FILTER_BITS = 1 << 23
_HEAVY = np.uint64(1 << 63)
#: Shingles, counting each text as 64 more, that a chunk of texts holds on average: sets of about 2 MB, of about 4,096 texts at most.
CHUNK_LOAD = 1 << 18
#: Bytes of text that are hashed at once.
_PART = 1 << 20

#: Words end at ASCII white space, and ASCII case is folded, as in a SimHash fingerprint.
_SPACES = np.arange(256, dtype=np.uint8)
_SPACES[ord("A") : ord("Z") + 1] += 32
_SPACES[[9, 10, 11, 12, 13, 32]] = 0
_SPACES[0] = ord("A")


def shingle_sets(data: np.ndarray, offsets: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, n + 1 bounds): the distinct shingles of each text in order, those in ``heavy`` last. A text of fewer words is one shingle."""
    n = len(offsets) - 1
    h, row = words(data, offsets, _SPACES)
    count = np.bincount(row, minlength=n)
    s, at = shingles(h, row, SHINGLE)
    got, own = [s], [row[at]]
    for k in range(1, SHINGLE):
        few = np.flatnonzero(count[row] == k)
        s, at = shingles(h[few], row[few], k)
        got.append(s), own.append(row[few][at])
    none = np.flatnonzero(count == 0)
    got.append(np.zeros(len(none), np.uint64)), own.append(none)
    s, r = np.concatenate(got) >> np.uint64(1), np.concatenate(own)
    if len(heavy):
        near = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
        s = np.where(heavy[near] == s, s | _HEAVY, s)
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (r[1:] != r[:-1])
    s, r = s[new], r[new]
    return s, np.searchsorted(r, np.arange(n + 1))


def set_keys(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A hash of each set; texts of equal sets are one class."""
    return mix(np.add.reduceat(mix(s & ~_HEAVY), bounds[:-1]) + np.diff(bounds).astype(np.uint64)).view(np.int64)


def set_fingerprints(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """SimHash of each set: a bit is 1 if it is set in over half of the shingles' hashes."""
    out = np.zeros(len(bounds) - 1, np.uint64)
    for low in range(0, len(out), 256):
        some = bounds[low : low + 257]
        bits = np.unpackbits(mix(s[some[0] : some[-1]] & ~_HEAVY).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, some[:-1] - some[0], axis=0, dtype=np.int64)
        out[low : low + 256] = np.packbits(2 * ones > np.diff(some)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def set_sketches(s: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Parity sketch of each set, a row of SKETCH_BITS bits: a bit is 1 if an odd number of shingles falls on it. Two sketches differ in no more
    bits than the sets in shingles, as what both sets hold cancels out."""
    n = len(bounds) - 1
    bit = (mix((s & ~_HEAVY) ^ _HEAVY) % np.uint64(SKETCH_BITS)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(n), np.diff(bounds)) * SKETCH_BITS + bit, minlength=n * SKETCH_BITS) & 1
    return np.packbits(odd.astype(bool).reshape(n, SKETCH_BITS), axis=1, bitorder="little").view(np.uint64)


def wide_sketches(s: np.ndarray, bounds: np.ndarray) -> list[np.ndarray | None]:
    """As set_sketches, with bits in proportion to the set (a power of two); None where SKETCH_BITS are enough. Bits are taken off the same
    hash, so the larger of two sketches is folded to the size of the smaller."""
    n = np.diff(bounds)
    bits = np.minimum(1 << np.ceil(np.log2(np.maximum(2 * n, 1))).astype(np.int64), WIDE_BITS)
    wide = bits > SKETCH_BITS
    bits[~wide] = 0
    ends = np.cumsum(bits)
    own = s[np.repeat(wide, n)]
    at = (mix((own & ~_HEAVY) ^ _HEAVY) & np.repeat(np.maximum(bits, 1) - 1, n * wide).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(np.repeat(ends - bits, n * wide) + at, minlength=int(bits.sum())) & 1
    words = np.packbits(odd.astype(bool), bitorder="little").view(np.int64)
    return [words[(b - m) // 64 : b // 64] if m else None for b, m in zip(ends.tolist(), bits.tolist(), strict=True)]


def bucket_sketches(n: np.ndarray, narrow: np.ndarray, wide: list[np.ndarray | None]) -> list[np.ndarray]:
    """Of each set its row of ``narrow``, or its wide sketch folded to SKETCH_SHARE bits for each of its n shingles (a power of two) where that is more."""
    words = np.exp2(np.ceil(np.log2(np.maximum(SKETCH_SHARE * n, SKETCH_BITS)))).astype(np.int64) // 64
    return [row if w is None or m * 64 == SKETCH_BITS else np.bitwise_xor.reduce(w.reshape(-1, min(m, len(w)))) for row, w, m in zip(narrow, wide, words.tolist(), strict=True)]


def _differ(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ, the larger folded to the size of the smaller."""
    m = min(len(a), len(b))
    return int(np.bitwise_count(np.bitwise_xor.reduce(np.concatenate((a, b)).reshape(-1, m)).view(np.uint64)).sum())


def heavy_shingles(docs: DataFrame, most: int = 100_000) -> np.ndarray:
    """Shingles that stand in five or more of about SAMPLE_ROWS rows. Any choice leaves the search complete; this one keeps buckets short."""
    each = max(1, docs.count() // SAMPLE_ROWS)
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(each)) == 0).select("text")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_buffer(batch.column(0))
            for low, high in parts(offsets, _PART):
                s, _ = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], np.zeros(0, np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], ["s"])

    often = some.mapInArrow(lean(found), "s bigint").groupBy("s").count().where("count >= 5").orderBy(F.desc("count"), "s").limit(most)
    return np.sort(np.array([r["s"] for r in often.select("s").collect()], np.int64).view(np.uint64))


def _runs(batches: Iterator[pa.RecordBatch], column: str, most: int = 20_000) -> Iterator[pa.Table]:
    """Tables of whole groups of equal ``column`` from sorted batches."""
    held, rows = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= most:
            t = pa.Table.from_batches(held)
            g = t[column].to_numpy()
            cut = int(np.searchsorted(g, g[-1]))
            if cut:
                yield t.slice(0, cut)
            held = t.slice(cut).to_batches()
            rows = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def _room(key: np.ndarray, n: np.ndarray, i: np.ndarray, x: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Whether rows x and y of a bucket, n[x] <= n[y], leave room for an index of ``least``: the places before a common shingle and after it bound the overlap."""
    over = 1 + np.minimum(i[x], i[y]) + np.minimum(n[x] - i[x], n[y] - i[y]) - 1
    return (key[x] != key[y]) & (n[x] >= least * n[y] - 1e-9) & (over >= least / (1 + least) * (n[x] + n[y]) - 1e-9)


def _once(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)


class _Sketches:
    """Sketches of the rows of a table, lists of 64-bit words whose number is a power of two."""

    def __init__(self, column: pa.ChunkedArray):
        lists = column.combine_chunks()
        self.flat, offsets = lists.flatten().to_numpy().view(np.uint64), lists.offsets.to_numpy()
        self.first, self.words = (offsets[:-1] - offsets[0]).astype(np.int64), np.diff(offsets).astype(np.int64)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def of(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(place of each row, sketches folded to ``words``) of the rows that have as many."""
        if words not in self.folded:
            place, rows = np.cumsum(self.words >= words) - 1, np.empty((int((self.words >= words).sum()), words), np.uint64)
            for w in np.unique(self.words[self.words >= words]).tolist():
                own = np.flatnonzero(self.words == w)
                for low in range(0, len(own), 4096):
                    some = own[low : low + 4096]
                    rows[place[some]] = np.bitwise_xor.reduce(self.flat[self.first[some][:, None] + np.arange(w)].reshape(len(some), -1, words), axis=1)
            self.folded[words] = place, rows
        return self.folded[words]

    def near(self, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether rows x and y differ in no more than ``most`` bits, the larger sketch folded to the size of the smaller."""
        words, ok = np.minimum(self.words[x], self.words[y]), np.zeros(len(x), bool)
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            for low in range(0, len(own), step := max(1, (1 << 19) // w)):
                some = own[low : low + step]
                place, rows = self.of(w)
                ok[some] = np.bitwise_count(rows[place[x[some]]] ^ rows[place[y[some]]]).sum(1) <= most[some]
        return ok


def _pairs(t: pa.Table, least: float, most_held: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a, b) of a table of whole groups, sorted by g and n; ``most_held`` of them, and one step's, are held at most. A pair that also
    meets in a bucket that both rows have in ``before`` is told there: what is asked of a pair here holds in each of its buckets if its index is ``least``."""
    g, key, n, i, label, side = (t[c].to_numpy() for c in ("g", "key", "n", "i", "label", "side"))
    begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))[: len(g)])
    size = np.diff(np.concatenate((begin, [len(g)])))
    end = np.repeat(begin + size, size)
    sketch = _Sketches(t["sketch"])
    lists = t["before"].combine_chunks()
    known = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    real = np.arange(BEFORE) < known[:, None]
    before = np.zeros((len(g), BEFORE), np.int64)
    before[real] = lists.flatten().to_numpy()
    most = (1 - least) / (1 + least)
    mixed = np.repeat(np.minimum.reduceat(label, begin) != np.maximum.reduceat(label, begin), size) if len(g) else np.zeros(0, bool)
    got, held, at, shift = [], 0, np.flatnonzero(mixed), 1

    def told() -> pa.RecordBatch:
        both = _once(*(key[np.concatenate([p[k] for p in got])] if got else key[:0] for k in (0, 1)))
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def elsewhere(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        met = np.zeros(len(x), bool)
        for k in range(BEFORE):
            met |= ((before[x, k][:, None] == before[y]) & real[y]).any(1) & real[x, k]
        return met

    while True:
        at = at[at + shift < end[at]]
        at = at[n[at] >= least * n[at + shift] - 1e-9]
        if not len(at):
            break
        y = at + shift
        ok = (label[at] != label[y]) & ((side[at] == 0) | (side[at] != side[y]))
        x, y = at[ok], y[ok]
        ok = _room(key, n, i, x, y, least)
        x, y = x[ok], y[ok]
        for low in range(0, len(x), 1 << 16):
            p, q = x[low : low + (1 << 16)], y[low : low + (1 << 16)]
            ok = ~elsewhere(p, q)
            p, q = p[ok], q[ok]
            ok = sketch.near(p, q, most * (n[p] + n[q]) + 1e-9)
            got.append((p[ok], q[ok]))
            held += int(ok.sum())
            if held > most_held:
                yield told()
                got, held = [], 0
        shift += 1
    yield told()


def _met(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """From rows (s, v, key, n, i) sorted by s, n and key: pairs of each row with the next and the first of its group s (g null), and the rows, each
    once, of groups of more than one (a null), g being v or s. Only the first and last row of the open group are held, whatever its size."""
    names = ["s", "v", "key", "n", "i"]
    held = None  # one row: nothing of its group was told yet; two: the first and the last
    for batch in batches:
        if not batch.num_rows:
            continue
        carried = 0 if held is None else held.num_rows
        t = pa.Table.from_batches([batch.select(names)])
        t = (t if held is None else pa.concat_tables([held.cast(t.schema), t])).combine_chunks()
        s, key = t["s"].to_numpy(), t["key"].to_numpy()
        fresh = np.concatenate(([True], (s[1:] != s[:-1]) | (key[1:] != key[:-1])))
        carried = int(fresh[:carried].sum())
        t = t.filter(pa.array(fresh)).combine_chunks()
        s, key, n, i = (t[c].to_numpy() for c in ("s", "key", "n", "i"))
        v = t["v"].combine_chunks() if isinstance(t["v"], pa.ChunkedArray) else t["v"]
        new = np.concatenate(([True], s[1:] != s[:-1]))
        begin = np.flatnonzero(new)
        start = np.repeat(begin, np.diff(np.concatenate((begin, [len(s)]))))
        at = np.flatnonzero(~new)
        at = at[at >= carried]
        got = [(x[ok], at[ok]) for x in (at - 1, start[at]) for ok in [_room(key, n, i, x, at, least)]]
        both = _once(*(key[np.concatenate([p[k] for p in got])] for k in (0, 1)))
        same = np.concatenate((~new, [False]))
        # A part of a cut group (v) may hold one row: it is told, too.
        tell = same[:-1] | same[1:] | v.is_valid().to_numpy(zero_copy_only=False)
        if carried == 2 or (carried == 1 and v[0].is_valid):
            tell[:carried] = False
        low, none = int(start[-1]), lambda m, kind: pa.nulls(m, kind)
        held = t.take(pa.array(sorted({low, len(s) - 1})))
        rows = np.flatnonzero(tell)
        m, k = len(both), len(rows)
        g = v.take(pa.array(rows)).fill_null(pa.scalar(0, pa.int64())).to_numpy(zero_copy_only=False)
        g = np.where(v.is_valid().to_numpy(zero_copy_only=False)[rows], g, s[rows])
        fields = ["a", "b", "g", "key", "n", "i"]
        if m:
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.int32()), none(m, pa.int32())], fields)
        if k:
            yield pa.RecordBatch.from_arrays([none(k, pa.int64()), none(k, pa.int64()), pa.array(g, pa.int64()), pa.array(key[rows], pa.int64()), pa.array(n[rows], pa.int32()), pa.array(i[rows], pa.int32())], fields)


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(t, z): the texts, compressed, by their hash; a text that a task has met before is left out, and so are most of those whose hash is not
    among the t of ``wanted``: a bitmap of fixed size tells them, so that they are neither sent to Python nor shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            t, some = batch.column(1).to_pylist(), []
            for i, x in enumerate(t):
                if x not in met:
                    met.add(x)
                    some.append(i)
            if len(met) > 1_000_000:
                met.clear()
            for low in range(0, len(some), 500):
                at = some[low : low + 500]
                texts = batch.column(0).take(pa.array(at)).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array([t[i] for i in at], pa.int64()), pa.array([pack((x or "").encode()) for x in texts], pa.binary())], ["t", "z"])

    place = F.pmod(F.xxhash64("t", F.lit(9)), F.lit(FILTER_BITS))
    bit = F.expr("shiftleft(1L, cast(p & 63 as int))")
    marks = wanted.select(place.alias("p")).groupBy(F.expr("p >> 6").alias("w")).agg(F.bit_or(bit).alias("marks"))
    known = docs.select("text", F.xxhash64("text").alias("t")).withColumn("p", place).withColumn("w", F.expr("p >> 6"))
    known = known.join(F.broadcast(marks), "w").where(F.col("marks").bitwiseAND(bit) != 0)  # at most FILTER_BITS / 64 rows
    return known.select("text", "t").mapInArrow(lean(each), "t bigint, z binary")


def _by_sketch(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b), each once, whose parity sketches differ in no more bits than sets with an index of ``least`` may differ in shingles."""
    side = lambda c: sketches.select(F.col("key").alias(c), F.col("n").alias(f"n_{c}"), F.coalesce("wide", "sketch").alias(f"sketch_{c}"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = (batch["n_a"].to_numpy() + batch["n_b"].to_numpy()).tolist()
            at = [[batch[c].values.to_numpy(), batch[c].offsets.to_numpy().tolist()] for c in ("sketch_a", "sketch_b")]
            most = (1 - least) / (1 + least)
            ok = [_differ(*(v[o[i] : o[i + 1]] for v, o in at)) <= most * m + 1e-9 for i, m in enumerate(n)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    sized = pairs.distinct().join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= least * F.greatest("n_a", "n_b") - 1e-9)
    return sized.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(lean(near), "a bigint, b bigint")


def _verified(pairs: DataFrame, rows: DataFrame, docs: DataFrame, least: float, load: int = CHUNK_LOAD) -> DataFrame:
    """The pairs (a, b) whose sets have an index of ``least``. Texts are cut into chunks of about ``load`` shingles, those with the same smallest
    partner into one where they fit, so that a text is sent to few places; for each pair of chunks a task holds the sets of the one, and those of the
    other, with the keys they are compared with, stream by one at a time."""
    pairs = pinned(pairs.distinct())
    turn = pairs.select(F.col("a").alias("key"), F.col("b").alias("m")).union(pairs.select("b", "a"))
    nodes = turn.groupBy("key").agg(F.min("m").alias("m")).select("key", F.least("key", "m").alias("m"))
    texts = pinned(rows.select("key", "t", "n").join(nodes, "key").groupBy("key").agg(F.min("t").alias("t"), F.min("n").alias("n"), F.min("m").alias("m")))
    weight = F.sum(F.col("n").cast("bigint") + 64)
    chunks = max(1, math.ceil((texts.agg(weight).first()[0] or 0) / load))
    large = texts.groupBy("m").agg(weight.alias("w")).where(F.col("w") > load).select("m", F.ceil(F.col("w") / load).alias("cut"))
    part = F.when(F.col("cut").isNull(), F.pmod(F.xxhash64("m", F.lit(3)), F.lit(chunks))).otherwise(F.xxhash64("m", F.pmod(F.xxhash64("key", F.lit(3)), "cut")))
    parts_ = texts.join(large, "m", "left").select("key", part.alias("part"))
    side = lambda c: parts_.select(F.col("key").alias(c), F.col("part").alias(f"part_{c}"))
    turned = F.col("part_a") > F.col("part_b")
    ours, theirs = F.when(turned, F.col("b")).otherwise(F.col("a")), F.when(turned, F.col("a")).otherwise(F.col("b"))
    tile = F.xxhash64(F.least("part_a", "part_b"), F.greatest("part_a", "part_b"))
    tiled = pinned(pairs.join(side("a"), "a").join(side("b"), "b").select(ours.alias("held"), theirs.alias("key"), tile.alias("tile")))
    met = tiled.groupBy("tile", "key").agg(F.collect_list("held").alias("with"))  # keys of one chunk
    wanted = met.unionByName(tiled.select("tile", F.col("held").alias("key")).distinct().withColumn("with", F.lit(None).cast("array<bigint>")))
    some = packed_texts(docs, texts).dropDuplicates(["t"]).join(wanted.join(texts.select("key", "t"), "key"), "t")
    some = some.select("tile", "key", "with", "z").repartition("tile").sortWithinPartitions("tile", F.col("with").isNotNull(), "key")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, unpack = None, {}, zstandard.ZstdDecompressor().decompress
        for batch in batches:
            tiles, keys, others = (batch.column(k) for k in range(3))
            out_a, out_b = [], []
            for low in range(0, batch.num_rows, 100):
                texts = [unpack(z.as_py()) for z in batch.column(3)[low : low + 100]]
                data, offsets = texts_buffer(pa.array(texts, pa.large_binary()).cast(pa.large_string()))
                del texts
                for lo, hi in parts(offsets, _PART):
                    s, bounds = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], np.zeros(0, np.uint64))
                    for k in range(lo, hi):
                        at, own = low + k, s[bounds[k - lo] : bounds[k - lo + 1]]
                        if tiles[at].as_py() != tile:
                            tile, held = tiles[at].as_py(), {}
                        key, some = keys[at].as_py(), others[at].as_py()
                        if some is None:
                            held[key] = own.copy()
                            continue
                        for x in some:
                            y = held[x]
                            if min(len(own), len(y)) < least * max(len(own), len(y)) - 1e-9:
                                continue
                            both = np.concatenate((own, y))
                            both.sort(kind="stable")  # two sorted runs are merged
                            common = int(np.count_nonzero(both[1:] == both[:-1]))
                            if common >= least * (len(both) - common) - 1e-9:
                                out_a.append(min(key, x)), out_b.append(max(key, x))
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return some.mapInArrow(lean(check), "a bigint, b bigint")


def _apart(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """The pairs (a, b) of which the groups (key, label) differ; a key without a label is a group of its own."""
    side = lambda c: label.select(F.col("key").alias(c), F.col("label").alias(f"label_{c}"))
    named = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return named.where(F.coalesce("label_a", "a") != F.coalesce("label_b", "b")).select("a", "b")


def copy_classes(docs: DataFrame, heavy: np.ndarray, least: float) -> DataFrame:
    """(doc_id, t, key, n, fp, sketch, wide, prefix) of each row: fp is the fingerprint of its set, sketch its parity sketch, wide a larger one where the set needs it, prefix has the first shingles of its set, of which two sets with an index of ``least`` share one;
    the last three are null where the same class has been met in the task."""
    held = docs.sparkSession.sparkContext.broadcast(heavy)  # bounded by heavy_shingles

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for batch in batches:
            data, offsets = texts_buffer(batch.column(1))
            for low, high in parts(offsets, _PART):
                s, bounds = shingle_sets(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], held.value)
                keys, n, first, wide = set_keys(s, bounds), np.diff(bounds), [], wide_sketches(s, bounds)
                sketch = bucket_sketches(n, set_sketches(s, bounds).view(np.int64), wide)
                for row, (k, m, at) in enumerate(zip(keys.tolist(), n.tolist(), bounds.tolist(), strict=False)):
                    if k in met:
                        sketch[row] = wide[row] = None
                    first.append(None if k in met else s[at : at + m - math.ceil(least * m - 1e-9) + 1].view(np.int64))
                    met.add(k)
                if len(met) > 1_000_000:
                    met.clear()
                ids = batch.column(0).slice(low, high - low), batch.column(2).slice(low, high - low)
                fp = set_fingerprints(s, bounds).view(np.int64)
                yield pa.RecordBatch.from_arrays([*ids, pa.array(keys), pa.array(n.astype(np.int32)), pa.array(fp), *(pa.array(x, pa.list_(pa.int64())) for x in (sketch, wide, first))], ["doc_id", "t", "key", "n", "fp", "sketch", "wide", "prefix"])

    return docs.select(F.col("doc_id").cast("bigint"), "text", F.xxhash64("text").alias("t")).mapInArrow(lean(each), "doc_id bigint, t bigint, key bigint, n int, fp bigint, sketch array<bigint>, wide array<bigint>, prefix array<bigint>")


@short_lived
def near_copy_groups(docs: DataFrame, least: float = 0.8, most: int = 4, tile: int = 8192) -> DataFrame:
    """(doc_id, t, key, group) for each row, t the hash of its text: rows linked by a Jaccard index of ``least`` or more, directly or over others, have the same group.

    SimHash goes first: pairs whose fingerprints lie within ``most`` bits, found through pivot tables, make groups. Then neighbours in each bucket of
    a common shingle (buckets over ``tile`` rows are cut by a hash, each in its own way) are met where their groups differ, so that large groups of like
    texts are one group before all other pairs of different groups are made. In all three rounds pairs whose parity sketches differ in more bits than
    sets of that index may differ in shingles are left out: no text need be read for them. Null and empty texts are alike.
    """
    heavy = heavy_shingles(docs)
    rows = pinned(copy_classes(docs, heavy, least))
    placed = rows.where("prefix is not null").select("key", "n", F.posexplode("prefix").alias("i", "g"))

    # Only marked shingles (below zero) can be in a large share of rows; there are few of them (heavy_shingles), so counting them needs no large shuffle.
    hot = pinned(placed.where("g < 0").groupBy("g").count().where(F.col("count") > tile).select("g", F.ceil(F.col("count") / tile).alias("cut")))
    cut = placed.join(F.broadcast(hot), "g", "left").select(
        F.when(F.col("cut").isNull(), F.col("g")).otherwise(F.xxhash64("g", F.pmod(F.xxhash64("key", "g"), "cut"))).alias("s"),
        F.when(F.col("cut").isNotNull(), F.col("g")).alias("v"), "key", "n", "i",
    )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _met(batches, least)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "g"):
            yield from _pairs(t, least)

    met = pinned(cut.repartition("s").sortWithinPartitions("s", "n", "key").mapInArrow(lean(first), "a bigint, b bigint, g bigint, key bigint, n int, i int"))
    classes = pinned(rows.where("prefix is not null").groupBy("fp").agg(F.min("key").alias("id"), F.max("key").alias("other")))
    alike = simhash_links(classes.select("id", "fp"), most, tile=tile, direct=True).unionAll(classes.where("id <> other").select("id", "other"))
    sketches = rows.where("sketch is not null").groupBy("key").agg(*[F.first(c).alias(c) for c in ("n", "sketch", "wide")])
    links, label = None, None
    for pairs in (alike, met.where("a is not null").select("a", "b").distinct()):
        if label is not None:
            pairs = _apart(pairs, label)
        found_ = _verified(_by_sketch(pairs, sketches, least), rows, docs, least)
        links = pinned(found_ if links is None else links.union(found_))
        label = connected_components(links).withColumnsRenamed({"node": "key", "component": "label"})
    named = met.where("g is not null").select("g", "key", "n", "i").join(label, "key", "left").withColumn("label", F.coalesce("label", "key"))
    mixed = named.groupBy(F.col("g").alias("v")).agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("size")).where("low <> high")
    mixed = mixed.join(F.broadcast(hot.withColumnRenamed("g", "v")), "v", "left").where("size > 3 or cut is not null").select("v")  # up to three rows of a bucket that isn't cut have all met
    last = Window.partitionBy("key").orderBy("i").rowsBetween(-BEFORE, -1)
    open_ = pinned(named.withColumnRenamed("g", "v").join(mixed, "v", "left_semi").withColumn("before", F.collect_list("v").over(last)))
    dealt = deal(open_, "v", "key", tile).join(sketches.select("key", "sketch"), "key")
    rest = dealt.select("g", "key", "n", "i", "label", "side", "before", "sketch").repartition("g").sortWithinPartitions("g", "n", "key")
    more = _verified(_by_sketch(rest.mapInArrow(lean(found), "a bigint, b bigint"), sketches, least), rows, docs, least)
    comp = connected_components(links.union(more))
    grouped = rows.select("doc_id", "t", "key").join(comp, F.col("key") == F.col("node"), "left")
    return grouped.select("doc_id", "t", "key", F.coalesce("component", "key").alias("group"))


@short_lived
def drop_near_copies(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """One row of each group stays: that of the smallest doc_id (of equal ids, the first by the other columns), or one without
    a doc_id where no row of the group has one."""
    groups = near_copy_groups(docs, least)
    first = pinned(groups.groupBy("group").agg(F.min("doc_id").alias("doc_id"), F.min("t").alias("t")))
    known = groups.where("doc_id is not null").select("doc_id").distinct()
    gone = pinned(known.join(first.where("doc_id is not null").select("doc_id"), "doc_id", "left_anti"))
    named = docs.where("doc_id is not null").join(gone, "doc_id", "left_anti")
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")

    n = "_" * (1 + max(map(len, docs.columns)))  # no column has that name

    def one(some: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy(*[F.col(f"`{c}`") for c in docs.columns])
        return some.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).select(docs.columns)

    if not repeated.isEmpty():
        named = named.join(repeated, "doc_id", "left_anti").unionByName(one(named.join(repeated, "doc_id", "left_semi"), "doc_id"))
    alone = first.where("doc_id is null").select(F.col("t").alias(f"{n}t"))
    if alone.isEmpty():
        return named.select(docs.columns)
    unnamed = docs.where("doc_id is null").withColumn(f"{n}t", F.xxhash64("text")).join(alone, f"{n}t", "left_semi")
    return named.select(docs.columns).unionByName(one(unnamed, f"{n}t"))
