"""SimHash near-duplicates, found exactly with pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import connected_components, deal, local_roots, parts, pinned, texts_buffer

BITS = 64


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of one UTF-8 text; bytes.lower and bytes.split work on ASCII letters and white space only."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    else:
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.concatenate(([0], np.cumsum(size)))
        first, last = start[: len(words) - shingle + 1].tolist(), (start[shingle:] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(0, dtype=np.int32)
    over = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(over.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a bigint of the same bits."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_buffer(batch.column(1))
            for low, high in parts(offsets):
                fps = [fingerprint(data[offsets[i] : offsets[i + 1]].tobytes(), shingle) for i in range(low, high)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"]
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, "doc_id bigint, fp bigint")


# --- links ---------------------------------------------------------------------------------


def pivots(count: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def index_pivots(seed: int = 8) -> np.ndarray:
    """A random reference fingerprint, and 32 more that differ from it in two bits each, no bit twice.

    The distance to one of the 32 less that to the first is -2, 0 or 2. A bit in which two fingerprints differ changes it for one
    reference alone, so fingerprints within d bits agree in all but d of these 32 coordinates.
    """
    first = pivots(1, seed)
    return np.concatenate((first, first ^ (np.uint64(3) << np.arange(0, BITS, 2, dtype=np.uint64))))


def pivot_table(fps: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Hamming distance of each fingerprint to each reference fingerprint, one row per reference."""
    return np.stack([np.bitwise_count(fps ^ r) for r in refs]).astype(np.int8)


def near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, most: int) -> np.ndarray:
    """Which pairs (i, j) differ in at most ``most`` bits: a pair survives while no coordinate differs by more
    (the triangle inequality makes that safe), and the survivors are compared bit by bit."""
    live = np.arange(len(i))
    for row in table:
        live = live[np.abs(row[i[live]] - row[j[live]]) <= most]
    return live[np.bitwise_count(fps[i[live]] ^ fps[j[live]]) <= most]


def index_plan(rows: int, most: int) -> tuple[list[range], list[tuple[int, ...]]]:
    """(groups of coordinates, choices of groups): fingerprints within ``most`` bits agree in all coordinates of some choice.

    With most + c groups, coordinates differ in at most ``most`` of them, so some c agree. c rises with the number of fingerprints
    so that an evenly filled bucket holds 16 or fewer (a coordinate holds 1.5 bits); every choice is complete.
    """
    coordinates = BITS // 2
    c = next((c for c in range(1, 4) if 16 * 2 ** (1.5 * coordinates * c / (most + c)) >= rows), 4)
    edges = np.linspace(0, coordinates, most + c + 1).astype(int)
    return [range(edges[k], edges[k + 1]) for k in range(most + c)], list(combinations(range(most + c), c))


def index_keys(fp: str, rows: int, most: int) -> Column:
    """array<bigint>: the buckets of a fingerprint, one for each choice of coordinate groups."""
    refs = [int(r) for r in index_pivots().view(np.int64)]
    distance = lambda r: F.bit_count(F.col(fp).bitwiseXOR(F.lit(r)))
    groups, choices = index_plan(rows, most)
    own = [F.xxhash64(*[distance(refs[j + 1]) - distance(refs[0]) for j in g]) for g in groups]
    return F.transform(F.array(F.array(*own)), lambda h: F.array(*[F.xxhash64(F.lit(k), *[F.get(h, F.lit(g)) for g in pick]) for k, pick in enumerate(choices)]))[0]


def _links(ids: np.ndarray, fps: np.ndarray, group: np.ndarray, side: np.ndarray, refs: np.ndarray, most: int, direct: bool):
    """A spanning set of links inside runs of equal ``group``. side 0: within the run; 1 and 2: only 1 against 2. ``direct``: pairs that lie near themselves."""
    n = len(ids)
    table = pivot_table(fps, refs)
    order = np.lexsort((table[0], group))  # by the first coordinate: what follows farther on differs more in it
    ids, fps, group, side, table, root = ids[order], fps[order], group[order], side[order], table[:, order], np.arange(n)
    start = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((start, [n])))
    end = np.repeat(start + size, size)
    first, kept = table[0], []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        some = (root[i] != root[j]) & ((side[i] == 0) | (side[i] != side[j]))
        i, j = i[some], j[some]
        ok = near(fps, table, i, j, most)
        if len(ok):
            i, j = i[ok], j[ok]
            kept.append((i, j))
            root = local_roots(n, i, j, root)

    at, shift = np.arange(n), 1
    while True:  # all pairs of short runs, by distance within the run
        at = at[at + shift < end[at]]
        at = at[first[at + shift] - first[at] <= most]
        if not len(at):
            break
        if len(at) < 4096 and (end[at] - at).max() > shift + 64:
            break
        take(at, at + shift)
        shift += 1
    for i in at:  # the rest of long runs: one row against all that follow it
        last = i + shift + int(np.searchsorted(first[i + shift : end[i]], first[i] + most, "right"))
        take(np.full(last - i - shift, i), np.arange(i + shift, last))
    if direct:
        i, j = (np.concatenate([p[k] for p in kept]) if kept else np.zeros(0, np.int64) for k in (0, 1))
        return ids[i], ids[j]
    moved = np.flatnonzero(root != np.arange(n))
    return ids[moved], ids[root[moved]]


def links(reps: DataFrame, most: int = 4, n_pivots: int = 12, tile: int = 8192, direct: bool = False) -> DataFrame:
    """Links (a, b) between rows of reps(id, fp), enough to connect all that lie within ``most`` bits.

    Distances to the index pivots make the buckets, which hold every such pair. A bucket over ``tile`` rows is dealt as pairs of chunks, each a
    group of its own, so no task holds a large bucket. Within a group rows are sorted by their distance to the first of ``n_pivots`` random
    references and met only while that differs by ``most``; pairs whose other distances differ by more are discarded, the rest compared bit by bit.
    Only a spanning set of links leaves the task: with ``direct``, of pairs that lie near themselves.
    """
    refs = pivots(n_pivots)
    placed = reps.select("id", "fp", F.explode(index_keys("fp", reps.count(), most)).alias("b"))
    dealt = deal(placed, "b", "id", tile)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(last: bool):
            t = pa.Table.from_batches(held)
            ids, fps = t["id"].to_numpy(), t["fp"].to_numpy().view(np.uint64)
            group, side = t["g"].to_numpy(), t["side"].to_numpy()
            cut = len(ids) if last else int(np.searchsorted(group, group[-1]))  # the last group may go on
            a, b = _links(ids[:cut], fps[:cut], group[:cut], side[:cut], refs, most, direct)
            held[:] = [] if last else t.slice(cut).to_batches()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 200_000:
                yield done(False)
        if held:
            yield done(True)

    sorted_ = dealt.select("id", "fp", "g", "side").repartition("g").sortWithinPartitions("g")
    return sorted_.mapInArrow(pairs, "a bigint, b bigint")


def simhash_groups(docs: DataFrame, most: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of documents.

    Rows whose fingerprints differ in at most ``most`` bits are linked; component_id is the smallest doc_id that can be
    reached. A null or empty text has fingerprint zero and is linked like any other. Rows with a null doc_id keep their
    fingerprint and take the component of their class. Repeated rows stay rows. Extra columns are ignored.
    """
    fps = pinned(fingerprints(docs, shingle))
    reps = pinned(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"))
    comp = connected_components(links(reps, most))
    classes = reps.join(comp, reps["id"] == comp["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    out = fps.join(classes, "fp", "left")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, most: int = 4) -> DataFrame:
    """One row of each group stays: that of the smallest doc_id (of equal ids, the first by text and the other columns);
    rows without a doc_id stay only where they are the whole of their group."""
    groups = simhash_groups(docs, most)
    kept = groups.where("doc_id = component_id").select("doc_id").distinct()
    alone = groups.where("component_id is null").select("fingerprint").distinct()
    named = docs.join(kept, "doc_id", "left_semi")
    repeated = docs.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select("doc_id")
    if not repeated.isEmpty():
        n = "_" * (1 + max(map(len, docs.columns)))  # no column has that name
        order = Window.partitionBy("doc_id").orderBy(*[F.col(f"`{c}`") for c in docs.columns if c != "doc_id"])
        one = named.join(repeated, "doc_id", "left_semi").withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n)
        named = named.join(repeated, "doc_id", "left_anti").unionByName(one.select(docs.columns))
    if alone.isEmpty():
        return named.select(docs.columns)
    unnamed = docs.where("doc_id is null")
    marked = unnamed.withColumn("doc_id", F.monotonically_increasing_id())
    marked = pinned(marked)
    fp = fingerprints(marked).withColumnRenamed("doc_id", "_id")
    first = fp.withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0")).join(alone, "fingerprint", "left_semi")
    first = first.groupBy("fp").agg(F.min("_id").alias("_id"))
    rest = marked.join(first, marked["doc_id"] == first["_id"], "left_semi").withColumn("doc_id", F.lit(None).cast("bigint"))
    return named.select(docs.columns).unionByName(rest.select(docs.columns))
