"""Embedding near-duplicates with a forest of random-projection trees."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import connected_components, deal, local_roots, mix, pinned


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    rows = rows / np.abs(rows).max(1, keepdims=True)  # else squares of tiny or huge numbers are lost
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def _direction(seed: int, dims: int) -> np.ndarray:
    w = np.random.default_rng(seed).standard_normal(dims)
    return w / np.linalg.norm(w)


class Forest:
    """Trees of random splits. A split sends the vectors within ``margin`` of it to both sides, so only pairs farther apart
    along the random direction are parted. Of a few random directions and places near the middle, the one with the
    fewest vectors in its margin is taken; where a third would spill everywhere, the node is a tight clump and stays a leaf."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, cosine: float, seed: int):
        self.rng = np.random.default_rng(seed)
        self.leaf, self.nodes, self.roots, self.leaves, self.dims = leaf, [], [], 0, sample.shape[1]
        self.margin = 0.5 * math.sqrt(2 * (1 - cosine) / self.dims)
        for _ in range(trees):
            self.roots.append(self._grow(sample, 0))

    def _grow(self, rows: np.ndarray, depth: int) -> int:
        best = None
        if len(rows) > self.leaf and depth < 40:
            for seed in self.rng.integers(0, 1 << 62, 4).tolist():
                at = np.sort(rows @ _direction(seed, self.dims))
                for t in np.quantile(at, np.linspace(0.3, 0.7, 9)):
                    spill = (np.searchsorted(at, t + self.margin, "right") - np.searchsorted(at, t - self.margin)) / len(at)
                    if best is None or spill < best[0]:
                        best = (spill, seed, float(t))
        if best is None or best[0] > 0.34:
            self.nodes.append(self.leaves)
            self.leaves += 1
            return len(self.nodes) - 1
        _, seed, t = best
        at, here = rows @ _direction(seed, self.dims), len(self.nodes)
        self.nodes.append(None)
        low, high = self._grow(rows[at <= t + self.margin], depth + 1), self._grow(rows[at >= t - self.margin], depth + 1)
        self.nodes[here] = (seed, t, low, high)
        return here

    def place(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of every leaf that a vector reaches, by row and leaf; leaf numbers run over all trees."""
        found, todo = [], [(r, np.arange(len(rows))) for r in self.roots]
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            if isinstance(self.nodes[node], int):
                found.append((at, np.full(len(at), self.nodes[node])))
                continue
            seed, t, low, high = self.nodes[node]
            p = rows[at] @ _direction(seed, self.dims)
            todo += [(low, at[p <= t + self.margin]), (high, at[p >= t - self.margin])]
        row, leaf = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def _compare(t: pa.Table, dims: int, kind: type, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, vectors linked, root id) for the rows of one group that have a link that is first met in this leaf."""
    ids, n, side, leaf = t["id"].to_numpy(), t["n"].to_numpy(), t["side"].to_numpy(), t["leaf"][0].as_py()
    unit = _unit(np.frombuffer(b"".join(t["vec"].to_pylist()), kind).reshape(-1, dims))
    leaves = t["leaves"].combine_chunks()
    code, row = leaves.flatten().to_numpy(), np.repeat(np.arange(len(ids)), leaves.value_lengths().to_numpy())
    code, row = code[code < leaf], row[code < leaf]  # leaves before this one, in which a pair may have met
    names, column, times = np.unique(code, return_inverse=True, return_counts=True)
    often = times[column] > 1
    names, column = np.unique(column[often], return_inverse=True)
    member = np.zeros((len(ids), max(1, len(names))), np.float32)
    member[row[often], column] = 1
    linked, root, strip = np.zeros(len(ids), np.int64), np.arange(len(ids)), 512
    for at in range(0, len(ids), strip):
        rows = slice(at, at + strip)
        close = unit[rows] @ unit.T >= cosine
        close[np.arange(close.shape[0]), np.arange(at, at + close.shape[0])] = False
        if side.any():
            close &= side[rows, None] != side[None, :]
        if not close.any():
            continue
        close &= member[rows] @ member.T == 0
        linked[rows] = close @ n
        i, j = np.nonzero(close)
        keep = j > i + at
        root = local_roots(len(ids), i[keep] + at, j[keep], root)
    some = np.flatnonzero(linked)
    return ids[some], linked[some], ids[root[some]]


def _comparer(dims: int, kind: type, cosine: float):
    def compare(t: pa.Table) -> pa.Table:
        a, n, b = _compare(t, dims, kind, cosine)
        return pa.table({"id": a, "n_links": n, "root": b})

    return compare


def _split(placed: DataFrame, vectors: DataFrame, dims: int, kind: type, cosine: float, leaf: int, fit_rows: int, chunk: int = 20_000) -> DataFrame:
    """placed(id, leaf) with every leaf of over 2 * ``leaf`` rows split by a tree of its own, and again, until none is left but tight clumps.

    A tree is fitted in a task on about ``fit_rows`` rows of its leaf; the rows of a leaf are dealt to chunks of about ``chunk`` rows, each with a copy of the tree, so
    leaves stay as small however many rows there are, and neither the driver nor a task holds a leaf.
    """

    def fit(t: pa.Table) -> pa.Table:
        at, share = t["leaf"][0].as_py(), t["share"][0].as_py()
        rows = _unit(np.frombuffer(b"".join(t["vec"].to_pylist()), kind).reshape(-1, dims))
        tree = Forest(rows, 1, max(8, int(leaf * share)), cosine, at & 0x7FFFFFFF)
        return pa.table({"leaf": [at], "tree": [pickle.dumps((tree.nodes, tree.roots))] if tree.leaves > 1 else pa.array([None], pa.binary())})

    def place(rows: pa.Table, trees: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.table({"id": pa.array([], pa.int64()), "leaf": pa.array([], pa.int64())})
        tree = Forest(np.zeros((0, dims)), 0, leaf, cosine, 0)
        tree.nodes, tree.roots = pickle.loads(trees["tree"][0].as_py())
        row, sub = tree.place(_unit(np.frombuffer(b"".join(rows["vec"].to_pylist()), kind).reshape(-1, dims)))
        names = mix(np.uint64(rows["leaf"][0].as_py() & (1 << 64) - 1) + (sub.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        return pa.table({"id": rows["id"].combine_chunks().take(pa.array(row)), "leaf": names.view(np.int64)})

    done, n = None, F.col("count")
    while True:
        large = pinned(placed.groupBy("leaf").count().where(n > 2 * leaf).select("leaf", "count"))
        if large.isEmpty():
            return placed if done is None else done.unionAll(placed)
        some = placed.join(large, "leaf").withColumn("share", F.least(F.lit(1.0), fit_rows / n))
        some = some.where(F.pmod(F.xxhash64("id", "leaf"), F.lit(1_000_003)) < F.col("share") * 1_000_003)
        trees = pinned(some.join(vectors, "id").select("leaf", "share", "vec").groupBy("leaf").applyInArrow(fit, "leaf bigint, tree binary").where("tree is not null"))
        cut = large.join(trees, "leaf").withColumn("c", F.explode(F.sequence(F.lit(0), F.floor(n / chunk).cast("int"))))
        rows = placed.join(large.join(trees.select("leaf"), "leaf"), "leaf").withColumn("c", F.pmod(F.xxhash64("id"), F.floor(n / chunk) + 1).cast("int"))
        rows = rows.join(vectors, "id").select("id", "leaf", "c", "vec")
        stay = placed.join(trees.select("leaf"), "leaf", "left_anti")
        done = pinned(stay if done is None else done.unionAll(stay))
        placed = pinned(rows.groupBy("leaf", "c").cogroup(cut.select(F.col("leaf").alias("_leaf"), F.col("c").alias("_c"), "tree").groupBy("_leaf", "_c")).applyInArrow(place, "id bigint, leaf bigint"))


def near_vectors(
    vectors: DataFrame, cosine: float = 0.9, trees: int = 6, leaf: int = 512, sample_rows: int = 16_384, fit_rows: int = 4096, tile: int = 4096, seed: int = 11
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vectors(vec_id, embedding).

    Equal vectors are one class with a count. A forest, fitted on about ``sample_rows`` classes, places every class; leaves that are still large are split again
    by trees fitted on ``fit_rows`` of their own rows. Classes are compared in double precision inside leaves. A pair is counted in the first leaf it shares,
    so links add up without a list of pairs, and each group emits a count and one link a row. A tight clump over ``tile`` rows is compared as
    pairs of chunks. Links reported have the cosine or more; a pair that shares no leaf in any tree is missed (recall is measured in the tests).

    Null or zero vectors and those with null or non-finite components link with nothing. Vectors of different lengths link with nothing of another length. Repeated rows
    are vectors of their own; rows without a vec_id count as links and join what they link, but never name a component. vec_ids lie under 2**62. Extra columns are ignored.
    """
    spark = vectors.sparkSession
    double = vectors.schema["embedding"].dataType.elementType.typeName() not in ("float", "short", "byte")
    kind, unnamed = np.float64 if double else np.float32, 1 << 62
    e = F.col("embedding").cast("array<double>" if double else "array<float>")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("bigint"), e.alias("embedding"))
    rows = rows.withColumn("key", F.when(F.coalesce(fine, F.lit(False)), F.sha2(F.to_json("embedding"), 256)))
    classes = rows.where("key is not null").groupBy("key").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"), F.any_value("embedding").alias("vec"))
    classes = pinned(classes.withColumn("id", F.coalesce("id", F.lit(unnamed) + F.monotonically_increasing_id())))
    met = None
    for dims, total in classes.groupBy(F.size("vec")).count().collect():
        own = classes.where(F.size("vec") == dims)
        share = min(1.0, sample_rows / total)
        picked = own.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(1_000_000 * share)).select("vec").toArrow()
        sample = picked["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        forest = Forest(_unit(sample) if len(sample) else sample, trees, max(8, int(leaf * share)), cosine, seed)
        held = spark.sparkContext.broadcast(forest)  # its size follows sample_rows, not the table

        def raw(batches: Iterator[pa.RecordBatch], dims=dims, kind=kind) -> Iterator[pa.RecordBatch]:
            for b in batches:
                made = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(kind)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in made], pa.binary())], ["id", "n", "vec"])

        def place(batches: Iterator[pa.RecordBatch], held=held, dims=dims, kind=kind) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for low in range(0, b.num_rows, 2000):
                    part = b.slice(low, 2000)
                    row, at = held.value.place(_unit(np.frombuffer(b"".join(part.column(1).to_pylist()), kind).reshape(-1, dims)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(at, pa.int64())], ["id", "leaf"])

        packed = pinned(own.select("id", "n", "vec").mapInArrow(raw, "id bigint, n bigint, vec binary"))
        placed = pinned(packed.select("id", "vec").mapInArrow(place, "id bigint, leaf bigint"))
        placed = _split(placed, packed.select("id", "vec"), dims, kind, cosine, leaf, fit_rows)
        leaves = placed.groupBy("id").agg(F.array_sort(F.collect_set("leaf")).alias("leaves"))  # at most a few dozen: the leaves of one vector
        placed = packed.join(leaves, "id").select("id", "n", "vec", "leaves", F.explode("leaves").alias("leaf"))
        one = deal(pinned(placed), "leaf", "id", tile).groupBy("g").applyInArrow(_comparer(dims, kind, cosine), "id bigint, n_links bigint, root bigint")
        met = one if met is None else met.unionAll(one)
    if met is None:
        met = spark.createDataFrame([], "id bigint, n_links bigint, root bigint")
    met = pinned(met)
    links = met.groupBy("id").agg(F.sum("n_links").alias("n_links"))
    comp = connected_components(met.select(F.col("id").alias("a"), F.col("root").alias("b")))
    found = classes.select("key", "id", "n").join(links, "id", "left").join(comp, F.col("id") == comp["node"], "left")
    least = F.coalesce("component", "id")
    found = found.select("key", (F.col("n") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links"), F.when(least < unnamed, least).alias("component_id"))
    out = rows.select("vec_id", "key").join(found, "key", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", F.when(F.col("key").isNull(), F.col("vec_id"))).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
