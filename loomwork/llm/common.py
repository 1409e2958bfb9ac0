"""Helpers shared by the training-data operators: shared storage, word hashes, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees, from spark.checkpoint.dir.

    Only a local session without that setting gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomwork-")
        sc.setCheckpointDir(found)
    return found


def pinned(df: DataFrame) -> DataFrame:
    """Cut the lineage: the rows and their partitions are fixed in shared storage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def short_lived(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For an operator whose first argument is a DataFrame: shuffle files of its inner jobs go once each job's result is in shared storage, not when
    the driver next collects garbage. The session's own setting is put back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @wraps(operator)
    def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
        conf = docs.sparkSession.conf
        was = conf.get(name, "false")
        conf.set(name, "true")
        try:
            return operator(docs, *args, **kwargs)
        finally:
            conf.set(name, was)

    return run


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that is read no more."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


# --- memory of a worker ------------------------------------------------------------------


def give_back() -> None:
    """Memory that this process has freed goes back to the system. A Python worker lives on for later tasks and stages, and what its allocators keep counts for its executor."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc
        trim(0)


def lean(each: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow that gives memory back after each batch and at its end."""

    @wraps(each)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def given() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                give_back()

        yield from each(given())
        give_back()

    return run


# --- words of many texts at once -----------------------------------------------------------

_FOLD = np.zeros(256, np.uint8)
_FOLD[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_FOLD[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
_FOLD[128:] = np.arange(128, 256)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 48


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def texts_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and n + 1 offsets; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def parts(offsets: np.ndarray, most: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges that hold about ``most`` bytes each; a longer text is a range of its own."""
    at, n = 0, len(offsets) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = _FOLD) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every word; words are runs of letters, digits and non-ASCII bytes, ASCII case folded (or of what ``fold`` doesn't map to 0)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    low = fold[data]
    inside = low != 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    size = ends - starts
    h = size.astype(np.uint64)
    live, j = np.arange(len(starts)), 0
    while len(live):
        h[live] = (h[live] + low[starts[live] + j] + np.uint64(1)) * _MULT
        j += 1
        live = live[size[live] > j]
        if j == _LONG_WORD:
            for i in live:
                h[i] ^= np.uint64(xxhash.xxh64_intdigest(low[starts[i] + j : ends[i]].tobytes()))
            break
    return mix(h), np.searchsorted(offsets, starts, "right") - 1


def shingles(word_hash: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the first word) of each run of n words inside one row."""
    count = len(word_hash) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(count, np.uint64)
    for k in range(n):
        h = (h ^ word_hash[k : k + count]) * _MULT + np.uint64(k)
        h ^= h >> np.uint64(29)
    at = np.flatnonzero(row[:count] == row[n - 1 :])
    return mix(h[at]), at


# --- buckets and components ----------------------------------------------------------------------------


def deal(placed: DataFrame, bucket: str, row: str, tile: int) -> DataFrame:
    """placed with bigint ``g`` and tinyint ``side``: the group in which a row of ``bucket`` meets the others.

    A bucket of up to ``tile`` rows is one group with side 0. A larger one is cut into chunks by the hash of ``row``, and each
    pair of chunks is a group: side 0 where a chunk meets itself, else 1 against 2. So every pair of a bucket meets in exactly one
    group, and no group holds more than about two chunks.
    """
    large = placed.groupBy(F.col(bucket).alias("_l")).count().where(F.col("count") > tile)
    large = pinned(large.select("_l", F.ceil(F.col("count") / tile).cast("int").alias("_n")))
    whole = F.array(F.struct(F.col(bucket).alias("g"), F.lit(0).cast("tinyint").alias("side")))
    if large.isEmpty():
        return placed.withColumn("g", F.col(bucket)).withColumn("side", F.lit(0).cast("tinyint"))
    rows = placed.join(large, placed[bucket] == large["_l"], "left")
    rows = rows.withColumn("_c", F.pmod(F.xxhash64(row, F.lit(1)), "_n").cast("int"))
    c = F.col("_c")
    tiles = F.transform(
        F.sequence(F.lit(0), F.col("_n") - 1),
        lambda o: F.struct(
            F.xxhash64(bucket, F.least(c, o), F.greatest(c, o)).alias("g"),
            F.when(o == c, 0).when(c < o, 1).otherwise(2).cast("tinyint").alias("side"),
        ),
    )
    rows = rows.withColumn("_t", F.explode(F.when(F.col("_n").isNull(), whole).otherwise(tiles)))
    return rows.withColumn("g", F.col("_t.g")).withColumn("side", F.col("_t.side")).drop("_l", "_n", "_c", "_t")


def local_roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest index reachable from each of 0..n-1 over the links (a, b), joined to an earlier result."""
    root = np.arange(n) if root is None else root
    while len(a):
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            break
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while not np.array_equal(root, up := root[root]):
            root = up
    return root


def connected_components(edges: DataFrame, salts: int = 8) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node reachable.

    ``edges`` has two bigint columns a and b. Alternating large-star and small-star rounds; each round
    is written, minima are pre-aggregated, and joins are salted, so a hub with many links is not
    met by one task. No links or labels reach the driver, only a count and a checksum of each round.
    A checkpoint keeps the size that was estimated for its plan, and that of a join is a product: over a dozen rounds planning would deal in numbers
    of millions of digits. So rounds are files, of which Spark knows the size.
    """
    spark = edges.sparkSession
    folder = f"{shared_dir(spark)}/components-{uuid.uuid4().hex}"

    def kept(e: DataFrame, k: int) -> DataFrame:
        e.write.parquet(f"{folder}/{k}")
        return spark.read.schema("u bigint, v bigint").parquet(f"{folder}/{k}")

    def sign(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    def to_least(e: DataFrame, least: DataFrame) -> DataFrame:
        spread = least.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return e.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(spread, ["u", "s"])

    e, k = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), 0), 0
    was = sign(e)
    while was[0]:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = to_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = to_least(large, least).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e, k = kept(small.union(least).distinct(), k + 1), k + 1
        remove(spark, f"{folder}/{k - 1}")
        now = sign(e)
        if now == was:
            break
        was = now
    e = pinned(e)
    remove(spark, folder)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
