"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on doc_id, files in doc_id order."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.llm.common import lean, shared_dir
from loomwork.llm.tokens import batches_of, flat_byte_ids, forget

END_ID = 2


def write_tokens(docs: DataFrame, tokenizer: str, out: str, stripe_bytes: int = 16 << 20, index_rows: int = 2000) -> None:
    """Encode each text (null: empty) with END_ID after it and write (doc_id, part, part_start, n, ids) as ORC in ascending doc_id order.

    Files are ranges of doc_id in the order of ``part``; part_start counts the ids before the row in its file, n those of the row. Equal doc_ids stay in one
    file; a null doc_id comes first. Stripes let readers split files; min/max row indexes and Bloom filters prune by doc_id.
    """

    def encoded(doc_ids: pa.Array, texts: pa.Array, part: int, at: int) -> pa.RecordBatch:
        found, bounds = flat_byte_ids(tokenizer, texts)
        ends = bounds + np.arange(len(bounds))  # with an END_ID after each text
        ids = np.empty(ends[-1], np.int32)
        last = np.zeros(len(ids), bool)
        last[ends[1:] - 1] = True
        ids[last], ids[~last] = END_ID, found
        columns = [doc_ids, pa.array([part] * len(texts), pa.int32()), pa.array(at + ends[:-1]), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "part_start", "n", "ids"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, texts in batches_of(batch.column(1)):
                rows = encoded(batch.column(0).slice(low, len(texts)), texts, part, at)
                at += len(rows["ids"].values)
                yield rows
                del rows  # not held while the next texts are encoded
        forget(tokenizer, " ")

    ordered = docs.select(F.col("doc_id").cast("bigint"), "text").repartitionByRange(F.col("doc_id").asc_nulls_first())
    ordered = ordered.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = ordered.mapInArrow(lean(each), "doc_id bigint, part int, part_start bigint, n bigint, ids array<int>")
    (
        written.write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_rows).option("compression", "zstd")
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01).orc(out)
    )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, part, part_start, n, ids); filters on doc_id are pushed to stripe statistics and Bloom filters."""
    return spark.read.schema("doc_id bigint, part int, part_start bigint, n bigint, ids array<int>").orc(path)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files; start counts the ids of all rows before it.

    The ids of earlier files come from a sum for each file: one row a file is ordered, never the documents.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(4)
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False))
            offsets = ids.offsets.to_numpy().tolist()
            crcs = [zlib.crc32(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())],
                ["doc_id", "part", "part_start", "n_tokens", "ids_crc32"],
            )

    rows = read_tokens(spark, path).mapInArrow(lean(each), "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    sums = read_tokens(spark, path).groupBy("part").agg(F.max(F.col("part_start") + F.col("n")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.join(sums.select("part", before.alias("before")), "part")
    return rows.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer, out)
    return token_digest(spark, out)
