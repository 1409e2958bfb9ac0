"""Harmonic packing of token ids into sequences."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import lean, pinned
from loomwork.llm.tokens import batches_of, forget, word_ids

END_ID = 1


def cuts(n: int, capacity: int, slack: float) -> list[int]:
    """Lengths of the pieces of a document of n ids. A piece of class k is longer than capacity / (k + 1) and at most capacity / k: k of them fill a sequence.

    Whole sequences first. What is left stays one piece where it comes within a share of ``slack`` of the top of its class; else the top
    of the next class is cut off, which leaves a shorter rest.
    """
    whole, rest = divmod(n, capacity)
    out = [capacity] * whole
    while rest:
        k = capacity // rest
        fits = capacity // k - rest <= slack * (capacity // k)
        out.append(rest if fits else capacity // (k + 1))
        rest -= out[-1]
    return out


def pack(docs: DataFrame, path: str, capacity: int = 2048, slack: float = 0.08) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): one row for each piece of each document.

    A document is its ids and END_ID (null text: END_ID alone), cut as ``cuts`` says; k pieces of class k fill a sequence, of which less than
    a share of ``slack`` and k ids stay empty; only the last sequence of a class may be short. A task counts its own pieces class by class as it reads;
    adding what earlier tasks counted gives the piece's number in its class, and so its sequence. Pieces are dealt by sequence, never by class, so a
    class that holds most pieces costs nothing. Repeated rows and null doc_ids are packed as rows of their own; other columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), Counter()
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "k", "task", "number"]
        for batch in batches:
            for low, texts in batches_of(batch.column(1)):
                rows = []
                for doc, found in zip(batch.column(0).slice(low, len(texts)).to_pylist(), word_ids(path, texts.to_pylist()), strict=True):
                    ids = memoryview(found + END_ID.to_bytes(4, "little"))
                    at, n = 0, len(ids) // 4
                    for size in cuts(n, capacity, slack):
                        k = capacity // size
                        rows.append((doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, k, task, number[k]))
                        number[k] += 1
                        at += size
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names)
        forget(path, "")

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, k bigint, task bigint, number bigint"
    pieces = pinned(docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(lean(each), schema))
    counts = pieces.groupBy("k", "task").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("k").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    # One row a class: at most 2 * sqrt(capacity) + capacity * slack of them, whatever the input.
    totals = counts.groupBy("k").agg(F.sum("n").alias("all"))
    lower = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("k", F.coalesce(F.sum(F.ceil(F.col("all") / F.col("k"))).over(lower), F.lit(0)).alias("first"))
    placed = pieces.join(counts.select("k", "task", "before"), ["k", "task"]).join(F.broadcast(totals), "k")
    placed = placed.withColumn("index", F.col("before") + F.col("number"))
    placed = placed.withColumn("sequence_id", (F.col("first") + F.floor(F.col("index") / F.col("k"))).cast("bigint"))
    ahead = Window.partitionBy("sequence_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)  # at most ``capacity`` pieces
    offset = F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset")
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset)
