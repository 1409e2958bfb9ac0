"""Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import pinned

ROUNDS = 6


def numbered(df: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """(df with a gapless bigint ``row`` in the given order, number of rows).

    Rows are range-partitioned and sorted, and fixed in shared storage; only the row counts of partitions are summed, so
    no task sees more than one partition. Rows equal in all of ``order`` take their numbers in any order.
    """
    keys = [*(F.col(c).asc_nulls_first() for c in order), F.col("_tie").asc()]  # many rows that are equal spread over partitions too
    sorted_ = df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    fixed = pinned(sorted_.withColumn("_m", F.monotonically_increasing_id()))
    part, local = F.shiftright("_m", 33), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    counts = fixed.groupBy(part.alias("_p")).count()
    before = F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    starts = pinned(counts.select("_p", F.coalesce(before, F.lit(0)).alias("_before"), "count"))
    total = starts.agg(F.sum("count")).first()[0] or 0
    rows = fixed.withColumn("_p", part).join(F.broadcast(starts.select("_p", "_before")), "_p")  # one short row a partition
    return rows.withColumn("row", F.col("_before") + local).drop("_p", "_m", "_before"), total


def permuted(row: Column, total: int, seed: int) -> Column:
    """A bijection of 0..total-1. Alternating moduli a and b with a * b >= total keep the domain within one root of
    the total, so few numbers walk on; no cycle has more than a * b - total numbers to pass."""
    a = math.isqrt(max(total - 1, 0)) + 1
    b = max(1, -(-total // a))

    def feistel(x: Column) -> Column:
        def turn(acc: Column, i: Column) -> Column:
            m = F.when(i % 2 == 0, F.lit(a)).otherwise(F.lit(b))
            f = F.pmod(F.xxhash64(F.lit(seed), i, acc["r"]), m)
            return F.struct(acc["r"].alias("l"), F.pmod(acc["l"] + f, m).cast("bigint").alias("r"))

        start = F.struct(F.floor(x / F.lit(b)).cast("bigint").alias("l"), F.pmod(x, F.lit(b)).cast("bigint").alias("r"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: s["l"] * b + s["r"])

    walks = min(a * b - total, 48)
    y = feistel(row)
    if walks:
        y = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), y, lambda acc, _: F.when(acc >= total, feistel(acc)).otherwise(acc))
        y = F.when(y < total, y).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))
    return y


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row of documents.

    Law ``rows``: row numbers by doc_id are permuted; shard and slot are remainder and quotient of the place, so shard
    sizes differ by one at most and any place can be computed without the table. size is the text's UTF-8 bytes (null: none)
    plus 1; a null text has the crc of an empty one. Null doc_ids come first. Repeated rows are rows of their own.
    """
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    light = docs.select(F.col("doc_id").cast("bigint"), (F.octet_length(raw).cast("bigint") + 1).alias("size"), F.crc32(raw).alias("text_crc32"))
    rows, total = numbered(light, "doc_id", "size", "text_crc32")
    place = rows.withColumn("place", permuted(F.col("row"), total, seed))
    return place.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.pmod("place", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("place") / shards).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )
