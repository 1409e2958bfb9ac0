"""Exact order statistics of groups of any size: counts by range, then ranks inside one range."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.common import null_safe_join
from loomwork.operators.storage import saved

#: Ranges into which a round cuts what is left of a group, and rows that are ranked in one place.
RANGES = 32
FEW = 4096


def _ranks(p: float, n: Column) -> tuple[Column, Column, Column]:
    """(lower rank, upper rank, share of the way between them) of the quantile p of n values, counted from 0, as linear interpolation has them."""
    at = F.lit(p) * (n - 1)
    return F.floor(at).cast("bigint"), F.ceil(at).cast("bigint"), at - F.floor(at)


def quantiles(rows: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], few: int = FEW) -> DataFrame:
    """(*keys, n, q array<double>): the exact quantiles of the values that aren't null or NaN of each group, with linear interpolation between ranks; null keys are keys.

    Groups of up to ``few`` rows are ranked at once. The values of a larger one are counted by partial sums in RANGES ranges between marks from a sketch of them, and only the ranges that hold a wanted rank are
    looked at again, until each holds ``few`` rows or one value; so no task sorts or holds a group, however large, and equal values are counted, not gathered. The sketch has a fixed size, and its error only moves
    the marks: ranks are counted exactly. A round leaves about a RANGES-th of a range, whatever the values.
    """
    keys = list(keys)
    real = saved(rows.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, F.col(value).cast("double").alias("v")))
    sizes = saved(real.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    wanted = F.array(*[x for p in probabilities for x in _ranks(p, F.col("n"))[:2]])
    # Each wanted rank of a group, with the range in which it is looked for and the number of values below that range.
    open_ = sizes.select(*keys, "low", "high", F.lit(0).cast("bigint").alias("below"), F.col("n").alias("inside"), F.explode(F.array_distinct(wanted)).alias("rank"))
    done = None
    while True:
        ended = open_.where(f"inside <= {few} or low = high")
        done = ended if done is None else done.unionByName(ended)
        open_ = saved(open_.where(f"inside > {few} and low < high"))
        if open_.isEmpty():
            break
        spans = open_.select(*keys, "low", "high", "below").distinct()
        met = saved(null_safe_join(real, spans, keys).where("v >= low and v <= high"))
        group = [*keys, "low", "high", "below"]
        marks = met.groupBy(*group).agg(F.array_distinct(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 50 * RANGES)).alias("marks"))
        marked = null_safe_join(met, marks, group)
        counts = marked.groupBy(*group, F.size(F.filter("marks", lambda m: m <= F.col("v"))).alias("cell")).agg(F.count("*").alias("c"), F.min("v").alias("_low"), F.max("v").alias("_high"))
        before = Window.partitionBy(*keys, "low", "high", "below").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows at most
        counts = counts.withColumn("_below", F.col("below") + F.coalesce(F.sum("c").over(before), F.lit(0)))
        cells = counts.select(*keys, F.col("low").alias("l"), F.col("high").alias("h"), "_low", "_high", "_below", "c")
        found = null_safe_join(open_, cells, keys).where("low = l and high = h and rank >= _below and rank < _below + c")
        open_ = found.select(*keys, F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("_below").alias("below"), F.col("c").alias("inside"), "rank")
    done = saved(done)
    single = done.where("low = high").select(*keys, "rank", F.col("low").alias("v"))
    ranges = done.where("low < high").select(*keys, "low", "high", "below").distinct()
    place = Window.partitionBy(*keys, "low", "high", "below").orderBy("v")  # ``few`` rows at most
    near = null_safe_join(real, ranges, keys).where("v >= low and v <= high").withColumn("at", F.col("below") + F.row_number().over(place) - 1)
    asked = done.where("low < high").select(*keys, F.col("low").alias("l"), F.col("high").alias("h"), "rank")
    ranked = null_safe_join(near, asked, keys).where("low = l and high = h and at = rank").select(*keys, "rank", "v")
    ranks = single.unionByName(ranked).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("r"))  # two for each probability
    q = []
    for p in probabilities:
        low, high, share = _ranks(p, F.col("n"))
        a, b = F.element_at("r", low), F.element_at("r", high)
        q.append(F.when(low == high, a).otherwise((1 - share) * a + share * b))
    return null_safe_join(sizes.select(*keys, "n"), ranks, keys).select(*keys, "n", F.array(*q).alias("q"))
