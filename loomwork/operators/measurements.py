"""Statistics, alignment and findings over test measurements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.common import all_of, exact_sum, mean, null_safe_join, rounded, share
from loomwork.operators.selection import quantiles
from loomwork.operators.storage import saved

#: Dimensions in which two values of a metric may differ without being the same point.
DIMENSIONS = ("case_id", "metric", "unit", "band", "width", "channel", "direction", "sample", "sheet")


def visible(runs: DataFrame, roles: Sequence[str]) -> DataFrame:
    """Published runs that one of ``roles`` may read."""
    return runs.where("published").where(F.arrays_overlap("roles", F.array(*map(F.lit, roles))))


def optional_filters(df: DataFrame, **wanted) -> DataFrame:
    """Keep rows that equal each value given; None sets no condition, and a list means any of its values."""
    conditions = [F.col(k).isin(v) if isinstance(v, (list, tuple)) else F.col(k) == v for k, v in wanted.items() if v is not None]
    return df.where(all_of(conditions))


#: Dimensions by which each report type is always grouped, so that unlike conditions are never averaged together.
SERIES = {"low": ("band", "width"), "high": ("band", "width", "direction"), "urgent": ("band", "direction"), "medium": ("band",)}
ALL_SERIES = ("band", "width", "direction", "channel")


def series_of(report_type: str | None) -> tuple[str, ...]:
    """Series columns of a report type; a type without a policy is grouped by all."""
    return SERIES.get(report_type, ALL_SERIES)


def measurement_stats(points: DataFrame, runs: DataFrame, series: Sequence[str], listed: int = 10) -> DataFrame:
    """Count, sum, mean, extremes, median, p95 and sample range for each product, metric and series.

    Groups of at most ``listed`` values also give these in order of sample and cell; longer groups are never gathered.
    """
    keys = ["product_id", "metric", "unit", *series]
    rows = points.join(runs.select("run_id", "product_id"), "run_id")
    stats = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), rounded(exact_sum("value"), 4).alias("total"), mean("value").alias("average"), F.min("value").alias("minimum"),
        F.max("value").alias("maximum"), F.percentile("value", F.array(F.lit(0.5), F.lit(0.95))).alias("_p"), F.min("sample").alias("first_no"), F.max("sample").alias("last_no"),
    )
    stats = stats.withColumn("median", rounded(F.col("_p")[0])).withColumn("p95", rounded(F.col("_p")[1])).drop("_p")
    small = stats.where(F.col("n") <= listed).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    short = rows.join(small, all_of([F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]), "left_semi")
    values = short.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("sample", "cell", "value"))).alias("v"))
    values = values.withColumn("value_list", F.array_join(F.transform("v", lambda x: x["value"].cast("string")), ",")).drop("v")
    return null_safe_join(stats, values, keys, "left")


def catalog(points: DataFrame, runs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """What can be asked of each report type and metric: distinct conditions, whether samples are numbered, number of cases."""
    rows = points.join(runs.select("run_id", "report_type"), "run_id").join(F.broadcast(dictionary.select("metric", "unit", "more_is_better")), ["metric", "unit"], "left")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ",").alias(f"{c}s")
    return rows.groupBy("report_type", "metric", "unit").agg(
        *[listed(c) for c in ("band", "width", "channel", "direction")], F.max(F.col("sample").isNotNull()).alias("numbered"),
        F.count_distinct("case_id").alias("n_cases"), F.first("more_is_better").alias("more_is_better"),
    )


def leave_one_out(rows: DataFrame, filters: dict[str, object]) -> DataFrame:
    """For each filter, the rows that all the other filters leave; one pass over the rows."""
    hold = {k: F.coalesce(F.col(k) == v, F.lit(False)) for k, v in filters.items()}
    counts = rows.agg(F.count_if(all_of(list(hold.values()))).alias("_all"), *[F.count_if(all_of([c for j, c in hold.items() if j != k])).alias(k) for k in hold])
    return counts.select("_all", F.explode(F.array(*[F.struct(F.lit(k).alias("dropped"), F.col(k).alias("n")) for k in filters])).alias("x")).select("x.dropped", "x.n", F.col("_all").alias("n_all"))


def compare_metric(points: DataFrame, runs: DataFrame, metric: str) -> DataFrame:
    """n, mean and extremes of one metric for each product; comparable only where one unit occurs."""
    rows = points.where(F.col("metric") == metric).join(runs.select("run_id", "product_id"), "run_id")
    out = rows.groupBy("product_id").agg(
        F.count("*").alias("n"), mean("value").alias("average"), F.min("value").alias("minimum"), F.max("value").alias("maximum"),
        F.array_join(F.array_sort(F.collect_set("sheet")), ",").alias("sheets"), (F.count_distinct("unit") <= 1).alias("comparable"),
    )
    return out


def verdict_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Pass, fail and other counts for each key, and one verdict: mixed, fail, pass or n/a."""
    out = results.groupBy(*keys).agg(
        F.count_if(F.col("verdict") == "pass").alias("passed"), F.count_if(F.col("verdict") == "fail").alias("failed"), F.count("*").alias("items")
    )
    verdict = F.when((F.col("passed") > 0) & (F.col("failed") > 0), "mixed").when(F.col("failed") > 0, "fail").when(F.col("passed") > 0, "pass").otherwise("n/a")
    return out.withColumn("verdict", verdict)


def last_point(points: DataFrame, *keys: str) -> DataFrame:
    """The last value of each key, by sample and then cell and value."""
    return points.groupBy(*keys).agg(F.max_by("value", F.struct("sample", "cell", "value")).alias("value"))


def throughput_scope(points: DataFrame) -> DataFrame:
    """Median and extremes of the last value of each channel and case, by band, width and direction."""
    keys = ["band", "width", "direction"]
    last = saved(last_point(points, "run_id", "case_id", *keys, "channel"))
    stats = last.groupBy(*keys).agg(F.count("*").alias("n"), F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    middle = quantiles(last, keys, "value", [0.5]).select(*keys, rounded(F.col("q")[0], 4).alias("median"))  # few groups, each of any size
    return null_safe_join(stats, middle, keys, "left").select(*keys, "n", "median", "minimum", "maximum")


def curve_features(points: DataFrame, curve: Sequence[str], x: str = "sample", least: int = 3) -> DataFrame:
    """Features of each curve of ``least`` or more places: peak, its first place, the cliff (first later place under half the peak), mean and last value."""
    one = points.groupBy(*curve, x).agg(F.max("value").alias("value"))
    peak = Window.partitionBy(*curve)
    at = one.withColumn("peak", F.max("value").over(peak))
    at = at.withColumn("peak_at", F.min(F.when(F.col("value") == F.col("peak"), F.col(x))).over(peak))
    return at.groupBy(*curve).agg(
        F.count("*").alias("places"), F.max("peak").alias("peak"), F.max("peak_at").alias("peak_at"),
        F.min(F.when((F.col(x) > F.col("peak_at")) & (F.col("value") < F.col("peak") / 2), F.col(x))).alias("cliff_at"),
        mean("value").alias("average"), F.max_by("value", x).alias("last"),
    ).where(F.col("places") >= least)


def noise(history: DataFrame, keys: Sequence[str], fixed_percent: float = 5.0, least: int = 5) -> DataFrame:
    """Robust spread of each key: 1.4826 times the median distance from the median, as a share of the median.

    Fewer than ``least`` values give no spread; the threshold is never under ``fixed_percent``.
    """
    middle = history.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile("value", 0.5).alias("middle"))
    far = null_safe_join(history, middle, list(keys))
    spread = far.groupBy(*keys).agg(F.first("n").alias("n"), F.first("middle").alias("middle"), F.percentile(F.abs(F.col("value") - F.col("middle")), 0.5).alias("mad"))
    percent = F.when((F.col("n") >= least) & (F.col("middle") != 0), 1.4826 * F.col("mad") / F.abs("middle") * 100)
    out = spread.withColumn("spread_percent", rounded(percent, 4))
    return out.select(*keys, "n", rounded(F.col("middle")).alias("middle"), "spread_percent", rounded(F.greatest(F.lit(fixed_percent), F.coalesce(3 * percent, F.lit(0.0))), 4).alias("threshold_percent"))


def ranked_runs(runs: DataFrame, most: int | None = None) -> DataFrame:
    """Runs of each product and report type, the newest first (``nth`` from 1); runs without a date come last."""
    order = Window.partitionBy("product_id", "report_type").orderBy(F.desc_nulls_last("test_date"), F.desc("run_id"))
    out = runs.withColumn("nth", F.row_number().over(order).cast("bigint"))
    return out if most is None else out.where(F.col("nth") <= most)


def align_last_two(points: DataFrame, runs: DataFrame, dimensions: Sequence[str] = DIMENSIONS) -> DataFrame:
    """Points of the newest run of each product and report type beside those of the run before it.

    One row a point: null dimensions count as equal, a repeated point keeps its last value and tells how many it had.
    """
    pair = ranked_runs(runs, 2).select("run_id", "product_id", "report_type", "nth")
    rows = points.join(pair, "run_id")
    keys = ["product_id", "report_type", *dimensions]
    side = lambda n, c: F.max_by(F.when(F.col("nth") == n, F.col(c)), F.when(F.col("nth") == n, F.struct("cell", "value")))
    return rows.groupBy(*keys).agg(
        side(1, "value").alias("after"), side(2, "value").alias("before"),
        F.count_if(F.col("nth") == 1).alias("n_after"), F.count_if(F.col("nth") == 2).alias("n_before"),
    )


def assess(aligned: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Change of each aligned point, whether it is notable by its metric's rule, and what it means.

    Absolute rules look at the change alone; for percentage rules any change from zero is notable. Where it is unknown whether
    more is better, a notable point has merely changed.
    """
    both = aligned.join(F.broadcast(dictionary), ["metric", "unit"], "left")
    delta = F.col("after") - F.col("before")
    both = both.withColumn("delta", rounded(delta, 4)).withColumn("percent", rounded(F.when(F.col("before") != 0, delta / F.abs("before") * 100), 4))
    notable = F.when(F.col("rule") == "absolute", F.abs("delta") >= F.col("threshold")).otherwise(
        F.when(F.col("before") == 0, F.col("delta") != 0).otherwise(F.abs("percent") >= F.col("threshold"))
    )
    better = (F.col("delta") > 0) == F.col("more_is_better")
    kind = (
        F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(~F.coalesce(notable, F.lit(False)), "same")
        .when(F.col("more_is_better").isNull(), "changed").when(better, "improvement").otherwise("regression")
    )
    return both.withColumn("assessment", kind)


def confounded(runs: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The last two runs of each product and report type; confounded where more than one of ``parts`` differs."""
    pair = ranked_runs(runs, 2).groupBy("product_id", "report_type")
    out = pair.agg(F.count("*").alias("n_runs"), *[(F.count_distinct(F.coalesce(p, F.lit("None"))) > 1).cast("int").alias(f"{p}_differs") for p in parts])
    total = sum((F.col(f"{p}_differs") for p in parts), F.lit(0))
    return out.where("n_runs = 2").withColumn("n_differ", total).withColumn("confounded", total > 1)


def findings(aligned: DataFrame, top: int) -> DataFrame:
    """Scopes (metric, band, direction) in which the points moved, ranked for each product by the size of the median change; the ``top`` of each."""
    both = aligned.where("after is not null and before is not null").withColumn("delta", F.col("after") - F.col("before"))
    scope = both.groupBy("product_id", "report_type", "metric", "band", "direction").agg(
        F.count("*").alias("n"), F.count_if(F.col("delta") > 0).alias("up"), F.count_if(F.col("delta") < 0).alias("down"),
        rounded(F.percentile("delta", 0.5), 4).alias("median_change"), rounded(F.percentile("before", 0.5), 4).alias("median_before"),
    )
    size = rounded(F.abs("median_change") / F.nullif(F.abs("median_before"), F.lit(0.0)), 6)
    order = Window.partitionBy("product_id", "report_type").orderBy(F.desc_nulls_last("magnitude"), "metric", F.asc_nulls_first("band"), F.asc_nulls_first("direction"))
    return scope.withColumn("magnitude", size).withColumn("place", F.row_number().over(order).cast("bigint")).where(F.col("place") <= top)


def scope_coverage(points: DataFrame, runs: DataFrame, scope: Sequence[str]) -> DataFrame:
    """How many of the last two runs of each product hold each scope, and whether all do."""
    pair = ranked_runs(runs, 2).select("run_id", "product_id", "report_type")
    total = pair.groupBy("product_id", "report_type").agg(F.count("*").alias("n_runs"))
    held = points.join(pair, "run_id").groupBy("product_id", "report_type", *scope).agg(F.count_distinct("run_id").alias("n_with"))
    out = held.join(total, ["product_id", "report_type"])
    return out.withColumn("in_all", F.col("n_with") == F.col("n_runs"))


def placeholder_cases(points: DataFrame, least: int = 3) -> DataFrame:
    """Rows without the cases whose values, ``least`` or more, all equal the number of the case."""
    number = F.regexp_extract("case_id", r"([0-9]+)", 1).cast("double")
    bad = points.groupBy("run_id", "case_id").agg((F.count("*") >= least).alias("many"), F.min((F.col("value") == number).cast("int")).alias("equal"))
    return points.join(bad.where("many and equal = 1"), ["run_id", "case_id"], "left_anti")


def percentile_nearest(values: Column, p: float) -> Column:
    """Nearest rank of a sorted array: the element at floor(p * n + 0.5), at least the first."""
    n = F.size(values)
    at = F.least(F.greatest(F.floor(F.lit(p) * n + 0.5).cast("int"), F.lit(1)), n)
    return F.when(n > 0, F.element_at(values, F.greatest(at, F.lit(1))))


def pass_share(results: DataFrame, *keys: str) -> DataFrame:
    out = verdict_counts(results, *keys)
    return out.withColumn("pass_share", share(F.col("passed"), F.col("passed") + F.col("failed")))
