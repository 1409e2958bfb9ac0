"""Queries over measurements, runs and verdicts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import measurements as m
from loomwork.operators.common import mean, null_safe_join
from loomwork.plans import sqltext as sql
from loomwork.plans.registry import query

ROLES = ("BUILDING", "MACHINERY", "NATION_3")
_VISIBLE = "published AND list_has_any(roles, ['BUILDING', 'MACHINERY', 'NATION_3'])"
_LAST_TWO = """SELECT run_id, product_id, report_type, firmware, hardware, chipset, test_date, row_number() OVER (PARTITION BY product_id, report_type ORDER BY test_date DESC NULLS LAST, run_id DESC) AS nth FROM run"""
#: Dimensions by which changes are looked at.
POINT = ("metric", "unit", "band", "direction")


def _aligned(dimensions) -> str:
    return f"""pair AS (SELECT * FROM ({_LAST_TWO}) WHERE nth <= 2),
    aligned AS (SELECT product_id, report_type, {", ".join(dimensions)},
      arg_max(value, (cell, value)) FILTER (nth = 1) AS after, arg_max(value, (cell, value)) FILTER (nth = 2) AS before, count(*) FILTER (nth = 1) AS n_after, count(*) FILTER (nth = 2) AS n_before
      FROM measurement JOIN pair USING (run_id) GROUP BY ALL)"""


_ALIGNED = _aligned(POINT)


def _stats_sql(series: str, where: str) -> str:
    return f"""SELECT product_id, metric, unit, {series}, count(*) AS n, {sql.rounded(sql.exact_sum("value"))} AS total, {sql.mean("value", 4)} AS average, min(value) AS minimum, max(value) AS maximum,
        {sql.rounded("quantile_cont(value, 0.5)", 4)} AS median, {sql.rounded("quantile_cont(value, 0.95)", 4)} AS p95, min(sample) AS first_no, max(sample) AS last_no,
        CASE WHEN count(*) <= 10 THEN array_to_string(list(value ORDER BY sample, cell, value), ',') END AS value_list
        FROM measurement JOIN run USING (run_id) WHERE {where} GROUP BY product_id, metric, unit, {series}"""


@query(_stats_sql("band, width, direction", _VISIBLE))
def agg_measurement_stats(t):
    """Grouped statistics of the runs that three roles may read."""
    return m.measurement_stats(t.measurement, m.visible(t.run, ROLES), m.series_of("high"))


@query(_stats_sql("band, width", "published AND report_type = 'low'"))
def agg_series_policy(t):
    """Statistics of one report type, grouped as its policy demands."""
    return m.measurement_stats(t.measurement, t.run.where("published and report_type = 'low'"), m.series_of("low"))


@query(_stats_sql("band, width, direction, channel", "published AND report_type = 'not specified'"))
def agg_series_unknown_type(t):
    """A report type without a policy is grouped by every series column."""
    return m.measurement_stats(t.measurement, t.run.where("published and report_type = 'not specified'"), m.series_of("not specified"))


@query(f"SELECT product_id, metric, {sql.mean("value", 4)} AS average, count(*) AS n FROM measurement JOIN run USING (run_id) WHERE {_VISIBLE} GROUP BY ALL")
def join_measure_run(t):
    rows = t.measurement.join(m.visible(t.run, ROLES).select("run_id", "product_id"), "run_id")
    return rows.groupBy("product_id", "metric").agg(mean("value").alias("average"), F.count("*").alias("n"))


@query(f"""SELECT report_type, metric, unit, array_to_string(list_sort(list(DISTINCT band)), ',') AS bands, array_to_string(list_sort(list(DISTINCT CAST(width AS VARCHAR))), ',') AS widths,
    array_to_string(list_sort(list(DISTINCT CAST(channel AS VARCHAR)) FILTER (channel IS NOT NULL)), ',') AS channels, array_to_string(list_sort(list(DISTINCT direction) FILTER (direction IS NOT NULL)), ',') AS directions,
    bool_or(sample IS NOT NULL) AS numbered, count(DISTINCT case_id) AS n_cases, any_value(more_is_better) AS more_is_better
    FROM measurement JOIN run USING (run_id) LEFT JOIN dictionary USING (metric, unit) GROUP BY ALL""")
def agg_catalog(t):
    return m.catalog(t.measurement, t.run, t.dictionary)


@query(f"SELECT metric, d.unit AS unit, more_is_better, count(*) AS n FROM measurement LEFT JOIN dictionary d USING (metric, unit) GROUP BY ALL")
def join_dictionary(t):
    rows = t.measurement.join(F.broadcast(t.dictionary), ["metric", "unit"], "left")
    return rows.groupBy("metric", "unit", "more_is_better").agg(F.count("*").alias("n"))


@query(f"SELECT report_type, count(*) AS n FROM measurement JOIN run USING (run_id) WHERE published AND metric = 'rate' AND band = 'A' GROUP BY ALL")
def agg_count_by_type(t):
    rows = m.optional_filters(t.measurement, metric="rate", band="A", width=None).join(t.run.where("published").select("run_id", "report_type"), "run_id")
    return rows.groupBy("report_type").agg(F.count("*").alias("n"))


@query(f"""SELECT dropped, n, n_all FROM (SELECT count(*) FILTER (metric = 'rate' AND band = 'A' AND width = 20 AND direction = 'F') AS n_all,
    count(*) FILTER (band = 'A' AND width = 20 AND direction = 'F') AS a, count(*) FILTER (metric = 'rate' AND width = 20 AND direction = 'F') AS b,
    count(*) FILTER (metric = 'rate' AND band = 'A' AND direction = 'F') AS c, count(*) FILTER (metric = 'rate' AND band = 'A' AND width = 20) AS d FROM measurement),
    LATERAL (VALUES ('metric', a), ('band', b), ('width', c), ('direction', d)) v(dropped, n)""")
def agg_no_match_hint(t):
    return m.leave_one_out(t.measurement, {"metric": "rate", "band": "A", "width": 20, "direction": "F"})


@query(f"""SELECT product_id, count(*) AS n, {sql.mean("value", 4)} AS average, min(value) AS minimum, max(value) AS maximum, array_to_string(list_sort(list(DISTINCT sheet)), ',') AS sheets,
    count(DISTINCT unit) <= 1 AS comparable FROM measurement JOIN run USING (run_id) WHERE metric = 'rate' GROUP BY product_id""")
def agg_compare_metric(t):
    return m.compare_metric(t.measurement, t.run, "rate")


@query(f"SELECT c_custkey AS product_id FROM customer WHERE c_custkey NOT IN (SELECT product_id FROM run JOIN measurement USING (run_id))")
def agg_compare_missing(t):
    """Products without any measurement."""
    have = t.measurement.select("run_id").join(t.run.select("run_id", "product_id"), "run_id").select("product_id").distinct()
    return t["customer"].select(F.col("c_custkey").alias("product_id")).join(have, "product_id", "left_anti")


@query(f"""SELECT band, width, min(value) AS minimum, max(value) AS maximum, any_value(passed) AS passed, any_value(failed) AS failed FROM measurement
    JOIN (SELECT band, width, count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'fail') AS failed FROM result GROUP BY ALL) USING (band, width) WHERE metric = 'rate' GROUP BY band, width""")
def agg_overview_band(t):
    span = t.measurement.where("metric = 'rate'").groupBy("band", "width").agg(F.min("value").alias("minimum"), F.max("value").alias("maximum"))
    tally = m.verdict_counts(t.result, "band", "width").select("band", "width", "passed", "failed")
    return null_safe_join(span, tally, ["band", "width"])


_VERDICT = "CASE WHEN count(*) FILTER (verdict = 'pass') > 0 AND count(*) FILTER (verdict = 'fail') > 0 THEN 'mixed' WHEN count(*) FILTER (verdict = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (verdict = 'pass') > 0 THEN 'pass' ELSE 'n/a' END"


@query(f"SELECT run_id, case_id, count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'fail') AS failed, count(*) AS items, {_VERDICT} AS verdict FROM result GROUP BY run_id, case_id")
def agg_verdict_rollup(t):
    return m.verdict_counts(t.result, "run_id", "case_id")


@query(f"""SELECT band, width, direction, count(*) AS n, {sql.rounded("quantile_cont(value, 0.5)", 4)} AS median, min(value) AS minimum, max(value) AS maximum FROM (
    SELECT run_id, case_id, band, width, direction, channel, arg_max(value, (sample, cell, value)) AS value FROM measurement WHERE metric = 'rate' GROUP BY ALL) GROUP BY band, width, direction""")
def agg_throughput_scope(t):
    return m.throughput_scope(t.measurement.where("metric = 'rate'"))


@query(f"""WITH one AS (SELECT run_id, band, sample, max(value) AS value FROM measurement WHERE metric = 'rate' GROUP BY ALL),
    p AS (SELECT *, max(value) OVER w AS peak FROM one WINDOW w AS (PARTITION BY run_id, band)),
    q AS (SELECT *, min(CASE WHEN value = peak THEN sample END) OVER (PARTITION BY run_id, band) AS peak_at FROM p)
    SELECT run_id, band, count(*) AS places, max(peak) AS peak, max(peak_at) AS peak_at, min(CASE WHEN sample > peak_at AND value < peak / 2 THEN sample END) AS cliff_at,
    {sql.mean("value", 4)} AS average, arg_max(value, sample) AS last FROM q GROUP BY run_id, band HAVING count(*) >= 3""")
def agg_curve_features(t):
    return m.curve_features(t.measurement.where("metric = 'rate'"), ["run_id", "band"])


_HISTORY = f"SELECT product_id, metric, band, run_id, {sql.mean("value", 6)} AS value FROM measurement JOIN run USING (run_id) GROUP BY ALL"


@query(f"""WITH h AS ({_HISTORY}), a AS (SELECT product_id, metric, band, count(*) AS n, quantile_cont(value, 0.5) AS middle, mad(value) AS mad FROM h GROUP BY ALL)
    SELECT product_id, metric, band, n, {sql.rounded("middle", 4)} AS middle, {sql.rounded("CASE WHEN n >= 5 AND middle <> 0 THEN 1.4826 * mad / abs(middle) * 100 END", 4)} AS spread_percent,
    {sql.rounded("greatest(5.0, coalesce(CASE WHEN n >= 5 AND middle <> 0 THEN 3 * (1.4826 * mad / abs(middle) * 100) END, 0.0))", 4)} AS threshold_percent FROM a""")
def agg_noise_mad(t):
    rows = t.measurement.join(t.run.select("run_id", "product_id"), "run_id")
    history = rows.groupBy("product_id", "metric", "band", "run_id").agg(mean("value", 6).alias("value"))
    return m.noise(history, ["product_id", "metric", "band"])


@query(f"WITH {_aligned(m.DIMENSIONS)} SELECT * FROM aligned")
def join_align_runs(t):
    """The points of the last two runs of each product side by side."""
    return m.align_last_two(t.measurement, t.run)


_ASSESSED = f"""{_ALIGNED}, d AS (SELECT *, {sql.rounded("after - before", 4)} AS delta, {sql.rounded("CASE WHEN before <> 0 THEN (after - before) / abs(before) * 100 END", 4)} AS percent FROM aligned LEFT JOIN dictionary USING (metric, unit)),
    assessed AS (SELECT *, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed'
    WHEN NOT coalesce(CASE WHEN rule = 'absolute' THEN abs(delta) >= threshold WHEN before = 0 THEN delta <> 0 ELSE abs(percent) >= threshold END, false) THEN 'same'
    WHEN more_is_better IS NULL THEN 'changed' WHEN (delta > 0) = more_is_better THEN 'improvement' ELSE 'regression' END AS assessment FROM d)"""


@query(f"WITH {_ASSESSED} SELECT * FROM assessed")
def q_compare_runs(t):
    """The last two runs of each product: change of every point and what it means."""
    return m.assess(m.align_last_two(t.measurement, t.run, POINT), t.dictionary)


@query(f"WITH {_ASSESSED} SELECT report_type, metric, assessment, count(*) AS n, {sql.mean("abs(percent)", 4)} AS mean_percent, count(*) FILTER (n_after > 1 OR n_before > 1) AS repeated FROM assessed GROUP BY ALL")
def agg_run_compare(t):
    """How many points got better or worse, by report type and metric."""
    both = m.assess(m.align_last_two(t.measurement, t.run, POINT), t.dictionary)
    return both.groupBy("report_type", "metric", "assessment").agg(
        F.count("*").alias("n"), mean(F.abs("percent")).alias("mean_percent"), F.count_if(F.expr("n_after > 1 or n_before > 1")).alias("repeated")
    )


@query(f"""WITH pair AS (SELECT * FROM ({_LAST_TWO}) WHERE nth <= 2) SELECT *, firmware_differs + hardware_differs + chipset_differs AS n_differ, firmware_differs + hardware_differs + chipset_differs > 1 AS confounded FROM (
    SELECT product_id, report_type, count(*) AS n_runs, CAST(count(DISTINCT coalesce(firmware, 'None')) > 1 AS INT) AS firmware_differs, CAST(count(DISTINCT coalesce(hardware, 'None')) > 1 AS INT) AS hardware_differs,
    CAST(count(DISTINCT coalesce(chipset, 'None')) > 1 AS INT) AS chipset_differs FROM pair GROUP BY ALL) WHERE n_runs = 2""")
def agg_confounded(t):
    return m.confounded(t.run, ["firmware", "hardware", "chipset"])


@query(f"""WITH {_ALIGNED}, f AS (SELECT product_id, report_type, metric, band, direction, count(*) AS n, count(*) FILTER (after > before) AS up, count(*) FILTER (after < before) AS down,
    {sql.rounded("quantile_cont(after - before, 0.5)", 4)} AS median_change, {sql.rounded("quantile_cont(before, 0.5)", 4)} AS median_before FROM aligned WHERE after IS NOT NULL AND before IS NOT NULL GROUP BY ALL),
    g AS (SELECT *, {sql.rounded("abs(median_change) / nullif(abs(median_before), 0)", 6)} AS magnitude FROM f)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, report_type ORDER BY magnitude DESC NULLS LAST, metric, band NULLS FIRST, direction NULLS FIRST) AS place FROM g) WHERE place <= 8""")
def q_findings(t):
    return m.findings(m.align_last_two(t.measurement, t.run, POINT), top=8)


@query(f"""WITH {_ALIGNED} SELECT product_id, report_type, count(*) FILTER (after > before * 1.05) AS up, count(*) FILTER (after < before * 0.95) AS down,
    count(*) FILTER (after <= before * 1.05 AND after >= before * 0.95) AS within, count(*) AS common FROM aligned WHERE metric = 'rate' AND after IS NOT NULL AND before IS NOT NULL GROUP BY ALL""")
def agg_channel_agreement(t):
    """Of the points that both runs have, how many moved up, down or stayed within five percent."""
    both = m.align_last_two(t.measurement.where("metric = 'rate'"), t.run, POINT).where("after is not null and before is not null")
    return both.groupBy("product_id", "report_type").agg(
        F.count_if(F.expr("after > before * 1.05D")).alias("up"), F.count_if(F.expr("after < before * 0.95D")).alias("down"),
        F.count_if(F.expr("after <= before * 1.05D and after >= before * 0.95D")).alias("within"), F.count("*").alias("common"),
    )


@query(f"""WITH pair AS (SELECT * FROM ({_LAST_TWO}) WHERE nth <= 2), total AS (SELECT product_id, report_type, count(*) AS n_runs FROM pair GROUP BY ALL)
    SELECT product_id, report_type, band, width, count(DISTINCT run_id) AS n_with, any_value(n_runs) AS n_runs, count(DISTINCT run_id) = any_value(n_runs) AS in_all
    FROM measurement JOIN pair USING (run_id) JOIN total USING (product_id, report_type) GROUP BY product_id, report_type, band, width""")
def agg_focus_intersection(t):
    return m.scope_coverage(t.measurement, t.run, ["band", "width"])


@query(f"""WITH pair AS (SELECT * FROM ({_LAST_TWO}) WHERE nth <= 2), total AS (SELECT product_id, report_type, count(*) AS n_runs FROM pair GROUP BY ALL)
    SELECT product_id, report_type, case_id FROM measurement JOIN pair USING (run_id) JOIN total USING (product_id, report_type) GROUP BY ALL HAVING count(DISTINCT run_id) = any_value(n_runs)""")
def set_intersect_scopes(t):
    """Cases that every one of the compared runs has."""
    return m.scope_coverage(t.measurement, t.run, ["case_id"]).where("in_all").select("product_id", "report_type", "case_id")


@query(f"""SELECT sheet, band, count(*) AS n, array_to_string(list_sort(list(DISTINCT CAST(value AS VARCHAR))), ',') AS value_set, array_to_string(list_sort(list(DISTINCT cell))[1:4], ' ') AS first_cells
    FROM measurement WHERE metric = 'level' AND value >= 0.07 GROUP BY sheet, band""")
def agg_error_summary(t):
    """Rows over the limit by sheet and state: count, values and the first four cells."""
    bad = t.measurement.where("metric = 'level' and value >= 0.07D")
    values = bad.groupBy("sheet", "band").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set(F.col("value").cast("string"))), ",").alias("value_set"))
    place = F.row_number().over(Window.partitionBy("sheet", "band").orderBy("cell"))
    first = bad.select("sheet", "band", "cell").distinct().withColumn("n_", place).where("n_ <= 4")
    first = first.groupBy("sheet", "band").agg(F.array_join(F.array_sort(F.collect_list("cell")), " ").alias("first_cells"))
    return null_safe_join(values, first, ["sheet", "band"], "left")


@query(f"""WITH v AS (SELECT run_id, band, width, channel, max(CASE verdict WHEN 'fail' THEN 2 WHEN 'pass' THEN 1 ELSE 0 END) AS worst FROM result GROUP BY ALL)
    SELECT r.run_id, r.metric, r.band, r.width, r.channel, r.n, CASE worst WHEN 2 THEN 'fail' WHEN 1 THEN 'pass' WHEN 0 THEN 'n/a' END AS verdict
    FROM (SELECT run_id, metric, band, width, channel, count(*) AS n FROM measurement WHERE metric = 'rate' GROUP BY ALL) r LEFT JOIN v
    ON r.run_id = v.run_id AND r.band IS NOT DISTINCT FROM v.band AND r.width IS NOT DISTINCT FROM v.width AND r.channel IS NOT DISTINCT FROM v.channel""")
def join_result_verdict(t):
    """Verdicts of channels beside their measurements; a missing channel matches a missing one."""
    keys = ["run_id", "band", "width", "channel"]
    worst = F.max(F.when(F.col("verdict") == "fail", 2).when(F.col("verdict") == "pass", 1).otherwise(0)).alias("worst")
    verdicts = t.result.groupBy(*keys).agg(worst)
    rows = t.measurement.where("metric = 'rate'").groupBy("run_id", "metric", "band", "width", "channel").agg(F.count("*").alias("n"))
    out = null_safe_join(rows, verdicts, keys, "left")
    return out.withColumn("verdict", F.when(F.col("worst") == 2, "fail").when(F.col("worst") == 1, "pass").when(F.col("worst") == 0, "n/a")).drop("worst")


@query(f"""WITH pair AS (SELECT * FROM ({_LAST_TWO}) WHERE nth <= 2)
    SELECT product_id, report_type, case_id, band, width, channel, max(CASE WHEN nth = 1 THEN verdict END) AS after, max(CASE WHEN nth = 2 THEN verdict END) AS before FROM result JOIN pair USING (run_id) GROUP BY ALL""")
def join_align_results(t):
    pair = m.ranked_runs(t.run, 2).select("run_id", "product_id", "report_type", "nth")
    side = lambda n: F.max(F.when(F.col("nth") == n, F.col("verdict")))
    return t.result.join(pair, "run_id").groupBy("product_id", "report_type", "case_id", "band", "width", "channel").agg(side(1).alias("after"), side(2).alias("before"))


@query(f"""WITH pair AS (SELECT * FROM ({_LAST_TWO}) WHERE nth <= 2)
    SELECT product_id, report_type, case_id, band, max(CASE WHEN nth = 1 THEN criterion END) AS after, max(CASE WHEN nth = 2 THEN criterion END) AS before FROM result JOIN pair USING (run_id) GROUP BY ALL""")
def join_align_criteria(t):
    pair = m.ranked_runs(t.run, 2).select("run_id", "product_id", "report_type", "nth")
    side = lambda n: F.max(F.when(F.col("nth") == n, F.col("criterion")))
    return t.result.join(pair, "run_id").groupBy("product_id", "report_type", "case_id", "band").agg(side(1).alias("after"), side(2).alias("before"))


@query(f"""WITH pair AS (SELECT * FROM ({_LAST_TWO}) WHERE nth <= 2),
    c AS (SELECT product_id, report_type, nth, unnest(['firmware', 'hardware', 'chipset']) AS name, unnest([firmware, hardware, chipset]) AS val FROM pair)
    SELECT product_id, report_type, name, max(val) FILTER (nth = 1) AS after, max(val) FILTER (nth = 2) AS before, max(val) FILTER (nth = 1) IS DISTINCT FROM max(val) FILTER (nth = 2) AS differs FROM c GROUP BY product_id, report_type, name""")
def join_conditions_diff(t):
    pair = m.ranked_runs(t.run, 2)
    names = ("firmware", "hardware", "chipset")
    rows = pair.select("product_id", "report_type", "nth", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("val")) for n in names])).alias("c"))
    side = lambda n: F.max(F.when(F.col("nth") == n, F.col("c.val")))
    out = rows.groupBy("product_id", "report_type", F.col("c.name").alias("name")).agg(side(1).alias("after"), side(2).alias("before"))
    return out.withColumn("differs", ~F.col("after").eqNullSafe(F.col("before")))


@query(f"""SELECT * FROM (SELECT run_id, product_id, report_type, test_date, row_number() OVER (PARTITION BY product_id, report_type ORDER BY test_date DESC NULLS LAST, run_id DESC) AS nth FROM run WHERE published) WHERE nth <= 20""")
def win_history_limit(t):
    """The twenty newest published runs of each product and report type."""
    return m.ranked_runs(t.run.where("published"), 20).select("run_id", "product_id", "report_type", "test_date", "nth")


@query(f"""SELECT m.* FROM measurement m WHERE NOT EXISTS (SELECT 1 FROM (SELECT run_id, case_id FROM measurement GROUP BY ALL
    HAVING count(*) >= 3 AND bool_and(value = CAST(regexp_extract(case_id, '([0-9]+)', 1) AS DOUBLE))) b WHERE b.run_id = m.run_id AND b.case_id = m.case_id)""")
def flt_placeholder_cases(t):
    return m.placeholder_cases(t.measurement)


@query(f"""SELECT product_id, count(*) AS n FROM run WHERE published AND list_has_any(roles, ['BUILDING', 'NATION_3']) GROUP BY product_id""")
def flt_acl_overlap(t):
    return m.visible(t.run, ["BUILDING", "NATION_3"]).groupBy("product_id").agg(F.count("*").alias("n"))


@query(f"SELECT m.* FROM measurement m JOIN run USING (run_id) WHERE published AND metric = 'rate' AND band IN ('A', 'R') AND width = 80")
def flt_optional_params(t):
    rows = m.optional_filters(t.measurement, metric="rate", band=["A", "R"], width=80, channel=None, direction=None, case_id=None)
    return rows.join(t.run.where("published").select("run_id"), "run_id", "left_semi")


@query(f"SELECT metric, direction, count(*) AS n FROM measurement WHERE direction = 'O' OR direction IS NULL GROUP BY ALL")
def flt_statistic_null(t):
    """The default statistic also matches rows that name none."""
    return t.measurement.where("direction = 'O' or direction is null").groupBy("metric", "direction").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT product_id, model FROM run")
def agg_distinct_values(t):
    return t.run.select("product_id", "model").distinct()


@query(f"""WITH e AS (SELECT DISTINCT product_id, model, lower(model) = 'customer#000000010' AS exact FROM run WHERE contains(lower(model), 'customer#00000001'))
    SELECT product_id, model FROM e WHERE exact OR NOT EXISTS (SELECT 1 FROM e WHERE exact)""")
def flt_ilike_product(t):
    """The product of that very name, whatever its case; without one, all that contain it."""
    some = t.run.select("product_id", "model", (F.lower("model") == "customer#000000010").alias("exact")).where(F.contains(F.lower("model"), F.lit("customer#00000001"))).distinct()
    any_exact = some.agg(F.coalesce(F.max("exact"), F.lit(False)).alias("any"))
    return some.join(F.broadcast(any_exact), F.col("exact") | ~F.col("any")).select("product_id", "model")


@query(f"""WITH s AS (SELECT run_id, case_id, band, width, count(DISTINCT channel) AS channels FROM measurement GROUP BY ALL)
    SELECT run_id, band, width, CASE WHEN channels > 1 THEN case_id || '/' || channels ELSE case_id END AS case_label, channels > 1 AS parted FROM s""")
def q_separate_cases(t):
    """One condition used by several channels gets labels of its own."""
    s = t.measurement.groupBy("run_id", "case_id", "band", "width").agg(F.count_distinct("channel").alias("channels"))
    label = F.when(F.col("channels") > 1, F.concat_ws("/", "case_id", F.col("channels").cast("string"))).otherwise(F.col("case_id"))
    return s.select("run_id", "band", "width", label.alias("case_label"), (F.col("channels") > 1).alias("parted"))


@query(f"""SELECT product_id, metric, CAST(count(*) AS BIGINT) AS n, {sql.rounded("list_sort(list(value))[CAST(least(greatest(floor(0.95 * count(*) + 0.5), 1), count(*)) AS INT)]", 4)} AS p95_nearest,
    {sql.rounded("list_sort(list(value))[CAST(count(*) // 2 + 1 AS INT)]", 4)} AS upper_median, {sql.rounded("quantile_cont(value, 0.95)", 4)} AS p95_cont FROM measurement JOIN run USING (run_id) GROUP BY ALL""")
def agg_percentile_kinds(t):
    """Three named percentiles: interpolated, nearest rank and upper median, from ranks in a sorted window."""
    rows = t.measurement.join(t.run.select("run_id", "product_id"), "run_id")
    own = Window.partitionBy("product_id", "metric")
    at = rows.select("product_id", "metric", "value", F.row_number().over(own.orderBy("value")).alias("r"), F.count("*").over(own).alias("n"))
    rank = F.least(F.greatest(F.floor(0.95 * F.col("n") + 0.5), F.lit(1)), F.col("n"))
    return at.groupBy("product_id", "metric").agg(
        F.count("*").alias("n"), F.round(F.max(F.when(F.col("r") == rank, F.col("value"))), 4).alias("p95_nearest"),
        F.round(F.max(F.when(F.col("r") == F.floor(F.col("n") / 2) + 1, F.col("value"))), 4).alias("upper_median"), F.round(F.percentile("value", 0.95), 4).alias("p95_cont"),
    )


@query(f"""SELECT run_id, product_id, CASE WHEN firmware IS NULL OR hardware IS NULL THEN 'incomplete' WHEN NOT published THEN 'draft' ELSE 'ok' END AS reason FROM run
    WHERE NOT EXISTS (SELECT 1 FROM measurement m WHERE m.run_id = run.run_id AND m.metric = 'rate')""")
def join_anti_reject(t):
    """Runs without any rate, and the first reason that holds them back."""
    out = t.run.join(t.measurement.where("metric = 'rate'").select("run_id"), "run_id", "left_anti")
    reason = F.when(F.col("firmware").isNull() | F.col("hardware").isNull(), "incomplete").when(~F.col("published"), "draft").otherwise("ok")
    return out.select("run_id", "product_id", reason.alias("reason"))


@query(f"""SELECT run_id, band, width, CAST(nullif(channel, -1) AS BIGINT) AS channel, A AS rate, B AS latency, C AS quantity FROM (SELECT run_id, band, width, coalesce(channel, -1) AS channel,
    {sql.mean("value", 4, "metric = 'rate'")} AS A, {sql.mean("value", 4, "metric = 'latency'")} AS B, {sql.mean("value", 4, "metric = 'quantity'")} AS C FROM measurement GROUP BY ALL)""")
def q_render_tables(t):
    """Channel table: one row a channel, one column a metric."""
    wide = t.measurement.groupBy("run_id", "band", "width", "channel").pivot("metric", ["rate", "latency", "quantity"]).agg(mean("value"))
    return wide


@query(f"""SELECT run_id, metric, count(*) AS points, array_to_string(list(CAST(v AS VARCHAR) ORDER BY sample), ',') AS series FROM (SELECT run_id, metric, sample, {sql.mean("value", 2)} AS v FROM measurement WHERE metric = 'rate' GROUP BY ALL) GROUP BY ALL HAVING count(*) >= 4""")
def q_render_charts(t):
    """Sweep series of four or more samples, in order; a run has at most a few samples."""
    point = t.measurement.where("metric = 'rate'").groupBy("run_id", "metric", "sample").agg(mean("value", 2).alias("v"))
    s = point.groupBy("run_id", "metric").agg(F.count("*").alias("points"), F.array_sort(F.collect_list(F.struct("sample", "v"))).alias("s"))
    return s.where("points >= 4").select("run_id", "metric", "points", F.array_join(F.transform("s", lambda x: x["v"].cast("string")), ",").alias("series"))


@query(f"""WITH c AS (SELECT case_id, report_type, {sql.mean("value", 2)} AS v FROM measurement JOIN run USING (run_id) WHERE metric = 'rate' GROUP BY ALL)
    SELECT case_id, max(v) FILTER (report_type = 'low') AS low, max(v) FILTER (report_type = 'medium') AS medium, max(v) FILTER (report_type = 'high') AS high, max(v) FILTER (report_type = 'urgent') AS urgent,
    arg_max(report_type, (v, report_type)) AS best, arg_min(report_type, (v, report_type)) AS worst FROM c GROUP BY case_id""")
def q_case_compare_table(t):
    """Cases by report type, with the best and worst of each case."""
    rows = t.measurement.where("metric = 'rate'").join(t.run.select("run_id", "report_type"), "run_id")
    c = rows.groupBy("case_id", "report_type").agg(mean("value", 2).alias("v"))
    of = lambda k: F.max(F.when(F.col("report_type") == k, F.col("v"))).alias(k)
    pick = F.struct("v", "report_type")
    return c.groupBy("case_id").agg(*[of(k) for k in ("low", "medium", "high", "urgent")], F.max_by("report_type", pick).alias("best"), F.min_by("report_type", pick).alias("worst"))


@query(f"""WITH n AS (SELECT model, report_type, product_id FROM run GROUP BY ALL) SELECT report_type, product_id, CASE WHEN count(*) OVER (PARTITION BY report_type, left(model, 15)) > 1
    THEN model || ' (' || product_id || ')' ELSE model END AS label FROM n""")
def q_projects_of(t):
    """Labels of products; where several share one, the id is added."""
    n = t.run.select("model", "report_type", "product_id").distinct()
    many = F.count("*").over(Window.partitionBy("report_type", F.substring("model", 1, 15))) > 1
    return n.select("report_type", "product_id", F.when(many, F.concat("model", F.lit(" ("), F.col("product_id").cast("string"), F.lit(")"))).otherwise(F.col("model")).alias("label"))


@query(f"""SELECT item, count(*) FILTER (verdict = 'pass') AS passed, count(*) FILTER (verdict = 'fail') AS failed, count(*) AS items, CASE WHEN count(*) FILTER (verdict = 'pass') > 0 AND count(*) FILTER (verdict = 'fail') > 0 THEN 'mixed'
    WHEN count(*) FILTER (verdict = 'fail') > 0 THEN 'fail' WHEN count(*) FILTER (verdict = 'pass') > 0 THEN 'pass' ELSE 'n/a' END AS verdict,
    {sql.rounded("count(*) FILTER (verdict = 'pass') / nullif(count(*) FILTER (verdict IN ('pass', 'fail')), 0)", 4)} AS pass_share FROM result GROUP BY item""")
def agg_item_pass_share(t):
    return m.pass_share(t.result, "item")


@query(f"SELECT run_id, product_id, test_date FROM run WHERE published ORDER BY test_date DESC NULLS LAST, run_id LIMIT 200")
def lim_clamp(t):
    """A wish for 5000 rows is cut to the most that is given, 200."""
    return t.run.where("published").select("run_id", "product_id", "test_date").orderBy(F.desc_nulls_last("test_date"), "run_id").limit(max(1, min(5000, 200)))


@query(f"""SELECT run_id, band, n, count(*) OVER () > 400 AS truncated FROM (SELECT run_id, band, count(*) AS n FROM measurement GROUP BY ALL ORDER BY n DESC, run_id, band LIMIT 401) QUALIFY row_number() OVER (ORDER BY n DESC, run_id, band) <= 400""")
def lim_truncated(t):
    """At most 400 rows, and whether there were more: one row more is asked for."""
    rows = t.measurement.groupBy("run_id", "band").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "run_id", "band").limit(401)
    place = F.row_number().over(Window.orderBy(F.desc("n"), "run_id", "band"))
    marked = rows.withColumn("truncated", F.count("*").over(Window.partitionBy(F.lit(1))) > 400).withColumn("_n", place)
    return marked.where("_n <= 400").drop("_n")


@query(f"""SELECT row_number() OVER (ORDER BY coalesce(CAST(channel AS VARCHAR), ''), coalesce(direction, ''), width) AS place, channel, direction, width, count(*) AS n FROM measurement GROUP BY channel, direction, width""")
def srt_none_as_empty(t):
    """Keys sorted as text, null as empty: 100 comes before 20."""
    g = t.measurement.groupBy("channel", "direction", "width").agg(F.count("*").alias("n"))
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return g.withColumn("place", F.row_number().over(Window.orderBy(text("channel"), text("direction"), "width")).cast("bigint"))


@query(f"""SELECT row_number() OVER (ORDER BY channel DESC NULLS LAST, band NULLS FIRST) AS place, channel, band, count(*) AS n FROM measurement GROUP BY channel, band""")
def srt_nulls(t):
    g = t.measurement.groupBy("channel", "band").agg(F.count("*").alias("n"))
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("channel"), F.asc_nulls_first("band"))).cast("bigint"))


@query(f"SELECT 'shipped' AS label, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at, count(*) AS n FROM lineitem UNION ALL SELECT 'ordered', min(o_orderdate), max(o_orderdate), count(*) FROM orders")
def src_sql(t):
    """Rows of a query with named parameters over a registered table."""
    text = "SELECT :label AS label, min({column}) AS first_at, max({column}) AS last_at, count(*) AS n FROM {rows}"
    shipped = t.spark.sql(text, args={"label": "shipped"}, column=F.col("l_shipdate"), rows=t["lineitem"])
    return shipped.unionAll(t.spark.sql(text, args={"label": "ordered"}, column=F.col("o_orderdate"), rows=t["orders"]))
