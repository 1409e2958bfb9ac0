import pytest
from pyspark.sql import functions as F

from loomwork.operators import measurements as m
from loomwork.operators.common import null_safe_join


def test_noise_needs_five_values_and_ignores_one_outlier(spark):
    rows = [("few", float(v)) for v in (10, 11, 12, 13)] + [("many", v) for v in (100.0, 101.0, 99.0, 100.5, 99.5, 500.0)]
    got = {r["k"]: r for r in m.noise(spark.createDataFrame(rows, "k string, value double"), ["k"]).collect()}
    assert got["few"]["spread_percent"] is None and got["few"]["threshold_percent"] == 5.0
    assert got["many"]["spread_percent"] < 2 and got["many"]["threshold_percent"] == pytest.approx(max(5.0, 3 * got["many"]["spread_percent"]), abs=1e-3)


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(1, None, "a"), (1, 2, "b")], "k int, c int, x string")
    b = spark.createDataFrame([(1, None, "n"), (1, 3, "m")], "k int, c int, y string")
    assert {(r["x"], r["y"]) for r in null_safe_join(a, b, ["k", "c"], "left").collect()} == {("a", "n"), ("b", None)}


def test_curves_of_two_places_have_no_features(spark):
    rows = [(1, x, v) for x, v in enumerate((5.0, 10.0, 10.0, 4.0, 1.0))] + [(2, 0, 1.0), (2, 1, 2.0)]
    got = m.curve_features(spark.createDataFrame(rows, "c int, sample int, value double"), ["c"]).collect()
    assert [(r["c"], r["peak"], r["peak_at"], r["cliff_at"], r["last"]) for r in got] == [(1, 10.0, 1, 3, 1.0)]


def test_rules_of_notable_changes(spark):
    rows = [("rate", "Mbps", 0.0, 1.0), ("rate", "Mbps", 100.0, 95.0), ("rate", "Mbps", 100.0, 80.0), ("level", "dB", 1.0, 2.0), ("latency", "ms", 1.0, 2.0), ("rate", "Mbps", None, 1.0)]
    table = spark.createDataFrame([("rate", "Mbps", True, "percent", 10.0), ("level", "dB", None, "absolute", 0.5), ("latency", "ms", False, "percent", 20.0)], "metric string, unit string, more_is_better boolean, rule string, threshold double")
    got = m.assess(spark.createDataFrame(rows, "metric string, unit string, before double, after double"), table)
    assert sorted((r["metric"], r["assessment"]) for r in got.collect()) == sorted([("rate", "improvement"), ("rate", "same"), ("rate", "regression"), ("level", "changed"), ("latency", "regression"), ("rate", "added")])


def test_leave_one_out_counts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), (None, 1)], "x string, y int")
    got = {r["dropped"]: (r["n"], r["n_all"]) for r in m.leave_one_out(df, {"x": "a", "y": 1}).collect()}
    assert got == {"x": (3, 1), "y": (2, 1)}


def test_last_value_of_a_repeated_point_wins(spark):
    runs = spark.createDataFrame([(1, 9, "t", "2024-01-01"), (2, 9, "t", "2024-02-01")], "run_id long, product_id long, report_type string, test_date string")
    points = spark.createDataFrame([(1, "m", None, 1.0, "a"), (2, "m", None, 2.0, "a"), (2, "m", None, 3.0, "b")], "run_id long, metric string, band string, value double, cell string")
    got = m.align_last_two(points, runs, ["metric", "band"]).collect()
    assert [(r["before"], r["after"], r["n_before"], r["n_after"]) for r in got] == [(1.0, 3.0, 1, 2)]


def test_nearest_rank(spark):
    one = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    assert one.select(m.percentile_nearest(F.col("v"), 0.5)).first()[0] == 2.0
    assert one.select(m.percentile_nearest(F.col("v"), 0.01)).first()[0] == 1.0
