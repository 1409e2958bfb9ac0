import math
import random

import numpy as np

from loomwork.operators.selection import quantiles


def check(spark, groups, ps, few):
    rows = [(k, v) for k, values in groups.items() for v in values]
    random.Random(1).shuffle(rows)
    got = {r["k"]: (r["n"], r["q"]) for r in quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", ps, few).collect()}
    want = {k: [x for x in v if x is not None and not math.isnan(x)] for k, v in groups.items()}
    assert set(got) == {k for k, v in want.items() if v}
    for k, (n, q) in got.items():
        assert n == len(want[k])
        assert np.allclose(q, np.quantile(want[k], ps), rtol=1e-12, atol=1e-12), (k, q)


def test_quantiles_equal_numpy(spark):
    rng = random.Random(3)
    groups = {
        "small": [1.0, 2.0, 10.0], "one": [5.0], "nulls": [None, 3.0, float("nan"), 4.0], "none": [None],
        "normal": [rng.gauss(0, 1) for _ in range(2000)], "steps": [float(rng.randrange(4)) for _ in range(1500)],
        "spread": [10.0 ** rng.uniform(-200, 200) * rng.choice([-1, 1]) for _ in range(2000)], None: [float(x) for x in range(1500)],
        "same": [7.5] * 2500, "outlier": [rng.random() for _ in range(2000)] + [1e300, -1e300],
    }
    check(spark, groups, [0.0, 0.5, 0.95, 1.0], 150)


def test_one_round_and_ties_at_edges(spark):
    check(spark, {"a": [1.0] * 99 + [2.0] * 101, "b": [0.0] * 10}, [0.25, 0.5, 0.75], 20)
    check(spark, {"a": [float(i) for i in range(300)]}, [0.5, 0.95], 4096)


def test_no_rows(spark):
    assert quantiles(spark.createDataFrame([], "k string, v double"), ["k"], "v", [0.5]).count() == 0
