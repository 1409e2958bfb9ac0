import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import graphs as g
from loomwork.operators import ledgers as le
from loomwork.operators import ordered as od
from loomwork.operators import retrieval as r


def test_repeated_submissions(spark):
    rows = [(1, "k", "a"), (2, "k", "a"), (3, "k", "b"), (4, "j", None), (5, "j", None)]
    got = le.submissions(spark.createDataFrame(rows, "id int, key string, body string"), ["key"], "body", "id")
    assert [x["state"] for x in got.orderBy("id").collect()] == ["accepted", "repeated", "conflict", "accepted", "repeated"]


def test_a_change_settles_after_two_polls(spark):
    rows = [(1, i, v) for i, v in enumerate("aaabbcbb")]
    got = le.settled(spark.createDataFrame(rows, "k int, i int, m string"), "k", "m", "i", 2).orderBy("i").collect()
    assert [x["settled"] for x in got] == [False, False, False, False, True, False, False, True]


def test_stale_revisions_and_manifests(spark):
    rows = [(1, 1, 5, "x"), (1, 2, 5, "y"), (1, 3, 4, "z"), (1, 4, 6, "w"), (1, 5, 6, "w")]
    df = spark.createDataFrame(rows, "k int, i int, revision int, hash string")
    assert [x["stale"] for x in le.stale(df, ["k"], "revision", "i").orderBy("i").collect()] == [False, True, True, False, True]
    assert [x["state"] for x in le.manifests(df, "k", "i").orderBy("i").collect()] == ["stored", "conflict", "stale", "stored", "same"]


def test_only_current_revisions_are_superseded(spark):
    rows = [(1, "a", "ready", False, True), (1, "b", "published", True, False), (1, "c", "published", False, False), (2, "d", "draft", True, True)]
    got = le.publish(spark.createDataFrame(rows, "k int, r string, status string, is_current boolean, chosen boolean"), "k", F.col("chosen"))
    assert {x["r"]: x["new_status"] for x in got.collect()} == {"a": "published", "b": "superseded", "c": "published", "d": "draft"}


@pytest.fixture(scope="module")
def calls(spark):
    random.seed(2)
    rows = [(i, random.randint(0, 3), float(random.randint(0, 400)), random.random() < 0.6) for i in range(300)]
    return rows, spark.createDataFrame(rows, "id bigint, user_id bigint, at double, failed boolean")


def test_denied_calls_do_not_count(spark, calls):
    rows, df = calls
    want, held = {}, {}
    for i, u, at, _ in sorted(rows, key=lambda x: (x[2], x[0])):
        own = [t for t in held.get(u, []) if at - t < 50]
        want[i] = len(own) < 3
        held[u] = own + [at] * want[i]
    assert {x["id"]: x["granted"] for x in od.rate_limit(df, "user_id", 3, 50).collect()} == want


def test_an_open_circuit_closes_with_time(spark, calls):
    rows, df = calls
    want, state = {}, {}
    for i, u, at, failed in sorted(rows, key=lambda x: (x[2], x[0])):
        n, last = state.get(u, (0, 0.0))
        want[i] = not (n >= 3 and at - last < 20)
        if want[i]:
            state[u] = (n + 1, at) if failed else (0, last)
    assert {x["id"]: x["passed"] for x in od.circuit_breaker(df, "user_id", 3, 20).collect()} == want


def test_components_closures_and_names(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 6), (7, 7)], "a long, b long")
    assert {x["node"]: x["component"] for x in g.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5, 7: 7}
    assert {x["node"] for x in g.reachable(edges, spark.createDataFrame([(3,)], "node long")).collect()} == {1, 2, 3}
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "a string, b string")
    weights = spark.createDataFrame([("a", 1), ("b", 2), ("c", 2)], "name string, weight long")
    assert {(x["name"], x["canonical"]) for x in g.merge_names(pairs, weights).collect()} == {("a", "b"), ("b", "b"), ("c", "b")}


def test_a_closure_has_no_limit_of_steps(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = {(x["start"], x["node"]) for x in g.reachable(chain, spark.createDataFrame([(0,), (150,), (999,)], "node long")).collect()}
    assert got == {(s, n) for s in (0, 150) for n in range(301)} | {(999, 999)}


def test_cap_comes_before_the_hiding_of_copies(spark):
    rows = [(1, "d1", "x", 1), (1, "d1", "y", 2), (1, "d1", "z", 3), (1, "d2", "z", 4), (1, "d3", "x", 5)]
    df = spark.createDataFrame(rows, "question int, doc string, text string, rank int")
    assert [x["rank"] for x in r.greedy_cap(df, "doc", "text", 2, 8).orderBy("rank").collect()] == [1, 2, 4]
    assert [x["rank"] for x in r.cap(r.hide_copies(df, "text"), ["doc"], 2).orderBy("rank").collect()] == [1, 2]


def test_spread_makes_room_for_each_subject(spark):
    rows = [(1, "a", i) for i in range(1, 7)] + [(1, "b", 7), (1, "b", 8)]
    got = r.spread(spark.createDataFrame(rows, "question int, s string, rank int"), "s", 4, 2).collect()
    assert sorted(x["rank"] for x in got) == [1, 2, 7, 8]


def test_nearest_in_blocks(spark):
    v = spark.createDataFrame([(i, [float(i % 7), float(i % 5), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    asked = v.where("vec_id < 9").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))
    whole, parts = r.nearest(v, asked, 5), r.nearest(v, asked, 5, block=2)
    assert {tuple(x) for x in whole.collect()} == {tuple(x) for x in parts.collect()} and whole.count() == 45
