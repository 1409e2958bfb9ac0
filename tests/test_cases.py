import random

from loomwork.operators import cases as cs

METRICS = (
    cs.Metric("dl", "Downlink", (("peak", 3), ("avg", 4), ("bler", 5)), "avg"),
    cs.Metric("rtt", "RTT (ms)", (("min", 0), ("avg", 1), ("max", 2), ("loss", 3)), "avg", more_is_better=False, after="Latency Test"),
)

TEXT = """## Case 4
| Item | a | b | c | Peak | Avg | BLER |
| --- | --- | --- | --- | --- | --- | --- |
|  Downlink | x | y | z | 1,200.5 | 900 | 0.1 |
| Downlink | x | y | z | 1 | 2 | 3 |
| RTT (ms) | 9 | 9 | 9 | 9 |
Latency Test
| RTT (ms) | 1 | n/a | 3 | |
"""


def test_cells_by_row_label(spark):
    sections = spark.createDataFrame([("p", 4, TEXT), ("q", 5, "no table"), ("r", 6, "| RTT (ms) | 7 | 8 |"), ("s", 7, None)], "project string, case_id int, text string")
    got = cs.case_cells(sections, ["project", "case_id"], "text", METRICS).collect()
    assert {(r["project"], r["metric"], r["field"], r["cell"], r["number"]) for r in got} == {
        ("p", "dl", "peak", "1,200.5", 1200.5), ("p", "dl", "avg", "900", 900.0), ("p", "dl", "bler", "0.1", 0.1),
        ("p", "rtt", "min", "1", 1.0), ("p", "rtt", "avg", "n/a", None), ("p", "rtt", "max", "3", 3.0),
        ("r", "rtt", "min", "7", 7.0), ("r", "rtt", "avg", "8", 8.0),
    }


def greedy(pairs):
    a, b, out = set(), set(), set()
    for s, x, y in sorted((-s, x, y) for x, y, s in pairs):
        if x not in a and y not in b:
            a.add(x), b.add(y), out.add((x, y, -s))
    return out


def test_one_to_one_equals_the_greedy_order(spark):
    rng = random.Random(5)
    pairs = [(f"a{x}", f"b{y}", rng.choice([0.5, 0.6, 0.75, 1.0])) for x in range(25) for y in range(25) if rng.random() < 0.3]
    got = {tuple(r) for r in cs.one_to_one(spark.createDataFrame(pairs, "a string, b string, alike double")).collect()}
    assert got == greedy(pairs)
    assert cs.one_to_one(spark.createDataFrame([], "a string, b string, alike double")).count() == 0


def test_like_names_equal_all_pairs(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    left = [(f"a{i}", sorted(set(rng.choices(words, k=rng.randint(1, 6))))) for i in range(40)]
    right = [(f"b{i}", sorted(set(rng.choices(words, k=rng.randint(1, 6))))) for i in range(40)]
    got = {(r["a"], r["b"]) for r in cs.like_names(spark.createDataFrame(left, "a string, words array<string>"), spark.createDataFrame(right, "b string, words array<string>"), 0.6).collect()}
    assert got == {(x, y) for x, p in left for y, q in right if len(set(p) & set(q)) / len(set(p) | set(q)) >= 0.6 - 1e-9}


def test_cases_of_projects_are_matched(spark):
    rows = [("A", "1", "TCP downlink near"), ("A", "2", "UDP uplink far"), ("A", "3", "handover xn"), ("B", "1", "anything else"), ("B", "9", "UDP uplink far cell"), ("B", "8", "idle power"),
            ("C", "7", "handover Xn"), ("C", "6", "tcp DOWNLINK near"), ("C", "5", "tcp downlink near again")]
    got = {(r["project"], r["case_id"]): r["matched"] for r in cs.matched_cases(spark.createDataFrame(rows, "project string, case_id string, name string"), "A").collect()}
    assert got == {("A", "1"): "1", ("A", "2"): "2", ("A", "3"): "3", ("B", "1"): "1", ("B", "9"): "2", ("B", "8"): None, ("C", "7"): "3", ("C", "6"): "1", ("C", "5"): None}


def test_projects_are_rows(spark):
    cells = [("1", "A", "dl", "avg", 10.0), ("1", "B", "dl", "avg", 12.0), ("1", "B", "dl", "avg", 14.0), ("1", "C", "dl", "avg", None), ("1", "A", "dl", "peak", 99.0), ("1", "A", "rtt", "avg", 3.0), ("1", "B", "rtt", "avg", 4.0), ("2", "B", "dl", "avg", 1.0)]
    got = cs.compared(spark.createDataFrame(cells, "case_id string, project string, metric string, field string, number double"), METRICS, "A").collect()
    assert {tuple(r) for r in got} == {
        ("1", "dl", "A", 10.0, 1, False, 0.0, "B", "A", 2), ("1", "dl", "B", 13.0, 2, True, 3.0, "B", "A", 2),
        ("1", "rtt", "A", 3.0, 1, False, 0.0, "A", "B", 2), ("1", "rtt", "B", 4.0, 1, False, 1.0, "A", "B", 2), ("2", "dl", "B", 1.0, 1, False, None, None, None, 1),
    }
