import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from loomwork.operators.names import concept_pairs, sequence_ratio


def plain_ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


def test_sequence_ratio_equals_plain_code(spark):
    rows = [("signal level", "signal levels"), ("", ""), ("", "abc"), ("abc", "cba"), ("Ärger", "ärger"), (None, "abc"), ("abc", None)]
    got = spark.createDataFrame(rows, "a string, b string").withColumn("r", sequence_ratio("a", "b")).collect()
    for r in got:
        want = None if r["a"] is None or r["b"] is None else plain_ratio(r["a"], r["b"])
        assert r["r"] == want


def test_concept_pairs_equal_all_pairs(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(12, 30))).strip() for _ in range(12)]
    names = set(base)
    for name in base:
        for _ in range(5):
            x = list(name)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(x))
                x[at : at + rng.randint(0, 1)] = [rng.choice("abcxyz")]
            names.add("".join(x))
    names = sorted(names)
    docs = spark.createDataFrame([(x,) for x in [*names, None]], "name string")
    got = {(r["a"], r["b"]) for r in concept_pairs(docs, 0.88).where(F.col("reason") == "alike").collect()}
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if abs(len(a) - len(b)) <= 6 and plain_ratio(a, b) >= 0.88}
    assert want and got == want
