import math
import random
import re

import duckdb
import pandas as pd

from loomwork.llm.ranked_search import SEARCH_SQL, search
from tests.llm.fixtures import documents, hard_texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(docs, items, k=10):
    """docs: list of (doc_id, text); items: list of (item_id, text). (item_id, rank) -> (doc_id, score)."""
    rows = [(d, terms(t)) for d, t in docs]
    rows = [(d, t) for d, t in rows if t]
    N, L = len(rows), sum(len(t) for _, t in rows)
    df, asked = {}, {}
    for _, t in rows:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    w = {x: math.floor(1000 * math.log((2 * N + 2) / (2 * n + 1))) for x, n in df.items()}
    out = {}
    for i, own in asked.items():
        got = []
        for d, t in rows:
            m = 10 + (90 * len(t) * N) // L
            score = sum(w[x] * ((10**9 * t.count(x)) // (1000 * t.count(x) + 8 * m)) for x in own if x in t)
            if score > 0:
                got.append((-score, d is not None, d or 0))
        for r, (s, named, d) in enumerate(sorted(got)[:k], 1):
            out[i, r] = (d if named else None, -s)
    return out


def found(spark, docs, items, **more):
    table = spark.createDataFrame(items, "item_id bigint, text string")
    rows = search(documents(spark, docs), table, **more).collect()
    assert len({(r["item_id"], r["rank"]) for r in rows}) == len(rows)
    return {(r["item_id"], r["rank"]): (r["doc_id"], r["score"]) for r in rows}


def corpus(n, seed, vocabulary=300):
    rng = random.Random(seed)
    words = [f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(20000)]
    return [(k, " ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 60, 300])))) for k in range(n)]


def test_equals_plain_code(spark):
    docs = corpus(300, 1)
    rng = random.Random(2)
    items = [(i, " ".join(rng.choice(docs)[1].split()[:12] + [f"w{rng.randrange(300)}" for _ in range(10)])) for i in range(25)]
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, items, k=3, stored=3) == plain(docs, items, 3)


def test_common_words_ties_and_copies(spark):
    """A word in every text weighs next to nothing; hundreds of equal texts tie by doc_id."""
    docs = [(1000 - k, "the same words again") for k in range(400)] + [(2000 + k, f"the word{k} other") for k in range(40)]
    items = [(1, "the"), (2, "the same"), (3, "WORD7 word8 the"), (4, "nothing here"), (5, ""), (6, None), (7, "again AGAIN other")]
    want = plain(docs, items)
    assert found(spark, docs, items) == want
    assert [want[2, r][0] for r in (1, 10)] == [601, 610]
    assert {i for i, _ in want} == {1, 2, 3, 7}


def test_hard_texts_and_long_ones(spark):
    docs = hard_texts() + [(50, "needle " + "hay stack " * 120_000), (51, "needle hay"), (52, "日本語 テキスト ünïcode"), (53, "日本語,テキスト_ÜNÏCODE a1b2")]
    items = [(1, "one two needle"), (2, "日本語 done"), (3, "Ünïcode A1B2"), (2, "テキスト"), (4, "don't I'll 34.5 x")]
    assert found(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert found(spark, [], [(1, "word")]) == {}
    assert found(spark, [(1, "word"), (2, None)], []) == {}
    assert found(spark, [(1, None), (2, "")], [(1, "word")]) == {}


def test_sql_states_the_same(spark):
    docs = corpus(120, 5)
    items = [(i, " ".join(t.split()[:9])) for i, t in docs[:15]]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    assert {(i, r): (d, s) for i, r, d, s in con.sql(SEARCH_SQL).fetchall()} == plain(docs, items)
