import zlib

import numpy as np
from pyspark.sql import functions as F

from loomwork.llm.language_id import ByteCnn, identify, keep_identified, sample, windows
from tests.llm.fixtures import SCHEMA, documents, hard_texts

SYLLABLES = {"en": ["the", "th", "ing", "and", "er", "ou", "sh"], "fr": ["é", "eau", "oi", "que", "la", "ç", "ai"], "de": ["sch", "ü", "ung", "der", "ich", "ß", "ei"]}


def corpus(n=240, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        lang = sorted(SYLLABLES)[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang], rng.integers(1, 4))) for _ in range(rng.integers(5, 200))]
        rows.append((i, " ".join(words), lang, "s", 0, "x", 0))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus()
    got = {r["doc_id"]: r for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {r[0] for r in held} == {k for k, r in got.items() if r["held_out"]}
    assert np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_prediction_uses_the_text_alone(spark):
    rows = corpus()
    a = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    changed = [(i, t, None if zlib.crc32(str(i).encode()) % 4 == 2 else lang, "other", n, f, x) for i, t, lang, s, n, f, x in rows]
    b = {r["doc_id"]: (r["lang_pred"], round(r["score"], 6)) for r in identify(spark.createDataFrame(changed, SCHEMA)).collect()}
    assert a == b


def test_hard_texts_and_nothing_to_learn_from(spark):
    rows = corpus(60) + [(1000 + i, t, None, None, None, "x", 0) for i, (_, t) in enumerate(hard_texts())]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, (_, t) in enumerate(hard_texts()):
        assert (got[1000 + i] == "und") == (not t or not any(c.isalpha() for c in t)), t
    blind = documents(spark, hard_texts()).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in identify(blind).collect()} == {"und"}
    assert identify(documents(spark, hard_texts()).limit(0)).count() == 0


def test_stage_keeps_columns_and_drops_what_has_no_language(spark):
    docs = spark.createDataFrame(corpus(90) + [(500, "12345 67", "en", "s", 0, "x", 0), (501, None, "en", "s", 0, "x", 0)], SCHEMA)
    got = keep_identified(docs)
    assert got.schema == docs.schema
    assert {r["doc_id"] for r in got.collect()} == set(range(90))


def test_windows_cover_whole_texts():
    raw = "".join(chr(97 + i % 26) for i in range(1000)).encode()
    data, offsets = np.frombuffer(raw, np.uint8), np.array([0, 0, 10, 1000])
    x, row, share = windows(data, offsets)
    assert b"".join(w[w > 0].tobytes() for w, r in zip(x, row, strict=True) if r == 2) == raw[10:] and 0 not in row
    assert abs(share[row == 2].sum() * 192 - 990) < 1e-6


def test_gradients_lower_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 300)
    x = rng.integers(97, 110, (300, 192)).astype(np.uint8)
    x[y == 1, 50:53] = [200, 201, 202]
    net = ByteCnn(["a", "b"])
    net.fit(x, y, epochs=8)
    assert (net.probabilities(x).argmax(1) == y).mean() > 0.97


def test_copies_of_one_text_do_not_fill_the_sample(spark):
    rng = np.random.default_rng(5)
    rows = [(f"text {i} " + "".join(map(chr, rng.integers(97, 123, 40))), "en") for i in range(900)]
    docs = spark.createDataFrame(rows + [rows[k] for k in range(5) for _ in range(800)] + [("nur eins", "de")] * 7 + [(None, "en"), ("", "de"), ("x", None)], "text string, lang string").repartition(8)
    got = sample(docs, 300, 1)
    names, cuts = got["lang"].to_pylist(), got["cut"].to_pylist()
    assert names.count("en") == 300 == len({c for c, n in zip(cuts, names, strict=True) if n == "en"}) and names.count("de") == 1


def test_held_out_accuracy_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in identify(docs).collect()}
    lang = {r["doc_id"]: r["lang"] for r in docs.where("lang is not null and length(text) > 20").select("doc_id", "lang").collect()}
    held = [k for k in lang if got[k]["held_out"]]
    assert len(held) > 100 and np.mean([got[k]["lang_pred"] == lang[k] for k in held]) >= 0.97


def test_stage_rejects_noise_and_fills_null_lang(spark):
    rng = np.random.default_rng(2)
    junk = [(700 + k, "".join(map(chr, rng.integers(33, 127, 400))), None, "s", 0, "x", 0) for k in range(30)]
    rows = [(i, t, None if i % 10 == 3 else lang, *more) for i, t, lang, *more in corpus(150)]
    got = {r["doc_id"]: r["lang"] for r in keep_identified(spark.createDataFrame(rows + junk, SCHEMA)).collect()}
    assert set(got) == set(range(150)) and all(got[i] == lang for i, _, lang, *_ in corpus(150))


def test_numbers_that_are_no_letters_are_und(spark):
    rows = corpus(60) + [(900 + k, t, None, None, None, "x", 0) for k, t in enumerate("² ½ ① Ⅷ 123 _ ª".split())]
    got = {r["doc_id"]: r["lang_pred"] for r in identify(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[900 + k] == "und" for k in range(7)] == [not any(map(str.isalpha, t)) for t in "² ½ ① Ⅷ 123 _ ª".split()]
