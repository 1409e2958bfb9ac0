import random

import numpy as np

from loomwork.llm.license_scan import SHINGLE, TEMPLATES, scan_licenses
from tests.llm.fixtures import documents, hard_texts


def plain_words(text):
    import re

    return [w.lower() for w in re.findall(r"[0-9A-Za-z]+", text)]


def places(text, template):
    """(share, first word, last word): the most distinct shingles of the template in a stretch of its shingles and a quarter more (eight at least), from the first such stretch."""
    a, b = plain_words(text), plain_words(template)
    shingles = [tuple(b[i : i + SHINGLE]) for i in range(len(b) - SHINGLE + 1)]
    have = [tuple(a[i : i + SHINGLE]) for i in range(len(a) - SHINGLE + 1)]
    n, want, top = len(shingles) + max(8, len(shingles) // 4), set(shingles), (0.0, 0, 0)
    for i, x in enumerate(have):
        if x in want and (share := len(want & set(have[i : i + n])) / len(want)) > top[0]:
            top = (share, i, max(j for j in range(i, min(i + n, len(have))) if have[j] in want) + SHINGLE - 1)
    return top


def best(text, template):
    return places(text, template)[0]


def test_every_template_is_found_in_prose(spark):
    random.seed(4)
    prose = lambda n: " ".join(random.choice("red green blue stone river hill".split()) + str(random.randint(0, 99)) for _ in range(n))
    names = sorted(TEMPLATES)
    texts = [(k, f"{prose(40 + 7 * k)}. {TEMPLATES[n]} {prose(60)}") for k, n in enumerate(names)]
    texts += [(100, prose(5000)), (101, " ".join([prose(3000), TEMPLATES["mit"], prose(3000), TEMPLATES["mit-line"]]))] + [(k + 500, t) for k, t in hard_texts() if k is not None]
    got = {}
    for r in scan_licenses(documents(spark, texts)).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
        assert r["containment"] >= 0.8 and (r["containment"], r["first_word"], r["last_word"]) == places(dict(texts)[r["doc_id"]], TEMPLATES[r["license"]]), r
    for k, n in enumerate(names):
        assert n in got[k] or any(best(TEMPLATES[o], TEMPLATES[n]) >= 0.8 for o in got[k]), n
    assert 100 not in got and {"mit", "mit-line"} <= got[101] and not any(k >= 500 for k in got)


def test_changed_copies(spark):
    rng = np.random.default_rng(1)
    words = TEMPLATES["apache-2.0"].split()
    texts = []
    for k in range(40):
        w = list(words)
        for i in rng.choice(len(w), 2, replace=False):
            w[i] = "changed"
        texts.append((k, " ".join(w)))
    texts.append((99, " ".join(words[: len(words) // 2])))
    want = {k for k, t in texts if best(t, TEMPLATES["apache-2.0"]) >= 0.8}
    got = {r["doc_id"] for r in scan_licenses(documents(spark, texts)).collect() if r["license"] == "apache-2.0"}
    assert got == want and len(want) > 20
    assert scan_licenses(documents(spark, texts).limit(0)).count() == 0


def test_hits_equal_brute_force(spark):
    """Every template against every text: what is not found is under 0.8, or gives way to a template that overlaps it and is held better."""
    rng, texts = random.Random(9), []
    names = sorted(TEMPLATES)
    for k in range(150):
        words = TEMPLATES[names[k % len(names)]].split()
        for _ in range(k // len(names) * max(1, len(words) // 40)):
            i = rng.randrange(len(words))
            words[i : i + 1] = rng.choice([["other"], [], [words[i], "more"]])
        words = words[: rng.choice([len(words), max(5, int(len(words) * 0.88))])]
        lead = [f"w{rng.randint(0, 99)}" for _ in range(rng.choice([0, 0, 30, 700]))]
        texts.append((k, " ".join(lead + words + lead[:20])))
    got = {}
    for r in scan_licenses(documents(spark, texts)).collect():
        got.setdefault(r["doc_id"], {})[r["license"]] = (r["containment"], r["first_word"], r["last_word"])
    found = missed = 0
    for k, text in texts:
        exact = {n: p for n in names if (p := places(text, TEMPLATES[n]))[0] >= 0.8}
        own = got.get(k, {})
        assert all(own[n] == exact[n] for n in own)
        for n, (share, first, last) in exact.items():
            over = any(exact[o][0] > share and exact[o][1] <= last and first <= exact[o][2] for o in exact)
            found, missed = found + (n in own), missed + (n not in own and not over)
    assert found > 80 and missed == 0


def test_a_text_that_is_only_a_cut_notice(spark):
    texts = []
    for k, n in enumerate(("gpl-3.0-or-later", "bsd-2-clause", "mit", "gpl-3.0-line", "apache-2.0")):
        words = TEMPLATES[n].split()
        texts.append((k, " ".join(words[: -max(1, len(words) // 8)])))
    got = {(r["doc_id"], r["license"]) for r in scan_licenses(documents(spark, texts)).collect()}
    assert {(0, "gpl-3.0-or-later"), (1, "bsd-2-clause"), (2, "mit"), (4, "apache-2.0")} <= got
    assert all((k, n) in got for k, t in texts for n in TEMPLATES if best(t, TEMPLATES[n]) == 1.0)


def test_license_sentences_of_the_documents_are_all_found(spark):
    import re

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    said = {r["doc_id"]: re.findall(r"(?:Licensed|Released|licensed) under (?:the |a )?[A-Z][^\n]{2,40}", r["text"] or "") for r in docs.collect()}
    want = {k for k, v in said.items() if v}
    got = {}
    for r in scan_licenses(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert want and not want - set(got), [said[k] for k in want - set(got)]
    restrictive = {k for k, v in said.items() if any("CC BY-NC 4.0" in x for x in v)}
    assert restrictive and all("cc-by-nc-4.0-short" in got[k] for k in restrictive)
