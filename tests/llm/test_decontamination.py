import random
import re

import numpy as np
import pyarrow as pa

from loomwork.llm import decontamination
from loomwork.llm.common import texts_buffer
from loomwork.llm.decontamination import drop_contaminated, find_passages
from tests.llm.fixtures import documents, hard_texts


def words(text):
    return [w.lower() for w in re.findall(r"[0-9A-Za-z\x80-\U0010ffff]+", text or "")]


def smith_waterman(a, b):
    best, before = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(max(0, before[j] + (2 if x == y else -1), before[j + 1] - 1, now[j] - 1))
        best, before = max(best, max(now)), now
    return best / (2 * max(len(a), 1))


def prose(rng, n):
    return " ".join(rng.choice("al be ce de ef fi go he in jo ka".split()) + rng.choice("ra ro ri ne no ta to".split()) + rng.choice(["", "s", "n", "th"]) for _ in range(n))


def test_scores_equal_a_plain_alignment(spark):
    rng = random.Random(6)
    items = [(i, prose(rng, rng.randint(8, 40))) for i in range(12)]
    texts = []
    for k in range(60):
        w = items[k % 12][1].split()
        for _ in range(k // 12):
            i = rng.randrange(len(w))
            w[i : i + 1] = rng.choice([[], ["new"], [w[i], "more"]])
        texts.append((k, f"{prose(rng, rng.randint(0, 400))} {' '.join(w)} {prose(rng, rng.randint(0, 200))}"))
    texts += [(100 + k, prose(rng, 300)) for k in range(20)] + [(500 + k, t) for k, (i, t) in enumerate(hard_texts())]
    bench = spark.createDataFrame(items + [(90, None), (91, ""), (92, "al")], "item_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in find_passages(documents(spark, texts), bench).collect()}
    for k, text in texts:
        for i, item in items:
            exact = smith_waterman(words(item), words(text))
            if (k, i) in got:
                assert abs(got[k, i] - exact) < 1e-9
            elif exact >= 0.5:  # only a passage without three words of the item in a row has no seed
                a, b = words(item), words(text)
                assert not {tuple(a[j : j + 3]) for j in range(len(a) - 2)} & {tuple(b[j : j + 3]) for j in range(len(b) - 2)}, (k, i, exact)
    assert all((k, k % 12) in got for k in range(36))


def test_stage_drops_only_documents_with_passages(spark):
    rng = random.Random(8)
    items = [(i, prose(rng, 30)) for i in range(5)]
    clean = [(k, prose(rng, 200)) for k in range(40)]
    texts = clean + [(100 + i, f"{prose(rng, 50)} {t.upper()}. {prose(rng, 50)}") for i, t in items] + [(None, "no id"), (200, None)]
    docs = documents(spark, texts)
    got = drop_contaminated(docs, spark.createDataFrame(items, "item_id bigint, text string"))
    assert got.schema == docs.schema
    assert sorted(str(r["doc_id"]) for r in got.collect()) == sorted([*(str(k) for k, _ in clean), "None", "200"])
    assert drop_contaminated(docs, spark.createDataFrame([], "item_id bigint, text string")).count() == len(texts)
    assert find_passages(docs.limit(0), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0


def test_copies_of_an_item_hide_no_edited_copy(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, 30)) for i in range(4)]
    texts = [(k, f"{prose(rng, 20)} {items[k % 4][1]} {prose(rng, 20)}") for k in range(120)]
    for k in range(120):
        w = items[k % 4][1].split()
        for i in rng.sample(range(30), 6 + k % 3):
            w[i] = f"new{i}"
        texts.append((1000 + k, f"{prose(rng, 30)} {' '.join(w)} {prose(rng, 30)}"))
    got = {(r["doc_id"], r["item_id"]) for r in find_passages(documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    for k, text in texts:
        a, b = words(items[k % 4][1]), words(text)
        grams = {tuple(b[i : i + 3]) for i in range(len(b))}
        if smith_waterman(a, b) >= 0.5 and any(tuple(a[i : i + 3]) in grams for i in range(28)):
            assert (k, k % 4) in got, k


def test_a_long_item_is_aligned_in_bounded_tables(spark):
    rng = random.Random(3)
    long = prose(rng, 3000)
    w = long.split()
    for i in rng.sample(range(3000), 500):
        w[i] = "new"
    texts = [(k, f"{prose(rng, 50)} {' '.join(w)}") for k in range(3)] + [(9, prose(rng, 100))]
    got = {r["doc_id"]: r["score"] for r in find_passages(documents(spark, texts), spark.createDataFrame([(1, long), (2, prose(rng, 20))], "item_id bigint, text string")).collect()}
    assert set(got) == {0, 1, 2} and all(0.6 < s < 0.9 for s in got.values())


def matches(items, texts, shared, least=0.5):
    x = decontamination.Items(list(range(len(items))), items, least, shared)
    h, row = decontamination.words(*texts_buffer(pa.array(texts, pa.string())))
    return decontamination._matches(x, h, row, least)


def test_both_ways_find_what_all_grams_find():
    rng = random.Random(12)
    phrases = ["one of the most", "which of the following is the best answer", "in the end"]
    for least in (0.3, 0.5, 0.8):
        items = [f"{rng.choice(phrases)} {prose(rng, rng.randint(3, 25))} {rng.choice(phrases)}" for _ in range(60)] + [None, "", "al", "in the", phrases[1], phrases[1]]
        texts = [f"{prose(rng, rng.randint(0, 90))} {rng.choice(phrases)} {prose(rng, 9)}" for _ in range(60)] + [t for _, t in hard_texts()]
        for _ in range(150):
            w = items[rng.randrange(60)].split()
            for _ in range(rng.randint(0, len(w) // 2)):
                i = rng.randrange(len(w))
                w[i : i + 1] = rng.choice([[], ["new"], [w[i], "more"]])
            texts.append(f"{prose(rng, rng.randint(0, 60))} {' '.join(w)} {rng.choice(phrases)} {prose(rng, rng.randint(0, 60))}")
        every = matches(items, texts, 1 << 30, least)
        assert len(every) > 100
        assert matches(items, texts, 8, least) == matches(items, texts, 0, least) == every


def test_hits_are_the_same_in_small_parts(monkeypatch):
    rng = random.Random(14)
    items = [f"one of the most {prose(rng, 12)}" for _ in range(40)]
    texts = [f"{items[k % 40]} {prose(rng, 20)} one of the most" for k in range(120)]
    want = matches(items, texts, 8)
    monkeypatch.setattr(decontamination, "_HITS", 7)
    assert matches(items, texts, 8) == want and {(k, k % 40) for k in range(120)} <= {m[:2] for m in want}


def test_a_phrase_shared_by_many_items_makes_no_cases(monkeypatch):
    rng = random.Random(13)
    items = [f"{prose(rng, 8)} is one of the most {prose(rng, 12)}" for _ in range(2000)]
    texts = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) + " one of the most " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(60)) for _ in range(100)]
    seen, plain = [], decontamination._worth
    monkeypatch.setattr(decontamination, "_worth", lambda x, h, item, *v: seen.append(len(item)) or plain(x, h, item, *v))
    assert matches(items, texts, 1 << 30) == [] and sum(seen) == 200_000
    seen.clear()
    assert matches(items, texts, decontamination.SHARED) == [] and sum(seen) == 0
    assert {m[:2] for m in matches(items, [f"new {items[k]} new" for k in range(50)], decontamination.SHARED)} >= {(k, k) for k in range(50)}
    assert np.all(np.diff(decontamination.Items([0], [items[0]], 0.5).seed.astype(float)) >= 0)
