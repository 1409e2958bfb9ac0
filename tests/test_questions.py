import random

import pytest

from loomwork.operators.questions import most_similar


def plain(q, p):
    q, p = q.lower().strip(" "), p.lower().strip(" ")
    if q == p:
        return 1.0
    if q in p or p in q:
        return 0.8
    a, b = set(q.replace("?", "").split()), set(p.replace("?", "").split())
    return len(a & b) / max(len(a), len(b)) if a and b else 0.0


def all_pairs(questions, stored, least):
    out = []
    for i, q in questions:
        best = None
        for j, p in sorted((x for x in stored if x[1] and x[1].strip(" ")), key=lambda x: x[0]):
            if q and q.strip(" ") and plain(q, p) >= least - 1e-9 and (best is None or plain(q, p) > best[1]):
                best = (j, plain(q, p))
        if best:
            out.append((i, *best))
    return sorted(out)


@pytest.mark.parametrize("least", [0.3, 0.8, 0.9])
def test_equals_all_pairs(spark, least):
    rng = random.Random(5)
    words = "the a of how what is signal level chip band test run case Fehler été 信号".split()
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    stored = [(k, t) for k, t in enumerate(base)] + [(100, "the"), (101, "?"), (102, None), (103, ""), (104, base[3]), (105, "gnal le"), (106, "a")]
    questions = [(k, t) for k, t in enumerate([*base[:20], "THE", " ? ", None, "", "  ", "zzz", "tes", "s", "of the", "of the"])]
    for k in range(60):
        w = base[k].split()
        w[rng.randrange(len(w))] = rng.choice([*words, "new", ""])
        questions.append((1000 + k, f" {' '.join(w).title()}? "))
    kind = "id bigint, text string"
    got = most_similar(spark.createDataFrame(questions, kind), spark.createDataFrame(stored, kind), least).collect()
    want = all_pairs(questions, stored, least)
    assert len(want) > 20
    assert sorted((r["id"], r["match"]) for r in got) == [(i, j) for i, j, _ in want]
    assert all(abs(a["similarity"] - b[2]) < 1e-9 for a, b in zip(sorted(got, key=lambda r: r["id"]), want, strict=True))


def test_no_rows_and_a_wrong_limit(spark):
    one, none = spark.createDataFrame([(1, "what")], "id bigint, text string"), spark.createDataFrame([], "id bigint, text string")
    assert most_similar(none, one, 0.5).count() == most_similar(one, none, 0.5).count() == 0
    with pytest.raises(ValueError):
        most_similar(one, one, 0.0)
