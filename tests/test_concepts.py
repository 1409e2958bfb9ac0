import random

from loomwork.operators.graphs import compare_concepts

KINDS = "a string, b string", "source string, type string, target string, doc_id bigint", "concept string, doc_id bigint"


def plain(pairs, relations, mentions):
    seen = {(s, "out:" + k, t, d) for s, k, t, d in relations} | {(t, "in:" + k, s, d) for s, k, t, d in relations}
    out = set()
    for a, b in {p for p in pairs if None not in p and p[0] != p[1]}:
        for way in {x[1] for x in seen if x[0] == a and x[2] == b}:
            out.add((a, b, "direct", b, way, len({x[3] for x in seen if x[:3] == (a, way, b)})))
        both = {d for c, d in mentions if c == a} & {d for c, d in mentions if c == b}
        if both:
            out.add((a, b, "shared", None, None, len(both)))
        how = lambda c, o: ",".join(sorted({x[1] for x in seen if x[0] == c and x[2] == o}))
        for o in {x[2] for x in seen} - {a, b, None}:
            if how(a, o) and how(b, o):
                out.add((a, b, "common", o, f"{how(a, o)} / {how(b, o)}", None))
    return out


def test_equals_plain_code(spark):
    rng = random.Random(4)
    names = [f"c{k}" for k in range(12)] + ["hot"] * 8
    relations = [(rng.choice(names), rng.choice(["uses", "tests"]), rng.choice(names), rng.randrange(9)) for _ in range(90)]
    relations += relations[:5] + [("hot", "uses", "hot", 1), (None, "uses", "c1", 2), ("c1", "uses", None, 2)]
    mentions = [(rng.choice(names), rng.randrange(30)) for _ in range(120)] + [(None, 1), ("c2", 3), ("c2", 3)]
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(40)] + [("c1", "c1"), (None, "c1"), ("c1", None), ("gone", "c1"), ("c1", "hot"), ("c1", "hot")]
    got = compare_concepts(*(spark.createDataFrame(r, k) for r, k in zip((pairs, relations, mentions), KINDS, strict=True))).collect()
    want = plain(pairs, relations, mentions)
    assert {x[2] for x in want} == {"direct", "shared", "common"}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_no_rows(spark):
    none = [spark.createDataFrame([], k) for k in KINDS]
    assert compare_concepts(*none).count() == 0
