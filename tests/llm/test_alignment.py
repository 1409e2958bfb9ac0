import hashlib
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from loomwork.llm.alignment import Tokenizers, align, group_of, key_of
from tests.llm.fixtures import documents, hard_texts

A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["a", "B", " ", "  ", "\n", "\t", "\r", "é", "日本", "😀", "▁", "<s>", "</s>", "<|endoftext|>", "<unk>", "<0x41>", ".", "'s", "n't", "12", "\0", "\x1c", " ", "　", "İ", "é", "ﬁ", "½", "​", "﻿", "\u0085", "   ", "the", "_", "-", " word"]


@pytest.fixture(scope="module")
def both():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, Tokenizers(A, B)


def spans(ids, lengths):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + int(lengths[i])))
        at = out[-1][2]
    return out


def plain(both, texts):
    """Rows by the definition: groups from common token ends, links as all overlapping pairs."""
    a, t = both
    rows, count = [], {}
    for text in texts:
        x, y = (a.encode(" " + text, add_special_tokens=False).ids, t.b.encode(text)) if text else ([], [])
        raw = (" " + text).encode() if text else b""
        if b"".join(t.a_bytes[i] for i in x) != raw or b"".join(t.b_bytes[i] for i in y) != raw:
            x, y = [], []
        p, q = spans(x, t.a_length), spans(y, t.b_length)
        cuts = sorted({e for *_, e in p} & {e for *_, e in q})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(i) for i, s, e in p if low <= s and e <= c) + "|" + ",".join(str(i) for i, s, e in q if low <= s and e <= c))
            low = c
        links = [(i, j) for i, s, e in p for j, u, v in q if max(s, u) < min(e, v)]
        rows.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""))
        for k in links:
            count[k] = count.get(k, 0) + 1
    best = {}
    for (_, j), n in count.items():
        best[j] = max(n, best.get(j, 0))
    return [(na, nb, g, len(links), sum(count[k] == best[k[1]] for k in links), sum(count[k] for k in links), sha) for na, nb, g, links, sha in rows]


def compare(spark, both, docs):
    got = sorted(align(documents(spark, docs).repartition(3), A, B).collect(), key=str)
    want = sorted([(d, *r) for (d, _), r in zip(docs, plain(both, [t or "" for _, t in docs]), strict=True)], key=lambda r: str(r))
    key = lambda r: (r[0] is None, r[0] or 0, tuple(r[1:]))
    assert sorted((tuple(r) for r in got), key=key) == sorted(want, key=key)


def test_equals_plain_code(spark, both):
    rng = random.Random(3)
    docs = [(k, "".join(rng.choice(ODD) for _ in range(rng.randrange(1, 30)))) for k in range(400)]
    compare(spark, both, docs + [(1000 + k, t) for k, (_, t) in enumerate(docs[:60])])


def test_hard_texts(spark, both):
    compare(spark, both, [(d, t) for d, t in hard_texts() if not t or len(t) < 20_000] + [(90, "Straße naïve — „quote“ 12,345.67\n\tindented  twice"), (91, "x" * 3000), (92, None)])


def test_long_text_counts(spark, both):
    """A text of some MB is a block of its own."""
    word = "alignment of a long text, "
    one = align(documents(spark, [(1, word * 8)]), A, B).first()
    long = align(documents(spark, [(1, word * 80_000), (2, "short")]), A, B).where("doc_id = 1").first()
    assert long["n_a"] > 9_000 * one["n_a"] and long["n_links"] == long["n_a"] + long["n_b"] - long["n_groups"]
    assert long["n_best"] == long["n_links"] and long["count_sum"] > 0


def test_empty_table_and_no_tokens(spark):
    assert align(documents(spark, []), A, B).count() == 0
    rows = align(documents(spark, [(1, None), (2, ""), (3, "▁")]), A, B).collect()
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in rows) and len(rows) == 3


def test_links_of_groups_and_keys(both):
    t = both[1]
    rng = random.Random(9)
    for _ in range(200):
        text = "".join(rng.choice(ODD) for _ in range(12))
        (x, y), = t.ids([text])
        if not len(x):
            continue
        group = (tuple(x.tolist()), tuple(y.tolist()))
        p, q = spans(group[0], t.a_length), spans(group[1], t.b_length)
        assert sorted(t.links(group)) == sorted((i, j) for i, s, e in p for j, u, v in q if max(s, u) < min(e, v))
        assert group_of(key_of(group)) == group
    many = ((5,) * 70_000, (7, 8))
    assert group_of(key_of(many)) == many


def test_both_caches_together_stay_small():
    from loomwork.llm import alignment
    from loomwork.llm.queries import tokenizer_path

    t = alignment.Tokenizers(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    for k in range(12):
        t.ids([" ".join(f"{k * 40_000 + j:x}" for j in range(40_000))])
    assert max(len(c) for c in (t.a.new, t.a.old, t.new, t.old)) <= 150_000
    text = "the 1f 2e"
    assert [x.tobytes() for x in t.ids([text])[0]] == [x for x in t.whole(text)]


def test_ids_of_many_texts_in_flat_arrays(both):
    """Words with marks after them are looked up apart in both, and texts that B doesn't keep are found among others."""
    import pyarrow as pa

    t, rng = both[1], random.Random(5)
    texts = [None, "", "ﬁne words. here!", "½", "plain words, with marks.%%%\nand a line", "m². x², don't. é.", "日本. 12.5, a_b_."]
    texts += ["".join(rng.choice(ODD) for _ in range(rng.randrange(1, 30))) for _ in range(300)]
    x, from_x, y, from_y = t.flat_ids(pa.array(texts))
    for k, text in enumerate(texts):
        a, b = t.whole(text) if text else (b"", b"")
        assert x[from_x[k] : from_x[k + 1]].astype("<u4").tobytes() == a and y[from_y[k] : from_y[k + 1]].astype("<u4").tobytes() == b


def test_words_with_marks_are_one_entry_of_both_caches():
    from loomwork.llm import alignment

    t = alignment.Tokenizers(A, B)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(400)]
    t.ids([" ".join(f"{w} {w}. {w}, {w}!!" for w in words)])
    assert len(t.a.new) < 410 and len(t.new) < 410
