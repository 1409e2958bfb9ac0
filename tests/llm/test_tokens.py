import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwork.llm.packing import cuts, pack
from loomwork.llm.tokens import byte_ids, word_ids
from loomwork.llm.token_output import read_tokens, token_digest, write_tokens
from tests.llm.fixtures import documents, hard_texts

P = pytest.importorskip("public_tokenizers")
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


def whole(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


PLAIN_WORD, PLAIN_BYTE = whole(WORD), whole(BYTE)


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from(list("abZ é́\n\t 1.,'  \u001c\u0000\u0085sé日<|>")), max_size=40))
def test_cached_ids_are_those_of_the_whole_text(text):
    assert np.frombuffer(word_ids(WORD, [text])[0], "<u4").tolist() == PLAIN_WORD(text)
    assert np.frombuffer(byte_ids(BYTE, [text])[0], "<u4").tolist() == PLAIN_BYTE(text)


def test_letters_that_fall_apart_when_normalised():
    letters = "\u0130\u0958\u095f\u09dc\u0a33\u0b5c\u0f43\ufb1d\ufb2a\u1e9e\u0391\u03a3"
    texts = [f"one {c} two{c} {c}three É{c}. plain words {c}" for c in letters] + ["\u0130stanbul \u0958\u0924"]
    for ids, path, plain in ((word_ids, WORD, PLAIN_WORD), (byte_ids, BYTE, PLAIN_BYTE)):
        assert [np.frombuffer(x, "<u4").tolist() for x in ids(path, texts)] == [plain(t) for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_special_tokens_in_texts_are_read_as_the_library_reads_them():
    assert np.frombuffer(word_ids(WORD, ["a <|endoftext|> b"])[0], "<u4").tolist() == PLAIN_WORD("a <|endoftext|> b") == [320, 49407, 321]
    assert np.frombuffer(byte_ids(BYTE, ["a <|endoftext|> b"])[0], "<u4").tolist() == PLAIN_BYTE("a <|endoftext|> b") == [64, 220, 50256, 275]


@pytest.mark.parametrize("ids, path, plain", [(word_ids, WORD, PLAIN_WORD), (byte_ids, BYTE, PLAIN_BYTE)])
def test_every_letter_inside_words_and_long_texts(ids, path, plain):
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha() and not 0xD800 <= c < 0xE000 and not 0x20000 <= c and not 0xAC00 <= c < 0xD7A4 and not 0x4E00 <= c < 0xA000]
    texts = [" ".join(f"a{c} {c}b x{c}y" for c in letters[k : k + 40]) for k in range(0, len(letters), 40)]
    for text, got in zip(texts, ids(path, texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain(text), text
    long = ["word İstanbul 12, " * 60_000, "x" * 1_000_000, "é" * 300_000]
    for text, got in zip(long, ids(path, long), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain(text)


def test_cuts_are_classes_of_the_capacity():
    for slack in (0.0, 0.03, 0.2):
        for n in range(1, 5000):
            got = cuts(n, 2048, slack)
            assert sum(got) == n and all(2048 // (2048 // x) - x <= slack * (2048 // (2048 // x)) for x in got)


def test_packing_places_each_id_once(spark):
    texts = hard_texts() + [(100 + k, f"word{k} " * (k * 7 % 300)) for k in range(60)]
    docs = documents(spark, texts)
    got = pack(docs.where("doc_id is null or doc_id <> 2"), WORD, 256).collect()
    by_doc, by_seq, short = {}, {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for key, text in texts:
        if key == 2:
            continue
        ids, at = [*PLAIN_WORD(text), 1], 0
        for r in sorted(by_doc[key], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        k = 256 // rows[0]["length"]
        assert at <= 256 and len(rows) <= k and all(256 // r["length"] == k for r in rows)
        short[k] = short.get(k, 0) + (at < 0.92 * 256 - k)
    assert max(short.values()) <= 1  # the last of each class
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert pack(docs.limit(0), WORD).count() == 0


def test_orc_round_trip(spark, tmp_path):
    docs = documents(spark, hard_texts())
    out = str(tmp_path / "t")
    write_tokens(docs, BYTE, out)
    assert token_digest(spark, out).count() == len(hard_texts())
    stored = read_tokens(spark, out)
    assert sorted(tuple(r["ids"]) for r in stored.collect()) == sorted((*PLAIN_BYTE(t), 2) for _, t in hard_texts())
    at = 0
    got = sorted(token_digest(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == sorted((k for k, _ in hard_texts()), key=lambda k: (k is not None, k))
    text = dict(hard_texts())
    for r in got:
        ids = [*PLAIN_BYTE(text[r["doc_id"]]), 2]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids))
        at += len(ids)
    assert stored.where("doc_id = 9").count() == 1


def test_orc_files_have_stripes_row_indexes_and_bloom_filters(spark, tmp_path):
    docs = documents(spark, [(7 * k, f"text {k} " + "words and more words " * (k % 40)) for k in range(6000)])
    out = str(tmp_path / "t")
    write_tokens(docs.coalesce(1), BYTE, out, stripe_bytes=65536, index_rows=1000)
    jvm = spark.sparkContext._jvm
    conf = jvm.org.apache.hadoop.conf.Configuration()
    orc = jvm.org.apache.orc
    stripes = streams = rows = 0
    for f in sorted((tmp_path / "t").glob("*.orc")):
        reader = orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(f)), orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() == 1000
        own = reader.rows()
        for stripe in reader.getStripes():
            kinds = [str(s.getKind()) for s in own.readStripeFooter(stripe).getStreamsList()]
            assert "ROW_INDEX" in kinds and "BLOOM_FILTER_UTF8" in kinds
            stripes, rows = stripes + 1, rows + stripe.getNumberOfRows()
    assert rows == 6000 and stripes > 1
    some = read_tokens(spark, out).where("doc_id = 7 * 3000").select("doc_id")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,21000)]" in some._jdf.queryExecution().explainString(jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert some.collect()
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() <= 2000  # of 6,000: stripes and row groups without the id are not read


def test_orc_digest_of_no_rows(spark, tmp_path):
    docs = documents(spark, hard_texts())
    write_tokens(docs.limit(0), BYTE, str(tmp_path / "none"))
    assert token_digest(spark, str(tmp_path / "none")).count() == 0


def test_marks_after_words_cost_no_call_each(monkeypatch):
    from loomwork.llm import tokens

    letters = "abcdefghijklmnop"
    text = " ".join(f"{'qz' if k % 2 else 'ñ'}{''.join(letters[int(d)] for d in str(k))}{'é' if k % 3 else ''}{['&&&', '.', '_/', '@'][k % 4]}" for k in range(600))
    for path, lead, plain in ((WORD, "", PLAIN_WORD), (BYTE, " ", PLAIN_BYTE)):
        e, calls = tokens.Encoder(path, lead), []
        monkeypatch.setattr(e, "one", lambda p, e=e, calls=calls: calls.append(p) or tokens.Encoder.one(e, p))
        assert np.frombuffer(e.ids([text])[0], "<u4").tolist() == plain(text)
        assert len(calls) < 20


def test_ids_are_gathered_without_an_index_for_each(monkeypatch):
    """Pieces of no ids, of many, and texts without any keep their places."""
    from loomwork.llm import tokens
    from loomwork.llm.queries import tokenizer_path

    texts = ["", "one two  two", "\n", "ein <|endoftext|> zwei", "a" * 500 + " é è", "one", ""] * 30
    for name, lead in (("byte_bpe_50k.json", " "), ("word_bpe_49k.json", "")):
        e = tokens.Encoder(tokenizer_path(name), lead)
        monkeypatch.setattr(tokens.np, "repeat", None)
        got = e.ids(texts)
        monkeypatch.undo()
        assert got == [e.one(t) for t in texts]


def test_words_with_and_without_marks_are_one_entry_and_new_words_need_no_call_each(monkeypatch):
    """A word of Latin letters is encoded once, however it begins or ends, and by the tokenizer's model for byte-level ids."""
    from loomwork.llm import tokens

    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}é" for k in range(400)]
    text = " ".join(f"{w} {w}. {w}, {w}!!" for w in words) + "\n" + "\n".join(words)
    e, calls = tokens.Encoder(BYTE, " "), []
    monkeypatch.setattr(e, "one", lambda p: calls.append(p) or tokens.Encoder.one(e, p))
    assert np.frombuffer(e.ids([text])[0], "<u4").tolist() == PLAIN_BYTE(text)
    assert len(calls) < 10 and len(e.new) < 2 * len(words) + 10


def test_flat_ids_of_a_column(spark):
    """Nulls, empty texts, special tokens and odd white space between others, in one array."""
    import pyarrow as pa

    from loomwork.llm.tokens import flat_byte_ids

    texts = [None, "", "one  two\n\n three", " lead", "a <|endoftext|> b", "x\0y z", "", "İx. 一一 Привет, мир. é.", "\n", "end ", None]
    for column in (pa.array(texts), pa.array(["cut off", *texts], pa.large_string()).slice(1), pa.array([], pa.string())):
        ids, bounds = flat_byte_ids(BYTE, column)
        got = [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        assert got == [PLAIN_BYTE(t) for t in texts][: len(column)]


def test_pieces_in_use_move_to_the_next_generation():
    from loomwork.llm import tokens

    e = tokens.Encoder(BYTE, " ", 200)
    for k in range(6):
        text = "always here. " + " ".join(f"x{k * 150 + j}" for j in range(150))
        assert np.frombuffer(e.ids([text])[0], "<u4").tolist() == PLAIN_BYTE(text)
    assert max(len(e.new), len(e.old)) < 400 and " here" in e.new.at


def test_a_worker_keeps_no_ids_of_pieces_after_its_task(spark, tmp_path):
    rows = [(k, f"word{k} other{k}") for k in range(64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)

    def kept(batches):
        import pyarrow as pa

        from loomwork.llm.tokens import _encoder

        for _ in batches:
            sizes = [len(pool) for path, lead in ((BYTE, " "), (WORD, "")) for e in [_encoder(path, lead)] for pool in (e.new, e.old)]
            yield pa.RecordBatch.from_arrays([pa.array([sum(sizes)])], ["n"])

    write_tokens(docs, BYTE, str(tmp_path / "ids"))
    pack(docs, WORD).count()
    left = [r["n"] for r in docs.repartition(8).mapInArrow(kept, "n long").collect()]
    assert left and not any(left)
