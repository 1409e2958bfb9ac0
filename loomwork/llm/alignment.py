"""Cross-tokenizer alignment: groups of token ids that two tokenizers cut alike are interned, and links are counted once for each distinct group."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from uuid import uuid4

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import mix, parts, pinned, shared_dir, texts_buffer
from loomwork.llm.tokens import WORD_AND_MARK, Encoder, Memory, Pool, apart, flat, replaced

#: Bytes of text of a block of documents, and of those that are encoded at once.
BLOCK_BYTES = 1 << 20
_ENCODED = 4 << 20
SALTS = 8
#: Stretches of text of which a worker remembers A's and B's ids, in each of two generations. Both caches are held at once, by two workers of an executor.
CACHE_STRETCHES = 100_000

#: Stands for the B ids of a stretch that aren't those of the stretch alone.
NONE = 0xFFFFFFFF


class Tokenizers:
    """Ids and bytes of tokens of both tokenizers. A is byte-level BPE, B sentencepiece with byte fallback."""

    def __init__(self, a: str, b: str):
        import sentencepiece

        self.a = Encoder(a, " ", CACHE_STRETCHES)
        self.a.t.encode_special_tokens, self.a.special = True, []  # their strings are ordinary text
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # byte-level pieces show these bytes as they are, the others from 256 on
        hidden = [x for x in range(256) if x not in shown]
        byte = {chr(x): x for x in shown} | {chr(256 + k): x for k, x in enumerate(hidden)}
        self.a_bytes = [b""] * self.a.t.get_vocab_size()
        for token, i in self.a.t.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        piece = self.b.id_to_piece
        self.b_bytes = [bytes([int(piece(i)[3:5], 16)]) if self.b.is_byte(i) else piece(i).replace("▁", " ").encode() for i in range(self.b.get_piece_size())]
        # With a token for each byte and nothing that changes texts, A's tokens are always those of the whole text.
        self.a_whole = self.a.t.normalizer is None and {bytes([k]) for k in range(256)} <= set(self.a_bytes)
        self.a_length, self.b_length = (np.array(list(map(len, x)), np.int32) for x in (self.a_bytes, self.b_bytes))

        #: No piece of B reaches over a space into the word before it or holds a line end, so cuts before either separate pieces; nor does one reach from a word into the marks after it.
        pieces = [piece(i) for i in range(self.b.get_piece_size()) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        self.cuts = not any("\n" in p or "▁" in p.lstrip("▁") for p in pieces) and not any(map(WORD_AND_MARK.search, pieces))
        self.memory = Memory(self.learn, CACHE_STRETCHES)
        ends = np.concatenate(([0], np.cumsum(list(map(len, self.b_bytes)))))
        self.b_rows = pa.Array.from_buffers(pa.large_binary(), len(self.b_bytes), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(self.b_bytes))])
        self.space = self.b.piece_to_id("▁")
        rng = np.random.default_rng(11)
        self.a_hash, self.b_hash, self.powers = (rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (len(self.a_bytes), len(self.b_bytes), 1 << 16))

    @property
    def new(self) -> Pool:
        return self.memory.new

    @property
    def old(self) -> Pool:
        return self.memory.old

    def learn(self, some: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """B ids of different stretches and of marks after a word. A stretch begins with the space that B adds, or with a line end. Where the ids aren't those of the stretch alone, NONE is the only one."""
        some = sorted(some, key=lambda p: p[:1] not in (" ", "\n"))
        n_marks = sum(p[:1] not in (" ", "\n") for p in some)
        lead = self.b.encode("a")
        marks = some[len(some) - n_marks :]
        found = self.b.encode([p[1:] if p[0] == " " else p for p in some[: len(some) - n_marks]], num_threads=1)
        found = [ids[1:] if p[0] != " " and ids and ids[0] == self.space else ids for p, ids in zip(some, found)]
        found += [ids[len(lead) :] if ids[: len(lead)] == lead else [] for ids in self.b.encode(["a" + p for p in marks], num_threads=1)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.int64, int(sizes.sum()))
        text = pa.array(some, pa.large_string())
        length = np.concatenate(([0], np.cumsum(self.b_length[ids], dtype=np.int64)))[np.concatenate(([0], np.cumsum(sizes)))]
        same = np.diff(length) == pc.binary_length(text).to_numpy()
        # Of those with the right length, the bytes are compared one by one.
        kept = ids[np.repeat(same, sizes)]
        got, want = self.b_rows.take(pa.array(kept)), text.filter(pa.array(same))
        (got, _), (want, offsets) = (texts_buffer(x.view(pa.large_string()) if x.type == pa.large_binary() else x) for x in (got, want))
        wrong = np.concatenate(([0], np.cumsum(got != want)))[offsets]
        same[np.flatnonzero(same)[np.diff(wrong) > 0]] = False
        out = np.where(same, sizes, 1)
        values = np.full(int(out.sum()), NONE, "<u4")
        values[np.repeat(same, out)] = ids[np.repeat(same, sizes)]
        return some, values, out

    def whole(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a text that isn't cut."""
        raw, y = (" " + text).encode("utf-8", "surrogatepass"), self.b.encode(text)
        x = np.frombuffer(self.a.one(" " + text), "<u4")
        if b"".join(map(self.b_bytes.__getitem__, y)) != raw or not self.a_whole and b"".join(map(self.a_bytes.__getitem__, x.tolist())) != raw:
            return b"", b""
        return x.tobytes(), np.array(y, "<u4").tobytes()

    def flat_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A ids of space+text of all texts, the number of them before each text and at the end, and the same of B; a text has none where it is empty or the joined bytes of A or B differ from space+text."""
        texts = texts.cast(pa.large_string()).fill_null("")
        empty = pc.binary_length(texts).to_numpy() == 0
        if self.cuts and self.a_whole:
            nothing, space = (pa.scalar(c, pa.large_string()) for c in ("", " "))
            spaced = pc.if_else(pa.array(empty), nothing, pc.binary_join_element_wise(nothing, texts, space))
            pieces, starts = self.a.cuts(spaced)
            pieces = pieces.dictionary_encode()
            parted = apart(pieces.dictionary)
            (x, from_x), (y, from_y) = (flat(m.rows(*parted).take(pieces.indices)) for m in (self.a.memory, self.memory))
            from_x, from_y = from_x[starts], from_y[starts]
            none = np.concatenate(([0], np.cumsum(y == NONE)))[from_y]
            odd = np.flatnonzero(np.diff(none)).tolist()
        else:
            x = y = np.zeros(0, "<u4")
            from_x = from_y = np.zeros(len(texts) + 1, np.int64)
            odd = np.flatnonzero(~empty).tolist()
        other = [self.whole(texts[k].as_py()) for k in odd]
        x, from_x = replaced(x, from_x, dict(zip(odd, (o[0] for o in other), strict=True)))
        y, from_y = replaced(y, from_y, dict(zip(odd, (o[1] for o in other), strict=True)))
        return x.astype(np.int32), from_x, y.astype(np.int32), from_y

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """A ids of space+text and B ids for each text."""
        x, from_x, y, from_y = self.flat_ids(pa.array(texts, pa.large_string()))
        return [(x[a:b], y[c:d]) for a, b, c, d in zip(from_x[:-1], from_x[1:], from_y[:-1], from_y[1:], strict=True)]

    def links(self, group: tuple[tuple[int, ...], tuple[int, ...]]) -> list[tuple[int, int]]:
        """All pairs (A id, B id) of occurrences in the group of which the byte ranges overlap."""
        (x, y), out, j, end_a, end_b = group, [], 0, 0, 0
        for a in x:
            end_a += len(self.a_bytes[a])
            while True:
                if j == 0 or end_b <= end_a - len(self.a_bytes[a]):  # the next B token is the first that reaches into this A token
                    end_b += len(self.b_bytes[y[j]])
                    j += 1
                    continue
                out.append((a, y[j - 1]))
                if end_b >= end_a or j == len(y):
                    break
                end_b += len(self.b_bytes[y[j]])
                j += 1
        return out


def key_of(group: tuple[tuple[int, ...], tuple[int, ...]]) -> bytes:
    """The group itself in few bytes: the number of A ids, then all ids, as little-endian 16-bit numbers (ids of both are below 65536)."""
    x, y = group
    return np.array((len(x), *x, *y), "<u2").tobytes() if len(x) < 65536 else b"\0\0" + np.array((len(x), *x, *y), "<u4").tobytes()


def group_of(key: bytes) -> tuple[tuple[int, ...], tuple[int, ...]]:
    ids = np.frombuffer(key, "<u2").tolist() if key[:2] != b"\0\0" else np.frombuffer(key[2:], "<u4").tolist()
    return tuple(ids[1 : 1 + ids[0]]), tuple(ids[1 + ids[0] :])


@lru_cache(maxsize=2)
def _tokenizers(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def groups_of(x: np.ndarray, y: np.ndarray, t: Tokenizers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, group of each B token, hash of each group) of the joined tokens of texts: a group ends where tokens of both end."""
    ends_x, ends_y = np.cumsum(t.a_length[x], dtype=np.int64), np.cumsum(t.b_length[y], dtype=np.int64)
    both = np.zeros(int(ends_x[-1]) + 1 if len(x) else 1, np.int8)
    both[ends_x] += 1
    both[ends_y] += 1
    number, hashes = np.cumsum(both == 2, dtype=np.int32), []
    own = [number[e] - (both[e] == 2) for e in (ends_x, ends_y)]
    for ids, g, table in ((x, own[0], t.a_hash), (y, own[1], t.b_hash)):  # sums of random numbers of ids times one of the place in the group
        first = np.flatnonzero(np.concatenate((np.ones(min(len(g), 1), bool), g[1:] != g[:-1])))
        place = np.arange(len(g)) - np.repeat(first, np.diff(np.concatenate((first, [len(g)]))))
        h = table[ids] * t.powers[place & 0xFFFF]
        hashes.append(np.add.reduceat(h, first) if len(g) else h)
    return own[0], own[1], mix(hashes[0] * np.uint64(3) + hashes[1])


def encoded(t: Tokenizers, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, A ids, their number before each text and at the end, B ids, likewise) of each block of a column; many blocks are encoded at once, so that words are looked up less often."""
    _, offsets = texts_buffer(column)
    for lo, hi in parts(offsets, _ENCODED):
        x, from_x, y, from_y = t.flat_ids(column.slice(lo, hi - lo))
        for low, high in parts(offsets[lo : hi + 1] - offsets[lo], BLOCK_BYTES):
            a, b, c, d = from_x[low], from_x[high], from_y[low], from_y[high]
            yield lo + low, x[a:b], from_x[low : high + 1] - a, y[c:d], from_y[low : high + 1] - c


def _blocks(docs: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    """Two tables of one written folder, told apart by ``kind``. 0: a document (block, doc_id, n_a, n_b, n_groups, n_links, groups_sha256) with the numbers (``at``) and counts (``times``) of its groups. 1: a distinct group of a
    block (block, no, key, times). A block is some MB of texts of one task."""
    names = ["kind", "block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times_in", "no", "key", "times"]
    kinds = [pa.int32(), pa.int64(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.binary(), pa.int64()]

    def made(n: int, **columns: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns[c].cast(k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, task, number = _tokenizers(a, b), TaskContext.get().partitionId(), 0
        for batch in batches:
            for low, x, from_x, y, from_y in encoded(t, batch.column(1)):
                block, n, number = (task << 32) + number, len(from_x) - 1, number + 1
                n_a, n_b = np.diff(from_x), np.diff(from_y)
                of_x, of_y, h = groups_of(x, y, t)
                at, known = pd.factorize(h)
                first = np.empty(len(known), np.int64)
                first[at[::-1]] = np.arange(len(h))[::-1]
                # Where a text's tokens begin, a group does too.
                start = np.concatenate((of_x, [len(h)]))[np.minimum(from_x, len(of_x))]
                n_groups = np.diff(start)
                edges = [np.searchsorted(of, first.astype(of.dtype), side).tolist() for of in (of_x, of_y) for side in ("left", "right")]
                distinct = [(x[p:q].tolist(), y[r:s].tolist()) for p, q, r, s in zip(*edges, strict=True)]
                text = [b"%s|%s" % (b",".join(b"%d" % i for i in p), b",".join(b"%d" % i for i in q)) for p, q in distinct]
                sha = [hashlib.sha256(b";".join(map(text.__getitem__, at[p:q].tolist()))).hexdigest() if q > p else "" for p, q in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]
                pair, times = np.unique(np.repeat(np.arange(n), n_groups) * max(1, len(distinct)) + at, return_counts=True)
                own, at = np.divmod(pair, max(1, len(distinct)))
                ends = pa.array(np.searchsorted(own, np.arange(n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (at, times)]
                counts = {k: pa.array(v) for k, v in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_a + n_b - n_groups))}  # inside a group each token end but the last lies in a token of the other
                yield made(n, kind=pa.array([0] * n), block=pa.array([block] * n), doc_id=batch.column(0).slice(low, n), groups_sha256=pa.array(sha, pa.string()), at=lists[0], times_in=lists[1], **counts)
                total = np.bincount(at, times, len(distinct)).astype(np.int64)
                for lo in range(0, len(distinct), 50_000):
                    m = len(distinct[lo : lo + 50_000])
                    keys = pa.array(map(key_of, distinct[lo : lo + 50_000]), pa.binary())
                    yield made(m, kind=pa.array([1] * m), block=pa.array([block] * m), no=pa.array(np.arange(lo, lo + m)), key=keys, times=pa.array(total[lo : lo + m]))

    schema = "kind int, block bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, at array<int>, times_in array<int>, no int, key binary, times bigint"
    spark = docs.sparkSession
    out = f"{shared_dir(spark)}/aligned-{uuid4().hex}"
    docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, schema).write.partitionBy("kind").parquet(out)
    return spark.read.schema(schema).parquet(out).where("kind = 0"), spark.read.schema(schema).parquet(out).where("kind = 1")


def group_links(groups: DataFrame, a: str, b: str) -> DataFrame:
    """(key, times, pairs): for each distinct group all its links, packed as A id * 2^32 + B id, expanded once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _tokenizers(a, b)
        for batch in batches:
            pairs = [[(x << 32) + y for x, y in t.links(group_of(k))] for k in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pairs, pa.list_(pa.int64()))], ["key", "times", "pairs"])

    return groups.select("key", "times").mapInArrow(each, "key binary, times bigint, pairs array<bigint>")


def align(docs: DataFrame, a: str, b: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for each row.

    space+text is encoded by A and text by B (which adds the space); byte offsets where tokens of both end cut them into groups. Tasks write each document as numbers and counts of its block's distinct groups, and
    those groups with their frequency. Over the table distinct groups are interned by their own ids as key, their links (pairs of tokens with overlapping bytes) are expanded once and weighted by the
    frequency to the count of each id pair; ``n_best`` counts a document's links whose count is the highest of their B id, ``count_sum`` adds counts. A group's two sums come back to the blocks by its key, and
    a block adds them up for its documents. No row is made for a token, and none for a group of a document.

    A text that is null or empty, or whose joined token bytes differ from space+text, has zeros and ''. Repeated rows and null doc_ids are rows of their own; other columns are ignored.
    """
    rows, groups = _blocks(docs, a, b)
    groups = groups.select("block", "no", "key", "times")
    known = pinned(group_links(groups.groupBy("key").agg(F.sum("times").alias("times")), a, b))
    flat = known.select("key", "times", F.explode("pairs").alias("pair"))
    count = pinned(flat.groupBy("pair").agg(F.sum("times").alias("count")))  # at most A ids x B ids rows
    most = count.groupBy(F.expr("pair & 4294967295").alias("id")).agg(F.max("count").alias("most"))
    best = count.join(most, F.expr("pair & 4294967295") == F.col("id")).select("pair", "count", (F.col("count") == F.col("most")).cast("bigint").alias("best"))
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # a pair may stand in many groups
    links = flat.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int")).join(salted, ["pair", "salt"])
    sums = links.groupBy("key").agg(F.sum("best").alias("best"), F.sum("count").alias("count"))
    back = groups.select("block", "no", "key").join(sums, "key").select("block", "no", "best", "count")

    def each(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        n = (theirs["no"].to_numpy().max() + 1) if theirs.num_rows else 0
        values = np.zeros((2, n), np.int64)
        for k, c in enumerate(("best", "count")):
            values[k, theirs["no"].to_numpy()] = theirs[c].to_numpy()
        at, times = (ours[c].combine_chunks() for c in ("at", "times_in"))
        row = np.repeat(np.arange(len(at)), np.diff(at.offsets.to_numpy()))
        out = np.zeros((2, len(at)), np.int64)
        for k in (0, 1):
            np.add.at(out[k], row, values[k, at.flatten().to_numpy()] * times.flatten().to_numpy())
        same = ours.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        return same.append_column("n_best", pa.array(out[0])).append_column("count_sum", pa.array(out[1])).append_column("groups_sha256", ours["groups_sha256"])

    documents = rows.select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "times_in")
    schema = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"
    return documents.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(each, schema)
