"""Benchmark decontamination: n-gram seeds find passages, Smith-Waterman alignment scores them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import parts, shingles, texts_buffer, words

GRAM = 3
SHARED = 8  # a gram at more places of items is no seed by itself
_BUCKETS = 512
_HITS = 1 << 21
_CELLS = 1 << 20


def align(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of each row of a (padded with 0) with the same row of b (padded with 1), over words.

    A match adds 2; a mismatch, or a word more on either side, takes 1. Returns (score as a share of that of a full match,
    end of the aligned words in b).
    """
    rows, width = b.shape
    before = np.zeros((rows, width + 1), np.int32)
    ramp = np.arange(width + 1, dtype=np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for i in range(a.shape[1]):
        now = np.zeros((rows, width + 1), np.int32)
        step = np.where(b == a[:, i, None], 2, -1).astype(np.int32)
        np.maximum(before[:, :-1] + step, before[:, 1:] - 1, out=now[:, 1:])
        np.maximum(now, 0, out=now)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp  # extra words of b cost 1 each
        at = now.argmax(1)
        top = now[np.arange(rows), at]
        better = top > best
        best, end = np.where(better, top, best), np.where(better, at, end)
        before = now
    return best / (2.0 * np.maximum(size, 1)), end


class Items:
    """A block of benchmark items: word hashes, their n-grams, and a table of the hash buckets of their words.

    A gram at up to ``shared`` places of items is a rare seed. A commoner one is kept by item, beside the item's rarest words: so many
    that an alignment of ``least`` matches one of them.
    """

    def __init__(self, ids: list, texts: list[str | None], least: float, shared: int = SHARED):
        data, offsets = texts_buffer(pa.array(texts, pa.string()))
        h, row = words(data, offsets)
        cut = np.searchsorted(row, np.arange(len(ids) + 1))
        self.ids, self.words = ids, [h[cut[i] : cut[i + 1]] for i in range(len(ids))]
        gram, item, offset, length = [], [], [], []
        for i, w in enumerate(self.words):
            n = min(GRAM, len(w))  # an item of fewer words is one gram
            if n:
                g, at = shingles(w, np.zeros(len(w), np.int64), n)
                gram.append(g), offset.append(at), item.append(np.full(len(g), i)), length.append(np.full(len(g), n))
        join = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        seed, owner, place, length = join(gram, np.uint64), join(item, np.int64), join(offset, np.int64), join(length, np.int64)
        self.lengths = np.unique(length).tolist()
        order = np.argsort(seed, kind="stable")
        seed, owner, place = seed[order], owner[order], place[order]
        _, nth, times = np.unique(seed, return_inverse=True, return_counts=True)
        rare = times[nth] <= shared if len(seed) else np.zeros(0, bool)
        self.seed, self.seed_item, self.seed_offset = seed[rare], owner[rare], place[rare]
        self.common = np.unique(seed[~rare])
        by_item = np.argsort(owner[~rare], kind="stable")
        self.common_gram = np.searchsorted(self.common, seed[~rare])[by_item]
        self.common_offset, owner = place[~rare][by_item], owner[~rare][by_item]
        self.common_edge = np.searchsorted(owner, np.arange(len(ids) + 1))
        self._rarest_words(np.unique(owner).tolist(), least)
        self.table = np.zeros((len(ids), _BUCKETS), bool)
        for i, w in enumerate(self.words):
            self.table[i, w % np.uint64(_BUCKETS)] = True

    def _rarest_words(self, owners: list[int], least: float) -> None:
        """``word`` and ``word_item``: of each item with common grams, the words that fewest such items hold.

        An alignment of ``least`` matches ``least`` of the item's n places, so it misses fewer than the n - least * n + 1 places taken here.
        """
        held = np.concatenate([np.unique(self.words[i]) for i in owners]) if owners else np.zeros(0, np.uint64)
        known, holders = np.unique(held, return_counts=True)
        taken = []
        for i in owners:
            w = self.words[i]
            places = len(w) - max(1, int(np.ceil(least * len(w) - 1e-9))) + 1
            taken.append(np.unique(w[np.lexsort((w, holders[np.searchsorted(known, w)]))[:places]]))
        word = np.concatenate(taken) if taken else np.zeros(0, np.uint64)
        item = np.repeat(np.array(owners, np.int64), [len(t) for t in taken])
        order = np.argsort(word, kind="stable")
        self.word, self.word_item = word[order], item[order]
        self.reach = max((2 * len(self.words[i]) + 8 for i in owners), default=0)

    def grams(self, h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        got = [shingles(h, row, n) for n in self.lengths]
        return np.concatenate([g for g, _ in got]), np.concatenate([p for _, p in got])


def _spread(low: np.ndarray, times: np.ndarray) -> np.ndarray:
    """low[k], low[k] + 1, ... for times[k] numbers, one k after the other."""
    return np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())


def _common_pairs(x: Items, h: np.ndarray, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """row * number of items + item, sorted, of the items with common grams of which one of the rarest words stands near a place of ``pos``.

    An item without one can't reach the score there, so nothing is lost, and a phrase that many items share meets none of them by itself.
    """
    edge = np.zeros(len(h) + 1, np.int64)
    np.add.at(edge, np.maximum(pos - x.reach, 0), 1)
    np.add.at(edge, np.minimum(pos + x.reach + GRAM, len(h)), -1)
    near = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    low = np.searchsorted(x.word, h[near])
    times = np.searchsorted(x.word, h[near], "right") - low
    part, pairs = np.cumsum(times) // _HITS, np.zeros(0, np.int64)
    for k in np.unique(part):
        some = part == k
        found = np.repeat(row[near[some]], times[some]) * len(x.ids) + x.word_item[_spread(low[some], times[some])]
        pairs = np.unique(np.concatenate((pairs, found)))
    return pairs


def _matches(x: Items, h: np.ndarray, row: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
    """(row, item, score, first word, last word) of the best passage of each row and item with a seed."""
    if not len(h):
        return []
    gram, pos = x.grams(h, row)
    order = np.argsort(pos, kind="stable")
    gram, pos = gram[order], pos[order]
    low = np.searchsorted(x.seed, gram)
    times = np.searchsorted(x.seed, gram, "right") - low  # at most SHARED
    hit = np.flatnonzero(times)
    low, times, at = low[hit], times[hit], pos[hit]
    kind = np.searchsorted(x.common, gram)
    hit = np.flatnonzero(x.common[np.minimum(kind, len(x.common) - 1)] == gram) if len(x.common) else np.zeros(0, np.int64)
    code, place = row[pos[hit]] * len(x.common) + kind[hit], pos[hit]
    pairs = _common_pairs(x, h, row, place) if len(place) else np.zeros(0, np.int64)
    order = np.argsort(code, kind="stable")
    code, place = code[order], place[order]
    doc, item = pairs // len(x.ids), pairs % len(x.ids)
    size = x.common_edge[item + 1] - x.common_edge[item]
    rows = int(row[-1]) + 1
    load = np.bincount(row[at], times, rows) + np.bincount(doc, size, rows)
    part = (np.cumsum(load) // _HITS).astype(np.int64)  # rows are taken together while they have few hits
    out = []
    for k in np.unique(part[load > 0]):
        a, b = np.searchsorted(part, k), np.searchsorted(part, k, "right")
        some = slice(*np.searchsorted(row[at], [a, b]))
        seed = _spread(low[some], times[some])
        twin = slice(*np.searchsorted(doc, [a, b]))
        own = _spread(x.common_edge[item[twin]], size[twin])
        wanted = np.repeat(doc[twin], size[twin]) * len(x.common) + x.common_gram[own]
        first = np.searchsorted(code, wanted)
        many = np.searchsorted(code, wanted, "right") - first
        met = np.concatenate((x.seed_item[seed], np.repeat(np.repeat(item[twin], size[twin]), many)))
        offset = np.concatenate((x.seed_offset[seed], np.repeat(x.common_offset[own], many)))
        where = np.concatenate((np.repeat(at[some], times[some]), place[_spread(first, many)]))
        if len(met):
            out += _aligned(x, h, row, met, offset, where, least)
    return out


def _worth(x: Items, h: np.ndarray, item: np.ndarray, a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which cases (item against the words a to b) may reach ``least``: without as large a share of the item's words in common no alignment does.
    Buckets can only count too many."""
    ok, bucket = np.zeros(len(item), bool), (h % np.uint64(_BUCKETS)).astype(np.int64)
    need = np.array([least * len(w) for w in x.words])
    room = b - a
    at = 0
    while at < len(item):
        end = at + max(1, int(np.searchsorted(np.cumsum(room[at : at + 100_000]), 4_000_000, "right")))
        size = room[at:end]
        start = np.cumsum(size) - size
        word = np.repeat(a[at:end] - start, size) + np.arange(size.sum())
        common = np.add.reduceat(x.table[np.repeat(item[at:end], size), bucket[word]].astype(np.int32), start)
        ok[at:end] = common >= need[item[at:end]] - 1e-9
        at = end
    return ok


def _together(cases: list[tuple[int, int, int, int]]) -> Iterator[list[tuple[int, int, int, int]]]:
    """Cases, sorted by the width of their passage, in batches whose tables have at most _CELLS cells a word; a wider case is alone."""
    at = 0
    for end in range(1, len(cases) + 1):
        if end == len(cases) or (end + 1 - at) * (cases[end][3] - cases[end][2]) > _CELLS or end - at == 1024:
            yield cases[at:end]
            at = end


def _aligned(x: Items, h: np.ndarray, row: np.ndarray, item: np.ndarray, offset: np.ndarray, pos: np.ndarray, least: float) -> list[tuple[int, int, float, int, int]]:
    start = pos - offset
    order = np.lexsort((start, item, row[pos]))
    item, start, doc = item[order], start[order], row[pos][order]
    size = np.array([len(w) for w in x.words])
    slack = size // 4 + 4
    new = np.ones(len(item), bool)
    new[1:] = (np.diff(doc) != 0) | (np.diff(item) != 0) | (np.diff(start) > slack[item[1:]])
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(item)])) - 1 if len(first) else first
    edge = np.searchsorted(row, np.arange(int(row[-1]) + 2)) if len(row) else np.zeros(1, np.int64)
    i, d = item[first], doc[first]
    a = np.maximum(edge[d], start[first] - slack[i])
    b = np.minimum(edge[d + 1], start[last] + size[i] + slack[i])
    step, span = 8 * size[i] + 64, 2 * size[i] + 2 * slack[i]  # many starts in a row: pieces that overlap by more than an alignment can span
    pieces = np.maximum(1, -(-(b - span - a) // step))
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    i, d, a, b, step, span = (np.repeat(v, pieces) for v in (i, d, a, b, step, span))
    a = a + nth * step
    b = np.minimum(b, a + step + span)
    ok = _worth(x, h, i, a, b, least)
    cases = list(zip(*(v[ok].tolist() for v in (i, d, a, b)), strict=True))
    cases.sort(key=lambda c: (c[3] - c[2], size[c[0]]))
    best: dict[tuple[int, int], tuple[float, int, int]] = {}
    for some in _together(cases):
        n, width = max(size[c[0]] for c in some), max(c[3] - c[2] for c in some)
        a, b = np.zeros((len(some), n), np.uint64), np.ones((len(some), width), np.uint64)
        for k, (i, _, p, q) in enumerate(some):
            a[k, : size[i]], b[k, : q - p] = x.words[i], h[p:q]
        score, end = align(a, b, np.array([size[c[0]] for c in some]))
        for k in np.flatnonzero(score >= least):
            i, d, p, q = some[k]
            back, n_back = align(x.words[i][None, ::-1], h[p : p + end[k]][None, ::-1], size[[i]])
            got = (float(score[k]), int(p + end[k] - n_back[0] - edge[d]), int(p + end[k] - 1 - edge[d]))
            if (d, i) not in best or (got[0], -got[1]) > (best[d, i][0], -best[d, i][1]):
                best[d, i] = got
    return [(d, i, *v) for (d, i), v in sorted(best.items())]


def _blocks(docs: DataFrame, items: DataFrame, least: float, block_items: int) -> Iterator:
    """Benchmark items in blocks of about ``block_items``."""
    sc = docs.sparkSession.sparkContext
    items = items.select("item_id", "text")
    blocks = -(-items.count() // block_items)
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        x = Items([r["item_id"] for r in rows], [r["text"] for r in rows], least)
        if x.lengths:
            yield sc.broadcast(x)  # bounded by block_items


def find_passages(docs: DataFrame, items: DataFrame, least: float = 0.5, block_items: int = 20_000) -> DataFrame:
    """(doc_id, item_id, score, first_word, last_word): the best passage of each document row and benchmark item whose alignment
    scores ``least`` or more of a full match; words count from 0.

    Seeds are the 3-grams that stand at up to SHARED places of the items, however many documents hold them: a word of a document meets at
    most as many items. The commoner 3-grams, and so items without rare ones, are met by a second, exact way: an item counts only where one
    of its rarest words stands near, of which the score needs one. A document is aligned around a seed unless too few words of the item stand
    there for the score. Only a passage without three words of its item in a row has no seed.
    Null or empty texts and items match nothing. Items that repeat and documents that repeat give rows of their own. Documents are read in
    place and never shuffled; items are taken in blocks of a bounded size.
    """
    out = None
    schema = "doc_id bigint, item_id bigint, score double, first_word bigint, last_word bigint"
    for held in _blocks(docs, items, least, block_items):

        def each(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = texts_buffer(batch.column(1))
                ids, found = batch.column(0).to_pylist(), []
                for low, high in parts(offsets):
                    h, row = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    found += [(ids[low + d], held.value.ids[i], *x) for d, i, *x in _matches(held.value, h, row, least)]
                columns = list(zip(*found, strict=True)) or [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "score", "first_word", "last_word"])

        one = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, schema)
        out = one if out is None else out.unionAll(one)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, least: float = 0.5, block_items: int = 20_000) -> DataFrame:
    """The rows in which no passage is found; rows and columns are otherwise as they were."""
    at = docs.columns.index("text")
    for held in _blocks(docs, items, least, block_items):

        def each(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = texts_buffer(batch.column(at))
                keep = np.ones(batch.num_rows, bool)
                for low, high in parts(offsets):
                    h, row = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                    keep[[low + m[0] for m in _matches(held.value, h, row, least)]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(each, docs.schema)
    return docs
