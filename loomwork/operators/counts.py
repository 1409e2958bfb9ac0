"""What tasks of a lexical search do: terms of texts are counted, and the best texts of questions found, both over Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

from loomwork.functions.text import B, K1, STOP_WORDS

#: Words that are counted at once, words remembered, and counts of terms that are scored at once.
_WORDS, _MEMORY, _SHARD = 400_000, 100_000, 1_000_000
_STOP, _MARKS = frozenset(STOP_WORDS), re.compile("[.+/_-]+")
_OTHER = (1, [])  # most words: one term that nobody asks for


def _give_back() -> None:
    """Freed memory goes back to the system; else a worker holds its peak while other stages run."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def word_forms(word: str) -> list[str]:
    """Search terms of one raw token, as ``loomwork.functions.text.token_forms`` has them."""
    if word in _STOP:
        return []
    if "㐀" <= word[0] <= "鿿":
        return [word[i : i + 2] for i in range(max(len(word) - 1, 1))]
    s = word.rstrip(".+/_-")
    if s in _STOP:
        return []
    parts = [p for p in _MARKS.split(s) if p and p not in _STOP]
    return list(dict.fromkeys([s, *parts, "".join(parts)])) if len(parts) > 1 else [s]


def term_counts(batches: Iterable, terms: dict[str, int]) -> Iterator:
    """(*keys, len, terms, counts) of batches (*keys, words); rows without a term are left out."""
    import numpy as np
    import pyarrow as pa

    known: dict[str, tuple[int, list[int]]] = {}

    def look(word: str) -> tuple[int, list[int]]:
        forms = word_forms(word)
        ids = [terms[f] for f in forms if f in terms]
        known[word] = found = (len(forms), ids) if ids or len(forms) != 1 else _OTHER
        return found

    def count(batch):
        rows, words, n = batch.num_rows, batch.column(batch.num_columns - 1), max(len(terms), 1)
        coded = words.flatten().dictionary_encode()
        of = [known.get(w) or look(w) for w in coded.dictionary.to_pylist()]
        code, row = coded.indices.to_numpy(), np.repeat(np.arange(rows), np.diff(words.offsets.to_numpy()))
        length = np.bincount(row, np.array([x[0] for x in of], float)[code], rows).astype(np.int64)
        many, flat = np.array([len(x[1]) for x in of], np.int64), np.array([i for x in of for i in x[1]], np.int64)
        hit = np.flatnonzero(many[code])
        code, row = code[hit], row[hit]
        times = many[code]
        at = np.repeat((np.cumsum(many) - many)[code] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        pair, tf = np.unique(np.repeat(row, times) * n + flat[at], return_counts=True)
        ends = pa.array(np.searchsorted(pair, np.arange(rows + 1) * n).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % n, tf)]
        out = pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(length), *lists], [*batch.schema.names[:-1], "len", "terms", "counts"])
        return out.filter(pa.array(length > 0))

    for whole in batches:
        step = max(1, whole.num_rows * _WORDS // max(len(whole.column(whole.num_columns - 1).flatten()), 1))
        for low in range(0, whole.num_rows, step):
            if len(known) > _MEMORY:
                known.clear()
            yield count(whole.slice(low, step))
        del whole
        _give_back()
    known.clear()
    _give_back()


class _Best:
    """The best texts so far of each question."""

    def __init__(self, begin, terms: list[int], keys: list[str], most: int):
        import numpy as np

        self.keys, self.most, self.rows = keys, most, None
        self.asked = [terms[a:b] for a, b in zip(begin[:-1], begin[1:], strict=True)]
        self.least = np.zeros(len(self.asked), np.int64)  # what a text needs to be among them, in ten-billionths

    def add(self, part, weight, average: float) -> None:
        """Score part(*keys, len, terms, counts) for all questions. Weights count in ten-billionths, so sums are exact; the least is one, which tells a text met from one that isn't."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        part = part.take(pc.sort_indices(part.select(self.keys), sort_keys=[(k, "ascending") for k in self.keys]))
        n, lists = part.num_rows, part["terms"].combine_chunks()
        row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        term, tf, length = lists.flatten().to_numpy(), part["counts"].combine_chunks().flatten().to_numpy().astype(float), part["len"].to_numpy()
        w = tf * (K1 + 1) / (tf + K1 * ((1 - B) + B * length[row] / average)) * weight[term]
        by = np.argsort(term, kind="stable")
        row, w, start = row[by], np.maximum(np.rint(w[by] * 1e10), 1).astype(np.int64), np.searchsorted(term[by], np.arange(len(weight) + 1)).tolist()
        total, found = np.zeros(n, np.int64), []
        for i, asked in enumerate(self.asked):
            new = []
            for t in asked:
                a, b = start[t], start[t + 1]
                if a == b:
                    continue
                at = row[a:b]
                was = total[at]
                new.append(at[was == 0] if new else at)
                total[at] = was + w[a:b]
            if not new:
                continue
            at = np.concatenate(new) if len(new) > 1 else new[0]
            sums = total[at]
            total[at] = 0
            if self.least[i]:
                good = sums >= self.least[i]
                at, sums = at[good], sums[good]
            score = ((sums + 50) // 100 + 5000) // 10000  # rounded at eight decimals and then at four, as the SQL does
            if len(at) > self.most:  # rows are in order of their keys, so this is the order by score and key
                first = np.partition(score * n + (n - 1 - at), len(at) - self.most)[len(at) - self.most :]
                score, at = first // n, n - 1 - first % n
            found.append((np.full(len(at), i), score, at))
        if not found:
            return
        q, score, at = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = pa.table({"_q": q, "_s": score} | {k: part[k].take(pa.array(at)) for k in self.keys})
        rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("_q", "ascending"), ("_s", "descending"), *[(k, "ascending") for k in self.keys]]))
        q = rows["_q"].to_numpy()
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        last = np.flatnonzero(nth == self.most - 1)
        self.least[q[last]] = np.maximum(rows["_s"].to_numpy()[last] * 1_000_000 - 500_050, 0)
        self.rows = rows.filter(pa.array(nth < self.most))


def best_texts(batches: Iterable, questions, terms: list[int], weights, n_terms: int, keys: Sequence[str], scope: str | None, most: int, average: float) -> Iterator:
    """(question, *keys, scope, score) of the ``most`` best of batches (*keys, scope, len, terms, counts) for each question and scope; questions and terms are parallel and in order of questions."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    weight = np.zeros(n_terms)
    weight[weights["t"].to_numpy()] = weights["w"].to_numpy()
    coded = questions.dictionary_encode()
    begin = np.searchsorted(coded.indices.to_numpy(), np.arange(len(coded.dictionary) + 1)).tolist()
    best: dict[object, _Best] = {}
    waiting: dict[object, list] = {}
    held = 0

    def score() -> None:
        for name, parts in waiting.items():
            if name not in best:
                best[name] = _Best(begin, terms, list(keys), most)
            best[name].add(pa.Table.from_batches(parts), weight, average)
        waiting.clear()
        _give_back()

    for batch in batches:
        batch = batch.filter(pc.greater(pc.list_value_length(batch.column("terms")), 0))
        names = batch.column(scope).unique().to_pylist() if scope else [None]
        for name in names:
            same = batch if not scope else batch.filter(pc.is_null(batch.column(scope)) if name is None else pc.equal(batch.column(scope), name))
            if same.num_rows:
                waiting.setdefault(name, []).append(same)
                held += len(same.column("terms").flatten())
        if held >= _SHARD:
            score()
            held = 0
    score()
    for name, b in best.items():
        if b.rows is None:
            continue
        rows = {"question": coded.dictionary.take(b.rows["_q"])} | {k: b.rows[k] for k in keys}
        if scope:
            rows[scope] = pa.array([name] * len(b.rows), batch.schema.field(scope).type)
        yield from pa.table(rows | {"score": pa.array(b.rows["_s"].to_numpy() / 10000)}).to_batches(max_chunksize=65536)
        b.rows = rows = None
    _give_back()


def held_words(batches: Iterable, words: Sequence[str]) -> Iterator:
    """(row, hits) of batches (row, text): the sorted numbers of the ``words`` that stand in each text, whole or inside others. Words are walked letter by letter, so those that begin alike cost no more."""
    import pyarrow as pa

    root: dict = {}
    for i, word in enumerate(words):
        node = root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = i
    for batch in batches:
        hits = []
        for text in batch.column(1).to_pylist():
            found = set()
            for k, c in enumerate(text):
                node, at = root.get(c), k
                while node is not None:
                    if "" in node:
                        found.add(node[""])
                    at += 1
                    node = node.get(text[at]) if at < len(text) else None
            hits.append(sorted(found))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, pa.list_(pa.int32()))], ["row", "hits"])
