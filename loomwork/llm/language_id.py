"""Language identification with a byte convolutional network trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import lean, parts, texts_buffer

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
DIMS = 6
UNKNOWN = "und"


class ByteCnn:
    """Byte embedding, filters of several widths, maximum over the window, softmax."""

    def __init__(self, classes: list[str], seed: int = 3):
        rng = np.random.default_rng(seed)
        self.classes = classes
        scale = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        self.p = {"embed": scale(256, DIMS) * 0.5}
        for w in WIDTHS:
            self.p[f"w{w}"] = scale(w * DIMS, FILTERS) / np.float32(np.sqrt(w * DIMS))
        self.p["out"] = scale(len(WIDTHS) * FILTERS, len(classes)) * 0.1
        self.p["bias"] = np.zeros(len(classes), np.float32)

    def _pooled(self, x: np.ndarray, keep: bool = False):
        e = self.p["embed"][x].reshape(len(x), -1)
        pooled, where, views = [], [], []
        for w in WIDTHS:
            v = np.lib.stride_tricks.sliding_window_view(e, w * DIMS, axis=1)[:, ::DIMS]
            z = v.reshape(-1, w * DIMS) @ self.p[f"w{w}"]
            z = z.reshape(len(x), -1, FILTERS)
            if keep:
                at = z.argmax(1)
                where.append(at)
                views.append(v)
                pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0])
            else:
                pooled.append(z.max(1))
        return np.maximum(np.concatenate(pooled, 1), 0), where, views

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.classes)), np.float32)
        for at in range(0, len(x), 256):  # a few MB of filter outputs at a time
            z = self._pooled(x[at : at + 256])[0] @ self.p["out"] + self.p["bias"]
            z = np.exp(z - z.max(1, keepdims=True))
            out[at : at + 256] = z / z.sum(1, keepdims=True)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 128, rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        t, steps = 0, epochs * max(1, -(-len(x) // batch))
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for low in range(0, len(x), batch):
                at = order[low : low + batch]
                xs, t = x[at], t + 1
                pooled, where, views = self._pooled(xs, True)
                z = pooled @ self.p["out"] + self.p["bias"]
                z = np.exp(z - z.max(1, keepdims=True))
                d = z / z.sum(1, keepdims=True)
                d[np.arange(len(at)), y[at]] -= 1
                d /= len(at)
                g = {"out": pooled.T @ d, "bias": d.sum(0), "embed": np.zeros_like(self.p["embed"])}
                back = (d @ self.p["out"].T) * (pooled > 0)
                for k, w in enumerate(WIDTHS):
                    b = back[:, k * FILTERS : (k + 1) * FILTERS]
                    best = views[k][np.arange(len(at))[:, None], where[k]]  # (row, filter, w * DIMS)
                    g[f"w{w}"] = np.einsum("bfi,bf->if", best, b)
                    to = b[:, :, None] * self.p[f"w{w}"].T[None]
                    bytes_ = xs[np.arange(len(at))[:, None, None], where[k][:, :, None] + np.arange(w)]
                    np.add.at(g["embed"], bytes_.ravel(), to.reshape(-1, DIMS))
                step = rate * min(1.0, 2 * (1 - t / (steps + 1)))
                for k in self.p:  # Adam
                    m[k] += 0.1 * (g[k] - m[k])
                    s[k] += 0.01 * (g[k] ** 2 - s[k])
                    self.p[k] -= (step * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)).astype(np.float32)


def windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row, share) of whole texts: consecutive stretches of WINDOW bytes; the last is filled up with zeros."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + nth * WINDOW
    length = np.minimum(WINDOW, offsets[row + 1] - start)
    at = start[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < length[:, None]
    return np.where(inside, data[np.minimum(at, max(len(data) - 1, 0))], 0), row, length / WINDOW


def noise(x: np.ndarray, seed: int = 13) -> np.ndarray:
    """Windows in no language, made of the windows x: their bytes in random order, or random printable characters."""
    rng = np.random.default_rng(seed)
    out = rng.permuted(x, axis=1)
    some = rng.random(len(x)) < 0.5
    out[some] = rng.integers(33, 127, (some.sum(), x.shape[1]))
    out[rng.random(len(x)) < 0.3, 40:] = 0
    return out


def sample(docs: DataFrame, rows_per_language: int, windows_per_row: int) -> pa.Table:
    """(lang, h, cut): windows of about ``rows_per_language`` different texts of each language, at most so many, spread over the whole text.

    A text is in the sample where its hash is low enough for the number of different texts of its language, so copies count
    once and no task sees a language as a whole; of what comes to the driver, a few more than asked for, the lowest hashes stay.
    """
    label = docs.where("lang is not null and text is not null and length(text) > 0").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = label.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    chance = F.pmod("h", F.lit(1_000_003)) < F.lit(1_000_003 * 1.25 * rows_per_language) / F.col("n")
    places = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(windows_per_row - 1)), lambda i: F.floor(i * F.length("text") / windows_per_row)))
    cut = F.transform(places, lambda p: F.substring(F.col("text"), (p + 1).cast("int"), F.lit(WINDOW)))
    some = label.join(F.broadcast(counts), "lang").where(chance)  # one row a language
    got = some.groupBy("lang", "h").agg(F.min(cut).alias("cut")).orderBy("lang", F.pmod("h", F.lit(1_000_003)), "h").toArrow()
    if not got.num_rows:
        return got
    names = np.array(got["lang"].to_pylist(), object)
    start = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
    nth = np.arange(len(names)) - np.repeat(start, np.diff(np.concatenate((start, [len(names)]))))
    got = got.filter(pa.array(nth < rows_per_language))
    cuts = got["cut"].combine_chunks()
    row = np.repeat(np.arange(len(cuts)), cuts.value_lengths().to_numpy())
    return pa.table({"lang": got["lang"].take(pa.array(row)), "cut": cuts.flatten()})


def train(docs: DataFrame, rows_per_language: int = 600, windows_per_row: int = 6, reject: bool = False) -> ByteCnn | None:
    """Fit on the windows of ``sample``; None without labelled text. With ``reject``, windows of ``noise`` are a class UNKNOWN."""
    got = sample(docs, rows_per_language, windows_per_row)
    if not got.num_rows:
        return None
    names = got["lang"].to_pylist()
    classes = sorted(set(names))
    number = {c: i for i, c in enumerate(classes)}
    x = np.zeros((len(names), WINDOW), np.uint8)
    for i, text in enumerate(got["cut"].to_pylist()):
        raw = np.frombuffer(text.encode()[:WINDOW], np.uint8)
        x[i, : len(raw)] = raw
    y = np.array([number[n] for n in names])
    net = ByteCnn([*classes, UNKNOWN] if reject else classes)
    short = x.copy()  # short texts occur too: the same windows, cut at a tenth to a half
    short[np.arange(WINDOW) >= np.random.default_rng(9).integers(WINDOW // 10, WINDOW // 2, len(x))[:, None]] = 0
    x, y = np.concatenate((x, short)), np.concatenate((y, y))
    if reject:
        none = noise(x[:: max(1, len(classes) // 2)])
        x, y = np.concatenate((x, none)), np.concatenate((y, np.full(len(none), len(classes))))
    net.fit(x, y, epochs=max(4, 20_000 // len(x)))  # a few hundred steps at least
    return net


def _predict(net: ByteCnn | None, column: pa.Array) -> tuple[list[str], np.ndarray]:
    texts = column.to_pylist()
    data, offsets = texts_buffer(column)
    n = len(texts)
    total = np.zeros((n, len(net.classes) if net else 1))
    if net:
        for low, high in parts(offsets, 1 << 20):
            x, row, share = windows(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
            if len(x):
                np.add.at(total, low + row, net.probabilities(x) * share[:, None])
    total /= np.maximum(total.sum(1, keepdims=True), 1e-9)
    best = total.argmax(1)
    known = [bool(net) and t is not None and any(map(str.isalpha, t)) for t in texts]
    return [net.classes[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, total.max(1), 0.0)


def held_out(doc_id=None):
    """Whether a document is kept out of training: crc32 of its id as text leaves 2 when divided by 4."""
    key = F.col("doc_id") if doc_id is None else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, rows_per_language: int = 600) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of documents.

    Learned from the rows that are not held out and have a lang; predicted from the text alone, over windows of the whole text
    whose probabilities are averaged by length. A null text or one without a letter is ``und`` with score 0, as is every
    text where there is nothing to learn from. Repeated rows and null doc_ids (never held out) are rows of their own.
    """
    net = train(docs.where(~held_out()), rows_per_language)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = _predict(net, batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("bigint"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(each, "doc_id bigint, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows whose text is in one of the languages of ``lang``, by a net that also knows windows in none: UNKNOWN must not be the likeliest,
    and the language has a probability of ``least`` or more over the whole text. A null lang becomes the language found; other columns stay as they are.

    Null texts, texts without a letter and, where no row has a lang, all rows go.
    """
    net, at, named = train(docs.where(~held_out()), reject=True), docs.columns.index("text"), docs.columns.index("lang")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, score = _predict(net, batch.column(at))
            columns = list(batch.columns)
            columns[named] = pc.coalesce(columns[named], pa.array(names, columns[named].type))
            out = pa.RecordBatch.from_arrays(columns, schema=batch.schema)
            yield out.filter(pa.array((np.array(names, object) != UNKNOWN) & (score >= least)))

    return docs.mapInArrow(lean(each), docs.schema)
