"""Ranked lexical search: a threshold-seeded join of postings with items, exact in every rank."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import parts, pinned, shared_dir, texts_buffer, words

#: Bits of the filter of items' terms that tasks hold (4 MB, whatever the number of terms); a word that passes by chance finds no item later.
FILTER_BITS = 1 << 25
_PART = 2 << 20
#: Entries (item, term) of a block of items (24 MB).
BLOCK_TERMS = 1_000_000


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once: term is a 64-bit hash of a lower-case word. Rows of one item_id are one item; a null text has no terms."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts_buffer(batch.column(1))
            for low, high in parts(offsets, _PART):
                h, row = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(pa.array(row)), pa.array(h.view(np.int64))], ["item_id", "term"])

    return items.select("item_id", "text").mapInArrow(each, f"item_id {items.schema['item_id'].dataType.simpleString()}, term bigint").distinct()


def _filter(terms: DataFrame) -> np.ndarray:
    """The filter as bytes: Spark sets the bits of each 64-bit word, so at most FILTER_BITS / 64 words reach the driver."""
    bit = F.pmod("term", F.lit(FILTER_BITS))
    rows = terms.select(F.shiftright(bit, 6).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod(term, {FILTER_BITS}) % 64 as int))").alias("b"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in rows.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint8)


def term_vectors(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(row, doc_id, n, terms, counts) for each row with a term: n counts all its terms with repeats; terms, in order, and counts are those that may stand in an item."""
    held = docs.sparkSession.sparkContext.broadcast(_filter(terms))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            data, offsets = texts_buffer(batch.column(1))
            for low, high in parts(offsets, _PART):
                h, row = words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                n = np.bincount(row, minlength=high - low)
                bit = h & np.uint64(FILTER_BITS - 1)
                some = np.flatnonzero((bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1)
                h, row = h[some].view(np.int64), row[some]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                first = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
                count = np.diff(np.concatenate((first, [len(h)]))).astype(np.int32)
                ends = pa.array(np.searchsorted(row[first], np.arange(high - low + 1)).astype(np.int32))
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(low, high - low), pa.array(n), pa.ListArray.from_arrays(ends, pa.array(h[first])), pa.ListArray.from_arrays(ends, pa.array(count))],
                    ["doc_id", "n", "terms", "counts"],
                )
                yield out.filter(pa.array(n > 0))

    found = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(each, "doc_id bigint, n bigint, terms array<bigint>, counts array<int>")
    return pinned(found.withColumn("row", F.monotonically_increasing_id()))


class ItemBlock:
    """Terms of some items, as tasks hold them: at most about BLOCK_TERMS (item, term) entries."""

    def __init__(self, entries: pa.Table):
        self.ids = entries["item_id"].combine_chunks().dictionary_encode()
        item, self.ids = self.ids.indices.to_numpy().astype(np.int64), self.ids.dictionary
        term, w = entries["term"].to_numpy(), entries["w"].to_numpy()
        order = np.lexsort((term, item))
        self.begin = np.searchsorted(item[order], np.arange(len(self.ids) + 1))
        self.vocabulary, at = np.unique(term, return_inverse=True)
        self.own = at[order]  # terms of each item, by their number
        self.weight = np.zeros(len(self.vocabulary), np.int64)
        self.weight[at] = w
        self.need, self.bound = np.zeros(len(self.ids), np.int64), np.zeros(len(self.ids), np.int64)
        if "need" in entries.column_names:
            self.need[item], self.bound[item] = entries["need"].to_numpy(), entries["bound"].to_numpy()
            keep = np.flatnonzero(entries["essential"].to_numpy(zero_copy_only=False))
            keep = keep[np.argsort(at[keep], kind="stable")]
            self.items = item[keep]  # items in which each term is essential
            self.first = np.searchsorted(at[keep], np.arange(len(self.vocabulary) + 1))

    def postings(self, terms: pa.ListArray, counts: pa.ListArray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of the term, part of the impact) of the rows' terms that the items hold, in order of row and term."""
        row = np.repeat(np.arange(len(terms)), np.diff(terms.offsets.to_numpy()))
        t, tf = terms.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        at = np.minimum(np.searchsorted(self.vocabulary, t), max(0, len(self.vocabulary) - 1))
        hit = np.flatnonzero(self.vocabulary[at] == t) if len(self.vocabulary) else np.zeros(0, np.int64)
        row, tf = row[hit], tf[hit]
        return row, at[hit], (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])

    def scores(self, posts: tuple[np.ndarray, np.ndarray, np.ndarray], row: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Exact score of each pair (row, item)."""
        of, term, part = posts
        key, size = of * len(self.vocabulary) + term, np.diff(self.begin)[item]
        pair = np.repeat(np.arange(len(row)), size)
        want = self.own[np.repeat(self.begin[item], size) + np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size)]
        at = np.searchsorted(key, wanted := row[pair] * len(self.vocabulary) + want)
        hit = np.flatnonzero(at < len(key))
        hit = hit[key[at[hit]] == wanted[hit]]
        out = np.zeros(len(row), np.int64)
        np.add.at(out, pair[hit], self.weight[want[hit]] * part[at[hit]])
        return out

    def candidates(self, posts: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (row, item) whose essential terms, with all that left-out terms could add, reach the item's bound."""
        row, term, part = posts
        size = np.diff(self.first)[term]
        done, ends = 0, np.searchsorted(row, np.arange(rows + 1))
        total = np.concatenate(([0], np.cumsum(size)))
        while done < rows:  # rows whose postings meet about ``at_once`` entries
            end = max(done + 1, int(np.searchsorted(total[ends], total[ends[done]] + at_once, "right")) - 1)
            some = slice(ends[done], ends[end])
            n = size[some]
            item = self.items[np.repeat(self.first[term[some]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            pair, at = np.unique(np.repeat(row[some], n) * len(self.ids) + item, return_inverse=True)
            reached = np.bincount(at, np.repeat(self.weight[term[some]] * part[some], n).astype(np.float64), len(pair))  # whole numbers below 2^53
            r, i = np.divmod(pair, max(1, len(self.ids)))
            ok = reached >= self.need[i]
            yield r[ok], i[ok]
            done = end


def _in_blocks(entries: DataFrame, vectors: DataFrame, each, columns: list[str], seeds: DataFrame | None = None) -> DataFrame:
    """(item_id, row, doc_id, score) of ``each(ItemBlock, batch)`` over the rows of vectors, block by block of items; a block is one job."""
    spark = vectors.sparkSession
    out = f"{shared_dir(spark)}/ranked-{uuid4().hex}"
    kind = entries.schema["item_id"].dataType.simpleString()
    blocks = max(1, -(-entries.count() // BLOCK_TERMS))
    for k in range(blocks):
        mine = lambda x, k=k: x.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast(ItemBlock(mine(entries).select(*columns).toArrow()))
        rows = vectors.select("row", "doc_id", "m", "terms", "counts")
        if seeds is not None:
            rows = mine(seeds).groupBy("row").agg(F.collect_list("item_id").alias("item_ids")).join(rows, "row").select("row", "doc_id", "m", "terms", "counts", "item_ids")

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            for batch in batches:
                posts = block.postings(batch.column(3), batch.column(4), batch.column(2).to_numpy())
                for row, item, score in each(block, posts, batch):
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(item)), batch.column(0).take(at), batch.column(1).take(at), pa.array(score)], ["item_id", "row", "doc_id", "score"])

        rows.mapInArrow(run, f"item_id {kind}, row bigint, doc_id bigint, score bigint").write.mode("append").parquet(out)
    return spark.read.schema(f"item_id {kind}, row bigint, doc_id bigint, score bigint").parquet(out)


def _of_seeds(block: ItemBlock, posts, batch: pa.RecordBatch):
    asked = batch.column(5)
    row = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
    item = pa.compute.index_in(asked.flatten(), block.ids).to_numpy(zero_copy_only=False).astype(np.int64)
    yield row, item, block.scores(posts, row, item)


def _of_candidates(block: ItemBlock, posts, batch: pa.RecordBatch):
    for row, item in block.candidates(posts, batch.num_rows):
        score = block.scores(posts, row, item)
        ok = score >= block.bound[item]
        yield row[ok], item[ok], score[ok]


def search(docs: DataFrame, items: DataFrame, k: int = 10, stored: int = 32) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring rows of docs for each item (fewer where fewer score above 0), equal scores by ascending doc_id.

    A term is a run of ASCII letters and digits and of non-ASCII characters, ASCII case folded; its weight is floor(1000 * ln((2 N + 2) / (2 df + 1))), and a row's score sums
    w * ((10^9 tf) div (1000 tf + 8 m)) over the item's terms, with m = 10 + (90 n N) div L.

    1. Rows keep the terms that a filter of fixed size lets through. 2. The ``stored`` largest impacts of each term are stored with their rows; the kth of them is a lower bound of the
    kth score of every item with that term, and the exact scores of an item's stored rows raise it. 3. An item's terms are ordered by largest impact; those whose impacts from there on sum to less than
    the bound can't make a row enter the list by themselves and are left out of the join. 4. Postings of the other terms meet the items; pairs of which the sum, with all that
    left-out terms could add, reaches the bound are scored exactly, and what reaches the bound is ranked. So no cap is set and no row lost.

    Items are a stated query set: their terms go to the rows in blocks of about BLOCK_TERMS entries, one job a block, so a hot term shuffles no postings. Null texts hold no term; null and repeated doc_ids are rows of their own, nulls first
    among equal scores; rows of one item_id are one item; other columns are ignored. 64-bit hashes stand for terms.
    """
    asked = pinned(item_terms(items))
    vectors = term_vectors(docs, asked)
    total = vectors.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
    N, L = total["N"], total["L"] or 1
    vectors = vectors.withColumn("m", 10 + F.expr(f"(90L * n * {N}L) div {L}L"))
    postings = vectors.select("row", "m", F.explode(F.arrays_zip("terms", "counts")).alias("p")).select("row", "m", F.col("p.terms").alias("term"), F.col("p.counts").cast("bigint").alias("tf"))
    df = postings.groupBy("term").agg(F.count("*").alias("df")).join(asked.select("term").distinct(), "term")
    weight = F.floor(1000 * F.ln((2 * F.lit(float(N)) + 2) / (2 * F.col("df").cast("double") + 1))).cast("bigint")
    weights = pinned(df.select("term", weight.alias("w")).where("w > 0"))

    # The part of an impact that the weight multiplies orders a term's rows already.
    part = F.expr("(1000000000L * tf) div (1000L * tf + 8L * m)")
    best = Window.partitionBy("term").orderBy(F.desc("part"), "row")
    top = postings.select("term", "row", part.alias("part")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= stored)
    top = pinned(top.join(weights, "term").select("term", "row", "place", (F.col("w") * F.col("part")).alias("impact")))
    terms = pinned(asked.join(weights, "term").join(top.where("place = 1").select("term", F.col("impact").alias("most")), "term"))
    seeds = pinned(terms.select("item_id", "term").join(top.select("term", "row"), "term").select("item_id", "row").distinct())
    scored = _in_blocks(terms, vectors, _of_seeds, ["item_id", "term", "w"], seeds)
    by_score = Window.partitionBy("item_id").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first(), "row")
    ranked = lambda x: x.where("score > 0").withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= k)
    bound = ranked(scored).where(F.col("rank") == k).select("item_id", F.col("score").alias("bound"))

    after = Window.partitionBy("item_id").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)  # one row a term of the item
    suffix = terms.withColumn("suffix", F.sum("most").over(after)).join(bound, "item_id", "left").withColumn("bound", F.coalesce("bound", F.lit(1).cast("bigint")))
    left_out = F.max(F.when(F.col("suffix") < F.col("bound"), F.col("suffix"))).over(Window.partitionBy("item_id"))
    entries = suffix.withColumn("need", F.col("bound") - F.coalesce(left_out, F.lit(0))).withColumn("essential", F.col("suffix") >= F.col("bound"))
    found = _in_blocks(pinned(entries), vectors, _of_candidates, ["item_id", "term", "w", "essential", "need", "bound"])
    return ranked(found).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


SEARCH_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
       '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
n AS (SELECT r, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY r),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
p AS (SELECT r, term, count(*) AS tf FROM d SEMI JOIN q USING (term) GROUP BY r, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn)::DOUBLE + 2) / (2 * count(*)::DOUBLE + 1)))::BIGINT AS w FROM p, s GROUP BY term),
x AS (SELECT q.item_id, p.r, sum(w.w * ((1000000000 * p.tf) // (1000 * p.tf + 8 * (10 + (90 * n.n * s.nn) // s.ll))))::BIGINT AS score
      FROM q JOIN p USING (term) JOIN w USING (term) JOIN n USING (r), s GROUP BY q.item_id, p.r),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM x JOIN n USING (r) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= 10"""
