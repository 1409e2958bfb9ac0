"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree deals exact block quotas of sources among output shards."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import pinned
from loomwork.llm.sharding import ROUNDS

#: Words of a block at most, and blocks that make up a target at least (a source's blocks are never shorter than a word).
BLOCK_WORDS = 256
TARGET_BLOCKS = 256
#: No document is taken more often.
MOST_TIMES = 3
_SPACE = r"[\x20\x09-\x0D]+"


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` stands for ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def sides(total: str) -> tuple[str, str]:
    """SQL of the moduli a and b of a Feistel permutation of 0..total-1, a * b >= total."""
    a = f"cast(ceil(sqrt(cast(greatest({total}, 1L) as double))) as bigint)"
    return a, f"greatest(1L, cast(ceil({total} / {a}) as bigint))"


def permuted_by(x: str, total: str, a: str, b: str, *seed: str) -> str:
    """SQL of the place of x in a permutation of 0..total-1 that ``seed`` names; total and its ``sides`` are columns.

    A walk out of the domain is no longer than the a * b - total numbers outside; above 16 of them a is over 16, and 16 steps outside have odds below 1e-18.
    """

    def feistel(v: str) -> str:
        m = f"if(fi % 2 = 0, {a}, {b})"
        turn = f"named_struct('l', fs.r, 'r', pmod(fs.l + pmod(xxhash64({', '.join(seed)}, fi, fs.r), {m}), {m}))"
        return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', {v} div {b}, 'r', pmod({v}, {b})), (fs, fi) -> {turn}, fs -> fs.l * {b} + fs.r)"

    outside = f"least({a} * {b} - {total}, 16L)"
    walk = f"if({outside} > 0, sequence(1L, {outside}), cast(array() as array<bigint>))"
    y = f"aggregate({walk}, {feistel(x)}, (pw, pi) -> if(pw >= {total}, {feistel('pw')}, pw))"
    return let(y, "pv", f"if(pv < {total}, pv, cast(raise_error('cycle walk did not end') as bigint))")


def word_count(text: Column) -> Column:
    """Number of words of a text (null: 0); words end at ASCII white space."""
    cut = F.split(text, _SPACE)
    ends = (F.element_at(cut, 1) == "").cast("int") + (F.element_at(cut, -1) == "").cast("int")
    return F.when(F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]"), F.size(cut) - ends).otherwise(0).cast("bigint")


def targets(sizes: DataFrame) -> DataFrame:
    """sizes (source, source_size) with source_no (from 0, by code point, null last), weight and target.

    Weights 1, 2, 3 repeat; targets share the sum of all sizes by weight, none above MOST_TIMES its size. What a source can't take is shared by weight among the
    others until none is above: with sources in the order of limit / weight that is one level, the highest that any prefix of full sources leaves.
    Windows here order one row a source.
    """
    byte_order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("source_no", F.row_number().over(byte_order) - 1)
    s = s.withColumn("weight", F.pmod("source_no", F.lit(3)) + 1).withColumn("_limit", F.col("source_size") * MOST_TIMES)
    filled = Window.orderBy(F.col("_limit") / F.col("weight"), "source_no")
    ahead, everything = filled.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(ahead), F.lit(0))
    s = s.withColumn("_level", left / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("target", F.least(F.col("_limit").cast("double"), F.col("weight") * F.max("_level").over(everything)))
    return s.select("source", "source_no", "source_size", "weight", "target")


def _log_factorial(n: str) -> str:
    """SQL of ln n! by Stirling's series after a shift by 8: absolute error below 1e-11."""
    low = "aggregate(sequence(1, 8), 1D, (fp, fk) -> fp * (fx - fk))"
    series = f"(fx - 0.5D) * ln(fx) - fx + {0.5 * math.log(2 * math.pi)!r}D + 1 / (12 * fx) - 1 / (360 * pow(fx, 3)) + 1 / (1260 * pow(fx, 5)) - ln({low})"
    return let(f"cast({n} as double) + 9", "fx", series)


def _log_choose(n: str, k: str) -> str:
    return f"({_log_factorial(n)} - {_log_factorial(k)} - {_log_factorial(f'{n} - {k}')})"


def hypergeometric(ours: str, others: str, draws: str, uniform: str) -> str:
    """SQL: how many of ``draws`` blocks, drawn without replacement from ``ours`` + ``others``, are ours: the quantile ``uniform`` of that distribution.

    Probabilities are added outwards from the mode, one value each side a step, for 12 standard deviations; what lies beyond has a probability below 1e-30.
    """
    more = "if(hm + hi <= hy.high, hs.up * (hx.a - hm - hi + 1) / (hm + hi) * (hx.k - hm - hi + 1) / greatest(hx.b - hx.k + hm + hi, 1L), 0D)"
    less = "if(hm - hi >= hy.low, hs.down * (hm - hi + 1) / greatest(hx.a - hm + hi, 1L) * (hx.b - hx.k + hm - hi + 1) / greatest(hx.k - hm + hi, 1L), 0D)"
    found = "case when hs.found is not null then hs.found when hx.u < hs.sum + ht.up then hm + hi when hx.u < hs.sum + ht.up + ht.down then hm - hi end"
    step = let(f"named_struct('up', {more}, 'down', {less})", "ht", f"named_struct('sum', hs.sum + ht.up + ht.down, 'up', ht.up, 'down', ht.down, 'found', {found})")
    start = "named_struct('sum', hp, 'up', hp, 'down', hp, 'found', if(hx.u < hp, hm, cast(null as bigint)))"
    share = "(hx.a / greatest(hx.a + hx.b, 1L))"
    steps = f"least(greatest(hy.high - hm, hm - hy.low), cast(ceil(12 * sqrt(greatest(hx.k * {share} * (1 - {share}), 0D)) + 30) as bigint))"
    walked = f"coalesce(aggregate({let(steps, 'hn', 'if(hn > 0, sequence(1L, hn), cast(array() as array<bigint>))')}, {start}, (hs, hi) -> {step}, hs -> hs.found), hm)"
    at_mode = f"exp({_log_choose('hx.a', 'hm')} + {_log_choose('hx.b', '(hx.k - hm)')} - {_log_choose('(hx.a + hx.b)', 'hx.k')})"
    mode = "least(hy.high, greatest(hy.low, cast(floor((hx.k + 1) * ((hx.a + 1) / (hx.a + hx.b + 2))) as bigint)))"
    inside = f"if(hy.low = hy.high, hy.low, {let(mode, 'hm', let(at_mode, 'hp', walked))})"
    ranged = let("named_struct('low', greatest(0L, hx.k - hx.b), 'high', least(hx.a, hx.k))", "hy", inside)
    return let(f"named_struct('a', {ours}, 'b', {others}, 'k', {draws}, 'u', {uniform})", "hx", ranged)


def drawn(parts: str, draws: str, *seed: str) -> Column:
    """Multivariate hypergeometric draw: for an array of (no, n) the array of (no, n, d), d of each part's n blocks, ``draws`` in all."""
    u = f"shiftrightunsigned(xxhash64({', '.join(seed)}, dx.no), 11) / 9007199254740992D"
    row = "named_struct('left', ds.left - dx.n, 'draws', ds.draws - dd, 'out', concat(ds.out, array(named_struct('no', dx.no, 'n', dx.n, 'd', dd))))"
    one = let(hypergeometric("dx.n", "ds.left - dx.n", "ds.draws", u), "dd", row)
    start = f"named_struct('left', aggregate({parts}, 0L, (ps, px) -> ps + px.n), 'draws', {draws}, 'out', cast(array() as array<struct<no:bigint,n:bigint,d:bigint>>))"
    return F.expr(f"aggregate({parts}, {start}, (ds, dx) -> {one}, ds -> ds.out)")


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_no, shard, n, total): how many of the blocks of each source a shard takes; quotas has (source_no, quota).

    A node of the tree is a range of shards. Its left half takes its share of the node's blocks (shards differ by one block at most), and a multivariate hypergeometric draw
    tells how many of each source those are. Sources are drawn in two steps, groups of about their number's root first and then sources in each group, so
    that no row holds them all. A level of the tree is one job over (nodes x sources) rows.
    """
    count, total = quotas.agg(F.count("*"), F.sum("quota")).first()
    group = math.isqrt(max(count, 1)) + 1
    bound = lambda shard: f"cast(floor({shard} * {total or 0}L / {shards}) as bigint)"
    node = quotas.select(F.lit(0).alias("lo"), F.lit(shards).alias("hi"), F.col("source_no").cast("bigint").alias("no"), F.col("quota").alias("n"))
    size, level, keys = shards, 0, ["lo", "hi"]
    while size > 1:
        level += 1
        # A node of one shard passes down as it is.
        grouped = node.withColumn("g", F.floor(F.col("no") / group)).groupBy(*keys, "g").agg(F.array_sort(F.collect_list(F.struct("no", "n"))).alias("parts"), F.sum("n").alias("n"))
        grouped = pinned(grouped.withColumn("mid", F.expr("lo + cast((hi - lo) div 2 as int)")))
        above = grouped.where("hi - lo > 1").groupBy(*keys, "mid").agg(F.array_sort(F.collect_list(F.struct(F.col("g").alias("no"), "n"))).alias("groups"))
        above = above.select(*keys, F.explode(drawn("groups", f"{bound('mid')} - {bound('lo')}", f"{seed}", f"{level}", "lo", "-1")).alias("x"))
        both = grouped.join(above.select(*keys, F.col("x.no").alias("g"), F.col("x.d").alias("d")), [*keys, "g"], "left")
        halves = F.when(F.col("hi") - F.col("lo") > 1, drawn("parts", "d", f"{seed}", f"{level}", "lo", "-2")).otherwise(F.expr("transform(parts, x -> named_struct('no', x.no, 'n', x.n, 'd', x.n))"))
        child = "named_struct('lo', lo, 'hi', if(hi - lo > 1, mid, hi), 'n', x.d)"
        child = f"if(hi - lo > 1, array({child}, named_struct('lo', mid, 'hi', hi, 'n', x.n - x.d)), array({child}))"
        both = both.select(*keys, "mid", F.explode(halves).alias("x"))
        node = pinned(both.select(F.col("x.no").alias("no"), F.explode(F.expr(child)).alias("c")).select("c.lo", "c.hi", "no", "c.n"))
        size = -(-size // 2)
    return node.select(F.col("no").alias("source_no"), F.col("lo").alias("shard"), "n", F.expr(f"{bound('(lo + 1)')} - {bound('lo')}").alias("total"))


def _located(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(rows, starts): each row of docs with its word count and its place among the rows of its source in a reproducible random order.

    rows has (doc_id, source, size, ahead, part): ahead counts the words of the source's rows before it in its partition; starts has (part, source, before):
    those of earlier partitions. Rows are range-partitioned by source and a hash, so a source with most rows lies in many partitions, and only a sum for each
    source of each partition is ordered.
    """
    light = docs.select(
        F.col("doc_id").cast("bigint"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
        F.xxhash64("text").alias("_t"), F.xxhash64(F.lit(seed), F.col("doc_id").cast("bigint"), "text").alias("_h"),
    )
    keys = [F.col("source").asc_nulls_last(), F.col("_h").asc(), F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("_t").asc(), F.col("_tie").asc()]
    light = pinned(light)  # dealing by range reads its input twice
    fixed = light.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie", "_h", "_t")
    fixed = pinned(fixed.withColumn("_m", F.monotonically_increasing_id())).withColumn("part", F.shiftright("_m", 33))
    inside = Window.partitionBy("part", "source").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    rows = fixed.withColumn("ahead", F.coalesce(F.sum("size").over(inside), F.lit(0))).drop("_m")
    sums = pinned(fixed.groupBy("part", "source").agg(F.sum("size").alias("n")))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def mix(docs: DataFrame, shards: int = 16, seed: int = 12, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, source, size, source_size, target, pieces) for each row: pieces has a (shard, slot, first, words) for each stretch of words that the mix takes.

    The words of a source, its rows in a reproducible random order, are cut into blocks of nearly equal length; its quota is as many of them as come nearest to its target.
    Draws go through all blocks of a source in a permuted order, and again in another one, so a block is taken at most one time more than any other of its source and none over
    MOST_TIMES. The splitting tree deals the draws among the shards, each of which takes draws of its own, and permutes them: slot is the block's place in its
    shard, gapless from 0. Pieces of a slot are in the order of first and of the source's rows.

    A null text has no words; a null source is a source of its own; repeated rows, and null doc_ids, are rows of their own; other columns are ignored. An empty table has no rows.
    """
    rows, starts = _located(docs, seed)
    named = pinned(targets(starts.groupBy("source").agg(F.sum("n").alias("source_size"))))
    length = F.greatest(F.lit(1.0), F.least(F.lit(float(block_words)), F.col("target") / TARGET_BLOCKS))
    named = named.withColumn("blocks", F.least(F.col("source_size"), F.ceil(F.col("source_size") / length)))
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("bigint"), F.col("blocks") * MOST_TIMES)).otherwise(0)
    named = named.withColumn("quota", quota.cast("bigint"))
    named = named.withColumns({c: F.expr(x) for c, x in zip("ab", sides("blocks"), strict=True)})
    dealt = pinned(split_quotas(named.select("source_no", "quota"), shards, seed))
    # Draws of a source by shard, and sources inside a shard: one row for each source and shard is ordered.
    by_shard = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    by_source = Window.partitionBy("shard").orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("first", F.coalesce(F.sum("n").over(by_shard), F.lit(0))).withColumn("offset", F.coalesce(F.sum("n").over(by_source), F.lit(0)))
    placed = placed.withColumns({c: F.expr(x) for c, x in zip("ab", sides("total"), strict=True)})
    ranges = placed.groupBy("source_no").agg(F.array_sort(F.collect_list(F.struct("shard", "first", "n", "offset", "total", "a", "b"))).alias("ranges"))
    known = starts.join(named.join(ranges, "source_no"), starts["source"].eqNullSafe(named["source"])).drop(named["source"])
    known = pinned(known.withColumnsRenamed({"part": "_part", "source": "_source"}))
    full = rows.join(known, (rows["part"] == known["_part"]) & rows["source"].eqNullSafe(known["_source"]))

    # Of a source's blocks, ``longer`` have a word more than the ``least``.
    full = full.selectExpr("*", "source_size div greatest(blocks, 1L) as least", "pmod(source_size, greatest(blocks, 1L)) as longer", "before + ahead as at").selectExpr("*", "longer * (least + 1) as edge", "at + size as end")
    block_of = lambda w: f"if({w} < edge, ({w}) div (least + 1), longer + ({w} - edge) div greatest(least, 1L))"
    start_of = lambda b: f"({b}) * least + least(({b}), longer)"
    draws = ", ".join(f"{k}L * blocks + {permuted_by('k', 'blocks', 'a', 'b', str(seed + k), 'source_no')}" for k in range(MOST_TIMES))
    slot = permuted_by("(r.offset + v - r.first)", "r.total", "r.a", "r.b", str(seed), "r.shard")
    piece = let("filter(ranges, r -> v >= r.first and v < r.first + r.n)[0]", "r", f"named_struct('shard', cast(r.shard as int), 'slot', {slot}, 'first', w.low - at, 'words', w.high - w.low)")
    words = f"named_struct('low', greatest(at, {start_of('k')}), 'high', least(end, {start_of('k + 1')}))"
    taken = let(words, "w", f"transform(filter(array({draws}), v -> v < quota), v -> {piece})")
    pieces = F.expr(f"if(size > 0, flatten(transform(sequence({block_of('at')}, {block_of('end - 1')}), k -> {taken})), null)")
    none = F.array().cast("array<struct<shard:int,slot:bigint,first:bigint,words:bigint>>")
    return full.select("doc_id", "source", "size", "source_size", "target", F.coalesce(pieces, none).alias("pieces"))


def mix_digest(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(doc_id, size, source_size, target, taken, n_pieces): taken counts the words of the row that the mix takes, repeats included."""
    taken = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + p["words"])
    return mix(docs, shards).select("doc_id", "size", "source_size", "target", taken.alias("taken"), F.size("pieces").cast("bigint").alias("n_pieces"))


def mixed_shards(docs: DataFrame, shards: int = 16) -> DataFrame:
    """(shard, slot, doc_id, source, first, words): the mix itself, in the order in which a shard is written."""
    rows = mix(docs, shards).select("doc_id", "source", F.explode("pieces").alias("p")).select("p.shard", "p.slot", "doc_id", "source", "p.first", "p.words")
    return rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot", "doc_id", "first")
