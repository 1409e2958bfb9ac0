"""Roll-ups of documents, logs, answers and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.common import exact_sum, place, rounded, share


def overview(docs: DataFrame) -> DataFrame:
    """Counts in all, by role and by publisher in one pass: (dimension, name, n, current, share)."""
    sets = docs.groupingSets([[], [F.col("role")], [F.col("publisher")]], F.col("role"), F.col("publisher"))
    out = sets.agg(F.grouping_id().alias("g"), F.count("*").alias("n"), F.count_if("current").alias("current"))
    total = F.max(F.when(F.col("dimension") == "all", F.col("n"))).over(Window.partitionBy(F.lit(0)))
    named = out.select(
        F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "role").otherwise("publisher").alias("dimension"),
        F.when(F.col("g") == 3, "").when(F.col("g") == 1, F.coalesce("role", F.lit("unknown"))).otherwise(F.coalesce("publisher", F.lit("unknown"))).alias("name"), "n", "current",
    )
    return named.withColumn("share", share(F.col("n"), total))


def daily(log: DataFrame) -> DataFrame:
    """Records of each day by kind, with the share of errors."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return log.groupBy(F.to_date("at").alias("day")).agg(
        F.count("*").alias("n"), of("view").alias("views"), of("click").alias("clicks"), of("error").alias("errors"), of("purchase").alias("purchases"), share(of("error"), F.count("*")).alias("error_rate")
    )


def sliding_count(log: DataFrame, seconds: int) -> DataFrame:
    """How many records a user had in the ``seconds`` up to each record."""
    at = F.unix_micros(F.col("at").cast("timestamp"))
    w = Window.partitionBy("user_id").orderBy(at).rangeBetween(-seconds * 1_000_000, 0)
    return log.withColumn("recent", F.count("*").over(w))


def memory(turns: DataFrame, last: int, budget: int) -> DataFrame:
    """The ``last`` turns of each conversation whole, and of the older ones those that fit ``budget`` characters, the newest first, up to the first that doesn't."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "text")
    rows = turns.withColumn("age", F.row_number().over(newest).cast("bigint"))
    used = F.sum(F.when(F.col("age") > last, F.length("text")).otherwise(0)).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("used", used.cast("bigint"))
    return rows.withColumn("kept", F.when(F.col("age") <= last, "whole").when(F.col("used") <= budget, "condensed").otherwise("left out"))


def pages(rows: DataFrame, size: int, budget: int, key: str) -> DataFrame:
    """Rows of each ``key`` until ``budget`` characters are used, at most ``size``; the place from which to read on."""
    w = Window.partitionBy(key).orderBy("idx")
    used = F.sum(F.length("body")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("_n", F.row_number().over(w)).withColumn("_used", used)
    page = marked.where((F.col("_n") <= size) & ((F.col("_used") <= budget) | (F.col("_n") == 1)))
    return page.groupBy(key).agg(F.count("*").alias("shown"), F.max("_used").cast("bigint").alias("characters"), (F.max("idx") + 1).alias("next_start"))


def attribute_conflicts(rows: DataFrame, key: str, attributes: list[str]) -> DataFrame:
    """Attributes of which one key has several values: (key, attribute, n, low, high, severity)."""
    each = rows.select(key, F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("v")) for a in attributes])).alias("x"))
    out = each.where("x.v is not null").groupBy(key, F.col("x.attribute").alias("attribute")).agg(F.count_distinct("x.v").alias("n"), F.min("x.v").alias("low"), F.max("x.v").alias("high")).where("n > 1")
    return out.withColumn("severity", F.when(F.col("n") >= 4, "high").when(F.col("n") == 3, "medium").otherwise("low"))


def synthesis(claims: DataFrame, keys: list[str], value: Column) -> DataFrame:
    """Claims of one field: agreed by several sources, single, or in conflict; values are told apart in their normal form."""
    rows = claims.withColumn("_v", value)
    out = rows.groupBy(*keys).agg(F.count("*").alias("claims"), F.count_distinct("source").alias("sources"), F.count_distinct("_v").alias("n_values"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    return out.withColumn("status", F.when(F.col("n_values") > 1, "conflict").when(F.col("sources") > 1, "agreed").otherwise("single"))


def weighted_categories(texts: DataFrame, words: dict[str, dict[str, int]]) -> DataFrame:
    """(doc_id, category, score): weighted keyword hits of each category, as a percentage of the document's best."""
    low = F.lower("text")
    total = lambda some: sum((F.regexp_count(low, F.lit(w)) * n for w, n in some.items()), F.lit(0))
    each = texts.select("doc_id", F.explode(F.array(*[F.struct(F.lit(c).alias("category"), total(some).cast("bigint").alias("hits")) for c, some in words.items()])).alias("x")).select("doc_id", "x.*")
    best = F.max("hits").over(Window.partitionBy("doc_id"))
    return each.withColumn("score", rounded(F.col("hits") * 100 / F.nullif(best, F.lit(0)), 1))


def trust(answers: DataFrame, *keys: str) -> DataFrame:
    """Shares of bad outcomes and latency by nearest rank over answers(found, mismatch, ms); one row for each key."""
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = answers.withColumn("_r", F.row_number().over(own.orderBy("ms"))).withColumn("_n", F.count("*").over(own))
    rank = lambda p: F.least(F.greatest(F.floor(p * F.col("_n") + 0.5), F.lit(1)), F.col("_n"))
    pick = lambda p: F.max(F.when(F.col("_r") == rank(p), F.col("ms")))
    return ranked.groupBy(*keys).agg(
        F.count("*").alias("answers"), share(F.count_if(~F.col("found")), F.count("*")).alias("not_found"), share(F.count_if("mismatch"), F.count("*")).alias("mismatches"),
        pick(0.5).alias("p50"), pick(0.95).alias("p95"), rounded(exact_sum("ms"), 2).alias("total_ms"),
    )


def judge(runs: DataFrame, fail: float, warn: float, tolerance: float) -> DataFrame:
    """PASS, WARN or FAIL of each run of a metric: by its level, and by how far it fell below the run before."""
    before = F.lag("score").over(Window.partitionBy("metric").orderBy("day"))
    rows = runs.withColumn("before", before)
    fell = F.coalesce(F.col("before") - F.col("score") > tolerance, F.lit(False))
    return rows.withColumn("verdict", F.when(F.col("score") < fail, "FAIL").when((F.col("score") < warn) | fell, "WARN").otherwise("PASS"))


def fill_to(recent: DataFrame, older: DataFrame, keys: list[str], order: list, least: int) -> DataFrame:
    """Recent rows of each key, and where they are fewer than ``least``, as many older ones (in ``order``) as are missing."""
    n = recent.groupBy(*keys).agg(F.count("*").alias("_n"))
    more = older.withColumn("_p", place(keys, *order)).join(n, keys, "left").where(F.col("_p") <= least - F.coalesce("_n", F.lit(0))).drop("_p", "_n")
    return recent.withColumn("recent", F.lit(True)).unionByName(more.withColumn("recent", F.lit(False)))
