"""Names that are alike: pairs by edit distance through rare letter pairs, similarity of questions, merging under one name."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomwork.functions.text import acronym, levenshtein_ratio


def _grams(names: DataFrame, edits: Column) -> DataFrame:
    """(name, size, gram) of the rarest letter pairs of each distinct name: two for each of its ``edits``, and one more.

    An edit changes at most two pairs, so names within that distance share one of these (pairs are numbered by
    occurrence, and both names order them alike).
    """
    at = F.sequence(F.lit(1), F.greatest(F.length("name") - 1, F.lit(1)))
    rows = names.select("name", F.length("name").alias("size"), edits.alias("edits"), F.posexplode(F.transform(at, lambda i: F.substring("name", i, F.lit(2)))).alias("pos", "two"))
    nth = F.row_number().over(Window.partitionBy("name", "two").orderBy("pos"))
    rows = rows.withColumn("gram", F.concat_ws("#", "two", nth.cast("string")))
    df = rows.groupBy("gram").agg(F.count("*").alias("df"))
    rare = F.row_number().over(Window.partitionBy("name").orderBy("df", "gram"))
    rows = rows.join(df, "gram").withColumn("_n", rare)
    return rows.where(F.col("_n") <= 2 * F.col("edits") + 1).select("name", "size", "gram")


def similar_names(names: DataFrame, ratio: float) -> DataFrame:
    """(a, b, distance, ratio), a < b, of distinct names whose edit distance is at most (1 - ratio) of the longer.

    Exact from a ratio of 0.7 on: under it short names can be alike without a common letter pair.
    """
    if ratio < 0.7:
        raise ValueError("names are compared from a ratio of 0.7 on")
    edits = F.floor(F.length("name") * ((1 - ratio) / ratio) + 1e-9).cast("int")
    g = _grams(names.select("name").where("name is not null").distinct(), edits)
    a, b = g.select(F.col("name").alias("a"), F.col("size").alias("na"), "gram"), g.select(F.col("name").alias("b"), F.col("size").alias("nb"), "gram")
    near = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * ratio - 1e-9)
    pairs = a.join(b, "gram").where(near).select("a", "b").distinct()
    out = pairs.withColumn("distance", F.levenshtein("a", "b").cast("bigint")).withColumn("ratio", levenshtein_ratio(F.col("a"), F.col("b")))
    return out.where(F.col("ratio") >= ratio)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the letters in matching blocks over the letters of both; null where a name is null."""
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def concept_pairs(names: DataFrame, ratio: float, most: int = 6) -> DataFrame:
    """(a, b, reason): names alike by matching blocks whose lengths differ by at most ``most``, and names that are another's acronym.

    Matching blocks of ``ratio`` r leave at least r of the letters in place, so the edit distance is at most 2 (1 - r) of the longer: the
    edit-distance join at that ratio finds every pair.
    """
    loose = 1 - math.ceil((1 - ratio) * 200) / 100
    pairs = similar_names(names, loose).where(F.abs(F.length("a") - F.length("b")) <= most)
    alike = pairs.where(sequence_ratio("a", "b") >= ratio).select("a", "b", F.lit("alike").alias("reason"))
    short = names.select("name", acronym("name").alias("short")).where("short is not null")
    by = short.join(names.select(F.col("name").alias("other")), F.lower("short") == F.col("other")).select(F.least("name", "other").alias("a"), F.greatest("name", "other").alias("b"), F.lit("acronym").alias("reason"))
    return alike.unionByName(by)


def question_similarity(q: Column, p: Column, w: Column, pw: Column) -> Column:
    """Equal 1, one within the other 0.8, else the shared words over the larger number of words."""
    part = F.size(F.array_intersect(w, pw)) / F.greatest(F.size(w), F.size(pw), F.lit(1))
    return F.when(q == p, 1.0).when(F.contains(q, p) | F.contains(p, q), 0.8).otherwise(part)


def qa_similarity(q: Column, p: Column, w: Column, pw: Column) -> Column:
    """0.4 of the shared words, 0.3 or 0.2 for an equal or contained question, 0.3 of the words found in the other text."""
    n = F.greatest(F.size(w), F.lit(1))
    match = F.when(q == p, 0.3).when(F.contains(q, p) | F.contains(p, q), 0.2).otherwise(0.0)
    return 0.4 * F.size(F.array_intersect(w, pw)) / n + match + 0.3 * F.size(F.filter(w, lambda k: F.contains(p, k))) / n
