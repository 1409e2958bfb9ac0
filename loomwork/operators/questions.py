"""Stored questions that are most like a new one: an exact similarity join over distinct texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.names import question_similarity

_GRAM = 5
_CONTAINED = 0.8


def question_words(text: Column) -> Column:
    """Distinct words of a lower-case question: runs without white space, question marks left out."""
    return F.array_distinct(F.filter(F.split(F.replace(text, F.lit("?"), F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != ""))


def _texts(rows: DataFrame, id: str, text: str) -> DataFrame:
    """(id, t): questions in lower case without outer spaces; blank and null ones are left out."""
    return rows.select(F.col(id).alias("id"), F.lower(F.trim(F.col(text))).alias("t")).where("t <> ''")


def _distinct(texts: DataFrame) -> DataFrame:
    """(key, t, w): each text once, under its smallest id, with its words."""
    return texts.groupBy("t").agg(F.min("id").alias("key")).withColumn("w", question_words(F.col("t")))


def _prefix(texts: DataFrame, df: DataFrame, least: float) -> DataFrame:
    """(key, n, word): the rarest of a text's n words, one more than it may miss; two texts alike enough share one of them."""
    rows = texts.select("key", F.size("w").alias("n"), F.explode("w").alias("word")).join(df, "word")
    place = F.row_number().over(Window.partitionBy("key").orderBy("df", "word"))
    return rows.withColumn("_place", place).where(F.col("_place") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("key", "n", "word")


def _by_words(asked: DataFrame, kept: DataFrame, least: float) -> DataFrame:
    """(q, p) of texts that may share ``least`` of the words of the longer one."""
    df = asked.select(F.explode("w").alias("word")).unionAll(kept.select(F.explode("w").alias("word"))).groupBy("word").agg(F.count("*").alias("df"))
    a, b = _prefix(asked, df, least), _prefix(kept, df, least)
    a, b = a.withColumnsRenamed({"key": "q", "n": "nq"}), b.withColumnsRenamed({"key": "p", "n": "np"})
    return a.join(b, "word").where(F.least("nq", "np") >= F.greatest("nq", "np") * least - 1e-9).select("q", "p")


def _parts(text: Column, size: int | Column) -> Column:
    """Distinct parts of ``size`` characters."""
    size = F.lit(size)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - size + 1, F.lit(1))), lambda i: F.substring(text, i, size))
    return F.array_distinct(cut)


def _within(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) of texts that may contain one another: the outer one holds the inner one's rarest part of _GRAM characters, or all of a shorter one."""
    t = F.col("t")
    held = outer.select(F.col("key").alias("outer"), F.explode(F.array_distinct(F.flatten(F.array(*[_parts(t, k) for k in range(1, _GRAM + 1)])))).alias("part"))
    df = held.groupBy("part").agg(F.count("*").alias("df"))
    own = inner.select(F.col("key").alias("inner"), F.explode(_parts(t, _GRAM)).alias("part")).join(df, "part")
    rarest = own.groupBy("inner").agg(F.min(F.struct("df", "part")).alias("r")).select("inner", F.col("r.part").alias("part"))
    return rarest.join(held, "part").select("inner", "outer")


def most_similar(questions: DataFrame, stored: DataFrame, least: float, id: str = "id", text: str = "text") -> DataFrame:
    """(id, match, similarity): for each question the stored one most like it, of equal ones that with the smallest id, if ``least`` is reached.

    Equal texts are alike by 1, one within the other by 0.8, others by their shared words over the larger number of words; upper and
    lower case and outer spaces don't count. Texts are compared once however often they repeat. The join is exact: rarest words for
    shared ones, rarest parts for contained ones (only up to a ``least`` of 0.8). Blank and null texts have no match and are none;
    questions without a match have no row, and repeated questions a row each.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be over 0 and at most 1")
    rows = _texts(questions, id, text)
    asked, kept = _distinct(rows), _distinct(_texts(stored, id, text))
    pairs = _by_words(asked, kept, least).unionByName(asked.select("t", F.col("key").alias("q")).join(kept.select("t", F.col("key").alias("p")), "t").select("q", "p"))
    if least <= _CONTAINED:
        pairs = pairs.unionByName(_within(kept, asked).select(F.col("outer").alias("q"), F.col("inner").alias("p")))
        pairs = pairs.unionByName(_within(asked, kept).select(F.col("inner").alias("q"), F.col("outer").alias("p")))
    a, b = asked.select(F.col("key").alias("q"), F.col("t").alias("tq"), F.col("w").alias("wq")), kept.select(F.col("key").alias("p"), F.col("t").alias("tp"), F.col("w").alias("wp"))
    scored = pairs.distinct().join(a, "q").join(b, "p").withColumn("s", question_similarity(F.col("tq"), F.col("tp"), F.col("wq"), F.col("wp")))
    best = scored.where(F.col("s") >= least - 1e-9).groupBy("tq").agg(F.min(F.struct((-F.col("s")).alias("s"), "p")).alias("b"))
    return rows.join(best, rows["t"] == best["tq"]).select("id", F.col("b.p").alias("match"), (-F.col("b.s")).alias("similarity"))
