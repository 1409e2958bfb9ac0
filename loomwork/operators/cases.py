"""Report comparison: cells of a case by row label, cases of projects matched one to one by name, and all projects beside each other."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.common import exact_sum, place, rounded
from loomwork.operators.storage import saved


@dataclass(frozen=True)
class Metric:
    """A row of a case's table: its name, the label of the row, its fields by place among the cells after the label, the field that is compared, and whether more of it is better."""

    name: str
    label: str
    fields: tuple[tuple[str, int], ...]
    compared: str
    more_is_better: bool = True
    after: str | None = None


def labelled_rows(sections: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(*keys, line, label, cells): the rows of Markdown tables in each text, with the label of the first cell without outer white space, and the other cells. Rules between head and body are no rows."""
    lines = sections.select(*keys, F.posexplode(F.split(text, "\n")).alias("line", "_b")).where(F.col("_b").rlike(r"^\s*\|.*\|"))
    cells = F.transform(F.split(F.regexp_replace("_b", r"^\s*\||\|\s*$", ""), r"\|"), lambda c: F.trim(c))
    rows = lines.select(*keys, "line", cells.alias("_c")).where(~F.forall("_c", lambda c: c.rlike(r"^:?-*:?$")))
    return rows.select(*keys, "line", F.col("_c")[0].alias("label"), F.slice("_c", 2, F.greatest(F.size("_c") - 1, F.lit(0))).alias("cells"))


def case_cells(sections: DataFrame, keys: Sequence[str], text: str, metrics: Sequence[Metric]) -> DataFrame:
    """(*keys, metric, field, cell, number): for each metric the fields of the first row of its label, in lines after the first that holds ``after`` if it has such a mark and such a line, else in the whole text.

    Keys are unique. Cells that are empty, or missing, have no row; ``number`` is null where a cell is none (a thousands comma is read over).
    """
    keys = list(keys)
    rows = labelled_rows(sections, keys, text)
    kinds = sections.sparkSession.createDataFrame(
        [(m.name, m.label, m.after, f, i) for m in metrics for f, i in m.fields], "metric string, label string, after string, field string, at int"
    )  # a small fixed table
    marks = sorted({m.after for m in metrics if m.after})
    before = lambda mark: F.size(F.split(F.substring_index(F.col(text), mark, 1), "\n")) - 1  # noqa: E731  lines before the mark's own
    place_of = sections.select(*keys, F.map_from_arrays(F.array(*map(F.lit, marks)), F.array(*[F.when(F.contains(text, F.lit(m)), before(m)) for m in marks])).alias("_marks")) if marks else None
    found = rows.join(F.broadcast(kinds.select("metric", "label", "after").distinct()), "label")
    if place_of is not None:
        found = found.join(place_of, keys).withColumn("_late", F.coalesce(F.col("line") >= F.try_element_at("_marks", F.coalesce("after", F.lit(""))), F.lit(False))).drop("_marks")
    else:
        found = found.withColumn("_late", F.lit(False))
    first = found.withColumn("_n", place([*keys, "metric"], F.desc("_late"), "line")).where("_n = 1")
    out = first.join(F.broadcast(kinds.select("metric", "field", "at")), "metric").withColumn("cell", F.get("cells", "at")).where("cell is not null and cell <> ''")
    number = F.expr("try_cast(regexp_replace(cell, ',', '') as double)")
    return out.select(*keys, "metric", "field", "cell", number.alias("number"))


def name_words(name: Column) -> Column:
    """The distinct words of a case name, in lower case."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(name, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1)))


def like_names(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(a, b, alike): pairs of left(a, words) and right(b, words) whose sets of words have a Jaccard index of ``least`` or more.

    A pair with that index shares one of the first words of both sets in the order of rareness (a set of n has n - ceil(least * n) + 1 such words), so only rows that share one are compared; no pair is lost.
    """
    both = left.select("words").unionByName(right.select("words"))
    seen = both.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("c"))

    def prefix(rows: DataFrame, key: str) -> DataFrame:
        n = F.size("words")
        each = rows.select(key, "words", F.explode("words").alias("word")).join(seen, "word")
        nth = place([key], "c", "word")
        return each.withColumn("_n", nth).where(F.col("_n") <= n - F.ceil(F.lit(least) * n - 1e-9) + 1).select(key, "words", "word")

    pairs = prefix(left, "a").withColumnRenamed("words", "wa").join(prefix(right, "b").withColumnRenamed("words", "wb"), "word")
    pairs = pairs.where((F.size("wa") >= least * F.size("wb") - 1e-9) & (F.size("wb") >= least * F.size("wa") - 1e-9)).dropDuplicates(["a", "b"])
    common = F.size(F.array_intersect("wa", "wb"))
    return pairs.withColumn("alike", common / (F.size("wa") + F.size("wb") - common)).where(F.col("alike") >= least - 1e-9).select("a", "b", "alike")


def one_to_one(pairs: DataFrame) -> DataFrame:
    """(a, b, alike) of pairs(a, b, alike): a one-to-one matching in which the most alike pair is always taken first (ties: smallest a, then smallest b).

    In a round every pair that is the best of both its sides is taken, which the greedy order would take as well, and pairs of a side that is taken go. A round takes the best pair of all that are left at least; chains of
    ever better partners are the only cause of many rounds. Each round is kept in shared storage.
    """
    rest, out = saved(pairs), None
    order = [F.desc("alike"), F.asc("a"), F.asc("b")]
    while not rest.isEmpty():
        best = saved(rest.withColumn("_a", place(["a"], *order)).withColumn("_b", place(["b"], *order)).where("_a = 1 and _b = 1").drop("_a", "_b"))
        out = best if out is None else out.unionByName(best)
        rest = saved(rest.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti"))
    return pairs.limit(0) if out is None else out


def matched_cases(cases: DataFrame, first: str, least: float = 0.5) -> DataFrame:
    """(project, case_id, name, matched, alike) of cases(project, case_id, name), unique by project and case: the case of project ``first`` to which each is matched; null without one.

    A case of the same id is its match, with alike 1; the cases left on both sides are matched by the words of their names, one to one, and only within one project.
    """
    own = cases.where(F.col("project") == first).select(F.col("case_id").alias("first_id"), F.col("name").alias("first_name"))
    others = cases.where(F.col("project") != first)
    same = others.join(own.select("first_id"), F.col("case_id") == F.col("first_id")).select("project", "case_id", F.col("first_id").alias("matched"), F.lit(1.0).alias("alike"))
    left = others.join(same.select("project", "case_id"), ["project", "case_id"], "left_anti")
    sep = "\u0000"  # names of projects hold none
    a = left.select(F.concat_ws(sep, "project", "case_id").alias("a"), name_words(F.col("name")).alias("words"))
    pairs = like_names(a, own.select(F.col("first_id").alias("b"), name_words(F.col("first_name")).alias("words")), least)
    # A case of the first project is free in a project where none has its id.
    pairs = pairs.withColumn("project", F.substring_index("a", sep, 1)).join(same.select("project", F.col("matched").alias("b")), ["project", "b"], "left_anti")
    part = lambda c, i: F.split(c, sep)[i]
    named = one_to_one(pairs.select("a", F.concat_ws(sep, "project", "b").alias("b"), "alike")).select(part("a", 0).alias("project"), part("a", 1).alias("case_id"), part("b", 1).alias("matched"), "alike")
    found = same.unionByName(named)
    out = others.join(found, ["project", "case_id"], "left").select("project", "case_id", "name", "matched", "alike")
    return out.unionByName(cases.where(F.col("project") == first).select("project", "case_id", "name", F.col("case_id").alias("matched"), F.lit(1.0).alias("alike")))


def compared(cells: DataFrame, metrics: Sequence[Metric], first: str, digits: int = 4) -> DataFrame:
    """(case_id, metric, project, value, n_values, conflict, change, best, worst, n_projects) of cells(case_id, project, metric, field, number): one row a case, metric and project, however many projects there are.

    ``value`` is the mean of the compared field where a project states it more than once, ``conflict`` tells that it states different values, ``change`` is against project ``first``; ``best`` and ``worst``
    name the projects (ties: first by name), null unless two projects or more have a value.
    """
    kinds = {m.name: m for m in metrics}
    field = F.create_map(*[x for m in metrics for x in (F.lit(m.name), F.lit(m.compared))])
    more = F.create_map(*[x for m in metrics for x in (F.lit(m.name), F.lit(1.0 if m.more_is_better else -1.0))])
    some = cells.where(F.col("metric").isin(*kinds)).where((F.col("field") == field[F.col("metric")]) & F.col("number").isNotNull())
    value = rounded(exact_sum("number") / F.count("number"), digits)
    each = some.groupBy("case_id", "metric", "project").agg(value.alias("value"), F.count("*").alias("n_values"), (F.min("number") != F.max("number")).alias("conflict"))
    own = Window.partitionBy("case_id", "metric")
    score = F.col("value") * more[F.col("metric")]
    n = F.count("*").over(own)
    each = each.withColumn("change", rounded(F.col("value") - F.max(F.when(F.col("project") == first, F.col("value"))).over(own), digits)).withColumn("_s", score)
    best = F.first("project").over(own.orderBy(F.desc("_s"), "project"))
    worst = F.first("project").over(own.orderBy(F.asc("_s"), "project"))
    return each.select("case_id", "metric", "project", "value", "n_values", "conflict", "change", F.when(n > 1, best).alias("best"), F.when(n > 1, worst).alias("worst"), n.alias("n_projects"))
