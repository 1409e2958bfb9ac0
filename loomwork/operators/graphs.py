"""Property graphs as node and edge tables: neighbours, paths, closures, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.common import distinct_listed
from loomwork.operators.storage import stored


def both_ways(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    return edges.unionByName(edges.withColumnsRenamed({a: "_b", b: "_a"}).withColumnsRenamed({"_a": a, "_b": b}))


def components(edges: DataFrame, salts: int = 8) -> DataFrame:
    """(node, component) of every node of edges(a, b); component is the smallest node reachable.

    Each round links the larger neighbours of a node to its smallest one, and then the smaller ones, until
    nothing changes. A node with many links is met by several tasks, and a round keeps no more than one link a node and edge.
    """

    def state(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    def with_least(e: DataFrame, least: DataFrame) -> DataFrame:
        spread = least.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return e.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(spread, ["u", "_s"]).drop("_s")

    nodes = both_ways(edges).select("a").distinct()
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = None
    while (now := state(e)) != was:
        was = now
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = with_least(large, lower).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stored(small.unionAll(lower).distinct())
    return nodes.join(e, F.col("a") == F.col("u"), "left").select(F.col("a").alias("node"), F.coalesce("v", "a").alias("component"))


def merge_names(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(name, canonical): names linked by pairs(a, b) get the name of their group with the highest weight (ties: the first in order)."""
    ids = both_ways(pairs).select(F.col("a").alias("name")).distinct()
    comp = components(pairs)
    w = weights.select(F.col("name").alias("_n"), "weight")
    rows = comp.join(ids, F.col("node") == F.col("name"), "left_semi").join(w, F.col("node") == F.col("_n"), "left")
    best = rows.groupBy("component").agg(F.min_by("node", F.struct(-F.coalesce("weight", F.lit(0)), "node")).alias("canonical"))
    return comp.join(best, "component").select(F.col("node").alias("name"), "canonical")


def reachable(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(start, node): all that can be reached from start(node) along edges(a, b) in either direction, the start itself too.

    Edges lead both ways, so that is the component of the start, however many steps away.
    """
    comp = stored(components(edges))
    asked = start.select(F.col("node").alias("start")).distinct()
    mine = asked.join(comp, F.col("start") == F.col("node"), "left").select("start", "component")
    out = mine.join(comp, "component").select("start", "node")
    return out.unionAll(mine.where("component is null").select("start", F.col("start").alias("node")))


def shared_neighbours(edges: DataFrame, asked: DataFrame, left: str, right: str, others: DataFrame | None = None) -> DataFrame:
    """(asked, other, shared): nodes of ``left``, if given those in ``others``, that have neighbours of ``right`` in common with the asked ones."""
    mine = edges.join(asked, left, "left_semi").select(F.col(left).alias("asked"), right)
    other = edges if others is None else edges.join(others, left, "left_semi")
    other = other.select(F.col(left).alias("other"), right)
    return mine.join(other, right).where("asked <> other").groupBy("asked", "other").agg(F.count_distinct(right).alias("shared"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Rows of both by key, the one with the highest version."""
    rows = old.unionByName(new)
    rest = [c for c in old.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, *rest)).alias("x"))
    return best.select(*keys, "x.*")


def facing(relations: DataFrame) -> DataFrame:
    """(concept, direction, type, other, doc_id): each relation(source, type, target, doc_id) from both of its ends."""
    seen = lambda mine, way, other: relations.select(F.col(mine).alias("concept"), F.lit(way).alias("direction"), "type", F.col(other).alias("other"), "doc_id")
    return seen("source", "out", "target").unionByName(seen("target", "in", "source"))


def compare_concepts(pairs: DataFrame, relations: DataFrame, mentions: DataFrame) -> DataFrame:
    """(a, b, kind, name, relation, docs) of each different pair(a, b), over relations(source, type, target, doc_id) and mentions(concept, doc_id).

    ``direct``: a relation of a with b, seen from a, and its documents; ``shared``: the number of documents that mention both; ``common``:
    a concept related to both, with its relations to a and to b. A pair of a concept with itself, or with null, has no row, and what is not
    there has none either; repeated pairs, relations and mentions count once. Pairs meet the rows of a first and those of b by
    both keys, so a frequent concept costs no more than its own rows for each pair in which it is a.
    """
    p = pairs.where("a <> b").select("a", "b").distinct()
    seen = facing(relations.distinct()).withColumn("way", F.concat_ws(":", "direction", "type"))
    direct = p.join(seen, (F.col("a") == F.col("concept")) & (F.col("b") == F.col("other"))).groupBy("a", "b", "way").agg(F.count_distinct("doc_id").alias("docs"))
    m = mentions.select("concept", "doc_id").distinct()
    first, second = m.select(F.col("concept").alias("a"), "doc_id"), m.select(F.col("concept").alias("b"), "doc_id")
    shared = p.join(first, "a").join(second, ["b", "doc_id"]).groupBy("a", "b").agg(F.count("*").alias("docs"))
    near = seen.groupBy("concept", "other").agg(distinct_listed(F.col("way")).alias("how"))  # relation types are few
    of_a, of_b = near.withColumnsRenamed({"concept": "a", "how": "how_a"}), near.withColumnsRenamed({"concept": "b", "how": "how_b"})
    common = p.join(of_a, "a").where("other <> a AND other <> b").join(of_b, ["b", "other"])
    nothing = F.lit(None).cast("string")
    out = direct.select("a", "b", F.lit("direct").alias("kind"), F.col("b").alias("name"), F.col("way").alias("relation"), "docs")
    out = out.unionByName(shared.select("a", "b", F.lit("shared").alias("kind"), nothing.alias("name"), nothing.alias("relation"), "docs"))
    return out.unionByName(common.select("a", "b", F.lit("common").alias("kind"), F.col("other").alias("name"), F.concat_ws(" / ", "how_a", "how_b").alias("relation"), F.lit(None).cast("bigint").alias("docs")))
