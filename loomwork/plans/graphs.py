"""Graph queries: documents and their topics, versions of a family, words that follow each other as concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import graphs as g
from loomwork.operators.common import distinct_listed, place
from loomwork.operators.names import similar_names
from loomwork.plans.registry import query

_TOPIC = "topic AS (SELECT doc_id, unnest(topics) AS topic FROM document)"
_REL = "rel AS (SELECT DISTINCT w[i] AS source, CASE WHEN i % 2 = 1 THEN 'precedes' ELSE 'modifies' END AS type, w[i + 1] AS target, doc_id FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, string_split(title, ' ') AS w FROM document)))"
_SUPERSEDES = "sup AS (SELECT doc_id AS a, lag(doc_id) OVER (PARTITION BY family ORDER BY doc_id) AS b FROM document QUALIFY b IS NOT NULL)"


def topics(t) -> DataFrame:
    return t.document.select("doc_id", F.explode("topics").alias("topic"))


def relations(t) -> DataFrame:
    """(source, type, target, doc_id): words that follow each other in a title."""
    w = F.split("title", " ")
    d = t.document.select("doc_id", w.alias("w")).where(F.size("w") > 1)
    d = d.select("doc_id", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("i"))
    return d.select(F.element_at("w", F.col("i")).alias("source"), F.when(F.col("i") % 2 == 1, "precedes").otherwise("modifies").alias("type"), F.element_at("w", F.col("i") + 1).alias("target"), "doc_id").distinct()


def supersedes(t) -> DataFrame:
    """(a, b): a document and the one of its family that it replaces."""
    before = F.lag("doc_id").over(Window.partitionBy("family").orderBy("doc_id"))
    return t.document.select(F.col("doc_id").alias("a"), before.alias("b")).where("b is not null")


@query(f"WITH {_TOPIC}, x AS (SELECT a.doc_id AS asked, b.doc_id AS other, count(DISTINCT a.topic) AS shared FROM topic a JOIN topic b ON a.topic = b.topic AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0 GROUP BY ALL) SELECT asked, other, shared FROM x JOIN document o ON o.doc_id = other JOIN document m ON m.doc_id = asked WHERE o.current AND o.family <> m.family")
def graph_related_docs(t):
    """For every fiftieth document, current documents of other families with shared topics."""
    asked = t.document.where("doc_id % 50 = 0").select("doc_id")
    out = g.shared_neighbours(topics(t), asked, "doc_id", "topic", t.document.where("current").select("doc_id"))
    other = t.document.where("current").select(F.col("doc_id").alias("other"), F.col("family").alias("f"))
    mine = t.document.select(F.col("doc_id").alias("asked"), F.col("family").alias("mf"))
    return out.join(other, "other").join(mine, "asked").where("f <> mf").select("asked", "other", "shared")


@query(f"WITH {_TOPIC} SELECT a.topic AS topic, b.topic AS neighbour, count(DISTINCT a.doc_id) AS docs FROM topic a JOIN topic b USING (doc_id) WHERE a.topic <> b.topic GROUP BY ALL")
def graph_topic_neighbours(t):
    """Topics that stand in one document (which has six at most)."""
    a, b = topics(t), topics(t).withColumnRenamed("topic", "neighbour")
    return a.join(b, "doc_id").where("topic <> neighbour").groupBy("topic", "neighbour").agg(F.count_distinct("doc_id").alias("docs"))


@query(f"WITH {_REL} SELECT concept, direction, type, other, count(DISTINCT doc_id) AS docs FROM (SELECT source AS concept, 'out' AS direction, type, target AS other, doc_id FROM rel UNION ALL SELECT target, 'in', type, source, doc_id FROM rel) GROUP BY ALL")
def graph_concept_relations(t):
    """Relations of each concept in both directions."""
    r = relations(t)
    out = r.select(F.col("source").alias("concept"), F.lit("out").alias("direction"), "type", F.col("target").alias("other"), "doc_id")
    in_ = r.select(F.col("target").alias("concept"), F.lit("in").alias("direction"), "type", F.col("source").alias("other"), "doc_id")
    return out.unionByName(in_).groupBy("concept", "direction", "type", "other").agg(F.count_distinct("doc_id").alias("docs"))


@query(f"WITH {_REL} SELECT concept, direction, type, other, docs FROM (SELECT concept, direction, type, other, count(DISTINCT doc_id) AS docs FROM (SELECT source AS concept, 'out' AS direction, type, target AS other, doc_id FROM rel UNION ALL SELECT target, 'in', type, source, doc_id FROM rel) GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY concept, direction, type ORDER BY docs DESC, other) <= 3")
def q_concept_relations(t):
    """The three best supported relations of each kind of each concept."""
    rows = graph_concept_relations(t)
    return rows.withColumn("_p", place(["concept", "direction", "type"], F.desc("docs"), "other")).where("_p <= 3").drop("_p")


@query(f"""WITH {_REL}, two AS MATERIALIZED (SELECT source AS a, 'out:' || type AS way, target AS b, doc_id FROM rel UNION ALL SELECT target, 'in:' || type, source, doc_id FROM rel),
    pair AS MATERIALIZED (SELECT a, b FROM (SELECT a, b, count(DISTINCT doc_id) AS docs FROM two WHERE a <> b GROUP BY a, b) QUALIFY row_number() OVER (PARTITION BY a ORDER BY docs DESC, b) = 1),
    m AS MATERIALIZED (SELECT DISTINCT a AS c, doc_id FROM two), n AS MATERIALIZED (SELECT a AS c, b AS other, string_agg(DISTINCT way, ',' ORDER BY way) AS how FROM two GROUP BY a, b)
    SELECT a, b, 'direct' AS kind, b AS name, way AS relation, count(DISTINCT doc_id) AS docs FROM pair JOIN two USING (a, b) GROUP BY a, b, way
    UNION ALL SELECT p.a, p.b, 'shared', NULL, NULL, count(*) FROM pair p JOIN m x ON x.c = p.a JOIN m y ON y.c = p.b AND y.doc_id = x.doc_id GROUP BY p.a, p.b
    UNION ALL SELECT p.a, p.b, 'common', x.other, x.how || ' / ' || y.how, NULL FROM pair p JOIN n x ON x.c = p.a JOIN n y ON y.c = p.b AND y.other = x.other WHERE x.other <> p.a AND x.other <> p.b""")  # fmt: skip
def q_concept_compare(t):
    """Each concept beside the one it is related to in most documents: their relations, shared documents and common concepts."""
    r = relations(t)
    seen = g.facing(r)
    best = seen.where("concept <> other").groupBy("concept", "other").agg(F.count_distinct("doc_id").alias("docs"))
    pairs = best.groupBy("concept").agg(F.min(F.struct((-F.col("docs")).alias("o"), "other")).alias("m")).select(F.col("concept").alias("a"), F.col("m.other").alias("b"))
    return g.compare_concepts(pairs, r, seen.select("concept", "doc_id"))


@query("WITH t0 AS (SELECT doc_id, unnest(topics) AS topic FROM document) SELECT count(*) AS docs, min(doc_id) AS first_doc FROM (SELECT doc_id FROM t0 WHERE topic = 'the' INTERSECT SELECT doc_id FROM t0 WHERE topic = 'and')")
def graph_shared_docs(t):
    """Documents that name both of two topics."""
    both = topics(t).where("topic = 'the'").select("doc_id").intersect(topics(t).where("topic = 'and'").select("doc_id"))
    return both.agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query(f"WITH {_REL}, n AS (SELECT source AS a, target AS b, type FROM rel UNION ALL SELECT target, source, type FROM rel) SELECT b AS neighbour, string_agg(DISTINCT type, ',' ORDER BY type) AS types FROM n WHERE a IN ('the', 'and') AND b NOT IN ('the', 'and') GROUP BY b HAVING count(DISTINCT a) = 2")
def graph_common_neighbours(t):
    """Neighbours of both of two concepts, with the relations that lead there."""
    n = g.both_ways(relations(t).select(F.col("source").alias("a"), F.col("target").alias("b"), "type"))
    some = n.where(F.col("a").isin("the", "and") & ~F.col("b").isin("the", "and"))
    return some.groupBy(F.col("b").alias("neighbour")).agg(F.count_distinct("a").alias("n"), distinct_listed(F.col("type")).alias("types")).where("n = 2").drop("n")


@query(f"WITH {_REL}, n AS (SELECT source AS a, target AS b FROM rel UNION SELECT target, source FROM rel), hit AS (SELECT DISTINCT a FROM n WHERE contains(a, 'tion')) SELECT h.a AS concept, count(b) AS neighbours, string_agg(DISTINCT b, ' ' ORDER BY b) AS names FROM hit h LEFT JOIN n ON h.a = n.a GROUP BY h.a")
def graph_local_search(t):
    """Concepts with a keyword, and their neighbours."""
    n = g.both_ways(relations(t).select(F.col("source").alias("a"), F.col("target").alias("b"))).distinct()
    return n.where(F.contains("a", F.lit("tion"))).groupBy(F.col("a").alias("concept")).agg(F.count("*").alias("neighbours"), distinct_listed(F.col("b"), " ").alias("names"))


@query(f"WITH {_REL}, {_TOPIC}, n AS (SELECT source AS a, target AS b FROM rel UNION SELECT target, source FROM rel), e AS (SELECT 'the' AS b, 1 AS hops UNION ALL SELECT b, 2 FROM n WHERE a = 'the') SELECT doc_id, count(*) AS paths, min(hops) AS hops FROM topic JOIN e ON topic = b GROUP BY doc_id")
def graph_var_length(t):
    """Documents one or two steps from a concept, with the number of ways."""
    n = g.both_ways(relations(t).select(F.col("source").alias("a"), F.col("target").alias("b"))).distinct()
    near = t.spark.range(1).select(F.lit("the").alias("topic"), F.lit(1).alias("hops")).unionAll(n.where("a = 'the'").select("b", F.lit(2)))
    return topics(t).join(near, "topic").groupBy("doc_id").agg(F.count("*").alias("paths"), F.min("hops").alias("hops"))


@query("SELECT run_id, product_id, c.case_id, count(*) AS items, count(*) FILTER (verdict = 'fail') AS failed FROM run r LEFT JOIN result c USING (run_id) WHERE EXISTS (SELECT 1 FROM result x WHERE x.run_id = r.run_id AND x.verdict = 'fail') GROUP BY ALL")
def graph_report_rows(t):
    """Report, section and case rows of the reports that have a failed item."""
    bad = t.result.where("verdict = 'fail'").select("run_id").distinct()
    rows = t.run.select("run_id", "product_id").join(bad, "run_id", "left_semi").join(t.result, "run_id", "left")
    return rows.groupBy("run_id", "product_id", "case_id").agg(F.count("*").alias("items"), F.count_if(F.col("verdict") == "fail").alias("failed"))


@query(f"WITH {_TOPIC}, {_REL}, {_SUPERSEDES} SELECT 'node' AS part, 'document' AS label, count(*) AS n FROM document UNION ALL SELECT 'node', 'topic', count(DISTINCT topic) FROM topic UNION ALL SELECT 'edge', 'has_topic', count(*) FROM topic UNION ALL SELECT 'edge', type, count(*) FROM rel GROUP BY type UNION ALL SELECT 'edge', 'supersedes', count(*) FROM sup")
def graph_stats(t):
    one = lambda df, part, label, n=None: df.agg((F.count("*") if n is None else n).alias("n")).select(F.lit(part).alias("part"), F.lit(label).alias("label"), "n")
    rel = relations(t).groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), F.col("type").alias("label"), "n")
    return one(t.document, "node", "document").unionAll(one(topics(t), "node", "topic", F.count_distinct("topic"))).unionAll(one(topics(t), "edge", "has_topic")).unionAll(rel).unionAll(one(supersedes(t), "edge", "supersedes"))


@query("""WITH RECURSIVE n AS (SELECT lower(p_name) || ' ' || lower(p_type) AS name, count(*) AS weight FROM part GROUP BY ALL), pair AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON a.name <> b.name WHERE 1 - levenshtein(a.name, b.name) / CAST(greatest(length(a.name), length(b.name)) AS DOUBLE) >= 0.9e0),
    walk AS (SELECT a AS name, a AS other FROM pair UNION SELECT w.name, p.b FROM walk w JOIN pair p ON w.other = p.a) SELECT w.name AS name, arg_min(other, (-weight, other)) AS canonical FROM walk w JOIN n ON n.name = other GROUP BY w.name""")
def rel_union_find(t):
    """Chains of like names under the name most often used."""
    name = F.concat_ws(" ", F.lower("p_name"), F.lower("p_type"))
    w = t["part"].groupBy(name.alias("name")).agg(F.count("*").alias("weight"))
    return g.merge_names(similar_names(w.select("name"), 0.9).select("a", "b"), w)


@query(f"WITH RECURSIVE {_SUPERSEDES}, way AS (SELECT a, b FROM sup UNION SELECT b, a FROM sup), walk AS (SELECT doc_id AS start, doc_id AS node FROM document WHERE doc_id % 50 = 0 UNION SELECT start, b FROM walk JOIN way ON node = a) SELECT start, node, row_number() OVER (PARTITION BY start ORDER BY node) AS place FROM walk")
def graph_version_closure(t):
    """All versions of every fiftieth document, along replacements in both directions."""
    out = g.reachable(supersedes(t), t.document.where("doc_id % 50 = 0").select(F.col("doc_id").alias("node")))
    return out.withColumn("place", place(["start"], "node"))


@query(f"WITH {_SUPERSEDES} SELECT doc_id, family, EXISTS (SELECT 1 FROM sup WHERE a = doc_id) AS replaces_older FROM document")
def graph_timeline(t):
    old = supersedes(t).select(F.col("a").alias("doc_id")).withColumn("_r", F.lit(True))
    return t.document.join(old, "doc_id", "left").select("doc_id", "family", F.col("_r").isNotNull().alias("replaces_older"))


@query(f"WITH {_TOPIC}, {_SUPERSEDES} SELECT doc_id FROM topic WHERE lower(topic) = 'the' AND doc_id NOT IN (SELECT b FROM sup)")
def graph_topic_docs(t):
    """Documents of a topic that nothing replaces."""
    return topics(t).where(F.lower("topic") == "the").select("doc_id").join(supersedes(t).select(F.col("b").alias("doc_id")), "doc_id", "left_anti")


@query(f"WITH {_TOPIC}, {_REL} SELECT DISTINCT topic FROM topic WHERE topic NOT IN (SELECT source FROM rel) AND topic NOT IN (SELECT target FROM rel)")
def graph_orphan_prune(t):
    """Topics without a relation."""
    ends = relations(t).select(F.col("source").alias("topic")).unionAll(relations(t).select("target")).distinct()
    return topics(t).select("topic").distinct().join(ends, "topic", "left_anti")


@query(f"WITH {_TOPIC} SELECT topic, count(*) FILTER (doc_id % 10 <> 0) AS remaining FROM topic GROUP BY topic HAVING count(*) FILTER (doc_id % 10 = 0) > 0")
def graph_detach_delete(t):
    """Deleting every tenth document: how many documents each of its topics keeps."""
    gone = F.col("doc_id") % 10 == 0
    return topics(t).groupBy("topic").agg(F.count_if(~gone).alias("remaining"), F.count_if(gone).alias("_g")).where("_g > 0").drop("_g")


@query(f"WITH {_REL} SELECT count(DISTINCT source) AS overlap FROM rel WHERE doc_id % 2 = 0 AND source IN (SELECT source FROM rel WHERE doc_id % 2 = 1)")
def graph_foreign_overlap(t):
    """Concepts of one run that another owns already."""
    r = relations(t)
    return r.where("doc_id % 2 = 0").join(r.where("doc_id % 2 = 1").select("source").distinct(), "source", "left_semi").agg(F.count_distinct("source").alias("overlap"))


@query("SELECT doc_id, kind, name FROM (SELECT doc_id, unnest(['zone', 'category', 'entity']) AS kind, unnest([publisher, role, title]) AS name FROM document) WHERE name IS NOT NULL AND name <> ''")
def graph_legacy_edges(t):
    """Edges of a record from its map of names."""
    m = F.create_map(F.lit("zone"), "publisher", F.lit("category"), "role", F.lit("entity"), "title")
    return t.document.select("doc_id", F.explode(m).alias("kind", "name")).where("name is not null and name <> ''")


@query(f"WITH {_REL} SELECT source, type, target, max(doc_id) AS last_doc, count(*) AS support FROM rel GROUP BY ALL")
def snk_graph(t):
    """Edges merged by key; the last writer names the evidence."""
    return relations(t).groupBy("source", "type", "target").agg(F.max("doc_id").alias("last_doc"), F.count("*").alias("support"))


@query(f"WITH {_REL}, {_TOPIC}, big AS (SELECT topic FROM topic GROUP BY topic HAVING count(*) >= 3) SELECT source, type, target, count(*) AS n FROM rel WHERE source IN (SELECT topic FROM big) AND target IN (SELECT topic FROM big) GROUP BY ALL")
def snk_entity_graph(t):
    """Relations of which both ends are known entities."""
    big = topics(t).groupBy("topic").agg(F.count("*").alias("n")).where("n >= 3").select("topic")
    r = relations(t).join(big.withColumnRenamed("topic", "source"), "source", "left_semi").join(big.withColumnRenamed("topic", "target"), "target", "left_semi")
    return r.groupBy("source", "type", "target").agg(F.count("*").alias("n"))


@query(f"WITH {_REL}, r AS (SELECT *, CASE WHEN length(source) < 3 OR length(target) < 3 THEN 'short name' WHEN source = target THEN 'self' WHEN type = 'modifies' AND source > target THEN 'wrong order' ELSE 'kept' END AS reason FROM rel) SELECT reason, type, count(*) AS n FROM r GROUP BY ALL")
def q_concept_validate(t):
    """Relations by the first reason to drop them."""
    reason = F.when((F.length("source") < 3) | (F.length("target") < 3), "short name").when(F.col("source") == F.col("target"), "self").when((F.col("type") == "modifies") & (F.col("source") > F.col("target")), "wrong order").otherwise("kept")
    return relations(t).withColumn("reason", reason).groupBy("reason", "type").agg(F.count("*").alias("n"))


@query(f"WITH {_TOPIC}, k AS (SELECT DISTINCT topic AS name, left(topic, 4) AS stem FROM topic WHERE length(topic) >= 4) SELECT stem, string_agg(name, ' ' ORDER BY name) AS names FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY stem ORDER BY name) <= 5) GROUP BY stem")
def q_near_names(t):
    """Up to five names that share their first four letters."""
    k = topics(t).where(F.length("topic") >= 4).select(F.col("topic").alias("name"), F.substring("topic", 1, 4).alias("stem")).distinct()
    k = k.withColumn("_p", place(["stem"], "name")).where("_p <= 5")
    return k.groupBy("stem").agg(distinct_listed(F.col("name"), " ").alias("names"))


@query("SELECT family, doc_id, 'latest' AS state FROM document WHERE current UNION ALL SELECT family, doc_id, 'older' FROM document WHERE NOT current AND family IN (SELECT family FROM document WHERE doc_id % 50 = 0)")
def join_latest_revision(t):
    """The latest document of each family, and the older ones of the families asked for."""
    d = t.document.select("family", "doc_id", "current")
    asked = d.where("doc_id % 50 = 0").select("family").distinct()
    old = d.where("not current").join(asked, "family", "left_semi").select("family", "doc_id", F.lit("older").alias("state"))
    return d.where("current").select("family", "doc_id", F.lit("latest").alias("state")).unionAll(old)


@query(f"WITH {_TOPIC} SELECT d.publisher AS zone, topic AS name, count(*) AS n FROM topic JOIN document d USING (doc_id) GROUP BY ALL HAVING count(*) > 1")
def join_zone_entity(t):
    """Zones in which a name occurs, with counts."""
    return topics(t).join(t.document.select("doc_id", F.col("publisher").alias("zone")), "doc_id").groupBy("zone", F.col("topic").alias("name")).agg(F.count("*").alias("n")).where("n > 1")
