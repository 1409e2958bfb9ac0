"""Roll-up queries over documents, logs, conversations and answers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.functions import text as x
from loomwork.operators import lines as ln
from loomwork.operators import packing as pk
from loomwork.operators import rollups as ru
from loomwork.operators.common import distinct_listed, exact_sum, listed, mean, place, rounded, share
from loomwork.plans import sqltext as sql
from loomwork.plans.registry import query


@query("SELECT doc_id, count(*) AS chunks, arg_min(md5(body), idx) AS first_line, max(idx) AS last_idx, CAST(sum(length(body)) AS BIGINT) AS characters FROM chunk GROUP BY doc_id")
def agg_document_rollup(t):
    return t.chunk.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.md5(F.min_by("body", "idx")).alias("first_line"), F.max("idx").alias("last_idx"), F.sum(F.length("body")).alias("characters"))


@query("SELECT doc_id, string_agg(section, ',' ORDER BY section) AS sections, CAST(sum(n) AS BIGINT) AS chunks FROM (SELECT doc_id, section, count(*) AS n FROM chunk GROUP BY doc_id, section) GROUP BY doc_id")
def agg_list_documents(t):
    s = t.chunk.groupBy("doc_id", "section").agg(F.count("*").alias("n"))
    return s.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("section")), lambda v: v.cast("string")), ",").alias("sections"), F.sum("n").alias("chunks"))


_SHARE = sql.rounded("n / max(CASE WHEN dimension = 'all' THEN n END) OVER ()")


@query(f"WITH g AS (SELECT CASE grouping_id(role, publisher) WHEN 3 THEN 'all' WHEN 1 THEN 'role' ELSE 'publisher' END AS dimension, CASE grouping_id(role, publisher) WHEN 3 THEN '' WHEN 1 THEN coalesce(role, 'unknown') ELSE coalesce(publisher, 'unknown') END AS name, count(*) AS n, count(*) FILTER (current) AS current FROM document GROUP BY GROUPING SETS ((), (role), (publisher))) SELECT *, {_SHARE} AS share FROM g")
def agg_zone_overview(t):
    return ru.overview(t.document)


@query("SELECT coalesce(publisher, 'unknown') AS publisher, coalesce(role, 'unknown') AS role, count(*) AS n FROM document GROUP BY ALL")
def q_zone_overview_tool(t):
    return t.document.groupBy(F.coalesce("publisher", F.lit("unknown")).alias("publisher"), F.coalesce("role", F.lit("unknown")).alias("role")).agg(F.count("*").alias("n"))


@query("SELECT topic, n FROM (SELECT topic, count(*) AS n FROM (SELECT unnest(topics) AS topic FROM document) GROUP BY topic) QUALIFY row_number() OVER (ORDER BY n DESC, topic) <= 20")
def agg_top_topics(t):
    """The twenty most frequent topics."""
    return t.document.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic").limit(20)


@query(f"WITH g AS (SELECT publisher, count(*) AS n, count(*) FILTER (current) AS current, count(*) FILTER (NOT current) AS history FROM document GROUP BY publisher) SELECT *, CAST(round(CAST(n * 100.0e0 / sum(n) OVER () AS DECIMAL(30,8)), 1) AS DOUBLE) AS share, row_number() OVER (ORDER BY CASE publisher WHEN 'src3' THEN 0 WHEN 'src1' THEN 1 ELSE 2 END, n DESC, publisher) AS place FROM g")
def agg_category_stats(t):
    """Categories: two in a configured order first, the rest by size."""
    g = t.document.groupBy("publisher").agg(F.count("*").alias("n"), F.count_if("current").alias("current"), F.count_if(~F.col("current")).alias("history"))
    first = F.when(F.col("publisher") == "src3", 0).when(F.col("publisher") == "src1", 1).otherwise(2)
    g = g.withColumn("share", rounded(F.col("n") * 100 / F.sum("n").over(Window.partitionBy(F.lit(0))), 1))
    return g.withColumn("place", F.row_number().over(Window.orderBy(first, F.desc("n"), "publisher")).cast("bigint"))


@query("SELECT family, count(*) AS current FROM document WHERE eligible GROUP BY family HAVING count(*) > 1")
def agg_contested_series(t):
    """Families with more than one eligible document."""
    return t.document.where("eligible").groupBy("family").agg(F.count("*").alias("current")).where("current > 1")


@query("""WITH w AS (SELECT doc_id, section, unnest(list_distinct(regexp_extract_all(body, '[A-Z][a-z]{3,}'))) AS name FROM chunk), k AS (SELECT lower(name) AS concept, name, doc_id, section FROM w),
    c AS (SELECT concept, count(DISTINCT doc_id) AS docs, count(DISTINCT (doc_id, section)) AS windows FROM k GROUP BY concept), n AS (SELECT concept, name, count(*) AS n FROM k GROUP BY concept, name)
    SELECT c.concept, docs, windows, name AS common_name, docs < 2 AS weak FROM c JOIN n ON c.concept = n.concept QUALIFY row_number() OVER (PARTITION BY c.concept ORDER BY n DESC, name) = 1""")
def agg_concepts(t):
    """Capitalised words of windows merged into concepts: documents, windows, most common writing, weak if only one document names it."""
    w = t.chunk.select("doc_id", "section", F.explode(F.array_distinct(F.regexp_extract_all("body", F.lit("([A-Z][a-z]{3,})")))).alias("name")).withColumn("concept", F.lower("name"))
    c = w.groupBy("concept").agg(F.count_distinct("doc_id").alias("docs"), F.count_distinct("doc_id", "section").alias("windows"))
    n = w.groupBy("concept", "name").agg(F.count("*").alias("n")).withColumn("_p", place(["concept"], F.desc("n"), "name")).where("_p = 1")
    return c.join(n.select("concept", F.col("name").alias("common_name")), "concept").withColumn("weak", F.col("docs") < 2)


@query("""WITH c AS (SELECT p_brand AS equipment, p_type AS field, p_name AS source, CASE WHEN p_size % 2 = 0 THEN CAST(p_size % 5 AS DOUBLE) ELSE (p_size % 5) * 1000 / 1000.0e0 END AS v FROM part)
    SELECT equipment, field, count(*) AS claims, count(DISTINCT source) AS sources, count(DISTINCT v) AS n_values, min(v) AS low, max(v) AS high, CASE WHEN count(DISTINCT v) > 1 THEN 'conflict' WHEN count(DISTINCT source) > 1 THEN 'agreed' ELSE 'single' END AS status FROM c GROUP BY equipment, field""")
def agg_equipment_synthesis(t):
    """Claims written with different prefixes (1.2 Gbps is 1200 Mbps) compared by value."""
    n = F.col("p_size") % 5
    written = F.when(F.col("p_size") % 2 == 0, F.concat_ws(" ", n.cast("string"), F.lit("Mbps"))).otherwise(F.concat_ws(" ", (n * 1000).cast("string"), F.lit("kbps")))
    c = t["part"].select(F.col("p_brand").alias("equipment"), F.col("p_type").alias("field"), F.col("p_name").alias("source"), written.alias("text"))
    return ru.synthesis(c, ["equipment", "field"], rounded(x.megabits("text"), 6))


@query("""WITH e AS (SELECT p_name, unnest(['p_type', 'p_size', 'p_brand']) AS attribute, unnest([p_type, CAST(p_size AS VARCHAR), p_brand]) AS v FROM part)
    SELECT p_name, attribute, count(DISTINCT v) AS n, min(v) AS low, max(v) AS high, CASE WHEN count(DISTINCT v) >= 4 THEN 'high' WHEN count(DISTINCT v) = 3 THEN 'medium' ELSE 'low' END AS severity FROM e GROUP BY p_name, attribute HAVING count(DISTINCT v) > 1""")
def agg_conflicts_attr(t):
    return ru.attribute_conflicts(t["part"], "p_name", ["p_type", "p_size", "p_brand"])


@query(f"SELECT p_partkey, p_retailprice AS stated, 700.0e0 + p_size * 5 AS measured, {sql.rounded('abs(p_retailprice - (700.0e0 + p_size * 5)) / greatest(p_retailprice, 700.0e0 + p_size * 5)')} AS difference FROM part WHERE abs(p_retailprice - (700.0e0 + p_size * 5)) / greatest(p_retailprice, 700.0e0 + p_size * 5) > 0.1e0")
def agg_conflicts_numeric(t):
    """Two statements of one number, units stripped, that differ by over a tenth."""
    stated = F.regexp_replace(F.concat(F.col("p_retailprice").cast("string"), F.lit(" USD")), "[^0-9.]", "").cast("double")
    measured = F.lit(700.0) + F.col("p_size") * 5
    diff = F.abs(stated - measured) / F.greatest(stated, measured)
    return t["part"].where(diff > 0.1).select("p_partkey", stated.alias("stated"), measured.alias("measured"), rounded(diff).alias("difference"))


@query("""WITH e AS (SELECT p_name, unnest(['p_type', 'p_size', 'p_brand']) AS attribute, unnest([p_type, CAST(p_size AS VARCHAR), p_brand]) AS v FROM part), c AS (SELECT p_name, attribute, CASE WHEN count(DISTINCT v) >= 4 THEN 'high' WHEN count(DISTINCT v) = 3 THEN 'medium' ELSE 'low' END AS severity FROM e GROUP BY p_name, attribute HAVING count(DISTINCT v) > 1)
    SELECT severity, attribute, count(*) AS n FROM c GROUP BY ALL""")
def agg_conflict_report(t):
    return ru.attribute_conflicts(t["part"], "p_name", ["p_type", "p_size", "p_brand"]).groupBy("severity", "attribute").agg(F.count("*").alias("n"))


@query(f"SELECT count(DISTINCT k) AS records, count(*) AS uses, count(*) FILTER (kind = 'error') AS conflicts, count(*) FILTER (kind = 'purchase') AS verified, {sql.mean('value')} AS mean_value FROM log")
def agg_qa_stats(t):
    of = lambda k: F.count_if(F.col("kind") == k)
    return t.log.agg(F.count_distinct("k").alias("records"), F.count("*").alias("uses"), of("error").alias("conflicts"), of("purchase").alias("verified"), mean("value").alias("mean_value"))


_DAY = "count(*) AS n, count(*) FILTER (kind = 'view') AS views, count(*) FILTER (kind = 'click') AS clicks, count(*) FILTER (kind = 'error') AS errors, count(*) FILTER (kind = 'purchase') AS purchases, " + sql.rounded("count(*) FILTER (kind = 'error') / CAST(count(*) AS DOUBLE)") + " AS error_rate"


@query("SELECT CAST(at AS DATE) AS day, {0} FROM log GROUP BY CAST(at AS DATE)".format(_DAY).replace("(at AS", '("at" AS'))
def agg_daily_summary(t):
    return ru.daily(t.log)


@query("""SELECT coalesce(strftime(date_trunc('week', "at"), '%Y-%m-%d'), 'all') AS week, coalesce(kind, 'all') AS kind, count(*) AS n FROM log GROUP BY ROLLUP (strftime(date_trunc('week', "at"), '%Y-%m-%d'), kind)""")
def agg_weekly_report(t):
    week = F.date_format(F.date_trunc("week", "at"), "yyyy-MM-dd")
    r = t.log.select(week.alias("week"), "kind").rollup("week", "kind").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("week", F.lit("all")).alias("week"), F.coalesce("kind", F.lit("all")).alias("kind"), "n")


@query("SELECT k, n FROM (SELECT k, count(*) AS n FROM log GROUP BY k) QUALIFY row_number() OVER (ORDER BY n DESC, k) <= 10")
def agg_top_qa(t):
    return t.log.groupBy("k").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "k").limit(10)


@query("SELECT kind, k, n FROM (SELECT kind, k, count(*) AS n FROM log GROUP BY kind, k) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, k) <= 5")
def agg_top_queries(t):
    return t.log.groupBy("kind", "k").agg(F.count("*").alias("n")).withColumn("_p", place(["kind"], F.desc("n"), "k")).where("_p <= 5").drop("_p")


_RANK = "CAST(least(greatest(floor({p}e0 * n + 0.5e0), 1), n) AS BIGINT)"


@query(f"""WITH a AS (SELECT user_id, kind <> 'error' AS found, k % 10 = 0 AS mismatch, value AS ms FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM a)
    SELECT user_id, count(*) AS answers, {sql.rounded('count(*) FILTER (NOT found) / CAST(count(*) AS DOUBLE)')} AS not_found, {sql.rounded('count(*) FILTER (mismatch) / CAST(count(*) AS DOUBLE)')} AS mismatches,
    max(ms) FILTER (r = {_RANK.format(p=0.5)}) AS p50, max(ms) FILTER (r = {_RANK.format(p=0.95)}) AS p95, {sql.rounded(sql.exact_sum('ms'), 2)} AS total_ms FROM r GROUP BY user_id""")
def agg_trust(t):
    """Shares of bad answers and nearest-rank latencies of each user."""
    a = t.log.select("user_id", (F.col("kind") != "error").alias("found"), (F.col("k") % 10 == 0).alias("mismatch"), F.col("value").alias("ms"))
    return ru.trust(a, "user_id")


@query("SELECT reason, count(*) FILTER (value >= 10) AS up, count(*) FILTER (value < 10) AS down FROM (SELECT value, unnest([kind, 'k' || (k % 5)]) AS reason FROM log WHERE \"at\" >= TIMESTAMP '2024-01-15 00:00:00') GROUP BY reason")
def agg_feedback(t):
    """Ratings and their reasons over the last days."""
    r = t.log.where(F.col("at") >= F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))).select("value", F.explode(F.array("kind", F.concat(F.lit("k"), (F.col("k") % 5).cast("string")))).alias("reason"))
    return r.groupBy("reason").agg(F.count_if(F.col("value") >= 10).alias("up"), F.count_if(F.col("value") < 10).alias("down"))


@query(f"SELECT user_id, count(*) AS calls, CAST(sum(k) AS BIGINT) AS tokens, {sql.rounded(sql.exact_sum('value'), 2)} AS points FROM log GROUP BY user_id")
def agg_usage_ledger(t):
    return t.log.groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"), rounded(exact_sum("value"), 2).alias("points"))


_CATEGORIES = {"speech": {"tion": 1, "the ": 2}, "water": {"eau": 3, "que": 1}, "ground": {"sch": 2, "ung": 2}}
_HITS = ", ".join("{'category': '" + c + "', 'hits': CAST(" + " + ".join(f"len(regexp_extract_all(lower(text), '{w}')) * {n}" for w, n in some.items()) + " AS BIGINT)}" for c, some in _CATEGORIES.items())


@query(f"WITH e AS (SELECT doc_id, v.category AS category, v.hits AS hits FROM (SELECT doc_id, unnest([{_HITS}]) AS v FROM documents)) SELECT *, CAST(round(CAST(hits * 100.0e0 / nullif(max(hits) OVER (PARTITION BY doc_id), 0) AS DECIMAL(30,8)), 1) AS DOUBLE) AS score FROM e")
def agg_category_weights(t):
    return ru.weighted_categories(t["documents"], _CATEGORIES)


@query("SELECT publisher, role, count(*) AS n, CASE WHEN count(*) >= 30 THEN 'high' WHEN count(*) >= 15 THEN 'medium' WHEN count(*) >= 5 THEN 'low' ELSE 'none' END AS level FROM document WHERE eligible GROUP BY publisher, role")
def agg_category_relevance(t):
    d = t.document.where("eligible").groupBy("publisher", "role").agg(F.count("*").alias("n"))
    return d.withColumn("level", F.when(F.col("n") >= 30, "high").when(F.col("n") >= 15, "medium").when(F.col("n") >= 5, "low").otherwise("none"))


@query("SELECT d.publisher AS publisher, count(*) AS citations, count(DISTINCT l.k) AS documents FROM log l JOIN document d ON l.k = d.doc_id GROUP BY d.publisher")
def agg_citation_distribution(t):
    hits = t.log.join(t.document.select(F.col("doc_id").alias("k"), "publisher"), "k")
    return hits.groupBy("publisher").agg(F.count("*").alias("citations"), F.count_distinct("k").alias("documents"))


@query("WITH c AS (SELECT publisher, count(l.id) AS searches FROM document d LEFT JOIN log l ON l.k = d.doc_id AND l.kind = 'view' GROUP BY publisher) SELECT publisher, searches, CASE WHEN searches >= 200 THEN 'hot' WHEN searches >= 100 THEN 'warm' WHEN searches > 0 THEN 'cool' ELSE 'cold' END AS status FROM c")
def agg_category_search(t):
    views = t.log.where("kind = 'view'").select(F.col("k").alias("doc_id"), "id")
    c = t.document.select("doc_id", "publisher").join(views, "doc_id", "left").groupBy("publisher").agg(F.count("id").alias("searches"))
    return c.withColumn("status", F.when(F.col("searches") >= 200, "hot").when(F.col("searches") >= 100, "warm").when(F.col("searches") > 0, "cool").otherwise("cold"))


@query("SELECT publisher, role, count(*) AS n, count(*) FILTER (NOT eligible) AS review FROM document GROUP BY ROLLUP (publisher, role) HAVING publisher IS NOT NULL")
def agg_legacy_zones(t):
    return t.document.rollup("publisher", "role").agg(F.count("*").alias("n"), F.count_if(~F.col("eligible")).alias("review")).where("publisher is not null")


@query("SELECT 'runs' AS store, count(*) AS n FROM run WHERE product_id = 7 UNION ALL SELECT 'measurements', count(*) FROM measurement JOIN run USING (run_id) WHERE product_id = 7 UNION ALL SELECT 'results', count(*) FROM result JOIN run USING (run_id) WHERE product_id = 7")
def agg_cleanup_plan(t):
    """What each store holds for one product before it is deleted."""
    own = t.run.where("product_id = 7").select("run_id")
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
    return count(own, "runs").unionAll(count(t.measurement.join(own, "run_id"), "measurements")).unionAll(count(t.result.join(own, "run_id"), "results"))


@query("SELECT field, filled, total, " + sql.rounded("filled / CAST(total AS DOUBLE)") + " AS coverage FROM (SELECT unnest(['title', 'publisher', 'role', 'topics']) AS field, unnest([count(nullif(title, '')), count(publisher), count(role), count(*) FILTER (len(topics) > 1)]) AS filled, count(*) AS total FROM document)")
def agg_processing_state(t):
    """How many documents have each piece of metadata."""
    filled = {"title": F.count(F.nullif("title", F.lit(""))), "publisher": F.count("publisher"), "role": F.count("role"), "topics": F.count_if(F.size("topics") > 1)}
    one = t.document.agg(F.count("*").alias("total"), *[c.alias(k) for k, c in filled.items()])
    each = one.select("total", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.col(k).alias("filled")) for k in filled])).alias("x"))
    return each.select("x.field", "x.filled", "total", share(F.col("x.filled"), F.col("total")).alias("coverage"))


@query("""WITH c AS (SELECT count(*) FILTER (NOT eligible) AS a, count(*) FILTER (length(text) < 100) AS b, count(*) FILTER (role IS NULL) AS c FROM document) SELECT item, n, severity FROM c, LATERAL (VALUES ('not eligible', a, 2), ('short', b, 1), ('no language', c, 3)) v(item, n, severity) WHERE n > 0""")
def q_attention(t):
    """Conditions that need attention, those that don't occur left out."""
    c = t.document.agg(F.count_if(~F.col("eligible")).alias("a"), F.count_if(F.length("text") < 100).alias("b"), F.count_if(F.col("role").isNull()).alias("c"))
    items = (("a", "not eligible", 2), ("b", "short", 1), ("c", "no language", 3))
    each = c.select(F.explode(F.array(*[F.struct(F.lit(name).alias("item"), F.col(k).alias("n"), F.lit(s).alias("severity")) for k, name, s in items])).alias("v"))
    return each.select("v.*").where("n > 0")


@query("SELECT count(*) AS chunks, count(*) FILTER (trim(body) = '') AS empty, count(*) FILTER (doc_id NOT IN (SELECT doc_id FROM documents)) AS orphans, (SELECT count(*) FROM (SELECT doc_id FROM chunk GROUP BY doc_id HAVING count(*) <> max(idx) + 1)) AS gaps, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM chunk)) AS without FROM chunk")
def agg_acceptance_scan(t):
    """Completeness of chunks: empty ones, orphans, documents with gaps in their numbers, documents without any."""
    c, ids = t.chunk, t["documents"].select("doc_id")
    by_doc = c.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("idx").alias("m"), F.count_if(F.trim("body") == "").alias("e"))
    both = by_doc.join(ids.withColumn("known", F.lit(True)), "doc_id", "full")
    return both.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("e"), F.lit(0)).alias("empty"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("n"))), F.lit(0)).alias("orphans"),
        F.count_if(F.col("n") != F.col("m") + 1).alias("gaps"), F.count_if(F.col("n").isNull()).alias("without"),
    )


@query("SELECT count(*) AS documents, count(*) FILTER (eligible) AS eligible, count(*) FILTER (current) AS current, (SELECT count(*) FROM chunk) AS chunks FROM document")
def q_store_counts(t):
    d = t.document.agg(F.count("*").alias("documents"), F.count_if("eligible").alias("eligible"), F.count_if("current").alias("current"))
    return d.join(F.broadcast(t.chunk.agg(F.count("*").alias("chunks"))))


@query("SELECT d.publisher, count(*) AS chunks, count(*) FILTER (d.title = '' OR d.role IS NULL) AS incomplete FROM chunk c LEFT JOIN document d USING (doc_id) GROUP BY d.publisher")
def q_citation_sample(t):
    both = t.chunk.join(t.document.select("doc_id", "title", "role", "publisher"), "doc_id", "left")
    return both.groupBy("publisher").agg(F.count("*").alias("chunks"), F.count_if((F.col("title") == "") | F.col("role").isNull()).alias("incomplete"))


@query("""WITH m AS (SELECT doc_id, idx, body, row_number() OVER w AS n, sum(length(body)) OVER w AS used FROM chunk WINDOW w AS (PARTITION BY doc_id ORDER BY idx ROWS UNBOUNDED PRECEDING)) SELECT doc_id, count(*) AS shown, CAST(max(used) AS BIGINT) AS characters, max(idx) + 1 AS next_start FROM m WHERE n <= 8 AND (used <= 2000 OR n = 1) GROUP BY doc_id""")
def q_read_file_page(t):
    """The first page of each document: at most eight lines and 2000 characters."""
    return ru.pages(t.chunk, 8, 2000, "doc_id")


@query("SELECT doc_id, idx, md5(body) AS line, count(*) OVER (PARTITION BY doc_id) AS total FROM chunk QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) BETWEEN 9 AND 16")
def q_document_page(t):
    """The second page of eight lines of each document."""
    n = F.count("*").over(Window.partitionBy("doc_id"))
    rows = t.chunk.withColumn("total", n).withColumn("_p", place(["doc_id"], "idx"))
    return rows.where("_p between 9 and 16").select("doc_id", "idx", F.md5("body").alias("line"), "total")


@query("SELECT doc_id, section, min(idx) AS first_idx, count(*) AS n, md5(string_agg(body, chr(10) ORDER BY idx)) AS digest FROM chunk GROUP BY doc_id, section")
def q_sections_from_chunks(t):
    """Lines of a section (five at most) joined in order."""
    g = t.chunk.groupBy("doc_id", "section").agg(F.min("idx").alias("first_idx"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", "body"))).alias("b"))
    return g.select("doc_id", "section", "first_idx", "n", F.md5(F.array_join(F.transform("b", lambda v: v["body"]), "\n")).alias("digest"))


@query("SELECT publisher, family, count(*) AS documents, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM document GROUP BY publisher, family QUALIFY row_number() OVER (PARTITION BY publisher ORDER BY family) <= 12")
def q_report_rollup(t):
    """Families of each publisher, the first twelve."""
    g = t.document.groupBy("publisher", "family").agg(F.count("*").alias("documents"), F.array_sort(F.collect_list("doc_id")).alias("d"))
    g = g.withColumn("_p", place(["publisher"], "family")).where("_p <= 12")
    return g.select("publisher", "family", "documents", F.array_join(F.transform("d", lambda v: v.cast("string")), ",").alias("ids"))


@query("SELECT doc_id, title, publisher, role, count(*) OVER (PARTITION BY publisher) AS facet FROM document WHERE current QUALIFY row_number() OVER (PARTITION BY publisher ORDER BY title, doc_id) BETWEEN 3 AND 4")
def lim_page(t):
    """The second page (of two rows) of each publisher's current documents by title; facets are counted before the page is cut."""
    rows = t.document.where("current").withColumn("facet", F.count("*").over(Window.partitionBy("publisher"))).withColumn("_p", place(["publisher"], "title", "doc_id"))
    return rows.where("_p between 3 and 4").select("doc_id", "title", "publisher", "role", "facet")


@query("SELECT doc_id, title FROM document WHERE (contains(title, 'ent') OR list_bool_or(list_transform(topics, lambda p: contains(p, 'ion')))) AND publisher = 'src3'")
def q_list_documents_tool(t):
    return t.document.where((F.contains("title", F.lit("ent")) | F.exists("topics", lambda p: F.contains(p, F.lit("ion")))) & (F.col("publisher") == "src3")).select("doc_id", "title")


_SCORE = "CASE WHEN contains(title, 'the') THEN 300 ELSE 0 END + CASE WHEN contains(publisher, '1') THEN 250 ELSE 0 END + 40 * len(list_filter(topics, lambda p: contains(p, 'an'))) + CASE WHEN role = 'en' THEN 80 ELSE 0 END"


@query(f"SELECT doc_id, CAST({_SCORE} AS BIGINT) AS score FROM document WHERE {_SCORE} > 0")
def q_doc_profiles(t):
    score = F.when(F.contains("title", F.lit("the")), 300).otherwise(0) + F.when(F.contains("publisher", F.lit("1")), 250).otherwise(0) + 40 * F.size(F.filter("topics", lambda p: F.contains(p, F.lit("an")))) + F.when(F.col("role") == "en", 80).otherwise(0)
    return t.document.select("doc_id", score.cast("bigint").alias("score")).where("score > 0")


@query("""WITH a AS (SELECT conv_id, turn, text, row_number() OVER w AS age, CAST(sum(CASE WHEN n > 6 THEN length(text) ELSE 0 END) OVER w2 AS BIGINT) AS used FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text) AS n FROM turn) WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC, text), w2 AS (PARTITION BY conv_id ORDER BY turn DESC, text ROWS UNBOUNDED PRECEDING))
    SELECT conv_id, turn, age, used, CASE WHEN age <= 6 THEN 'whole' WHEN used <= 800 THEN 'condensed' ELSE 'left out' END AS kept FROM a""")
def win_memory_recent(t):
    return ru.memory(t.turn, 6, 800).select("conv_id", "turn", "age", "used", "kept")


@query("""SELECT id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY "at" RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS recent FROM log""")
def win_sliding_hour(t):
    """Records of a user in the hour up to each record."""
    return ru.sliding_count(t.log, 3600).select("id", "user_id", "recent")


@query("SELECT id, kind, row_number() OVER (PARTITION BY kind ORDER BY id) AS position FROM log WHERE kind IN ('view', 'signup')")
def win_queue_position(t):
    return t.log.where(F.col("kind").isin("view", "signup")).select("id", "kind", place(["kind"], "id").alias("position"))


@query("SELECT doc_id, idx, row_number() OVER (PARTITION BY doc_id, section ORDER BY idx) AS part, count(*) OVER (PARTITION BY doc_id, section) AS parts FROM chunk")
def win_part_index(t):
    """Which of how many citations of one place."""
    return t.chunk.select("doc_id", "idx", place(["doc_id", "section"], "idx").alias("part"), F.count("*").over(Window.partitionBy("doc_id", "section")).alias("parts"))


@query("SELECT kind, user_id, id, value FROM log QUALIFY row_number() OVER (PARTITION BY kind, user_id ORDER BY id DESC) = 1")
def win_latest_per_key(t):
    return t.log.groupBy("kind", "user_id").agg(F.max("id").alias("id"), F.max_by("value", "id").alias("value"))


@query("""WITH v AS (SELECT user_id, CAST("at" AS DATE) AS day, max(value) AS v FROM log GROUP BY ALL) SELECT user_id, day, v, lag(v) OVER (PARTITION BY user_id ORDER BY day) AS before, v IS DISTINCT FROM lag(v) OVER (PARTITION BY user_id ORDER BY day) AS changed FROM v""")
def win_prev_change(t):
    v = t.log.groupBy("user_id", F.to_date("at").alias("day")).agg(F.max("value").alias("v"))
    before = F.lag("v").over(Window.partitionBy("user_id").orderBy("day"))
    return v.withColumn("before", before).withColumn("changed", ~F.col("v").eqNullSafe(F.col("before")))


@query(f"""WITH v AS (SELECT kind AS metric, CAST("at" AS DATE) AS day, {sql.rounded("count(*) FILTER (value >= 5) / CAST(count(*) AS DOUBLE)")} AS score FROM log GROUP BY kind, CAST("at" AS DATE)), b AS (SELECT *, lag(score) OVER (PARTITION BY metric ORDER BY day) AS before FROM v)
    SELECT *, CASE WHEN score < 0.6e0 THEN 'FAIL' WHEN score < 0.7e0 OR coalesce(before - score > 0.07e0, false) THEN 'WARN' ELSE 'PASS' END AS verdict FROM b""")
def q_judge(t):
    v = t.log.groupBy(F.col("kind").alias("metric"), F.to_date("at").alias("day")).agg(share(F.count_if(F.col("value") >= 5), F.count("*")).alias("score"))
    return ru.judge(v, 0.6, 0.7, 0.07)


@query("SELECT id, CASE WHEN kind = 'error' THEN 'error' WHEN value < 1 THEN 'empty' WHEN k % 10 = 0 THEN 'mismatch' WHEN k < 5 THEN 'no source' ELSE 'ok' END AS class FROM log")
def q_classify_failures(t):
    return t.log.select("id", F.when(F.col("kind") == "error", "error").when(F.col("value") < 1, "empty").when(F.col("k") % 10 == 0, "mismatch").when(F.col("k") < 5, "no source").otherwise("ok").alias("class"))


@query("""WITH r AS (SELECT page_id, lower(regexp_extract(url, '/([a-z]{2})/', 1)) AS topic, row_number() OVER (PARTITION BY regexp_extract(url, '/([a-z]{2})/', 1) ORDER BY page_id) AS p, page_id % 10 = 0 AS recent FROM pages), n AS (SELECT topic, count(*) AS n FROM r WHERE recent GROUP BY topic), o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY page_id) AS q FROM r WHERE NOT recent)
    SELECT page_id, topic, true AS recent FROM r WHERE recent UNION ALL SELECT page_id, o.topic, false FROM o LEFT JOIN n ON o.topic = n.topic WHERE q <= 10 - coalesce(n, 0)""")
def topk_quiet_week(t):
    """Recent pages of each topic, filled with older ones up to ten."""
    p = t["pages"].select("page_id", F.lower(F.regexp_extract("url", "/([a-z]{2})/", 1)).alias("topic"))
    return ru.fill_to(p.where("page_id % 10 = 0"), p.where("page_id % 10 <> 0"), ["topic"], ["page_id"], 10)


@query("""SELECT CAST(isoyear("at") AS VARCHAR) || '-W' || lpad(CAST(weekofyear("at") AS VARCHAR), 2, '0') AS week, kind, count(*) AS n, count(DISTINCT user_id) AS users FROM log GROUP BY ALL""")
def q_weekly_digest(t):
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "at").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("at").cast("string"), 2, "0"))
    return t.log.groupBy(week.alias("week"), "kind").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


_NUMS = "list_distinct(regexp_extract_all(text, '[0-9]+(?:\\.[0-9]+)?'))"


@query(f"""WITH a AS (SELECT conv_id, turn, unnest({_NUMS}) AS number FROM turn WHERE role = 'assistant'), e AS (SELECT DISTINCT conv_id, unnest({_NUMS}) AS number FROM turn WHERE role <> 'assistant') SELECT a.* FROM a WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.conv_id = a.conv_id AND e.number = a.number)""")
def q_ungrounded_numbers(t):
    """Numbers of an answer that neither the question nor the evidence of the conversation has."""
    numbers = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"([0-9]+(?:\.[0-9]+)?)")))).alias("number")
    said = t.turn.where("role = 'assistant'").select("conv_id", "turn", numbers)
    return said.join(t.turn.where("role <> 'assistant'").select("conv_id", numbers).distinct(), ["conv_id", "number"], "left_anti").select("conv_id", "turn", "number")


_CAPS = "list_distinct(regexp_extract_all(text, '[A-ZÀ-Þ][a-zß-ÿ]{4,}'))"


@query(f"""WITH c AS (SELECT conv_id, turn, unnest({_CAPS}) AS name FROM turn WHERE role = 'assistant'), own AS (SELECT DISTINCT conv_id, unnest({_CAPS}) AS name FROM turn WHERE role = 'user'), any_ AS (SELECT DISTINCT unnest({_CAPS}) AS name FROM turn WHERE role = 'user')
    SELECT conv_id, turn, count(*) AS claims, count(*) FILTER (own_) AS verified, count(*) FILTER (NOT own_ AND other) AS other_source, count(*) FILTER (NOT own_ AND NOT other) AS not_found FROM (SELECT c.conv_id, c.turn, own.name IS NOT NULL AS own_, any_.name IS NOT NULL AS other FROM c LEFT JOIN own ON c.conv_id = own.conv_id AND c.name = own.name LEFT JOIN any_ ON c.name = any_.name) GROUP BY conv_id, turn""")
def q_grounding(t):
    """Names in answers: found in the conversation's own questions, in those of others, or nowhere."""
    names = F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("([A-ZÀ-Þ][a-zß-ÿ]{4,})")))).alias("name")
    said = t.turn.where("role = 'assistant'").select("conv_id", "turn", names)
    own = t.turn.where("role = 'user'").select("conv_id", names).distinct()
    other = own.select("name").distinct().withColumn("_o", F.lit(True))
    both = said.join(own.withColumn("_w", F.lit(True)), ["conv_id", "name"], "left").join(other, "name", "left")
    in_own, in_other = F.col("_w").isNotNull(), F.col("_o").isNotNull()
    return both.groupBy("conv_id", "turn").agg(F.count("*").alias("claims"), F.count_if(in_own).alias("verified"), F.count_if(~in_own & in_other).alias("other_source"), F.count_if(~in_own & ~in_other).alias("not_found"))


_FACTS = "[['the', 'und'], ['que', 'ion'], ['zzz', 'an']]"


@query(f"""SELECT conv_id, turn, passed, hits FROM (SELECT conv_id, turn, len(list_filter({_FACTS}, lambda g: list_bool_or(list_transform(g, lambda o: contains(lower(text), o))))) AS hits, len(list_filter({_FACTS}, lambda g: list_bool_or(list_transform(g, lambda o: contains(lower(text), o))))) = 3 AND NOT contains(lower(text), 'password') AS passed FROM turn WHERE role = 'assistant')""")
def q_score_answer(t):
    """Fact groups of which an answer has any wording; it passes with all groups and nothing forbidden."""
    groups = F.array(*[F.array(*map(F.lit, g)) for g in (("the", "und"), ("que", "ion"), ("zzz", "an"))])
    low = F.lower("text")
    hits = F.size(F.filter(groups, lambda g: F.exists(g, lambda o: F.contains(low, o)))).cast("bigint")
    return t.turn.where("role = 'assistant'").select("conv_id", "turn", ((hits == 3) & ~F.contains(low, F.lit("password"))).alias("passed"), hits.alias("hits"))


@query("""SELECT doc_id, CASE WHEN length(text) < 50 THEN 'too short' WHEN role IS NULL THEN 'no language' WHEN NOT eligible THEN 'rejected' WHEN NOT current THEN 'superseded' ELSE 'publish' END AS stage FROM document""")
def q_pipeline_stages(t):
    """The stage at which each document stops, or that it is published."""
    return t.document.select("doc_id", F.when(F.length("text") < 50, "too short").when(F.col("role").isNull(), "no language").when(~F.col("eligible"), "rejected").when(~F.col("current"), "superseded").otherwise("publish").alias("stage"))


@query("SELECT publisher, '- ' || string_agg(doc_id || ': ' || title, chr(10) || '- ' ORDER BY searches DESC, doc_id) AS lines FROM (SELECT publisher, d.doc_id, title, count(l.id) AS searches FROM document d LEFT JOIN log l ON l.k = d.doc_id WHERE current GROUP BY ALL) GROUP BY publisher")
def snk_index_md(t):
    """An index of each publisher's current documents, those searched most first."""
    d = t.document.where("current").select("doc_id", "title", "publisher").join(t.log.select(F.col("k").alias("doc_id"), "id"), "doc_id", "left")
    d = d.groupBy("publisher", "doc_id", "title").agg(F.count("id").alias("searches"))
    row = F.concat_ws(": ", F.col("doc_id").cast("string"), "title")
    g = d.groupBy("publisher").agg(F.array_sort(F.collect_list(F.struct((-F.col("searches")).alias("s"), "doc_id", row.alias("r")))).alias("x"))
    return g.select("publisher", F.concat(F.lit("- "), F.array_join(F.transform("x", lambda v: v["r"]), "\n- ")).alias("lines"))


@query("SELECT r_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS nations, '| ' || r_name || ' | ' || count(*) || ' |' AS row FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY r_regionkey, r_name")
def snk_exports(t):
    """Lines of a Markdown table made of a small dimension."""
    n = t["region"].join(t["nation"], F.col("r_regionkey") == F.col("n_regionkey")).groupBy("r_regionkey", "r_name").agg(F.count("*").alias("n"), listed(F.col("n_name"), sep=", ").alias("nations"))
    return n.select("r_regionkey", "nations", F.concat(F.lit("| "), "r_name", F.lit(" | "), F.col("n").cast("string"), F.lit(" |")).alias("row"))


@query("SELECT conv_id, count(*) AS turns, count(DISTINCT role) AS roles, string_agg(DISTINCT role, ',' ORDER BY role) AS named FROM turn GROUP BY conv_id")
def agg_conversations(t):
    return t.turn.groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_distinct("role").alias("roles"), distinct_listed(F.col("role")).alias("named"))


@query("SELECT doc_id, idx, md5(body) AS line FROM (SELECT c.*, row_number() OVER (PARTITION BY md5(body) ORDER BY source, c.doc_id, idx) AS n FROM chunk c JOIN documents d USING (doc_id)) WHERE n = 1")
def set_union_dedupe(t):
    """Chunks of all sources, each text once: that of the first source."""
    c = t.chunk.join(t["documents"].select("doc_id", "source"), "doc_id").withColumn("line", F.md5("body"))
    first = c.groupBy("line").agg(F.min(F.struct("source", "doc_id", "idx")).alias("f"))
    return first.select("f.doc_id", "f.idx", "line")


@query("SELECT conv_id, turn, similarity FROM (SELECT a.conv_id, a.turn, max(" + sql.rounded("len(list_intersect(aw, bw)) / CAST(greatest(len(aw), len(bw), 1) AS DOUBLE)") + ") AS similarity FROM (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS aw FROM turn WHERE role = 'user') a JOIN (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS bw FROM turn WHERE role = 'assistant') b USING (conv_id) GROUP BY a.conv_id, a.turn) WHERE similarity > 0.1")
def q_similar_qa(t):
    """Each question with the likeness of the answer of its conversation that is most like it, where over 0.1."""
    w = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)")))
    a, b = t.turn.where("role = 'user'").select("conv_id", "turn", w.alias("aw")), t.turn.where("role = 'assistant'").select("conv_id", w.alias("bw"))
    like = rounded(F.size(F.array_intersect("aw", "bw")) / F.greatest(F.size("aw"), F.size("bw"), F.lit(1)))
    return a.join(b, "conv_id").groupBy("conv_id", "turn").agg(F.max(like).alias("similarity")).where("similarity > 0.1")


_HEAD = "'run ' || run_id || ' / ' || coalesce(band, '-')"
_LINE = "concat_ws(' | ', case_id, CAST(width AS VARCHAR), verdict)"


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT run_id, band, run_id || '/' || coalesce(band, '') AS k, row_number() OVER (ORDER BY {_LINE}) AS o, {_LINE} AS line, {_HEAD} AS head FROM result),
    {sql.packs("SELECT k, o, length(line) AS size, 609 - 1 - length(head) AS budget FROM l", nested=True)}
    SELECT run_id, band, pack, any_value(head) || chr(10) || string_agg(line, chr(10) ORDER BY o) AS content FROM packed JOIN l USING (k, o) GROUP BY run_id, band, pack""")
def q_chunk_report(t):
    """Result lines of each run and band, packed under their heading within 380 tokens."""
    line = F.concat_ws(" | ", "case_id", F.col("width").cast("string"), "verdict")
    head = F.concat(F.lit("run "), F.col("run_id").cast("string"), F.lit(" / "), F.coalesce("band", F.lit("-")))
    return pk.headed(t.result.select("run_id", "band", line.alias("line")), ["run_id", "band"], ["line"], "line", head)
