"""Views that give the driver's tables the shape of test reports, documents, chunks, logs and job ledgers.

Each view is a DataFrame here and, for the oracle, a common table expression of the same rows.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

METRICS = (("quantity", "pcs", "l_quantity"), ("rate", "Mbps", "l_extendedprice"), ("latency", "ms", "l_discount"), ("level", "dB", "l_tax"))
#: metric, unit, whether more is better (unknown: null), kind of rule and its threshold.
DICTIONARY = (("quantity", "pcs", True, "absolute", 5.0), ("rate", "Mbps", True, "percent", 10.0), ("latency", "ms", False, "percent", 20.0), ("level", "dB", None, "absolute", 0.03))
WIDTHS = (20, 40, 80, 160)


class Tables:
    """The tables of one folder, and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getitem__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def run(self) -> DataFrame:
        o = self["orders"].join(self["customer"], F.col("o_custkey") == F.col("c_custkey"))
        o = o.join(self["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
        key = F.col("o_orderkey")
        return o.select(
            key.alias("run_id"), F.col("o_custkey").alias("product_id"), F.col("c_name").alias("model"), F.col("n_name").alias("vendor"),
            F.lower(F.substring("o_orderpriority", 3, 20)).alias("report_type"), (F.col("o_orderstatus") != "P").alias("published"),
            F.col("o_orderdate").cast("date").alias("test_date"), F.array("c_mktsegment", "n_name").alias("roles"),
            F.concat(F.lit("fw"), (key % 5).cast("string")).alias("firmware"),
            F.when(key % 11 != 0, F.concat(F.lit("hw"), (key % 3).cast("string"))).alias("hardware"),
            F.concat(F.lit("chip"), (key % 2).cast("string")).alias("chipset"),
        )

    @cached_property
    def measurement(self) -> DataFrame:
        points = F.array(*[F.struct(F.lit(m).alias("metric"), F.lit(u).alias("unit"), F.col(c).alias("value")) for m, u, c in METRICS])
        part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
        rows = self["lineitem"].select(
            F.col("l_orderkey").alias("run_id"), F.concat(F.lit("case-"), (part % 40).cast("string")).alias("case_id"), F.explode(points).alias("p"),
            F.col("l_returnflag").alias("band"), F.element_at(F.array(*map(F.lit, WIDTHS)), (supp % 4 + 1).cast("int")).alias("width"),
            F.nullif(part % 7, F.lit(0)).alias("channel"), F.nullif(F.col("l_linestatus"), F.when(part % 13 == 0, F.lit("O"))).alias("direction"),
            line.alias("sample"), F.concat(F.lit("sheet"), (supp % 3).cast("string")).alias("sheet"), F.concat_ws(":", part.cast("string"), supp.cast("string"), line.cast("string")).alias("cell"),
        )
        return rows.select("run_id", "case_id", "p.metric", "p.unit", "p.value", "band", "width", "channel", "direction", "sample", "sheet", "cell")

    @cached_property
    def dictionary(self) -> DataFrame:
        return self.spark.createDataFrame(DICTIONARY, "metric string, unit string, more_is_better boolean, rule string, threshold double")

    @cached_property
    def result(self) -> DataFrame:
        line = self["lineitem"].join(self["part"], F.col("l_partkey") == F.col("p_partkey"))
        good = F.col("l_extendedprice") >= F.col("p_retailprice") * F.col("l_quantity")
        return line.select(
            F.col("l_orderkey").alias("run_id"), F.concat(F.lit("case-"), (F.col("l_partkey") % 40).cast("string")).alias("case_id"), F.col("p_type").alias("item"),
            F.col("l_returnflag").alias("band"), F.element_at(F.array(*map(F.lit, WIDTHS)), (F.col("l_suppkey") % 4 + 1).cast("int")).alias("width"),
            F.nullif(F.col("l_partkey") % 7, F.lit(0)).alias("channel"), F.col("p_retailprice").alias("criterion"),
            F.when(F.col("l_tax") == 0, "n/a").when(good, "pass").otherwise("fail").alias("verdict"),
        )

    @cached_property
    def document(self) -> DataFrame:
        """doc_id, title, text, publisher, role, family, current (the latest of its family), eligible, topics."""
        last = self["documents"].groupBy((F.col("doc_id") % 200).alias("family")).agg(F.max("doc_id").alias("last"))
        begin = F.regexp_extract(F.lower("text"), "^(?:[^a-z]*+[a-z]++){0,6}+", 0)  # no more of a text is taken apart than its first six words
        words = F.regexp_extract_all(begin, F.lit("([a-z]+)"))
        # What is made of a text is made before the join, which carries the text itself only for those who ask for it.
        d = self["documents"].select(
            "doc_id", F.array_join(words, " ").alias("title"), "text", F.col("source").alias("publisher"), F.col("lang").alias("role"),
            (F.col("doc_id") % 200).alias("family"), F.array_distinct(words).alias("topics"),
        )
        d = d.join(self["labels"].select("doc_id", "quality"), "doc_id", "left").withColumn("eligible", F.coalesce("quality", F.lit(1)) == 1)
        d = d.join(F.broadcast(last), "family").withColumn("current", F.col("doc_id") == F.col("last"))
        return d.select("doc_id", "title", "text", "publisher", "role", "family", "current", "eligible", "topics")

    @cached_property
    def chunk(self) -> DataFrame:
        """One row for each line of each document that isn't blank: doc_id, idx, body, section."""
        line = self["documents"].select("doc_id", F.posexplode(F.split("text", "\n")).alias("idx", "body")).where(F.trim("body") != "")
        return line.select("doc_id", F.col("idx").cast("bigint").alias("idx"), "body", F.floor(F.col("idx") / 5).cast("bigint").alias("section"))

    @cached_property
    def log(self) -> DataFrame:
        """Events as log records: id, at, user_id, kind, value, k."""
        return self["events"].select(F.col("event_id").alias("id"), F.col("ts").alias("at"), "user_id", F.col("event_type").alias("kind"), "value", F.get_json_object("props", "$.k").cast("bigint").alias("k"))

    @cached_property
    def item(self) -> DataFrame:
        return self["benchmark"]

    @cached_property
    def turn(self) -> DataFrame:
        return self["conversations"]


SQL = {
    "run": """SELECT o_orderkey AS run_id, o_custkey AS product_id, c_name AS model, n_name AS vendor, lower(substr(o_orderpriority, 3, 20)) AS report_type,
        o_orderstatus <> 'P' AS published, CAST(o_orderdate AS DATE) AS test_date, [c_mktsegment, n_name] AS roles, 'fw' || (o_orderkey % 5) AS firmware,
        CASE WHEN o_orderkey % 11 <> 0 THEN 'hw' || (o_orderkey % 3) END AS hardware, 'chip' || (o_orderkey % 2) AS chipset
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "measurement": "SELECT run_id, case_id, p.metric AS metric, p.unit AS unit, p.value AS value, band, width, channel, direction, sample, sheet, cell FROM (SELECT l_orderkey AS run_id, "
    "'case-' || (l_partkey % 40) AS case_id, unnest([" + ", ".join(f"{{'metric': '{m}', 'unit': '{u}', 'value': {c}}}" for m, u, c in METRICS) + "]) AS p, l_returnflag AS band, "
    f"CAST({list(WIDTHS)}[CAST(l_suppkey % 4 + 1 AS INT)] AS INT) AS width, nullif(l_partkey % 7, 0) AS channel, CASE WHEN l_partkey % 13 = 0 AND l_linestatus = 'O' THEN NULL ELSE l_linestatus END AS direction, "
    "l_linenumber AS sample, 'sheet' || (l_suppkey % 3) AS sheet, l_partkey || ':' || l_suppkey || ':' || l_linenumber AS cell FROM lineitem)",
    "dictionary": "SELECT * FROM (VALUES " + ", ".join(f"('{m}', '{u}', {'NULL' if b is None else str(b)}, '{r}', CAST({x} AS DOUBLE))" for m, u, b, r, x in DICTIONARY) + ") v(metric, unit, more_is_better, rule, threshold)",
    "result": f"""SELECT l_orderkey AS run_id, 'case-' || (l_partkey % 40) AS case_id, p_type AS item, l_returnflag AS band, CAST({list(WIDTHS)}[CAST(l_suppkey % 4 + 1 AS INT)] AS INT) AS width,
        nullif(l_partkey % 7, 0) AS channel, p_retailprice AS criterion, CASE WHEN l_tax = 0 THEN 'n/a' WHEN l_extendedprice >= p_retailprice * l_quantity THEN 'pass' ELSE 'fail' END AS verdict
        FROM lineitem JOIN part ON l_partkey = p_partkey""",
    "document": """SELECT d.doc_id, array_to_string(regexp_extract_all(lower(text), '[a-z]+')[1:6], ' ') AS title, text, source AS publisher, lang AS role, d.doc_id % 200 AS family,
        d.doc_id = max(d.doc_id) OVER (PARTITION BY d.doc_id % 200) AS current, coalesce(quality, 1) = 1 AS eligible, list_distinct(regexp_extract_all(lower(text), '[a-z]+')[1:6]) AS topics
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "chunk": """SELECT doc_id, idx, body, CAST(floor(idx / 5) AS BIGINT) AS section FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body,
        unnest(range(len(string_split(text, chr(10))))) AS idx FROM documents) WHERE trim(body) <> ''""",
    "log": "SELECT event_id AS id, ts AS at, user_id, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "item": "SELECT * FROM benchmark",
    "turn": "SELECT * FROM conversations",
}


def with_views(sql: str) -> str:
    """``sql`` with the views it names put before it."""
    used = [name for name in SQL if re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql, re.I)]
    views = ", ".join(f"{name} AS ({SQL[name]})" for name in used)
    sql = sql.strip()
    if not views:
        return sql
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", sql, re.I):
        return f"WITH {m[1] or ''}{views}, {sql[m.end() :]}"
    return f"WITH {views} {sql}"
