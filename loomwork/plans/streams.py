"""Streaming queries: the events table read as a stream, results as tables that equal those of a batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.plans.registry import query
from loomwork.streaming import runs


def _events(t):
    """The events as a stream; late ones are those that come after the whole time that the table spans (and a day), so none of it is dropped, whatever the order of its files."""
    span = t["events"].agg(F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))).first()[0] or 0
    return runs.events(t.spark, f"{t.folder}/events.parquet", f"{span // 86_400 + 2} days")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_tumbling_window(t):
    out = runs.updated(runs.tumbling(_events(t), "1 hour"), "tumbling", ["start", "event_type"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("WITH w AS (SELECT value, unnest(generate_series(CAST(CAST(ts AS DATE) AS TIMESTAMP) - INTERVAL 6 DAY, CAST(CAST(ts AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS start FROM events) SELECT start, count(*) AS n, max(value) AS highest FROM w GROUP BY start")
def st_sliding_window(t):
    out = runs.updated(runs.sliding(_events(t), "7 days", "1 day"), "sliding", ["start"])
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 DAY AS end_at, count(*) AS n FROM s GROUP BY user_id, visit""")
def st_session_window(t):
    """Visits of each user with a gap of a day."""
    out = runs.appended(runs.sessions(runs.events(t.spark, f"{t.folder}/events.parquet", "0 seconds"), "1 day"), "sessions")
    batch = t["events"].withColumn("at", F.col("ts").cast("timestamp"))
    # Still open at the last watermark. A left join, since an anti join would be pushed below the merging of sessions.
    told = out.select("user_id", "start", F.lit(True).alias("told"))
    rest = runs.sessions(batch, "1 day").join(told, ["user_id", "start"], "left").where("told is null").drop("told")
    both = out.unionByName(rest)
    return both.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end_at"), "n")


@query("SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL")
def st_stream_counts(t):
    """Running counts of each user and key."""
    k = F.get_json_object("props", "$.k").cast("bigint").alias("k")
    return runs.updated(_events(t).groupBy("user_id", k).agg(F.count("*").alias("n")), "counts", ["user_id", "k"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def st_stream_dedupe(t):
    """The first event of each user and type."""
    first = _events(t).select("user_id", "event_type", "at").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return runs.appended(first.select("user_id", "event_type"), "dedupe")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 50 = 0)")
def st_stream_tombstone(t):
    """A stream against a table of deleted keys."""
    dead = t["events"].where("event_type = 'purchase' and event_id % 50 = 0").select("user_id").distinct()
    return runs.appended(_events(t).join(dead, "user_id", "left_anti").select("event_id", "user_id"), "tombstones")
