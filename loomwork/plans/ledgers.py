"""Queries of job, change and deletion ledgers: log records stand for submissions, revisions, leases and callbacks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators import graphs as g
from loomwork.operators import ledgers as le
from loomwork.operators import ordered as od
from loomwork.operators.common import place
from loomwork.plans.registry import query


def _submissions_sql(key: str, body: str) -> str:
    return f"""SELECT id, {key}, CASE WHEN row_number() OVER w = 1 THEN 'accepted' WHEN {body} IS NOT DISTINCT FROM first_value({body}) OVER w THEN 'repeated' ELSE 'conflict' END AS state
    FROM log WINDOW w AS (PARTITION BY {key} ORDER BY id ROWS UNBOUNDED PRECEDING)"""


@query(_submissions_sql("user_id, k", "kind"))
def st_idempotent_submit(t):
    """The same key again: repeated with the same body, else a conflict."""
    return le.submissions(t.log, ["user_id", "k"], "kind", "id").select("id", "user_id", "k", "state")


@query(_submissions_sql("kind, k", "user_id"))
def st_registry_conflict(t):
    return le.submissions(t.log, ["kind", "k"], "user_id", "id").select("id", "kind", "k", "state")


_DEAD = "dead AS (SELECT user_id, min(id) AS deleted FROM log WHERE kind = 'purchase' AND k % 10 = 0 GROUP BY user_id)"


def tombstones(t) -> DataFrame:
    return t.log.where("kind = 'purchase' and k % 10 = 0").select("user_id", F.col("id").alias("deleted"))


@query(f"WITH {_DEAD} SELECT id, l.user_id AS user_id, coalesce(id > deleted, false) AS refused FROM log l LEFT JOIN dead d ON l.user_id = d.user_id")
def st_tombstone(t):
    """Records that come after their key was deleted are refused."""
    return le.without_deleted(t.log, tombstones(t), "user_id", "id").select("id", "user_id", "refused")


@query("SELECT id, user_id, k, coalesce(k <= max(k) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS stale FROM log")
def st_stale_revision(t):
    return le.stale(t.log, ["user_id"], "k", "id").select("id", "user_id", "k", "stale")


@query("""WITH busy AS (SELECT user_id FROM log GROUP BY user_id HAVING arg_max(kind, id) = 'signup') SELECT user_id, id, k FROM log WHERE value < 10 AND user_id NOT IN (SELECT user_id FROM busy) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY k, id) = 1""")
def st_change_order(t):
    """The next change of each key by revision, while no ingestion of that key runs."""
    busy = t.log.groupBy("user_id").agg(F.max_by("kind", "id").alias("last")).where("last = 'signup'").select("user_id")
    rows = t.log.withColumn("_o", F.struct("k", "id")).join(busy, "user_id", "left_anti")
    return le.next_in_order(rows, ["user_id"], "_o", F.col("value") >= 10).select("user_id", "id", "k")


@query("SELECT kind, user_id, id FROM log WHERE value < 10 QUALIFY row_number() OVER (PARTITION BY kind, user_id ORDER BY id) = 1")
def st_outbox_order(t):
    """Of each kind and reference the first callback that isn't delivered."""
    return le.next_in_order(t.log, ["kind", "user_id"], "id", F.col("value") >= 10).select("kind", "user_id", "id")


@query("SELECT a.id AS id, a.user_id AS user_id FROM log a WHERE a.value < 10 AND NOT EXISTS (SELECT 1 FROM log b WHERE b.user_id = a.user_id AND b.value < 10 AND b.id < a.id) AND NOT EXISTS (SELECT 1 FROM log c WHERE c.user_id = a.user_id AND c.kind = 'error' AND c.k = 0)")
def join_not_exists_order(t):
    """Claimable rows: no earlier unfinished one of the same key, and nothing of it running."""
    running = t.log.where("kind = 'error' and k = 0").select("user_id").distinct()
    return le.next_in_order(t.log, ["user_id"], "id", F.col("value") >= 10).join(running, "user_id", "left_anti").select("id", "user_id")


@query("""SELECT kind, id, user_id FROM log WHERE "at" + k * INTERVAL 1 MINUTE <= TIMESTAMP '2024-01-15 00:00:00' AND kind IN ('view', 'error') QUALIFY row_number() OVER (PARTITION BY kind, user_id ORDER BY id) = 1""")
def st_lease_claim(t):
    """The next job of each kind and worker whose lease has run out."""
    until = F.col("at") + F.make_dt_interval(F.lit(0), F.lit(0), F.col("k").cast("int"))
    free = t.log.where(F.col("kind").isin("view", "error")).where(until <= F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00")))
    return free.withColumn("_n", place(["kind", "user_id"], "id")).where("_n = 1").select("kind", "id", "user_id")


@query("SELECT user_id, n AS attempts, CASE WHEN n > 4 THEN 'Failed' ELSE 'Waiting' END AS state, CASE n WHEN 1 THEN 30 WHEN 2 THEN 120 WHEN 3 THEN 600 WHEN 4 THEN 3600 END AS delay FROM (SELECT user_id, count(*) AS n FROM log WHERE kind = 'error' AND k < 30 GROUP BY user_id)")
def st_retry_backoff(t):
    jobs = t.log.where("kind = 'error' and k < 30").groupBy("user_id").agg(F.count("*").alias("attempts"))
    return le.retry(jobs, [30, 120, 600, 3600])


@query("SELECT id, user_id, CASE WHEN id = last THEN 'Active' WHEN id < last THEN 'Superseded' ELSE 'Pending' END AS index_state FROM (SELECT id, user_id, max(id) FILTER (kind = 'purchase') OVER (PARTITION BY user_id) AS last FROM log)")
def st_supersede_after_complete(t):
    return le.retired(t.log, "user_id", "id", F.col("kind") == "purchase").select("id", "user_id", "index_state")


@query("""WITH a AS (SELECT id, user_id, k AS revision, kind AS hash, max(k) OVER (PARTITION BY user_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high, first_value(kind) OVER (PARTITION BY user_id, k ORDER BY id ROWS UNBOUNDED PRECEDING) AS first FROM log),
    s AS (SELECT id, user_id, revision, CASE WHEN high IS NULL OR revision > high THEN 'stored' WHEN revision < high THEN 'stale' WHEN hash = first THEN 'same' ELSE 'conflict' END AS state FROM a)
    SELECT *, count(*) FILTER (state = 'stored') OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS analysis_version FROM s""")
def st_stale_manifest(t):
    rows = t.log.select("id", "user_id", F.col("k").alias("revision"), F.col("kind").alias("hash"))
    return le.manifests(rows, "user_id", "id").drop("hash")


@query("SELECT DISTINCT md5(body) AS line FROM chunk WHERE doc_id % 2 = 1 AND md5(body) NOT IN (SELECT md5(body) FROM chunk WHERE doc_id % 2 = 0)")
def set_expected_except(t):
    """Lines that the store holds but this package didn't stage: they go."""
    lines = t.chunk.select("doc_id", F.md5("body").alias("line"))
    staged = lines.where("doc_id % 2 = 0").select("line")
    return lines.where("doc_id % 2 = 1").select("line").join(staged, "line", "left_anti").distinct()


@query("SELECT d.doc_id AS doc_id, CASE WHEN p.doc_id IS NULL THEN 'staged' WHEN bool_and(c.doc_id IS NOT NULL) THEN 'switched' ELSE 'kept old' END AS state FROM documents d LEFT JOIN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) p USING (doc_id) LEFT JOIN chunk c ON c.doc_id = d.doc_id GROUP BY d.doc_id, p.doc_id")
def st_staged_publish(t):
    """A package is switched to when all of its documents have chunks; else the old one serves on."""
    have = t.chunk.select("doc_id").distinct().withColumn("_c", F.lit(True))
    d = t["documents"].select("doc_id").join(have, "doc_id", "left")
    return d.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "staged").when(F.col("_c"), "switched").otherwise("kept old").alias("state"))


@query("WITH old AS (SELECT DISTINCT md5(body) AS line FROM chunk WHERE doc_id % 4 = 0) SELECT doc_id, count(o.line) AS reused, count(*) - count(o.line) AS to_encode FROM chunk c LEFT JOIN old o ON md5(c.body) = o.line GROUP BY doc_id")
def st_vector_reuse(t):
    """Chunks whose text has a vector already, and those that must be encoded."""
    lines = t.chunk.select("doc_id", F.md5("body").alias("line"))
    old = lines.where("doc_id % 4 = 0").select("line").distinct().withColumn("_o", F.lit(1))
    return lines.join(old, "line", "left").groupBy("doc_id").agg(F.count("_o").alias("reused"), (F.count("*") - F.count("_o")).alias("to_encode"))


@query("""WITH w AS (SELECT kind, k, user_id, unnest(generate_series(CAST(CAST("at" AS DATE) AS TIMESTAMP) - INTERVAL 6 DAY, CAST(CAST("at" AS DATE) AS TIMESTAMP), INTERVAL 1 DAY)) AS start FROM log) SELECT start, kind, count(*) AS n, count(DISTINCT k) AS items FROM w GROUP BY start, kind""")
def st_digest_window(t):
    """Seven-day windows, a new one each day, each item counted once."""
    return t.log.groupBy(F.window("at", "7 days", "1 day").alias("w"), "kind").agg(F.count("*").alias("n"), F.count_distinct("k").alias("items")).select(F.col("w.start").alias("start"), "kind", "n", "items")


_SNAP = "o AS (SELECT k, max(value) AS v FROM log WHERE id % 3 <> 0 AND k <> 7 GROUP BY k), n AS (SELECT k, max(value) AS v FROM log WHERE id % 3 <> 1 AND k <> 9 GROUP BY k)"


@query(f"WITH {_SNAP} SELECT coalesce(o.k, n.k) AS k, o.v AS before, n.v AS after, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'removed' WHEN o.v IS NOT DISTINCT FROM n.v THEN 'unchanged' ELSE 'replaced' END AS change FROM o FULL JOIN n ON o.k = n.k")
def set_diff_snapshot(t):
    old = t.log.where("id % 3 <> 0 and k <> 7").groupBy("k").agg(F.max("value").alias("v"))
    new = t.log.where("id % 3 <> 1 and k <> 9").groupBy("k").agg(F.max("value").alias("v"))
    return le.snapshot_changes(old, new, "k", "v")


@query("SELECT coalesce(o.family, n.family) AS family, CASE WHEN o.family IS NULL THEN 'new' WHEN n.family IS NULL THEN 'removed' ELSE 'superseded' END AS event FROM (SELECT family, max(doc_id) AS d FROM document WHERE doc_id % 5 <> 0 GROUP BY family) o FULL JOIN (SELECT family, max(doc_id) AS d FROM document WHERE family <> 3 GROUP BY family) n ON o.family = n.family WHERE o.d IS DISTINCT FROM n.d")
def st_doc_events(t):
    """New, superseded and removed documents between two snapshots."""
    old = t.document.where("doc_id % 5 <> 0").groupBy("family").agg(F.max("doc_id").alias("d"))
    new = t.document.where("family <> 3").groupBy("family").agg(F.max("doc_id").alias("d"))
    rows = le.snapshot_changes(old, new, "family", "d").where("change <> 'unchanged'")
    return rows.select("family", F.when(F.col("change") == "added", "new").when(F.col("change") == "removed", "removed").otherwise("superseded").alias("event"))


@query("""WITH c AS (SELECT id, user_id, kind, CAST(kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY user_id ORDER BY id) AS INT) AS new FROM log WHERE id > 100), r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM c) SELECT user_id, kind, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM r GROUP BY user_id, run, kind""")
def st_progress_cursor(t):
    """Events after a cursor, those of one kind in a row as one."""
    w = Window.partitionBy("user_id").orderBy("id")
    c = t.log.where("id > 100").withColumn("new", (~F.col("kind").eqNullSafe(F.lag("kind").over(w))).cast("int"))
    c = c.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy("user_id", "run", "kind").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count("*").alias("n")).drop("run")


@query("SELECT user_id, k, count(*) AS n FROM log WHERE kind = 'view' GROUP BY user_id, k HAVING count(*) >= 3")
def st_popularity(t):
    return t.log.where("kind = 'view'").groupBy("user_id", "k").agg(F.count("*").alias("n")).where("n >= 3")


@query("""WITH c AS (SELECT id, user_id, k % 2 AS marker, coalesce(k % 2 <> lag(k % 2) OVER (PARTITION BY user_id ORDER BY id), false) AS changed FROM log), r AS (SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY user_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT id, user_id, marker, row_number() OVER (PARTITION BY user_id, run ORDER BY id) = 2 AND run > 0 AS settled FROM r""")
def st_settle_change(t):
    """A change counts once it has stayed the same for two polls."""
    polls = t.log.select("id", "user_id", (F.col("k") % 2).alias("marker"))
    return le.settled(polls, "user_id", "marker", "id", 2)


@query("""WITH d AS (SELECT kind, CAST("at" AS DATE) AS day, count(*) % 2 AS marker FROM log GROUP BY kind, CAST("at" AS DATE)), c AS (SELECT *, coalesce(marker <> lag(marker) OVER (PARTITION BY kind ORDER BY day), false) AS changed FROM d), r AS (SELECT *, sum(CAST(changed AS INT)) OVER (PARTITION BY kind ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM c)
    SELECT kind, day, marker, row_number() OVER (PARTITION BY kind, run ORDER BY day) = 2 AND run > 0 AS settled FROM r""")
def st_quality_watch(t):
    """Days on which a check would run: the daily state has changed and been stable for two polls."""
    d = t.log.groupBy("kind", F.to_date("at").alias("day")).agg((F.count("*") % 2).alias("marker"))
    return le.settled(d, "kind", "marker", "day", 2)


@query("""SELECT "at", id, arg_max(value, ver) AS value FROM (SELECT "at", id, value, 1 AS ver FROM log UNION ALL SELECT "at", id, value + 1, 2 FROM log WHERE k % 7 = 0) GROUP BY "at", id""")
def st_hypertable(t):
    """Points written again replace those of the same time and id."""
    old = t.log.select("at", "id", "value", F.lit(1).alias("ver"))
    new = t.log.where("k % 7 = 0").select("at", "id", (F.col("value") + 1).alias("value"), F.lit(2).alias("ver"))
    return g.upsert(old, new, ["at", "id"], F.col("ver")).drop("ver")


@query("""WITH f AS (SELECT doc_id, source || '/' || (doc_id % 10) AS path, md5(text) AS hash FROM documents) SELECT doc_id, path, CASE WHEN row_number() OVER p = 1 THEN CASE WHEN row_number() OVER h > 1 THEN 'copy' ELSE 'new' END WHEN hash = lag(hash) OVER p THEN 'same' ELSE 'changed' END AS state FROM f WINDOW p AS (PARTITION BY path ORDER BY doc_id), h AS (PARTITION BY hash ORDER BY doc_id)""")
def st_folder_scan(t):
    """Files of a folder in the order in which they were seen: new, a copy of another, unchanged, or changed."""
    f = t["documents"].select("doc_id", F.concat_ws("/", "source", (F.col("doc_id") % 10).cast("string")).alias("path"), F.md5("text").alias("hash"))
    p, h = Window.partitionBy("path").orderBy("doc_id"), Window.partitionBy("hash").orderBy("doc_id")
    first = F.when(F.row_number().over(h) > 1, "copy").otherwise("new")
    state = F.when(F.row_number().over(p) == 1, first).when(F.col("hash") == F.lag("hash").over(p), "same").otherwise("changed")
    return f.select("doc_id", "path", state.alias("state"))


@query("""SELECT id, user_id, CASE WHEN row_number() OVER (PARTITION BY user_id, CAST("at" AS DATE) ORDER BY id) = 1 THEN 'running' ELSE 'busy' END AS state FROM log""")
def st_document_lock(t):
    """One running job of each key in a batch (a day); the others fail as busy."""
    n = F.row_number().over(Window.partitionBy("user_id", F.to_date("at")).orderBy("id"))
    return t.log.select("id", "user_id", F.when(n == 1, "running").otherwise("busy").alias("state"))


@query("""SELECT k, CAST("at" AS DATE) AS day, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY k ORDER BY CAST("at" AS DATE)) AS BIGINT) AS so_far FROM log WHERE kind IN ('view', 'click') GROUP BY k, CAST("at" AS DATE)""")
def st_search_count(t):
    d = t.log.where(F.col("kind").isin("view", "click")).groupBy("k", F.to_date("at").alias("day")).agg(F.count("*").alias("n"))
    return d.withColumn("so_far", F.sum("n").over(Window.partitionBy("k").orderBy("day")))


@query("""SELECT id, CASE WHEN k IS NULL THEN 'no key' WHEN k % 10 = 3 THEN 'document id differs' WHEN sha256(user_id || chr(10) || k) <> sha256(user_id || chr(10) || CASE WHEN k % 7 = 0 THEN k + 1 ELSE k END) THEN 'idempotency key differs' ELSE 'ok' END AS reason FROM log""")
def st_ingest_identity(t):
    """Keys recomputed from the metadata and held against the headers; the first that fails is the reason."""
    key = lambda k: F.sha2(F.concat_ws("\n", F.col("user_id").cast("string"), k.cast("string")), 256)
    k = F.col("k")
    header = key(F.when(k % 7 == 0, k + 1).otherwise(k))
    return t.log.select("id", F.when(k.isNull(), "no key").when(k % 10 == 3, "document id differs").when(key(k) != header, "idempotency key differs").otherwise("ok").alias("reason"))


@query("""SELECT l.id AS id, CASE WHEN l.user_id IS NULL THEN 'no user' WHEN l.value <= 0 THEN 'empty' WHEN l.kind = 'error' THEN 'not approved' WHEN r.route IS NULL THEN 'no route' ELSE 'ok' END AS reason, CASE WHEN l.user_id IS NOT NULL AND l.value > 0 AND l.kind <> 'error' THEN r.route END AS route FROM log l LEFT JOIN (VALUES ('view', 'vectors'), ('purchase', 'numbers'), ('click', 'graph')) r(kind, route) ON l.kind = r.kind""")
def st_metadata_rules(t):
    """Rules in order, then a fixed route for each kind; what has no route is refused."""
    routes = t.spark.createDataFrame([("view", "vectors"), ("purchase", "numbers"), ("click", "graph")], "kind string, route string")
    rows = t.log.join(F.broadcast(routes), "kind", "left")
    reason = F.when(F.col("user_id").isNull(), "no user").when(F.col("value") <= 0, "empty").when(F.col("kind") == "error", "not approved").when(F.col("route").isNull(), "no route").otherwise("ok")
    return rows.select("id", reason.alias("reason"), F.when(reason.isin("ok", "no route"), F.col("route")).alias("route"))


@query("SELECT d.doc_id AS doc_id, coalesce(o.publisher, d.publisher) AS publisher, o.revision AS revision FROM document d LEFT JOIN (SELECT k AS doc_id, arg_max('patched-' || kind, (id)) AS publisher, max(id) AS revision FROM log WHERE kind = 'click' GROUP BY k) o USING (doc_id)")
def st_change_apply(t):
    """The override with the highest revision of each document, laid over its metadata."""
    o = t.log.where("kind = 'click'").groupBy(F.col("k").alias("doc_id")).agg(F.max_by(F.concat(F.lit("patched-"), "kind"), "id").alias("new"), F.max("id").alias("revision"))
    return t.document.join(o, "doc_id", "left").select("doc_id", F.coalesce("new", "publisher").alias("publisher"), "revision")


@query("SELECT c.doc_id AS doc_id, c.idx AS idx, CASE WHEN l.user_id IS NULL THEN 'as it was' ELSE 'patched' END AS metadata FROM chunk c LEFT JOIN (SELECT DISTINCT k AS doc_id, 1 AS user_id FROM log WHERE kind = 'click') l USING (doc_id)")
def q_metadata_patch(t):
    """Metadata overrides merged into the chunks of their documents; texts stay as they are."""
    o = t.log.where("kind = 'click'").select(F.col("k").alias("doc_id")).distinct().withColumn("_p", F.lit(True))
    return t.chunk.join(o, "doc_id", "left").select("doc_id", "idx", F.when(F.col("_p"), "patched").otherwise("as it was").alias("metadata"))


@query("SELECT 'documents' AS store, count(*) AS n FROM documents WHERE source = 'src3' UNION ALL SELECT 'chunks', count(*) FROM chunk JOIN documents USING (doc_id) WHERE source = 'src3' UNION ALL SELECT 'vectors', count(*) FROM embeddings JOIN documents ON vec_id = doc_id WHERE source = 'src3'")
def q_deletion_plan(t):
    """What each store holds of the documents to delete."""
    ids = t["documents"].where("source = 'src3'").select("doc_id")
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
    return one(ids, "documents").unionAll(one(t.chunk.join(ids, "doc_id"), "chunks")).unionAll(one(t["embeddings"].join(ids, F.col("vec_id") == F.col("doc_id")), "vectors"))


@query("SELECT count(*) AS left_over, count(*) = 0 AS clean FROM chunk WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'src3') AND doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def st_delete_verify(t):
    """Deletes the documents of one source from the chunks, then asks for what is left of them."""
    ids = t["documents"].where("source = 'src3'").select("doc_id")
    left = t.chunk.join(ids, "doc_id", "left_anti").join(ids, "doc_id", "left_semi")
    return left.agg(F.count("*").alias("left_over")).withColumn("clean", F.col("left_over") == 0)


@query("SELECT doc_id, idx FROM chunk WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE source = 'src3')")
def snk_delete_by_doc(t):
    """The chunks that stay when the documents of one source are deleted."""
    return t.chunk.join(t["documents"].where("source = 'src3'").select("doc_id"), "doc_id", "left_anti").select("doc_id", "idx")


@query("SELECT id, CASE WHEN j.user_id IS NULL THEN 'unknown job' WHEN j.k <> l.k THEN 'key differs' WHEN NOT regexp_matches(md5(CAST(id AS VARCHAR)), '^[0-9a-f]{32}$') THEN 'bad hash' ELSE 'ok' END AS reason FROM log l LEFT JOIN (SELECT user_id, max(k) AS k FROM log WHERE kind = 'signup' GROUP BY user_id) j ON l.user_id = j.user_id WHERE l.kind = 'purchase'")
def st_correlation_check(t):
    """Responses held against the job that they answer."""
    jobs = t.log.where("kind = 'signup'").groupBy("user_id").agg(F.max("k").alias("job_k")).withColumn("_j", F.lit(True))
    rows = t.log.where("kind = 'purchase'").join(jobs, "user_id", "left")
    reason = F.when(F.col("_j").isNull(), "unknown job").when(F.col("job_k") != F.col("k"), "key differs").when(~F.md5(F.col("id").cast("string")).rlike("^[0-9a-f]{32}$"), "bad hash").otherwise("ok")
    return rows.select("id", reason.alias("reason"))


@query("""WITH s AS (SELECT user_id, min(k) % 24 AS hour, max(CAST("at" AS DATE)) AS last_run FROM log GROUP BY user_id) SELECT user_id, hour, last_run, 10 >= hour AND 10 < hour + 6 AND last_run < DATE '2024-01-30' AS due, CASE WHEN dayofweek(last_run) = 1 THEN 'weekly' ELSE 'daily' END AS level FROM s""")
def st_due_schedule(t):
    """At ten on a fixed day: due if the hour has come, isn't over by six, and nothing ran that day; a full check after a Monday."""
    s = t.log.groupBy("user_id").agg((F.min("k") % 24).alias("hour"), F.max(F.to_date("at")).alias("last_run"))
    due = (F.lit(10) >= F.col("hour")) & (F.lit(10) < F.col("hour") + 6) & (F.col("last_run") < F.lit("2024-01-30").cast("date"))
    return s.select("user_id", "hour", "last_run", due.alias("due"), F.when(F.dayofweek("last_run") == 2, "weekly").otherwise("daily").alias("level"))


@query("SELECT publisher, sha1(publisher || '|' || string_agg(doc_id, ',' ORDER BY doc_id)) AS signature FROM document WHERE current GROUP BY publisher")
def st_digest_cache_key(t):
    """Signature of each publisher's current documents: it changes with any of them."""
    d = t.document.where("current").groupBy("publisher").agg(F.array_sort(F.collect_list("doc_id")).alias("d"))
    return d.select("publisher", F.sha1(F.concat("publisher", F.lit("|"), F.array_join(F.transform("d", lambda v: v.cast("string")), ","))).alias("signature"))


@query("""WITH r AS (SELECT doc_id, family, CASE WHEN eligible THEN 'ready' ELSE 'draft' END AS status, doc_id % 3 = 0 AS is_current, current AS chosen FROM document) SELECT doc_id, family, CASE WHEN chosen AND status = 'ready' THEN 'published' WHEN bool_or(chosen AND status = 'ready') OVER (PARTITION BY family) AND is_current THEN 'superseded' ELSE status END AS new_status FROM r""")
def q_package_publish(t):
    r = t.document.select("doc_id", "family", F.when(F.col("eligible"), "ready").otherwise("draft").alias("status"), (F.col("doc_id") % 3 == 0).alias("is_current"), "current")
    return le.publish(r, "family", F.col("current")).select("doc_id", "family", "new_status")


@query("SELECT m.doc_id AS doc_id, CASE WHEN l.doc_id IS NULL THEN 'no metadata' WHEN l.quality = 0 THEN 'low quality' WHEN l.toxic = 1 THEN 'excluded' ELSE 'used' END AS reason FROM documents m LEFT JOIN labels l USING (doc_id)")
def join_manifest_metadata(t):
    """Documents with their stored results, and why one is left out."""
    both = t["documents"].select("doc_id").join(t["labels"].withColumn("_l", F.lit(True)), "doc_id", "left")
    return both.select("doc_id", F.when(F.col("_l").isNull(), "no metadata").when(F.col("quality") == 0, "low quality").when(F.col("toxic") == 1, "excluded").otherwise("used").alias("reason"))


@query("SELECT doc_id FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id) OR EXISTS (SELECT 1 FROM embeddings e WHERE e.vec_id = documents.doc_id) OR EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = documents.doc_id)")
def set_union_exists(t):
    """Documents that any of three tables knows."""
    known = t["labels"].select("doc_id").unionAll(t["embeddings"].select("vec_id")).unionAll(t["conversations"].select("conv_id"))
    return t["documents"].select("doc_id").join(known, "doc_id", "left_semi")


@query("""SELECT source, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source, md5(left(text, 40)) ORDER BY doc_id DESC) = 1""")
def q_reingest_plan(t):
    """The newest file of each name of a source."""
    name = F.md5(F.substring("text", 1, 40))
    return t["documents"].withColumn("_n", F.row_number().over(Window.partitionBy("source", name).orderBy(F.desc("doc_id")))).where("_n = 1").select("source", "doc_id")


@query("""SELECT doc_id, CASE WHEN contains(text, 'eau') THEN 'water' WHEN contains(text, 'sch') THEN 'ground' ELSE 'other' END AS category, CAST(CASE WHEN regexp_matches(text, '[0-9]') THEN least(0.5e0 + len(regexp_extract_all(text, '[0-9]+')) / 10.0e0, 1.0e0) ELSE 0.4e0 END AS DOUBLE) AS confidence FROM documents""")
def q_legacy_analyze(t):
    """A classification whose confidence stays under 0.4 without evidence in the text."""
    n = F.regexp_count("text", F.lit("[0-9]+"))
    category = F.when(F.contains("text", F.lit("eau")), "water").when(F.contains("text", F.lit("sch")), "ground").otherwise("other")
    return t["documents"].select("doc_id", category.alias("category"), F.when(n > 0, F.least(0.5 + n / 10, F.lit(1.0))).otherwise(0.4).alias("confidence"))


@query("""WITH h AS (SELECT p_partkey, p_brand, CAST(contains(lower(blob), 'red') AS INT) + CAST(contains(lower(blob), 'bolt') AS INT) + CAST(contains(lower(blob), 'economy') AS INT) AS hits FROM (SELECT *, p_name || ' ' || p_brand || ' ' || p_type AS blob FROM part)) SELECT p_brand, p_partkey, hits FROM h WHERE hits > 0 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY hits DESC, p_partkey) <= 5""")
def q_record_match(t):
    """The five records of each brand that hold most of the terms."""
    blob = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    hits = sum((F.contains(blob, F.lit(w)).cast("int") for w in ("red", "bolt", "economy")), F.lit(0))
    rows = t["part"].select("p_brand", "p_partkey", hits.alias("hits")).where("hits > 0")
    return rows.withColumn("_n", place(["p_brand"], F.desc("hits"), "p_partkey")).where("_n <= 5").drop("_n")


@query("""WITH a AS (SELECT lower(p_name) AS alias, p_brand AS id FROM part UNION ALL SELECT lower(p_type), p_brand FROM part) SELECT alias, count(DISTINCT id) AS ids, min(id) AS first_id FROM a GROUP BY alias HAVING count(DISTINCT id) > 1""")
def q_catalog_validate(t):
    """Aliases that stand for more than one identity."""
    a = t["part"].select("p_brand", F.explode(F.array(F.lower("p_name"), F.lower("p_type"))).alias("alias"))
    return a.groupBy("alias").agg(F.count_distinct("p_brand").alias("ids"), F.min("p_brand").alias("first_id")).where("ids > 1")


@query("""WITH m AS (SELECT lower(n_name) AS key, n_name AS name FROM nation), al AS (SELECT lower(replace(n_name, '_', ' ')) AS key, n_name AS name FROM nation), s AS (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN replace(n_name, '_', ' ') WHEN 2 THEN '' ELSE s_name END AS raw FROM supplier JOIN nation ON s_nationkey = n_nationkey)
    SELECT s_suppkey, CASE WHEN trim(raw) = '' THEN 'invalid' WHEN m.name IS NOT NULL OR al.name IS NOT NULL THEN 'canonical' ELSE 'unknown' END AS status, coalesce(m.name, al.name) AS name FROM s LEFT JOIN m ON lower(trim(raw)) = m.key LEFT JOIN al ON lower(trim(raw)) = al.key""")
def fn_normalize_value(t):
    """Values by master data, then by alias; blank ones are invalid, the rest unknown."""
    n = t["nation"]
    master = n.select(F.lower("n_name").alias("key"), F.col("n_name").alias("m"))
    alias = n.select(F.lower(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("key"), F.col("n_name").alias("a"))
    s = t["supplier"].join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey") % 4
    raw = F.when(k == 0, F.upper("n_name")).when(k == 1, F.replace("n_name", F.lit("_"), F.lit(" "))).when(k == 2, "").otherwise(F.col("s_name"))
    s = s.select("s_suppkey", F.lower(F.trim(raw)).alias("key")).join(F.broadcast(master), "key", "left").join(F.broadcast(alias), "key", "left")
    found = F.coalesce("m", "a")
    return s.select("s_suppkey", F.when(F.col("key") == "", "invalid").when(found.isNotNull(), "canonical").otherwise("unknown").alias("status"), found.alias("name"))


@query("""SELECT id, coalesce(nullif(trim(CASE WHEN k % 3 = 0 THEN '' ELSE kind END), ''), 'user-' || user_id) AS document, CASE WHEN kind = 'purchase' THEN 'TestReport' ELSE 'Attachment' END AS file_kind, kind <> 'purchase' OR (k % 2 = 0 AND value > 5) AS importable FROM log""")
def src_manifest(t):
    """Manifest entries: the first alias that isn't blank, and whether the entry may be imported (reports only approved and final)."""
    name = F.coalesce(F.nullif(F.trim(F.when(F.col("k") % 3 == 0, "").otherwise(F.col("kind"))), F.lit("")), F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    report = F.col("kind") == "purchase"
    return t.log.select("id", name.alias("document"), F.when(report, "TestReport").otherwise("Attachment").alias("file_kind"), (~report | ((F.col("k") % 2 == 0) & (F.col("value") > 5))).alias("importable"))


@query("SELECT user_id, k, count(*) AS n, count(*) FILTER (value > 10) AS finals FROM log WHERE kind = 'purchase' GROUP BY user_id, k HAVING count(*) > 1 OR count(*) FILTER (value > 10) > 1")
def q_manifest_duplicates(t):
    """Entries of one document and version that stand twice, or twice as final."""
    g_ = t.log.where("kind = 'purchase'").groupBy("user_id", "k").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 10).alias("finals"))
    return g_.where("n > 1 or finals > 1")


@query()
def st_circuit_breaker(t):
    """Calls of each user that an open circuit turns away: three failures open it for a day."""
    calls = t.log.select("id", "user_id", F.unix_seconds(F.col("at").cast("timestamp")).cast("double").alias("at"), (F.col("kind") == "error").alias("failed"))
    return od.circuit_breaker(calls, "user_id", limit=3, cooldown=86_400.0)


@query()
def st_rate_limit(t):
    """Calls granted to each user: at most three in a day; denied ones don't count."""
    calls = t.log.select("id", "user_id", F.unix_seconds(F.col("at").cast("timestamp")).cast("double").alias("at"))
    return od.rate_limit(calls, "user_id", most=3, seconds=86_400.0)
