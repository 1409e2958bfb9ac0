"""Ledgers of jobs, changes, deletions and callbacks as rules over event tables; each also fits one micro-batch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.common import place


def submissions(events: DataFrame, key: Sequence[str], body: str, order: str) -> DataFrame:
    """State of each submission: the first of a key is accepted; later ones repeat it, or conflict if their body differs."""
    w = Window.partitionBy(*key).orderBy(order)
    first = F.first(body).over(w.rowsBetween(Window.unboundedPreceding, 0))
    nth = F.row_number().over(w)
    return events.withColumn("state", F.when(nth == 1, "accepted").when(F.col(body).eqNullSafe(first), "repeated").otherwise("conflict"))


def without_deleted(events: DataFrame, tombstones: DataFrame, key: str, order: str) -> DataFrame:
    """Events with ``refused`` where their key was deleted before (tombstones: key, deleted)."""
    dead = tombstones.groupBy(key).agg(F.min("deleted").alias("deleted"))
    return events.join(dead, key, "left").withColumn("refused", F.coalesce(F.col(order) > F.col("deleted"), F.lit(False))).drop("deleted")


def stale(changes: DataFrame, key: Sequence[str], revision: str, order: str) -> DataFrame:
    """Changes with ``stale`` where an earlier one of their key had the same or a later revision."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return changes.withColumn("stale", F.coalesce(F.col(revision) <= F.max(revision).over(w), F.lit(False)))


def next_in_order(rows: DataFrame, key: Sequence[str], order: str, finished: Column) -> DataFrame:
    """The first unfinished row of each key: all later ones have to wait for it."""
    return rows.where(~finished).withColumn("_n", place(list(key), order)).where("_n = 1").drop("_n")


def retry(jobs: DataFrame, delays: Sequence[int]) -> DataFrame:
    """The state after another failure, and the delay in seconds until the next attempt."""
    n = F.col("attempts")
    out = jobs.withColumn("state", F.when(n > len(delays), "Failed").otherwise("Waiting"))
    return out.withColumn("delay", F.try_element_at(F.array(*map(F.lit, delays)), F.when(n <= len(delays), n.cast("int"))))


def snapshot_changes(old: DataFrame, new: DataFrame, key: str, version: str) -> DataFrame:
    """added, replaced, removed or unchanged for each key of two snapshots."""
    o, n = old.select(key, F.col(version).alias("before")), new.select(key, F.col(version).alias("after"))
    both = o.withColumn("_o", F.lit(1)).join(n.withColumn("_n", F.lit(1)), key, "full")
    kind = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("replaced")
    return both.select(key, "before", "after", kind.alias("change"))


def settled(polls: DataFrame, key: str, marker: str, order: str, times: int) -> DataFrame:
    """Polls at which the marker has been the same ``times`` times running, having changed before; the first state stays silent."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.coalesce(F.col(marker) != F.lag(marker).over(w), F.lit(False))
    run = F.sum(changed.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = polls.withColumn("_run", run)
    nth = F.row_number().over(Window.partitionBy(key, "_run").orderBy(order))
    return rows.withColumn("settled", (nth == times) & (F.col("_run") > 0)).drop("_run")


def manifests(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Outcome of manifests(key, revision, hash) in order: stored, stale, or conflict for another hash of a stored revision; and the version of the analysis."""
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    high = F.max("revision").over(before)
    own = Window.partitionBy(key, "revision").orderBy(order)
    first = F.first("hash").over(own.rowsBetween(Window.unboundedPreceding, 0))
    state = (
        F.when(high.isNull() | (F.col("revision") > high), "stored").when(F.col("revision") < high, "stale").when(F.col("hash") == first, "same").otherwise("conflict")
    )
    out = rows.withColumn("state", state)
    return out.withColumn("analysis_version", F.count_if(F.col("state") == "stored").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def retired(versions: DataFrame, key: str, version: str, completed: Column) -> DataFrame:
    """Active, superseded or pending: an old version is retired only when a later one has completed."""
    last = F.max(F.when(completed, F.col(version))).over(Window.partitionBy(key))
    return versions.withColumn("index_state", F.when(F.col(version) == last, "Active").when(F.col(version) < last, "Superseded").otherwise("Pending"))


def publish(revisions: DataFrame, key: str, chosen: Column) -> DataFrame:
    """Publish the chosen ready revision of each document; only revisions flagged current are superseded by it."""
    any_ = F.max((chosen & (F.col("status") == "ready")).cast("int")).over(Window.partitionBy(key)) == 1
    new = F.when(chosen & (F.col("status") == "ready"), "published").when(any_ & F.col("is_current"), "superseded").otherwise(F.col("status"))
    return revisions.withColumn("new_status", new)
