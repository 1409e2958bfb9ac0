"""The view of documents: topics of odd texts, and graph queries over them beside their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry
from loomwork.operators import graphs as g
from loomwork.plans.views import Tables

TEXTS = ["the cat, the mat and a hat sat", "", "123 456", "頻寬", "the", None, "One  Two\nthree_four5five six SEVEN", "...", "a" * 9, "99 bottles", "Élan vital", "the end"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents without a Latin word stand at ids that graph queries ask for, twice in one zone."""
    top = tmp_path_factory.mktemp("odd")
    rows = [(i, TEXTS[i % len(TEXTS)], "en", f"src{i % 2}", 1) for i in range(260)] + [(300, "", "en", "src0", 0), (310, "7", "fr", "src0", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 260, 3)], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{top}/labels.parquet")
    return str(top)


@pytest.mark.parametrize("name", ["graph_detach_delete", "graph_orphan_prune", "graph_stats", "join_zone_entity", "q_contribution", "graph_related_docs", "graph_version_closure", "topk_rank_boosts"])
def test_query_equals_its_sql_on_odd_documents(spark, folder, name):
    duck = duckdb.connect()
    for t in ("documents", "labels"):
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df, sql = entry.queries()[name](spark, folder), duck.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    at = [sql.columns.index(c) for c in order]
    got = sorted(repr(tuple(row[c] for c in order)) for row in df.collect())
    assert got == sorted(repr(tuple(row[i] for i in at)) for row in sql.fetchall())


def test_texts_stay_out_of_the_join_with_labels(spark, folder):
    """Before, whole texts were shuffled for their first words."""
    plan = Tables(spark, folder).document.select("doc_id", "title", "topics", "eligible")._jdf.queryExecution().optimizedPlan().toString()
    assert "AS title" in plan[plan.index("Join LeftOuter") :]


def test_only_the_others_asked_for_are_met(spark):
    edges = spark.createDataFrame([(i, "hot") for i in range(50)] + [(1, "x"), (7, "x")], "d long, t string")
    asked, others = spark.createDataFrame([(1,), (2,)], "d long"), spark.createDataFrame([(7,), (2,)], "d long")
    got = {tuple(row) for row in g.shared_neighbours(edges, asked, "d", "t", others).collect()}
    assert got == {(1, 7, 2), (1, 2, 1), (2, 7, 1)}


def test_rounds_of_components_keep_estimates_small(spark):
    """Before, the estimate of a round was multiplied into the next: a number of ever more digits."""
    chain = spark.range(600).selectExpr("id AS a", "id + 1 AS b")
    plan = g.components(chain)._jdf.queryExecution().optimizedPlan()
    assert len(str(plan.stats().sizeInBytes())) < 30
