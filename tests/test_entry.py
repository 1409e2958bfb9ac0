import datetime
import math
import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))
SF = "/root/testdata/sf0.001"
SOME = (
    "agg_measurement_stats", "agg_catalog", "agg_noise_mad", "join_align_runs", "agg_run_compare", "join_result_verdict", "q_findings", "topk_vector", "q_hybrid_search", "q_find_documents", "agg_eval_summary",
    "fn_tokens", "join_entity_pairs", "fn_markdown_sections", "fn_clean_markup", "agg_zone_overview", "agg_trust", "q_grounding", "graph_related_docs", "graph_version_closure", "rel_union_find", "st_stale_manifest",
    "st_settle_change", "st_digest_window", "st_tumbling_window", "st_session_window", "src_jsonl_package", "src_log_lines", "q_report_wide_to_long", "snk_vectors",
)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def told(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    return v.isoformat() if isinstance(v, datetime.date) else repr(v)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, duck, name):
    df, sql = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    order = sorted(df.columns)
    got = sorted(tuple(told(r[c]) for c in order) for r in df.collect())
    at = [sql.columns.index(c) for c in order]
    assert got == sorted(tuple(told(r[i]) for i in at) for r in sql.fetchall())


def test_registered_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 250


def test_flagship(spark):
    assert entry.entry(spark).columns[:3] == ["product_id", "metric", "unit"]


def test_the_rest_works_without_the_training_data_package(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 250 and not any(k.startswith('op') for k in q) and 'pipeline' not in q; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, timeout=120, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
