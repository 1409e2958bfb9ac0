import zlib

import numpy as np
import pytest

from loomwork.llm.queries import queries
from tests.llm.fixtures import documents
from tests.llm.test_near_copies import shingles
from tests.llm.test_secrets import plain as plain_secrets
from tests.llm.test_simhash import plain_components
from tests.llm.test_tokens import PLAIN_WORD

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_against_plain_code(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        rows = {r["doc_id"]: r.asDict() for r in docs.collect()}
        if name == "packing":
            by_doc = {}
            for r in after.collect():
                by_doc.setdefault(r["doc_id"], []).append(r)
            assert set(by_doc) == set(rows)
            for k, own in by_doc.items():
                ids, at = [*PLAIN_WORD(rows[k]["text"]), 1], 0
                for r in sorted(own, key=lambda r: r["start"]):
                    assert r["start"] == at and zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
                    at += r["length"]
                assert at == len(ids)
            break
        assert after.columns == docs.columns
        kept = {r["doc_id"]: r.asDict() for r in after.collect()}
        held.append((name, set(rows) - set(kept)))
        if name == "language_id":
            assert all(any(c.isalpha() for c in kept[k]["text"] or "") for k in kept)
        if name == "simhash_dedup":
            sets = {k: shingles(r["text"]) for k, r in rows.items()}  # five words, 0.8 or more, as stages on word shingles take
            near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
            comp = plain_components(list(sets), near)
            assert set(kept) == {k for k in sets if comp[k] == k}
        if name == "decontamination":
            items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(i in r["text"] for r in kept.values() for i in items)
        if name == "secret_scan":
            assert set(kept) == set(rows) and not any(plain_secrets(r["text"].replace("[SECRET]", "\n")) for r in kept.values())
            assert all(kept[k]["text"] == r["text"] for k, r in rows.items() if not plain_secrets(r["text"]) and "gh" not in r["text"] and "xox" not in r["text"] and "-----" not in r["text"] and "eyJ" not in r["text"] and "AIza" not in r["text"])
        else:
            assert all(kept[k] == rows[k] for k in kept)
        docs = spark.createDataFrame([tuple(r) for r in after.collect()], after.schema)


def test_every_query_gives_a_row_for_each_document(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    found = queries()
    assert len(found) == 13
    for name in ("op2_pii_spans", "op3_language_id", "op6_feistel_sharding", "op8_simhash_dedup", "op9_orc_tokens", "op10_secret_scan", "op11_group_alignment", "op12_source_mix"):
        assert found[name](spark, SF).count() == n, name
    assert found["op4_embedding_near_dedup"](spark, SF).count() == spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert found["op7_harmonic_packing"](spark, SF).select("doc_id").distinct().count() == n
    assert found["op1_license_scan"](spark, SF).count() > 0 and found["op5_decontamination"](spark, SF).count() > 0
    items = spark.read.parquet(f"{SF}/benchmark.parquet").count()
    assert 0 < found["op13_ranked_search"](spark, SF).select("item_id").distinct().count() <= items


def test_no_rows_nulls_and_very_long_texts_pass_all_stages(spark):
    long = "lead one two three " * 30_000
    for texts in ([], [(None, None)] * 3 + [(1, None), (2, ""), (3, " ")], [(k, f"{long} {k}") for k in range(2)] + [(7, "x" * 300_000), (8, "The text of a document stands here and ends.")] * 2):
        docs = documents(spark, texts)
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, SF)
            rows = after.collect()
            if name != "packing":
                assert after.columns == docs.columns
                docs = spark.createDataFrame([tuple(r) for r in rows], docs.schema)
        assert (not texts and not rows) or {r["doc_id"] for r in rows} <= {k for k, _ in texts}
    assert len(rows) and docs.where("doc_id = 8").count() == 1
