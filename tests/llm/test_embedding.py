import numpy as np

from loomwork.llm.embedding_dedup import near_vectors
from tests.llm.test_simhash import plain_components


def brute(rows, cosine=0.9):
    ok = {i: np.array(v, np.float32).astype(float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    ids = sorted(ok)
    near = [(a, b) for a in ids for b in ids if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= cosine]
    comp = plain_components([i for i, _ in rows], near)
    return {i: (sum(i in p for p in near), comp[i], comp[i] == i) for i, _ in rows}


def made(seed=1, centres=30, each=12, dims=32):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((centres, dims))
    rows = [c + rng.standard_normal(dims) * rng.uniform(0.05, 0.6) for c in base for _ in range(each)]
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def test_small_tables_equal_brute_force(spark):
    rows = made()
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1002, None), (1003, []), (1004, [0.0] * 32), (1005, [float("nan")] + [1.0] * 31), (1006, [None] + [1.0] * 31), (1007, [1e30] * 32), (1008, [1e-30] * 32), (1009, [1.0, 2.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    assert got == brute(rows)


def test_many_leaves_and_tiles_keep_the_links(spark):
    rows = made(2, centres=60, each=15, dims=48)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = brute(rows)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df, leaf=24, tile=16).collect()}
    found, all_ = sum(got.values()), sum(w[0] for w in want.values())
    assert all(got[i] <= want[i][0] for i in want)
    assert found / all_ >= 0.98


def test_large_leaves_are_split_again(spark):
    rows = made(3, centres=100, each=12, dims=48)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    want = brute(rows)
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df, leaf=64, sample_rows=300, fit_rows=200).collect()}
    assert all(got[i] <= want[i][0] for i in want) and sum(got.values()) >= 0.97 * sum(w[0] for w in want.values())


def test_empty_and_unnamed(spark):
    schema = "vec_id bigint, embedding array<float>, label int, id bigint"
    assert near_vectors(spark.createDataFrame([], schema)).count() == 0
    got = near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1, 7), (5, [1.0, 0.0], 1, 7), (5, [1.0, 0.0], 1, 7)], schema)).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["5", "5", "None"] and all(r["n_links"] == 2 and r["component_id"] == 5 for r in got)


def test_classes_without_ids_join_and_doubles_stay_doubles(spark):
    rng = np.random.default_rng(6)
    a = rng.standard_normal(16)
    b = np.cos(0.4) * a / np.linalg.norm(a)
    side = rng.standard_normal(16)
    side -= (side @ a) * a / (a @ a)
    mid, far = b + np.sin(0.4) * side / np.linalg.norm(side), np.cos(0.8) * a / np.linalg.norm(a) + np.sin(0.8) * side / np.linalg.norm(side)
    rows = [(7, a.tolist()), (None, (mid * 1e200).tolist()), (3, (far * 1e-200).tolist()), (9, side.tolist()), (None, (-side).tolist()), (None, (-side * 3).tolist())]
    got = near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in got), key=str) == sorted([(7, 1, 3), (None, 2, 3), (3, 1, 3), (9, 0, 9), (None, 1, None), (None, 1, None)], key=str)


def test_recall_at_defaults_over_many_leaves(spark):
    """50,000 planted vectors: more leaves than one, a sample that is a part of them, leaves that are split again."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((5000, 64))
    rows = np.repeat(centres, 10, axis=0) + rng.standard_normal((50_000, 64)) * np.repeat(rng.uniform(0.05, 0.5, 5000), 10)[:, None]
    unit = rows.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = np.concatenate([(unit[i : i + 2000] @ unit.T >= 0.9).sum(1) - 1 for i in range(0, 50_000, 2000)])
    import pyarrow as pa

    table = pa.table({"vec_id": np.arange(50_000), "embedding": pa.ListArray.from_arrays(np.arange(0, 50_001 * 64, 64, dtype=np.int32), rows.astype(np.float32).ravel())})
    got = near_vectors(spark.createDataFrame(table).repartition(8)).toPandas().set_index("vec_id").loc[np.arange(50_000)]["n_links"].to_numpy()
    assert (got <= want).all() and got.sum() >= 0.9 * want.sum(), got.sum() / want.sum()
    print("recall", got.sum() / want.sum())
