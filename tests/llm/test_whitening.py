import numpy as np
import pytest

from shorewise.llm import whitening as W
from shorewise.llm.registry import QUERIES

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def by_hand(vectors, components=32):
    """x, and the whitened rows by an eigendecomposition of the covariance."""
    x = np.floor(np.array(vectors, np.float32).astype(float) * 64) + 1_000_000
    c = x - x.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / len(x))
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    with np.errstate(divide="ignore", invalid="ignore"):
        return x, c @ v / np.sqrt(e), e, c.var(axis=0).sum()


def same(rows, vectors):
    x, z, e, trace = by_hand([vectors[k] for k in sorted(vectors)])
    n, d = x.shape
    got = rows.sort_values(["vec_id", "component"])
    assert len(got) == n * min(32, d) and set(got["n"]) == {n}
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(np.abs(table), np.abs(z), atol=1e-8)
    one = got[got.component == 1].sort_values("vec_id")
    assert one["deviation"].tolist() == [sum(int(n * v - s) ** 2 for v, s in zip(r, x.sum(axis=0), strict=True)) for r in x]
    assert np.allclose(got[got.vec_id == min(vectors)]["explained"], e / trace, rtol=1e-9)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9


def test_the_table(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    out = QUERIES["op11_jacobi_whitening"](spark, sf_dir)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same(out.toPandas(), {r.vec_id: r.embedding for r in rows})


def test_many_partitions_merge_in_a_tree(spark):
    rng = np.random.default_rng(3)
    vectors = {k: (rng.normal(size=5) * [9, 3, 2, 1, 0.5]).astype(np.float32).tolist() for k in range(400)}
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in vectors.items()], SCHEMA).repartition(40)
    assert df.rdd.getNumPartitions() > W.FAN
    same(W.whiten(df, "embedding", ["vec_id"]).toPandas(), vectors)


def test_odd_rows(spark):
    """Null, broken and other vectors go; repeated rows, null ids and columns of clashing names don't matter."""
    rng = np.random.default_rng(5)
    good = [rng.normal(size=3).tolist() for _ in range(30)]
    rows = [(k, v) for k, v in enumerate(good)] + [(0, good[0]), (None, good[1])]
    bad = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [1.0, float("nan"), 2.0]), (94, [float("inf"), 0.0, 0.0]), (95, [1.0, 2.0])]
    df = spark.createDataFrame([(k, v, "x", "y") for k, v in rows + bad], SCHEMA)
    out = W.whiten(df, "embedding", ["vec_id"]).toPandas()
    assert len(out) == 32 * 3 and set(out["n"]) == {32} and out["vec_id"].isna().sum() == 3 and (out["vec_id"] == 0).sum() == 6
    _, z, _, _ = by_hand([v for _, v in rows])
    assert np.allclose(np.sort(np.abs(out[out.component == 1]["whitened"])), np.sort(np.abs(z[:, 0])))


def test_components_without_variance(spark):
    df = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0], "", "") for k in range(20)], SCHEMA)
    out = W.whiten(df, "embedding", ["vec_id"]).toPandas()
    assert out[out.component == 1]["whitened"].notna().all() and out[out.component > 1]["whitened"].isna().all()
    assert out["identity_error"].max() < 1e-9 and abs(out[out.component == 1]["explained"].iloc[0] - 1) < 1e-12
    one = W.whiten(df.limit(1), "embedding", ["vec_id"]).toPandas()
    assert one["whitened"].isna().all() and set(one["explained"]) == {0.0} and set(one["deviation"]) == {0}


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert W.whiten(empty, "embedding", ["vec_id"]).count() == 0
    assert W.whiten(spark.createDataFrame([(1, None, "", "")], SCHEMA), "embedding", ["vec_id"]).count() == 0


def test_deviation_beyond_machine_words():
    model = W.Whitening(10**9, [10**9 * 7 + 3], np.ones(1), np.ones((1, 1)), 1.0)
    whole = np.array([[0], [5], [2**35]])
    assert W.deviations(model, whole) == [9, (10**9 * 5 - 3) ** 2 if (10**9 * 5 - 3) ** 2 < 2**63 else None, None]


@pytest.mark.parametrize("d", [1, 2, 7, 24])
def test_jacobi(d):
    rng = np.random.default_rng(d)
    r = np.triu(rng.normal(size=(d, d))) * 10.0 ** -np.arange(d)[:, None]
    lengths, v = W.jacobi(r)
    assert np.allclose(np.sqrt(lengths), np.linalg.svd(r, compute_uv=False), rtol=1e-8)
    assert np.allclose(v @ v.T, np.eye(d), atol=1e-12)
    assert np.allclose(v.T @ np.diag(lengths) @ v, r.T @ r, atol=1e-12)
