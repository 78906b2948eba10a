import numpy as np
import pytest

from timberline.llm import whitening
from timberline.llm.queries import op11_whitening

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, n int, deviation string"


def _expected(vectors: list[list[float]]):
    """Integers, covariance and eigenvectors in double precision, rows kept whole in memory."""
    x = np.floor(64 * np.array(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    centred = x - x.mean(0)
    values, turn = np.linalg.eigh(centred.T @ centred / len(x))
    return x, values[::-1], turn[:, ::-1], centred


@pytest.mark.parametrize("kind", ["spread", "clusters", "equal", "no rank"])
def test_corrected_eigenvectors(kind):
    rng, d = np.random.default_rng(4), 48
    values = {"spread": np.linspace(1, 90, d), "clusters": np.repeat([3.0, 40.0, 41.0], 16) + np.tile(np.arange(16) * 1e-8, 3),
              "equal": np.repeat([1.0, 2.0, 5.0], 16), "no rank": np.concatenate([np.zeros(24), np.linspace(1, 2, 24)])}[kind]
    turn = np.linalg.qr(rng.normal(size=(d, d)))[0].astype(np.longdouble)
    for _ in range(4):
        turn = turn @ (1.5 * np.eye(d) - 0.5 * turn.T @ turn)
    a = (turn * values) @ turn.T
    a = (a + a.T) / 2
    found, x = whitening.corrected(a, np.linalg.eigh(a.astype(np.float32))[1])
    order = np.argsort(-values)
    assert np.abs(found - values[order]).max() < 1e-14
    assert np.abs(x.T @ x - np.eye(d)).max() < 1e-15
    assert np.abs(a @ x - x * found).max() < 1e-14
    if kind in ("spread", "clusters"):
        assert np.abs(np.abs((turn[:, order] * x).sum(0)) - 1).max() < 1e-14


def test_whole_table_against_numpy(spark):
    rows = op11_whitening(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x, values, turn, centred = _expected([r["embedding"] for r in table])
    n, sums = len(x), x.sum(0)
    assert len(rows) == n * 32 and {r["component"] for r in rows} == set(range(1, 33)) and {r["n"] for r in rows} == {n}
    at = {r["vec_id"]: k for k, r in enumerate(table)}
    got = np.full((n, 32), np.nan)
    for r in rows:
        got[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
        assert r["deviation"] == int(((n * x[at[r["vec_id"]]] - sums) ** 2).sum())
        assert abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-12
    want = centred @ turn[:, :32] / np.sqrt(values[:32])
    want *= np.sign((want * got).sum(0))
    assert np.abs(got - want).max() < 1e-9
    assert np.abs(got.T @ got / n - np.eye(32)).max() < 1e-10
    (error,) = {r["identity_error"] for r in rows}
    assert error < 1e-10


def test_nulls_lengths_ties_and_clashing_columns(spark):
    good = [[0.5, 1.0, -2.0], [0.25, 3.0, 1.0], [0.0, 0.5, 0.0], [1.5, -1.0, 2.0], [1.5, -1.0, 2.0]]
    odd = [None, [], [1.0, None, 2.0], [float("nan"), 0.0, 0.0], [float("inf"), 0.0, 0.0], [1e30, 0.0, 0.0], [1.0], [1.0, 2.0, 3.0, 4.0]]
    rows = [(k, v, 1, 7, "x") for k, v in enumerate(good)] + [(None, good[0], None, 7, "x")] + [(100 + k, v, 1, 7, "x") for k, v in enumerate(odd)]
    found = whitening.whiten(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    x, values, _, _ = _expected([*good, good[0]])
    assert {r["id"] for r in found} == {0, 1, 2, 3, 4, None} and len(found) == 18
    assert {r["n"] for r in found} == {6}
    assert {r["deviation"] for r in found if r["id"] == 3} == {r["deviation"] for r in found if r["id"] == 4}
    assert {r["deviation"] for r in found if r["id"] == 1} == {int(((6 * x[1] - x.sum(0)) ** 2).sum())}
    share = {r["component"]: r["explained"] for r in found}
    assert np.allclose([share[k] for k in (1, 2, 3)], values / values.sum(), atol=1e-14)


def test_without_variance_and_without_rows(spark):
    same = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = whitening.whiten(same).collect()
    assert len(rows) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in rows)
    assert {r["deviation"] for r in rows} == {0}
    line = spark.createDataFrame([(k, [float(k), 2.0 * k]) for k in range(9)], "vec_id long, embedding array<float>")
    rows = whitening.whiten(line).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in rows)
    empty = whitening.whiten(same.filter("vec_id > 5"))
    assert empty.collect() == [] and empty.columns == whitening.whiten(same).columns


def test_exact_products_and_long_overflow(spark):
    y = np.array([[1 << 39, -(1 << 38) + 1], [3, -(1 << 39) + 7]], dtype=np.int64)
    assert whitening.exact_products(y).tolist() == (y.astype(object).T @ y.astype(object)).tolist()
    far = spark.createDataFrame([(1, [1e10]), (2, [-1e10]), (3, [0.0])], "vec_id long, embedding array<double>")
    assert {r["id"]: r["deviation"] for r in whitening.whiten(far).collect()} == {1: None, 2: None, 3: 0}
