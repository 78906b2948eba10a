import numpy as np
import pytest

from timberline.llm import vectors as V
from timberline.llm.queries import op5_columns

SCHEMA = "vec_id long, embedding array<float>, label int, node long, sort_key string"


def corpus():
    rnd = np.random.default_rng(5)
    rows, n = [], 0
    for label in (0, 1, 2):
        for _ in range(60):
            base = rnd.standard_normal(24)
            for _ in range(4):
                rows.append((n, (base + rnd.standard_normal(24) * 0.09).astype(np.float32).tolist(), label, 1, "k"))
                n += 1
    rows += [(n + k, rows[0][1], 0, 1, "k") for k in range(30)]  # copies, more than the small window below
    rows += [(1000, None, 0, 1, "k"), (1001, [0.0] * 24, 0, 1, "k"), (1002, [], 1, 1, "k"), (1003, [1.0, None], 1, 1, "k"),
             (1004, [float("nan")] * 24, 1, 1, "k"), (1005, [float("inf")] * 24, 1, 1, "k"), (1006, rows[0][1], None, 1, "k"),
             (None, rows[4][1], 0, 1, "k"), (7, rows[7][1], 0, 1, "k"), (1007, [-0.0, 1.0], 2, 1, "k"), (1008, [0.0, 2.0, 0.0], 2, 1, "k")]
    return rows


def brute(rows):
    valid = [r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    width = 24
    x = np.array([(list(r[1]) + [0.0] * width)[:width] if v else [0.0] * width for r, v in zip(rows, valid, strict=True)])
    norm = np.linalg.norm(x, axis=1)
    norm[norm == 0] = 1
    cos = (x / norm[:, None]) @ (x / norm[:, None]).T
    linked = cos >= 0.98
    for k, r in enumerate(rows):
        for j, s in enumerate(rows):
            linked[k, j] &= k != j and bool(valid[k] and valid[j]) and r[2] == s[2]
    return linked


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(corpus(), SCHEMA)


def test_links_equal_brute_force(spark, frame, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 50)
    rows, linked = corpus(), brute(corpus())
    got = sorted((r.id is None, r.id or 0, r.n_links, -1 if r.component_id is None else r.component_id)
                 for r in V.near_vectors(frame, window=12).collect())
    parent = list(range(len(rows)))
    for k, j in zip(*np.nonzero(linked), strict=True):
        a, b = k, j
        while parent[a] != a:
            a = parent[a]
        while parent[b] != b:
            b = parent[b]
        parent[a] = b
    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[root(k)] = min(least.get(root(k), r[0]), r[0])
    want = sorted((r[0] is None, r[0] or 0, int(linked[k].sum()), least.get(root(k), -1)) for k, r in enumerate(rows))
    assert got == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in op5_columns(V.near_vectors(frame, window=12)).collect())


def test_empty_table(spark, frame):
    assert V.near_vectors(frame.limit(0)).count() == 0


def test_recall_on_the_embeddings_table(spark):
    """Measured against all pairs of a label; the operator promises 0.9."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = {r.id: r.n_links for r in V.near_vectors(table).collect()}
    rows = [tuple(r)[:3] for r in table.select("vec_id", "embedding", "label").collect()]
    found = sum(got.values())
    want = 0
    for label in {r[2] for r in rows} - {None}:
        x = np.array([r[1] for r in rows if r[2] == label], float)
        x /= np.linalg.norm(x, axis=1)[:, None]
        want += int((x @ x.T >= 0.98).sum()) - len(x)
    assert 0.9 * want <= found <= want + 2
