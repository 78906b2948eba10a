"""Whitening of vectors by components of their covariance, corrected to double precision.

Entries become integers ``floor(scale * c) + offset``, so counts, sums and products are
exact whatever the order in which tasks finish. The covariance is summed over all rows,
centred at the rounded means before multiplying; the rest of the mean is taken off exactly.
Its eigenvectors are found in float32 and corrected in extended precision by the
iteration of Ogita and Aishima, which needs products of matrices only. Eigenvalues closer than
the iteration can tell apart form clusters; each is solved again inside its own subspace, shifted by
its mean, and the iteration goes on.

Only matrices of the vectors' width reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.session import cut

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 32
#: Scaled entries from here on count as not finite: sums of a batch must fit 64 bits.
LARGEST = float(1 << 40)
WIDE = np.longdouble


@dataclass(frozen=True)
class Whitening:
    """The fit: rows, width, sums of the integers, rounded means, eigenvalues (falling), unit eigenvectors as columns."""

    n: int
    width: int
    sums: tuple[int, ...]
    centre: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def rest(self) -> np.ndarray:
        """Exact mean less ``centre``, within half a unit."""
        return np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, self.centre, strict=True)])

    def kept(self, components: int) -> np.ndarray:
        """Which of the first ``components`` have a variance above rounding."""
        first = self.values[:components]
        return first > self.width * 2.0**-50 * max(float(self.values.max(initial=0.0)), 0.0)


# --- eigenvectors -----------------------------------------------------------------------------------------------


def corrected(a: np.ndarray, x: np.ndarray, rounds: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors of the symmetric ``a``, from approximate vectors ``x``."""
    a, x = a.astype(WIDE), x.astype(WIDE)
    d = len(a)
    size, one, last = _norm(a), np.eye(d, dtype=WIDE), np.inf
    for _ in range(rounds):
        miss = one - x.T @ x
        s = x.T @ (a @ x)
        s = (s + s.T) / 2
        values = np.diag(s) / (1 - np.diag(miss))
        delta = 2 * (_norm(s - np.diag(values)) + size * _norm(miss))
        gap = values[None, :] - values[:, None]
        near = np.abs(gap) <= delta
        # Half of what is missing to orthonormal columns, and a turn that is antisymmetric to the last bit.
        turn = np.where(near, 0, (s + (values[None, :] + values[:, None]) / 2 * miss) / np.where(near, 1, gap))
        step = miss / 2 + turn
        x = x + x @ step
        turned = _solve_clusters(a, x, values, delta, size)
        moved = float(np.abs(step).max(initial=0))
        # Rounding over the least gap is a floor that no round gets below.
        if not turned and (moved <= 2.0**-60 or (moved <= 2.0**-20 and moved >= last / 2)):
            break
        last = moved
    for _ in range(3):
        x = x + x @ ((one - x.T @ x) / 2)
    values = np.diag(x.T @ (a @ x))
    order = np.argsort(-values, kind="stable")
    values, x = values[order], x[:, order]
    # A defined sign: the entry of largest size is positive.
    sign = np.where(x[np.abs(x).argmax(0), np.arange(d)] < 0, -1, 1)
    return values, x * sign


def _norm(m: np.ndarray) -> float:
    return np.sqrt((m * m).sum())


def _solve_clusters(a: np.ndarray, x: np.ndarray, values: np.ndarray, delta: float, size: float) -> bool:
    """Turn the columns of ``x`` inside each cluster of eigenvalues onto its own eigenvectors, in place.

    A cluster whose part of the matrix is diagonal but for rounding stays: any basis of equal eigenvalues is one.
    """
    order, turned = np.argsort(-values, kind="stable"), False
    cuts = np.flatnonzero(-np.diff(values[order]) > delta) + 1
    for members in np.split(order, cuts):
        if len(members) < 2:
            continue
        basis = x[:, members]
        inner = basis.T @ (a @ basis)
        inner = (inner + inner.T) / 2 - np.eye(len(members), dtype=WIDE) * np.diag(inner).mean()
        if np.abs(inner - np.diag(np.diag(inner))).max() > 2.0**-58 * size:
            _, turn = np.linalg.eigh((inner / np.abs(inner).max()).astype(np.float64))
            x[:, members] = basis @ turn.astype(WIDE)
            turned = True
    return turned


def principal(products: np.ndarray, sums: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues, eigenvectors and trace of the covariance, from exact integer products and sums of centred rows."""
    exact = n * products - np.outer(sums, sums)  # n * n * covariance
    v = np.array([[_wide(int(e), n * n) for e in row] for row in exact], dtype=WIDE).reshape(exact.shape)
    top = float(np.abs(v).max(initial=0))
    if top == 0:
        return np.zeros(len(v)), np.eye(len(v)), 0.0
    _, start = np.linalg.eigh((v / WIDE(top)).astype(np.float32))
    values, vectors = corrected(v, start)
    return values.astype(np.float64), vectors.astype(np.float64), float(np.trace(v))


def _wide(top: int, bottom: int) -> np.longdouble:
    """A quotient of integers with all bits that the wide type holds."""
    q = (abs(top) << 128) // bottom
    spare = max(q.bit_length() - 128, 0)
    q >>= spare
    parts = sum(WIDE(float((q >> s) & 0xFFFFFFFF)) * WIDE(2) ** s for s in (96, 64, 32, 0))
    return (-parts if top < 0 else parts) * WIDE(2) ** (spare - 128)


# --- rows -------------------------------------------------------------------------------------------------------


def integers(column: pa.Array, width: int | None = None, scale: int = SCALE) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Length of each usable vector (-1 for others), and by length the matrix ``floor(scale * c)`` of its rows."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.list_flatten(column).cast(pa.float64()).to_numpy(zero_copy_only=False) * scale
    good = np.isfinite(flat) & (np.abs(flat) < LARGEST)
    ends = np.cumsum(size)
    bad = np.concatenate([[0], np.cumsum(~good)])
    length = np.where((size > 0) & (bad[ends] == bad[ends - size]), size, -1)
    out = {}
    for w in np.unique(length).tolist() if width is None else [width]:
        rows = np.flatnonzero(length == w)
        if w > 0:
            at = (ends - size)[rows][:, None] + np.arange(w)
            out[w] = np.floor(flat[at]).astype(np.int64) if len(rows) else np.zeros((0, w), np.int64)
    return length, out


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` in Python integers: double products where every sum stays below 2^53, integers beyond."""
    largest = int(np.abs(y).max(initial=0))
    rows = (1 << 53) // max(largest * largest, 1)
    total = np.zeros((y.shape[1],) * 2, dtype=object)
    if rows < 1:
        wide = y.astype(object)
        return total + wide.T @ wide
    for k in range(0, len(y), rows):
        part = y[k : k + rows].astype(np.float64)
        total = total + (part.T @ part).astype(np.int64)
    return total


def _sums(vectors: DataFrame, scale: int, offset: int) -> DataFrame:
    """``(width, i, total)`` by length: sums of the integers, at i = -1 the number of rows."""

    def run(batches):
        n: dict[int, int] = {}
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for w, y in integers(batch.column(0), scale=scale)[1].items():
                n[w] = n.get(w, 0) + len(y)
                total[w] = total.get(w, 0) + y.sum(0).astype(object) + len(y) * offset
        for w, count in n.items():
            yield pa.record_batch({"width": pa.array([w] * (w + 1), pa.int32()), "i": pa.array(range(-1, w), pa.int32()),
                                   "total": pa.array([count, *map(int, total[w])], pa.decimal128(38))})

    return vectors.mapInArrow(run, "width int, i int, total decimal(38,0)").groupBy("width", "i").agg(F.sum("total").alias("total"))


def fit(vectors: DataFrame, vec_col: str = "embedding", scale: int = SCALE, offset: int = OFFSET) -> Whitening | None:
    """The whitening of all usable vectors, None without any. Runs jobs.

    Usable are vectors without null and non-finite entries (and none from 2^40 / ``scale`` on). Where their lengths
    differ, those of the most frequent length count (of several, the longest); an empty vector is not usable.
    """
    column = vectors.select(F.col(vec_col).cast("array<double>").alias("vector"))
    sums = cut(_sums(column, scale, offset), "sums")
    top = sums.filter("i = -1").orderBy(F.desc("total"), F.desc("width")).limit(1).collect()
    if not top:
        return None
    width, n = top[0]["width"], int(top[0]["total"])
    total = [int(r["total"]) for r in sums.filter((F.col("width") == width) & (F.col("i") >= 0)).orderBy("i").collect()]
    centre = np.array([(2 * s + n) // (2 * n) - offset for s in total], dtype=np.int64)

    def run(batches):
        found = np.zeros((width, width), dtype=object)
        for batch in batches:
            found = found + exact_products(integers(batch.column(0), width, scale)[1][width] - centre)
        i, j = np.triu_indices(width)
        yield pa.record_batch({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()),
                               "total": pa.array([int(t) for t in found[i, j]], pa.decimal128(38))})

    products = column.mapInArrow(run, "i int, j int, total decimal(38,0)").groupBy("i", "j").agg(F.sum("total").alias("total"))
    rest = np.array([s - n * (int(c) + offset) for s, c in zip(total, centre, strict=True)], dtype=object)
    square = np.zeros((width, width), dtype=object)
    for i, j, t in products.collect():
        square[i, j] = square[j, i] = int(t)
    values, turn, trace = principal(square, rest, n)
    return Whitening(n, width, tuple(s - n * offset for s in total), centre, values, turn, trace)


def _whitened(y: np.ndarray, model: Whitening, components: int) -> np.ndarray:
    """Rows on the first components over the root of their variance; ``y`` is centred but for ``model.rest``."""
    keep = model.kept(components)
    scale = np.sqrt(np.where(keep, model.values[:components], 1.0))
    return (y - model.rest) @ model.vectors[:, :components] / scale


def whitened_rows(vectors: DataFrame, model: Whitening, id_col: str = "vec_id", vec_col: str = "embedding",
                  components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``(id, deviation, whitened)`` per usable row: the exact sum of squares of ``n * x - S`` (null where a long
    cannot hold it) and one double per component (null where the component has no variance)."""
    components = min(components, model.width)
    flat = ~model.kept(components)

    def run(batches):
        n, rest = model.n, np.array([s - model.n * int(c) for s, c in zip(model.sums, model.centre, strict=True)], dtype=object)
        for batch in batches:
            length, rows = integers(batch.column(1), model.width, scale)
            y = rows[model.width] - model.centre
            bound = n * (int(np.abs(y).max(initial=0)) + 1)
            if model.width * bound * bound < 1 << 63:
                away = ((n * y - rest.astype(np.int64)) ** 2).sum(1).tolist()
            else:
                away = [d if d < 1 << 63 else None for d in ((n * y.astype(object) - rest) ** 2).sum(1).tolist()]
            w = _whitened(y, model, components)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * components, pa.int32()),
                                             pa.array(w.ravel(), pa.float64(), mask=np.tile(flat, len(y))))
            ids = batch.column(0).filter(pa.array(length == model.width))
            yield pa.record_batch([ids, pa.array(away, pa.int64()), lists], names=["id", "deviation", "whitened"])

    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, f"id {kind}, deviation long, whitened array<double>")


def identity_error(vectors: DataFrame, model: Whitening, vec_col: str = "embedding", components: int = COMPONENTS,
                   scale: int = SCALE) -> float | None:
    """Largest absolute entry of the whitened rows' covariance less the identity, measured over all rows; None
    where no component has variance. Runs a job."""
    components = min(components, model.width)
    keep = np.flatnonzero(model.kept(components))
    if not len(keep):
        return None
    m = len(keep)

    def run(batches):
        found, mean = np.zeros((m, m)), np.zeros(m)
        for batch in batches:
            w = _whitened(integers(batch.column(0), model.width, scale)[1][model.width] - model.centre, model, components)[:, keep]
            found += w.T @ w
            mean += w.sum(0)
        i, j = np.triu_indices(m)
        yield pa.record_batch({"i": pa.array([*i, *range(m)], pa.int32()), "j": pa.array([*j, *[-1] * m], pa.int32()),
                               "total": pa.array([*found[i, j], *mean], pa.float64())})

    column = vectors.select(F.col(vec_col).cast("array<double>").alias("vector"))
    sums = column.mapInArrow(run, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total")).collect()
    mean, product = np.zeros(m), np.zeros((m, m))
    for i, j, total in sums:
        if j < 0:
            mean[i] = total / model.n
        else:
            product[i, j] = product[j, i] = total / model.n
    return float(np.abs(product - np.outer(mean, mean) - np.eye(m)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS,
           scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """``(id, component, n, deviation, whitened, explained, identity_error)`` per usable row and component.

    Components are numbered from 1 by falling variance, as many as the vectors are wide at most. Unusable rows (see
    ``fit``) are left out; without usable rows the result is empty. A component without variance has null ``whitened`` and
    ``explained`` 0 (null if nothing varies). Repeated rows and null ids stay; extra columns may have any names. Runs
    jobs while the plan is made.
    """
    kind = vectors.schema[id_col].dataType.simpleString()
    model = fit(vectors, vec_col, scale, offset)
    if model is None:
        schema = f"id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema)
    components = min(components, model.width)
    error = identity_error(vectors, model, vec_col, components, scale)
    share = [float(v) / model.trace if k else 0.0 for v, k in zip(model.values[:components], model.kept(components), strict=True)]
    explained = F.element_at(F.array(*map(F.lit, share)), F.col("component")) if model.trace > 0 else F.lit(None)
    rows = whitened_rows(vectors, model, id_col, vec_col, components, scale)
    rows = rows.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    rows = rows.select("id", (F.col("at") + 1).cast("int").alias("component"), "deviation", "whitened")
    return rows.select("id", "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
                       explained.cast("double").alias("explained"), F.lit(error).cast("double").alias("identity_error"))
