"""Embedding whitening with eigenvectors refined in mixed precision.

Entries become whole numbers, floor(scale * c) + shift, so that sums and deviations are exact. One pass sums the
vectors by dimension, a second sums the products of the centred vectors, each task its own matrix product; Spark adds
the tasks' sums by entry. The driver holds one matrix of dimension x dimension, never a vector of the table. Its
eigenvectors are found in float32 and corrected by iterations of Ogita and Aishima, which are matrix products in
extended precision; eigenvalues closer than the error bound of an iteration form a cluster, whose vectors are turned by
the eigenvectors of the small projected matrix before the next iteration.

Rows whose vector is null, empty, holds null or non-finite entries, or an entry whose scaled value is beyond 2**52,
are left out, as are vectors of another length than most have (of equally frequent lengths the longest counts).
Repeated rows and ids each count and each have results; null ids are kept. A component without variance (up to
rounding) has no whitened values (null) and takes no part in ``identity_error``; without any variance that is 0 and
``explained`` is 0. ``deviation`` is null where it does not fit a long. An empty table gives an empty result. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

LIMIT = float(1 << 52)
_ROWS = 4096  # vectors at a time in a task


def _refined(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One iteration of Ogita and Aishima: vectors, eigenvalues, bound of the off-diagonal parts, largest correction."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    r, s = (r + r.T) / 2, (s + s.T) / 2  # so that the corrections of a close pair stay orthogonal
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    norm = lambda m: float(np.sqrt((m * m).sum()))  # noqa: E731  at least the spectral norm
    bound = 2 * (norm(off) + float(np.abs(values).max()) * norm(r))
    gap = values[None, :] - values[:, None]
    apart = np.abs(gap) > bound
    e = np.where(apart, (s + values[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, values, bound, float(np.abs(e).max())


def _turned(a: np.ndarray, x: np.ndarray, values: np.ndarray, bound: float) -> tuple[np.ndarray, bool]:
    """Vectors of clustered eigenvalues turned to those of the projected matrix; whether any was."""
    order = np.argsort(values)
    x, values = x[:, order], values[order]
    ends = np.flatnonzero(np.diff(values) > bound) + 1
    turned = False
    for part in np.split(np.arange(len(values)), ends):
        if len(part) < 2:
            continue
        basis = x[:, part]
        basis = basis @ (np.eye(len(part), dtype=a.dtype) * 1.5 - basis.T @ basis / 2)  # one step towards orthonormal
        middle = values[part].mean()
        small = basis.T @ (a @ basis - middle * basis)
        small = ((small + small.T) / 2).astype(np.float64)
        x[:, part] = basis @ np.linalg.eigh(small)[1].astype(a.dtype)
        turned = True
    return x, turned


def eigenvectors(matrix: np.ndarray, most: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, to double precision."""
    n = len(matrix)
    scale = float(np.abs(matrix).max()) if n else 0.0
    if not scale:
        return np.zeros(n), np.eye(n)
    a = np.asarray(matrix, np.longdouble) / np.longdouble(scale)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    last = np.inf
    for _ in range(most):
        x, values, bound, moved = _refined(a, x)
        if moved < 1e-18 * n or moved < 1e-7 and moved > last / 4:
            break
        last = moved
        if moved > 1e-13:
            x, turned = _turned(a, x, values, bound)
            last = np.inf if turned else last
    x /= np.sqrt((x * x).sum(0))
    values = (x * (a @ x)).sum(0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * np.longdouble(scale)).astype(np.float64), x[:, order].astype(np.float64)


def _blocks(batches, scale: float, shift: int) -> Iterator[tuple]:
    """(batch, whole-number vectors) of every batch, a few thousand vectors at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            part = batch.slice(at, _ROWS)
            lists = part.column(part.num_columns - 1)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            yield part, (np.floor(scale * flat) + shift).astype(np.int64).reshape(part.num_rows, -1)


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """(id, _v) of the rows that take part, entries as double."""
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) + abs(shift) < LIMIT))
    rows = vectors.select(F.col(id_col), v.alias("_v")).where(F.col("_v").isNotNull() & fine & (F.size("_v") > 0))
    lengths = rows.groupBy(F.size("_v").alias("d")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return rows.where(F.size("_v") == most[0].d) if most else rows.where(F.lit(False))


def _sums(scale: float, shift: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        n, total = 0, None
        for _, x in _blocks(batches, scale, shift):
            n += len(x)
            part = x.astype(object).sum(0) if np.abs(x).max() > 1 << 48 else x.sum(0).astype(object)
            total = part if total is None else total + part
        if n:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(range(len(total)), pa.int32()), "n": pa.array([n] * len(total), pa.int64()),
                "s": pa.array([str(v) for v in total])})

    return run


def _centred(x: np.ndarray, n: int, sums: np.ndarray, wide: bool) -> np.ndarray:
    """n * x - sums, exact: whole numbers of 64 bits, or Python's where ``wide``."""
    return n * x.astype(object) - sums if wide else n * x - sums.astype(np.int64)


def _products(scale: float, shift: int, n: int, sums: np.ndarray, wide: bool):
    def run(batches) -> Iterator:
        import pyarrow as pa

        total = None
        for _, x in _blocks(batches, scale, shift):
            y = _centred(x, n, sums, wide).astype(np.float64) / n
            part = y.T @ y
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pa.RecordBatch.from_pydict({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "v": pa.array(total[i, j])})

    return run


class Whitening:
    """What a fit holds: n, exact sums by dimension, covariance, eigenvalues falling, eigenvectors as columns."""

    def __init__(self, n: int, sums: np.ndarray, covariance: np.ndarray, scale: float, shift: int, wide: bool):
        self.n, self.sums, self.covariance, self.scale, self.shift, self.wide = n, sums, covariance, scale, shift, wide
        self.values, self.vectors = eigenvectors(covariance)
        self.trace = float(np.trace(covariance))

    def varied(self, k: int) -> np.ndarray:
        """Of the first k components, which have variance beyond rounding."""
        return self.values[:k] > max(self.values.max(initial=0), 0) * len(self.values) * 1e-15


def fitted(rows: DataFrame, scale: float = 1024.0, shift: int = 100_000) -> Whitening | None:
    """The fit over all rows of ``usable``; None without rows. The driver sees one row for each pair of dimensions."""
    found = rows.select("_v").mapInArrow(_sums(scale, shift), "i int, n long, s string").groupBy("i").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("i").collect()
    if not found:
        return None
    n, sums = found[0].n, np.array([int(r.s) for r in found], object)
    bound = rows.select("_v").agg(F.max(F.greatest(F.abs(F.array_min("_v")), F.abs(F.array_max("_v"))))).first()[0]
    wide = n * (abs(bound * scale) + abs(shift) + 1) * 2 >= 1 << 62
    added = rows.select("_v").mapInArrow(_products(scale, shift, n, sums, wide), "i int, j int, v double").groupBy("i", "j").agg(
        F.sum("v").alias("v")).collect()
    covariance = np.zeros((len(sums), len(sums)))
    for r in added:
        covariance[r.i, r.j] = covariance[r.j, r.i] = r.v / n
    return Whitening(n, sums, covariance, scale, shift, wide)


def _deviations(y: np.ndarray) -> list:
    """Exact sums of squares by row; None where one does not fit 64 bits."""
    if y.dtype != object and (y.astype(np.float64) ** 2).sum(1).max(initial=0) < 2.0**62:
        return (y * y).sum(1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in y]
    return [v if v < 1 << 63 else None for v in exact]


def whitened(rows: DataFrame, fit: Whitening, components: int = 8, id_col: str = "vec_id") -> DataFrame:
    """Per row of ``usable``: id, deviation and ``w``, the whitened coordinates of the first components."""
    k = min(components, len(fit.values))
    varied = fit.varied(k)
    turn = fit.vectors[:, :k] / np.sqrt(np.where(varied, fit.values[:k], 1.0))
    n, sums, wide, scale, shift = fit.n, fit.sums, fit.wide, fit.scale, fit.shift

    def run(batches) -> Iterator:
        import pyarrow as pa

        for part, x in _blocks(batches, scale, shift):
            y = _centred(x, n, sums, wide)
            w = (y.astype(np.float64) / n) @ turn
            flat = pa.array(w.ravel(), mask=np.tile(~varied, len(w)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(w) * k + 1, k), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(_deviations(y), pa.int64()), lists], [id_col, "deviation", "w"])

    kind = dict(rows.dtypes)[id_col]
    return rows.select(id_col, "_v").mapInArrow(run, f"`{id_col}` {kind}, deviation long, w array<double>")


def identity_error(coordinates: DataFrame, fit: Whitening, components: int = 8) -> float:
    """Largest absolute entry of the covariance of ``w`` minus the identity, over the components with variance."""
    k = min(components, len(fit.values))
    live = np.flatnonzero(fit.varied(k)).tolist()
    if not live:
        return 0.0
    pairs = [(a, b) for a in live for b in live if a <= b]
    means = coordinates.agg(*[F.avg(F.get("w", F.lit(a))).alias(f"m{a}") for a in live]).first()
    at = lambda a: F.get("w", F.lit(a)) - F.lit(means[f"m{a}"])
    found = coordinates.agg(*[F.avg(at(a) * at(b)).alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max(abs(found[f"c{a}_{b}"] - (a == b)) for a, b in pairs)


def whitening(vectors: DataFrame, components: int = 8, id_col: str = "vec_id", vec_col: str = "embedding",
              scale: float = 1024.0, shift: int = 100_000) -> DataFrame:
    """Per remaining row and component: id, component, n, deviation, whitened, explained, identity_error."""
    rows = usable(vectors, id_col, vec_col, scale, shift)
    fit = fitted(rows, scale, shift)
    kind = dict(vectors.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if fit is None:
        return vectors.sparkSession.createDataFrame([], schema)
    found = saved(whitened(rows, fit, components, id_col), "whitened")
    error = identity_error(found, fit, components)
    shares = [float(max(v, 0.0) / fit.trace) if fit.trace > 0 else 0.0 for v in fit.values[:components]]
    return found.select(id_col, "deviation", F.posexplode("w").alias("p", "whitened")).select(
        id_col, (F.col("p") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(F.array(*map(F.lit, shares)), F.col("p")).alias("explained"), F.lit(error).alias("identity_error"))
