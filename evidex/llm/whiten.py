"""Embedding whitening by incremental eigendecomposition.

Vectors go onto a grid of whole numbers; each distinct grid vector is in the fit list once. A task
holds the count, mean and spectrum of the vectors it has seen. A vector, centred at the mean so
far, changes the scatter by a matrix of rank one: the new eigenvalues are the roots of the secular
equation, one between each two old ones, found for all at once by rational interpolation with a
bracket; entries without weight and equal eigenvalues are deflated first (equal ones by a
reflection); the weights are then recomputed from the roots, so that the new eigenvectors are
orthogonal. Two spectra are combined the same way, by one such update per eigenvector of the second
and one for the distance of the means, ``FAN`` spectra a task, in rounds until one is left. Over this
basis a last pass sums the projected covariance in all tasks (Rayleigh-Ritz), whose eigenvectors
turn the basis; another one measures how far the whitened fit list is from uncorrelated.

Numbers that leave the tasks grow with the square of the dimension, never with the rows.

Defined cases: rows whose vector is null or has null or non-finite entries are dropped; vectors of
each length are a table of their own (an empty vector has no components); ``component`` goes up to
the length if that is below ``COMPONENTS``; where an eigenvalue is zero within rounding, ``whitened``
is null, and ``identity_error`` leaves the component out (null if none is left); ``explained`` is
null if all vectors are equal; a deviation beyond a long is null; rows that repeat an id and null
ids are answered one by one; a grid value or sum beyond a long is an error; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidex.session import cut_lineage

GRID, SHIFT = 64, 1_000_000
COMPONENTS = 16
#: Distinct vectors of a task, in the mean; spectra that one task combines, in the mean.
TASK_ROWS, FAN = 8192, 16
EPS = np.finfo(np.float64).eps
#: The last step of a secular root, as a part of its distance from its pole; steps of bisection at most.
TOLERANCE, STEPS = 1e-7, 60


def secular_roots(poles: np.ndarray, weights: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """(nearest pole, distance from it) of the roots of 1 + rho sum(weights / (poles - x)) = 0.

    ``poles`` ascend strictly, ``weights`` and ``rho`` are positive; root j lies above pole j.
    """
    size = len(poles)
    top = poles[-1] + rho * weights.sum()
    above = np.r_[poles[1:], top]
    gap = above - poles
    ordinal = np.arange(size)
    low_part = (ordinal[:, None] <= ordinal[None, :]).astype(np.float64)

    middle = poles + gap / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        value = 1 / rho + (weights[:, None] / (poles[:, None] - middle[None, :])).sum(axis=0)
    right = (value < 0) & (ordinal < size - 1)  # nearer to the pole above
    origin = np.where(right, ordinal + 1, ordinal)
    distance = poles[:, None] - poles[origin][None, :]
    low = np.where(right, -gap / 2, 0.0)
    high = np.where(right, 0.0, np.where(value < 0, gap, gap / 2))
    # Start: the two poles at hand as they are, the others as constant as in the middle.
    beyond = np.r_[weights[1:], 0.0]
    rest = value + (weights - beyond) * 2 / gap
    near, far, rest = np.where(right, beyond, weights), np.where(right, weights, beyond), np.where(right, -rest, rest)
    half = rest * gap + near + far
    with np.errstate(all="ignore"):
        root = np.sqrt(np.maximum(half * half - 4 * rest * near * gap, 0))
        start = np.where(half > 0, 2 * near * gap / (half + root), (half - root) / (2 * rest))
    start = np.where(right, -start, start)
    at = np.where((start > low) & (start < high), start, (low + high) / 2)
    own, next_ = distance[ordinal, ordinal], np.where(ordinal < size - 1, distance[np.minimum(ordinal + 1, size - 1), ordinal], gap)
    with np.errstate(all="ignore"):
        for _ in range(STEPS):
            apart = distance - at[None, :]
            term = weights[:, None] / apart
            slope = term / apart
            low_slope = np.einsum("ij,ij->j", slope, low_part)
            all_slope = slope.sum(axis=0)
            value = 1 / rho + term.sum(axis=0)
            low = np.where(value < 0, at, low)
            high = np.where(value < 0, high, at)
            a, b = own - at, next_ - at
            c = value - a * low_slope - b * (all_slope - low_slope)
            middle_term = (a + b) * value - a * b * all_slope
            last = a * b * value
            root = np.sqrt(np.maximum(middle_term * middle_term - 4 * c * last, 0))
            step = np.where(middle_term <= 0, (middle_term - root) / (2 * c), 2 * last / (middle_term + root))
            # Above the last pole there is only one to interpolate with.
            step[-1] = a[-1] + a[-1] ** 2 * low_slope[-1] / (value[-1] - a[-1] * low_slope[-1])
            new = at + step
            near = np.abs(step) <= TOLERANCE * np.abs(at)  # convergence is faster than quadratic: the next step is none
            at = np.where(near | (new > low) & (new < high), new, (low + high) / 2)
            if near.all():
                break
    return origin, at


def rank_one(values: np.ndarray, vectors: np.ndarray, direction: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Spectrum (values ascending, vectors in columns) after adding rho * direction direction'."""
    z = direction @ vectors
    norm = float(np.sqrt(z @ z))
    if rho <= 0 or norm == 0:
        return values, vectors
    z = z / norm
    rho = rho * norm * norm
    small = 8 * EPS * max(abs(values[-1]), rho)
    close = np.flatnonzero(np.diff(values) <= small)
    if len(close):  # equal eigenvalues: one of their eigenvectors takes all of the weight
        vectors, z = vectors.copy(), z.copy()
        edges = np.flatnonzero(np.r_[True, np.diff(values) > small, True])
        for start, end in zip(edges[:-1], edges[1:], strict=True):
            part = z[start:end]
            weight = np.sqrt(part @ part)
            if end - start == 1 or weight == 0:
                continue
            mirror = part.copy()
            mirror[-1] += np.copysign(weight, part[-1])
            mirror /= np.sqrt(mirror @ mirror)
            vectors[:, start:end] -= 2 * np.outer(vectors[:, start:end] @ mirror, mirror)
            z[start : end - 1], z[end - 1] = 0, -np.copysign(weight, part[-1])
    live = np.flatnonzero(rho * np.abs(z) > small)
    if not len(live):
        return values, vectors
    poles, weights = values[live], z[live] ** 2
    origin, at = secular_roots(poles, weights, rho)
    # Differences pole - root, and the weights for which these roots are exact.
    apart = (poles[:, None] - poles[origin][None, :]) - at[None, :]
    between = poles[:, None] - poles[None, :]
    np.fill_diagonal(between, 1.0)
    ratio = apart / np.where(between == 0, 1.0, between)
    exact = np.sqrt(np.abs(np.prod(ratio, axis=1))) * np.sign(z[live])
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = exact[:, None] / apart
        turn /= np.sqrt(np.einsum("ij,ij->j", turn, turn))[None, :]
    if not np.isfinite(turn).all():  # a root on its pole: weightless but for rounding
        full = (vectors * values) @ vectors.T + rho * np.outer(direction, direction) / (norm * norm)
        return np.linalg.eigh(full)
    values, vectors = values.copy(), vectors.copy()
    values[live] = poles[origin] + at
    vectors[:, live] = vectors[:, live] @ turn
    order = np.argsort(values, kind="stable")
    return values[order], vectors[:, order]


@dataclass
class Spectrum:
    """Count, exact sums, mean, and the eigendecomposition of the scatter of some vectors."""

    n: int
    sums: np.ndarray
    mean: np.ndarray
    values: np.ndarray
    vectors: np.ndarray

    @classmethod
    def empty(cls, dim: int) -> Spectrum:
        return cls(0, np.zeros(dim, dtype=np.int64), np.zeros(dim), np.zeros(dim), np.eye(dim))

    def add(self, rows: np.ndarray) -> None:
        """One centred rank-one update per row."""
        if len(rows) and float(np.abs(rows).max()) * len(rows) + float(np.abs(self.sums).max()) >= 2.0**62:
            raise OverflowError("the sums of the grid vectors don't fit a long")
        self.sums = self.sums + rows.sum(axis=0)
        for row in rows.astype(np.float64):
            from_mean = row - self.mean
            self.values, self.vectors = rank_one(self.values, self.vectors, from_mean, self.n / (self.n + 1))
            self.n += 1
            self.mean = self.mean + from_mean / self.n

    def join(self, other: Spectrum) -> None:
        """The spectrum of both, by one update per eigenvector of the other and one for the means."""
        n = self.n + other.n
        between = other.mean - self.mean
        for value, vector in zip(other.values, other.vectors.T, strict=True):
            self.values, self.vectors = rank_one(self.values, self.vectors, vector, float(value))
        self.values, self.vectors = rank_one(self.values, self.vectors, between, self.n * other.n / n)
        self.mean = self.mean + between * (other.n / n)
        self.sums, self.n = self.sums + other.sums, n

    def row(self, dim: int) -> dict:
        return {
            "dim": dim, "n": self.n, "sums": self.sums.tolist(), "mean": self.mean.tolist(),
            "eigenvalues": self.values.tolist(), "eigenvectors": self.vectors.ravel().tolist(),
        }

    @classmethod
    def of(cls, row: dict) -> Spectrum:
        dim = int(row["dim"])
        vectors = np.array(row["eigenvectors"], dtype=np.float64).reshape(dim, dim)
        return cls(int(row["n"]), np.array(row["sums"], dtype=np.int64), np.array(row["mean"]), np.array(row["eigenvalues"]), vectors)


SPECTRUM = "dim int, n long, sums array<long>, mean array<double>, eigenvalues array<double>, eigenvectors array<double>"


def grid(vector: Column) -> Column:
    """floor(64 c) of each entry; the shift of the grid takes no part in differences."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(c * GRID))


def usable(vector: Column) -> Column:
    number = vector.cast("array<double>")
    fine = F.forall(number, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return vector.isNotNull() & fine & (F.size(vector) > 0)


def _by_dim(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """(dim, matrix of x, rows) of batches with columns dim and x."""
    for batch in batches:
        dims = batch.column("dim").to_numpy()
        for dim in np.unique(dims).tolist():
            part = batch if (dims == dim).all() else batch.filter(pa.array(dims == dim))
            yield dim, part.column("x").flatten().to_numpy().reshape(-1, dim), part


def spectra(fit: DataFrame) -> dict[int, Spectrum]:
    """The spectrum of the vectors of each length; ``fit``: dim, x."""

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Spectrum] = {}
        for dim, x, _ in _by_dim(batches):
            held.setdefault(dim, Spectrum.empty(dim)).add(x)
        for dim, own in held.items():
            yield from pa.Table.from_pylist([own.row(dim)]).cast(_arrow()).to_batches()

    def combine(rows: pd.DataFrame) -> pd.DataFrame:
        parts = [Spectrum.of(r) for r in rows.to_dict("records")]
        for other in parts[1:]:
            parts[0].join(other)
        return pd.DataFrame([parts[0].row(int(rows["dim"].iloc[0]))])

    tasks = fit.count() // TASK_ROWS + 1
    found = cut_lineage(fit.repartition(tasks, "x").mapInArrow(first, SPECTRUM))
    while (most := found.groupBy("dim").count().agg(F.max("count")).first()[0] or 0) > 1:
        groups = -(-most // FAN) if most > FAN else 1
        number = F.pmod(F.xxhash64("mean", "n"), F.lit(groups))
        found = cut_lineage(found.withColumn("part", number).groupBy("dim", "part").applyInPandas(combine, SPECTRUM))
    return {r["dim"]: Spectrum.of(r.asDict()) for r in found.collect()}


def _arrow() -> pa.Schema:
    longs, doubles = pa.list_(pa.int64()), pa.list_(pa.float64())
    return pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("sums", longs), ("mean", doubles), ("eigenvalues", doubles), ("eigenvectors", doubles)])


def outer_sums(fit: DataFrame, project: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> dict[int, np.ndarray]:
    """Per length: the sum over ``fit`` of p p' / n, with p = (x - sums / n) basis.

    ``project``: (n, sums, basis) of the lengths that are asked for.
    ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for dim, x, _ in _by_dim(batches):
            if dim not in project:
                continue
            n, _, basis = project[dim]
            p = centred(x, *project[dim][:2]) @ basis
            held[dim] = held.get(dim, 0) + p.T @ p / n
        for dim, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part.ravel().tolist()], pa.list_(pa.float64()))], ["dim", "part"])

    sums = fit.mapInArrow(run, "dim int, part array<double>").select("dim", F.posexplode("part").alias("at", "v"))
    out = {dim: np.zeros(basis.shape[1] ** 2) for dim, (_, _, basis) in project.items()}
    for r in sums.groupBy("dim", "at").agg(F.sum("v").alias("v")).collect():
        out[r["dim"]][r["at"]] = r["v"]
    return {dim: flat.reshape(project[dim][2].shape[1], -1) for dim, flat in out.items()}


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - sums / n, rounded once where n x fits a long."""
    if len(x) and float(np.abs(x).max()) * n + float(np.abs(sums).max()) < 2.0**62:
        return (n * x - sums) / n
    return x - sums / n


@dataclass
class Whitening:
    """Components of the vectors of one length: eigenvalues fall, eigenvectors in columns."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None = None

    def scaled(self) -> tuple[np.ndarray, np.ndarray]:
        """(which components have an eigenvalue, the eigenvectors of those over its root)."""
        fine = self.values > max(self.trace, 0) * len(self.vectors) * 4 * EPS
        return fine, self.vectors[:, fine] / np.sqrt(self.values[fine])


def fit_whitening(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """The whitening of the vectors of each length of ``fit`` (dim, x), every row of it counted."""
    project = {dim: (s.n, s.sums, np.linalg.qr(s.vectors)[0]) for dim, s in spectra(fit).items()}
    models = {}
    for dim, covariance in outer_sums(fit, project).items():
        n, sums, basis = project[dim]
        values, turn = np.linalg.eigh((covariance + covariance.T) / 2)
        vectors = (basis @ turn)[:, ::-1][:, :components]
        vectors = vectors * np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1, 1)
        models[dim] = Whitening(n, sums, values[::-1][:components], vectors, float(np.trace(covariance)))
    scaled = {dim: (m.n, m.sums, m.scaled()[1]) for dim, m in models.items() if m.scaled()[0].any()}
    for dim, covariance in outer_sums(fit, scaled).items() if scaled else ():
        models[dim].identity_error = float(np.abs(covariance - np.eye(len(covariance))).max())
    return models


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error per usable row and component."""
    x = grid(F.col("embedding")).alias("x")
    rows = vectors.filter(usable(F.col("embedding"))).select("vec_id", F.size("embedding").alias("dim"), x)
    models = fit_whitening(cut_lineage(rows.select("dim", "x").distinct()), components)
    id_type = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, x, part in _by_dim(batches):
            model = models[dim]
            fine, basis = model.scaled()
            size = len(fine)
            out = np.full((len(x), size), np.nan)
            out[:, fine] = centred(x, model.n, model.sums) @ basis
            deviation, known = deviations(x, model.n, model.sums)
            explained = model.values / model.trace if model.trace > 0 else np.full(size, np.nan)
            each = np.repeat(np.arange(len(x)), size)
            error = pa.array([model.identity_error], pa.float64()).take(pa.array(np.zeros(len(each), dtype=np.int32)))
            columns = [
                part.column("vec_id").take(pa.array(each)),
                pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), len(x))),
                pa.array(np.full(len(each), model.n)),
                pa.array(deviation[each], mask=~known[each]),
                pa.array(out.ravel(), mask=np.isnan(out.ravel())),
                pa.array(np.tile(explained, len(x)), mask=np.isnan(np.tile(explained, len(x)))),
                error,
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(
        run, f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    )


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum over dimensions of (n x - sums)^2, whether it fits a long) of each row, exact."""
    about = ((x.astype(np.float64) * n - sums) ** 2).sum(axis=1)
    if len(x) and float(np.abs(x).max()) * n + float(np.abs(sums).max()) < 2.0**62 and about.max() < 2.0**62:
        return ((n * x - sums) ** 2).sum(axis=1), np.ones(len(x), dtype=bool)
    exact = [sum((n * a - s) ** 2 for a, s in zip(row, sums.tolist(), strict=True)) for row in x.tolist()]
    known = np.array([e < 1 << 63 for e in exact], dtype=bool)
    return np.array([e if k else 0 for e, k in zip(exact, known, strict=True)], dtype=np.int64), known
