"""Embedding whitening: leading components of the covariance by a block Jacobi-Davidson method.

Vectors become integers, ``floor(256 * c)``, and every distinct one is in the fit list once. The covariance is never formed:
a product with a few directions is one pass over the fit list, in which tasks centre their rows, multiply twice and return
sums per dimension (``Fit.times``). The driver holds the search space only: dimension times ``Params.space`` numbers.

Each round solves the small projected problem (Rayleigh-Ritz), locks leading pairs whose residual has reached double
precision, and widens the space by corrections: for each open pair the equation projected off the locked and the current
vectors is solved roughly by MINRES, all pairs of a round in step, so that one pass serves them all. A full space restarts
from its leading vectors. When the locked vectors and the space together fill the dimension, the small problem is exact.

Sums and the deviation are integers and exact: 64-bit where a bound shows that they fit, Python integers elsewhere.

Defined results: rows whose vector is null or holds a null or non-finite entry are dropped, so are empty vectors and those whose
length is not the commonest one (the shorter of two equally common). Entries beyond 64 bits count as the largest. A deviation
beyond 64 bits is null. A component without spread (eigenvalue zero to double precision) is not returned, so one distinct
vector, or none, gives no rows. Repeated rows are transformed alike and counted once in the fit. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from works_risk.llm.tiles import written
from works_risk.llm.words import long_text_batches

EPS = float(np.finfo(float).eps)
_INT64 = 1 << 63


@dataclass(frozen=True)
class Params:
    components: int = 4
    #: Vectors beyond the open pairs that widen the space in a round.
    guard: int = 2
    #: Most vectors of the search space before it restarts.
    space: int = 32
    #: MINRES steps per correction.
    inner: int = 3
    #: Residual, in units of rounding times the largest eigenvalue, at which a pair is locked.
    units: float = 64.0
    rounds: int = 200
    seed: int = 7


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and x, the integers of each vector that can be used."""
    x = F.col("embedding")
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    good = vectors.select("vec_id", "embedding").filter(x.isNotNull() & (F.size(x) > 0) & ~F.exists(x, odd))
    sizes = good.groupBy(F.size(x).alias("size")).agg(F.count(F.lit(1)).alias("n"))
    # One row comes back, whatever the number of lengths.
    common = sizes.agg(F.max(F.struct("n", (-F.col("size")).alias("less"))).alias("most")).collect()[0]["most"]
    dim = -common["less"] if common else 0
    top, low = F.lit(float(_INT64 - 1024)), F.lit(float(-_INT64))
    whole = lambda v: F.floor(F.greatest(F.least(v.cast("double") * 256, top), low)).cast("long")
    return good.filter(F.size(x) == dim).select("vec_id", F.transform(x, whole).alias("x"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A row of integers per vector of a batch."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def exact_sums(x: np.ndarray) -> tuple[list[int], list[int]]:
    """Sums and sums of squares of each column."""
    if len(x) and int(np.abs(x.astype(float)).max()) ** 2 * len(x) >= _INT64 >> 1:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)], [int(v) for v in (x * x).sum(axis=0)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the sum over dimensions of (n * x - sum)^2."""
    if not len(x):
        return []
    most = n * int(np.abs(x.astype(float)).max()) + max(abs(s) for s in sums)
    if most * most * x.shape[1] < _INT64 >> 1:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = n * x.astype(object) - np.array(sums, object)
    return [int(v) if v < _INT64 else None for v in (y * y).sum(axis=1)]


def means(n: int, sums: list[int]) -> np.ndarray:
    return np.array([float(Fraction(s, n)) for s in sums])


@dataclass
class Fit:
    """The distinct vectors and their exact sums."""

    rows: DataFrame
    n: int
    sums: list[int]
    squares: list[int]
    passes: int = field(default=0)

    @property
    def dim(self) -> int:
        return len(self.sums)

    @property
    def trace(self) -> float:
        """Of the covariance, rounded once."""
        return float(sum((Fraction(q, self.n) - Fraction(s, self.n) ** 2 for s, q in zip(self.sums, self.squares)), Fraction(0)))

    def _summed(self, run, width: int, keys: int) -> np.ndarray:
        """Rows (k, values) of all tasks added up by k; ``keys`` rows come back."""
        self.passes += 1
        parts = self.rows.mapInArrow(run, "k int, v array<double>")
        sums = parts.groupBy("k").agg(*[F.sum(F.col("v")[j]).alias(f"v{j}") for j in range(width)])
        out = np.zeros((keys, width))
        for row in sums.collect():
            out[row["k"]] = row[1:]
        return out

    def times(self, v: np.ndarray) -> np.ndarray:
        """Covariance times the columns of ``v``: centred products, one pass."""
        mean = means(self.n, self.sums)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(v.shape)
            for batch in batches:
                if batch.num_rows:
                    y = matrix(batch.column("x")) - mean
                    total += y.T @ (y @ v)
            yield _numbered(total)

        return self._summed(run, v.shape[1], self.dim) / self.n

    def covariance_of(self, project) -> np.ndarray:
        """Covariance of the projected rows, centred on their own mean first: two passes."""
        width = project(np.zeros((1, self.dim), np.int64)).shape[1]

        def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((1, width))
            for batch in batches:
                if batch.num_rows:
                    sums += project(matrix(batch.column("x"))).sum(axis=0)
            yield _numbered(sums)

        mean = self._summed(total, width, 1)[0] / self.n

        def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros((width, width))
            for batch in batches:
                if batch.num_rows:
                    w = project(matrix(batch.column("x"))) - mean
                    sums += w.T @ w
            yield _numbered(sums)

        return self._summed(products, width, width) / self.n


def _numbered(values: np.ndarray) -> pa.RecordBatch:
    edges = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.ascontiguousarray(values).reshape(-1)))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), lists], ["k", "v"])


def fit_list(vectors: DataFrame) -> Fit:
    """Each distinct vector once, written, with n and the sums per dimension. ``vectors`` has x."""
    rows = written(vectors.select("x").distinct(), "whitening-fit")
    limb, limbs = 10**18, 3  # sums travel as three decimals of 18 digits each, so they stay exact on the cluster
    names = [f"{c}{p}" for c in "sq" for p in range(limbs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, first, second = 0, [], []
        for batch in batches:
            if batch.num_rows:
                s, q = exact_sums(matrix(batch.column("x")))
                n += batch.num_rows
                first = [a + b for a, b in zip(first, s)] if first else s
                second = [a + b for a, b in zip(second, q)] if second else q
        columns = [pa.array(np.arange(len(first)), pa.int32()), pa.array([n] * len(first), pa.int64())]
        for values in (first, second):
            for power in range(limbs):
                digits = [(abs(v) // limb**power % limb) * (1 if v >= 0 else -1) for v in values]
                columns.append(pa.array(digits, pa.int64()))
        yield pa.RecordBatch.from_arrays(columns, ["k", "n", *names])

    parts = rows.mapInArrow(run, "k int, n long, " + ", ".join(f"{c} long" for c in names))
    summed = parts.groupBy("k").agg(F.sum("n").alias("n"), *[F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in names])
    found = sorted(summed.collect(), key=lambda r: r["k"])
    whole = lambda r, c: sum(int(r[f"{c}{p}"]) * limb**p for p in range(limbs))
    return Fit(rows, found[0]["n"] if found else 0, [whole(r, "s") for r in found], [whole(r, "q") for r in found])


def _off(v: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """``v`` without its part in the span of the orthonormal ``basis``; twice, so that rounding is gone too."""
    for _ in range(2):
        v = v - basis @ (basis.T @ v)
    return v


def _new_directions(v: np.ndarray, basis: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """Orthonormal columns off ``basis`` from the columns of ``v``; one that vanishes gives way to a random one."""
    dim, made = len(v), []
    for k in range(min(v.shape[1], dim - basis.shape[1])):
        one = v[:, [k]]
        for _ in range(4):
            size = np.linalg.norm(one)
            one = _off(one / size, np.hstack([basis, *made])) if size > 0 and np.isfinite(size) else np.zeros_like(one)
            if np.linalg.norm(one) > 1e-8:
                break
            one = random.normal(size=one.shape)
        one = _off(one / np.linalg.norm(one), np.hstack([basis, *made]))
        made.append(one / np.linalg.norm(one))
    return np.hstack(made) if made else np.zeros((dim, 0))


def corrections(times, theta: np.ndarray, u: np.ndarray, r: np.ndarray, locked: np.ndarray, steps: int) -> np.ndarray:
    """Rough solutions t of (I - QQ')(A - theta)(I - QQ') t = -r with Q the locked and the current vectors.

    MINRES for all columns in step: each step is one product with as many directions as there are columns.
    """
    q = np.hstack([locked, u])
    b = -_off(r, q)
    beta = np.linalg.norm(b, axis=0)
    safe = lambda x: np.where(np.abs(x) > 0, x, 1.0)
    v_old, v = np.zeros_like(b), b / safe(beta)
    t, d_old, d = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    c_old, s_old, c, s = np.ones(len(beta)), np.zeros(len(beta)), np.ones(len(beta)), np.zeros(len(beta))
    beta_now, phi = np.zeros(len(beta)), beta.copy()
    for _ in range(steps):
        # Lanczos step on the projected operator.
        w = _off(times(v) - theta * v, q)
        alpha = (v * w).sum(axis=0)
        w = w - alpha * v - beta_now * v_old
        beta_next = np.linalg.norm(w, axis=0)
        # The two rotations so far, then a new one, keep the small system triangular.
        epsilon = s_old * beta_now
        delta = c * (c_old * beta_now) + s * alpha
        gamma = c * alpha - s * (c_old * beta_now)
        rho = safe(np.hypot(gamma, beta_next))
        c_old, s_old, c, s = c, s, gamma / rho, beta_next / rho
        d_old, d = d, (v - delta * d - epsilon * d_old) / rho
        t = t + c * phi * d
        phi = -s * phi
        v_old, v, beta_now = v, w / safe(beta_next), beta_next
    return _off(t, q)


@dataclass
class Components:
    vectors: np.ndarray
    values: np.ndarray
    residuals: np.ndarray
    rounds: int


def leading(times, dim: int, params: Params = Params()) -> Components:
    """The largest eigenvalues of a symmetric operator without negative ones, with vectors, in falling order."""
    random = np.random.default_rng([params.seed, dim])
    want = min(params.components, dim)
    block = min(want + params.guard, dim)
    most = max(params.space, 3 * block)
    locked, values, residuals = np.zeros((dim, 0)), [], []
    space = _new_directions(random.normal(size=(dim, block)), locked, random)
    image = times(space)
    for turn in range(1, params.rounds + 1):
        small = space.T @ image
        theta, s = np.linalg.eigh((small + small.T) / 2)
        theta, s = theta[::-1], s[:, ::-1]
        ritz, ritz_image = space @ s, image @ s
        rest = _off(ritz_image - ritz * theta, locked)
        sizes = np.linalg.norm(rest, axis=0)
        scale = max([abs(theta[0]), *values], default=0.0)
        full = locked.shape[1] + space.shape[1] == dim
        done = 0
        while done < len(theta) and len(values) < want and (full or sizes[done] <= params.units * EPS * scale):
            values.append(float(theta[done]))
            residuals.append(float(sizes[done]))
            done += 1
        locked = np.hstack([locked, ritz[:, :done]])
        ritz, ritz_image, theta, rest = ritz[:, done:], ritz_image[:, done:], theta[done:], rest[:, done:]
        if len(values) == want:
            return Components(locked, np.array(values), np.array(residuals), turn)
        open_pairs = min(block, len(theta))
        if len(theta) + open_pairs > most:  # restart
            ritz, ritz_image = ritz[:, : most // 2], ritz_image[:, : most // 2]
        space, image = ritz, ritz_image
        wide = corrections(times, theta[:open_pairs], ritz[:, :open_pairs], rest[:, :open_pairs], locked, params.inner)
        new = _new_directions(wide, np.hstack([locked, space]), random)
        if new.shape[1]:
            space, image = np.hstack([space, new]), np.hstack([image, times(new)])
    raise ArithmeticError(f"{want - len(values)} components did not reach double precision in {params.rounds} rounds")


def whiten(vectors: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per usable vector of (vec_id, embedding) and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    long_text_batches(vectors.sparkSession)
    whole = whole_vectors(vectors)
    fit = fit_list(whole)
    id_type = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    trace = fit.trace if fit.n else 0.0
    if trace <= 0:
        return vectors.sparkSession.createDataFrame([], schema)
    found = leading(fit.times, fit.dim, params)
    keep = found.values > fit.dim * EPS * trace
    axes, spread = found.vectors[:, keep], np.sqrt(found.values[keep])
    mean = means(fit.n, fit.sums)
    project = lambda x: ((x - mean) @ axes) / spread
    error = float(np.abs(fit.covariance_of(project) - np.eye(len(spread))).max())
    n, sums, explained = fit.n, fit.sums, found.values[keep] / trace
    width = len(spread)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column("x"))
            rows = np.repeat(np.arange(len(x)), width)
            fill = lambda value, kind: pa.array(np.full(len(rows), value), kind)
            columns = [
                batch.column("vec_id").take(pa.array(rows)),
                pa.array(np.tile(np.arange(1, width + 1), len(x)), pa.int32()),
                fill(n, pa.int64()),
                pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(rows)),
                pa.array(project(x).reshape(-1)),
                pa.array(np.tile(explained, len(x))),
                fill(error, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return whole.mapInArrow(run, schema)
