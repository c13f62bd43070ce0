"""Whitening of embeddings by Chebyshev-filtered subspace iteration.

The leading eigenvectors of a covariance matrix are found without the matrix: a pass
over the rows multiplies it with a narrow block, each task with its own rows, and the
products are summed by Spark. A polynomial in the matrix, built by the Chebyshev
recurrence from such passes, damps the part of the spectrum that is not wanted; the
block is then made orthonormal (QR) and turned to the best vectors in it
(Rayleigh-Ritz). This is repeated until the residuals certify the wanted pairs.

Only matrices of dimensions times block width ever reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatprep.llm.common import written

COMPONENTS = 8
#: Columns of the block for each wanted component: the further the first unwanted
#: eigenvalue is from the last wanted one, the fewer passes are needed.
GUARD = 3
#: Degree of the polynomial, so many passes between two turns of the block.
DEGREE = 8
#: Passes with one vector that bound the spectrum from below.
BOUND_STEPS = 8
#: A pair is certified when its residual is this small a part of the largest eigenvalue,
#: or when rounding keeps it from falling further and it is below the second bound.
CERTIFIED = 1e-13
SETTLED = 1e-10
MAX_ROUNDS = 60
#: Eigenvalues below this part of the trace are rounding, not variance.
NO_VARIANCE = 1e-12
SEED = 42
#: Entries of this size and more have no exact sums, and count as non-finite.
MAX_ENTRY = float(1 << 30)


@dataclass(frozen=True)
class Centre:
    """Count, whole mean and what is left over of it: the mean is ``whole + rest / n``."""

    n: int
    whole: np.ndarray
    rest: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Rows less the mean. The large part is taken off in whole numbers, without rounding."""
        return (x - self.whole) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[Decimal]:
        """Sum over dimensions of ``(n * x - sum) ** 2`` for each row, exact."""
        off = x - self.whole
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if x.shape[1] * most * most >= 1 << 62:
            off = off.astype(object)
        scaled = self.n * off - self.rest
        return [Decimal(int(v)) for v in (scaled * scaled).sum(axis=1)]


def _usable(vector: Column) -> Column:
    def odd(entry: Column) -> Column:
        return entry.isNull() | F.isnan(entry) | (F.abs(entry) >= MAX_ENTRY)

    return vector.isNotNull() & ~F.exists(vector, odd)


def _points(df: DataFrame, id_col: str, vec_col: str, scale: int, shift: int) -> DataFrame:
    """``id`` and whole-numbered ``x`` of every usable vector of the commonest length."""
    vector = F.col("v")
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(_usable(vector))
    whole = F.transform(vector, lambda c: F.floor(c * scale).cast("long") + F.lit(shift).cast("long"))
    rows = written(rows.select("id", whole.alias("x")), "points")
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).select("d").head()
    return rows.where(F.size("x") == (common["d"] if common else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("x"))
    return column.flatten().to_numpy().reshape(len(column), -1)


def _centre(points: DataFrame) -> Centre | None:
    """Count and exact sums of all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                sums = _matrix(batch).sum(axis=0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums), pa.array([batch.num_rows] * len(sums))],
                    ["at", "part", "n"],
                )

    parts = points.select("x").mapInArrow(run, "at int, part long, n long")
    exact = F.sum(F.col("part").cast("decimal(38,0)")).alias("total")
    # One row for each dimension.
    found = sorted(parts.groupBy("at").agg(exact, F.sum("n").alias("n")).collect())
    if not found:
        return None
    n = found[0]["n"]
    whole, rest = zip(*(divmod(int(row["total"]), n) for row in found), strict=True)
    return Centre(n, np.array(whole, np.int64), np.array(rest, np.int64))


def _pass(points: DataFrame, centre: Centre, block: np.ndarray) -> np.ndarray:
    """The covariance matrix times a block, and each dimension's variance in a last column."""
    width = block.shape[1] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(block), width))
        rows = 0
        for batch in batches:
            x = centre.centred(_matrix(batch)) if batch.num_rows else np.empty((0, len(block)))
            total[:, :-1] += x.T @ (x @ block)
            total[:, -1] += np.einsum("ij,ij->j", x, x)
            rows += batch.num_rows
        if rows:
            cells = [pa.array(total[:, k]) for k in range(width)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(block), dtype=np.int32)), *cells], ["at", *(f"c{k}" for k in range(width))]
            )

    names = [f"c{k}" for k in range(width)]
    parts = points.select("x").mapInArrow(run, "at int, " + ", ".join(f"{name} double" for name in names))
    # One row for each dimension comes to the driver.
    rows = sorted(parts.groupBy("at").agg(*[F.sum(name).alias(name) for name in names]).collect())
    return np.array([row[1:] for row in rows]) / centre.n


def least_bound(multiply: Callable[[np.ndarray], np.ndarray], d: int, steps: int = BOUND_STEPS) -> float:
    """A value at or below the spectrum's low end, by Lanczos steps and their last residual."""
    steps = min(steps, d)
    ahead = np.random.default_rng(SEED + 1).standard_normal(d)
    basis, alphas, betas = [ahead / np.linalg.norm(ahead)], [], []
    for _ in range(steps):
        ahead = multiply(basis[-1][:, None])[:, 0]
        alphas.append(basis[-1] @ ahead)
        for _ in range(2):
            for known in basis:
                ahead = ahead - (known @ ahead) * known
        betas.append(np.linalg.norm(ahead))
        if betas[-1] <= 1e-12 * abs(max(alphas)):
            break
        basis.append(ahead / betas[-1])
    off = betas[: len(alphas) - 1]
    low = np.linalg.eigvalsh(np.diag(alphas) + np.diag(off, 1) + np.diag(off, -1))[0]
    return max(0.0, float(low - betas[-1]))


def filtered(
    multiply: Callable[[np.ndarray], np.ndarray],
    block: np.ndarray,
    product: np.ndarray,
    low: float,
    high: float,
    top: float,
    degree: int = DEGREE,
) -> np.ndarray:
    """A Chebyshev polynomial of the matrix times a block: small on [low, high], one at ``top``.

    ``product`` is the matrix times the block, which is known from the turn before.
    """
    half, middle = (high - low) / 2, (high + low) / 2
    sigma = first = half / (top - middle)
    before, now = block, (product - middle * block) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (multiply(now) - middle * now) * (2 * after / half) - sigma * after * before
        sigma = after
    return now


def leading_pairs(
    multiply: Callable[[np.ndarray], np.ndarray], d: int, wanted: int
) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns, certified by residuals.

    ``multiply`` gives the matrix (symmetric, no negative eigenvalues) times a block.
    """
    wanted, width = min(wanted, d), min(d, GUARD * wanted)
    block = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, width)))[0]
    # A block as wide as the space has nothing to damp.
    low = least_bound(multiply, d) if width < d else 0.0
    last = np.inf
    for _ in range(MAX_ROUNDS):
        product = multiply(block)
        small = block.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        block, product = block @ turn, product @ turn
        top = max(values[0], 0.0)
        off = np.linalg.norm(product - block * values, axis=0)[:wanted].max(initial=0.0)
        if off <= CERTIFIED * top or (off <= SETTLED * top and off > last / 2) or width == d:
            return values[:wanted], block[:, :wanted]
        last = off
        high = max(values[-1], low + 1e-6 * (top - low))
        block = np.linalg.qr(filtered(multiply, block, product, low, high, top))[0]
    raise RuntimeError(f"not certified in {MAX_ROUNDS} rounds: residual {off / top:.1e} of the largest eigenvalue")


def whiten(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    components: int = COMPONENTS,
    scale: int = 1024,
    shift: int = 100_000,
) -> DataFrame:
    """One row for each vector and component: id, ``component``, ``n``, ``deviation``, ``whitened``,
    ``explained``, ``identity_error``.

    Entries become whole numbers ``x = floor(scale * entry) + shift``. The mean and the
    covariance (divisor n) are over all vectors that stay. ``whitened`` is the centred
    vector on the component's unit eigenvector, over the root of its eigenvalue;
    ``explained`` is the eigenvalue's share of the trace, ``identity_error`` the largest
    entry of the whitened values' covariance less the identity. ``deviation``, the sum
    over dimensions of ``(n * x - sum of x) ** 2``, is exact.

    Vectors that are null, or hold null, non-finite or huge entries (``MAX_ENTRY``), are
    left out; so are those of another length than the commonest (of equally common ones
    the greatest). Components without variance are not returned: none at all for a single
    vector, or for copies of one. An empty table gives an empty result. Null ids and
    repeated rows stay, other columns play no part.
    """
    id_type = df.schema[id_col].dataType.simpleString()
    schema = (
        f"id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, "
        "identity_error double"
    )
    points = _points(df, id_col, vec_col, scale, shift)
    centre = _centre(points)
    if centre is None:
        return df.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    d = len(centre.whole)
    variances = np.zeros(d)

    def multiply(block: np.ndarray) -> np.ndarray:
        product = _pass(points, centre, block)
        variances[:] = product[:, -1]
        return product[:, :-1]

    values, vectors = leading_pairs(multiply, d, components)
    trace = float(variances.sum())
    some = (values > NO_VARIANCE * trace) & (trace > 0)
    values, vectors = values[some], vectors[:, some]
    axes = vectors / np.sqrt(values)
    k = axes.shape[1]
    error = 0.0
    if k:
        error = float(np.abs(axes.T @ multiply(axes) - np.eye(k)).max())
    explained = values / trace if k else values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows or not k:
                continue
            x = _matrix(batch)
            at = np.repeat(np.arange(rows), k)
            deviations = pa.array(centre.deviations(x), pa.decimal128(38, 0)).take(pa.array(at))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * k, centre.n, np.int64)),
                    deviations,
                    pa.array((centre.centred(x) @ axes).ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * k, error)),
                ],
                ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return points.select("id", "x").mapInArrow(run, schema).withColumnRenamed("id", id_col)
