"""Embedding whitening: leading principal components by Chebyshev-filtered subspace iteration.

Entries c become integers z = floor(1024 c); the constant added to them (x = z +
100000) changes neither covariances nor n*x - S. Vectors are packed once into
stored blocks of raw integers. Every product of the covariance with a block of
directions is one pass over these blocks: each task centres its rows, multiplies,
and adds up; partial sums are added in two steps. Cycles of a few passes apply a
Chebyshev polynomial that is small on the unwanted part of the spectrum, then QR and
Rayleigh-Ritz. The Rayleigh-Ritz product is also the first step of the next
polynomial, so a cycle of degree m costs m passes. The lower end of the spectrum
comes from a Lanczos sequence that rides along in the first cycles. Iteration ends
when the residuals of the wanted components have reached rounding level; otherwise it
fails rather than return uncertified components.

* Rows whose vector is null, or holds null, NaN or infinite entries or entries of
  2**35 or more, are dropped, as are vectors of another length than the most common
  one (the shortest of equally common ones) and vectors without entries.
* Repeated rows and null ids are all kept and returned.
* Components whose eigenvalue is not above rounding (1e-12 of the largest) do not
  exist: fewer are returned for few or degenerate vectors, none for a single one.
* Within equal eigenvalues any orthonormal basis is a result; the sign makes the
  entry of the largest magnitude positive.
* A deviation that does not fit 64 bits is null in the table, exact as long as it fits.
* Long vectors: memory of a task is one block (``BLOCK_BYTES``) and one dim x ``WIDTH`` matrix.
* An empty table gives no rows. Columns beside ``vec_id`` and ``embedding`` are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from updraft.llm.common import arrow_schema, read, small_batches, written

COMPONENTS = 8
WIDTH = 32            # columns of the iterated subspace: more guard vectors mean fewer passes
DEGREE = 6            # of the polynomial of a cycle
MOST_GROWTH = 1e11    # of the leading direction in a cycle, so that QR keeps the others
SCALE = 1024
LIMIT = 2.0 ** 35     # of an entry, so that sums over blocks are exact
NOISE = 1e-12         # eigenvalues below this part of the largest do not count
ROUNDING = 2e-15      # residual, as part of the largest eigenvalue, that cannot be improved
CERTIFIED = 1e-11     # residual that is accepted once cycles no longer improve it
MAX_PASSES = 1000
BLOCK_BYTES = 1 << 20
REDUCERS = 8          # partial sums of tasks are added in so many tasks, theirs by the driver
BLOCKS = "ids array<bigint>, n int, wide boolean, data binary, sums array<decimal(38,0)>, squares decimal(38,0)"
ROWS = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")


@dataclass(frozen=True)
class Fit:
    """Components of a set of packed vectors."""

    n: int
    sums: np.ndarray          # of z, exact integers
    trace: float
    values: np.ndarray        # falling
    vectors: np.ndarray       # columns
    passes: int
    residual: float           # largest, as part of the largest eigenvalue

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (array of float or double) of the rows that take part."""
    exact = dict(vectors.dtypes)["embedding"] in ("array<float>", "array<double>")
    rows = vectors.select("vec_id", F.col("embedding") if exact else F.col("embedding").cast("array<double>").alias(
        "embedding"))
    good = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LIMIT)) & (F.size("embedding") > 0)
    rows = rows.where(F.col("embedding").isNotNull() & good)
    usual = rows.groupBy(F.size("embedding").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.where(F.size("embedding") == (usual["size"] if usual else 0))


def _exact_sum(z: np.ndarray, bound: int, axis=None):
    """Sum of integers as Python integers where 64 bits may not hold it."""
    return z.sum(axis=axis) if bound * z.size < 2 ** 62 else z.astype(object).sum(axis=axis)


def _packed(ids: list, z: np.ndarray) -> tuple:
    top = int(np.abs(z).max())
    wide = top >= 2 ** 31
    squares = _exact_sum(z * z, top * top) if top * top < 2 ** 62 else sum(v * v for v in z.ravel().tolist())
    return (ids, len(z), wide, z.astype("<i8" if wide else "<i4").tobytes(),
            [int(s) for s in _exact_sum(z, top, 0)], int(squares))


def pack(vectors: DataFrame) -> DataFrame:
    """Blocks of raw integers, with exact sums and the sum of squares of each block."""
    spark = vectors.sparkSession
    small_batches(spark)
    schema = arrow_schema(spark, BLOCKS)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(_decimals(c, f.type), f.type) for c, f in zip(zip(*rows), schema)],
                                          schema=schema)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            z = np.floor(column.flatten().to_numpy().astype(float).reshape(batch.num_rows, -1) * SCALE).astype(np.int64)
            ids = batch.column(0).to_pylist()
            step = max(1, BLOCK_BYTES // (8 * z.shape[1]))
            for at in range(0, len(z), step):
                yield table([_packed(ids[at:at + step], z[at:at + step])])

    return vectors.mapInArrow(run, BLOCKS)


def _decimals(values, kind: pa.DataType):
    """Integers as decimals where the column holds decimals."""
    from decimal import Decimal

    if pa.types.is_decimal(kind):
        return [Decimal(v) for v in values]
    if pa.types.is_list(kind) and pa.types.is_decimal(kind.value_type):
        return [[Decimal(v) for v in row] for row in values]
    return list(values)


def block_sums(blocks: DataFrame) -> tuple[int, np.ndarray, int]:
    """Rows, exact sums per dimension and exact sum of squares of all blocks."""
    total = blocks.agg(F.sum("n"), F.sum("squares")).first()
    sums = blocks.select(F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("s").alias("s")).collect()
    out = np.zeros(len(sums), object)
    for r in sums:
        out[r["at"]] = int(r["s"])
    return int(total[0] or 0), out, int(total[1] or 0)


def _matrix(data: bytes, wide: bool, n: int) -> np.ndarray:
    return np.frombuffer(data, "<i8" if wide else "<i4").reshape(n, -1)


def _added(rows: DataFrame, shape: tuple[int, ...], each: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Sum of ``each(block)`` over blocks: within tasks, then in ``REDUCERS`` tasks, then here."""
    schema = arrow_schema(rows.sparkSession, "part int, total binary")

    def one(part: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                          schema=schema)

    def within(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in it:
            for n, wide, data in zip(*(c.to_pylist() for c in batch.columns)):
                value = each(_matrix(data, wide, n))
                total = value if total is None else total + value
        if total is not None:
            yield one(TaskContext.get().partitionId(), total)

    def across(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        # In the order of the tasks, so that a repeated reduction gives the same bits.
        for part, data in sorted((p, d) for b in it for p, d in zip(*(c.to_pylist() for c in b.columns))):
            value = np.frombuffer(data)
            total = value if total is None else total + value
        if total is not None:
            yield one(0, total)

    partial = rows.select("n", "wide", "data").mapInArrow(within, schema_ddl())
    few = partial.repartition(REDUCERS, "part").mapInArrow(across, schema_ddl()).collect()
    out = np.zeros(int(np.prod(shape)))
    for data in sorted(bytes(r["total"]) for r in few):
        out = out + np.frombuffer(data)
    return out.reshape(shape)


def schema_ddl() -> str:
    return "part int, total binary"


def times_covariance(blocks: DataFrame, n: int, mean: np.ndarray, q: np.ndarray) -> np.ndarray:
    """V q for the covariance V of the blocks: one pass, rows centred before they are multiplied."""
    sent = blocks.sparkSession.sparkContext.broadcast((mean, q))

    def each(z: np.ndarray) -> np.ndarray:
        centre, directions = sent.value
        x = z - centre
        return x.T @ (x @ directions)

    out = _added(blocks, q.shape, each) / n
    sent.unpersist()
    return out


class _LowerEnd:
    """Lanczos sequence for the lower end of the spectrum; its vector rides along with the block."""

    def __init__(self, start: np.ndarray):
        self.basis, self.alpha, self.beta = [start / np.linalg.norm(start)], [], []

    @property
    def vector(self) -> np.ndarray:
        return self.basis[-1]

    def add(self, product: np.ndarray) -> None:
        a = float(self.vector @ product)
        w = product - a * self.vector
        for u in self.basis:      # full reorthogonalisation: a few short vectors
            w -= (u @ w) * u
        b = float(np.linalg.norm(w))
        self.alpha.append(a)
        self.beta.append(b)
        self.basis.append(w / b if b > 1e-12 * max(1.0, abs(a)) else np.zeros_like(w))

    def bound(self) -> float:
        """Below all of the spectrum but for directions the start vector hardly has; never below 0."""
        if not self.alpha:
            return 0.0
        off = self.beta[:-1]
        values, vectors = np.linalg.eigh(np.diag(self.alpha) + np.diag(off, 1) + np.diag(off, -1))
        return max(0.0, float(values[0]) - self.beta[-1] * abs(float(vectors[-1, 0])))


def _degree(low: float, high: float, top: float) -> int:
    """Degree at which the leading direction grows by ``MOST_GROWTH`` at most."""
    if high <= low:
        return 2
    x = max(1.0 + 1e-9, (2 * top - high - low) / (high - low))
    return int(np.clip(np.log(MOST_GROWTH) / np.log(x + np.sqrt(x * x - 1)), 2, DEGREE))


def leading_components(apply: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int = COMPONENTS,
                       width: int = WIDTH, seed: int = 7) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Eigenvalues and vectors of the ``wanted`` largest, by ``apply(q)`` = V q alone.

    Returns also the number of passes and the largest residual relative to the largest eigenvalue.
    """
    wanted, width = min(wanted, dim), min(width, dim)
    rng = np.random.default_rng(seed)
    q, _ = np.linalg.qr(rng.standard_normal((dim, width)))
    lower, passes, before = _LowerEnd(rng.standard_normal(dim)), 0, np.inf

    def product(block: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1
        if len(lower.alpha) >= min(dim, 2 * DEGREE) or not lower.vector.any():
            return apply(block)
        out = apply(np.column_stack([block, lower.vector]))
        lower.add(out[:, -1])
        return out[:, :-1]

    while passes < MAX_PASSES:
        y = product(q)
        h = q.T @ y
        values, u = np.linalg.eigh((h + h.T) / 2)
        values, u = values[::-1], u[:, ::-1]
        q, y = q @ u, y @ u
        top = max(float(values[0]), np.finfo(float).tiny)
        residual = float(np.linalg.norm(y - q * values, axis=0)[:wanted].max()) / top
        settled = residual <= CERTIFIED and residual > before / 4
        if residual <= ROUNDING or settled or (width == dim and residual <= CERTIFIED):
            return np.maximum(values[:wanted], 0.0), q[:, :wanted], passes, residual
        before = residual
        # Damp [low, high]; the product of the Rayleigh-Ritz step is the polynomial's first step.
        low, high = lower.bound(), float(values[-1])
        low = min(low, 0.999 * high)
        middle, half = (high + low) / 2, max((high - low) / 2, 1e-14 * top)
        last, now = q, (y - middle * q) / half
        for _ in range(_degree(low, high, top) - 1):
            last, now = now, 2 * (product(now) - middle * now) / half - last
        q, _ = np.linalg.qr(now / np.linalg.norm(now, axis=0))
    raise RuntimeError(f"components did not converge in {MAX_PASSES} passes: residual {residual:.1e}")


def fit(blocks: DataFrame, wanted: int = COMPONENTS) -> Fit | None:
    """Components of packed vectors; None without vectors or without spread."""
    n, sums, squares = block_sums(blocks)
    if n == 0:
        return None
    spread = n * squares - sum(int(s) * int(s) for s in sums)     # n**2 times the trace, exact
    if spread == 0:
        return None
    mean = np.array([int(s) / n for s in sums])
    values, vectors, passes, residual = leading_components(
        lambda q: times_covariance(blocks, n, mean, q), len(sums), wanted)
    real = values > NOISE * values[0]
    vectors = vectors[:, real] * np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])[real]
    return Fit(n, sums, spread / n / n, values[real], vectors, passes, residual)


def identity_error(blocks: DataFrame, model: Fit) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, measured in one more pass."""
    k = len(model.values)
    mean = np.array([int(s) / model.n for s in model.sums])
    turn = model.vectors / np.sqrt(model.values)

    def each(z: np.ndarray) -> np.ndarray:
        w = (z - mean) @ turn
        return np.vstack([w.T @ w, w.sum(axis=0)])

    total = _added(blocks, (k + 1, k), each) / model.n
    return float(np.abs(total[:k] - np.outer(total[k], total[k]) - np.eye(k)).max())


def _deviations(z: np.ndarray, n: int, sums: np.ndarray) -> list:
    """Exact sums of (n z - S)^2 per row; None where 64 bits cannot hold one."""
    most = n * int(np.abs(z).max()) + max(abs(int(s)) for s in sums)
    if most * most * z.shape[1] < 2 ** 63:
        t = n * z.astype(np.int64) - sums.astype(np.int64)
        return (t * t).sum(axis=1).tolist()
    out = [sum((n * v - int(s)) ** 2 for v, s in zip(row, sums)) for row in z.tolist()]
    return [v if v < 2 ** 63 else None for v in out]


def whitened_rows(blocks: DataFrame, model: Fit | None) -> DataFrame:
    """One row per vector and component."""
    spark = blocks.sparkSession
    if model is None:
        return blocks.where("false").select(*[F.lit(None).cast(t).alias(c) for c, t in
                                             (f.split() for f in ROWS.split(", "))])
    schema = arrow_schema(spark, ROWS)
    k = len(model.values)
    error = identity_error(blocks, model)
    mean = np.array([int(s) / model.n for s in model.sums])
    turn, explained = model.vectors / np.sqrt(model.values), model.explained
    n, sums = model.n, model.sums

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(batch.num_rows):
                ids, rows, wide, data = (c[at].as_py() for c in batch.columns)
                z = _matrix(data, wide, rows)
                columns = [pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                           np.tile(np.arange(1, k + 1, dtype=np.int32), rows), np.full(rows * k, n),
                           pa.array(_deviations(z, n, sums), pa.int64()).take(pa.array(np.repeat(np.arange(rows), k))),
                           ((z - mean) @ turn).ravel(), np.tile(explained, rows), np.full(rows * k, error)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type)
                                                  for c, f in zip(columns, schema)], schema=schema)

    return blocks.select("ids", "n", "wide", "data").mapInArrow(run, ROWS)


def whiten(vectors: DataFrame, wanted: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of ``vectors``."""
    blocks = written(pack(valid_vectors(vectors)), "blocks")
    return whitened_rows(blocks, fit(blocks, wanted))


def op12_chebyshev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read(spark, sf_dir, "embeddings"))
