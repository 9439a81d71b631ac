"""Embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

X holds the centred rows. Each step alternates the products p = Xv and Xᵀp in one
pass over the rows and leaves one number a dimension: X v_j = a_j u_j + b_{j-1} u_{j-1}
and Xᵀ u_j = a_j v_j + b_j v_{j+1}. The long vectors u are never stored: u_j = X w_j
for a short w_j that follows the same recurrence, so their inner products with p
are wᵀ(Xᵀp), and both families are reorthogonalised in full on short vectors. The
singular value decomposition of the small bidiagonal matrix gives components and
deviations.

The steps go on until nothing is left that could displace a wanted component:
what the bidiagonal matrix doesn't hold yet of the total variance bounds every
direction not seen. A broken-off chain is restarted orthogonally, so repeated
singular values are all found. A Rayleigh-Ritz turn within the found components
removes what the recurrences have lost.

Entries are integers and their sums exact (decimal), so the mean costs no digits:
a row is centred as (x - floor(S/n)) - rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barwise.llm.common import bound_batches, table

#: entries saturate here, far inside what a long and a double hold exactly
LIMIT = 1 << 50
#: a component with less than this share of the variance has none
NOTHING = 1e-13
OUT = "vec_id long, component int, n long, deviation decimal(38,0), whitened double"


def _matrix(lists: pa.Array, kind=np.float64) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(lists), -1)


def quantise(v: np.ndarray, scale: int = 1024, shift: int = 100_000) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(v * float(scale)), -LIMIT, LIMIT).astype(np.int64) + shift


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v as doubles) without null, empty or non-finite vectors."""
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
            .filter(F.col("v").isNotNull() & (F.size("v") > 0) & fine))


def exact_sums(rows: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Number of vectors and exact sums by dimension, for each length of vectors."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for b in batches:
            lists = b.column("v")
            lengths = lists.value_lengths().to_numpy()
            for d in np.unique(lengths):
                x = quantise(_matrix(lists.filter(pa.array(lengths == d))))
                n, high, low = seen.get(d, (0, 0, 0))
                seen[d] = n + len(x), high + (x >> 26).sum(axis=0), low + (x & (1 << 26) - 1).sum(axis=0)
        for d, (n, high, low) in seen.items():
            sums = [Decimal((int(h) << 26) + int(w)) for h, w in zip(high, low)]
            yield pa.record_batch({"d": pa.array([int(d)] * len(sums), pa.int32()), "at": pa.array(range(len(sums)), pa.int32()),
                                   "n": pa.array([n] * len(sums), pa.int64()), "s": pa.array(sums, pa.decimal128(38, 0))})

    parts = rows.select("v").mapInArrow(part, "d int, at int, n long, s decimal(38,0)")
    out: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("d", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("d", "at").collect():
        out.setdefault(r.d, (r.n, []))[1].append(int(r.s))
    return out


class Centre:
    """Centring of the vectors of one length, exact up to one rounding."""

    def __init__(self, n: int, sums: list[int]):
        self.n = n
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[Decimal | None]:
        """Sum over dimensions of (n x - S)^2, exact; None beyond 38 digits."""
        off = x - self.whole
        most = (int(np.abs(off).max(initial=0)) + 1) * self.n
        if most * most * x.shape[1] < 1 << 63:
            d = off * self.n - np.array(self.rest, np.int64)
            return [Decimal(int(s)) for s in (d * d).sum(axis=1)]
        sums = [sum((int(o) * self.n - r) ** 2 for o, r in zip(row, self.rest)) for row in off]
        return [Decimal(s) if s < 10 ** 38 else None for s in sums]


def _summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Sum over the centred rows of ``part`` (block of rows -> ``width`` numbers):
    one vector a task, summed map-side; one vector reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc = np.zeros(width)
        for b in batches:
            if b.num_rows:
                acc += part(_matrix(b.column("c"))).ravel()
        yield pa.record_batch({"a": pa.array([acc.tolist()], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(run, "a array<double>").select(Summarizer.sum(array_to_vector("a")).alias("s")).first()
    return sums.s.toArray() if sums.s.size else np.zeros(width)


def bidiagonalise(product: Callable[[np.ndarray], np.ndarray], d: int, total: float, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest squared singular values of X and their right singular
    vectors (columns), from ``product``: q -> Xᵀ(Xq); ``total`` is the squared
    Frobenius norm of X."""
    rng = np.random.default_rng(seed)
    vs, ws, zs = (np.zeros((d, 0)) for _ in range(3))
    diag, upper = [], []

    def fresh() -> np.ndarray:
        v = rng.normal(size=d)
        for _ in range(2):
            v -= vs @ (vs.T @ v)
        return v / np.linalg.norm(v)

    v, beta, held = fresh(), 0.0, 0.0
    while True:
        q = v - beta * ws[:, -1] if beta else v.copy()
        y = product(q)
        for _ in range(2):  # p = Xq against all earlier u
            c = ws.T @ y
            q, y = q - ws @ c, y - zs @ c
        alpha = float(np.sqrt(max(q @ y, 0.0)))
        vs = np.column_stack([vs, v])
        if alpha * alpha <= NOTHING * total:  # Xv lies among the earlier u
            alpha, w, z = 0.0, np.zeros(d), np.zeros(d)
        else:
            w, z = q / alpha, y / alpha
        ws, zs = np.column_stack([ws, w]), np.column_stack([zs, z])
        diag.append(alpha)
        held += alpha * alpha
        r = z - alpha * v
        for _ in range(2):
            r -= vs @ (vs.T @ r)
        beta = float(np.linalg.norm(r))
        if beta * beta <= NOTHING * total:
            beta = 0.0
        j = len(diag)
        b = np.diag(diag) + np.diag(upper, 1)
        left, sigma, right = np.linalg.svd(b)
        rest = total - held
        settled = j >= k and beta * np.abs(left[-1, :k]).max() <= 1e-14 * sigma[0] and rest < 0.999 * sigma[k - 1] ** 2
        if j == d or rest <= NOTHING * total or settled:
            return sigma[:k] ** 2, vs @ right[:k].T
        v = r / beta if beta else fresh()
        upper.append(beta)
        held += beta * beta


def whiten(vectors: DataFrame, k: int = 8, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error):
    up to ``k`` rows for each usable row of ``vectors``, components from 1 by
    falling variance, the sign of each the same for all rows.

    Vectors that are null, empty, or hold null or non-finite entries are left
    out. A null id passes through; repeated rows each count and get their rows.
    Vectors of different lengths are whitened apart, each with the ``n`` of its
    length. A component without variance can't be scaled and has no rows (a table
    of one vector or of equal ones gives none). Equal variances: any orthonormal
    basis of their space, the same for all rows. Entries beyond 2^50 saturate; a
    deviation beyond 38 digits is null. Very long vectors take as many passes as
    it needs to leave no direction unseen, at most one a dimension. An empty table
    gives an empty table; other columns are not read, whatever their names.
    """
    bound_batches(vectors.sparkSession)
    rows = usable(vectors, id_col, vec_col)
    out = None
    for d, (n, sums) in exact_sums(rows).items():
        own = _whiten_length(rows.filter(F.size("v") == d), d, Centre(n, sums), k)
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = rows.select(F.col("id").cast("long").alias("vec_id"), F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"),
                          F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("whitened"),
                          F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error")).limit(0)
    return out


def _whiten_length(rows: DataFrame, d: int, centre: Centre, k: int) -> DataFrame:
    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = centre.rows(quantise(_matrix(b.column("v"))))
            yield pa.record_batch({"c": pa.ListArray.from_arrays(np.arange(0, c.size + 1, d, dtype=np.int32), c.ravel())})

    # read once a step; a lost executor's share is centred again from the table
    x = rows.select("v").mapInArrow(centred, "c array<double>").persist()
    try:
        total = float(_summed(x, lambda c: np.array([(c * c).sum()]), 1)[0])
        k = min(k, d)
        if total > 0:
            e, v = bidiagonalise(lambda q: _summed(x, lambda c: c.T @ (c @ q), d), d, total, k)
            v = np.linalg.qr(v)[0]
            found = v.shape[1]
            gram = _summed(x, lambda c: (p := c @ v).T @ p, found * found).reshape(found, found)
            e, turn = np.linalg.eigh((gram + gram.T) / 2)
            order = np.argsort(-e, kind="stable")
            order = order[e[order] > NOTHING * total]
            e, v = e[order], (v @ turn)[:, order]
        else:
            e, v = np.zeros(0), np.zeros((d, 0))
        variance, m = e / centre.n, len(e)
        scale = np.sqrt(variance)
        if m:
            moments = _summed(x, lambda c: np.concatenate([(w := (c @ v) / scale).sum(axis=0), (w.T @ w).ravel()]), m + m * m)
            mean = moments[:m] / centre.n
            error = float(np.abs(moments[m:].reshape(m, m) / centre.n - np.outer(mean, mean) - np.eye(m)).max())
        else:
            error = 0.0
    finally:
        x.unpersist()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ints = quantise(_matrix(b.column("v")))
            w = (centre.rows(ints) @ v) / scale
            each = np.repeat(np.arange(len(ints)), m)
            yield pa.record_batch({
                "vec_id": b.column("id").take(pa.array(each)), "component": pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(ints))),
                "n": pa.array(np.full(len(each), centre.n)), "whitened": pa.array(w.ravel()),
                "deviation": pa.array(centre.deviations(ints), pa.decimal128(38, 0)).take(pa.array(each))}).select(
                ["vec_id", "component", "n", "deviation", "whitened"])

    share = F.element_at(F.array(*[F.lit(float(s)) for s in e / total]), F.col("component")) if m else F.lit(0.0)
    return (rows.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(spread, OUT)
            .withColumn("explained", share).withColumn("identity_error", F.lit(error)))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of every embedding."""
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), k=8)
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))
