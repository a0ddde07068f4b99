"""Whitening of embeddings by an exact scatter matrix in residue numbers.

1. Each entry c becomes the integer x = floor(1024 * c) + 100000. Sums by dimension, the number of vectors and the
   largest entry come from one pass; the last two bound every entry of the scatter matrix (sum of x x^T) and so the
   number of primes that are needed.
2. Each partition multiplies its residues modulo each prime by matrix products of doubles, in chunks so short that all
   partial sums stay below 2^53: nothing is rounded. Their residues are summed by Spark per prime and cell, and the
   driver gets one number for each, however many rows there are.
3. The Chinese remainder theorem gives the exact scatter G; n * G - S S^T is the exact covariance times n^2, rounded once
   to doubles for eigh.
4. Each row is centred exactly (n * x - S), projected and divided by the root of the eigenvalue. The whitened rows are
   written once; their covariance, which tells the error, is aggregated from what was written.

Vectors that are null, empty or hold null or non-finite entries are dropped, and so are those of another length than most
(of_one_length) and those with an entry of 2^30 or more, whose squares this arithmetic does not hold. Repeated rows count as
often as they stand; a null vec_id is carried along. Components whose eigenvalue is not above rounding (1e-12 of the largest) can't
be whitened: `whitened` is null there. `explained` is null if all vectors are equal. A deviation beyond a long is null;
`deviation_exact` has it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelgrid.llm.tables import one_thread_a_task, written
from reelgrid.llm.vectors import embeddings, lists, matrix, of_one_length, usable

SCALE, SHIFT = 1024, 100000
#: Entries below this size are whitened.
LARGEST = float(1 << 30)
#: Primes are the largest ones below this; CHUNK rows of residues of half their size multiply without rounding.
BELOW, CHUNK = 1 << 20, 1 << 15


def primes_for(bound: int) -> list[int]:
    """The largest primes below BELOW whose product exceeds 2 * bound: residues then tell every integer from -bound to bound."""
    found, product, p = [], 1, BELOW
    while product <= 2 * bound:
        p -= 1
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            found.append(p)
            product *= p
    return found


def remaindered(residues: np.ndarray, primes: list[int]) -> np.ndarray:
    """The integers, of least size, that have these residues; residues[k] are those modulo primes[k]."""
    product = 1
    for p in primes:
        product *= p
    out = sum(r.astype(object) * (product // p * pow(product // p, -1, p)) for r, p in zip(residues, primes, strict=True)) % product
    return np.where(out > product // 2, out - product, out)


def integers(column: pa.Array) -> np.ndarray:
    return np.floor(SCALE * matrix(column)).astype(np.int64) + SHIFT


def totals(rows: DataFrame, d: int) -> tuple[int, int, list[int]]:
    """Number of vectors, the largest size of an entry x, and the sum of x by dimension."""

    def run(batches):
        n, most, sums = 0, 0, np.zeros(d, object)
        for b in batches:
            x = integers(b.column(0))
            if len(x):
                n, most, sums = n + len(x), max(most, int(np.abs(x).max())), sums + x.sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([most]), pa.array([[str(s) for s in sums]])], names=["n", "most", "sums"])

    parts = rows.select("vector").mapInArrow(run, "n long, most long, sums array<string>")
    by_place = parts.select("n", "most", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = sorted(by_place.collect())  # a row per dimension
    return found[0]["n"], found[0]["most"], [int(r["s"]) for r in found]


def scatter(rows: DataFrame, d: int, primes: list[int]) -> np.ndarray:
    """The exact sum of x x^T over all rows, as Python integers."""

    def run(batches):
        sums = np.zeros((len(primes), d, d), np.int64)
        for b in batches:
            x = integers(b.column(0))
            for lo in range(0, len(x), CHUNK):
                for k, p in enumerate(primes):
                    r = x[lo : lo + CHUNK] % p
                    r = np.where(r > p // 2, r - p, r).astype(np.float64)
                    sums[k] = (sums[k] + (r.T @ r).astype(np.int64)) % p
        at = [(k, i) for k in range(len(primes)) for i in range(d)]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in at], pa.int32()), pa.array([i for _, i in at], pa.int32()), lists(sums.reshape(-1, d), pa.int64())], names=["prime", "i", "sums"])

    parts = rows.select("vector").mapInArrow(run, "prime int, i int, sums array<long>")
    cells = parts.select("prime", "i", F.posexplode("sums").alias("j", "s")).groupBy("prime", "i", "j").agg(F.sum("s").alias("s"))
    residues = np.zeros((len(primes), d, d), np.int64)
    for prime, i, j, s in cells.collect():  # d * d a prime
        residues[prime, i, j] = s % primes[prime]
    return remaindered(residues, primes)


class Whitening:
    """What the fit gives: n, sums S, eigenvalues and eigenvectors by falling eigenvalue, and shares of the trace."""

    def __init__(self, n: int, sums: list[int], g: np.ndarray, components: int):
        self.n, self.sums = n, sums
        s = np.array(sums, object)
        exact = n * g - s[:, None] * s[None, :]
        v = np.array([[c / (n * n) for c in row] for row in exact.tolist()], np.float64)  # true division of integers rounds once
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        self.values, self.vectors = values[order], vectors[:, order]
        trace = int(np.trace(exact))
        self.explained = [float(e) / (trace / (n * n)) if trace else None for e in self.values]
        self.can = self.values > max(0.0, float(values.max())) * 1e-12

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: longs where these fit, else Python integers."""
        near = [s // self.n for s in self.sums]
        left = [s - self.n * m for s, m in zip(self.sums, near, strict=True)]
        small = x - np.array(near, np.int64)
        if (int(np.abs(small).max(initial=0)) + 1) * self.n < 1 << 62:
            return small * self.n - np.array(left, np.int64)
        return small.astype(object) * self.n - np.array(left, object)

    def deviations(self, y: np.ndarray) -> list[int]:
        most = max(abs(int(y.max())), abs(int(y.min()))) if y.size else 0
        return ((y if most * most * y.shape[1] < 1 << 63 else y.astype(object)) ** 2).sum(axis=1).tolist()

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """A column per component; nan where it can't be whitened."""
        with np.errstate(divide="ignore", invalid="ignore"):
            w = (y / self.n).astype(np.float64) @ self.vectors / np.sqrt(np.where(self.can, self.values, np.nan))
        return w


def fitted(rows: DataFrame, d: int, components: int) -> Whitening:
    n, most, sums = totals(rows, d)
    return Whitening(n, sums, scatter(rows, d, primes_for(n * most * most)), components)


def identity_error(white: DataFrame, can: np.ndarray) -> float | None:
    """The largest entry of the covariance of `whitened` minus the identity, over the components that can be whitened."""
    at = [k for k, ok in enumerate(can) if ok]
    if not at:
        return None
    w = lambda k: F.col("whitened")[k]
    means = white.agg(*[F.avg(w(k)).alias(f"m{k}") for k in at]).first()
    cov = white.agg(*[F.avg((w(i) - means[f"m{i}"]) * (w(j) - means[f"m{j}"])).alias(f"c{i}_{j}") for i in at for j in at if i <= j]).first()
    return max(abs(cov[f"c{i}_{j}"] - (i == j)) for i in at for j in at if i <= j)


def whitened(rows: DataFrame, components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact of rows(vec_id, embedding)."""
    spark = one_thread_a_task(rows.sparkSession)
    vectors = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    vectors, d = of_one_length(vectors.where(usable(F.col("vector"), LARGEST)), "vector")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not d:
        return spark.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)")
    fit = fitted(vectors, d, components)

    def run(batches):
        for b in batches:
            y = fit.centred(integers(b.column(1)))
            deviation = pa.array([str(v) for v in fit.deviations(y)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), deviation, lists(fit.whitened(y), pa.float64())], names=["vec_id", "deviation", "whitened"])

    white = written(vectors.mapInArrow(run, f"vec_id {kind}, deviation string, whitened array<double>"), "whitened")
    error = identity_error(white, fit.can)
    exact = F.col("deviation").cast("decimal(38,0)")
    out = white.select("vec_id", exact.alias("deviation_exact"), F.posexplode("whitened").alias("at", "w"))
    return out.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(fit.n).cast("long").alias("n"), F.expr("try_cast(deviation_exact AS long)").alias("deviation"),
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"), F.element_at(F.array(*[F.lit(e).cast("double") for e in fit.explained]), F.col("at") + 1).alias("explained"),
        F.lit(error).cast("double").alias("identity_error"), "deviation_exact",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's first eight whitened components."""
    return whitened(embeddings(spark, sf_dir))


QUERIES = {"op11_whitening": op11_whitening}
ORACLES: dict[str, str] = {}
