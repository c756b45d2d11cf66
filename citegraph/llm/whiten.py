"""Whitening of embeddings by a residue-number scatter.

An entry c becomes the integer x = floor(1024 c) + 100000. With n vectors and sums S, y = n x - S is n times the centred
vector, without rounding, and the covariance is (sum of y y') / n^3. The sum is made in residues: each task multiplies its
blocks of y modulo several primes by float matrix products that stay below 2^53, so every product is exact, and keeps one
matrix for each prime. Matrix rows are the cells by which the tasks' residues are dealt out and added; Chinese remaindering
turns the sums into exact integers, of which eigh takes the quotients as doubles. The number of primes follows from n and
the largest |y|, so nothing wraps, at any size. A last scan measures the covariance of what is really returned.

Memory: a task holds a block of rows and, for each prime, a matrix of dimension squared; the driver gets as much once.

Defined results: vectors that are null, or hold a null, a non-finite entry or one whose x is beyond 62 bits, are dropped.
Where lengths differ, shorter vectors count as followed by zeros up to the longest; an empty vector is all zeros. Repeated
vectors and ids, null ids too, keep a row each. Directions without variance (eigenvalue at the rounding of the largest)
have null for whitened and stand out of identity_error, which is null if none is left, as is explained if nothing varies.
A deviation of over 38 digits is null. No vectors, or empty ones alone, give an empty result. Only the id and the vector are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import Batches, ship, table, task

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Residues lie within half a prime of zero: 2^19 each, 2^38 a product, and 2^14 rows of them stay below 2^53.
PRIME_BITS, BLOCK_ROWS, BLOCK_ENTRIES = 20, 1 << 14, 1 << 21
LARGEST = 1 << 62


def primes_below(bits: int = PRIME_BITS) -> Iterator[int]:
    """The primes under 2**bits, the largest first."""
    for p in range((1 << bits) - 1, 2, -1):
        if all(p % q for q in range(2, math.isqrt(p) + 1)):
            yield p


def primes_for(bound: int) -> list[int]:
    """So many primes that integers of absolute value up to bound have residues of their own."""
    found, product = [], 1
    for p in primes_below():
        if product > 2 * bound:
            return found
        found.append(p)
        product *= p
    raise OverflowError("too few primes")


def reconstructed(residues: np.ndarray, primes: list[int]) -> np.ndarray:
    """The integers of least absolute value with these residues (first axis: the primes), as Python ints."""
    product = math.prod(primes)
    total = np.zeros(residues.shape[1:], object)
    for r, p in zip(residues, primes, strict=True):
        rest = product // p
        total = (total + r.astype(object) * (rest * pow(rest, -1, p))) % product
    return np.where(total > product // 2, total - product, total)


def integers(vectors: pa.Array, dimension: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(kept, x): which vectors stay, and their integers, padded to dimension (the longest one's if None)."""
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    own = np.maximum(lengths, 0)
    flat = pc.list_flatten(vectors).cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(flat * SCALE)
        sound = np.abs(scaled) < LARGEST
    owner = np.repeat(np.arange(len(own)), own)
    kept = (lengths >= 0) & (np.bincount(owner[~sound], minlength=len(own)) == 0)
    width = int(own[kept].max(initial=0)) if dimension is None else dimension
    x = np.full((int(kept.sum()), width), SHIFT, np.int64)
    stays = kept[owner]
    place = np.arange(len(owner)) - np.repeat(np.cumsum(own) - own, own)
    row = (np.cumsum(kept) - 1)[owner[stays]]
    x[row, place[stays]] = scaled[stays].astype(np.int64) + SHIFT
    return np.flatnonzero(kept), x


class Fit(NamedTuple):
    """n vectors, their exact sums by dimension, the largest |n x - S|, and the components: columns of axes, values falling."""

    n: int
    sums: list[int]
    reach: int
    values: np.ndarray
    axes: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n x - S, as longs where they fit, else as Python ints."""
        reach = max(self.reach, self.n * int(np.abs(x).max(initial=0)), *map(abs, self.sums), 0)
        kind = np.int64 if reach < LARGEST else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def whitened(self, y: np.ndarray) -> np.ndarray:
        """Projections over the root of the variance; NaN for a direction without variance."""
        root = np.where(self.usable, np.sqrt(np.maximum(self.values, 0.0)), np.nan)
        return (y.astype(float) / self.n) @ self.axes / root

    @property
    def usable(self) -> np.ndarray:
        return self.values > len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)


def _sums(vectors: DataFrame) -> tuple[int, list[int], int]:
    """n, the sums of x by dimension, and the largest |n x - S|."""

    def run(batches: Batches) -> Batches:
        n, low_bits = 0, (1 << 31) - 1
        high, low, least, most = (np.zeros(0, np.int64) for _ in range(4))
        for b in batches:
            _, x = integers(b.column(0))
            if not len(x):
                continue
            if x.shape[1] < len(high):
                x = np.pad(x, ((0, 0), (0, len(high) - x.shape[1])), constant_values=SHIFT)
            more = x.shape[1] - len(high)  # dimensions that all rows before lack: zeros there
            high, low = np.pad(high, (0, more), constant_values=n * (SHIFT >> 31)), np.pad(low, (0, more), constant_values=n * (SHIFT & low_bits))
            least, most = np.pad(least, (0, more), constant_values=SHIFT), np.pad(most, (0, more), constant_values=SHIFT)
            if not n:
                least, most = x[0], x[0]
            n += len(x)
            high, low = high + (x >> 31).sum(0), low + (x & low_bits).sum(0)
            least, most = np.minimum(least, x.min(0)), np.maximum(most, x.max(0))
        if n:
            d = np.arange(-1, len(high))
            first = lambda a: pa.array(np.r_[n, a].astype(np.int64))  # noqa: E731  dimension -1 carries n
            yield pa.RecordBatch.from_arrays([pa.array(d.astype(np.int32)), *map(first, (high, low, least, most)), pa.array(np.full(len(d), n, np.int64))], ["dim", "high", "low", "least", "most", "rows"])

    body = "dim int, high long, low long, least long, most long, rows long"
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    parts = vectors.mapInArrow(task("whiten", run), body).groupBy("dim").agg(whole("high"), whole("low"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("rows").alias("rows"))
    found = {r["dim"]: r for r in parts.collect()}  # a row a dimension
    n = int(found[-1]["rows"]) if found else 0
    sums, reach = [], 0
    for d in range(len(found) - 1):
        r = found[d]
        absent = n - int(r["rows"])  # rows of tasks whose longest vector was shorter
        total = (int(r["high"]) << 31) + int(r["low"]) + SHIFT * absent
        ends = [r["least"], r["most"], *([SHIFT] if absent else [])]
        sums.append(total)
        reach = max(reach, *(abs(n * e - total) for e in ends))
    return n, sums, reach


def _scatter(vectors: DataFrame, n: int, sums: list[int], primes: list[int]) -> np.ndarray:
    """The exact sum of y y' over all vectors, y = n x - S, as Python ints."""
    d = len(sums)
    block = max(1, min(BLOCK_ROWS, BLOCK_ENTRIES // d))

    def run(batches: Batches) -> Batches:
        sums_mod = [np.array([s % p for s in sums], np.int64) for p in primes]
        totals = np.zeros((len(primes), d, d), np.int64)
        for b in batches:
            _, x = integers(b.column(0), d)
            for i in range(0, len(x), block):
                for k, p in enumerate(primes):
                    r = (x[i : i + block] % p * (n % p) - sums_mod[k]) % p
                    r = np.where(r > p // 2, r - p, r).astype(float)
                    totals[k] = (totals[k] + (r.T @ r).astype(np.int64)) % p
        if totals.any():
            cells = np.arange(len(primes) * d, dtype=np.int32)
            rows = totals.reshape(-1, d)
            yield from pa.Table.from_arrays([pa.array(cells), pa.array([r.tobytes() for r in rows], pa.binary())], ["cell", "residues"]).to_batches(max_chunksize=1024)

    def add(batches: Batches) -> Batches:
        totals: dict[int, np.ndarray] = {}
        for b in batches:
            for cell, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                totals[cell] = (totals.get(cell, 0) + np.frombuffer(part, np.int64)) % primes[cell // d]
        for cell, total in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["cell", "residues"])

    body = "cell int, residues binary"
    dealt = vectors.mapInArrow(task("whiten", run), body).repartition("cell").mapInArrow(task("whiten", add), body)
    residues = np.zeros((len(primes), d, d), np.int64)
    for r in dealt.collect():  # a row for each prime and dimension
        residues[r["cell"] // d, r["cell"] % d] = np.frombuffer(r["residues"], np.int64)
    return reconstructed(residues, primes)


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """The components of vectors (one column); None if there is no vector."""
    n, sums, reach = _sums(vectors)
    if not n:
        return None
    if not sums:
        return Fit(n, [], 0, np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    scatter = _scatter(vectors, n, sums, primes_for(max(1, n * reach * reach)))
    cube = n**3
    covariance = np.array([[v / cube for v in row] for row in scatter.tolist()])  # quotients of ints are rounded once
    values, axes = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    axes = axes[:, order]
    axes *= np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    trace = sum(scatter.diagonal().tolist()) / cube
    return Fit(n, sums, reach, values[order], axes, values[order] / trace if trace else np.full(len(order), np.nan))


def _identity_error(vectors: DataFrame, fitted: Fit) -> float | None:
    """The largest entry of the whitened vectors' covariance minus the identity, over directions with variance."""
    usable = np.flatnonzero(fitted.usable)
    if not len(usable):
        return None
    d = len(fitted.sums)

    def run(batches: Batches) -> Batches:
        total, square = np.zeros(len(usable)), np.zeros((len(usable), len(usable)))
        for b in batches:
            _, x = integers(b.column(0), d)
            w = fitted.whitened(fitted.centred(x))[:, usable]
            total, square = total + w.sum(0), square + w.T @ w
        i, j = np.indices((len(usable), len(usable) + 1)).reshape(2, -1)  # the last column: plain sums
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(np.c_[square, total].ravel())], ["i", "j", "total"])

    parts = vectors.mapInArrow(task("whiten", run), "i int, j int, total double").groupBy("i", "j").agg(F.sum("total").alias("total"))
    moments = np.zeros((len(usable), len(usable) + 1))
    for r in parts.collect():  # a row for each pair of components
        moments[r["i"], r["j"]] = r["total"]
    mean = moments[:, -1] / fitted.n
    return float(np.abs(moments[:, :-1] / fitted.n - np.outer(mean, mean) - np.eye(len(usable))).max())


def whiten(df: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) for each kept vector and component."""
    ship(df.sparkSession)
    rows = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{column}`").cast("array<double>").alias("__vector"))
    vectors = rows.select("__vector")
    fitted = fit(vectors, components)
    kind = rows.schema[0].dataType.simpleString()
    body = f"`{key}` {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if fitted is None:
        return df.sparkSession.createDataFrame([], body)
    error, d, k = _identity_error(vectors, fitted), len(fitted.sums), len(fitted.values)
    exact = fitted.reach**2 * d < LARGEST

    def run(batches: Batches) -> Batches:
        explained = [None if math.isnan(v) else v for v in fitted.explained.tolist()]
        for b in batches:
            kept, x = integers(b.column(1), d)
            y = fitted.centred(x)
            if exact:
                deviation = pa.array((y.astype(np.int64) ** 2).sum(1), pa.int64()).cast(pa.decimal128(38, 0))
            else:
                sizes = (y.astype(object) ** 2).sum(1).tolist() if d else [0] * len(y)
                deviation = pa.array([None if s >= 10**38 else s for s in sizes], pa.decimal128(38, 0))
            w = fitted.whitened(y).ravel()
            owner = np.repeat(np.arange(len(kept)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(np.repeat(kept, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(kept))),
                    pa.array(np.full(len(owner), fitted.n, np.int64)),
                    deviation.take(pa.array(owner)),
                    pa.array(w, mask=np.isnan(w)),
                    pa.array(explained * len(kept), pa.float64()),
                    pa.array([error] * len(owner), pa.float64()),
                ],
                [key, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(task("whiten", run), body)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """whiten over all embeddings, with deviation as a long: null where it is beyond one."""
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))
