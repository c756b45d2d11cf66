"""A stored vector index: cells of a coarse k-means, probed by the nearest centres, with exact distances.

Centres are trained on a sample of at most SAMPLE vectors, the ones of the smallest hashes; every vector is then assigned
to its nearest centre and stored under that cell. A search reads the cells of the nearest centres alone and ranks their
vectors by exact distance; how many cells that takes is measured on the sample, whose vectors ask for their neighbours. Each cell knows how far its farthest vector is from the centre, so an exact search can go on
with just those cells that could hold a nearer vector than the k-th found, until there are none: the triangle inequality
leaves the others out.

Defined results: vectors that are null, hold nulls or non-finite entries, or have another length than most are kept under
cell -1, and are found by no search, as they have no distance. Repeated vectors are rows of their own; ties go by key. An
empty table gives an index that finds nothing.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.operators.search import distance
from citegraph.snapshot import Store, checkpointed, shared_folder

SAMPLE, ROUNDS = 20_000, 12
#: Vectors of a cell, about; queries, neighbours and recall by which the number of cells to read is set.
CELL_ROWS, QUERIES, NEIGHBOURS, RECALL = 1_000, 200, 20, 0.97


def _sound(column: str, dimension: int) -> Column:
    entry_ok = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(column).isNotNull() & (F.size(column) == dimension) & F.coalesce(entry_ok, F.lit(False))


def centres_of(sample: np.ndarray, cells: int, rounds: int = ROUNDS) -> np.ndarray:
    """Lloyd's rounds from a spread of start vectors (each the farthest from those before); empty cells keep their centre."""
    first = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(first) < min(cells, len(sample)):
        first.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[first[-1]]) ** 2).sum(1))
    centres = sample[first].copy()
    for _ in range(rounds):
        cell = nearest_cells(sample, centres)[0]
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        n = np.bincount(cell, minlength=len(centres))
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def nearest_cells(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each vector, and its distance."""
    square = (vectors**2).sum(1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(1)
    cell = square.argmin(1)
    return cell, np.sqrt(((vectors - centres[cell]) ** 2).sum(1))


def probes_for(sample: np.ndarray, centres: np.ndarray) -> int:
    """The least number of nearest cells that hold RECALL of the neighbours of the first vectors of the sample."""
    queries = sample[:QUERIES]
    cell = nearest_cells(sample, centres)[0]
    square = (queries**2).sum(1)[:, None] - 2 * queries @ sample.T + (sample**2).sum(1)
    near = cell[np.argsort(square, axis=1, kind="stable")[:, :NEIGHBOURS]]
    away = (queries**2).sum(1)[:, None] - 2 * queries @ centres.T + (centres**2).sum(1)
    rank = np.argsort(np.argsort(away, axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(rank, near, 1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(RECALL * len(needed)) - 1)]) + 1


class VectorIndex:
    """The index of one table's vectors in a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.store = spark, Store(spark, folder)
        self.state = self.store.manifest()["state"]
        self.centres = np.array(self.state.get("centres") or np.zeros((0, 0)))

    @classmethod
    def build(cls, df: DataFrame, key: str = "vec_id", column: str = "embedding", folder: str | None = None, cell_rows: int = CELL_ROWS, sample: int = SAMPLE) -> VectorIndex:
        """Train centres on at most sample vectors, and store every row of df by its cell."""
        spark = df.sparkSession
        folder = folder or f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
        rows = df.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("vector"))
        common = rows.where("vector is not null").groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
        dimension = common["d"] if common else 0
        sound = rows.where(_sound("vector", dimension))
        n = common["n"] if common else 0
        some = sound.orderBy(F.xxhash64("key"), "key").limit(sample).collect()  # the documented bound of the fit
        cells = max(1, math.ceil(n / cell_rows))
        vectors = np.array([r["vector"] for r in some])
        centres = centres_of(vectors, cells) if some else np.zeros((0, dimension))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                vectors = np.array(b.column(1).to_pylist(), float).reshape(b.num_rows, dimension)
                cell, far = nearest_cells(vectors, centres)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.astype(np.int32)), pa.array(far)], ["key", "vector", "cell", "far"])

        body = f"key {rows.schema['key'].dataType.simpleString()}, vector array<double>, cell int, far double"
        odd = rows.where(~_sound("vector", dimension)).select("key", "vector", F.lit(-1).alias("cell"), F.lit(0.0).alias("far"))
        made = checkpointed((sound.mapInArrow(assign, body) if some else sound.select("key", "vector", F.lit(0).alias("cell"), F.lit(0.0).alias("far"))).unionByName(odd))
        radius = {r["cell"]: r["radius"] for r in made.where("cell >= 0").groupBy("cell").agg(F.max("far").alias("radius")).collect()}
        store = Store(spark, folder, buckets=min(64, cells))
        with store.lock():
            state = {"key": key, "probes": probes_for(vectors, centres) if some else 0, "centres": centres.tolist(), "radius": [radius.get(i, -1.0) for i in range(len(centres))]}
            store.commit({}, state, {"cells": (["cell"], made)})
        return cls(spark, folder)

    def _of(self, cells: list[int]) -> DataFrame:
        """The rows of cells, from their buckets and row groups."""
        return self.store.read("cells", values=cells).where(F.col("cell").isin(cells))

    def _ranked(self, cells: list[int], query: list[float], k: int) -> list[tuple]:
        d = distance(F.col("vector"), F.array(*[F.lit(float(x)) for x in query]))
        return [tuple(r) for r in self._of(cells).select("key", d.alias("distance")).orderBy("distance", "key").limit(k).collect()]

    def search(self, query: list[float], k: int, probes: int | None = None, exact: bool = False) -> DataFrame:
        """(key, distance) of the k nearest: of the nearest cells, or exact, of all cells that could hold one of them."""
        probes = self.state["probes"] if probes is None else probes
        kind = f"{self.state['key']} {self.store.read('cells').schema['key'].dataType.simpleString()}, distance double"
        used = [i for i, r in enumerate(self.state["radius"]) if r >= 0]
        if not used or len(query) != self.centres.shape[1]:
            return self.spark.createDataFrame([], kind)
        away = np.sqrt(((self.centres - np.array(query, float)) ** 2).sum(1))
        order = sorted(used, key=lambda i: away[i])
        found = self._ranked(order[:probes], query, k)
        if exact and len(order) > probes:
            least = found[-1][1] if len(found) == k else math.inf
            rest = [i for i in order[probes:] if away[i] - self.state["radius"][i] <= least * (1 + 1e-9)]
            if rest:
                found = sorted(found + self._ranked(rest, query, k), key=lambda r: (r[1], r[0]))[:k]
        return self.spark.createDataFrame(found, kind)
