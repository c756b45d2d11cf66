"""Vectors of chunks by the version of a model: only what is pending is embedded, and a change of model is swapped in whole.

The store says which model its vectors are of. A pass embeds the chunks that have no vector, or whose text has changed, and
takes out those that are gone, by the buckets of their keys; under another model, or other dimensions, all chunks are
embedded and the table is replaced in one commit, so a reader never sees vectors of two models. A model is a column
expression, or a function over numpy batches that Spark runs through predict_batch_udf, loaded once a worker.

Defined results: a null text is embedded as the empty one. Repeated chunk ids are not allowed. Without chunks there are no
vectors, but the model is recorded.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from citegraph.functions import text as T
from citegraph.operators.search import CUT, nearest
from citegraph.snapshot import Change, Cuts, Store

BATCH = 64


class Model(NamedTuple):
    name: str
    dims: int
    column: Callable[[Column], Column]

    @property
    def version(self) -> str:
        return f"{self.name}:{self.dims}"


def hash_model(dims: int = 64) -> Model:
    """The deterministic embedding by words' hashes."""
    return Model("hash", dims, lambda text: T.hash_embedding(text, dims))


def batch_model(name: str, dims: int, load: Callable[[], Callable[[np.ndarray], np.ndarray]], batch: int = BATCH) -> Model:
    """load makes, in each worker, a function from a batch of texts to a matrix of vectors."""
    return Model(name, dims, predict_batch_udf(load, return_type=ArrayType(FloatType()), batch_size=batch))


def _digest(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def pending(store: Store, chunks: DataFrame, model: Model) -> DataFrame:
    """The chunks (chunk_id, text) without a vector of the model and of their present text."""
    manifest = store.manifest()
    rows = chunks.withColumn("digest", _digest("text"))
    if manifest["state"].get("model") != model.version or "vectors" not in manifest["tables"]:
        return rows
    return rows.join(store.read("vectors").select("chunk_id", "digest"), ["chunk_id", "digest"], "left_anti").select(*rows.columns)


def embed(store: Store, chunks: DataFrame, model: Model) -> dict[str, int]:
    """Bring the vectors up to date with chunks; returns how many were embedded and how many went."""
    with store.lock(), Cuts(store.spark) as cut:
        todo = pending(store, chunks, model).select("chunk_id", "digest", F.coalesce("text", F.lit("")).alias("text"))
        made = cut(todo.select("chunk_id", "digest", model.column(F.col("text")).cast("array<double>").alias("vector")))
        manifest, state = store.manifest(), {"model": model.version}
        if manifest["state"].get("model") != model.version or "vectors" not in manifest["tables"]:
            gone = store.read("vectors").count() if "vectors" in manifest["tables"] else 0
            store.commit({}, state, {"vectors": (["chunk_id"], made)})
            return {"embedded": made.count(), "gone": gone}
        lost = cut(store.read("vectors").select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti"))
        keys = cut(lost.unionByName(made.select("chunk_id")).distinct())
        if not keys.isEmpty():
            store.commit({"vectors": Change(["chunk_id"], keys, made)}, state)
        return {"embedded": made.count(), "gone": lost.count()}


def closest(store: Store, query: str, model: Model, k: int = 50, cut: float | None = CUT) -> DataFrame:
    """(chunk_id, distance) of the chunks closest to a query; none if the vectors are of another model."""
    vectors = store.read("vectors")
    if store.manifest()["state"].get("model") != model.version:
        vectors = vectors.where("false")
    asked = store.spark.createDataFrame([(query,)], "text string").select(model.column(F.col("text")).alias("v")).first()["v"]
    return nearest(vectors, list(asked), k, cut, "chunk_id", "vector")
