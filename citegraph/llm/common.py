"""Reading tables, cutting lineage and shipping code: what the ten operators share."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words in every contract: blank, tab to carriage return.
WORD_BREAK = r"[\x20\x09-\x0D]+"

#: Bounds of an Arrow batch, where the session leaves Spark's own: a worker holds a few batches at once.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20

_shipped: set[str] = set()
_kept: dict[str, object] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; in local mode, where it is unset, a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='citegraph-checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again.

    It cuts the lineage so that a lost executor costs a read, not the work that came before, and it fixes row
    identities that would otherwise depend on the order of a recomputed task.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Tables:
    """Written tables that go when the work that needs them is done."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def __enter__(self) -> Tables:
        return self

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __exit__(self, *_: object) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once an application, so that their Python workers can import it."""
    for name, bound, default in (("maxRecordsPerBatch", BATCH_ROWS, "10000"), ("maxBytesPerBatch", BATCH_BYTES, "268435456")):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b") in (default, "2147483647"):
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(bound))
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = os.path.realpath(tempfile.mkdtemp(prefix="citegraph-"))
    target = f"{folder}/citegraph_code.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(target)
    _shipped.add(context.applicationId)


def text_of(column: str = "text") -> Column:
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's text, modulo 5: the contracts' folds. A null id has the text ''."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5


Batches = Iterator[pa.RecordBatch]


def task(operator: str, run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run as a task of an operator: what workers remember for other operators goes first, and free memory goes last."""

    def whole(batches: Batches) -> Batches:
        for other in [k for k in _kept if k != operator]:
            del _kept[other]
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole


def kept(operator: str, build: Callable[[], object]) -> object:
    """What a worker remembers from one task of an operator to the next."""
    if operator not in _kept:
        _kept[operator] = build()
    return _kept[operator]
