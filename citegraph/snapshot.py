"""Tables by copy-on-write, in a folder of any Hadoop file system, and cuts of lineage.

A table is dealt into buckets by a hash of its key. A manifest names, for one version, the folder that holds each bucket;
files never change. A commit writes the buckets of the keys that it touches anew and then one manifest, by a rename: until
then readers see the version before, and a writer that dies leaves only folders that no manifest names. Readers of a
version keep what they read until vacuum() removes it. One writer at a time holds a lease file, with a date at which
others may take it over.

A bucket is written by as many tasks as its bytes need (a rebalance), and a table whose buckets have grown past
BUCKET_BYTES is dealt into more of them by the next commit that touches it, so that a commit keeps costing about the
buckets of what it changes.
"""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS, BUCKET_BYTES, MOST_BUCKETS = 8, 256 << 20, 4096
LEASE_SECONDS = 6 * 3600
KEPT_VERSIONS, KEPT_SECONDS = 2, 24 * 3600
#: Bytes of rows that one pass of a commit deals out.
PASS_BYTES = 256 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); in local mode, where it is unset, a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='citegraph-checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, path: str, *by: str) -> None:
    """Write df in a new folder, dealt by columns, and let its shuffle files go at once, not when the driver collects garbage."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    written(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Cuts:
    """checkpointed, for tables that go when the work that needs them is done."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/cuts-{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        written(df, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Cuts:
        return self

    def __exit__(self, *_: object) -> None:
        Folder(self.spark, self.folder).delete("")


class Folder:
    """A folder of a Hadoop file system: small files, names, deletion."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, name: str = "") -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._at(name))] if self.fs.exists(self._at(name)) else []

    def has(self, name: str) -> bool:
        return self.fs.exists(self._at(name))

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._at(name)).getLength()

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self._at(name)).getModificationTime() / 1000

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self._at(name)):
            return None
        stream = self.fs.open(self._at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a new file; an OSError if there is one."""
        if self.fs.exists(self._at(name)):
            raise FileExistsError(f"{self.path}/{name}")
        try:
            stream = self.fs.create(self._at(name), False)
        except Exception as error:  # the file system's own refusal, by another writer's file
            if not self.fs.exists(self._at(name)):
                raise
            raise FileExistsError(f"{self.path}/{name}") from error
        stream.write(bytearray(text.encode()))
        stream.close()

    def put(self, name: str, text: str) -> None:
        """Write a new file that appears whole."""
        part = f".{name.rpartition('/')[2]}-{uuid.uuid4().hex}"
        self.create(part, text)
        self.fs.mkdirs(self._at(name).getParent())
        if self.fs.exists(self._at(name)) or not self.fs.rename(self._at(part), self._at(name)):
            self.delete(part)
            raise FileExistsError(f"{self.path}/{name}")

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


class Change(NamedTuple):
    """What a commit does to a table: the rows of keys (columns named in key) go, those of add come.

    keys and add are read several times: cut them first. Keys are not null; those of add are among keys.
    """

    key: list[str]
    keys: DataFrame
    add: DataFrame


class Store:
    """Versioned tables under a folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, bucket_bytes: int = BUCKET_BYTES):
        self.spark, self.folder, self.buckets, self.bucket_bytes = spark, Folder(spark, folder), buckets, bucket_bytes
        self._owner: str | None = None

    def current(self) -> int:
        """The version that readers see; 0 before the first commit."""
        return max((int(n.split(".")[0]) for n in self.folder.names("manifests") if not n.startswith(".")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.current() if version is None else version
        text = self.folder.read(f"manifests/{version:012d}.json") if version else None
        if version and text is None:
            raise FileNotFoundError(f"version {version} is gone")
        return json.loads(text) if text else {"version": 0, "state": {}, "tables": {}}

    def read(self, table: str, version: int | None = None, values: list | None = None) -> DataFrame:
        """A table; with values of its one key, only the buckets that may hold them."""
        entry = self.manifest(version)["tables"].get(table)
        if entry is None:
            raise FileNotFoundError(f"no table {table}")
        if values is None:
            return self._rows(entry, None)
        found = self.spark.sql(f"SELECT DISTINCT CAST(pmod(xxhash64(x), {entry['n']}) AS INT) FROM (SELECT explode(:values) AS x)", args={"values": F.array(*map(F.lit, values))})
        return self._rows(entry, sorted(r[0] for r in found.collect()))

    def touched(self, table: str, keys: DataFrame) -> DataFrame:
        """The rows of these keys, from their buckets alone."""
        entry = self.manifest()["tables"][table]
        return self._rows(entry, self._buckets(entry["key"], keys, entry["n"])).join(keys.select(*entry["key"]).distinct(), entry["key"], "left_semi").select(*_names(entry))

    def _rows(self, entry: dict, buckets: list[int] | None) -> DataFrame:
        schema = StructType.fromJson(entry["schema"])
        held = entry["held"] if buckets is None else {b: at for b in map(str, buckets) if (at := entry["held"].get(b))}
        paths = [f"{self.folder.path}/data/{folder}/bucket__={b}" for b, (folder, _) in sorted(held.items())]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _bucket(key: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(n)).cast("int")

    def _buckets(self, key: list[str], keys: DataFrame, n: int) -> list[int]:
        return sorted(r[0] for r in keys.select(self._bucket(key, n)).distinct().collect())  # at most MOST_BUCKETS

    def _write(self, table: str, rows: DataFrame, key: list[str], n: int, order: tuple[str, ...] = ()) -> dict[str, list]:
        """Write rows in a new folder, in files sorted by key and order; the folder and bytes of each of their buckets."""
        at = f"{table}-{uuid.uuid4().hex}"
        dealt = rows.withColumn("bucket__", self._bucket(key, n)).hint("rebalance", F.col("bucket__"))
        written(dealt.sortWithinPartitions("bucket__", *key, *order), f"{self.folder.path}/data/{at}", "bucket__")
        made = [x.split("=")[1] for x in self.folder.names(f"data/{at}") if x.startswith("bucket__=")]
        return {b: [at, self.folder.size(f"data/{at}/bucket__={b}")] for b in made}

    def _write_in_passes(self, table: str, part: Callable[[list[int] | None], DataFrame], key: list[str], n: int, buckets: list[int], size: int, order: tuple[str, ...] = ()) -> dict[str, list]:
        """_write of part(None) if that is under PASS_BYTES; else in passes of about so much, so that the disk holds the shuffle files of one at a time.

        A pass writes some of the buckets in a folder of its own; part gives the rows that may lie in them.
        """
        passes, made = min(len(buckets), -(-size // PASS_BYTES)), {}
        if passes <= 1:
            return self._write(table, part(None), key, n, order)
        if stray := set(self._buckets(key, part(None), n)) - set(buckets):
            raise ValueError(f"{table}: rows of keys that were not named, in buckets {sorted(stray)}")
        for some in (buckets[i::passes] for i in range(passes)):
            made |= self._write(table, part(some).where(self._bucket(key, n).isin(some)), key, n, order)
        return made

    def _changed(self, table: str, change: Change, entry: dict | None) -> dict:
        key, n = change.key, entry["n"] if entry else self.buckets
        if entry and entry["key"] != key:
            raise ValueError(f"{table} is dealt by {entry['key']}")
        held = dict(entry["held"]) if entry else {}
        wanted = self._wanted(held, n)
        whole = wanted > n  # all of it is dealt anew, this once
        touched = None if whole else self._buckets(key, change.keys, n)
        keys = change.keys.select(*key).distinct()

        def part(buckets: list[int] | None) -> DataFrame:
            if not entry:
                return change.add
            old = self._rows(entry, None if whole else touched if buckets is None else buckets)
            return old.join(keys, key, "left_anti").select(*change.add.columns).unionByName(change.add)

        size = _file_bytes(change.add) + sum(size for b, (_, size) in held.items() if whole or int(b) in touched)
        made = self._write_in_passes(table, part, key, wanted, list(range(wanted)) if whole else touched, size)
        if not whole and (stray := set(made) - set(map(str, touched))):
            raise ValueError(f"{table}: rows of keys that were not named, in buckets {sorted(stray)}")
        kept = {} if whole else {b: at for b, at in held.items() if int(b) not in touched}
        return {"key": key, "n": wanted, "schema": json.loads(change.add.schema.json()), "held": kept | made}

    def _wanted(self, held: dict[str, list], n: int) -> int:
        total = sum(size for _, size in held.values())
        while n < MOST_BUCKETS and total > n * self.bucket_bytes:
            n *= 2
        return n

    def staged(self, table: str, key: list[str], rows: DataFrame) -> tuple[dict, DataFrame]:
        """Rows written ahead of the commit that publishes them as a whole table: its entry, and the rows, read again."""
        made = self._write_in_passes(table, lambda _: rows, key, self.buckets, list(range(self.buckets)), _file_bytes(rows))
        entry = {"key": key, "n": self.buckets, "schema": json.loads(rows.schema.json()), "held": made}
        return entry, self._rows(entry, None)

    def commit(self, changes: dict[str, Change], state: dict | None = None, whole: dict[str, tuple | dict] | None = None, drop: list[str] | None = None) -> int:
        """Publish the next version: tables changed by their keys, replaced (key, rows, more columns to sort by; or staged), dropped.

        state, if given, takes the place of the stored one. Under lock() only. Returns the version.
        """
        before = self.manifest()
        tables = {t: entry for t, entry in before["tables"].items() if t not in (drop or [])}
        for table, change in changes.items():
            tables[table] = self._changed(table, change, tables.get(table))
        for table, new in (whole or {}).items():
            if isinstance(new, dict):
                tables[table] = new
                continue
            key, rows, *order = new
            made = self._write_in_passes(table, lambda _, rows=rows: rows, key, self.buckets, list(range(self.buckets)), _file_bytes(rows), tuple(order))
            tables[table] = {"key": key, "n": self.buckets, "schema": json.loads(rows.schema.json()), "held": made}
        self._hold()
        version = before["version"] + 1
        self.folder.put(f"manifests/{version:012d}.json", json.dumps({"version": version, "state": before["state"] if state is None else state, "tables": tables}))
        return version

    def publish(self, tables: dict[str, DataFrame]) -> int:
        """Replace these tables whole, dealt by all their columns."""
        return self.commit({}, whole={name: (df.columns, df) for name, df in tables.items()})

    def vacuum(self, versions: int = KEPT_VERSIONS, seconds: float = KEPT_SECONDS) -> int:
        """Delete all but the newest versions and the folders that none of them names, if they are old enough; how many."""
        last, gone = self.current(), 0
        for name in self.folder.names("manifests"):
            if not name.startswith(".") and int(name.split(".")[0]) <= last - versions:
                self.folder.delete(f"manifests/{name}")
        named = {at for name in self.folder.names("manifests") for t in self.manifest(int(name.split(".")[0]))["tables"].values() for at, _ in t["held"].values()}
        for name in self.folder.names("data"):
            if name not in named and self.folder.age(f"data/{name}") >= seconds:
                self.folder.delete(f"data/{name}")
                gone += 1
        return gone

    @contextmanager
    def lock(self, seconds: float = LEASE_SECONDS) -> Iterator[None]:
        """One writer at a time; a second one fails at once, unless the first one's lease has run out."""
        found = self.folder.read("LEASE")
        if found is not None and (json.loads(found)["until"] < time.time() if found else self.folder.age("LEASE") > seconds):
            self.folder.delete("LEASE")
        owner = uuid.uuid4().hex
        self.folder.create("LEASE", json.dumps({"owner": owner, "until": time.time() + seconds}))
        self._owner = owner
        try:
            yield
        finally:
            self._owner = None
            if owner in (self.folder.read("LEASE") or ""):
                self.folder.delete("LEASE")

    def _hold(self) -> None:
        if not self._owner or self._owner not in (self.folder.read("LEASE") or ""):
            raise OSError("the writer's lease is not held")


def _names(entry: dict) -> list[str]:
    return [f["name"] for f in entry["schema"]["fields"]]


def _file_bytes(df: DataFrame) -> int:
    """The bytes of the files that df reads; 0 if it does more than read them, or not the same each time: it is then read once."""

    def of(plan) -> int:
        while plan.nodeName() in ("Project", "Filter"):
            plan = plan.children().head()
        return int(str(plan.stats().sizeInBytes())) if plan.nodeName().startswith(("Relation", "LogicalRelation")) else 0

    plan = df._jdf.queryExecution().optimizedPlan()
    return of(plan) if plan.deterministic() else 0
