"""Sharding by extendible hashing: only buckets over the byte limit split, one bit of the hash at a time.

The address of a row has 62 bits: 40 of the key's md5, then 22 of a hash of the row, which come into use where one key
alone has more bytes than a shard may hold. Rows that these bits don't part go on with the other 42 bits of their hashes,
which are different for all rows, so that every shard fits, and no row is lost. A first scan reduces the rows to (address, bytes). The directory starts at
the depth that an even spread needs; buckets over the limit split further, eight bits a round, and a round reads only
the rows of the buckets that are still too large. Everything is DataFrame operations; no bucket is gathered anywhere.

Defined results: a null text has 0 bytes; a null key has the address of ''. Repeated rows keep a row each. A row that
alone exceeds the limit gets a shard of its own (oversized is true). prefix is the address's leading bits down to a depth of
62; deeper shards, and those of oversized rows, are numbered. An empty table gives an empty result. Only key and
text are read, so other columns, whatever their names, do no harm.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import materialize, table

KEY_BITS, ROW_BITS, REST_BITS = 40, 22, 42
BITS = KEY_BITS + ROW_BITS
ROUND_BITS = 8
SHARD_BYTES = 64 << 20


def row_hash() -> Column:
    """64 bits of a row's place in its scan: different for different rows, as the hash of one long is one to one."""
    return F.xxhash64(F.monotonically_increasing_id())


def address_of(key: str) -> Column:
    """40 bits of the key's md5, above 22 bits of the row's hash."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    high = F.conv(F.substring(digest, 1, KEY_BITS // 4), 16, 10).cast("long")
    return F.shiftleft(high, ROW_BITS).bitwiseOR(F.shiftrightunsigned("__row", 64 - ROW_BITS))


def prefix(address: Column, bits: int, depth: int) -> Column:
    return F.shiftright(address, bits - depth)


def _leaves(cells: DataFrame, depth: int, top: int, limit: int, group: list[str]) -> DataFrame:
    """Of cells (group, cell at depth, bytes): each cell's bucket, the shallowest ancestor from depth top on within the limit.

    Null where the cell itself is still over it.
    """
    levels = cells.select(*group, "cell", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("at"), "bytes").select(
        *group, "at", F.expr(f"shiftright(cell, {depth} - at)").alias("bucket"), "cell", "bytes"
    )
    sums = levels.groupBy(*group, "at", "bucket").agg(F.sum("bytes").alias("bucket_bytes")).where(F.col("bucket_bytes") <= limit)
    found = levels.join(sums, [*group, "at", "bucket"]).groupBy(*group, "cell").agg(F.min_by(F.struct("at", "bucket", "bucket_bytes"), "at").alias("leaf"))
    return cells.join(found, [*group, "cell"], "left").select(*group, "cell", "leaf.at", "leaf.bucket", "leaf.bucket_bytes")


def _directory(rows: DataFrame, address: str, bits: int, top: int, limit: int, group: list[str]) -> tuple[DataFrame, DataFrame]:
    """(leaves, open cells): buckets over the limit split further, up to all bits; a round reads the rows of open cells."""
    directory, at, open_cells = None, top, None
    while True:
        depth = min(bits, at + ROUND_BITS)
        here = prefix(F.col(address), bits, at).alias("cell")
        todo = rows if open_cells is None else rows.withColumn("cell", here).join(open_cells, [*group, "cell"], "left_semi")
        cells = todo.groupBy(*group, prefix(F.col(address), bits, depth).alias("cell")).agg(F.sum("n_bytes").alias("bytes"))
        leaves = materialize(_leaves(cells, depth, at if open_cells is None else at + 1, limit, group), "shard-cells")
        closed = leaves.where("at is not null").select(F.lit(depth).alias("cell_depth"), *group, "cell", "at", "bucket", "bucket_bytes")
        directory = closed if directory is None else directory.unionByName(closed)
        open_cells = leaves.where("at is null").select(*group, "cell")
        if depth == bits or open_cells.isEmpty():
            return directory, open_cells
        at = depth


def _placed(rows: DataFrame, address: str, bits: int, directory: DataFrame, group: list[str]) -> DataFrame:
    """rows with the leaf of each; a round of splits each, nearly always the first alone."""
    depths = sorted(r[0] for r in directory.select("cell_depth").distinct().collect())
    parts = [rows.withColumn("cell", prefix(F.col(address), bits, d)).join(directory.where(F.col("cell_depth") == d), [*group, "cell"]) for d in depths]
    return reduce(DataFrame.unionByName, parts or [rows.withColumn("cell", F.col(address)).join(directory, [*group, "cell"])])


def extendible_shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """(key, n_bytes, depth, prefix, shard_bytes, oversized) for every row of df: its shard is (depth, prefix)."""
    return _shards(df, key, text, limit).withColumnRenamed("key", key)


def _shards(df: DataFrame, key: str, text: str, limit: int, *carried: Column) -> DataFrame:
    """extendible_shards with the carried columns beside key."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = df.select(*carried, F.col(key).alias("key"), size.alias("n_bytes"), row_hash().alias("__row")).withColumn("address", address_of("key"))
    names = [*rows.columns[: len(carried)], "key", "n_bytes"]
    rows = materialize(rows, "shard-rows")
    fit = rows.where(F.col("n_bytes") <= limit)
    total = fit.agg(F.sum("n_bytes")).first()[0] or 0
    top = min(BITS - ROUND_BITS, max(0, math.floor(math.log2(max(1, total / limit)))))
    directory, still_open = _directory(fit, "address", BITS, top, limit, [])
    leaf = [F.col("at").alias("depth"), F.col("bucket").alias("prefix"), F.col("bucket_bytes").alias("shard_bytes"), F.lit(False).alias("oversized")]
    out = [_placed(fit, "address", BITS, directory, []).select(*names, *leaf)]
    if not still_open.isEmpty():  # rows of one key that even the address does not part: by the rest of their hashes
        deep = fit.join(still_open.withColumnRenamed("cell", "address"), "address", "left_semi").withColumn("rest", F.col("__row").bitwiseAND(F.lit((1 << REST_BITS) - 1)))
        deep = materialize(deep, "shard-deep")
        leaves, _ = _directory(deep, "rest", REST_BITS, 0, limit, ["address"])
        numbers = materialize(leaves.select("address", "at", "bucket").distinct().select("*", F.monotonically_increasing_id().alias("number")), "shard-numbers")
        placed = _placed(deep, "rest", REST_BITS, leaves, ["address"]).join(numbers, ["address", "at", "bucket"])
        out.append(placed.select(*names, (F.col("at") + BITS).alias("depth"), F.col("number").alias("prefix"), *leaf[2:]))
    over = rows.where(F.col("n_bytes") > limit)
    out.append(over.select(*names, F.lit(BITS + REST_BITS + 1).alias("depth"), F.monotonically_increasing_id().alias("prefix"), F.col("n_bytes").alias("shard_bytes"), F.lit(True).alias("oversized")))
    return reduce(DataFrame.unionByName, out)


def write_shards(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES) -> None:
    """Write the rows of df under path, a folder for each shard. Each row is carried to its shard, keys may repeat."""
    shard = F.format_string("%02d-%x", "depth", "prefix").alias("shard")
    dealt = _shards(df, key, text, limit, F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")).select(shard, "row")
    dealt.repartition("shard").select("row.*", "shard").write.partitionBy("shard").parquet(path)


def op7_extendible_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "depth", "prefix", "shard_bytes", "oversized")


def shards_sql(limit: int) -> str:
    """DuckDB SQL of the same directory for unique keys: levels 0 to 40 of the key's bits."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
        ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 10))::BIGINT AS address FROM documents),
g AS (SELECT greatest(0, floor(log2(greatest(1, coalesce(sum(n_bytes), 0) / {limit}))))::INT AS top FROM d WHERE n_bytes <= {limit}),
l AS (SELECT d.*, lvl::INT AS depth, address >> (40 - lvl::INT) AS prefix FROM d, g, range(0, 41) r(lvl) WHERE n_bytes <= {limit} AND lvl >= top),
s AS (SELECT *, (sum(n_bytes) OVER (PARTITION BY depth, prefix))::BIGINT AS shard_bytes FROM l)
SELECT doc_id, n_bytes, depth, prefix::BIGINT AS prefix, shard_bytes, false AS oversized FROM s WHERE shard_bytes <= {limit}
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY depth) = 1"""


OP7_SQL = shards_sql(SHARD_BYTES)
