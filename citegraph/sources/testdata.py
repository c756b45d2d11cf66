"""The knowledge-graph model over the driver's tables: items, entities, mentions, relations, facts and evidence.

Documents are files, conversations are messages, orders are mails from a customer to the suppliers of its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Model:
    """DataFrames of the model; each is a plan, read when it is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def files(self) -> DataFrame:
        """item_id, source_id, kind, title, uri, content_hash, text of documents."""
        uri = F.concat(F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
        return self.table("documents").select(
            F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("item_id"),
            F.col("source").alias("source_id"),
            F.lit("file").alias("kind"),
            F.concat(F.col("source"), F.lit(" "), F.col("lang"), F.lit(" "), F.col("doc_id").cast("string")).alias("title"),
            uri.alias("uri"),
            F.lit(None).cast("string").alias("modified_at"),
            F.sha2("text", 256).alias("content_hash"),
            "text",
        )

    def chunks(self) -> DataFrame:
        """A document is one chunk here: chunk_id, item_id, ord, text."""
        f = self.files()
        return f.select(F.concat("item_id", F.lit("#0")).alias("chunk_id"), "item_id", F.lit(0).alias("ord"), "text")

    def mails(self) -> DataFrame:
        return self.table("orders").select(
            F.concat(F.lit("mail:"), F.col("o_orderkey").cast("string")).alias("item_id"),
            F.lit("orders").alias("source_id"),
            F.lit("email").alias("kind"),
            F.col("o_orderpriority").alias("title"),
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("created_at"),
            F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("author"),
        )

    def messages(self) -> DataFrame:
        return self.table("conversations").select(
            F.concat_ws(":", F.lit("msg"), F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("item_id"), "conv_id", "turn", "role", "text"
        )

    def entities(self) -> DataFrame:
        person = lambda t, k, n, p: self.table(t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("entity_id"), F.lit("person").alias("kind"), F.col(n).alias("name"))
        return person("customer", "c_custkey", "c_name", "cust:").unionByName(person("supplier", "s_suppkey", "s_name", "supp:"))

    def recipients(self) -> DataFrame:
        """item_id, entity_id: the different suppliers of each order."""
        return self.table("lineitem").select(F.concat(F.lit("mail:"), F.col("l_orderkey").cast("string")).alias("item_id"), F.concat(F.lit("supp:"), F.col("l_suppkey").cast("string")).alias("entity_id")).distinct()

    def mentions(self) -> DataFrame:
        """entity_id, item_id, role; each triple once."""
        author = self.mails().select(F.col("author").alias("entity_id"), "item_id", F.lit("author").alias("role"))
        return author.unionByName(self.recipients().select("entity_id", "item_id", F.lit("recipient").alias("role")))

    def wrote(self) -> DataFrame:
        """The evidence of wrote_to: src, dst, item_id for each mail and different recipient."""
        return self.mails().select("item_id", F.col("author").alias("src")).join(self.recipients().withColumnRenamed("entity_id", "dst"), "item_id")

    def facts(self) -> DataFrame:
        """entity_id, key, value, confidence, item_id: the segment and nation of customers, cited by their mails."""
        nation = F.broadcast(self.table("nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))  # one row a nation
        c = self.table("customer").join(nation, "c_nationkey")
        pair = F.explode(F.array(F.struct(F.lit("organization").alias("key"), F.col("c_mktsegment").alias("value")), F.struct(F.lit("address").alias("key"), F.col("n_name").alias("value"))))
        return c.select(F.concat(F.lit("cust:"), F.col("c_custkey").cast("string")).alias("entity_id"), pair.alias("x")).select("entity_id", "x.key", "x.value", F.lit(0.95).alias("confidence"))
