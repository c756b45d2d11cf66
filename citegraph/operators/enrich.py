"""Tier-1 enrichment: candidates, batches, strict validation of labels, and what accepted labels add."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegraph.functions import text as T

#: The types of documents, the relations of people to the user, and what a keyword looks like.
DOC_TYPES = ("contract", "invoice", "receipt", "payslip", "tax", "bank", "insurance", "medical", "identity", "housing", "travel", "school", "work", "personal", "photo", "other")
RELATIONS = ("sibling", "parent", "child", "spouse", "partner", "friend", "colleague", "manager", "landlord", "doctor", "family", "other", "unknown")
KEYWORD = r"^[\p{L}\p{N}_][\p{L}\p{N}_ '\-]{0,29}$"
LONGEST_TOPIC, MOST_KEYWORDS, CONFIDENCE, BATCH = 60, 8, 0.7, 50
SCHEMA = "id string, version string, doc_type string, topic string, keywords array<string>"


def file_candidates(items: DataFrame, labelled: DataFrame, pending: DataFrame) -> DataFrame:
    """Files without labels that no open batch holds."""
    return items.where("kind = 'file'").join(labelled.select("item_id"), "item_id", "left_anti").join(pending.select("item_id"), "item_id", "left_anti")


def batches(candidates: DataFrame, size: int = BATCH, batches_per_partition: int = 1 << 20) -> DataFrame:
    """candidates with a batch number by hash of the id, about size rows a batch."""
    n = max(1, -(-candidates.count() // size))
    return candidates.withColumn("batch", F.pmod(F.xxhash64("item_id"), F.lit(n)))


def estimate(strings: DataFrame, column: str = "text", size: int = BATCH) -> DataFrame:
    """One row: strings, batches, tokens (words and a third)."""
    words = F.sum(F.size(F.filter(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda w: w != "")))
    return strings.agg(F.count("*").alias("strings"), F.ceil(F.count("*") / size).alias("batches"), F.ceil(F.coalesce(words, F.lit(0)) * 4 / 3).alias("tokens"))


def validated(answers: DataFrame, known: DataFrame, phrases: list[str]) -> DataFrame:
    """answers (raw JSON, a row each) with the parsed label and the reason why it is refused, null if it is not.

    An answer names a known item once, at its present version, with values of the closed lists and clean words.
    """
    parsed = answers.select("raw", F.from_json("raw", SCHEMA).alias("l"), F.json_object_keys("raw").alias("keys"))
    rows = parsed.select("raw", "keys", "l.*").join(known.select(F.col("item_id").alias("id"), F.col("version").alias("now")), "id", "left")
    times = rows.where("id is not null").groupBy("id").agg(F.count("*").alias("times"))
    words = F.concat_ws(" ", "topic", F.array_join("keywords", " "))
    unknown_keys = F.size(F.array_except("keys", F.array(*[F.lit(k) for k in ("id", "version", "doc_type", "topic", "keywords")]))) > 0
    reason = (
        F.when(F.col("keys").isNull() | F.col("id").isNull(), "not a label")
        .when(unknown_keys, "unknown field")
        .when(F.col("now").isNull(), "unknown id")
        .when(F.col("times") > 1, "duplicate id")
        .when(~F.col("doc_type").isin(*DOC_TYPES) | F.col("doc_type").isNull(), "unknown type")
        .when((F.length("topic") > LONGEST_TOPIC) | (F.size("keywords") > MOST_KEYWORDS), "too long")
        .when(F.exists("keywords", lambda k: ~k.rlike(KEYWORD)), "not a keyword")
        .when(T.risk_score(words, phrases) >= T.FLAG_AT, "unsafe text")
        .when(F.col("version") != F.col("now"), "stale")
    )
    return rows.join(times, "id", "left").select("raw", "id", "doc_type", "topic", "keywords", reason.alias("refused"))


def applied(labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts (item_id, key, value, confidence) and keyword chunks (item_id, ord -1, text) of accepted labels."""
    good = labels.where("refused is null")
    pair = F.explode(F.array(F.struct(F.lit("doc_type").alias("key"), F.col("doc_type").alias("value")), F.struct(F.lit("topic").alias("key"), F.col("topic").alias("value"))))
    facts = good.select(F.col("id").alias("item_id"), pair.alias("x")).select("item_id", "x.key", "x.value", F.lit(CONFIDENCE).alias("confidence")).where("value is not null and value <> ''")
    chunks = good.where(F.size("keywords") > 0).select(F.col("id").alias("item_id"), F.lit(-1).alias("ord"), F.array_join("keywords", " ").alias("text"))
    return facts, chunks
