"""Quality rules: a table of thresholds compiled into one Spark projection.

Every measure is a column expression over the whole text; a rule is a row of the table with a lower and an upper
bound. Nothing is shuffled and no Python runs on the executors.

Defined results: a null text has no words, so it fails the base rules and is not kept. Repeated rows each get their own
row. Columns of the input other than the id and the text are never read, so names that clash do no harm; an empty table
gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citegraph.llm.common import WORD_BREAK, table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
SYMBOLS = "[#*$%&|<>]"

#: Function words of seven languages; a text of 50 words and more should have some.
STOP_WORDS = tuple(
    (
        "the of and to in a is that for it was on are be with as at by this from or an have not "
        "der die das und den von zu mit ist im auf für nicht ein eine dem des sich als auch "
        "de la le et les des en un une que est pour dans qui sur par au du pas avec "
        "el los las y del se por con su para como una no al lo "
        "il di che e non per della con gli da o os um uma do dos het een van dat op te"
    ).split()
)


class Rule(NamedTuple):
    measure: str
    least: float | None
    most: float | None


#: The table. Ratios are shares of words, of characters in words, or of lines with a word.
RULES = (
    Rule("mean_word_length", 2.0, 16.0),
    Rule("symbol_ratio", None, 0.1),
    Rule("stop_word_ratio", 0.02, None),
    Rule("upper_ratio", None, 0.4),
    Rule("dup_line_ratio", None, 0.4),
    Rule("bullet_line_ratio", None, 0.9),
    Rule("ellipsis_line_ratio", None, 0.3),
)


def _repeated_words(frame: DataFrame) -> DataFrame:
    """n_repeat_words: words inside windows of eight words whose hash is found at two or more places of the text.

    Each step is a projection of its own: it keeps an array as an attribute, where a lambda over an inlined
    expression would build that array again for each element.
    """
    word = F.col("__word_hashes")
    windows = F.transform(F.sequence(F.lit(0), F.col("__n") - WINDOW), lambda i: F.xxhash64(*[F.get(word, i + k) for k in range(WINDOW)]))
    frame = frame.withColumn("__windows", F.when(F.col("__n") >= WINDOW, windows))
    hashes = F.col("__windows")
    placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    frame = frame.withColumn("__placed", F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), placed)).drop("__windows")
    p = F.col("__placed")
    twice = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]))
    frame = frame.withColumn("__starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("__placed")
    covered = F.aggregate(
        F.col("__starts"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda acc, i: F.struct((i + WINDOW).alias("end"), (acc["total"] + i + WINDOW - F.greatest(i, acc["end"])).alias("total")),
        lambda acc: acc["total"],
    )
    return frame.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("__starts")


def quality_measures(df: DataFrame, keep: list[Column], text: str = "text") -> DataFrame:
    """The counts and ratios of every row's text, beside the columns in keep."""
    text_column = F.coalesce(F.col(text).cast("string"), F.lit(""))
    frame = df.select(
        F.struct(F.lit(0), *keep).alias("__keep"),  # apart, whatever its columns are called
        text_column.alias("__text"),
        F.array_remove(F.split(text_column, WORD_BREAK), "").alias("__words"),
        F.filter(F.split(text_column, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"),
    )
    words, lines, body = F.col("__words"), F.col("__lines"), F.col("__text")
    frame = frame.select(
        "__keep",
        F.size(words).alias("__n"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        F.regexp_count(body, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.regexp_count(body, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("__word_hashes"),
    )
    frame = _repeated_words(frame).withColumn("n_words", F.col("__n").cast("long"))
    n, n_lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    names = [f.name for f in frame.schema["__keep"].dataType.fields[1:]]
    return frame.select(
        *[F.col(f"__keep.`{c}`") for c in names],
        *["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
        (F.col("word_chars") / n).alias("mean_word_length"),
        (F.col("n_symbols") / n).alias("symbol_ratio"),
        ((F.col("n_stop_words") + 1) / n).alias("stop_word_ratio"),
        (F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper_ratio"),
        (F.col("n_dup_lines") / n_lines).alias("dup_line_ratio"),
        (F.col("n_bullet_lines") / n_lines).alias("bullet_line_ratio"),
        (F.col("n_ellipsis_lines") / n_lines).alias("ellipsis_line_ratio"),
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """base_failed and kept, from the columns of quality_measures."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    kept = ~failed
    for r in rules:
        if r.least is not None:
            kept = kept & (F.col(r.measure) >= r.least)
        if r.most is not None:
            kept = kept & (F.col(r.measure) <= r.most)
    return failed, kept


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows of df that the rules keep, with the columns they came with.

    The verdict stands in a projection with a row number: a filter on it is not pushed down, where its measures would
    be written out, and worked out, once for each place that names them.
    """
    measured = quality_measures(df, [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")], text)
    judged = measured.select("row", verdict(rules)[1].alias("__kept"), F.monotonically_increasing_id().alias("__at"))
    return judged.where(F.col("__kept") & (F.col("__at") >= 0)).select("row.*")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed, kept = verdict()
    return quality_measures(table(spark, sf_dir, "documents"), [F.col("doc_id")]).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), kept.alias("kept")
    )


def rules_sql(source: str, columns: str) -> str:
    """DuckDB SQL of the same measures and verdict; columns: the expressions that it returns, over m."""
    bounds = [f"{r.measure} >= {r.least}" for r in RULES if r.least is not None] + [f"{r.measure} <= {r.most}" for r in RULES if r.most is not None]
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH src AS (SELECT row_number() OVER () AS rid, d.* FROM {source} d),
t AS (SELECT *, coalesce(text, '') AS body,
        list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM src),
win AS (SELECT rid, i, words[i:i + 7] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM t)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(*) AS n FROM (SELECT DISTINCT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
c AS (SELECT t.*, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(body, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(body, '\p{{Lu}}')) AS n_upper,
        len(list_filter(words, lambda w: lower(w) IN ({stop}))) AS n_stop, len(lines) AS n_lines,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
        len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullet,
        len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM t LEFT JOIN rep USING (rid)),
r AS (SELECT *, word_chars / greatest(n_words, 1) AS mean_word_length, n_symbols / greatest(n_words, 1) AS symbol_ratio,
        (n_stop + 1) / greatest(n_words, 1) AS stop_word_ratio, n_upper / greatest(word_chars, 1) AS upper_ratio,
        n_dup_lines / greatest(n_lines, 1) AS dup_line_ratio, n_bullet / greatest(n_lines, 1) AS bullet_line_ratio,
        n_ellipsis / greatest(n_lines, 1) AS ellipsis_line_ratio,
        n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM c),
m AS (SELECT *, NOT base_failed AND {" AND ".join(bounds)} AS kept FROM r)
SELECT {columns} FROM m"""


OP4_SQL = rules_sql("documents", "doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept")
