"""Filter interaction audit by permutation-trie execution: what each filter removes after each set of earlier filters.

All orders of k filters form a trie of prefixes. What survives a prefix does not depend on its order, so the trie is
walked depth first over unordered prefix states: a state's survivors are a persisted DataFrame, made from its parent's
by applying one more filter, and a state that another order has reached before is not run again. For every edge (state,
next filter) one aggregate over the survivors counts what the filter actually removes; a report of all orders is then a
lookup of edges. At most k + 1 states are persisted at a time; a lost block is made again from the written root rows.

Failures are boolean columns of the root rows, so texts are read once, whatever the number of states. Equality of texts
(filter E) is that of their SHA-256; only digests that occur twice are joined back, and they are pre-aggregated.

Defined results: a null text is empty, a null part is ''. A row whose failure is null passes. A null doc_id is not
smaller than another and no id is smaller than it; it has no labels. Repeated rows count as often as they occur, and as
rows of one id are not copies of each other. Repeated labels of an id count once, the largest value. An empty table has
no parts and gives an empty result. Only doc_id, text and lang are read, so other columns, whatever their names, do no harm.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citegraph.llm.common import WORD_BREAK, Tables, materialize, table, text_of

MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_UPPER_PERCENT = 200, 50, 3
SYMBOL = "[#$%&*|]"


def edges(rows: DataFrame, filters: list[str], part: str, lost: list[str]) -> DataFrame:
    """(part, state, filter, alive, removed, *lost) of every edge: rows alive in the state, and removed by the filter.

    rows has a boolean column for each filter (the row fails it) and for each of lost (count it where it is removed).
    state is the sum of 2**i of the filters applied before, by their place in filters. Every part has every edge.
    """
    spark = rows.sparkSession
    flags = [F.coalesce(F.col(f"`{c}`"), F.lit(False)).alias(f"__{c}") for c in (*filters, *lost)]
    seen, counted = set(), []

    def visit(state: int, survivors: DataFrame, tables: Tables) -> None:
        seen.add(state)
        left = [(i, f) for i, f in enumerate(filters) if not state >> i & 1]
        if not left:
            return
        survivors = survivors.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            counts = [F.struct(F.lit(f).alias("filter"), F.count_if(f"__{f}").alias("removed"), *[F.count_if(F.col(f"__{f}") & F.col(f"__{c}")).alias(c) for c in lost]) for _, f in left]
            sums = survivors.groupBy("__part").agg(F.count("*").alias("alive"), F.array(*counts).alias("edges"))
            sums = sums.select(F.col("__part").alias("part"), F.lit(state).alias("state"), "alive", F.explode("edges").alias("e"))
            counted.append(tables.write(sums.select("part", "state", "e.filter", "alive", "e.removed", *[f"e.{c}" for c in lost]), f"state-{state}"))
            for i, f in left:
                if state | 1 << i not in seen:
                    visit(state | 1 << i, survivors.where(~F.col(f"__{f}")), tables)
        finally:
            survivors.unpersist()

    with Tables(spark, "audit") as tables:
        root = tables.write(rows.select(F.coalesce(F.col(part).cast("string"), F.lit("")).alias("__part"), *flags), "root")
        visit(0, root, tables)
        found = reduce(DataFrame.unionByName, counted)
        # Edges out of states where a part has no survivors: zeros.
        own = root.select(F.col("__part").alias("part")).distinct().withColumn("state", F.explode(F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))))
        own = own.select("part", "state", F.posexplode(F.array(*map(F.lit, filters))).alias("i", "filter")).where("shiftright(state, i) % 2 = 0").drop("i")
        zeros = {c: F.coalesce(c, F.lit(0)).cast("long") for c in ("alive", "removed", *lost)}
        return materialize(own.join(found, ["part", "state", "filter"], "left").withColumns(zeros), "audit-edges")


def report(edges: DataFrame, filters: list[str], lost: list[str]) -> DataFrame:
    """A row for each part, order of all filters and step: what was kept, removed and already gone, from the edges."""
    bits = {f: 1 << i for i, f in enumerate(filters)}
    orders = [(sum(bits[g] for g in order[:k]), f, "".join(order), k + 1) for order in permutations(filters) for k, f in enumerate(order)]
    steps = F.broadcast(edges.sparkSession.createDataFrame(orders, "state int, filter string, filter_order string, step int"))  # k * k! rows
    rows = edges.join(steps, ["state", "filter"])
    own = Window.partitionBy("part", "filter")  # k! rows each
    others = F.lit((1 << len(filters)) - 1) - F.element_at(F.create_map(*[F.lit(x) for pair in bits.items() for x in pair]), F.col("filter"))
    alone = F.max(F.when(F.col("state") == others, F.col("removed"))).over(own)
    failing = F.max(F.when(F.col("state") == 0, F.col("removed"))).over(own)
    return rows.select(
        *["part", "filter_order", "step", "filter"],
        (F.col("alive") - F.col("removed")).alias("kept"),
        *["removed", (failing - F.col("removed")).alias("redundant"), alone.alias("unique_fails"), *lost],
        F.sum("removed").over(own).alias("shapley"),
    )


def text_failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good_lost, toxic_lost) of every document: which of the five conditions it fails, and its labels."""
    text = text_of()
    parts = docs.select("doc_id", F.col("lang").alias("part"), text.alias("text"), F.array_remove(F.split(text, WORD_BREAK), "").alias("words"))
    upper = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    with Tables(docs.sparkSession, "audit-text") as tables:
        scan = tables.write(
            parts.select(
                *["doc_id", "part", (F.size("words") < MIN_WORDS).alias("A")],
                (100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * F.size("words")).alias("B"),
                (100 * upper > MAX_UPPER_PERCENT * F.length("text")).alias("C"),
                F.col("text").rlike(SYMBOL).alias("D"),
                F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
            ),
            "scan",
        )
        # A table of its own, so that the join below has two plain exchanges and a digest of many rows can be split.
        copied = tables.write(scan.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "copied")
        marks = labels.groupBy("doc_id").agg((F.max("quality") == 1).alias("good_lost"), (F.max("toxic") == 1).alias("toxic_lost"))
        rows = scan.join(copied, "digest", "left").join(marks, "doc_id", "left")
        later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
        return materialize(rows.select("part", "A", "B", "C", "D", later.alias("E"), "good_lost", "toxic_lost"), "audit-rows")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters, lost = list("ABCDE"), ["good_lost", "toxic_lost"]
    rows = text_failures(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return report(edges(rows, filters, "part", lost), filters, lost).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", *lost, "shapley")


OP12_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS earliest FROM d),
f AS (SELECT doc_id, part, [len(words) < {MIN_WORDS}, 100 * len(list_distinct(words)) < {MIN_DISTINCT_PERCENT} * len(words),
        100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MAX_UPPER_PERCENT} * length(text), regexp_matches(text, '{SYMBOL}'),
        coalesce(doc_id > earliest, false)] AS fails FROM w),
l AS (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, list_sum(list_transform([1, 2, 3, 4, 5], lambda i: CASE WHEN fails[i] THEN 1 << (i - 1) ELSE 0 END))::BIGINT AS mask,
        count(*) AS n, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || e.c || g.c || h.c AS filter_order FROM x a, x b, x e, x g, x h WHERE len(list_distinct([a.c, b.c, e.c, g.c, h.c])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
t AS (SELECT *, 1 << (ascii(filter_order[step]) - 65) AS bit,
        coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(filter_order[i]) - 65))), 0)::BIGINT AS before FROM s),
r AS (SELECT part, filter_order, step::INT AS step, bit, coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0)::BIGINT AS toxic_lost
    FROM m, t GROUP BY ALL)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r"""
