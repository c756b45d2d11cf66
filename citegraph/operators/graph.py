"""Graph operators: neighbours, timelines, threads, origins, facts with evidence, identity by connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Nodes whose labels are sent to all tasks in a round of communities; links of a part; links of a level that one task moves.
SENT_NODES, PART_LINKS, LOCAL_LINKS = 2_000_000, 500_000, 1_000_000


def relation_weights(evidence: DataFrame) -> DataFrame:
    """(src, dst, weight), with the type if evidence has one: a relation weighs as much as it has evidence rows."""
    return evidence.where("src <> dst").groupBy("src", "dst", *[c for c in evidence.columns if c == "type"]).agg(F.count("*").alias("weight"))


def neighbours(relations: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entity_id, other_id, weight) of edges out of and into the seeds: two equi-joins, never an OR."""
    out = relations.join(seeds, relations["src"] == seeds["entity_id"]).select("entity_id", F.col("dst").alias("other_id"), "weight")
    back = relations.join(seeds, relations["dst"] == seeds["entity_id"]).select("entity_id", F.col("src").alias("other_id"), "weight")
    return out.unionByName(back)


def met(people: DataFrame, most: int = 10, organizers: DataFrame | None = None) -> DataFrame:
    """(src, dst, item_id) of all unordered pairs of an item's people, for items of at most so many.

    organizers (item_id, organizer) count as people; a larger item relates its organizer to everyone else.
    """
    people = people.select("item_id", "entity_id")
    if organizers is not None:
        organizers = organizers.select("item_id", "organizer").where("organizer is not null").distinct()
        people = people.unionByName(organizers.withColumnRenamed("organizer", "entity_id")).where("entity_id is not null").distinct()
    own = people.groupBy("item_id").agg(F.array_sort(F.slice(F.collect_set("entity_id"), 1, most + 1)).alias("own"))
    first = own.where(F.size("own") <= most).select("item_id", "own", F.posexplode("own").alias("i", "src"))
    pairs = first.select("src", F.explode(F.slice("own", F.col("i") + 2, F.lit(most))).alias("dst"), "item_id")
    if organizers is None:
        return pairs
    large = organizers.join(own.where(F.size("own") > most).select("item_id"), "item_id", "left_semi")
    return pairs.unionByName(large.join(people, "item_id").where("entity_id <> organizer").select(F.col("organizer").alias("src"), F.col("entity_id").alias("dst"), "item_id"))


def first_of(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def edges_among(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    ids = nodes.select("entity_id")
    return relations.join(ids.withColumnRenamed("entity_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("entity_id", "dst"), "dst", "left_semi")


def mention_counts(mentions: DataFrame, distinct_items: bool) -> DataFrame:
    n = F.countDistinct("item_id") if distinct_items else F.count("*")
    return mentions.groupBy("entity_id").agg(n.alias("n"))


def timeline(items: DataFrame, mentions: DataFrame, entity: str, since: str | None, until: str | None, limit: int) -> DataFrame:
    """Items that mention the entity in a range of dates, newest first; each item once."""
    own = items.join(mentions.where(F.col("entity_id") == entity).select("item_id"), "item_id", "left_semi")
    own = own if since is None else own.where(F.col("created_at") >= since)
    own = own if until is None else own.where(F.col("created_at") <= until)
    return own.orderBy(F.desc("created_at"), "item_id").limit(limit)


def contact_dates(items: DataFrame, mentions: DataFrame, now: str) -> DataFrame:
    """(entity_id, last_contact, next_meeting): the latest item up to now, and the earliest after it."""
    both = mentions.select("entity_id", "item_id").join(items.select("item_id", "created_at"), "item_id")
    return both.groupBy("entity_id").agg(F.max(F.when(F.col("created_at") <= now, F.col("created_at"))).alias("last_contact"), F.min(F.when(F.col("created_at") > now, F.col("created_at"))).alias("next_meeting"))


def same_content(left: DataFrame, right: DataFrame, most: int) -> DataFrame:
    """(item_id, other_id) of other items with the same bytes, at most so many each, by id.

    Copies are kept as sorted lists of the first ids for each hash, so a hash that a third of all items share costs each
    of them a short list and never a pair with every copy.
    """
    few = right.select("content_hash", F.col("item_id").alias("other_id"))
    few = first_of(few.withColumn("__salt", F.pmod(F.xxhash64("other_id"), F.lit(64))), ["content_hash", "__salt"], [F.col("other_id")], most + 1)
    few = first_of(few, ["content_hash"], [F.col("other_id")], most + 1).select("content_hash", "other_id")
    pairs = left.select("item_id", "content_hash").join(few, "content_hash").where("item_id <> other_id")
    return first_of(pairs, ["item_id"], [F.col("other_id")], most).select("item_id", "other_id")


def components(pairs: DataFrame, node: str, key: str, cut) -> DataFrame:
    """(node, component) of a bipartite graph: nodes that share keys, named by the least node.

    Each round passes the least label through keys and jumps to the label's own label, so long chains halve. cut must
    end the lineage (a checkpoint).
    """
    pairs = cut(pairs.select(F.col(node).alias("node"), F.col(key).alias("key")).where("node is not null and key is not null").distinct())
    labels = cut(pairs.select("node").distinct().withColumn("label", F.col("node")))
    while True:  # labels only fall, so this ends
        by_key = pairs.join(labels, "node").groupBy("key").agg(F.min("label").alias("label"))
        seen = pairs.join(by_key, "key").groupBy("node").agg(F.min("label").alias("label"))
        jump = seen.join(labels.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left")
        new = cut(jump.select("node", F.least("label", F.coalesce("next", "label")).alias("label")))
        if new.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").isEmpty():
            break
        labels = new
    return labels.select("node", F.col("label").alias("component"))


def communities(edges: DataFrame, cut, me: DataFrame | None = None, patience: int = 4) -> DataFrame:
    """(entity_id, community) by modularity over undirected edges (src, dst, weight): local moves, then contraction, by level.

    Weights of both directions are summed; the entities in me (entity_id) are left out. In a round every node weighs its
    neighbours' communities by what modularity gains, from its edges to them, its degree and their totals; a half of the
    nodes, another one each round, moves. A level ends when none wants to move or the best modularity has stood for some
    rounds; its communities are the next level's nodes. It ends when a level gains nothing. The best labels seen are kept, so
    modularity never falls from level to level. Communities are named by their least member; the result for a given graph
    is the same each time. cut must end the lineage.

    Nodes are numbers: the places of their names in order. A level's links are dealt by node once and kept; a round sends the
    labels of up to SENT_NODES nodes to all tasks and moves no link, and joins the links with the labels of more. The rounds
    of a level of at most LOCAL_LINKS links run in one task, with the same result.
    """
    if me is not None:
        for c in ("src", "dst"):
            edges = edges.join(me.select(F.col("entity_id").alias(c)), c, "left_anti")
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    flat = cut(edges.where("src <> dst").groupBy(a.alias("a"), b.alias("b")).agg(F.sum("weight").cast("double").alias("w")))
    total = flat.agg(F.sum("w") * 2).first()[0]
    members = names = _numbered(flat.select(F.explode(F.array("a", "b")).alias("entity_id")).distinct(), cut)
    ends = flat.join(members.toDF("a", "x"), "a").join(members.toDF("b", "y"), "b")
    both = F.array(F.struct(F.col("x").alias("node"), F.col("y").alias("other"), "w"), F.struct(F.col("y").alias("node"), F.col("x").alias("other"), "w"))
    links = cut(ends.select(F.inline(both)))  # both ways; inside a node once a way
    best = -1.0
    while total:
        hashes = links.select("node").distinct().join(names, "node").select("node", "entity_id", F.xxhash64("entity_id").alias("hash"))
        labels, quality = (_moved_in_one_task if links.count() <= LOCAL_LINKS else _moved)(links, cut(hashes), total, patience, cut)
        if quality <= best + 1e-9:
            break
        best = quality
        members = cut(members.join(labels, "node").select("entity_id", F.col("label").alias("node")))
        sent = _sent(labels)
        ends = links.join(sent(labels.toDF("node", "x")), "node").join(sent(labels.toDF("other", "y")), "other")
        links = cut(ends.groupBy("x", "y").agg(F.sum("w").alias("w")).toDF("node", "other", "w"))
    first = members.groupBy("node").agg(F.min("entity_id").alias("community"))
    return members.join(first, "node").select("entity_id", "community")


def _numbered(names: DataFrame, cut) -> DataFrame:
    """(entity_id, node): the place of each name in their order, from 0, however the rows are dealt."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # in its part
    rows = cut(names.repartitionByRange("entity_id").sortWithinPartitions("entity_id").select("entity_id", F.spark_partition_id().alias("part"), place.alias("place")))
    starts, n = [], 0
    for part, size in sorted(tuple(r) for r in rows.groupBy("part").agg(F.count("*")).collect()):  # a row for each part
        starts.append((part, n))
        n += size
    starts = names.sparkSession.createDataFrame(starts, "part int, start long")
    return cut(rows.join(F.broadcast(starts), "part").select("entity_id", (F.col("start") + F.col("place")).alias("node")))


def _sent(nodes: DataFrame):
    """What marks a side of a join with a row for each node: sent to all tasks up to SENT_NODES."""
    return F.broadcast if nodes.count() <= SENT_NODES else lambda df: df


def _hash_with(round_: int, hashes: np.ndarray) -> np.ndarray:
    """xxhash64(name, round) of the names with these hashes: Spark's hash of the one is the seed of the other's."""
    one, two, three, five = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))
    h = (hashes.view(np.uint64) + five + np.uint64(4)) ^ (np.array([round_], np.uint64) * one)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * two + three
    h = (h ^ (h >> np.uint64(33))) * two
    h = (h ^ (h >> np.uint64(29))) * three
    return h ^ (h >> np.uint64(32))


def _rounds(node: np.ndarray, other: np.ndarray, w: np.ndarray, hashes: np.ndarray, total: float, patience: int) -> tuple[np.ndarray, float]:
    """The labels of nodes from 0 after the local moves, and their modularity."""
    n = len(hashes)
    k, loops = np.bincount(node, w, n), node == other
    inner, outer = w[loops].sum(), ~loops
    every = np.arange(n)
    node, other, w = np.concatenate([node[outer], every]), np.concatenate([other[outer], every]), np.concatenate([w[outer], np.zeros(n)])
    order = ~hashes  # falls as hashes rise
    now, best, stood, round_ = every, -1.0, 0, 0
    while True:
        tot = np.bincount(now, k, n)
        pairs, at = np.unique(node * n + now[other], return_inverse=True)
        votes, of, label = np.bincount(at, w), pairs // n, pairs % n
        own = label == now[of]
        gain = _half_up(votes - k[of] * (tot[label] - np.where(own, k[of], 0.0)) / total)
        rank = np.lexsort((order[label], gain, of))
        chosen = rank[np.r_[of[rank][1:] != of[rank][:-1], True]]
        wants = gain[chosen] > gain[own]
        quality = (votes[own].sum() + inner) / total - ((tot / total) ** 2).sum()
        if quality > best + 1e-9:
            best, found, stood = quality, now, 0
        else:
            stood += 1
        if stood >= patience or not wants.any():
            return found, best
        goes = wants & (_hash_with(round_, hashes) % np.uint64(2) == 0)
        now = np.where(goes, label[chosen], now)
        round_ += 1


def _half_up(x: np.ndarray) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) * 1e9 + 0.5) / 1e9


def _moved_in_one_task(links: DataFrame, hashes: DataFrame, total: float, patience: int, cut) -> tuple[DataFrame, float]:
    """_moved for a level of at most LOCAL_LINKS links."""

    def moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        names = table.filter(pc.is_null(table["other"])).sort_by("node")
        ends, nodes = table.filter(pc.is_valid(table["other"])), names["node"].to_numpy()
        place = lambda c: np.searchsorted(nodes, ends[c].to_numpy())
        labels, quality = _rounds(place("node"), place("other"), ends["w"].to_numpy(), names["hash"].to_numpy(), total, patience)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[labels]), pa.array(np.full(len(nodes), quality))], ["node", "label", "quality"])

    rows = links.select("node", "other", "w", F.lit(None).cast("long").alias("hash"))
    rows = rows.unionByName(hashes.select("node", F.lit(None).cast("long").alias("other"), F.lit(None).cast("double").alias("w"), "hash"))
    made = cut(rows.coalesce(1).mapInArrow(moved, "node long, label long, quality double"))
    return made.select("node", "label"), made.first()["quality"]


def _moved(links: DataFrame, hashes: DataFrame, total: float, patience: int, cut) -> tuple[DataFrame, float]:
    """(node, label) after the local moves of one level, and their modularity. hashes: (node, entity_id, hash), the names of nodes."""
    loop = F.col("node") == F.col("other")
    degrees = cut(links.groupBy("node").agg(F.sum("w").alias("k"), F.sum(F.when(loop, F.col("w")).otherwise(0.0)).alias("self")))
    sent = _sent(degrees)
    own_links = degrees.select("node", F.col("node").alias("other"), F.lit(0.0).alias("w"), "k")  # by which a node knows its own label
    rows = links.where(~loop).join(sent(degrees.select("node", "k")), "node").select("node", "other", "w", "k").unionByName(own_links)
    parts = max(links.sparkSession.sparkContext.defaultParallelism, -(-links.count() // PART_LINKS))
    held = rows.repartition(parts, "node").persist()
    held.count()  # from here on plans know how it is dealt
    inner = degrees.agg(F.sum("self")).first()[0]
    now = degrees.select("node", "k", F.col("node").alias("label"))
    best, found, stood, round_ = -1.0, now, 0, 0
    try:
        while True:
            tots = now.groupBy("label").agg(F.sum("k").alias("tot")).join(hashes.select(F.col("node").alias("label"), F.col("hash").alias("order")), "label")
            near = now.select(F.col("node").alias("other"), "label").join(tots, "label")
            votes = held.join(sent(near), "other").groupBy("node", "label").agg(F.sum("w").alias("w"), F.max("k").alias("k"), F.max("tot").alias("tot"), F.max("order").alias("order"), F.max(loop).alias("own"))
            gain = F.round(F.col("w") - F.col("k") * (F.col("tot") - F.when(F.col("own"), F.col("k")).otherwise(0.0)) / total, 9)
            choice = F.max(F.struct(gain.alias("gain"), F.bitwise_not("order").alias("order"), "label"))
            at = F.max(F.when(F.col("own"), F.struct(gain.alias("gain"), "w", "label")))
            chosen = votes.groupBy("node").agg(F.max("k").alias("k"), choice.alias("new"), at.alias("at"))
            state = cut(chosen.select("node", "k", F.col("at.label").alias("label"), F.col("new.label").alias("new"), (F.col("new.gain") > F.col("at.gain")).alias("wants"), F.col("at.w").alias("inside")))
            by_label = state.groupBy("label").agg(F.sum("k").alias("tot"), F.sum("inside").alias("inside"), F.count_if("wants").alias("wants"))
            sums = by_label.agg(F.sum("inside").alias("inside"), F.sum((F.col("tot") / total) ** 2).alias("apart"), F.sum("wants").alias("wants")).first()
            quality = (sums["inside"] + inner) / total - sums["apart"]
            if quality > best + 1e-9:
                best, found, stood = quality, now, 0
            else:
                stood += 1
            if stood >= patience or not sums["wants"]:
                return found.select("node", "label"), best
            goes = F.col("wants") & (F.pmod(F.xxhash64("entity_id", F.lit(round_)), F.lit(2)) == 0)
            now = state.join(hashes, "node").select("node", "k", F.when(goes, F.col("new")).otherwise(F.col("label")).alias("label"))
            round_ += 1
    finally:
        held.unpersist()


def modularity(edges: DataFrame, members: DataFrame) -> float:
    """That of communities (entity_id, community) over undirected edges (src, dst, weight), without edges to oneself."""
    ends = edges.where("src <> dst").join(members.toDF("src", "x"), "src").join(members.toDF("dst", "y"), "dst")
    own = ends.agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("x") == F.col("y"), F.col("weight")).otherwise(0)).alias("within")).first()
    if not own["all"]:
        return 0.0
    degree = ends.select(F.col("x").alias("c"), "weight").unionByName(ends.select(F.col("y").alias("c"), "weight")).groupBy("c").agg(F.sum("weight").alias("k"))
    return own["within"] / own["all"] - degree.agg(F.sum((F.col("k") / (2 * own["all"])) ** 2)).first()[0]


def facts_with_evidence(facts: DataFrame, evidence: DataFrame, items: DataFrame, most: int = 10) -> DataFrame:
    """Facts (entity_id, key, value) with their newest cited items, as one row for each."""
    rows = facts.join(evidence.select("entity_id", "item_id"), "entity_id").join(items.select("item_id", "created_at"), "item_id")
    return first_of(rows, ["entity_id", "key", "value"], [F.desc("created_at"), F.col("item_id")], most)


def upsert_facts(facts: DataFrame) -> DataFrame:
    """Facts once each, with the largest confidence and the tier of the first."""
    return facts.groupBy("entity_id", "key", "value").agg(F.max("confidence").alias("confidence"), F.min_by("tier", "at").alias("tier"))


def confidence_of(years: Column) -> Column:
    """Greetings in so many different years: 0.5, and 0.15 for each further one, at most 0.9."""
    return F.least(F.lit(0.9), 0.5 + 0.15 * (years - 1))


def greeting_confidence(evidence: DataFrame) -> DataFrame:
    """(fact_id, confidence): a user's word 1, a contact card 0.95, else 0.5 and 0.15 for each further year, at most 0.9."""
    years = F.countDistinct(F.when(F.col("method") == "greeting", F.substring("created_at", 1, 4)))
    user, card = F.max((F.col("method").startswith("user:")).cast("int")), F.max((F.col("method") == "contact").cast("int"))
    value = F.when(user == 1, 1.0).when(card == 1, 0.95).otherwise(confidence_of(years))
    return evidence.groupBy("fact_id").agg(value.alias("confidence"))
