"""People: keys of participants, who is who, merged tables, facts about people, corrections, and questions about a person.

Parties are rows (item_id, role, name, email, phone, handle, authoritative, at): a contact card or a participant of a
message, at its place in the order of ingestion. Keys and names are normalised before (see functions.text).
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citegraph.functions import rules
from citegraph.functions import text as T
from citegraph.operators import graph

KEY_KINDS = ("email", "phone", "handle")
CONTACT, GREETING, VALUE, CORRECTION = 0.95, 0.5, 0.6, 1.0
#: Points of a person in a search.
KEY_POINTS, RELATION_POINTS, ME_POINTS, NICKNAME_POINTS, FULL_NAME_POINTS = 10, 6, 5, 3, 2


def participant_keys(parties: DataFrame) -> DataFrame:
    """The parties with a row for each of their keys (kind, value)."""
    kinds = F.filter(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("value")) for k in KEY_KINDS]), lambda x: x["value"].isNotNull() & (x["value"] != ""))
    return parties.withColumn("x", F.explode(kinds)).select(*[c for c in parties.columns if c not in KEY_KINDS], "x.kind", "x.value")


def resolve(parties: DataFrame, cut: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(people, aliases): each group of keys that parties join is a person (entity_id, name); aliases are their keys.

    The id is that of the least key of the person. The name is the last of a contact card, else the first that came.
    """
    keys = cut(participant_keys(parties).withColumn("key", F.concat_ws(":", "kind", "value")))
    party = keys.withColumn("party", F.concat_ws("|", "item_id", "role", F.coalesce("name", F.lit(""))))
    joined = graph.components(party, "key", "party", cut)
    aliases = joined.select(T.entity_id(F.lit("person"), F.col("component")).alias("entity_id"), "node").withColumns({"kind": F.substring_index("node", ":", 1), "value": F.expr("substring(node, instr(node, ':') + 1)")})
    named = keys.where("name is not null").join(joined.withColumnRenamed("node", "key"), "key").select("component", "name", "authoritative", "at").distinct()
    card = F.max(F.when(F.col("authoritative"), F.struct("at", "name")))["name"]
    first = F.min(F.struct("at", "name"))["name"]
    names = named.groupBy("component").agg(F.coalesce(card, first).alias("name"))
    people = joined.select("component").distinct().join(names, "component", "left")
    return people.select(T.entity_id(F.lit("person"), F.col("component")).alias("entity_id"), "name"), aliases.select("entity_id", "kind", "value")


def keep_apart(parties: DataFrame, components: DataFrame, not_same: DataFrame) -> DataFrame:
    """(party, person): people of the components (key, component), where pairs of keys (a, b) in not_same never join.

    A party joins the first person that owns one of its keys and holds none that it must be kept from; it takes what other
    such people it can into that person. The order of parties decides, so a component with such a pair is one group: it is
    the people whom one mistaken key joins, and grows with that, not with the data. Other components need no order.
    """
    keyed = participant_keys(parties).withColumn("key", F.concat_ws(":", "kind", "value")).join(components, "key")
    apart = not_same.join(components.withColumnRenamed("key", "a"), "a").groupBy("component").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    plain = keyed.join(apart, "component", "left_anti").select("item_id", "component").distinct().select("item_id", F.col("component").alias("person"))

    def split(rows: pd.DataFrame) -> pd.DataFrame:
        conflicts: dict[str, set[str]] = {}
        for pair in rows["pairs"].iloc[0]:
            conflicts.setdefault(pair["a"], set()).add(pair["b"])
            conflicts.setdefault(pair["b"], set()).add(pair["a"])
        owned: dict[str, set[str]] = {}  # by the person's first key
        owner: dict[str, str] = {}
        first_keys: dict[str, list[str]] = {}
        for item, own in rows.sort_values(["at", "item_id"]).groupby("item_id", sort=False):
            keys = sorted(set(own["key"]))
            barred = set().union(*(conflicts.get(k, set()) for k in keys))
            free = [k for k in keys if not (k in owner and owned[owner[k]] & barred)]
            found = list(dict.fromkeys(owner[k] for k in free if k in owner))
            person = found[0] if found else (free or keys)[0]
            owned.setdefault(person, set())
            for other in found[1:]:
                if not any(conflicts.get(k, set()) & owned[other] for k in owned[person]):
                    for k in owned.pop(other):
                        owner[k] = person
                        owned[person].add(k)
            for k in free:
                if k not in owner:
                    owner[k] = person
                    owned[person].add(k)
            first_keys[item] = keys
        people = {item: next((owner[k] for k in keys if k in owner), keys[0]) for item, keys in first_keys.items()}
        return pd.DataFrame({"item_id": list(people), "person": list(people.values())})

    return plain.unionByName(keyed.join(apart, "component").groupBy("component").applyInPandas(split, "item_id string, person string"))


def repoint(df: DataFrame, merged: DataFrame, *columns: str) -> DataFrame:
    """df with entities in the columns replaced by those that they were merged into: merged has (entity_id, into)."""
    for c in columns:
        df = df.join(merged.select(F.col("entity_id").alias(c), F.col("into").alias("__into")), c, "left").withColumn(c, F.coalesce("__into", c)).drop("__into")
    return df


def merge_facts(facts: DataFrame, merged: DataFrame) -> DataFrame:
    return repoint(facts, merged, "entity_id").groupBy("entity_id", "key", "value").agg(F.max("confidence").alias("confidence"))


def merge_relations(evidence: DataFrame, merged: DataFrame) -> DataFrame:
    """(src, dst, weight): the different items of each pair after the merge, none between one person."""
    return repoint(evidence, merged, "src", "dst").where("src <> dst").groupBy("src", "dst").agg(F.countDistinct("item_id").alias("weight"))


def stack_facts(cards: DataFrame, keys: dict[str, str], confidence: float, method: str) -> DataFrame:
    """(entity_id, key, value, confidence, method): a fact for each column that has a value; columns may be lists."""

    def named(column: str, key: str) -> Column:
        values = F.array(F.col(column)) if dict(cards.dtypes)[column] == "string" else F.col(column)
        return F.transform(values, lambda v: F.struct(F.lit(key).alias("key"), v.alias("value")))

    lists = [named(c, k) for c, k in keys.items()]
    rows = cards.select("entity_id", F.explode(F.concat(*[F.coalesce(x, F.array().cast("array<struct<key:string,value:string>>")) for x in lists])).alias("x"))
    return rows.select("entity_id", "x.key", "x.value", F.lit(confidence).alias("confidence"), F.lit(method).alias("method")).where("value is not null and value <> ''").distinct()


def is_greeting(text: Column, packs: dict[str, rules.Pack], first: int = 40) -> Column:
    """Whether a greeting is among the first words, and no word that puts it off the day."""
    own = F.slice(T.tokens(T.fold(text)), 1, first)
    joined = F.concat(F.lit(" "), F.array_join(own, " "), F.lit(" "))
    hit = F.lit(False)
    for p in packs.values():
        for g in p.greetings:
            hit = hit | F.contains(joined, F.lit(f" {' '.join(rules.words(g))} "))
    return hit & ~F.arrays_overlap(own, F.array(*[F.lit(rules.folded(w)) for p in packs.values() for w in p.exclude]))


def greeting_facts(sent: DataFrame, packs: dict[str, rules.Pack], local: Column) -> DataFrame:
    """Birthdays by greetings (item_id, text, recipients) that one person got; local is the sender's local time."""
    one = sent.where((F.size(F.array_distinct("recipients")) == 1) & is_greeting(F.col("text"), packs))
    return one.select(F.col("recipients")[0].alias("entity_id"), F.lit("birthday").alias("key"), F.date_format(local, "MM-dd").alias("value"), F.lit(GREETING).alias("confidence"), "item_id")


def value_facts(values: DataFrame, items: DataFrame) -> DataFrame:
    """Extracted (item_id, fact_key, value) as facts: an amount is its author's if there is one, a deadline the document's."""
    rows = values.join(items.select("item_id", "author"), "item_id")
    owner = F.when(F.endswith("fact_key", F.lit("_amount")) & F.col("author").isNotNull(), F.col("author")).otherwise(T.entity_id(F.lit("document"), F.col("item_id")))
    return rows.select(owner.alias("entity_id"), F.col("fact_key").alias("key"), "value", F.lit(VALUE).alias("confidence"), "item_id")


def corrected(facts: DataFrame, corrections: DataFrame, rejected: DataFrame) -> DataFrame:
    """Facts with the user's own (entity_id, key, value) at full confidence, without those that the user rejected."""
    own = corrections.select("entity_id", "key", "value", F.lit(CORRECTION).alias("confidence"))
    both = facts.select("entity_id", "key", "value", "confidence").unionByName(own)
    return both.groupBy("entity_id", "key", "value").agg(F.max("confidence").alias("confidence")).join(rejected, ["entity_id", "key", "value"], "left_anti")


def relation_edges(corrections: DataFrame, me: str) -> DataFrame:
    """The edges me -> person that the user's relation_to_user corrections state."""
    return corrections.where("key = 'relation_to_user'").select(F.lit(me).alias("src"), F.col("entity_id").alias("dst"), F.col("value").alias("type"))


def candidates(entities: DataFrame, aliases: DataFrame, corrected_people: DataFrame) -> DataFrame:
    """People to be labelled: not the user, and none that the user has corrected."""
    me = aliases.where("kind = 'role' and value = 'me'").select("entity_id")
    return entities.join(me, "entity_id", "left_anti").join(corrected_people.select("entity_id"), "entity_id", "left_anti")


def contact_text(cards: DataFrame, columns: list[str]) -> DataFrame:
    """(entity_id, text): a card's values, a line each."""
    return cards.select("entity_id", F.concat_ws("\n", *[F.when(F.col(c) != "", F.col(c)) for c in columns]).alias("text"))


def find(entities: DataFrame, aliases: DataFrame, facts: DataFrame, mentions: DataFrame, query: str, limit: int = 5, packs: dict[str, rules.Pack] | None = None) -> DataFrame:
    """(entity_id, name, score) of the people whom a query names, at least half as likely as the best.

    A key is worth 10, a relation 6, the user 5, a nickname 3, each word of a name 1 and all of them 2 more.
    """
    own = list(dict.fromkeys(rules.words(query)))
    words = F.array(*[F.lit(w) for w in own]).cast("array<string>")
    known = rules.relation_words(rules.load() if packs is None else packs)
    named = [r for w in own if (r := known.get(w))]
    by_name = entities.select("entity_id", T.tokens(T.fold(F.coalesce("name", F.lit("")))).alias("w"))
    shared = F.size(F.array_intersect("w", words))
    scored = by_name.where(shared > 0).select("entity_id", (shared + F.when(F.size(F.array_except("w", words)) == 0, FULL_NAME_POINTS).otherwise(0)).alias("score"))
    keys = [k.strip(".,;:!?()<>\"'") for k in query.split()]
    scored = scored.union(aliases.where(F.col("kind").isin(*KEY_KINDS) & F.lower("value").isin([k.lower() for k in keys])).select("entity_id", F.lit(KEY_POINTS)).distinct())
    if named:
        scored = scored.union(facts.where(F.col("key").isin("relation_to_user") & F.col("value").isin(named)).select("entity_id", F.lit(RELATION_POINTS)).distinct())
    if {"me", "my", "moi"} & set(own) and not named:
        scored = scored.union(aliases.where("kind = 'role' and value = 'me'").select("entity_id", F.lit(ME_POINTS)))
    nick = facts.where(F.startswith("key", F.lit("nickname"))).select("entity_id", T.tokens(T.fold(F.col("value"))).alias("w"))
    scored = scored.union(nick.where((F.size("w") > 0) & (F.size(F.array_except("w", words)) == 0)).select("entity_id", F.lit(NICKNAME_POINTS)).distinct())
    total = scored.groupBy("entity_id").agg(F.sum("score").cast("long").alias("score"))
    best = total.agg(F.max("score").alias("best"))  # one row
    good = total.crossJoin(F.broadcast(best)).where(F.col("score") * 2 >= F.col("best"))
    counts = mentions.join(good.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.count("*").alias("mentions"))
    rows = good.join(counts, "entity_id", "left").join(entities.select("entity_id", "name"), "entity_id")
    return rows.orderBy(F.desc("score"), F.desc(F.coalesce("mentions", F.lit(0))), "entity_id").limit(limit).select("entity_id", "name", "score")


def entity_cards(entities: DataFrame, aliases: DataFrame, mentions: DataFrame) -> DataFrame:
    """(entity_id, name, aliases, is_me, mentions): aliases without roles and cards."""
    own = aliases.groupBy("entity_id").agg(
        F.array_sort(F.collect_set(F.when(~F.col("kind").isin("role", "contact"), F.concat_ws(":", "kind", "value")))).alias("aliases"), F.max((F.col("kind") == "role") & (F.col("value") == "me")).alias("is_me")
    )
    counts = mentions.groupBy("entity_id").agg(F.count("*").alias("mentions"))
    rows = entities.join(own, "entity_id", "left").join(counts, "entity_id", "left")
    return rows.select("entity_id", "name", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"), F.coalesce("is_me", F.lit(False)).alias("is_me"), F.coalesce("mentions", F.lit(0)).cast("long").alias("mentions"))


def who_is(one: DataFrame, facts: DataFrame, relations: DataFrame, items: DataFrame, mentions: DataFrame, now: str, most: int = 5) -> DataFrame:
    """(entity_id, facts, related, first_contact, last_contact) of the few entities in one."""
    own = facts.join(one.select("entity_id"), "entity_id", "left_semi").groupBy("entity_id").agg(F.array_sort(F.collect_set(F.concat_ws("=", "key", "value"))).alias("facts"))
    near = graph.neighbours(relations, one.select("entity_id"))
    near = graph.first_of(near, ["entity_id"], [F.desc("weight"), F.col("other_id")], most)
    near = near.groupBy("entity_id").agg(F.array_sort(F.collect_list("other_id")).alias("related"))
    seen = mentions.join(one.select("entity_id"), "entity_id", "left_semi").join(items.select("item_id", "created_at").where(F.col("created_at") <= now), "item_id")
    seen = seen.groupBy("entity_id").agg(F.min("created_at").alias("first_contact"), F.max("created_at").alias("last_contact"))
    return one.select("entity_id").join(own, "entity_id", "left").join(near, "entity_id", "left").join(seen, "entity_id", "left")


def first_wins(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Insert or ignore: of the rows of a key the first stays."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


