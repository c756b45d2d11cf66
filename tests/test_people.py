"""Rule packs, people, corrections, scopes and what is shown, on small rows."""

import random
import re

import pytest

from citegraph.functions import display, rules
from citegraph.operators import graph, people, report
from citegraph.plans.engine import Engine
from citegraph.snapshot import checkpointed
from citegraph.sources import parsers

PARTY = "item_id string, role string, name string, email string, phone string, handle string, authoritative boolean, at long"


def test_packs_are_checked_and_merged():
    packs = rules.load({"language": "de", "date_order": "DMY", "deadlines": {"due": ["fällig am"]}}, {"language": "en", "deadlines": {"due": ["owed by"]}, "greetings": ["merry birthday"]})
    assert packs["de"].deadlines == {"due": ["fällig am"]} and "owed by" in packs["en"].deadlines["due"] and "due by" in packs["en"].deadlines["due"]
    assert rules.version(packs) != rules.version(rules.load()) == rules.version(rules.load())
    for bad in ({}, {"language": "e"}, {"language": "en", "date_order": "XYZ"}, {"language": "en", "wrong": 1}, {"language": "en", "greetings": ["!"]}):
        with pytest.raises(ValueError):
            rules.load(bad)
    examples = [("birthday", "Happy birthday Sam!", True), ("birthday", "Belated happy birthday!", False), ("birthday", "Joyeux anniversaire en retard !", False), ("birthday", "Bon anniv ma belle", True), ("relation", "my mum", "parent"), ("relation", "le proprio", "landlord"), ("values", "Total due: $1,450.00", {"invoice_amount": "1450 USD"})]
    assert rules.failures(rules.load(), examples) == [] and len(rules.failures(rules.load(), [("birthday", "Happy new year", True)])) == 1


def test_people_are_resolved_by_keys(spark):
    rows = [("a", "author", "Al", "al@x.y", None, None, False, 1), ("b", "contact", "Alan A.", "al@x.y", "+331", None, True, 2), ("c", "author", None, None, "+331", "al", False, 3), ("d", "author", "Bo", "bo@x.y", None, None, False, 4), ("e", "author", "No keys", None, "", None, False, 5), ("a", "author", "Al", "al@x.y", None, None, False, 1)]
    found, aliases = people.resolve(spark.createDataFrame(rows, PARTY), checkpointed)
    assert sorted(r["name"] for r in found.collect()) == ["Alan A.", "Bo"]
    by = {}
    for r in aliases.collect():
        by.setdefault(r.entity_id, set()).add((r.kind, r.value))
    assert sorted(map(sorted, by.values())) == [[("email", "al@x.y"), ("handle", "al"), ("phone", "+331")], [("email", "bo@x.y")]]
    none, _ = people.resolve(spark.createDataFrame([], PARTY), checkpointed)
    assert none.count() == 0


def test_long_chains_and_large_components(spark):
    chain = [(f"n{i:03}", f"k{j}") for i in range(200) for j in (i, i + 1)]
    star = [(f"s{i:03}", "hub") for i in range(300)]
    got = dict(map(tuple, graph.components(spark.createDataFrame([*chain, *star, ("x", None), (None, "y")], "n string, k string"), "n", "k", checkpointed).collect()))
    assert set(got.values()) == {"n000", "s000"} and len(got) == 500


def test_not_same_by_order(spark):
    rows = [("a", "author", None, "a@x", "+1", None, False, 1), ("b", "author", None, "b@x", "+1", None, False, 2), ("c", "author", None, "c@x", "+1", None, False, 3), ("d", "author", None, "d@x", "+2", None, False, 4)]
    parties = spark.createDataFrame(rows, PARTY)
    keys = people.participant_keys(parties).selectExpr("*", "concat_ws(':', kind, value) AS key")
    joined = checkpointed(graph.components(keys, "key", "item_id", checkpointed).withColumnRenamed("node", "key"))
    got = dict(map(tuple, people.keep_apart(parties, joined, spark.createDataFrame([("email:a@x", "email:b@x")], "a string, b string")).collect()))
    assert got["a"] == got["c"] != got["b"] and got["d"] not in (got["a"], got["b"])


def test_merges_and_corrections(spark):
    merged = spark.createDataFrame([("b", "a")], "entity_id string, into string")
    facts = spark.createDataFrame([("a", "k", "v", 0.5), ("b", "k", "v", 0.9), ("b", "k", "w", 0.1)], "entity_id string, key string, value string, confidence double")
    assert sorted(map(tuple, people.merge_facts(facts, merged).collect())) == [("a", "k", "v", 0.9), ("a", "k", "w", 0.1)]
    wrote = spark.createDataFrame([("a", "b", "1"), ("a", "c", "1"), ("b", "c", "2"), ("b", "c", "1")], "src string, dst string, item_id string")
    assert [tuple(r) for r in people.merge_relations(wrote, merged).collect()] == [("a", "c", 2)]
    own = spark.createDataFrame([("a", "k", "v"), ("a", "relation_to_user", "friend")], "entity_id string, key string, value string")
    got = people.corrected(facts, own, spark.createDataFrame([("b", "k", "v")], "entity_id string, key string, value string"))
    assert sorted(map(tuple, got.collect())) == [("a", "k", "v", 1.0), ("a", "relation_to_user", "friend", 1.0), ("b", "k", "w", 0.1)]
    assert [tuple(r) for r in people.relation_edges(own, "me").collect()] == [("me", "a", "friend")]


def test_scope_hides_facts_and_relations(spark):
    items = spark.createDataFrame([("i1", "work", "t"), ("i2", "family", "t")], "item_id string, source_id string, title string")
    keys = "entity_id string, key string, value string"
    tables = {
        "items": items,
        "entities": spark.createDataFrame([("e", "E"), ("f", "F")], "entity_id string, name string"),
        "mentions": spark.createDataFrame([("e", "i1"), ("e", "i2"), ("f", "i2")], "entity_id string, item_id string"),
        "facts": spark.createDataFrame([("e", "k", "work"), ("e", "k", "home")], keys),
        "fact_evidence": spark.createDataFrame([("e", "k", "work", "i1"), ("e", "k", "home", "i2")], keys + ", item_id string"),
        "relations": spark.createDataFrame([("e", "f", 2)], "src string, dst string, weight long"),
        "relation_evidence": spark.createDataFrame([("e", "f", "i2"), ("e", "f", "i2")], "src string, dst string, item_id string"),
    }
    work = Engine(tables, set(), ["work"])
    assert [r.value for r in work.facts("e").collect()] == ["work"] and work.related("e").count() == 0
    assert Engine(tables, set()).facts("e").count() == 2
    without = Engine({k: v for k, v in tables.items() if "evidence" not in k}, set(), ["work"])
    assert without.facts("e").count() == 0 and without.related("e").count() == 0


def test_engine_calls(spark):
    items = spark.createDataFrame([("i1", "s", "T", "file", "2024-01-01", "t1", "2024-01-01"), ("i2", "s", "U", "email", "2024-01-02", "t1", "2024-01-02")], "item_id string, source_id string, title string, kind string, modified_at string, thread_id string, created_at string")
    chunks = spark.createDataFrame([("i1#1", "i1", 1, "second part 4111 1111 1111 1111"), ("i1#0", "i1", 0, "first part")], "chunk_id string, item_id string, ord int, text string")
    e = Engine({"items": items, "chunks": chunks}, set())
    assert e.get_item("i1").first().body == "first part\n\nsecond part [REDACTED:card]" and e.get_item("i1", True, 2).first().cut
    assert [r.item_id for r in e.thread("i2").collect()] == ["i1", "i2"] and tuple(e.status().first()) == ("s", 2, 2, "2024-01-02")
    log = spark.createDataFrame([("2024-01-01", "cli"), ("2024-01-03", "http"), ("2024-01-02", "cli")], "ts string, interface string")
    assert [r.ts for r in e.activity(log, interface="cli").collect()] == ["2024-01-02", "2024-01-01"]


def test_secrets_are_taken_out_by_match():
    text, kinds = display.redacted("4111111111111111 and 94111111111111111 and GB82WEST12345698765432, pwd: x1 sk-" + "a" * 20)
    assert text == "[REDACTED:card] and 94111111111111111 and [REDACTED:iban], pwd: [REDACTED:password] [REDACTED:api_key]" and kinds == ["iban", "card", "api_key", "password"]
    assert display.redacted("") == ("", [])


def test_snippets_match_brute_force():
    rng = random.Random(6)
    terms = [("aa", True), ("bb", False)]
    for _ in range(200):
        text = " ".join(rng.choice(["aa", "aab", "bb", "bbc", "x", "y", "é"]) for _ in range(rng.randint(0, 30)))
        own = text.split()
        hit = lambda w: 0 if w.startswith("aa") else 1 if w == "bb" else -1
        windows = [(len({hit(w) for w in own[i : i + 5]} - {-1}), sum(hit(w) >= 0 for w in own[i : i + 5]), -i) for i in range(max(1, len(own) - 4))]
        at = -max(windows)[2]
        want = " ".join(f"[{w}]" if hit(w) >= 0 else w for w in own[at : at + 5])
        assert re.sub("^… | …$", "", display.snippet(text, terms, 5)) == want


def test_tables_are_chunked_with_their_header():
    got = display.chunk_table("a b\n" + "\n".join(f"{i} x" for i in range(7)), 8)
    assert got[0] == "a b\n0 x\n1 x\n2 x" and len(got) == 3 and all(x.startswith("a b\n") for x in got)
    assert display.chunk_table("") == [] and display.chunk_table("h\n" + "w " * 50, 8) == ["h\n" + "w " * 50]


def test_labels_hits_and_archives(spark):
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1), ("d", 2)], "entity_id string, community int")
    entities = spark.createDataFrame([("a", "person", "A"), ("b", "person", "B"), ("c", "person", "C"), ("d", "project", "D")], "entity_id string, kind string, name string")
    weights, counts = spark.createDataFrame([("a", 1)], "entity_id string, weight long"), spark.createDataFrame([("c", 9), ("b", 3)], "entity_id string, mentions long")
    assert dict(map(tuple, report.community_labels(members, entities, weights, counts).collect())) == {1: "C, B", 2: "D"}
    hits, none = spark.createDataFrame([("i",)], "item_id string"), spark.createDataFrame([], "item_id string, x string")
    one = report.enrich_hits(hits, spark.createDataFrame([("i", "e")], "item_id string, entity_id string"), none.withColumnRenamed("x", "value"), none.withColumnRenamed("x", "name"), none.withColumnRenamed("x", "copy_id")).first()
    assert one.people == ["e"] and one["values"] == one.attachments == one.copies == []


def test_parsers_of_cards_notes_and_times(spark):
    card = "BEGIN:VCARD\nFN:Al\nEMAIL:al@x.y\nEND:VCARD\nBEGIN:VCARD\nUID:u1\nFN:Bo\nEND:VCARD"
    got = parsers.card_items(spark.createDataFrame([("p.vcf", card), ("q.vcf", None)], "path string, text string")).collect()
    assert got[0].external_id.startswith("p.vcf#card-0-") and got[1].external_id == "p.vcf#u1" and got[0].emails == ["al@x.y"]
    lines = spark.createDataFrame([('{"id": "1", "title": "t", "text": "x", "updated": "2024-01-01T00:00:00Z"}',), ("broken",), (None,)], "value string")
    assert [r.external_id for r in parsers.note_items(lines).collect()] == ["note:1"]
    assert parsers.calendar_time("20240701T090000", "Europe/Paris") == "2024-07-01T07:00:00+00:00" and parsers.calendar_time("20240701T090000Z", "Europe/Paris") == "2024-07-01T09:00:00+00:00"
    assert parsers.calendar_time("20240701") == "2024-07-01T12:00:00+00:00" and parsers.calendar_time("20240701T090000", "Nowhere/At") == "2024-07-01T09:00:00+00:00" and parsers.calendar_time("x") is None
    assert parsers.html_text("<p>a<script>x</script> b</p><div>c &amp; <b>d</b></div><style>y") == "a b\nc & d"
    assert re.match(parsers.glob_pattern("**/a*.tx?"), "x/y/ab.txt") and not re.match(parsers.glob_pattern("*.txt"), "x/a.txt") and re.match(parsers.glob_pattern("**/b"), "b")
