"""Profiles show no row of another side, by any table; embeddings by model version."""

import numpy as np
import pytest

from citegraph.operators import embed, profile
from citegraph.snapshot import Store


def test_no_table_shows_another_side(spark):
    frame = spark.createDataFrame
    tables = {
        "items": frame([("w1", "work", "mail"), ("w2", "work", "file"), ("h1", "home", "mail"), ("n", None, "mail")], "item_id string, source_id string, kind string"),
        "chunks": frame([("w1", "a"), ("h1", "b")], "item_id string, text string"),
        "attachments": frame([("w2", "x.pdf"), ("h1", "y.pdf")], "item_id string, name string"),
        "mentions": frame([("w1", "e1"), ("h1", "e1"), ("h1", "e2"), ("w2", "e3")], "item_id string, entity_id string"),
        "identifiers": frame([("w1", "email", "e1@work"), ("h1", "phone", "1")], "item_id string, kind string, value string"),
        "fact_evidence": frame([("h1", "e1", "birthday", "03-12"), ("w1", "e4", "due", "2026-01-01")], "item_id string, entity_id string, key string, value string"),
        "facts": frame([("e1", "birthday", "03-12", 0.9), ("e4", "due", "2026-01-01", 0.6)], "entity_id string, key string, value string, confidence double"),
        "relation_evidence": frame([("w1", "e1", "e3", "wrote_to"), ("h1", "e1", "e3", "wrote_to"), ("h1", "e1", "e2", "wrote_to")], "item_id string, src string, dst string, type string"),
        "relations": frame([("e1", "e3", "wrote_to", 2), ("e1", "e2", "wrote_to", 1)], "src string, dst string, type string, weight long"),
        "entities": frame([(f"e{i}", "person") for i in range(1, 6)], "entity_id string, kind string"),
        "aliases": frame([("e1", "email", "e1@work"), ("e1", "phone", "1"), ("e1", "name", "Jane"), ("e2", "handle", "z"), ("e2", "name", "Zoe")], "entity_id string, kind string, value string"),
        "community_members": frame([(1, "e1"), (1, "e2")], "community_id int, entity_id string"),
        "communities": frame([(1, "Jane, Zoe")], "community_id int, label string"),
        "sources": frame([("work",), ("home",)], "source_id string"),
        "query_log": frame([("who is Zoe",)], "query string"),
    }
    rows = lambda t: sorted(map(tuple, t.collect()), key=str)
    seen = {t: rows(df) for t, df in profile.scoped(tables, ["work"], known=["work", "home"]).items()}
    assert seen == {
        "items": [("w1", "work", "mail"), ("w2", "work", "file")], "chunks": [("w1", "a")], "attachments": [("w2", "x.pdf")], "mentions": [("w1", "e1"), ("w2", "e3")],
        "identifiers": [("w1", "email", "e1@work")], "fact_evidence": [("w1", "e4", "due", "2026-01-01")], "facts": [("e4", "due", "2026-01-01", 0.6)],
        "relation_evidence": [("w1", "e1", "e3", "wrote_to")], "relations": [("e1", "e3", "wrote_to", 1)], "entities": [("e1", "person"), ("e3", "person"), ("e4", "person")],
        "aliases": [("e1", "email", "e1@work"), ("e1", "name", "Jane")], "community_members": [("e1", 1)], "communities": [(1, None)], "sources": [("work",)],
    }
    some = profile.scoped(tables, ["work"], ["file"])
    assert rows(some["items"]) == [("w2", "work", "file")] and rows(some["entities"]) == [("e3", "person")] and rows(some["aliases"]) == []
    assert all(t.count() == 0 for n, t in profile.scoped(tables, []).items() if n != "communities")
    with pytest.raises(ValueError, match="unknown sources"):
        profile.scoped(tables, ["work", "hme"], known=["work", "home"])
    bare = profile.scoped({k: v for k, v in tables.items() if k not in ("identifiers", "fact_evidence", "relation_evidence")}, ["work"])
    assert bare["facts"].count() == bare["relations"].count() == 0 and rows(bare["aliases"]) == [("e1", "name", "Jane")]


CHUNK = "chunk_id string, text string"


def test_only_pending_chunks_are_embedded(spark, tmp_path):
    store, model = Store(spark, str(tmp_path / "v"), buckets=2), embed.hash_model()
    chunks = lambda rows: spark.createDataFrame(rows, CHUNK)
    assert embed.embed(store, chunks([]), model) == {"embedded": 0, "gone": 0}
    first = [("a", "the lease of the flat"), ("b", "train ticket"), ("c", None)]
    assert embed.embed(store, chunks(first), model) == {"embedded": 3, "gone": 0}
    second = [("a", "the lease of the flat"), ("b", "train tickets to see"), ("d", "the lease")]
    assert [r.chunk_id for r in embed.pending(store, chunks(second), model).orderBy("chunk_id").collect()] == ["b", "d"]
    assert embed.embed(store, chunks(second), model) == {"embedded": 2, "gone": 1}
    assert embed.embed(store, chunks(second), model) == {"embedded": 0, "gone": 0}
    near = [r.chunk_id for r in embed.closest(store, "lease of the flat", model).collect()]
    assert near[:2] == ["a", "d"] and embed.closest(store, "lease", embed.hash_model(32)).count() == 0
    wide = embed.hash_model(32)  # another model: no vector of the old one stays
    assert embed.embed(store, chunks(second), wide) == {"embedded": 3, "gone": 3}
    assert {len(r.vector) for r in store.read("vectors").collect()} == {32} and store.manifest()["state"]["model"] == "hash:32"


def test_models_run_over_batches(spark, tmp_path):
    def load():
        return lambda texts: np.array([[len(t), t.count("e")] for t in texts], np.float32)

    store, model = Store(spark, str(tmp_path / "b"), buckets=1), embed.batch_model("lengths", 2, load, 3)
    rows = [(str(i), "e" * i + "x") for i in range(7)] + [("none", None)]
    assert embed.embed(store, spark.createDataFrame(rows, CHUNK), model)["embedded"] == 8
    assert {r.chunk_id: r.vector for r in store.read("vectors").collect()} == {k: [len(t or ""), (t or "").count("e")] for k, t in rows}
    assert embed.closest(store, "eex", model, 1).first().chunk_id == "2"
