"""Copy-on-write tables: what a commit writes, what readers see, who may write."""

import json
import random
import time

import pytest

from citegraph import snapshot
from citegraph.snapshot import Change, Cuts, Folder, Store, checkpointed

ROW = "k string, v long"


def frame(spark, rows):
    return spark.createDataFrame(rows, ROW)


def changed(spark, gone, rows):
    return Change(["k"], frame(spark, [(k, 0) for k in gone]).select("k"), frame(spark, rows))


def test_random_changes_equal_a_dictionary(spark, tmp_path):
    rng, want = random.Random(1), {}
    store = Store(spark, str(tmp_path / "s"), buckets=4)
    history = {}
    for _ in range(6):
        touched = {f"k{rng.randrange(40)}" for _ in range(8)}
        new = {k: rng.randrange(100) for k in touched if rng.random() < 0.7}
        want = {k: v for k, v in want.items() if k not in touched} | new
        with store.lock():
            history[store.commit({"t": changed(spark, touched, list(new.items()))}, {"n": len(want)})] = dict(want)
    assert dict(map(tuple, store.read("t").collect())) == want and store.manifest()["state"] == {"n": len(want)}
    for version, then in history.items():  # readers of an older version keep it
        assert dict(map(tuple, store.read("t", version).collect())) == then
    assert {r.k for r in store.touched("t", frame(spark, [(k, 0) for k in list(want)[:3]])).collect()} == set(list(want)[:3])
    late = store.read("t", 5)
    assert store.vacuum(versions=2, seconds=3600) == 0 and late.count() == len(history[5])
    assert store.vacuum(versions=1, seconds=0) > 0 and dict(map(tuple, store.read("t").collect())) == want
    with pytest.raises(FileNotFoundError):
        store.read("t", 1)


def test_a_commit_writes_the_buckets_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=16)
    rows = [(f"k{i}", i) for i in range(2000)]
    with store.lock():
        store.commit({"t": Change(["k"], frame(spark, rows).select("k"), frame(spark, rows)), "other": changed(spark, ["x"], [("x", 1)])})
        before = store.manifest()["tables"]
        store.commit({"t": changed(spark, ["k7", "gone"], [("k7", -7)])})
    after = store.manifest()["tables"]
    moved = {b for b in after["t"]["held"] if after["t"]["held"][b] != before["t"]["held"][b]}
    assert 1 <= len(moved) <= 2 and after["other"] == before["other"] and len(after["t"]["held"]) == 16
    assert store.read("t").count() == 2000 and store.read("t").where("k = 'k7'").first().v == -7
    plan = store.touched("t", frame(spark, [("k7", 0)]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan and len(store.touched("t", frame(spark, [("k7", 0)])).inputFiles()) <= len(before["t"]["held"])


def test_a_crash_leaves_the_version_before(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    with store.lock():
        store.publish({"t": frame(spark, [("a", 1)])})
    with pytest.raises(ZeroDivisionError), store.lock():
        store._write("t", frame(spark, [("a", 2)]), ["k"], 8)  # data, but no manifest
        raise ZeroDivisionError
    assert store.current() == 1 and store.read("t").first().v == 1
    with pytest.raises(OSError, match="lease"):
        store.publish({"t": frame(spark, [("a", 3)])})  # outside a lock
    with pytest.raises(ValueError, match="not named"), store.lock():
        store.commit({"t": Change(["k", "v"], frame(spark, [("a", 1)]), frame(spark, [(f"b{i}", i) for i in range(50)]))})
    assert store.current() == 1 and store.vacuum(seconds=0) >= 2


def test_one_writer_at_a_time(spark, tmp_path):
    store, other = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    with store.lock():
        with pytest.raises(OSError), other.lock():
            pass
        assert store.publish({"t": frame(spark, [])}) == 1
    with store.lock(seconds=-1):  # run out: another may take over, and the first can't commit any more
        with other.lock():
            assert other.publish({"t": frame(spark, [("a", 1)])}) == 2
            with pytest.raises(OSError, match="lease"):
                store.publish({"t": frame(spark, [])})
    with store.lock():
        pass
    assert json.loads(json.dumps(store.manifest()))["version"] == 2 and store.folder.read("LEASE") is None


def test_tables_grow_into_more_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), buckets=1, bucket_bytes=2000)
    for part in range(4):
        rows = [(f"k{part}-{i}", random.Random(i).getrandbits(60)) for i in range(300)]
        with store.lock():
            store.commit({"t": Change(["k"], frame(spark, rows).select("k"), frame(spark, rows))})
    assert store.manifest()["tables"]["t"]["n"] >= 4 and store.read("t").count() == 1200


def test_folders_and_cuts(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "f"))
    folder.put("a/b.txt", "é\n")
    assert folder.read("a/b.txt") == "é\n" and folder.names("a") == ["b.txt"] and folder.names("none") == [] and folder.age("a/b.txt") < time.time()
    with pytest.raises(FileExistsError):
        folder.put("a/b.txt", "")
    with pytest.raises(FileExistsError):
        folder.create("a/b.txt", "")
    with Cuts(spark) as cut:
        kept = cut(spark.range(3))
        assert kept.count() == 3
        at = Folder(spark, cut.folder)
        assert len(at.names()) == 1
    assert at.names() == []


def test_a_large_commit_comes_in_passes_and_leaves_no_shuffle_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshot, "PASS_BYTES", 2000)
    store, made = Store(spark, str(tmp_path / "s")), lambda rows: checkpointed(frame(spark, rows))
    rows = made([(f"k{i}", i) for i in range(3000)])
    with store.lock():
        store.commit({"t": Change(["k"], rows, rows)}, whole={"u": (["k"], rows)})
        held = store.manifest()["tables"]
        assert all(len({at for at, _ in held[t]["held"].values()}) > 2 for t in held)  # folders, one a pass
        store.commit({"t": Change(["k"], rows.where("v < 2000"), made([(f"k{i}", -i) for i in range(1000)]))})
    assert store.read("u").count() == 3000
    assert {r.k: r.v for r in store.read("t").collect()} == {f"k{i}": -i if i < 1000 else i for i in range(3000) if i < 1000 or i >= 2000}
    with pytest.raises(ValueError, match="not named"), store.lock():
        store.commit({"t": Change(["k"], made([("k1", 1)]), rows)})
    on_disk = lambda: {f.getName() for f in _listed(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().startswith("shuffle_")}
    before = on_disk()
    checkpointed(rows.repartition(5, "k"))
    for _ in range(50):
        if left := on_disk() - before:
            time.sleep(0.1)
    assert not left


def _listed(seq):
    return [seq.apply(i) for i in range(seq.size())]
