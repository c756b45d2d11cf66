import math

import numpy as np

from citegraph.operators import search
from citegraph.operators.vectors import VectorIndex, centres_of, nearest_cells
from citegraph.plans import queries

KIND = "vec_id long, embedding array<float>"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], KIND)


def found(df):
    return [(r[0], round(r[1], 5)) for r in df.collect()]


def test_cells_hold_the_neighbours(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(12, 16))
    vectors = (middle[rng.integers(0, 12, 1500)] + 0.4 * rng.normal(size=(1500, 16))).astype(np.float32)
    vectors[700] = vectors[3]
    rows = [v.tolist() for v in vectors] + [None, [math.nan] * 16, [1.0] * 3, [None] * 16]
    df = frame(spark, rows).repartition(3)
    index = VectorIndex.build(df, cell_rows=100, sample=600)
    again = VectorIndex(spark, index.store.folder.path)
    assert len(index.centres) == 16 and index.store.read("cells").count() == len(rows)  # every row, odd ones too
    hits = total = 0
    for q in range(0, 1500, 100):
        query = vectors[q].astype(float).tolist()
        want = found(search.nearest(df.where("vec_id < 1500"), query, 20, None))
        assert found(again.search(query, 20, probes=1, exact=True)) == want
        hits += len({k for k, _ in found(index.search(query, 20))} & {k for k, _ in want})
        total += 20
    assert hits >= 0.9 * total and 1 <= index.state["probes"] < 16
    read = index._of([0])
    assert 0 < read.count() < 600 and len(read.inputFiles()) < len(index.store.read("cells").inputFiles())
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(cell,0)" in plan or "In(cell" in plan


def test_empty_tables_odd_queries_and_few_vectors(spark):
    none = VectorIndex.build(frame(spark, []))
    assert none.search([1.0], 3).collect() == []
    few = VectorIndex.build(frame(spark, [[1.0, 0.0], [0.0, 1.0], [1.0, 0.0], None]))
    assert found(few.search([1.0, 0.0], 5)) == [(0, 0.0), (2, 0.0), (1, round(2**0.5, 5))] and few.search([1.0], 5).collect() == []
    same = np.ones((5, 3))
    assert nearest_cells(same, centres_of(same, 3))[1].max() == 0


def test_a_search_of_vectors_builds_no_index_of_words(spark, tmp_path):
    rows = [(i, [float(i), 0.0, 1.0]) for i in range(30)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")  # the folder has no other table
    for name in ("knn_cells_exact", "knn_cells"):
        assert [r.vec_id for r in queries.QUERIES[name](spark, str(tmp_path)).collect()] == list(range(20))
