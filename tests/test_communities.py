"""Communities by modularity on planted graphs, beside a plain run of the same idea on one machine."""

import random

import pytest

from citegraph.operators import graph
from citegraph.snapshot import Cuts

EDGE = "src string, dst string, weight long"


def one_by_one(edges):
    """Nodes move to the best neighbouring community, one at a time, until none moves; then communities are the nodes."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    of = {n: n for n in nodes}
    links = {}
    for a, b, w in edges:
        for x, y in ((a, b), (b, a)):
            links.setdefault(x, {}).setdefault(y, 0)
            links[x][y] += w
    total = sum(sum(x.values()) for x in links.values())
    while True:
        names = sorted(links)
        k = {n: sum(links[n].values()) for n in names}
        label, tot, moved = {n: n for n in names}, dict(k), True
        any_move = False
        while moved:
            moved = False
            for n in names:
                own = label[n]
                tot[own] -= k[n]
                votes = {own: 0}
                for o, w in links[n].items():
                    if o != n:
                        votes[label[o]] = votes.get(label[o], 0) + w
                best = max(sorted(votes), key=lambda c: votes[c] - k[n] * tot.get(c, 0) / total)
                if votes[best] - k[n] * tot.get(best, 0) / total <= votes[own] - k[n] * tot.get(own, 0) / total + 1e-12:
                    best = own
                label[n] = best
                tot[best] = tot.get(best, 0) + k[n]
                moved |= best != own
                any_move |= best != own
        of = {n: label[c] for n, c in of.items()}
        new = {}
        for a, own in links.items():
            for b, w in own.items():
                x, y = label[a], label[b]
                new.setdefault(x, {}).setdefault(y, 0)
                new[x][y] += w
        if not any_move:
            return of
        links = new


def planted(rng, groups, size, inside, outside):
    nodes = [f"n{i:03d}" for i in range(groups * size)]
    edges = []
    for i, a in enumerate(nodes):
        for j in range(i + 1, len(nodes)):
            if rng.random() < (inside if i // size == j // size else outside):
                edges.append((a, nodes[j], rng.randint(1, 3)))
    return nodes, edges


@pytest.mark.parametrize("seed", [1, 2])
def test_modularity_is_that_of_one_machine_at_least(spark, seed):
    rng = random.Random(seed)
    nodes, edges = planted(rng, 5, 12, 0.6, 0.04)
    edges += [(b, a, 1) for a, b, _ in edges[:20]] + [(nodes[0], nodes[0], 5)]  # back edges are summed, loops are none
    frame = spark.createDataFrame(edges, EDGE)
    with Cuts(spark) as cut:
        found = graph.communities(frame, cut).collect()
    members = lambda rows: spark.createDataFrame(rows, "entity_id string, community string")
    got = graph.modularity(frame, members([tuple(r) for r in found]))
    plain = graph.modularity(frame, members(list(one_by_one([e for e in edges if e[0] != e[1]]).items())))
    truth = graph.modularity(frame, members([(n, f"g{i // 12}") for i, n in enumerate(nodes)]))
    assert got >= max(plain, truth) - 1e-6 and len(found) == len({r.entity_id for r in found}) == 60
    assert all(r.community == min(x.entity_id for x in found if x.community == r.community) for r in found)


def test_the_user_is_left_out_and_groups_apart_stay_apart(spark):
    pairs = [(f"{g}{i}", f"{g}{j}", 1) for g in "abc" for i in range(4) for j in range(i)] + [("me", f"{g}{i}", 9) for g in "abc" for i in range(4)]
    frame, me = spark.createDataFrame(pairs, EDGE), spark.createDataFrame([("me",)], "entity_id string")
    with Cuts(spark) as cut:
        found = {r.entity_id: r.community for r in graph.communities(frame, cut, me).collect()}
        assert found == {f"{g}{i}": f"{g}0" for g in "abc" for i in range(4)}
        assert graph.communities(frame.limit(0), cut).collect() == []
    assert graph.modularity(frame.limit(0), me.withColumnRenamed("entity_id", "x").selectExpr("x", "x as y")) == 0.0


def test_one_task_and_many_find_the_same_communities(spark, monkeypatch):
    nodes, edges = planted(random.Random(3), 6, 10, 0.5, 0.06)
    frame = spark.createDataFrame(edges + [(nodes[0], nodes[0], 4)], EDGE)
    found = []
    for local, sent in ((graph.LOCAL_LINKS, 10), (0, graph.SENT_NODES), (0, 10)):  # links moved in one task; labels sent to tasks; joined
        monkeypatch.setattr(graph, "LOCAL_LINKS", local)
        monkeypatch.setattr(graph, "SENT_NODES", sent)
        with Cuts(spark) as cut:
            found.append({r.entity_id: r.community for r in graph.communities(frame, cut).collect()})
    assert found[0] == found[1] == found[2] and set(found[0]) == set(nodes)


def test_a_round_moves_labels_and_no_links(spark, monkeypatch):
    monkeypatch.setattr(graph, "LOCAL_LINKS", 0)
    _, edges = planted(random.Random(4), 4, 10, 0.5, 0.06)
    frame, states = spark.createDataFrame(edges, EDGE), []
    with Cuts(spark) as cut:

        def watched(df):
            if "wants" in df.columns:
                states.append(df._jdf.queryExecution().executedPlan().toString())
            return cut(df)

        graph.communities(frame, watched).collect()
    assert states
    for plan in states:  # above the links that are kept, nothing is dealt out again
        above = plan[: plan.index("InMemoryTableScan")]
        assert "BroadcastHashJoin" in above and "SortMergeJoin" not in above and "Exchange hashpartitioning" not in above
