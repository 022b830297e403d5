"""Distributed communities against a local greedy search on graphs of known shape."""

import random

import pytest

from quarry.operators import graph
from quarry.operators.communities import communities


def greedy(n, pairs):
    """Louvain's sequential moves and contraction: the community of each node."""
    near = {k: {} for k in range(n)}
    for a, b in pairs:
        near[a][b] = near[a].get(b, 0) + 1
        near[b][a] = near[b].get(a, 0) + 1
    member, total = list(range(n)), 2 * len(pairs)
    while True:
        home, volume = {k: k for k in near}, {k: sum(w.values()) for k, w in near.items()}
        inside, ever, moved = dict(volume), False, True
        while moved:
            moved = False
            for k in near:
                inside[home[k]] -= volume[k]
                into = {home[k]: 0}
                for j, w in near[k].items():
                    if j != k:
                        into[home[j]] = into.get(home[j], 0) + w
                best = max(sorted(into), key=lambda c: (into[c] - inside[c] * volume[k] / total, c == home[k]))
                moved |= best != home[k]
                home[k] = best
                inside[best] += volume[k]
            ever |= moved or any(home[k] != k for k in near)
        if not ever:
            return member
        member = [home[m] for m in member]
        merged = {}
        for k, ws in near.items():
            for j, w in ws.items():
                to = merged.setdefault(home[k], {})
                to[home[j]] = to.get(home[j], 0) + w
        near = merged


def quality(pairs, member):
    m, inside, ends = len(pairs), 0, {}
    for a, b in pairs:
        inside += member[a] == member[b]
        for x in (a, b):
            ends[member[x]] = ends.get(member[x], 0) + 1
    return inside / m - sum(d * d for d in ends.values()) / (4 * m * m)


def ring_of_cliques():
    return 24, [(6 * g + i, 6 * g + j) for g in range(4) for i in range(6) for j in range(i)] + [(6 * g, (6 * g + 7) % 24) for g in range(4)]


def planted():
    rng = random.Random(4)
    pairs = {(a, b) for a in range(90) for b in range(a) if rng.random() < (0.35 if a % 3 == b % 3 else 0.03)}
    return 90, sorted(pairs)


def star_and_path():
    return 40, [(0, k) for k in range(1, 20)] + [(k, k + 1) for k in range(20, 39)]


@pytest.mark.parametrize("shape", [ring_of_cliques, planted, star_and_path])
def test_modularity_is_no_less_than_that_of_a_sequential_search(spark, shape):
    n, pairs = shape()
    nodes = spark.createDataFrame([(f"n{k}", k) for k in range(n)], "id string, ord long")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    found = communities(nodes, edges)
    got = {int(r.id[1:]): r.community for r in found.collect()}
    assert sorted(got) == list(range(n))
    mine = quality(pairs, got)
    assert mine >= quality(pairs, greedy(n, pairs)) - 0.01
    assert graph.modularity(edges, found).head()[0] == pytest.approx(mine)
    firsts = {}
    for k in range(n):
        firsts.setdefault(got[k], k)
    assert [firsts[c] for c in sorted(firsts)] == sorted(firsts.values()) and sorted(firsts) == list(range(len(firsts)))


def test_cliques_lone_nodes_loops_and_no_edges(spark):
    pairs = [(f"{g}{i}", f"{g}{j}") for g in "xyz" for i in range(4) for j in range(i)] + [("x0", "y0"), ("y1", "z1"), ("x0", "x0"), ("x1", "x0")]
    nodes = spark.createDataFrame([(f"{g}{i}", k * 4 + i) for k, g in enumerate("xyz") for i in range(4)] + [("alone", 99)], "id string, ord long")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    got = {r.id: r.community for r in communities(nodes, edges).collect()}
    assert [len({got[f"{g}{i}"] for i in range(4)}) for g in "xyz"] == [1, 1, 1] and len(set(got.values())) == 4
    assert sorted(r.community for r in communities(nodes, edges.limit(0)).collect()) == list(range(13))
    assert communities(nodes.limit(0), edges.limit(0)).count() == 0


def test_many_blocks_hubs_and_rows_of_equal_ids(spark, monkeypatch):
    """Blocks of a few edges, and a node with more edges than a block, give no worse a partition; rows of equal ids are one node."""
    from quarry.operators import communities as module

    n, pairs = planted()
    pairs = pairs + [(k, 90) for k in range(90)]
    monkeypatch.setattr(module, "BLOCK", 80)
    nodes = spark.createDataFrame([(f"n{k}", k) for k in range(n + 1)] + [("n7", 500), ("n7", 501)], "id string, ord long")
    edges = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    rows = communities(nodes, edges).collect()
    assert len(rows) == n + 3 and len({r.community for r in rows if r.id == "n7"}) == 1
    assert quality(pairs, {int(r.id[1:]): r.community for r in rows}) >= quality(pairs, greedy(n + 1, pairs)) - 0.02


def test_modularity_counts_an_edge_for_each_row_of_its_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "src string, dst string")
    at = spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2), ("c", 2), ("d", 2)], "id string, community long")
    # the rows that a join gives: a-b four times, twice within 1; b-c twice, once within 2; c-d within 2; seven ends in each
    assert graph.modularity(edges, at).head()[0] == pytest.approx(4 / 7 - (7 * 7 + 7 * 7) / (4 * 7 * 7))


def test_blocks_are_answered_in_arrays_and_ids_in_order_are_not_numbered_again(spark, monkeypatch):
    """A row for each block and slice of nodes, not for each block and node; numbers in order give what names give."""
    from quarry.operators import communities as module

    n, pairs = planted()
    pairs = pairs + [(k, 90) for k in range(89)]
    monkeypatch.setattr(module, "BLOCK", 80)
    seen, level_of = [], module._level

    def level(*given):
        out = level_of(*given)
        seen.append((out.touched.count(), out.nodes.count(), out.blocks))
        return out

    monkeypatch.setattr(module, "_level", level)
    nodes = spark.createDataFrame([(k, k) for k in range(n + 1)] + [(7, 7)], "id long, ord long")
    edges = spark.createDataFrame([(min(p), max(p)) for p in pairs], "src long, dst long")
    rows = communities(nodes, edges, in_order=True).collect()
    touched, many, blocks = seen[0]
    assert many == n + 1 and blocks > 1 and touched <= blocks  # all ids are in one slice
    got = {r.id: r.community for r in rows}
    assert len(rows) == n + 2 and sorted(got) == list(range(n + 1))
    assert quality(pairs, got) >= quality(pairs, greedy(n + 1, pairs)) - 0.02
    firsts = {}
    for k in range(n + 1):
        firsts.setdefault(got[k], k)
    assert [firsts[c] for c in sorted(firsts)] == sorted(firsts.values()) and sorted(firsts) == list(range(len(firsts)))


def test_numbers_in_order_give_what_names_give(spark):
    n, pairs = planted()
    names = spark.createDataFrame([(f"n{k}", k) for k in range(n)], "id string, ord long"), spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "src string, dst string")
    numbers = spark.createDataFrame([(5 * k, k) for k in range(n)], "id long, ord long"), spark.createDataFrame([(5 * min(p), 5 * max(p)) for p in pairs], "src long, dst long")
    by_name = {int(r.id[1:]): r.community for r in communities(*names).collect()}
    by_number = {r.id // 5: r.community for r in communities(*numbers, in_order=True).collect()}
    assert sorted(by_name) == sorted(by_number) and quality(pairs, by_number) == pytest.approx(quality(pairs, by_name), abs=0.02)


def test_slices_beyond_the_first_and_sparse_ids(spark, monkeypatch):
    """Ids far apart fall into many slices, whose answers come back in the order of ids."""
    from quarry.operators import communities as module

    n, pairs = ring_of_cliques()
    monkeypatch.setattr(module, "BLOCK", 20)
    nodes = spark.createDataFrame([(k * 100_003, k) for k in range(n)], "id long, ord long")
    edges = spark.createDataFrame([(min(p) * 100_003, max(p) * 100_003) for p in pairs], "src long, dst long")
    got = {r.id // 100_003: r.community for r in communities(nodes, edges, in_order=True).collect()}
    assert quality(pairs, got) >= quality(pairs, greedy(n, pairs)) - 0.02


def test_numbered_edges_are_those_of_the_view(spark, tmp_path):
    """Also for names that several customers share, names that are null and keys of no row."""
    from quarry.plans import queries
    from quarry.plans.views import view

    d = "/root/testdata/sf0.001"
    for name in "nation region customer supplier part orders lineitem".split():
        rows = spark.read.parquet(f"{d}/{name}.parquet")
        if name == "customer":
            rows = rows.selectExpr("*", "CASE WHEN c_custkey = 3 THEN NULL ELSE concat('c', c_custkey % 40) END AS x").drop("c_name").withColumnRenamed("x", "c_name")
        if name == "supplier":
            rows = rows.where("s_suppkey <> 2").selectExpr("*", "CASE WHEN s_suppkey = 4 THEN NULL ELSE concat('s', s_suppkey % 6) END AS x").drop("s_name").withColumnRenamed("x", "s_name")
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    nodes = view(spark, str(tmp_path), "v_nodes").where("id IS NOT NULL")
    numbers = {name: k for k, name in enumerate(sorted({r.id for r in nodes.collect()}))}
    known = nodes.join(spark.createDataFrame(list(numbers.items()), "id string, n long"), "id").selectExpr("n AS id", "kind", "ord", "file")
    got = {(r.src, r.dst) for r in queries._numbered_edges(spark, str(tmp_path), known).collect()}
    want = {(numbers[r.src], numbers[r.dst]) for r in view(spark, str(tmp_path), "v_edges").where("src IS NOT NULL AND dst IS NOT NULL").collect()}
    assert got == want and len(got) > 100
