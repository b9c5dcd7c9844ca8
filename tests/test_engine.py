"""Fixed cases of the engine: sets, forest, loops, greedy choice, leftovers and widening."""

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from linkmosaic.errors import InputError
from linkmosaic.operators import graph, selection
from linkmosaic.operators.selection import Groups, NetworkOptimizer, circuit_utility
from linkmosaic.sources.schema import RasterMeta


def test_groups_join_by_weight():
    g = Groups({1: 5, 2: 3})
    assert g.union(1, 2) and not g.union(2, 1)
    assert g.find(1) == g.find(2)
    assert g.weight(1) == 8 and g.count[g.find(2)] == 2


def solve(spark, nodes, edges, budget, **kw):
    opt = NetworkOptimizer(dict.fromkeys(nodes, 1.0))
    for e in edges:
        opt.add_candidate(*e)
    out = opt.solve(spark, budget, **kw)
    return sorted(r["id"] for r in out["selected"].collect()), out


def test_forest_within_budget(spark):
    ids, out = solve(spark, [1, 2, 3, 4], [(1, 2, 1, 1), (2, 3, 2, 1), (3, 4, 3, 1), (1, 4, 4, 10)], 3)
    assert ids == [1, 2, 3]
    assert out["totals"].first()["total_cost"] == 3
    assert [(r["size"], r["count"]) for r in out["components"].collect()] == [(4.0, 4)]


@pytest.mark.parametrize(("budget", "fraction", "loops", "n"), [(2, 0, 2, 2), (3, 0, 1, 3), (3, 0.05, 2, 2)])
def test_loops(spark, budget, fraction, loops, n):
    ids, _ = solve(spark, [1, 2, 3], [(1, 2, 1, 1), (2, 3, 2, 1), (1, 3, 3, 1), (2, 2, 9, 0)], budget, loop_fraction=fraction, max_redundancy=loops)
    assert len(ids) == n


def pool(rows, weights):
    return [{"id": i, "patch_ids": [a, b], "cost": float(k), "length": float(k), "roi": math.sqrt(weights[a] * weights[b]) / k} for i, a, b, k in rows]


WEIGHTS = {1: 10, 2: 8, 3: 6, 4: 4}
SIX = [(1, 1, 2, 3), (2, 2, 3, 2), (3, 3, 4, 2), (4, 1, 4, 5), (5, 1, 3, 4), (6, 2, 4, 4.5)]


def test_greedy_choice():
    picks, stats = circuit_utility(pool(SIX, WEIGHTS), WEIGHTS, 9)
    assert [p["id"] for p in picks] == [1, 2, 3]
    assert (stats["budget_used"], stats["budget_remaining"], stats["corridors_used"]) == (7, 2, 3)


def test_nothing_to_spend():
    assert circuit_utility(pool(SIX, WEIGHTS), WEIGHTS, 0)[0] == []
    assert circuit_utility([], WEIGHTS, 5)[1]["corridors_used"] == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 6), st.integers(1, 6), st.integers(1, 9)), max_size=14), st.integers(0, 40))
def test_greedy_without_loops_is_a_scan_by_roi(edges, budget):
    weights = {i: float(i) for i in range(1, 7)}
    rows = pool([(i, a, b, k) for i, (a, b, k) in enumerate(edges) if a != b], weights)
    picks, _ = circuit_utility(rows, weights, budget, seeding=False, far_enough=lambda *_: False)
    sets, left, want = Groups(), budget - 1e-3, []
    for c in sorted(rows, key=lambda c: (-c["roi"], c["id"])):
        if c["cost"] <= left and sets.union(*c["patch_ids"]):
            left -= c["cost"]
            want.append(c["id"])
    assert sorted(p["id"] for p in picks) == sorted(want)


def test_leftover_grows_the_main_component_first():
    rows = pool(SIX, WEIGHTS)
    added, stats = selection.spend_leftover(rows, rows[:1], WEIGHTS, 4)
    assert [c["id"] for c in added] == [2, 3] and stats["low_value_added"] == 2


def leftover_by_scan(candidates, selected, weights, budget, bias=0.15):
    """Every pick looks at all candidates again."""
    sets, links, have, added = Groups(weights), selection.Links(), {c["id"] for c in selected}, []
    for c in selected:
        sets.union(*c["patch_ids"])
        links.put(c["patch_ids"], c["length"])
    while budget > 0:
        main = max(dict.fromkeys(sets.find(p) for p in weights), key=lambda r: sets.size[r])
        best = {"grow": (0.0, None), "loop": (0.0, None)}
        for c in candidates:
            a, b = (sets.find(p) for p in c["patch_ids"])
            if c["id"] not in have and c["cost"] <= budget and main in (a, b):
                kind, worth = ("loop", links.worth(*c["patch_ids"], c["length"])) if a == b else ("grow", sets.size[b if a == main else a])
                if worth / c["cost"] > best[kind][0]:
                    best[kind] = (worth / c["cost"], c)
        grow, loop = best["grow"], best["loop"]
        pick = loop[1] if loop[1] and (not grow[1] or loop[0] > grow[0] * (1 + bias)) else grow[1]
        if pick is None:
            return added
        sets.union(*pick["patch_ids"])
        links.put(pick["patch_ids"], pick["length"])
        have.add(pick["id"])
        added.append(pick["id"])
        budget -= pick["cost"]
    return added


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 7), st.integers(1, 7), st.integers(1, 9)), max_size=16), st.integers(0, 4), st.integers(0, 40))
def test_leftover_as_by_scan(edges, n, budget):
    weights = {i: float(i % 4 + 1) for i in range(1, 8)}
    rows = pool([(i, a, b, k) for i, (a, b, k) in enumerate(edges) if a != b], weights)
    added, stats = selection.spend_leftover(rows, rows[:n], weights, budget)
    assert [c["id"] for c in added] == leftover_by_scan(rows, rows[:n], weights, budget)
    assert stats["budget_used"] == sum(c["cost"] for c in added) and stats["low_value_added"] + stats["redundancy_added"] == len(added)


def test_redundant_links_without_length_and_of_three_patches():
    """A null length gives way to the cost; the detour is measured to the last patch."""
    weights = dict.fromkeys((1, 2, 3), 1.0)
    rows = [{"id": i, "patch_ids": ids, "cost": cost, "length": length, "roi": roi} for i, ids, cost, length, roi in [(1, [1, 2], 1.0, 5.0, 9.0), (2, [2, 3], 1.0, 5.0, 8.0), (3, [1, 3], 2.0, None, 1.0), (4, [1, 2, 3], 2.0, 3.0, 0.9)]]
    picks, stats = circuit_utility(rows, weights, 5, seeding=False)
    # 10 / 2 is a detour of 3 or more; after it the way from 1 to 3 is 2, shorter than the link of three patches
    assert [(p["id"], p["kind"]) for p in picks] == [(1, "primary"), (2, "primary"), (3, "redundant")]
    picks, stats = circuit_utility([rows[0], rows[1], rows[3]], weights, 5, seeding=False)
    assert picks[-1]["id"] == 4 and stats["redundant_links"] == 1


def test_thicken_pays_for_new_cells(spark):
    meta = RasterMeta(10, 10)
    c = spark.createDataFrame([(1, 1, 2, 0, [55], [55], 1.0)], "id long, patch1 long, patch2 long, ord int, path_cells array<long>, buffered_cells array<long>, cost double")
    cells = spark.createDataFrame([(54, 3, False), (56, 0, False)], "cell long, patch_id long, obstacle boolean")
    out, spent = selection.thicken(c, cells, 100, 1, 1, meta)
    row = out.first()
    assert row["thicken_factor"] == 3 and spent == len(row["buffered_cells"]) - 1 and row["cost"] == len(row["buffered_cells"])
    assert 54 not in row["buffered_cells"] and 56 in row["buffered_cells"]
    assert selection.thicken(c, cells, 2, 1, 1, meta)[0].first()["thicken_factor"] == 1


def test_thicken_ends_with_the_first_step_that_does_not_fit(spark):
    """Those at the main patch come first; a step that does not fit ends it, though a later one would."""
    rows = [(1, 3, 4, 0, [15], [15], 1.0), (2, 1, 2, 1, [55], [55], 1.0)]
    c = spark.createDataFrame(rows, "id long, patch1 long, patch2 long, ord int, path_cells array<long>, buffered_cells array<long>, cost double")
    cells = spark.createDataFrame([], "cell long, patch_id long, obstacle boolean")
    out, spent = selection.thicken(c, cells, 7, 1, 1, RasterMeta(10, 10))
    assert spent == 4 and {r["id"]: r["thicken_factor"] for r in out.collect()} == {1: 1, 2: 2}


def test_unknown_strategy():
    with pytest.raises(InputError):
        selection.choose("none")


def test_failures_do_not_depend_on_partitions_and_match_enumeration(spark):
    # two triangles joined by one edge, an edge that is there twice, and a vertex alone
    links = [(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5), (5, 6), (6, 5)]
    nodes = spark.createDataFrame([(i,) for i in range(8)], "id long")
    edges = spark.createDataFrame(links, "u long, v long")
    assert graph.failure_probability(nodes, edges).first()[0] == pytest.approx(1 / 9)
    assert graph.two_edge_connectivity(nodes, edges).first()[0] == pytest.approx((3 + 6) / 28)
    chance = [graph.failure_probability(nodes, e, k=2, iterations=400, seed=7).first()[0] for e in (edges, edges.orderBy("v").repartition(5))]
    assert chance[0] == chance[1]

    def parts(kept):
        groups = Groups()
        for u, v in kept:
            groups.union(u, v)
        return len({groups.find(i) for i in range(7)})

    pairs = [(i, j) for i in range(9) for j in range(i)]
    parted = sum(parts([e for n, e in enumerate(links) if n not in p]) > 1 for p in pairs)
    assert chance[0] == pytest.approx(parted / len(pairs), abs=0.08)
