"""Choice of corridors under a budget: spanning forest with loops, and greedy return on investment."""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Callable, Iterable
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkmosaic.errors import InputError
from linkmosaic.operators.components import connected_components
from linkmosaic.operators.graph import SMALL, component_sizes, components
from linkmosaic.operators.masks import disc_offsets, shifted
from linkmosaic.sources.schema import RasterMeta
from linkmosaic.sources.shared import discard, materialize


class Groups:
    """Disjoint sets with weights; the heavier root stays, on a tie that of the first argument."""

    def __init__(self, weights: dict | None = None) -> None:
        self.up: dict = {}
        self.size: dict = defaultdict(float)
        self.count: dict = defaultdict(int)
        for k, w in (weights or {}).items():
            self.up[k], self.size[k], self.count[k] = k, float(w), 1

    def find(self, x):
        self.up.setdefault(x, x)
        root = x
        while self.up[root] != root:
            root = self.up[root]
        while self.up[x] != root:
            self.up[x], x = root, self.up[x]
        return root

    def union(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.size[a] < self.size[b]:
            a, b = b, a
        self.up[b] = a
        self.size[a] += self.size[b]
        self.count[a] += self.count[b]
        return True

    def weight(self, x) -> float:
        return self.size[self.find(x)]


class Links:
    """Undirected weighted graph of chosen links; a link set twice has its last length."""

    def __init__(self) -> None:
        self.near: dict = defaultdict(dict)

    def put(self, ids: Iterable, length: float) -> None:
        ids = list(ids)
        for other in ids[1:]:
            self.near[ids[0]][other] = self.near[other][ids[0]] = length

    def distance(self, a, b) -> float:
        best, heap = {a: 0.0}, [(0.0, a)]
        while heap:
            d, x = heapq.heappop(heap)
            if x == b:
                return d
            if d > best[x]:
                continue
            for y, w in self.near[x].items():
                if d + w < best.get(y, math.inf):
                    best[y] = d + w
                    heapq.heappush(heap, (d + w, y))
        return math.inf

    def worth(self, a, b, length: float) -> float:
        """Multiplier of a redundant link by the path that it shortens."""
        if not math.isfinite(length) or length <= 0:
            return 0.1
        path = self.distance(a, b)
        if math.isinf(path):
            return 0.5
        return 0.9 if path / length >= 3 else 0.5 if path / length >= 1.5 else 0.1


# ---------------------------------------------------------------- spanning forest


def running_total(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the running sum of `value` in a total order, without a window over all rows.

    Rows are range-partitioned by the order; each partition sums its own, and the sums of the partitions
    before are added: one row a partition.
    """
    held = materialize(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "running")
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("_p").agg(F.sum(value).alias("_s")).select("_p", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inside = F.sum(value).over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return held.withColumn("_i", inside).join(offsets, "_p").withColumn(name, F.col("_off") + F.col("_i")).drop("_p", "_i", "_off")


def spanning_forest(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """edges(u, v, id, cost) -> the edges of the least forest under (cost, id).

    Few edges: Kruskal in one task.  More: rounds in which every component takes its least outgoing edge,
    which the total order makes free of cycles; components follow by star rounds.
    """
    held = edges.filter("u <> v")
    if held.count() <= small:

        def kruskal(g: pd.DataFrame) -> pd.DataFrame:
            sets, keep = Groups(), []
            for i, u, v in g.sort_values(["cost", "id"])[["u", "v"]].itertuples():
                if sets.union(u, v):
                    keep.append(i)
            return g.loc[keep].drop(columns="_one")

        return held.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(kruskal, held.schema)
    chosen = None
    now = materialize(held.withColumn("a", F.col("u")).withColumn("b", F.col("v")), "forest")
    while now.limit(1).count():
        both = now.select(F.col("a").alias("k"), "id", "cost").unionAll(now.select(F.col("b").alias("k"), "id", "cost"))
        best = both.groupBy("k").agg(F.min(F.struct("cost", "id")).alias("m")).select("m.id").distinct()
        took = materialize(now.join(best, "id", "left_semi"), "forest")
        chosen = took if chosen is None else chosen.unionByName(took)
        roots = materialize(connected_components(took.select(F.col("a").alias("u"), F.col("b").alias("v"))), "forest")
        moved = now.join(roots.select(F.col("id").alias("a"), F.col("component").alias("ra")), "a", "left").join(roots.select(F.col("id").alias("b"), F.col("component").alias("rb")), "b", "left")
        moved = moved.withColumn("a", F.coalesce("ra", "a")).withColumn("b", F.coalesce("rb", "b")).filter("a <> b").select(*now.columns)
        then = materialize(moved, "forest")
        discard(now)
        now = then
    return chosen.select(*edges.columns) if chosen is not None else edges.limit(0)


def largest_network(nodes: DataFrame, edges: DataFrame, budget: float, loop_fraction: float | None = 0.05, max_redundancy: int = 2) -> dict[str, DataFrame]:
    """nodes(id, weight), edges(u, v, id, cost) -> selected (with kind), components(component, size, count), totals.

    The forest's edges are taken by cost while they fit the budget; then edges inside a component, at most
    max_redundancy of each, none above loop_fraction of the budget (0 or None: no such cap), while they fit.
    """
    missing = {"u", "v", "id", "cost"} - set(edges.columns)
    if missing:
        raise InputError(f"edges lack {', '.join(sorted(missing))}")
    eps = 1e-9 * max(1.0, abs(budget))
    main = running_total(spanning_forest(edges.select("u", "v", "id", "cost")), ["cost", "id"], "cost", "spent").filter(F.col("spent") <= budget + eps)
    main = materialize(main.select("u", "v", "id", "cost"), "network")
    used = float(main.agg(F.sum("cost")).first()[0] or 0)
    parts = materialize(components(nodes, main), "network")
    picked = main.withColumn("kind", F.lit("tree"))
    if used < budget and max_redundancy > 0:
        rest = edges.select("u", "v", "id", "cost").filter("u <> v").join(main.select("id"), "id", "left_anti")
        inside = rest.join(parts.select(F.col("id").alias("u"), F.col("component").alias("cu")), "u").join(parts.select(F.col("id").alias("v"), F.col("component").alias("cv")), "v").filter("cu = cv")
        if loop_fraction:
            inside = inside.filter(F.col("cost") <= budget * loop_fraction + eps)
        few = inside.withColumn("_k", F.row_number().over(Window.partitionBy("cu").orderBy("cost", "id"))).filter(F.col("_k") <= max_redundancy)
        loops = running_total(few.select("u", "v", "id", "cost"), ["cost", "id"], "cost", "spent").filter(F.col("spent") + used <= budget + eps)
        picked = picked.unionByName(loops.select("u", "v", "id", "cost").withColumn("kind", F.lit("loop")))
    picked = materialize(picked, "network")
    totals = picked.agg(F.coalesce(F.sum("cost").cast("double"), F.lit(0.0)).alias("total_cost"), F.count("*").alias("selected"))
    return {"selected": picked, "components": component_sizes(nodes, main), "totals": totals}


class NetworkOptimizer:
    """Collects candidates one by one, then solves as largest_network does."""

    def __init__(self, nodes: dict) -> None:
        self.nodes = {int(k): float(v) for k, v in nodes.items()}
        self.edges: list[tuple] = []

    def add_candidate(self, u, v, cand_id, cost: float) -> None:
        if int(u) != int(v):
            self.edges.append((int(u), int(v), int(cand_id), float(cost)))

    def solve(self, spark, budget: float, loop_fraction: float | None = 0.05, max_redundancy: int = 2) -> dict[str, DataFrame]:
        nodes = spark.createDataFrame(list(self.nodes.items()), "id long, weight double")
        edges = spark.createDataFrame(self.edges, "u long, v long, id long, cost double")
        return largest_network(nodes, edges, budget, loop_fraction, max_redundancy)


optimize_network = optimize_largest_network = engine = largest_network


# ---------------------------------------------------------------- greedy return on investment


def circuit_utility(
    candidates: list[dict],
    weights: dict,
    budget: float,
    *,
    pair_limit: int | None = None,
    overlap: Callable[[dict, dict], float] | None = None,
    far_enough: Callable[[dict, list[dict]], bool] | None = None,
    seeding: bool = True,
    per_midpoint: int = 25,
    recent: int = 3,
    most_overlap: float = 0.3,
    overlap_worth: float = 0.01,
) -> tuple[list[dict], dict]:
    """Picks of candidates (id, patch_ids, cost, length, roi), in the order of choice, and their totals.

    Runs in one task: every choice changes the scores of the rest.  A lazy heap holds base ROI at first; a
    candidate is scored anew when it comes up, and goes back if the score differs: ROI times the lighter
    component that it joins, or times the worth of a loop.  Pairs of links through a patch may be chosen
    before all, by the size of what they connect over cost.
    """
    guard = max(1e-3, abs(budget) * 1e-12)
    left = budget - guard
    stats = {"budget_used": 0.0, "budget_remaining": max(left, 0.0), "primary_links": 0, "redundant_links": 0, "wasteful_links": 0, "corridors_used": 0}
    fine = lambda x: x is not None and math.isfinite(x) and x > 0
    pool = [c for c in candidates if fine(c["roi"]) and fine(c["cost"]) and len(c["patch_ids"]) >= 2]
    if left <= 0 or not pool:
        return [], stats
    sets, links, picks, taken = Groups(weights), Links(), [], set()
    per_pair: dict = defaultdict(list)
    pair_of = lambda c: tuple(sorted(c["patch_ids"][:2]))

    def commit(i: int, kind: str) -> None:
        nonlocal left
        c = pool[i]
        taken.add(i)
        for other in c["patch_ids"][1:]:
            sets.union(c["patch_ids"][0], other)
        length = c.get("length")
        links.put(c["patch_ids"], length if fine(length) else c["cost"])
        left -= c["cost"]
        per_pair[pair_of(c)].append(c)
        picks.append({**c, "kind": kind})
        stats[f"{kind}_links"] += 1

    if seeding:
        by_mid: dict = defaultdict(list)
        for i, c in enumerate(pool):
            a, b = c["patch_ids"][:2]
            by_mid[a].append((i, b))
            by_mid[b].append((i, a))
        double = []
        for items in by_mid.values():
            top = sorted(items, key=lambda x: -pool[x[0]]["roi"])[:per_midpoint] if len(items) > per_midpoint else items
            for (i, a), (j, b) in combinations(top, 2):
                cost = pool[i]["cost"] + pool[j]["cost"]
                wa, wb = weights.get(a, 0), weights.get(b, 0)
                if a != b and cost <= left and wa > 0 and wb > 0:
                    double.append((math.sqrt(wa * wb) / cost, cost, i, j, a, b))
        for _, cost, i, j, a, b in sorted(double, key=lambda x: -x[0]):
            if cost <= left and sets.find(a) != sets.find(b) and i not in taken and j not in taken:
                commit(i, "primary")
                commit(j, "primary")

    heap = [(-c["roi"], i, i) for i, c in enumerate(pool)]
    heapq.heapify(heap)
    turn = len(pool)
    while heap and left > 0:
        score, _, i = heapq.heappop(heap)
        c = pool[i]
        if i in taken or c["cost"] > left or (pair_limit is not None and len(per_pair[pair_of(c)]) >= pair_limit):
            continue
        roots = {sets.find(p) for p in c["patch_ids"]}
        if len(roots) > 1:
            worth = min(sets.size[r] for r in roots)
            worth, kind = (worth if worth > 0 else 1.0), "primary"
        else:
            if far_enough and picks and not far_enough(c, picks):
                continue
            shared = max((overlap(c, p) for p in per_pair[pair_of(c)][-recent:]), default=0.0) if overlap else 0.0
            length = c.get("length")
            worth = overlap_worth if shared > most_overlap else links.worth(c["patch_ids"][0], c["patch_ids"][-1], length if fine(length) else c["cost"])
            kind = "wasteful" if worth <= 0.1 else "redundant"
        now = c["roi"] * worth
        if abs(now + score) > 1e-12:
            heapq.heappush(heap, (-now, turn, i))
            turn += 1
        else:
            commit(i, kind)
    spent = sum(p["cost"] for p in picks)
    return picks, stats | {"budget_used": spent, "budget_remaining": budget - spent, "corridors_used": len(picks)}


def spend_leftover(candidates: list[dict], selected: list[dict], weights: dict, budget: float, bias: float = 0.15) -> tuple[list[dict], dict]:
    """Adds links to a selection: the one that brings the main component most weight for its cost, or a loop in it if that is worth `bias` more.

    The main component is the heaviest and only grows, so the weight that a link brings is fixed as soon as
    it leads out of it, and the worth of a loop only falls: two lazy heaps hold them, ties to the earlier.
    """
    sets, links, have = Groups(weights), Links(), {c["id"] for c in selected}
    length = lambda c: c["length"] if c.get("length") and c["length"] > 0 else c["cost"]
    for c in selected:
        sets.union(*c["patch_ids"][:2])
        links.put(c["patch_ids"][:2], length(c))
    main = max(dict.fromkeys(sets.find(p) for p in weights), key=lambda r: sets.size[r], default=None)
    if main is None:
        return [], {"budget_used": 0.0, "low_value_added": 0, "redundancy_added": 0}
    members, at = defaultdict(list), defaultdict(list)
    for p in weights:
        members[sets.find(p)].append(p)
    for k, c in enumerate(candidates):
        if c["id"] not in have and 0 < c["cost"] <= budget:
            for p in c["patch_ids"][:2]:
                at[p].append(k)
    grow: list[tuple[float, int]] = []
    loop: list[tuple[float, int]] = []
    worth = lambda c: links.worth(*c["patch_ids"][:2], length(c)) / c["cost"]

    def reach(patches: list) -> None:
        """Links at patches that have just become part of the main component."""
        for p in patches:
            for k in at[p]:
                c = candidates[k]
                a, b = (sets.find(x) for x in c["patch_ids"][:2])
                if a == b:
                    heapq.heappush(loop, (-worth(c), k))
                elif sets.size[b if a == main else a] > 0:
                    heapq.heappush(grow, (-sets.size[b if a == main else a] / c["cost"], k))

    def best(heap: list[tuple[float, int]], loops: bool) -> tuple[float, int | None]:
        while heap:
            score, k = heap[0]
            c = candidates[k]
            if c["id"] in have or c["cost"] > budget or (not loops and sets.find(c["patch_ids"][0]) == sets.find(c["patch_ids"][1])):
                heapq.heappop(heap)
                continue
            now = -worth(c) if loops else score
            if now == score:
                return -score, k
            heapq.heapreplace(heap, (now, k))
        return 0.0, None

    reach(members[main])
    added, n_loops, spent = [], 0, 0.0
    while budget > 0:
        (gain, g), (again, r) = best(grow, False), best(loop, True)
        k = r if r is not None and (g is None or again > gain * (1 + bias)) else g
        if k is None:
            break
        n_loops += k is r
        pick = candidates[k]
        roots = [sets.find(p) for p in pick["patch_ids"][:2]]
        have.add(pick["id"])
        links.put(pick["patch_ids"][:2], length(pick))
        if sets.union(*pick["patch_ids"][:2]):
            new = members.pop(roots[1] if roots[0] == main else roots[0])
            main = sets.find(pick["patch_ids"][0])
            reach(new)
        added.append(pick)
        budget -= pick["cost"]
        spent += pick["cost"]
    return added, {"budget_used": spent, "low_value_added": len(added) - n_loops, "redundancy_added": n_loops}


def thicken(selected: DataFrame, cells: DataFrame, budget: float, width: float, main: int | None, meta: RasterMeta, most: int = 3) -> tuple[DataFrame, float]:
    """Widens corridors to 2 and 3 times the width while new cells fit the budget; those at the patch `main` first.

    selected(id, patch1, patch2, ord, path_cells, buffered_cells, cost, ...), cells(cell, patch_id, obstacle):
    patches and obstacles stay free.  -> the same with thicken_factor, and what the new cells cost.  The
    first step that does not fit ends it for all: the steps taken are those up to which the running sum of
    new cells, in order, fits.  Every corridor gets the blocked cells of its own reach only.
    """
    if budget <= 0:
        return selected.withColumn("thicken_factor", F.lit(1)), 0.0
    reach = disc_offsets(max(1, round(width * most)))
    path = selected.select("id", F.explode("path_cells").alias("cell"))
    path = path.select("id", (F.floor((F.col("cell") - 1) / meta.ncol) + 1).cast("long").alias("r"), ((F.col("cell") - 1) % meta.ncol + 1).cast("long").alias("c"))
    around = shifted(path, reach, meta).select("id", F.col("target").alias("cell")).distinct()
    blocked = cells.filter("patch_id > 0 or obstacle").select("cell")
    shut = around.join(blocked, "cell").groupBy("id").agg(F.collect_list("cell").alias("shut"))
    nrow, ncol = meta.nrow, meta.ncol

    def run(batches):
        for b in batches:
            rows = []
            for i, cells_of, held, cut in b[["id", "path_cells", "buffered_cells", "shut"]].itertuples(index=False):
                now, out = set(held.tolist()), []
                for factor in range(2, most + 1) if len(cells_of) else ():
                    wider = widened(cells_of.tolist(), nrow, ncol, max(1, round(width * factor)), set() if cut is None else set(cut.tolist()))
                    out.append((i, factor, len(wider - now), sorted(wider)))
                    now = wider
                rows += out
            yield pd.DataFrame(rows, columns=["id", "factor", "extra", "wider"])

    steps = materialize(selected.select("id", "path_cells", "buffered_cells").join(shut, "id", "left").mapInPandas(run, "id long, factor int, extra long, wider array<long>"), "thicken")
    away = ~((F.col("patch1") == main) | (F.col("patch2") == main)) if main is not None else F.lit(True)
    slim = steps.select("id", "factor", "extra").join(selected.select("id", "ord", away.alias("away")), "id")
    paid = running_total(slim, ["away", "ord", "factor"], "extra", "spent")
    before = F.col("spent") - F.sum("extra").over(Window.partitionBy("id").orderBy("factor").rowsBetween(Window.unboundedPreceding, 0))
    taken = materialize(paid.withColumn("_before", before).filter((F.col("spent") <= budget) & (F.col("_before") < budget)).select("id", "factor", "extra"), "thicken")
    spent = float(taken.agg(F.coalesce(F.sum("extra"), F.lit(0))).first()[0])
    last = steps.join(taken.groupBy("id").agg(F.max("factor").alias("factor")), ["id", "factor"]).select("id", F.col("factor").alias("_f"), "wider")
    out = selected.join(last, "id", "left").withColumns(
        {"thicken_factor": F.coalesce("_f", F.lit(1)), "buffered_cells": F.coalesce("wider", "buffered_cells"), "cost": F.coalesce(F.size("wider").cast("double"), "cost")}
    )
    return out.drop("_f", "wider"), spent


def widened(path: Iterable[int], nrow: int, ncol: int, width: float, blocked: set) -> set:
    out = set()
    for cell in path:
        r, c = divmod(cell - 1, ncol)
        for dr, dc in disc_offsets(width):
            if 0 <= r + dr < nrow and 0 <= c + dc < ncol:
                out.add((r + dr) * ncol + c + dc + 1)
    return out - blocked


def scenario_sweep(candidates: DataFrame, patches: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Greedy choice for many budgets at once: one task a scenario (scenario_id, budget).

    candidates(id, patch1, patch2, cost, length, roi), patches(patch_id, weight).  -> scenario_id, ord, id, kind, cost.
    """
    pack = candidates.agg(F.sort_array(F.collect_list(F.struct("id", "patch1", "patch2", "cost", "length", "roi"))).alias("c"))
    sizes = patches.agg(F.collect_list(F.struct("patch_id", "weight")).alias("w"))
    rows = scenarios.crossJoin(pack).crossJoin(sizes)

    def run(batches):
        for b in batches:
            for sid, budget, c, w in b[["scenario_id", "budget", "c", "w"]].itertuples(index=False):
                pool = [{"id": x["id"], "patch_ids": [x["patch1"], x["patch2"]], "cost": x["cost"], "length": x["length"], "roi": x["roi"]} for x in c]
                picks, _ = circuit_utility(pool, {x["patch_id"]: x["weight"] for x in w}, budget)
                yield pd.DataFrame([(sid, k, p["id"], p["kind"], p["cost"]) for k, p in enumerate(picks)], columns=["scenario_id", "ord", "id", "kind", "cost"])

    return rows.repartition("scenario_id").mapInPandas(run, "scenario_id long, ord int, id long, kind string, cost double")


def bridge_pairs(candidates: DataFrame, patches: DataFrame, budget: float, per_midpoint: int = 25) -> DataFrame:
    """Pairs of links through a patch with their score: mid, id1, id2, far1, far2, cost, score."""
    held = candidates.filter((F.col("roi") > 0) & (F.col("cost") > 0))
    at = lambda mid, far: held.select(F.col(mid).alias("mid"), F.col(far).alias("far"), "id", "cost", "roi")
    top = Window.partitionBy("mid").orderBy(F.col("roi").desc(), "id")
    near = at("patch1", "patch2").unionAll(at("patch2", "patch1")).withColumn("_k", F.row_number().over(top)).filter(F.col("_k") <= per_midpoint).drop("_k", "roi")
    sized = near.join(patches.select(F.col("patch_id").alias("far"), "weight"), "far").filter("weight > 0")
    side = lambda i: sized.select("mid", F.col("id").alias(f"id{i}"), F.col("far").alias(f"far{i}"), F.col("cost").alias(f"cost{i}"), F.col("weight").alias(f"w{i}"))
    both = side(1).join(side(2), "mid").filter("id1 < id2 and far1 <> far2").withColumn("cost", F.col("cost1") + F.col("cost2")).filter(F.col("cost") <= budget)
    return both.select("mid", "id1", "id2", "far1", "far2", "cost", (F.sqrt(F.col("w1") * F.col("w2")) / F.col("cost")).alias("score"))


def one_per_pair(candidates: DataFrame) -> DataFrame:
    """The first candidate, by id, of every unordered pair of patches."""
    first = Window.partitionBy(F.least("patch1", "patch2"), F.greatest("patch1", "patch2")).orderBy("id")
    return candidates.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k")


def choose(strategy: str, **given):
    """largest_network, or circuit_utility (also named most_connectivity)."""
    if strategy == "largest_network":
        return largest_network(given["nodes"], given["edges"], given["budget"])
    if strategy in ("circuit_utility", "most_connectivity"):
        return circuit_utility(given["candidates"], given["weights"], given["budget"], **given.get("options", {}))
    raise InputError(f"unknown strategy {strategy!r}")
