"""Common table expressions that the SQL of the queries is put together from."""

from __future__ import annotations

from linkmosaic.operators.landscape import METRICS

#: name -> (what it needs, its SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "cells": ((), "select p_partkey + 1 as cell, p_partkey // 50 + 1 as r, p_partkey % 50 + 1 as c, p_size::double as value from part"),
    "hab": (("cells",), "select * from cells where value between 1 and 15"),
    "nb8": (("hab",), "select a.cell as a, b.cell as b from hab a join hab b on b.r between a.r - 1 and a.r + 1 and abs(a.c - b.c) <= 1 and a.cell <> b.cell"),
    "nb4": (("hab",), "select a.cell as a, b.cell as b from hab a join hab b on abs(a.r - b.r) + abs(a.c - b.c) = 1"),
    "reach8": (("nb8",), "select cell, cell as root from hab union select nb8.b, reach8.root from reach8 join nb8 on nb8.a = reach8.cell where reach8.root < nb8.b"),
    "reach4": (("nb4",), "select cell, cell as root from hab union select nb4.b, reach4.root from reach4 join nb4 on nb4.a = reach4.cell where reach4.root < nb4.b"),
    "labels8": (("reach8",), "select cell, r, c, dense_rank() over (order by root) as patch_id from (select cell, min(root) as root from reach8 group by cell) join hab using (cell)"),
    "labels4": (("reach4",), "select cell, r, c, dense_rank() over (order by root) as patch_id from (select cell, min(root) as root from reach4 group by cell) join hab using (cell)"),
    "patches": (("labels8",), "select patch_id, count(*) as cell_count, avg(c - 0.5) as x, avg(h - r + 0.5) as y from labels8, (select max(r) as h from cells) group by patch_id"),
    "big": (("patches",), "select * from patches where cell_count >= 3"),
    "bigcells": (("big",), "select l.* from labels8 l join big using (patch_id)"),
    "edge_cells": (("bigcells",), "select t.cell, t.r, t.c, t.patch_id from bigcells t left join bigcells o on o.patch_id = t.patch_id and abs(o.r - t.r) + abs(o.c - t.c) = 1 group by all having count(o.cell) < 4"),
    "thin": (("edge_cells",), "select * from (select *, row_number() over (partition by patch_id, (r - 1) // 2, (c - 1) // 2 order by c, r) as k from edge_cells) where k = 1"),
    "habu": (("cells",), "select * from cells where value between 1 and 15 or value = 20"),
    "nbu": (("habu",), "select a.cell as a, b.cell as b from habu a join habu b on b.r between a.r - 1 and a.r + 1 and abs(a.c - b.c) <= 1 and a.cell <> b.cell"),
    "reachu": (("nbu",), "select cell, cell as root from habu union select nbu.b, reachu.root from reachu join nbu on nbu.a = reachu.cell where reachu.root < nbu.b"),
    "n4": (("hab",), "select t.cell, count(o.cell) as n4 from hab t left join hab o on abs(o.r - t.r) + abs(o.c - t.c) = 1 group by t.cell"),
    "shapes": (("labels8", "n4"), "select patch_id, count(*) as n, sum(4 - n4) as e, sum((n4 = 4)::int) as core, avg(sqrt((c - mc)^2 + (r - mr)^2)) as g from (select *, avg(c) over (partition by patch_id) as mc, avg(r) over (partition by patch_id) as mr from labels8) join n4 using (cell) group by patch_id"),
    "tot": (("shapes",), "select sum(n)::double as nn, count(*)::double as np, sum(e)::double as ee, sum(n * n)::double as a2, max(n)::double as m, sum(core)::double as core, avg(0.25 * e / sqrt(n)) as msi, avg(e / n) as para, coalesce(avg(case when n <> 1 then 2 * ln(0.25 * e) / ln(n) end), 0) as frac, avg(g) as g_all, avg(g) filter (patch_id <= 200) as g_first from shapes"),
    "metrics": (("tot",), "select nn as total_area, np as num_patches, ee as total_edge, a2 / nn as mesh, nn * nn / a2 as split, m as lps, 100 * m / nn as lpi, 100 * np / nn as pd, ee / nn as ed, msi, para as mean_para, frac, (4 * nn - ee) / 2 / (2 * nn - 2 * sqrt(nn) - 2) * 100 as ai, 100 * core / nn as cai, case when np > 1000 then g_first else g_all end as mean_gyrate from tot"),
    "nodes": ((), "select n_nationkey::bigint as id, (select count(*) from customer where c_nationkey = n_nationkey)::double as weight from nation"),
    "trade": ((), "select least(s_nationkey, c_nationkey)::bigint as u, greatest(s_nationkey, c_nationkey)::bigint as v, count(*) as cost from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey where s_nationkey <> c_nationkey group by 1, 2"),
    "edges": (("nodes", "trade"), "select u, v, cost, row_number() over (order by u, v) as id from trade"),
    # an edge is in the forest if its ends are not connected by edges before it
    "ranked": (("edges",), "select *, row_number() over (order by cost, id) as k from edges"),
    "rankedboth": (("ranked",), "select u as a, v as b, k from ranked union all select v, u, k from ranked"),
    "before": (("rankedboth",), "select k, u as at from ranked union select before.k, r.b from before join rankedboth r on r.a = before.at and r.k < before.k"),
    "forest": (("before",), "select r.* from ranked r where not exists (select 1 from before b where b.k = r.k and b.at = r.v)"),
    "treeboth": (("forest",), "select u as a, v as b from forest union all select v, u from forest"),
    "hops": (("treeboth",), "select id as s, id as t, 0 as d from nodes union select h.s, e.b, h.d + 1 from hops h join treeboth e on e.a = h.t where h.d < 24"),
    "budget": (("edges",), "select cast(trunc(sum(cost) / 10) as bigint) as b from edges"),
    "main": (("forest", "budget"), "select u, v, id, cost from (select *, sum(cost) over (order by cost, id) as spent from forest), budget where spent <= b"),
    "mainboth": (("main",), "select u as a, v as b from main union all select v, u from main"),
    "mainreach": (("mainboth",), "select id, id as root from nodes union select m.b, r.root from mainreach r join mainboth m on m.a = r.id where r.root < m.b"),
    "mainparts": (("mainreach",), "select id, min(root) as root from mainreach group by id"),
    "loops": (("mainparts",), "select e.*, row_number() over (partition by p.root order by cost, e.id) as j from edges e join mainparts p on p.id = e.u join mainparts q on q.id = e.v and q.root = p.root, budget where e.cost <= b * 0.05 and e.id not in (select id from main)"),
    "chosen": (("loops",), "select id, u, v, cost, 'tree' as kind from main union all select id, u, v, cost, 'loop' from (select *, sum(cost) over (order by cost, id) as spent from loops where j <= 2), budget where spent + (select sum(cost) from main) <= b"),
    # the graph of the metrics: what is chosen from all edges
    "few": (("chosen",), "select u, v, id, cost from chosen"),
    "fewboth": (("few",), "select u as a, v as b, cost from few union all select v, u, cost from few"),
    "fewreach": (("fewboth",), "select id, id as root from nodes union select fewboth.b, fewreach.root from fewreach join fewboth on fewboth.a = fewreach.id where fewreach.root < fewboth.b"),
    "parts": (("fewreach",), "select id, min(root) as root from fewreach group by id"),
    "without": (("few", "fewboth"), "select f.id as k, f.u as at from few f union select w.k, e.b from without w join few f on f.id = w.k join fewboth e on e.a = w.at where not (least(e.a, e.b) = f.u and greatest(e.a, e.b) = f.v)"),
    "bridges": (("without",), "select f.* from few f where not exists (select 1 from without w where w.k = f.id and w.at = f.v)"),
    "firm": (("bridges",), "select u as a, v as b from few where id not in (select id from bridges) union all select v, u from few where id not in (select id from bridges)"),
    "blocks": (("firm",), "select id, id as root from nodes union select firm.b, blocks.root from blocks join firm on firm.a = blocks.id where blocks.root < firm.b"),
    # no path between neighbours costs more than the dearest edge
    "walks": (("fewboth",), "select id as s, id as t, 0::bigint as d from nodes union select w.s, e.b, w.d + e.cost from walks w join fewboth e on e.a = w.t where e.b <> w.s and w.d + e.cost <= (select max(cost) from few)"),
    "fewhops": (("fewboth",), "select id as s, id as t, 0 as d from nodes union select h.s, e.b, h.d + 1 from fewhops h join fewboth e on e.a = h.t where h.d < 24"),
    "sides": (("edges",), "select *, row_number() over (partition by mid order by roi desc, id) as k from (select u as mid, v as far, f.id, cost, sqrt(x.weight * y.weight) / cost as roi from edges f join nodes x on x.id = u join nodes y on y.id = v union all select v, u, f.id, cost, sqrt(x.weight * y.weight) / cost from edges f join nodes x on x.id = u join nodes y on y.id = v)"),
    "roi": (("edges",), "select e.id, u, v, cost, row_number() over (order by sqrt(x.weight * y.weight) / cost desc, e.id) as k from edges e join nodes x on x.id = u join nodes y on y.id = v"),
    "scan": (
        ("roi",),
        "select r_regionkey::bigint as scenario_id, 0::bigint as k, 50.0 * (r_regionkey + 1) - 0.001 as money, (select list(id order by id) from nodes) as root, null::bigint as took from region "
        "union all select s.scenario_id, r.k, case when ok then s.money - r.cost else s.money end, case when ok then list_transform(s.root, lambda x: case when x = s.root[r.v + 1] then s.root[r.u + 1] else x end) else s.root end, case when ok then r.id end "
        "from (select s.*, r.cost <= s.money and s.root[r.u + 1] <> s.root[r.v + 1] as ok, r.id as rid from scan s join roi r on r.k = s.k + 1) s join roi r on r.id = s.rid",
    ),
    "scanned": (("scan",), "select scenario_id, took as id from scan where took is not null"),
}


def cte(*names: str) -> str:
    """The named expressions and what they need, each once, in order."""
    done: list[str] = []

    def add(name: str) -> None:
        for x in CTES[name][0]:
            add(x)
        if name not in done:
            done.append(name)

    for name in names:
        add(name)
    return "with recursive " + ",\n".join(f"{n} as ({CTES[n][1]})" for n in done)


def sql(body: str, *names: str) -> str:
    return f"{cte(*names)}\n{body}" if names else body


def prune(body: str) -> str:
    return body.format(cols=", ".join(f"round({m}, 6) as {m}" for m in METRICS))
