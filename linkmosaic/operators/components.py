"""Connected components and spanning forests as DataFrame loops."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkmosaic.sources.shared import discard, materialize


#: Edges up to which one task, or a copy for every task, beats rounds of joins.
SMALL = 200_000


def _min_neighbour(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _min_neighbour(both).select("u", F.least("u", "m").alias("m"))
    return (
        both.filter("v > u")
        .join(least, "u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .filter("u <> v")
        .distinct()
    )


def _small_star(down: DataFrame) -> DataFrame:
    """down: distinct edges from larger to smaller ends, as large-star leaves them."""
    least = _min_neighbour(down)
    hung = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def _in_one_task(g: pd.DataFrame) -> pd.DataFrame:
    ids, at = np.unique(g[["u", "v"]].to_numpy(), return_inverse=True)
    at = at.reshape(-1, 2)
    return pd.DataFrame({"id": ids, "component": ids[merge_pairs(len(ids), at[:, 0], at[:, 1])]})


def merge_pairs(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of everyone's component, for n items and pairs (a, b): hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = 0) -> DataFrame:
    """(u, v) long edges -> (id, component): component is the smallest id reachable.

    With `small`, so many edges at most are given to one task, which spares the rounds.

    Alternating large-star and small-star rounds: every step is a min aggregate (combined on the map
    side) and an equi-join that AQE may split, so a hub costs no more than its edges.  Each round is
    written to the shared folder; the loop ends when a round changes nothing.  Self loops keep their
    node; null ends are dropped; without edges the result is empty.
    """
    given = edges.filter("u is not null and v is not null")
    if small:
        given = materialize(given.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), "cc")
        if given.count() <= small:
            return given.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(_in_one_task, "id long, component long")
    alone = given.filter("u = v").select(F.col("u").cast("long").alias("id")).distinct()
    now = materialize(
        given.filter("u <> v")
        .select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v"))
        .distinct(),
        "cc",
    )
    mark = None
    for _ in range(max_rounds):
        then = materialize(_small_star(_large_star(now)), "cc")
        discard(now)
        now = then
        seen = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1000003)).first()
        if seen == mark:
            break
        mark = seen
    else:
        raise RuntimeError("connected_components did not settle")
    stars = now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("id"), "component").distinct()
    found = stars.union(roots)
    lone = alone.join(found.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    return found.union(lone)
