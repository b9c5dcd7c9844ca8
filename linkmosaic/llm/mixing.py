"""Mixing sources to target weights by weighted pivotal dependent rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkmosaic.llm.common import SPACED_WORD, table, text_of, unit
from linkmosaic.sources.shared import materialize

FAN_IN = 64
WEIGHTS = (5.0, 2.0, 1.0)


def source_targets(sizes: DataFrame, share: float = 1.0, weights: tuple = WEIGHTS, cap: float = 3.0) -> DataFrame:
    """(source, size) -> one row a source: source_size, n_docs, target, rate.

    Sources by code point, null last, take the weights in turn.  A common level L gives the target
    min(cap * source_size, L * weight), with L such that the targets add up to share * all sizes: the
    fixed point of giving the excess of capped sources to the others by weight.  A source without
    words has target 0.  The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(cap))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = (
        per.withColumn("_total", F.sum("source_size").over(everything) * float(share))
        .withColumn("_full", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_open", F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / F.col("_open"))
    )
    # the first source whose cap lies above the level that it would open stops the filling
    level = F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct("_full", "_level"))).over(everything)["_level"]
    target = F.least(F.col("_cap"), F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))
    return per.select(
        "source", "source_size", "n_docs",
        target.alias("target"),
        F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"),
    )


def _pivot(units: Column, level: int, seed: int) -> Column:
    """Array of units (key, w, p, ...) -> array of (i, p) by position, all but one of them integral.

    Two units keep p1 * w1 + p2 * w2: mass flows one way or the other, with chances that leave both
    expectations as they are, until one of the two is 0 or 1.
    """
    entry = "struct<i:int,p:double>"
    first = F.struct(F.lit(0).alias("i"), units[0]["p"].alias("p"), units[0]["w"].alias("w"), F.array().cast(f"array<{entry}>").alias("done"), F.lit(0).alias("at"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + 1
        ratio = x["w"] / s["w"]
        up, down = F.least(1 - s["p"], x["p"] * ratio), F.least(s["p"], (1 - x["p"]) * ratio)
        rise = unit(x["key"], F.lit(seed), F.lit(level)) * (up + down) < down
        held_p = F.when(rise, F.when(1 - s["p"] <= x["p"] * ratio, F.lit(1.0)).otherwise(s["p"] + up)).otherwise(
            F.when(s["p"] <= (1 - x["p"]) * ratio, F.lit(0.0)).otherwise(s["p"] - down)
        )
        new_p = F.when(rise, F.when(x["p"] * ratio <= 1 - s["p"], F.lit(0.0)).otherwise(x["p"] - up / ratio)).otherwise(
            F.when((1 - x["p"]) * ratio <= s["p"], F.lit(1.0)).otherwise(x["p"] + down / ratio)
        )
        moved = F.struct(held_p.alias("a"), new_p.alias("b"))

        def settle(m: Column) -> Column:
            held_done = (m["a"] <= 0) | (m["a"] >= 1)
            gone = F.when(held_done, F.struct(s["i"].alias("i"), m["a"].alias("p"))).otherwise(F.struct(at.alias("i"), m["b"].alias("p")))
            return F.struct(
                F.when(held_done, at).otherwise(s["i"]).alias("i"),
                F.when(held_done, m["b"]).otherwise(m["a"]).alias("p"),
                F.when(held_done, x["w"]).otherwise(s["w"]).alias("w"),
                F.array_append(s["done"], gone.cast(entry)).alias("done"),
                at.alias("at"),
            )

        whole = F.struct(F.when((s["p"] <= 0) | (s["p"] >= 1), s["p"]).otherwise(moved["a"]).alias("a"), F.when((s["p"] <= 0) | (s["p"] >= 1), x["p"]).otherwise(moved["b"]).alias("b"))
        return F.transform(F.array(whole), settle)[0]

    rest = F.slice(units, 2, F.greatest(F.size(units) - 1, F.lit(0)))
    return F.aggregate(rest, first, step, lambda s: F.array_append(s["done"], F.struct(s["i"].alias("i"), s["p"].alias("p")).cast(entry)))


def _settle_rest(rows: DataFrame, cap: float, seed: int) -> DataFrame:
    """Rows (source, size, uid, target, copies, ...) with the words that a source is off its target given to or taken from light rows.

    What pivoting leaves is half of a heavy row's words at most.  Of the rows no heavier than that, FAN_IN
    drawn by hash are gone through from the heaviest on, and those that fit change by one copy.
    """
    off = rows.groupBy("source").agg((F.max("target") - F.sum(F.col("copies") * F.col("size"))).alias("off")).withColumnRenamed("source", "of")
    near = rows.join(off, F.col("source").eqNullSafe(F.col("of"))).filter((F.col("size") > 0) & (F.col("size") <= F.abs("off")))
    near = near.filter(F.when(F.col("off") > 0, F.col("copies") < math.floor(cap)).otherwise(F.col("copies") > 0))
    drawn = Window.partitionBy("source").orderBy(F.xxhash64("key", F.lit(seed + 1)), "uid")
    few = near.withColumn("_k", F.row_number().over(drawn)).filter(F.col("_k") <= FAN_IN)
    lots = few.groupBy("source").agg(F.max("off").alias("off"), F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("o"), "key", "uid"))).alias("units"))
    first = F.struct(F.abs("off").alias("left"), F.array().cast("array<long>").alias("took"))
    fill = lambda s, x: F.when(-x["o"] <= s["left"], F.struct((s["left"] + x["o"]).alias("left"), F.array_append(s["took"], x["uid"]).alias("took"))).otherwise(s)
    change = lots.select(F.explode(F.aggregate("units", first, fill)["took"]).alias("uid"), F.signum("off").cast("int").alias("more"))
    return rows.join(change, "uid", "left").withColumn("copies", F.col("copies") + F.coalesce("more", F.lit(0))).drop("more")


def pivotal_copies(df: DataFrame, carry: list[str], seed: int = 7, cap: float = 3.0, share: float = 1.0, weights: tuple = WEIGHTS) -> DataFrame:
    """Rows (source, size, key, *carry) -> the rows with source_size, target, copies (carry must not name the others).

    A row has the expectation rate = target / source_size of copies: its whole part for certain, the
    rest p by dependent rounding.  Rows of one source are hashed to groups of about FAN_IN; a group
    pairs its units and leaves one fractional unit; the left-over units of FAN_IN groups meet at the
    next level, until each source has one, which is rounded to the nearer integer.  The words that it
    is off its target are then carried to light rows.  No group grows with the data.

    Rows of no words take the whole part and an independent draw.  Null sources are a source of their
    own.  Repeated rows are units of their own.  Draws are hashes of the row, so reruns agree.  No rows:
    no rows.
    """
    targets = source_targets(df.select("source", "size"), share, weights, cap)
    joined = df.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    base = joined.select(
        "d.*", "t.source_size", "t.target", "t.n_docs",
        F.floor("t.rate").cast("int").alias("whole"),
        (F.col("t.rate") - F.floor("t.rate")).alias("p"),
        F.col("d.size").cast("double").alias("w"),
    )
    loose = (F.col("size") <= 0) | (F.col("p") <= 0)
    drawn = F.when(loose, (unit(F.col("key"), F.lit(seed)) < F.col("p")).cast("double")).otherwise(F.col("p"))
    groups = F.ceil(F.col("n_docs") / FAN_IN).cast("long")
    state = materialize(
        base.withColumn("uid", F.monotonically_increasing_id()).withColumn("open", ~loose).withColumn("p", drawn).withColumn("g", F.pmod(F.xxhash64("key", F.lit(seed)), groups)), "mix"
    )
    most = state.agg(F.max("n_docs")).first()[0] or 0
    # uid comes last: it tells equal rows apart, and must not order others
    cols = ["source", "size", "key", *carry, "source_size", "target", "n_docs", "whole", "w", "g", "uid"]
    settled = state.filter(~F.col("open")).select(*cols, "p")
    left, level = state.filter("open"), 0
    groups_left = math.ceil(most / FAN_IN)
    while True:
        lots = left.groupBy("source", "g").agg(F.array_sort(F.collect_list(F.struct((-F.col("w")).alias("o"), *cols, "p"))).alias("units"))
        placed = lots.select(F.inline(F.transform(_pivot(F.col("units"), level, seed), lambda d: F.struct(F.get(F.col("units"), d["i"]).alias("u"), d["p"].alias("now")))))
        out = materialize(placed.select(*[F.col(f"u.{c}").alias(c) for c in cols], F.col("now").alias("p")), "mix")
        fractional = (F.col("p") > 0) & (F.col("p") < 1)
        if groups_left <= 1:
            settled = settled.unionByName(out.withColumn("p", F.round("p")))
            break
        settled = settled.unionByName(out.filter(~fractional))
        left = out.filter(fractional).withColumn("g", F.floor(F.col("g") / FAN_IN).cast("long"))
        groups_left, level = math.ceil(groups_left / FAN_IN), level + 1
    rounded = materialize(settled.select("uid", "source", "size", "key", *carry, "source_size", "target", (F.col("whole") + F.col("p").cast("int")).alias("copies")), "mix")
    return _settle_rest(rounded, cap, seed).select("source", "size", "key", *carry, "source_size", "target", "copies")


def mix_documents(df: DataFrame, seed: int = 7) -> DataFrame:
    """Documents -> doc_id, size, source_size, target, taken (see pivotal_copies); size counts words, null text: 0."""
    rows = df.select(
        "doc_id", "source",
        F.regexp_count(text_of(), F.lit(SPACED_WORD)).cast("long").alias("size"),
        F.xxhash64("doc_id", "source", "text").alias("key"),
    )
    return pivotal_copies(materialize(rows, "mix"), ["doc_id"], seed)


def op8_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
