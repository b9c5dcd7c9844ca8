"""Sharding by a Feistel permutation with cycle walking over global row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkmosaic.llm.common import table, text_of
from linkmosaic.sources.shared import materialize

ROWS_PER_BUCKET = 1 << 16
WALK = 64


def number_rows(df: DataFrame, keys: list[str], n: int, name: str = "row_no") -> DataFrame:
    """Adds a dense global row number 0..n-1 that depends on the rows alone, not on partitions.

    Rows are hashed to buckets of about ROWS_PER_BUCKET, numbered inside each bucket in the order of
    `keys`, and shifted by the sizes of the buckets before.  The only single task sees one row a bucket.
    """
    buckets = max(1, math.ceil(n / ROWS_PER_BUCKET))
    held = df.withColumn("_b", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    sizes = held.groupBy("_b").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*keys)).cast("long")
    return held.withColumn("_i", inside).join(offsets, "_b").withColumn(name, F.col("_off") + F.col("_i") - 1).drop("_b", "_i", "_off")


def permute(x: Column, n: int, seed: int, rounds: int = 4) -> Column:
    """A keyed bijection of 0..n-1: alternating Feistel rounds on a by b halves, walked back into range.

    a * b exceeds n by less than a, so a number hardly ever leaves the range; one that does walks its
    cycle on, at most a * b - n steps, which is under WALK for small n and has a chance of (1 / sqrt n)
    for each further step otherwise.  A walk that is not over after WALK steps raises an error.
    """
    a = math.isqrt(max(n - 1, 0)) + 1
    b = -(-max(n, 1) // a)
    keys = F.array(*[F.lit(seed * 1000 + i).cast("long") for i in range(rounds)])

    def once(v: Column) -> Column:
        def step(s: Column, k: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k), F.lit(a).cast("long")), F.lit(a).cast("long"))
            right = F.pmod(s["r"] + F.pmod(F.xxhash64(left, k), F.lit(b).cast("long")), F.lit(b).cast("long"))
            return F.struct(left.alias("l"), right.alias("r"))

        start = F.struct(F.floor(v / b).cast("long").alias("l"), F.pmod(v, F.lit(b).cast("long")).alias("r"))
        return F.aggregate(keys, start, step, lambda s: s["l"] * F.lit(b).cast("long") + s["r"])

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(x), lambda v, _: F.when(v < n, v).otherwise(once(v)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("long"))


def permutation_shards(df: DataFrame, n_shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row gets a shard and a slot that can be computed from its global row number.

    Row number i goes to place p = permute(i); shard = p mod n_shards, slot = p div n_shards.  Shard
    sizes differ by one at most and slots have no gaps (law `rows`), whatever the texts or keys are.
    Null text: size 8, CRC of no bytes.  Repeated rows: each is numbered on its own; fully equal rows
    are interchangeable.  Null ids are ordered first.  No rows: no rows.  Other columns are left out.
    """
    skinny = materialize(
        df.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text_of(text_col)) + 8).cast("long").alias("size"),
            F.crc32(text_of(text_col)).cast("long").alias("text_crc32"),
        ),
        "shards",
    )
    n = skinny.count()
    place = number_rows(skinny, ["doc_id", "size", "text_crc32"], n).withColumn("_p", permute(F.col("row_no"), n, seed))
    return place.select(
        "doc_id", "size", "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % n_shards).cast("int").alias("shard"),
        F.floor(F.col("_p") / n_shards).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row_no",
    )


def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_shards(table(spark, sf_dir, "documents"), n_shards=24)
