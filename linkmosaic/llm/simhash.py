"""SimHash fingerprints, and near-dedup by meet-in-the-middle ball hashing."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkmosaic.llm.common import table
from linkmosaic.operators.components import connected_components
from linkmosaic.sources.shared import materialize

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_SLICE = 1 << 17  # shingles whose bits are unpacked at a time
HALF = 32


def _bit_counts(shingles) -> tuple[np.ndarray, int]:
    """How many of the hashes, an iterator of them, have each bit, and how many there are."""
    total, n = np.zeros(64, np.int64), 0
    while True:
        part = np.fromiter((h for _, h in zip(range(_SLICE), shingles)), dtype="<u8")
        if not len(part):
            return total, n
        n += len(part)
        add_bits(total, part)


def add_bits(total: np.ndarray, hashes: np.ndarray) -> None:
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    for lo in range(0, len(bits), 255):  # sums of 255 bits fit a byte
        total += bits[lo : lo + 255].sum(axis=0, dtype=np.uint8)


def majority(total: np.ndarray, n: int) -> int:
    return int(np.bitwise_or.reduce(np.where(2 * total > n, np.uint64(1) << np.arange(64, dtype=np.uint64), np.uint64(0))))


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included; a bit is set if over half the hashes have it.

    Fewer words than a shingle has: the whole sequence is the one shingle; no words or null: 0.
    """
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return 0
    grams = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    total, n = _bit_counts(map(xxhash.xxh64_intdigest, grams, repeat(seed)))
    return majority(total, n)


def fingerprints(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): fp as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b["text"]], dtype=np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, fp long")


def _flip(fp: Column, mask: Column) -> Column:
    return fp.bitwiseXOR(mask)


def _masks_two(half: int) -> list[int]:
    lo = half * HALF
    all_masks = [(1 << i) | (1 << j) for i in range(lo, lo + HALF) for j in range(i + 1, lo + HALF)]
    return [m - (1 << 64) if m >> 63 else m for m in all_masks]


def _masks_one() -> list[int]:
    return [0] + [(1 << i) if i < 63 else -(1 << 63) for i in range(64)]


def ball_links(classes: DataFrame) -> DataFrame:
    """(rep, fp), fp distinct -> links (u, v) of rep ids that connect all fingerprints at 3 or fewer bits.

    Meet in the middle: two fingerprints at distance 1 or 2 share a variant within one bit of both; at
    distance 3 one of them, the one with even parity, reaches a one-bit variant of the other by two flips.
    Of any three differing bits two lie in one half of the word, so flips of two bits of one half suffice.
    A lossless screen spares the others: if two fingerprints are that near, one half of the word differs
    in one bit at most, so they agree on that half with some bit masked.  Only fingerprints that meet
    another one there go on, and flip two bits only in the half opposite.  The screen needs the least and
    the largest fingerprint of a masked half, never a list of them.

    All fingerprints that reach a variant by one bit or none are linked to each other, and those that reach
    it by two are linked to each of these; so a variant links its members to the least of the one-bit ones:
    no pairs are made.  Every link is verified by counting bits.
    """
    halves = F.transform(
        F.sequence(F.lit(0), F.lit(63)),
        lambda i: F.struct(
            F.floor(i / HALF).cast("int").alias("half"),
            # the half with its bit i masked, beside i: 32 + 6 bits
            F.when(i < HALF, F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1)))
            .otherwise(F.shiftrightunsigned("fp", HALF))
            .bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), (i % HALF).cast("int"))))
            .bitwiseOR(F.call_function("shiftleft", i.cast("long"), F.lit(HALF)))
            .alias("key"),
        ),
    )
    # few bytes become many rows: they are dealt out before, or a task or two would make them all
    wide = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    masked = classes.repartition(wide, "fp").select("rep", "fp", F.inline(halves))
    met = masked.groupBy("key").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).filter("a <> b").select("key")
    near = masked.join(met.hint("merge"), "key").groupBy("rep", "fp").agg(F.max(F.when(F.col("half") == 0, 1).otherwise(0)).alias("low"), F.max(F.when(F.col("half") == 1, 1).otherwise(0)).alias("high"))
    near = materialize(near, "simhash").repartition(wide, "fp")
    lits = lambda ms: F.array(*[F.lit(m).cast("long") for m in ms])
    one = near.select("rep", "fp", F.explode(F.transform(lits(_masks_one()), lambda m: _flip(F.col("fp"), m))).alias("variant"), F.lit(True).alias("inner"))
    even = near.filter(F.bit_count("fp") % 2 == 0)
    # the half that agrees up to a bit was met; two of the other half's bits are flipped
    two = [
        even.filter(f"{met_in} = 1").select("rep", "fp", F.explode(F.transform(lits(_masks_two(far)), lambda m: _flip(F.col("fp"), m))).alias("variant"), F.lit(False).alias("inner"))
        for met_in, far in (("low", 1), ("high", 0))
    ]
    all_variants = one.unionByName(two[0]).unionByName(two[1])
    centre = F.min(F.when(F.col("inner"), F.struct("rep", "fp"))).over(W.partitionBy("variant"))
    pairs = all_variants.withColumn("c", centre).filter("c is not null and c.rep <> rep")
    true = F.bit_count(F.col("fp").bitwiseXOR(F.col("c.fp"))) <= 3
    return pairs.filter(true).select(F.col("rep").alias("u"), F.col("c.rep").alias("v")).distinct()


def simhash_groups(df: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id): documents linked at 3 or fewer differing bits, and what that connects.

    Equal fingerprints are one class from the start, named by its smallest doc_id.  Null and empty texts,
    and texts without words, have fingerprint 0 and are linked like any other.  Repeated rows: each gives
    its row.  Rows with a null id keep a null component if alone in their class.  No rows: no rows.
    """
    per_doc = materialize(fingerprints(df, words, id_col, text_col), "simhash")
    classes = materialize(per_doc.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash")
    links = materialize(ball_links(classes.filter("rep is not null")), "simhash")
    parts = connected_components(links)
    per_class = classes.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return per_doc.join(per_class, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
