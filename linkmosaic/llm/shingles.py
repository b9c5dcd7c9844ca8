"""Near copies by five-word shingles: SimHash links, min-hash bands for those beyond its radius, all verified by Jaccard."""

from __future__ import annotations

import struct
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkmosaic.llm.simhash import _LOWER, _SLICE, add_bits, ball_links, majority
from linkmosaic.operators.components import SMALL, connected_components
from linkmosaic.sources.shared import discard, materialize

WORDS = 5
SEED = 42
BANDS, ROWS = 16, 3  # a pair of similarity 0.8 shares no band with a chance of (1 - 0.8 ** 3) ** 16 = 0.00001
MORE = 8  # so many times the centres in every round
_BITS = 1024
_FACTORS = np.array([xxhash.xxh64_intdigest(struct.pack("<I", k)) | 1 for k in range(BANDS * ROWS)], dtype=np.uint64)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of the word shingles, repeats included (ASCII lower case, words between ASCII white space).

    Fewer words than a shingle has: the whole sequence is the one shingle; no words or null: none.
    """
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not found:
        return np.empty(0, "<u8")
    grams = map(b" ".join, zip(*(found[i:] for i in range(words)), strict=False)) if len(found) >= words else [b" ".join(found)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), dtype="<u8", count=max(1, len(found) - words + 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parity(held: np.ndarray) -> np.ndarray:
    """For each of 1,024 residues, whether an odd number of shingles has it."""
    odd = np.bincount((held % np.uint64(_BITS)).astype(np.int64), minlength=_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _bands(held: np.ndarray) -> list[int]:
    """A key for each band of least hashes."""
    if not len(held):
        return []
    mixed = held ^ (held >> np.uint64(29))
    least = np.array([(mixed * f).min() for f in _FACTORS], dtype="<u8").reshape(BANDS, ROWS)
    return [_signed(xxhash.xxh64_intdigest(row.tobytes(), k)) for k, row in enumerate(least)]


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, set_id, fp, n, parity, bands): of the set of shingles its hash, size, parity bits and band keys; of all shingles the SimHash."""

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b["doc_id"], b["text"], strict=True):
                hashes = shingle_hashes(t)
                total = np.zeros(64, np.int64)
                for lo in range(0, len(hashes), _SLICE):
                    add_bits(total, hashes[lo : lo + _SLICE])
                held = np.unique(hashes)
                rows.append((i, _signed(xxhash.xxh64_intdigest(held.tobytes())), _signed(majority(total, len(hashes))) if len(hashes) else 0, len(held), _parity(held), _bands(held)))
            yield pd.DataFrame(rows, columns=["doc_id", "set_id", "fp", "n", "parity", "bands"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInPandas(run, "doc_id long, set_id long, fp long, n int, parity array<long>, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(set_id, held): the set as the upper 32 bits of its hashes."""

    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t)) for t in b["text"]]
            yield pd.DataFrame({"set_id": [_signed(xxhash.xxh64_intdigest(h.tobytes())) for h in sets], "held": [np.unique(h >> np.uint64(32)).astype("<u4").view("<i4") for h in sets]})

    return docs.select("text").mapInPandas(run, "set_id long, held array<int>")


def _may_be_alike(n_a: Column, p_a: Column, n_b: Column, p_b: Column) -> Column:
    """False only where two sets can't have similarity 0.8, by their sizes and parity bits.

    Bits that differ are at most the shingles that differ, of which 0.8 allows a ninth of the sizes' sum.
    """
    differ = sum((F.bit_count(p_a[k].bitwiseXOR(p_b[k])) for k in range(_BITS // 64)), F.lit(0))
    return (5 * F.least(n_a, n_b) >= 4 * F.greatest(n_a, n_b)) & (9 * differ <= n_a + n_b)


def _verified(docs: DataFrame, pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of pairs (u, v) of sets, those of similarity 0.8 or more: they share 4/9 of their sizes' sum."""
    left, right = (classes.select(F.col("set_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("parity").alias(f"p_{k}")) for k in "uv")
    alike = _may_be_alike(F.col("n_u"), F.col("p_u"), F.col("n_v"), F.col("p_v"))
    pairs = materialize(pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v").filter(alike).select("u", "v"), "shingles")
    ids = pairs.select(F.col("u").alias("set_id")).union(pairs.select("v")).distinct()
    wanted = classes.join(ids, "set_id", "left_semi").select("doc_id").distinct()
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    sets = materialize(_sets(named.repartition(wide)), "shingles")
    left, right = (sets.select(F.col("set_id").alias(k), F.col("held").alias(f"held_{k}")) for k in "uv")
    both = pairs.join(left.hint("merge"), "u").join(right.hint("merge"), "v")
    links = materialize(both.filter(9 * F.size(F.array_intersect("held_u", "held_v")) >= 4 * (F.size("held_u") + F.size("held_v"))).select("u", "v").distinct(), "shingles")
    discard(sets)
    discard(pairs)
    return links


def near_copy_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of documents with an id: what pairs of five-word Jaccard >= 0.8 connect, named by its least doc_id.

    Equal sets (texts without words among them) are one class from the start.  Candidates are pairs within
    3 bits by SimHash, and sets that share a band of min-hashes; every link is verified on the whole sets.
    Nobody lists the pairs of a band: in each round its sets are compared with a few centres only, one at
    first, then MORE times as many.  Centres are the sets that meet most others in their bands, which an
    original does more than its edited copies.  A centre leaves the band, as it has met all of it; a band
    is done when those left in it are one component.  Near copies of one text so cost their number; sets
    that share a band and are not alike are compared one by one, by sketches inside the join, so no pair
    is given up and few are written.
    """
    spark = docs.sparkSession
    per_doc = materialize(signatures(docs), "shingles")
    classes = materialize(per_doc.groupBy("set_id").agg(F.min("doc_id").alias("doc_id"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("parity").alias("parity")), "shingles")
    prints = classes.groupBy("fp").agg(F.min("set_id").alias("rep"))
    equal = classes.join(prints, "fp").filter("set_id <> rep").select(F.col("set_id").alias("u"), F.col("rep").alias("v"))
    pairs = equal.unionByName(ball_links(materialize(prints, "shingles")))
    spread = per_doc.select("set_id", F.explode("bands").alias("key")).distinct()
    met = spread.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1")
    near = materialize(spread.join(met.hint("merge"), "key"), "shingles")
    known = near.groupBy("set_id").agg(F.sum("k").alias("met")).join(classes.select("set_id", "n", "parity"), "set_id")
    then = materialize(near.select("set_id", "key").join(known.hint("merge"), "set_id").withColumn("part", F.col("set_id")), "shingles")
    discard(near)
    near, links, slots, none = then, None, 1, spark.createDataFrame([], "u long, v long")
    while True:
        slot = F.pmod(F.xxhash64("set_id", F.lit(slots)), F.lit(slots))
        best = F.min(F.struct((-F.col("met")).alias("o"), F.xxhash64("set_id").alias("h"), "set_id", "part", "n", "parity")).alias("c")
        centres = near.groupBy("key", slot.alias("_s")).agg(best).select(F.col("key").alias("at"), F.col("c.set_id").alias("centre"), F.col("c.part").alias("its"), F.col("c.n").alias("n_c"), F.col("c.parity").alias("p_c"))
        # the sketches decide inside the join: only pairs that may be alike come out of it
        meet = (F.col("key") == F.col("at")) & (F.col("set_id") != F.col("centre")) & (F.col("part") != F.col("its"))
        star = near.join(centres.hint("merge"), meet & _may_be_alike(F.col("n"), F.col("parity"), F.col("n_c"), F.col("p_c")))
        pairs = pairs.unionByName(star.select("set_id", "centre").toDF("u", "v"))
        found = _verified(docs, pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), classes)
        links = found if links is None else links.unionByName(found)
        parts = materialize(connected_components(links, small=SMALL), "shingles")
        left = near.join(centres.select(F.col("at").alias("key"), F.col("centre").alias("set_id")).hint("merge"), ["key", "set_id"], "left_anti").drop("part")
        left = left.join(parts.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("part", F.coalesce("component", "set_id")).drop("component")
        open_keys = left.groupBy("key").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a <> b").select("key")
        then = materialize(left.join(open_keys.hint("merge"), "key").select(*near.columns), "shingles")
        discard(near)
        near, pairs, slots = then, none, slots * MORE
        if not near.limit(1).count():
            break
    placed = classes.select("set_id", "doc_id").join(parts.withColumnRenamed("id", "set_id"), "set_id", "left").withColumn("part", F.coalesce("component", "set_id"))
    placed = materialize(placed, "shingles")
    named = placed.join(placed.groupBy("part").agg(F.min("doc_id").alias("component_id")), "part").select("set_id", "component_id")
    return per_doc.select("doc_id", "set_id").join(named, "set_id").select("doc_id", "component_id")
