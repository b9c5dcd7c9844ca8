"""A training-data pipeline of five corpus operators; every stage works on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkmosaic.llm.common import SPACED_WORD, pack_extra, table, text_of, unpack_extra
from linkmosaic.llm.mixing import pivotal_copies
from linkmosaic.llm.packing import pack_documents
from linkmosaic.llm.quality import score_documents, train
from linkmosaic.llm.shingles import near_copy_groups
from linkmosaic.llm.suffixes import PASSAGE, strip_repeats
from linkmosaic.sources.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the line model rejects (score under 1/2); it learns from `labels` of what it is given.

    Null and empty texts have a score like any text; equal rows have equal scores and go or stay together.
    """
    crf = train(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(pack_extra(docs), crf)
    return unpack_extra(scored.filter(F.col("score") >= 0.5), docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that pairs of five-word Jaccard >= 0.8 connect the document with the smallest doc_id stays.

    Rows equal in id and text are one document; rows without an id have no name to be kept by and all stay.
    """
    columns = docs.columns
    docs = pack_extra(docs)
    named = docs.filter(F.col("doc_id").isNotNull())
    groups = materialize(near_copy_groups(named), "groups")
    kept = groups.filter("doc_id = component_id").select("doc_id").distinct()
    out = named.join(kept.hint("shuffle_hash"), "doc_id", "left_semi")
    if groups.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        first = F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("doc_id"))
        out = out.withColumn("_nth", first).filter("_nth = 1")
    out = out.select(*docs.columns).unionByName(docs.filter(F.col("doc_id").isNull()))
    return unpack_extra(out, columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts strings of PASSAGE bytes, some fifty words without a break, that occur elsewhere out of the texts; every document stays.

    Null texts stay null, short ones as they are; rows equal in id and text repeat each other.
    """
    return strip_repeats(docs, PASSAGE)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: 0 to 3 rows.

    Null and empty texts have size 0: they add no words, and are taken by an independent draw; a null source is a source of its own.
    """
    key = F.xxhash64("doc_id", "source", "text")
    keyed = pack_extra(docs).withColumn("_key", key)
    sized = keyed.select("doc_id", "source", F.col("_key").alias("key"), F.regexp_count(text_of(), F.lit(SPACED_WORD)).cast("long").alias("size"))
    copies = pivotal_copies(materialize(sized, "mix"), ["doc_id"]).select(F.col("doc_id").alias("_id"), F.col("key").alias("_k"), "copies")
    same = materialize(copies.groupBy("_id", "_k").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")), "mix")
    joined = keyed.join(same.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_k")))
    times = F.col("copies")
    if same.filter("rows > 1").limit(1).count():
        # equal rows share the copies that were drawn for all of them
        nth = F.row_number().over(Window.partitionBy("_id", "_k").orderBy("_k"))
        joined = joined.withColumn("_nth", nth)
        times = F.floor(F.col("copies") / F.col("rows")) + (F.col("_nth") <= F.col("copies") % F.col("rows")).cast("int")
    out = joined.filter(times > 0).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))))
    return unpack_extra(out, docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all that is left, packed to sequences of 2,048; null and empty texts are a piece of one id."""
    return pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]
#: No SQL: the stages learn, compare shingles and search; tests hold them against brute force on small inputs.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, "stage")
    return docs
