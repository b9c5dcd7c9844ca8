"""Small helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as runs of anything but ASCII white space (fixed pattern of the contracts).
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str = "text") -> Column:
    """The text, null as the empty string."""
    return F.coalesce(F.col(col), F.lit(""))


def unit(*key: Column) -> Column:
    """A reproducible number in [0, 1) of the key."""
    return F.shiftrightunsigned(F.xxhash64(*key), 11).cast("double") / float(1 << 53)


#: Columns of documents that operators look at.
CORE = ("doc_id", "text", "lang", "source", "n_chars")


def pack_extra(df: DataFrame) -> DataFrame:
    """Documents with all columns but CORE in one struct, so that no name of theirs can clash."""
    extra = [c for c in df.columns if c not in CORE]
    held = [F.struct(*[F.col(f"`{c}`") for c in extra]).alias("_extra")] if extra else []
    return df.select(*[c for c in CORE if c in df.columns], *held)


def unpack_extra(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns by their names again, in their order."""
    return df.select(*[F.col(c) if c in CORE else F.col(f"_extra.`{c}`").alias(c) for c in columns])
