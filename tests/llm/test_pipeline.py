"""The corpus pipeline, stage by stage, on a folder of small tables."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P


def text(n, seed):
    rng = random.Random(seed)
    return ".\n".join(" ".join(f"w{rng.randrange(3000)}" for _ in range(12)) for _ in range(n)) + "."


def junk(seed):
    return " | ".join(f"X{(seed * 31 + k) % 97}!!" for k in range(60))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    passage = text(8, 999)
    rows = [(i, junk(i) if i % 5 == 0 else text(6, i) + ("\n" + passage if i % 7 == 0 else ""), "en", f"s{i % 4}") for i in range(200)]
    rows += [(1000 + i, rows[i][1], "en", "s0") for i in range(1, 40, 5)]
    rows += [(2000, None, None, None), (2001, "", "en", "s1"), (2002, rows[1][1], "en", "s0"), (2002, rows[1][1], "en", "s0")]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "kept", "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _key string, spans string")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 > 0), 0) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    good = P.materialize(P.quality(spark, docs, folder), "t")
    assert good.columns == columns
    left = {r[0] for r in good.select("doc_id").collect()}
    assert {i for i in range(200) if i % 5} <= left and not {i for i in range(0, 200, 5)} & left
    single = P.materialize(P.near_copies(spark, good, folder), "t")
    ids = [r[0] for r in single.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and {i for i in range(200) if i % 5} <= set(ids) and not any(i == 2002 or 1000 <= i < 2000 for i in ids)
    cut = P.materialize(P.repeated_passages(spark, single, folder), "t")
    assert cut.columns == columns and cut.count() == single.count()
    assert cut.filter(F.col("text").contains(text(8, 999)[:256])).count() == 0
    untouched = cut.join(single.select("doc_id", F.col("text").alias("old")), "doc_id").filter("doc_id % 7 <> 0 and doc_id < 200 and not (text <=> old)")
    assert untouched.count() == 0
    mixed = P.materialize(P.mixing(spark, cut, folder), "t")
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert {r[0] for r in mixed.select("_key").distinct().collect()} == {"kept"}
    packed = P.packing(spark, mixed, folder)
    assert packed.filter("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0


def test_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0


def test_run(spark, folder):
    assert P.run(spark, folder).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert [name for name, _ in P.STAGES] == ["quality", "near copies", "repeated passages", "mixing", "packing"]
