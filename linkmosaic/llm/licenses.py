"""License scans by diagonal voting over word k-grams, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkmosaic.llm.common import table, text_of

#: Base phrases and their labels; then sentences of public licences for the method's own labels.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "either version 3 of the license or at your option any later version"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under a creative commons attribution noncommercial 4 0 international license"),
)
#: Fixed pattern of the contract, for text whose A-Z are still there.
NOT_A_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
K = 3
DRIFT = 3  # neighbouring diagonals at most so far apart are one span: words put in or left out
COVERAGE = 0.6  # share of a template's k-grams that its span must hold
END = 11 - 2**63
STRETCH = 1.5  # the span's length in words against the template's


def words_of(text: Column) -> Column:
    """Array of words; the Kelvin sign is kept from turning into an ASCII k."""
    parts = F.split(F.lower(F.replace(text, F.lit("K"), F.lit("ĸ"))), NOT_A_WORD)
    return parts


def _template_rows(spark: SparkSession) -> DataFrame:
    rows = []
    for number, (label, phrase, base) in enumerate([(*x, True) for x in BASE] + [(*x, False) for x in TEMPLATES]):
        w = phrase.split()
        for i in range(len(w) - K + 1):
            a, b, c = w[i : i + K]
            rows.append(f"({number}, '{label}', {str(base).lower()}, {len(w)}, {i}, '{a} {b} {c}', xxhash64('{a}', '{b}', '{c}'))")
    # the end of every text has a gram of its own, so that no text is lost by the join
    rows.append(f"(-1, null, false, 0, 0, null, {END}L)")
    return spark.sql(f"select * from values {', '.join(rows)} as v(t, label, base, t_words, t_pos, gram, h)")


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents -> one row each with base places and labels (see op4 of the README).

    The rolling word k-gram hashes of every whole text are joined to template positions (a fixed table,
    broadcast); matching grams are compared as words.  Votes are counted on each diagonal (place in the
    text minus place in the template); diagonals at most DRIFT apart are merged to one span.  A base
    phrase is found where one diagonal holds all its grams; another template where the merged span holds
    COVERAGE of its grams and is no longer than STRETCH times the template.  score is the largest share
    of a template's grams found, 1 for a base phrase, 0 without a label.

    Null or empty texts, and texts shorter than a phrase: no places, empty strings, null words, score 0.
    Repeated rows are scanned one by one.  A row that matches nothing still gives its row: a sentinel
    gram at the end of its array always joins.  Hits of a row are bounded by its own length.
    """
    spark = df.sparkSession
    held = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), words_of(text_of(text_col)).alias("raw"))
    # empty strings can stand at either end only
    lead = F.when(F.col("raw")[0] == "", 1).otherwise(0)
    n = F.size("raw") - lead - F.when((F.size("raw") > 1) & (F.element_at("raw", -1) == ""), 1).otherwise(0)
    held = held.select("rid", "doc_id", "raw", lead.alias("lead"), n.alias("n_words"))
    grams = F.transform("raw", lambda w, i: F.xxhash64(w, F.get("raw", i + 1), F.get("raw", i + 2)))
    held = held.withColumn("grams", F.array_append(grams, F.lit(END)))
    each = held.select("rid", "doc_id", "n_words", "lead", "raw", F.posexplode_outer("grams").alias("at", "h"))
    hit = each.join(F.broadcast(_template_rows(spark)), "h")
    hit = hit.filter(
        ((F.col("t") < 0) & (F.col("at") == F.size("raw")))
        | (F.array_join(F.slice("raw", F.col("at") + 1, F.lit(K)), " ") == F.col("gram"))
    )
    votes = hit.select(
        "rid", "doc_id", "n_words", "t", "label", "base", "t_words", "t_pos",
        (F.col("at") - F.col("lead") - F.col("t_pos")).cast("long").alias("diagonal"),
        (F.col("at") - F.col("lead")).cast("long").alias("word"),
    ).repartition("rid")
    lines = votes.groupBy("rid", "doc_id", "n_words", "t", "label", "base", "t_words", "diagonal").agg(
        F.collect_set("t_pos").alias("places"), F.min("word").alias("lo"), F.max("word").alias("hi")
    )
    along = Window.partitionBy("rid", "t").orderBy("diagonal")
    step = F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(along) > DRIFT), 1).otherwise(0)
    spans = (
        lines.withColumn("_step", step)
        .withColumn("span", F.sum("_step").over(along))
        .groupBy("rid", "doc_id", "n_words", "t", "label", "base", "t_words", "span")
        .agg(
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("found"),
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("start"),
        )
    )
    share = F.col("found") / (F.col("t_words") - (K - 1))
    ok = F.when(F.col("base"), share == 1).otherwise((share >= COVERAGE) & (F.col("hi") - F.col("lo") + K <= STRETCH * F.col("t_words")))
    ok = ok & (F.col("t") >= 0)
    is_base = ok & F.col("base")
    joined = lambda cond: F.array_join(F.array_sort(F.collect_set(F.when(cond, F.col("label")))), ",")
    return spans.groupBy("rid", "doc_id", F.col("n_words").cast("long").alias("n_words")).agg(
        F.count(F.when(is_base, 1)).alias("n_base"),
        F.min(F.when(is_base, F.col("start"))).alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).alias("last_word"),
        joined(is_base).alias("base_labels"),
        joined(ok).alias("labels"),
        F.coalesce(F.max(F.when(ok, share)), F.lit(0.0)).alias("score"),
    ).drop("rid")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    values = ", ".join(f"({i}, '{x[0]}', '{x[1]}', {b})" for i, (x, b) in enumerate([(x, "true") for x in BASE] + [(x, "false") for x in TEMPLATES]))
    return f"""
with phrases(t, label, phrase, base) as (values {values}),
tpl as (select t, label, base, len(string_split(phrase, ' ')) as t_words, unnest(range(len(string_split(phrase, ' ')) - 2)) as t_pos, string_split(phrase, ' ') as p from phrases),
grams as (select t, label, base, t_words, t_pos, p[t_pos + 1] || ' ' || p[t_pos + 2] || ' ' || p[t_pos + 3] as gram from tpl),
words as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
places as (select doc_id, w, unnest(range(greatest(len(w) - 2, 0))) as spot from words),
hits as (select distinct doc_id, t, label, base, t_words, t_pos, spot, spot - t_pos as diagonal from (select doc_id, spot, w[spot + 1] || ' ' || w[spot + 2] || ' ' || w[spot + 3] as gram from places) join grams using (gram)),
stepped as (select *, case when base then diagonal <> coalesce(lag(diagonal) over along, diagonal) else diagonal - lag(diagonal) over along > {DRIFT} end as step from hits window along as (partition by doc_id, t order by diagonal)),
numbered as (select *, sum(case when step then 1 else 0 end) over (partition by doc_id, t order by diagonal range between unbounded preceding and current row) as span from stepped),
spans as (select doc_id, t, label, base, t_words, span, count(distinct t_pos) as found, min(spot) as lo, max(spot) as hi, min(diagonal) as start from numbered group by all),
good as (select *, found / (t_words - 2.0) as share from spans where case when base then found = t_words - 2 else found / (t_words - 2.0) >= {COVERAGE} and hi - lo + {K} <= {STRETCH} * t_words end)
select d.doc_id, cast(len(d.w) as bigint) as n_words, count(*) filter (g.base) as n_base,
  min(g.start) filter (g.base) as first_word, max(g.start) filter (g.base) as last_word,
  coalesce(string_agg(distinct g.label, ',' order by g.label) filter (g.base), '') as base_labels,
  coalesce(string_agg(distinct g.label, ',' order by g.label), '') as labels,
  cast(coalesce(max(g.share), 0) as double) as score
from words d left join good g using (doc_id) group by d.doc_id, len(d.w)"""


ORACLE = _oracle()
