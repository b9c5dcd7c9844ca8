"""Corpus operators against brute force and SQL, and on nulls, empty and long texts, ties, repeated rows and empty tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from oracle import assert_same
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmosaic.llm import licenses, mixing, packing, quality, queries, sharding, simhash, suffixes, vectors, warc
from linkmosaic.operators.components import merge_pairs
from linkmosaic.sources.shared import shared_dir

DOCS = T.StructType([T.StructField(n, T.StringType() if n not in ("doc_id", "n_chars") else T.LongType()) for n in ("doc_id", "text", "lang", "source", "n_chars", "_b", "key", "_extra", "score", "grams")])


def documents(spark, rows):
    """rows of (doc_id, text, source); further columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", "z", "0", "g") for i, t, s in rows], DOCS)


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_documents():
    long = words(30_000, 1, 5000)
    copy = words(120, 2)
    return [
        (0, None, None), (1, "", "a"), (2, "   \n\t ", "a"), (3, "one", None), (4, long, "b"), (5, copy, "b"), (6, copy, "a"), (7, copy + " end", "c"), (8, long + " more", "c"),
        (9, "Released under the MIT License.", "a"), (9, "Released under the MIT License.", "a"), (10, "é" * 300 + words(100, 3) + "é" * 250, "d"), (11, "é" * 300, "d"),
    ]


@pytest.fixture(scope="module")
def odd(spark):
    return documents(spark, odd_documents())


@pytest.fixture(scope="module")
def none(spark):
    return documents(spark, [])


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf_dir, name):
    assert_same(queries.QUERIES[name](spark, sf_dir), sf_dir, queries.ORACLES[name])


# ---------------------------------------------------------------- vectors


def vector_rows(n=300, dim=8, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    v = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape), base + 0.3 * rng.normal(size=base.shape), base])
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    return rows + [(1000, None), (1020, []), (1040, [1.0, None] + [0.0] * 6), (1060, [float("nan")] + [1.0] * 7), (1080, [0.0] * dim), (1100, [float("inf")] * dim), (1120, [1.0, 2.0])]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def fine(v):
    return v and all(x is not None and np.isfinite(x) for x in v)


def test_top_k_is_exact(spark):
    rows = vector_rows()
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in vectors.exact_top_k(embeddings(spark, rows), F.col("vec_id") % 20 == 0, 7, pivots=4, block=64, query_block=8).collect()}
    whole = [(i, np.floor(64 * np.array(v + [0.0] * (8 - len(v)), dtype=float)).astype(np.int64)) for i, v in rows if fine(v)]
    want = {}
    for q, x in whole:
        if q % 20 == 0:
            best = sorted((-int(x @ y), i) for i, y in whole if i != q)[:7]
            want |= {(q, k): (i, -s) for k, (s, i) in enumerate(best, 1)}
    assert got == want


def test_pivot_bounds_hold_and_leave_little(monkeypatch):
    rng = np.random.default_rng(3)
    m = np.floor(64 * rng.normal(size=(3000, 16)) / 4)
    m[1000:1010] = m[0]
    table = vectors.PivotTable(vectors._spread(m[:500], 64))
    far, sq = table.distances(m), (m * m).sum(1)
    bound = table.bounds(sq[:50], far[:50], sq, far)
    assert (bound >= m[:50] @ m.T).all()
    triangle = np.max([np.abs(a[:50, None] - a[None, :]) for a in far.T], axis=0)
    assert (bound <= (sq[:50, None] + sq[None, :] - triangle**2) / 2 + 1e-3).all()
    seen, plain = [], vectors._products
    monkeypatch.setattr(vectors, "_products", lambda q, v: seen.append(len(v)) or plain(q, v))
    ids = np.arange(len(m))
    found = list(vectors._block_top(ids[:50], m[:50], far[:50], np.full(50, -(2**63)), ids, m, far, 20, table))
    assert len(found) == 50 and sum(seen) < 50 * len(m) / 10
    # pivots that all lie on one line, and a single row
    flat = np.outer(np.arange(5.0), np.ones(3))
    assert len(vectors._spread(flat, 64)) == 2 and len(vectors._spread(flat[:1], 64)) == 1


def test_top_k_of_huge_values_and_nothing(spark):
    rows = [(0, [3e30, 1.0]), (20, [2e30, -1.0]), (1, [-1e30, 5.0])]
    got = vectors.exact_top_k(embeddings(spark, rows), F.col("vec_id") % 20 == 0, 2).filter("query_id = 0").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(20, 2**63 - 1), (1, -(2**63))]
    assert vectors.exact_top_k(embeddings(spark, []), F.col("vec_id") % 20 == 0).count() == 0


def test_near_vectors_against_brute_force(spark):
    rows = [*vector_rows(), (5, vector_rows()[5][1])]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicate_vectors(embeddings(spark, rows), native_block=16, guest_block=32).collect())
    good = [(i, np.array(v + [0.0] * (8 - len(v)))) for i, v in rows if fine(v) and any(v)]
    m = np.stack([v / np.linalg.norm(v) for _, v in good])
    near = m @ m.T >= 0.9
    label = list(range(len(good)))
    for _ in range(len(good)):
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(good))]
        if new == label:
            break
        label = new
    least = {k: min(good[i][0] for i in range(len(good)) if label[i] == k) for k in set(label)}
    want = [(i, int(near[k].sum()) - 1, least[label[k]], i == least[label[k]]) for k, (i, _) in enumerate(good)]
    want += [(i, 0, i, True) for i, v in rows if not (fine(v) and any(v))]
    assert got == sorted(want)
    assert vectors.near_duplicate_vectors(embeddings(spark, [])).count() == 0


def test_near_vectors_across_many_cells_and_files(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(2600, 8))
    tight = rng.normal(size=(1, 8)) + 1e-3 * rng.normal(size=(300, 8))
    m = np.concatenate([base, tight, 2 * base[:100], np.repeat(tight[:1], 50, axis=0)])
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_duplicate_vectors(df, native_block=100, guest_block=150).collect()}
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    ids, at = np.nonzero(near)
    label = merge_pairs(len(m), ids, at)
    assert got == {i: (int(near[i].sum()) - 1, int(label[i])) for i in range(len(m))}


def test_near_vectors_are_not_written_for_every_cell(spark):
    """What lies on disk is a small multiple of the vectors, also where every cell has many guests."""
    rng = np.random.default_rng(9)
    m = rng.normal(size=(12_000, 64)).astype("f4")
    df = embeddings(spark, list(enumerate(m.tolist())))
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [*local.localDirsString(), re.sub("^file:/*", "/", shared_dir(spark))]
    held = lambda: {f: os.path.getsize(f) for top in folders for d, _, names in os.walk(top) for x in names if os.path.exists(f := f"{d}/{x}")}
    before = held()
    assert vectors.near_duplicate_vectors(df).filter("n_links = 0 and kept").count() == len(m)
    assert sum(n for f, n in held().items() if f not in before) < 4 * m.nbytes


# ---------------------------------------------------------------- quality


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    seqs = [rng.normal(size=(n, 3)) for n in (1, 4, 2)]
    crf = quality.LineCrf(np.array([0.5, -1.0, 0.3]), np.array([[0.2, -0.4], [-0.1, 0.7]]))
    good, log_z, _ = crf.marginals(seqs)
    for s, g, z in zip(seqs, good, log_z, strict=True):
        n, odds = len(s), s @ crf.weights
        total, on = 0.0, np.zeros(n)
        for code in range(2**n):
            y = [(code >> i) & 1 for i in range(n)]
            w = np.exp(sum(odds[i] * y[i] for i in range(n)) + sum(crf.steps[y[i], y[i + 1]] for i in range(n - 1)))
            total += w
            on += w * np.array(y)
        assert np.log(total) == pytest.approx(z) and g == pytest.approx(on / total)


def test_quality_learns_without_held_out_rows(spark, odd):
    made = [(i, f"{words(40, i)}.\n{words(30, i + 1)}." if i % 3 else " | ".join(f"W{k}!!" for k in range(30)), "a") for i in range(100, 400)]
    docs = documents(spark, made).unionByName(odd)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i, _, _ in made if i % 2] + [(None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(out) == 312 and quality.quality_scores(docs, labels).count() == 313
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in out.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out.values())
    assert np.mean([r["predicted"] == int(i % 3 > 0) for i, r in out.items() if i >= 100 and r["held_out"]]) > 0.95
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality.quality_scores(docs, flipped).collect()} == {i: r["score"] for i, r in out.items()}
    assert quality.quality_scores(docs, labels.limit(0)).first()["score"] == 0.5
    assert quality.quality_scores(docs.limit(0), labels).count() == 0


# ---------------------------------------------------------------- licenses


def test_licenses_on_odd_texts(spark, odd, none):
    mit = licenses.TEMPLATES[0][1].split()
    near = " ".join(mit[:6] + ["x"] + mit[6:13] + mit[14:])
    rows = [(20, "-- Under the MIT license under the mit licenſe; CC-BY NC", "a"), (21, near, "a"), (22, "under THE mit", "a"), (23, "mitKunder the mit license", "a")]
    out = {r["doc_id"]: r for r in licenses.scan_licenses(odd.unionByName(documents(spark, rows))).collect()}
    a = out[20]
    assert (a["n_words"], a["n_base"], a["first_word"], a["last_word"], a["base_labels"], a["score"]) == (11, 2, 0, 8, "cc-by-nc,mit", 1.0)
    assert out[21]["labels"] == "mit" and out[21]["n_base"] == 0 and 0 < out[21]["score"] < 1
    assert out[22]["labels"] == "" and out[22]["n_words"] == 3 and out[22]["first_word"] is None
    assert out[23]["n_base"] == 0
    assert out[0]["n_words"] == 0 and out[1]["n_words"] == 0 and out[2]["n_words"] == 0
    assert out[9]["n_base"] == 1 and licenses.scan_licenses(odd).filter("doc_id = 9").count() == 2
    assert licenses.scan_licenses(none).count() == 0


# ---------------------------------------------------------------- repeated strings


def brute_spans(texts, span=400):
    count = Counter(t[i : i + span] for t in texts for i in range(len(t) - span + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - span + 1):
            if count[t[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, r in zip(t, gone, strict=True) if not r)
        out.append((len(t), sum(gone), sum(1 for i in range(len(t)) if gone[i] and (not i or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def mixed_texts(seed):
    rng = random.Random(seed)
    base = [bytes(rng.choice(b"abcdefgh ") for _ in range(rng.randint(100, 2500))) for _ in range(4)]
    texts = []
    for _ in range(rng.randint(5, 25)):
        t = b""
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            i = rng.randrange(len(b))
            x = bytearray(b[i : rng.randint(i, len(b))])
            for _ in range(rng.choice([0, 0, 1, 3])):
                if x:
                    x[rng.randrange(len(x))] = rng.choice(b"xyz")
            t += bytes(x)
        if rng.random() < 0.3:
            t += (bytes(rng.choice(b"abc") for _ in range(rng.choice([1, 7, 450]))) * 300)[: rng.choice([300, 900, 1300])]
        texts.append(t)
    return texts


@pytest.mark.parametrize("span", [256, 300, 400])
@pytest.mark.parametrize("seed", range(12))
def test_suffix_runs_against_brute_force(seed, span, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(suffixes, "PAIRS", rng.choice([1, 3, 24]))
    monkeypatch.setattr(suffixes, "CHUNK", rng.choice([300, 1000, 1 << 22]))
    texts = mixed_texts(seed)
    runs = [suffixes.Run() for _ in range(3)]
    for i, t in enumerate(texts):
        for mark in suffixes.anchors(t):
            rng.choice(runs).add(t, *mark, i)
    spans = {i: [] for i in range(len(texts))}
    for group in suffixes.groups([suffixes.decoded(r.blob([(i, 0) for i in range(len(texts))])) for r in runs if r.items]):
        for doc, lo, hi in suffixes.repeated(group, span):
            spans[doc[0]].append((lo, hi))
    got = []
    for i, t in enumerate(texts):
        kept, removed, n = suffixes.cut(t, spans[i])
        got.append((len(t), removed, n, hashlib.sha256(kept).hexdigest()))
    assert got == brute_spans(texts, span)


@pytest.mark.parametrize("seed", [3, 8])
def test_op5_against_brute_force(spark, tmp_path, seed):
    """The whole query, with null and empty texts, repeated rows, a null id and passages of 256 to 399 bytes."""
    texts = [x.decode() for s in range(seed, seed + 3) for x in mixed_texts(s)]
    rng = random.Random(seed)
    passage = " ".join(f"word{rng.randrange(1000)}" for _ in range(40))
    assert 256 <= len(passage) < 400
    texts += [f"{k} before {passage} after {k}" for k in range(4)] + ["", None, "é" * 700, "x" + "é" * 650]
    rows = [(i, t) for i, t in enumerate(texts)] + [(2, texts[2]), (None, texts[4])]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    data = [(t or "").encode() for _, t in rows]
    want = sorted((-1 if i is None else i, *w, p[1]) for (i, _), w, p in zip(rows, brute_spans(data), brute_spans(data, 256), strict=True))
    got = suffixes.op5_front_coded_suffixes(spark, str(tmp_path)).collect()
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["n_passage"]) for r in got) == want
    assert sum(r["n_passage"] > r["n_removed"] for r in got) >= 4


def test_strip_repeats_takes_a_span(spark):
    rng = random.Random(1)
    passage = " ".join(f"w{rng.randrange(10**6)}" for _ in range(45))
    docs = spark.createDataFrame([(i, f"start {i} {passage} end {i}", 0) for i in range(3)], "doc_id long, text string, n_chars long")
    assert suffixes.strip_repeats(docs).filter(F.col("text").contains(passage)).count() == 3
    out = suffixes.strip_repeats(docs, suffixes.PASSAGE)
    assert out.filter(F.col("text").contains(passage[:60])).count() == 0 and out.filter(F.col("n_chars") == F.length("text")).count() == 3
    with pytest.raises(ValueError):
        suffixes.strip_repeats(docs, 100)


def test_merge_never_compares_known_prefixes():
    rng = random.Random(5)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 30))) for _ in range(5)]
    coded = [[(suffixes.common(r[i - 1], x) if i else 0, x, ()) for i, x in enumerate(r)] for r in runs]
    got = list(suffixes.merged(coded))
    assert [x for _, x, _ in got] == sorted(x for r in runs for x in r)
    assert [k for k, _, _ in got[1:]] == [suffixes.common(a[1], b[1]) for a, b in zip(got, got[1:], strict=False)]


def test_strip_repeats_on_odd_texts(spark, odd, none):
    rows = odd_documents()
    want = brute_spans([(t or "").encode() for _, t, _ in rows])
    out = suffixes.strip_repeats(odd)
    assert out.columns == odd.columns and out.count() == len(rows)
    for (i, t, _), (size, gone, _, _) in zip(rows, want, strict=True):
        got = {r["text"] for r in out.filter(F.col("doc_id") == i).collect()}
        if t is None:
            assert got == {None}
        elif not gone:
            assert got == {t}
        else:
            assert max(len(x.encode()) for x in got) <= size - gone
    assert suffixes.strip_repeats(none).count() == 0


# ---------------------------------------------------------------- WARC


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, digest string, big string")


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + words(80, 4) + "</p>"
    rows = [(5, "http://a/ü\r\nX: y", big), (3, None, big), (7, "u", big), (8, "u", "short"), (9, "u", "short"), (10, "u", None), (11, "u", ""), (None, "u", big), (12, "u", words(200_000, 6)), (3, "again", big)]
    root = "file://" + str(tmp_path / "w")
    files = warc.write_warc(pages(spark, rows), root)
    for split in (97, 1 << 20):
        out = warc.read_warc(files, root, payloads=True, split=split).collect()
        assert Counter((r["page_id"], r["payload_digest"]) for r in out) == Counter((i, hashlib.sha256((h or "").encode()).hexdigest()) for i, _, h in rows)
        kind = {(r["page_id"], r["record_type"], r["refers_to"]) for r in out}
        assert {(3, "response", None), (5, "revisit", 3), (7, "revisit", 3), (8, "response", None), (9, "response", None), (None, "response", None)} <= kind
        assert {r["url"] for r in out if r["page_id"] == 5} == {"http://a/ü\r\nX: y"}
        assert all(bytes(r["payload"]).decode() == dict((i, h or "") for i, _, h in rows)[r["page_id"]] for r in out if r["payload"] is not None and r["page_id"] not in (None,))
    assert warc.write_warc(pages(spark, []), "file://" + str(tmp_path / "e")).count() == 0


def test_false_magic_is_passed_over(tmp_path):
    record = warc.record_bytes(1, "u", b"x" * 500, hashlib.sha256(b"x" * 500).hexdigest())
    data = b"\x1f\x8b\x08junk" + record + record[:40] + warc.MAGIC + record
    at = tmp_path / "f"
    at.write_bytes(data)
    for cuts in ([0, len(data)], [0, 5, 9, 100, len(data)], list(range(0, len(data) + 1))):
        with at.open("rb") as f:
            got = [warc.parse_record(x)["page_id"] for a, b in zip(cuts, cuts[1:], strict=False) for x in warc.read_range(f, a, b)]
        assert got == [1, 1]


# ---------------------------------------------------------------- packing


def check_packing(rows, capacity):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return by_doc, by_seq


def test_packing_of_odd_texts(spark, odd, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(packing.VOCABULARY)
    special = documents(spark, [(50, "a <|endoftext|> b", "a"), (51, "naïve – “quotes” 中文 🙂", "a")])
    rows = packing.pack_documents(odd.unionByName(special)).collect()
    by_doc, by_seq = check_packing(rows, packing.CAPACITY)
    for i, t in [(i, t) for i, t, _ in odd_documents()] + [(50, "a <|endoftext|> b"), (51, "naïve – “quotes” 中文 🙂")]:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        for r in by_doc[i]:
            part = ids[r["start"] : r["start"] + r["length"]]
            assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and len(part) == r["length"]
        if i != 9:
            assert sum(r["length"] for r in by_doc[i]) == len(ids) and all(r["length"] == packing.CAPACITY for r in by_doc[i] if r["piece"] > 0)
    assert len(by_doc[9]) == 2
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // packing.CAPACITY) + 1
    assert packing.pack_documents(none).count() == 0


def test_bins_are_fewest_for_small_cases():
    rng = random.Random(1)
    for _ in range(150):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        bins = packing.complete_bins(Counter(items), 20)
        assert sum(bins, Counter()) == Counter(items) and all(sum(b.elements()) <= 20 for b in bins)
        best = [len(items)]

        def place(i, rooms, items=items, best=best):
            if len(rooms) >= best[0]:
                return
            if i == len(items):
                best[0] = len(rooms)
                return
            for j in range(len(rooms)):
                if rooms[j] >= items[i]:
                    rooms[j] -= items[i]
                    place(i + 1, rooms)
                    rooms[j] += items[i]
            place(i + 1, [*rooms, 20 - items[i]])

        place(0, [])
        assert len(bins) == best[0] >= packing.lower_bound(Counter(items), 20)


# ---------------------------------------------------------------- mixing


def filled(sizes, weights=(5.0, 2.0, 1.0)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, open_, target = float(sum(sizes.values())), set(sizes), {}
    while True:
        rest = total - sum(target.values())
        level = rest / sum(w[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * w[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return target | {s: level * w[s] for s in open_}
        target |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over


def test_mixing_meets_targets(spark, odd, none):
    rng = random.Random(2)
    rows = [(100 + i, words(rng.randint(0, 60), i), rng.choice(["s1", "s2", "s2", "s2", "s3", "s4", None])) for i in range(900)] + odd_documents()
    out = mixing.mix_documents(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes, taken, largest = Counter(), Counter(), Counter()
    source = {i: s for i, _, s in rows}
    for r in out:
        s = source[r["doc_id"]]
        assert 0 <= r["copies"] <= 3
        sizes[s] += r["size"]
        taken[s] += r["size"] * r["copies"]
        largest[s] = max(largest[s], r["size"])
    want = filled(sizes)
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s])
    # a source that is one large document and little else can't do better than that document or none
    allowed = {s: largest[s] / 2 if sizes[s] < 2 * largest[s] else max(1, 0.01 * want[s]) for s in sizes}
    assert not {s: (taken[s], want[s]) for s in sizes if abs(taken[s] - want[s]) > allowed[s]}
    again = mixing.mix_documents(documents(spark, rows[::-1]).repartition(7)).collect()
    key = lambda r: (r["doc_id"], r["size"], r["copies"])
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mixing.mix_documents(none).count() == 0


def test_a_heavy_document_does_not_spoil_its_source(spark):
    rows = [(i, words(5 + i % 30, i), f"s{i % 3}") for i in range(300)] + [(1000 + k, words(900 + k, k), f"s{k}") for k in range(3)]
    for seed in range(3):
        taken, target = Counter(), {}
        for r in mixing.mix_documents(documents(spark, rows), seed).collect():
            k = r["doc_id"] % 1000 % 3 if r["doc_id"] < 1000 else r["doc_id"] - 1000
            assert 0 <= r["copies"] <= 3
            taken[k] += r["size"] * r["copies"]
            target[k] = r["target"]
        assert all(abs(taken[k] - target[k]) <= 0.01 * target[k] for k in target)


def test_rounding_keeps_expectations(spark):
    docs = documents(spark, [(i, "w " * (1 + i % 7), "b" if i % 2 else "a") for i in range(60)]).persist()
    totals = Counter()
    for seed in range(40):
        for r in mixing.mix_documents(docs, seed).collect():
            totals[r["doc_id"] % 2] += r["copies"] / 30 / 40
    rates = {r["doc_id"] % 2: r["target"] / r["source_size"] for r in mixing.mix_documents(docs).collect()}
    assert all(totals[k] == pytest.approx(rates[k], rel=0.08) for k in rates)


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text, k=3):
    found = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()]
    grams = [b" ".join(found[i : i + k]) for i in range(len(found) - k + 1)] or ([b" ".join(found)] if found else [])
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(odd):
    got = {(r["doc_id"], r["fp"] & (2**64 - 1)) for r in simhash.fingerprints(odd).collect()}
    assert got == {(i, plain_fingerprint(t)) for i, t, _ in odd_documents()}
    assert simhash.fingerprint("One  TWO", 3) == plain_fingerprint("one two")


def test_all_links_up_to_three_bits(spark):
    rng = random.Random(7)
    fps = {0, 2**64 - 1}
    while len(fps) < 260:
        fp = rng.getrandbits(64)
        fps.add(fp)
        for _ in range(4):
            for _ in range(rng.randint(1, 4)):
                fp ^= 1 << rng.randrange(64)
            fps.add(fp)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.ball_links(spark.createDataFrame(list(enumerate(signed)), "rep long, fp long")).collect()
    joined = {i: i for i in range(len(fps))}

    def find(parent, x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in links:
        assert (fps[r["u"]] ^ fps[r["v"]]).bit_count() <= 3
        joined[find(joined, r["u"])] = find(joined, r["v"])
    want = {i: i for i in range(len(fps))}
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                want[find(want, i)] = find(want, j)
    same = lambda p: {frozenset(i for i in p if find(p, i) == r) for r in {find(p, i) for i in p}}
    assert same(joined) == same(want)


def test_simhash_groups_of_odd_texts(odd, none):
    out = {r["doc_id"]: r for r in simhash.simhash_groups(odd).collect()}
    assert out[0]["component_id"] == out[1]["component_id"] == out[2]["component_id"] == 0 and out[0]["fingerprint"] == "0" * 16
    assert out[6]["component_id"] == 5 and out[8]["component_id"] == 4
    assert simhash.simhash_groups(odd).count() == 13 and simhash.simhash_groups(none).count() == 0


# ---------------------------------------------------------------- sharding


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 24, 25, 1000])
def test_permutation_is_one(spark, n):
    out = [r[0] for r in spark.range(n).select(sharding.permute(F.col("id"), n, 5)).collect()]
    assert sorted(out) == list(range(n))


def test_shards(spark, odd, none, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 50)
    rows = [(i, words(i % 50, i), "a") for i in range(100, 700)] + odd_documents()
    docs = documents(spark, rows)
    out = sharding.permutation_shards(docs, 24).collect()
    counts = Counter(r["shard"] for r in out)
    assert len(out) == len(rows) and max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(24))
    for s, n in counts.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(n))
    text = {i: (t or "").encode() for i, t, _ in rows}
    assert all(r["size"] == len(text[r["doc_id"]]) + 8 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) and r["grown_shard"] is None for r in out)
    again = sharding.permutation_shards(docs.repartition(9), 24).collect()
    key = lambda r: (r["doc_id"], r["shard"], r["slot"])
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert sharding.permutation_shards(none, 24).count() == 0
