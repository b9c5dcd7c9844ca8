"""Removal of long repeated strings by a distributed merge sort of sampled suffixes."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmosaic.llm.common import pack_extra, table, text_of, unpack_extra
from linkmosaic.sources.shared import discard, materialize

SPAN = 400  # bytes of a string that counts as repeated
PASSAGE = 256  # the least length that can be asked for: some fifty words without a break
WINDOW = 160  # places among which a string's anchor is chosen
PREFIX = PASSAGE - WINDOW + 1  # bytes that all strings with one anchor have from the anchor on
GRAM = 8  # bytes that the choice of an anchor looks at
CHUNK = 1 << 22  # bytes of a text that are looked at together
RUN_BYTES = 48 << 20  # suffix bytes after which a task closes a run
PART_BYTES = 24 << 20  # suffix bytes that one merge gets, about
PAIRS = 24  # different contexts up to which a group is resolved pair by pair


def anchors(data: bytes) -> list[tuple[int, int, int]]:
    """(place, most, least) of the anchors of a text's strings of PASSAGE bytes or more.

    Every string has one anchor: the leftmost place of the least hash among its first WINDOW places.  Equal
    strings so have their anchors at equal offsets.  `place` is the anchor of the strings that start from
    `most` to `least` bytes before it.
    """
    out: list[tuple[int, int, int]] = []
    n_starts = len(data) - PASSAGE + 1
    for lo in range(0, max(n_starts, 0), CHUNK):
        starts = min(CHUNK, n_starts - lo)
        raw = np.frombuffer(data, np.uint8, count=starts + WINDOW + GRAM - 2, offset=lo)
        h = np.ndarray((starts + WINDOW - 1,), "<u8", raw, strides=(1,)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        low = ((h >> np.uint64(25)) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        wide = 1
        while wide < WINDOW:
            step = min(wide, WINDOW - wide)
            low = np.minimum(low[:-step], low[step:])
            wide += step
        at = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        last = np.r_[first[1:], starts] - 1
        place = at[first]
        out += zip((place + lo).tolist(), (place - first).tolist(), (place - last).tolist(), strict=True)
    return out


def common(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, of which `at` bytes are known."""
    n = min(len(a), len(b))
    if a[at:n] == b[at:n]:
        return n
    x = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (x.bit_length() + 7) // 8


# ---------------------------------------------------------------- front-coded runs

_HEAD = struct.Struct("<II")


class Run:
    """Suffixes of one task for one merge, as they are gathered: (right, left, least, place, document)."""

    def __init__(self, reach: int = SPAN) -> None:
        self.items: list[tuple[bytes, bytes, int, int, int]] = []
        self.size = 0
        self.reach = reach

    def add(self, data: bytes, place: int, most: int, least: int, doc: int) -> None:
        right = data[place : place + self.reach - least]
        self.items.append((right, data[place - most : place][::-1], least, place, doc))
        self.size += len(right) + most + 100

    def blob(self, docs: list[tuple[int, int]]) -> bytes:
        """Sorted and front-coded: each suffix as the length it shares with the one before, and the rest."""
        self.items.sort()
        used = sorted({x[4] for x in self.items})
        renumber = {d: i for i, d in enumerate(used)}
        shared, tails, prev = [], [], b""
        for right, *_ in self.items:
            same = common(prev, right)
            shared.append(same)
            tails.append(right[same:])
            prev = right
        ids = np.array([docs[d] for d in used], "<i8").tobytes()
        cols = np.array([(s, len(t), len(x[1]), x[2], x[3], renumber[x[4]]) for s, t, x in zip(shared, tails, self.items, strict=True)], "<i8").T
        parts = [_HEAD.pack(len(self.items), len(used)), ids, np.ascontiguousarray(cols).tobytes(), b"".join(tails), b"".join(x[1] for x in self.items)]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def decoded(blob: bytes) -> Iterator[tuple[int, bytes, tuple]]:
    """(shared with the one before, suffix, (left, least, place, (doc_id, hash))) in order."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, n_docs = _HEAD.unpack_from(raw)
    ids = np.frombuffer(raw, "<i8", 2 * n_docs, _HEAD.size).reshape(-1, 2).tolist()
    at = _HEAD.size + 16 * n_docs
    cols = np.frombuffer(raw, "<i8", 6 * n, at).reshape(6, n)
    at += 48 * n
    left_at = at + int(cols[1].sum())
    prev = b""
    for same, tail, most, least, place, doc in cols.T.tolist():
        prev = prev[:same] + raw[at : at + tail]
        yield same, prev, (raw[left_at : left_at + most], least, place, tuple(ids[doc]))
        at += tail
        left_at += most


def merged(runs: list[Iterable[tuple[int, bytes, tuple]]]) -> Iterator[tuple[int, bytes, tuple]]:
    """Merge of sorted runs by a loser tree; gives each suffix with what it shares with the one before.

    Every waiting suffix knows the length it shares with the last one given out: of two, the one that
    shares more comes first, and only on a tie are bytes compared, from that length on.
    """
    its = [iter(r) for r in runs]
    k = 1
    while k < len(its):
        k *= 2
    heads: list[tuple[bytes, tuple] | None] = [None] * k
    known = [0] * k
    for i, it in enumerate(its):
        got = next(it, None)
        if got:
            heads[i] = (got[1], got[2])

    def beats(i: int, j: int) -> bool:
        """Whether i comes before j; the loser's shared length becomes the one with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if known[i] != known[j]:
            return known[i] > known[j]
        x, y = a[0], b[0]
        same = common(x, y, known[i])
        first = same == len(x) or (same < len(y) and x[same] < y[same])
        known[j if first else i] = same
        return first

    tree = [0] * k

    def build(node: int) -> int:
        if node >= k:
            return node - k
        a, b = build(2 * node), build(2 * node + 1)
        if beats(a, b):
            tree[node] = b
            return a
        tree[node] = a
        return b

    win = build(1) if k > 1 else 0
    while heads[win] is not None:
        right, rest = heads[win]
        yield known[win], right, rest
        got = next(its[win], None)
        if got:
            heads[win], known[win] = (got[1], got[2]), got[0]
        else:
            heads[win], known[win] = None, -1
        node = (win + k) // 2
        while node:
            if beats(tree[node], win):
                tree[node], win = win, tree[node]
            node //= 2


# ---------------------------------------------------------------- what is repeated


def _by_pairs(kinds: list[tuple[bytes, bytes, int]], wide: list[tuple[int, int]], found: list[list[tuple[int, int]]], span: int) -> None:
    for i in range(len(kinds)):
        for j in range(i + 1, len(kinds)):
            lo = max(wide[i][0], wide[j][0], span - common(kinds[i][0], kinds[j][0], PREFIX))
            hi = min(wide[i][1], wide[j][1])
            if lo <= hi:
                hi = min(hi, common(kinds[i][1], kinds[j][1]))
                if lo <= hi:
                    found[i].append((lo, hi))
                    found[j].append((lo, hi))


def _by_offset(kinds: list[tuple[bytes, bytes, int]], wide: list[tuple[int, int]], found: list[list[tuple[int, int]]], span: int) -> None:
    """For every offset of the start before the anchor, the classes of equal right parts and of equal left parts together."""
    n = len(kinds)
    share = np.array([common(kinds[i - 1][0], kinds[i][0]) if i else 0 for i in range(n)])
    order = sorted(range(n), key=lambda i: kinds[i][1])
    left_share = np.array([common(kinds[order[i - 1]][1], kinds[order[i]][1]) if i else 0 for i in range(n)])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    least, most = np.array(wide).T
    for off in range(int(least.min()), int(most.max()) + 1):
        here = np.flatnonzero((least <= off) & (off <= most))
        if len(here) < 2:
            continue
        right = np.cumsum(share < span - off)
        left = np.cumsum(left_share < off)[rank]
        _, back, count = np.unique(right[here] * (n + 1) + left[here], return_inverse=True, return_counts=True)
        for i in here[count[back] > 1].tolist():
            if found[i] and found[i][-1][1] == off - 1:
                found[i][-1] = (found[i][-1][0], off)
            else:
                found[i].append((off, off))


def repeated(group: list[tuple[bytes, bytes, int, int, tuple]], span: int = SPAN) -> Iterator[tuple[tuple, int, int]]:
    """Of suffixes that share their first PREFIX bytes: (document, from, to) of bytes under a repeated string of `span` bytes.

    A string that starts l bytes before its anchor is repeated if another anchor of the group has the same
    l bytes before it and the same span - l bytes from it on.  Equal contexts are held once, with a count.
    """
    kinds: dict[tuple[bytes, bytes, int], list[tuple[int, tuple]]] = {}
    for right, left, least, place, doc in group:
        kinds.setdefault((right, left, least), []).append((place, doc))
    keys = sorted(kinds)
    # a text that ends soon has no string of the span that starts near the anchor
    wide = [(max(least, span - len(right)), len(left)) for right, left, least in keys]
    found: list[list[tuple[int, int]]] = [[w] if len(kinds[k]) > 1 and w[0] <= w[1] else [] for k, w in zip(keys, wide, strict=True)]
    if len(keys) > 1:
        (_by_pairs if len(keys) <= PAIRS else _by_offset)(keys, wide, found, span)
    for key, spans in zip(keys, found, strict=True):
        if spans:
            spans = sorted(set(spans))
            joined = [list(spans[0])]
            for lo, hi in spans[1:]:
                if lo <= joined[-1][1] + 1:
                    joined[-1][1] = max(joined[-1][1], hi)
                else:
                    joined.append([lo, hi])
            for place, doc in kinds[key]:
                for lo, hi in joined:
                    yield doc, place - hi, place - lo + span


def groups(runs: list[Iterable[tuple[int, bytes, tuple]]]) -> Iterator[list[tuple[bytes, bytes, int, int, tuple]]]:
    group: list = []
    for same, right, (left, least, place, doc) in merged(runs):
        if same < PREFIX:
            if len(group) > 1:
                yield group
            group = []
        group.append((right, left, least, place, doc))
    if len(group) > 1:
        yield group


def maximal(spans) -> list[list[int]]:
    runs: list[list[int]] = []
    for lo, hi in sorted(spans):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return runs


def cut(data: bytes, spans) -> tuple[bytes, int, int]:
    """(what is left, bytes removed, maximal runs removed) without the bytes of (from, to) spans."""
    runs = maximal(spans)
    kept, at = [], 0
    for lo, hi in runs:
        kept.append(data[at:lo])
        at = hi
    kept.append(data[at:])
    return b"".join(kept), sum(hi - lo for lo, hi in runs), len(runs)


# ---------------------------------------------------------------- distributed


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def repeated_spans(docs: DataFrame, laws: tuple[int, ...] = (SPAN,)) -> DataFrame:
    """docs(_id, _th, _text, ...) -> (_id, _th, spans): (law, lo, hi) under repeated strings of `law` bytes, for the texts that have any.

    1. Tasks list the anchors of their texts with a hash of the PREFIX bytes from each anchor on.
    2. Anchors whose hash no other anchor has can't lie in a repeated string; they are dropped by an
       aggregate and an equi-join, both of which take hot hashes.
    3. Tasks cut the suffixes at the anchors left, sort them, and send front-coded runs to merges by hash.
    4. A merge joins its runs in a loser tree and resolves the suffixes that share their PREFIX bytes.
    """
    spark = docs.sparkSession

    def sample(batches):
        for b in batches:
            rows: list[tuple] = []
            for doc_id, th, text in zip(b["_id"], b["_th"], b["_text"], strict=True):
                data = _bytes(text)
                rows += [(doc_id, th, p, m, x, xxhash.xxh64_intdigest(data[p : p + PREFIX]) - (1 << 63)) for p, m, x in anchors(data)]
            yield pd.DataFrame(rows, columns=["_id", "_th", "place", "most", "least", "key"])

    reach = max(laws)
    listed = materialize(docs.select("_id", "_th", "_text").mapInPandas(sample, "_id long, _th long, place long, most int, least int, key long"), "suffix")
    # a table of its own, so that the join reads two plain shuffles, of which AQE can split the hot parts
    twice = materialize(listed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "suffix")
    held = materialize(listed.join(twice.hint("merge"), "key", "left_semi"), "suffix")
    discard(listed)
    discard(twice)
    n = held.count()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * (reach + WINDOW) // PART_BYTES))
    mine = held.groupBy("_id", "_th").agg(F.collect_set(F.struct("place", "most", "least", "key")).alias("anchors"), F.count("*").alias("n"))
    # rows that repeat a whole document list their anchors as often; each takes its own set
    # all columns go along: so this join and the one that gives every document its spans read one shuffle
    joined = docs.join(mine.hint("shuffle_hash"), ["_id", "_th"])

    def send(batches):
        runs: dict[int, Run] = {}
        docs_here: list[tuple[int, int]] = []
        size = 0

        def close():
            out = pd.DataFrame([(p, r.blob(docs_here)) for p, r in runs.items()], columns=["part", "run"])
            runs.clear()
            docs_here.clear()
            return out

        for b in batches:
            for doc_id, th, text, marks in zip(b["_id"], b["_th"], b["_text"], b["anchors"], strict=True):
                data = _bytes(text)
                docs_here.append((int(doc_id), int(th)))
                for m in marks:
                    run = runs.setdefault(m["key"] % parts, Run(reach))
                    before = run.size
                    run.add(data, m["place"], m["most"], m["least"], len(docs_here) - 1)
                    size += run.size - before
                if size > RUN_BYTES:
                    yield close()
                    size = 0
        yield close()

    def merge(g: pd.DataFrame) -> pd.DataFrame:
        held: dict[tuple, list] = {}
        for group in groups([decoded(x) for x in g["run"]]):
            for law in laws:
                for doc, lo, hi in repeated(group, law):
                    held.setdefault((*doc, law), []).append((lo, hi))
        rows = [(i, th, law, lo, hi) for (i, th, law), spans in held.items() for lo, hi in maximal(spans)]
        return pd.DataFrame(rows, columns=["_id", "_th", "law", "lo", "hi"])

    runs = joined.mapInPandas(send, "part int, run binary")
    spans = runs.repartition(parts, "part").groupBy("part").applyInPandas(merge, "_id long, _th long, law int, lo long, hi long")
    return spans.groupBy("_id", "_th").agg(F.collect_set(F.struct("law", "lo", "hi")).alias("spans"))


def without_repeats(df: DataFrame, laws: tuple[int, ...] = (SPAN,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds `spans`: (law, lo, hi) byte spans under strings of `law` bytes that start anywhere else too.

    Laws are PASSAGE or more.  Rows are told apart by id and text; rows equal in both repeat each other, so
    that all their strings go.  Null and short texts have no spans.  A null id is a value like any other.
    No rows: no rows.  The text column is called _text in the result, the others keep their names.
    """
    if min(laws) < PASSAGE:
        raise ValueError(f"strings of fewer than {PASSAGE} bytes have no anchor")
    th = F.xxhash64(text_of(text_col))
    keyed = df.withColumns({"_id": F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))), "_th": th}).withColumnRenamed(text_col, "_text")
    return keyed.join(repeated_spans(keyed, laws).hint("shuffle_hash"), ["_id", "_th"], "left").drop("_id", "_th")


def strip_repeats(df: DataFrame, span: int = SPAN) -> DataFrame:
    """Documents with the repeated strings of `span` bytes cut out of their texts, n_chars adapted; other columns as they are.

    Bytes of a character that is cut through are left out with it.  A text of which nothing is left is empty;
    a null text stays null.  No rows: no rows.
    """
    packed = pack_extra(df)

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            spans = cols.pop(b.schema.get_field_index("spans")).to_pylist()
            names = [x for x in b.schema.names if x != "spans"]
            i = names.index("text")
            texts = [t if not s else cut(_bytes(t), [(x["lo"], x["hi"]) for x in s])[0].decode("utf-8", "ignore") for t, s in zip(cols[i].to_pylist(), spans, strict=True)]
            cols[i] = pa.array(texts, cols[i].type)
            if "n_chars" in names:
                j = names.index("n_chars")
                cols[j] = pa.array([old if not s else len(t) for t, s, old in zip(texts, spans, cols[j].to_pylist(), strict=True)], cols[j].type)
            yield pa.RecordBatch.from_arrays(cols, names)

    cleaned = without_repeats(packed, (span,)).withColumnRenamed("_text", "text").select(*packed.columns, "spans").mapInArrow(run, T.StructType(packed.schema.fields))
    return unpack_extra(cleaned, df.columns)


def op5_front_coded_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document by the law of SPAN bytes; n_passage counts the bytes under repeated strings of PASSAGE bytes.

    Null and empty texts have no bytes and the digest of nothing.  No documents: no rows.
    """
    marked = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), (SPAN, PASSAGE))

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(b["doc_id"], b["_text"], b["spans"], strict=True):
                data = _bytes(text)
                by_law: dict[int, list] = {SPAN: [], PASSAGE: []}
                for x in spans if spans is not None else ():
                    by_law[x["law"]].append((x["lo"], x["hi"]))
                kept, removed, n = cut(data, by_law[SPAN])
                passages = sum(hi - lo for lo, hi in maximal(by_law[PASSAGE]))
                rows.append((doc_id, len(data), removed, n, hashlib.sha256(kept).hexdigest(), passages))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage"])

    return marked.mapInPandas(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage long")
