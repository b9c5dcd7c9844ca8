"""Best-fit packing of token pieces by bin completion."""

from __future__ import annotations

import base64
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkmosaic.llm.common import table
from linkmosaic.sources.shared import materialize

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
CAPACITY = 2048
END = 0  # id after every document
PER_SHARD = 20_000  # pieces that one task packs, about
NODES = 2_000  # branch-and-bound nodes a shard
SPECIAL = "<|endoftext|>"  # fixed: the vocabulary's special token

_encoders: dict = {}


def encoder(path: str = VOCABULARY):
    """text -> ids as bytes of unsigned 32-bit numbers, little-endian, as the tokenizer file gives them.

    Byte-level ranks beside the file give the same ids several times faster; texts that hold the special
    token's string go to the tokenizer itself.
    """
    if path not in _encoders:
        ranks_at = path.removesuffix(".json") + ".tiktoken"
        try:
            import tiktoken

            with open(ranks_at, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        except (ImportError, FileNotFoundError):
            plain = None
        whole = []

        def exact(text: str) -> list[int]:
            if not whole:
                from tokenizers import Tokenizer

                whole.append(Tokenizer.from_file(path))
            return whole[0].encode(text, add_special_tokens=False).ids

        def run(text: str) -> bytes:
            ids = array("I", exact(text) if plain is None or SPECIAL in text else plain(text))
            ids.append(END)
            if array("I", [1]).tobytes() != b"\x01\x00\x00\x00":
                ids.byteswap()
            return ids.tobytes()

        _encoders[path] = run
    return _encoders[path]


def token_pieces(df: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents longer than capacity are cut in pieces of capacity, the first of which may be shorter."""

    def run(batches):
        encode = encoder(path)
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"], b["text"], strict=True):
                data = encode(text or "")
                n = len(data) // 4
                at, piece = 0, 0
                step = n % capacity or capacity
                while at < n:
                    rows.append((doc_id, piece, at, step, zlib.crc32(data[4 * at : 4 * (at + step)])))
                    at, piece, step = at + step, piece + 1, capacity
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: Counter, capacity: int) -> int:
    """Bins that any packing needs: by volume, and by what can't share a bin with the large pieces.

    For every k up to half the capacity: pieces over capacity - k share no bin with those of k and more,
    those over half of it none with each other, and what is left beside them must take the rest.
    """
    count = np.zeros(capacity + 1, np.int64)
    for s, n in sizes.items():
        count[s] = n
    size = np.arange(capacity + 1)
    up_to, volume = np.cumsum(count), np.cumsum(count * size)
    half, k = capacity // 2, np.arange(1, capacity // 2 + 1)
    n_large, n_half = up_to[-1] - up_to[capacity - k], up_to[capacity - k] - up_to[half]
    room = capacity * n_half - (volume[capacity - k] - volume[half])
    small = volume[half] - volume[k - 1]
    extra = np.maximum(0, -((room - small) // capacity))
    return int(max(-(-volume[-1] // capacity), (n_large + n_half + extra).max(initial=0)))


def best_fit(sizes: Counter, capacity: int) -> list[Counter]:
    """Best-fit decreasing: every piece goes to the fullest bin that takes it."""
    bins: list[Counter] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set if some bin has room r
    for s in sorted(sizes, reverse=True):
        for _ in range(sizes[s]):
            over = rooms >> s
            if over:
                room = s + ((over & -over).bit_length() - 1)
                at = by_room[room].pop()
                if not by_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, at = capacity, len(bins)
                bins.append(Counter())
            bins[at][s] += 1
            by_room[room - s].append(at)
            rooms |= 1 << (room - s)
    return bins


def fillings(left: Counter, mask: int, room: int, most: int = 40, steps: int = 400) -> list[tuple[int, tuple[int, ...]]]:
    """(waste, pieces) of undominated ways to fill room, least waste first; bit s of mask is set if left has size s.

    A filling is dominated if a piece left out still fits, if one of its pieces, or two of them together,
    can be exchanged for one larger piece left out that fits.
    """
    found: list[tuple[int, tuple[int, ...]]] = []

    def undominated(pick: tuple[int, ...], waste: int) -> bool:
        free = mask
        for s, n in Counter(pick).items():
            if left[s] <= n:
                free &= ~(1 << s)
        if free & ((2 << waste) - 1):
            return False
        if any((free >> (p + 1)) & ((1 << waste) - 1) for p in set(pick)):
            return False
        return not any((free >> (a + b)) & ((2 << waste) - 1) for i, a in enumerate(pick) for b in pick[i + 1 :])

    def grow(largest: int, room: int, pick: tuple[int, ...]) -> None:
        nonlocal steps
        steps -= 1
        if steps < 0 or len(found) >= most:
            return
        s = (mask & ((2 << min(largest, room)) - 1)).bit_length() - 1
        if s <= 0:
            if undominated(pick, room):
                found.append((room, pick))
            return
        for n in range(min(left[s], room // s), -1, -1):
            grow(s - 1, room - n * s, pick + (s,) * n)

    grow(room, room, ())
    return sorted(set(found))


def _search(sizes: Counter, best: list[Counter], capacity: int, nodes: int) -> tuple[list[Counter], int]:
    """Branch and bound over bins, with an incumbent and a number of nodes -> (better bins or the incumbent, nodes left)."""
    bound = lower_bound(sizes, capacity)
    total = sum(k * v for k, v in sizes.items())
    left, done, waste = Counter(sizes), [], 0
    mask = sum(1 << s for s in sizes if sizes[s] > 0)

    def put(pick: tuple[int, ...], sign: int) -> None:
        nonlocal mask
        for s in pick:
            left[s] += sign
            mask = mask | (1 << s) if left[s] > 0 else mask & ~(1 << s)

    def ways() -> list[tuple[int, tuple[int, ...]]]:
        top = mask.bit_length() - 1
        put((top,), -1)
        got = fillings(left, mask, capacity - top)
        put((top,), 1)
        return [(w, (top, *p)) for w, p in got][::-1]

    open_ways = [ways()]
    while open_ways and nodes > 0 and len(best) > bound:
        if not open_ways[-1]:
            open_ways.pop()
            if done:
                w, pick = done.pop()
                waste -= w
                put(pick, 1)
            continue
        nodes -= 1
        w, pick = open_ways[-1].pop()
        if waste + w > (len(best) - 1) * capacity - total:
            open_ways[-1].clear()  # the others waste as much or more
            continue
        waste += w
        put(pick, -1)
        done.append((w, pick))
        if mask:
            open_ways.append(ways())
        else:
            best = [Counter(p) for _, p in done]
            open_ways.append([])
    return best, nodes


def complete_bins(sizes: Counter, capacity: int = CAPACITY, nodes: int = NODES) -> list[Counter]:
    """Bins for a multiset of sizes: best-fit decreasing as the incumbent, then bin completion.

    A node takes the largest piece left and branches over the undominated fillings around it, least waste
    first.  A branch ends when its waste exceeds what one bin less than the incumbent leaves, and the
    search when the lower bound is met or the nodes are used up; then the incumbent stands.  Bins that are
    full already cannot be bettered, so the search is over the pieces of the bins that waste most: enough
    of them that a bin could be saved, then more, all of them where they are few.  Where the waste is spread
    so thin that this takes more bins than a quarter of the nodes, the incumbent stands, within the sum of
    that waste of the bound.  Every piece is in a bin in any case.
    """
    best = best_fit(sizes, capacity)
    bound = lower_bound(sizes, capacity)
    room = lambda b: capacity - sum(k * v for k, v in b.items())
    while len(best) > bound and nodes > 0:
        best.sort(key=room, reverse=True)
        gained, tried = False, 0
        for goal in (1.25, 2, 4, 8):
            n, wasted = 0, 0
            while n < len(best) and (wasted < goal * capacity or (goal == 8 and n < 64)):
                wasted += room(best[n])
                n += 1
            if wasted < capacity or n == tried or 4 * n > nodes:  # nothing to save, or too few nodes to reach the last bin
                continue
            tried = n
            part = sum(best[:n], Counter())
            found, nodes = _search(part, best[:n], capacity, nodes)
            if len(found) < n:
                best, gained = found + best[n:], True
                break
        if not gained:
            break
    return best


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, per_shard: int = PER_SHARD) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32).

    Full pieces are sequences of their own.  The others are hashed to shards of about per_shard pieces
    that tasks pack by bin completion; a shard ends within its own rounding of the common bound, so the
    sum stays within one sequence a shard of it where each shard meets its bound.
    """
    cut = pieces.filter(F.col("length") < capacity)
    shards = max(1, -(-cut.count() // per_shard))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["length", "doc_id", "piece", "start"], kind="stable")
        waiting: dict[int, list[int]] = defaultdict(list)
        for i, n in enumerate(g["length"]):
            waiting[int(n)].append(i)
        seq, off = np.zeros(len(g), np.int64), np.zeros(len(g), np.int64)
        base = int(g["shard"].iloc[0]) << 32
        for number, b in enumerate(complete_bins(Counter({k: len(v) for k, v in waiting.items()}), capacity)):
            at = 0
            for size in sorted(b.elements(), reverse=True):
                i = waiting[size].pop()
                seq[i], off[i] = base + number, at
                at += size
        return g.drop(columns="shard").assign(sequence_id=seq, offset=off)

    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    sharded = cut.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(shards)).cast("int"))
    packed = sharded.groupBy("shard").applyInPandas(pack, kinds)
    alone = pieces.filter(F.col("length") == capacity).select("*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(alone)


def pack_documents(df: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """Documents -> pieces with their place in sequences of at most `capacity` tokens.

    Null and empty texts are the end id alone.  Repeated rows are packed each on its own.  No rows: no rows.
    """
    return pack_pieces(materialize(token_pieces(df, capacity, path), "pack"), capacity)


def op7_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
