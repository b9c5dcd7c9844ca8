"""The near-copies stage against brute force at five-word Jaccard 0.8, on planted near copies."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P


def edited(text, swaps, rng):
    held = text.split()
    for k in rng.sample(range(len(held)), swaps):
        held[k] = f"new{rng.randrange(10**6)}"
    return " ".join(held)


def planted():
    rng = random.Random(7)
    prose = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    passage = prose(60)
    rows = []
    for size in (1, 4, 5, 9, 40, 120, 300, 1500):
        for _ in range(3):
            first = prose(size)
            rows += [first, first.upper(), first + " more", prose(3) + " " + first]
            rows += [edited(first, s, rng) for s in {min(size, 1), size // 100, size // 60, size // 40, size // 20}]
    for _ in range(25):  # a passage that many share, in texts that are not alike
        rows.append(prose(50) + " " + passage + " " + prose(rng.randrange(5, 60)))
    many, chain = prose(150), prose(200)
    rows += [edited(many, 2, rng) for _ in range(40)]  # each near the first, and some pairs not near each other
    for _ in range(12):  # a chain: neighbours are near, the ends are not
        chain = edited(chain, 2, rng)
        rows.append(chain)
    rows += ["", "  \n ", None, "!", "a b c d", "A b\tC d"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def grams(text):
    held = (text or "").split()
    held = [w.lower() for w in held]
    return {tuple(held[i : i + 5]) for i in range(len(held) - 4)} or ({tuple(held)} if held else set())


def brute(rows):
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    near = 0
    for a in sets:
        for b in sets:
            if a < b:
                x, y = sets[a], sets[b]
                if x == y or 5 * len(x & y) >= 4 * len(x | y):
                    near += x != y
                    p, q = sorted((top(a), top(b)))
                    root[q] = p
    return {i for i in sets if top(i) == i}, near


@pytest.mark.parametrize("more", [2, 8])
def test_near_copies_against_brute_force(spark, monkeypatch, more):
    monkeypatch.setattr("linkmosaic.llm.shingles.MORE", more)
    rows = planted()
    kept, near = brute(rows)
    assert near > 100 and len(kept) < len(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.near_copies(spark, docs, "")
    assert {r[0] for r in out.select("doc_id").collect()} == kept
    nameless = docs.withColumn("doc_id", F.lit(None).cast("long")).limit(3)
    assert P.near_copies(spark, docs.unionByName(nameless), "").count() == len(kept) + 3
