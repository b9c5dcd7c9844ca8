"""Seeds between patches against a plain search."""

import random

from linkmosaic.operators import pairs


def by_search(cells, most, width):
    apart, out = max(4, -(-int(3 * width) // 2)), set()
    for p in sorted({c[0] for c in cells}):
        for q in sorted({c[0] for c in cells if c[0] > p}):
            near = sorted(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, a[1], a[2], b[1], b[2]) for a in cells for b in cells if a[0] == p and b[0] == q)
            kept = []
            for x in [x for x in near if x[0] <= most * most][:200]:
                far = all(max(abs(x[1] - k[1]), abs(x[2] - k[2])) > apart and max(abs(x[3] - k[3]), abs(x[4] - k[4])) > apart for k in kept)
                if far and len(kept) < 8:
                    kept.append(x)
            out |= {(p, q, *x[1:], x[0], i + 1) for i, x in enumerate(kept)}
    return out


def test_seeds_equal_a_search(spark):
    rng = random.Random(5)
    cells = sorted({(rng.randint(1, 4), rng.randint(1, 30), rng.randint(1, 30)) for _ in range(160)})
    df = spark.createDataFrame([(0, r, c, p) for p, r, c in cells], "cell long, r long, c long, patch_id long")
    found = pairs.pair_seeds(pairs.boundary_pairs(df, 9, compat=False), 3)
    assert {tuple(r) for r in found.select("p1", "p2", "r1", "c1", "r2", "c2", "d2", "seed").collect()} == by_search(cells, 9, 3)


def test_no_pairs_no_seeds(spark):
    df = spark.createDataFrame([(0, 1, 1, 1), (0, 20, 20, 2)], "cell long, r long, c long, patch_id long")
    assert pairs.pair_seeds(pairs.boundary_pairs(df, 3), 1).count() == 0
