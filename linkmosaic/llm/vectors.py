"""Exact top-k search by pivot bounds, and near-duplicate vectors by spherical k-means cells."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkmosaic.llm.common import table
from linkmosaic.operators.components import connected_components, merge_pairs
from linkmosaic.sources.shared import materialize


def usable(col: str) -> Column:
    """Whether an array is there, has components, and all of them are finite numbers."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.col(col).isNotNull() & (F.size(col) > 0) & F.forall(col, lambda x: F.coalesce(fine(x.cast("double")), F.lit(False))), F.lit(False))


def _matrix(blobs) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype="<f8").reshape(len(blobs), -1)


def _pack(arrays, dim: int) -> np.ndarray:
    out = np.zeros((len(arrays), dim))
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


# ---------------------------------------------------------------- exact top-k


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to n rows of the sample, each farthest from the span of those before; rows that lie nearly in it are left out."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    picked, rest, least = [0], sample - sample[0], None
    while len(picked) < n:
        size = (rest * rest).sum(1)
        j = int(size.argmax())
        least = 1e-4 * size[j] if least is None else least
        if not np.isfinite(size[j]) or size[j] <= least:
            break
        u = rest[j] / np.sqrt(size[j])
        picked.append(j)
        rest = rest - np.outer(rest @ u, u)
    return sample[picked]


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles while they fit 53 bits, else in Python's integers, held to a long."""
    top = (np.abs(q).max(initial=0) or 1.0) * (np.abs(v).max(initial=0) or 1.0) * max(1, q.shape[1])
    if top < 2.0**53:
        return (q @ v.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(q).dot(whole(v).T) if q.size and v.size else np.zeros((len(q), len(v)), dtype=object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


class PivotTable:
    """Bounds on inner products from distances to pivots.

    With p pivots their distances fix where a vector stands in the pivots' span (p - 1 coordinates c from the first
    pivot) and how far it is from that span (h), so d(q, v)^2 >= |c_q - c_v|^2 + (h_q - h_v)^2.  That is the greatest
    lower bound which the distances allow, and no less than |d(q, x) - d(v, x)| for any pivot x.  `err` covers rounding.
    """

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        away = pivots[1:] - pivots[0]
        self.sizes = (away * away).sum(1)
        self.inverse = np.linalg.inv(np.linalg.qr(away.T)[1]) if len(away) else np.zeros((0, 0))
        self.stretch = np.linalg.norm(self.inverse, 2) if len(away) else 0.0

    def distances(self, m: np.ndarray) -> np.ndarray:
        return np.stack([np.linalg.norm(m - p, axis=1) for p in self.pivots], axis=1)

    def places(self, far: np.ndarray, err: float) -> tuple[np.ndarray, np.ndarray]:
        sq = far * far
        c = (sq[:, :1] + self.sizes - sq[:, 1:]) / 2 @ self.inverse
        return c, np.sqrt(np.maximum(0, sq[:, 0] - (c * c).sum(1)) + err)

    def bounds(self, q_sq, q_far, v_sq, v_far) -> np.ndarray:
        """Upper bounds of <q, v>: (|q|^2 + |v|^2 - d^2) / 2 with the least d; infinite where numbers are too large, never below a long."""
        with np.errstate(all="ignore"):
            top = max(q_far.max(initial=0), v_far.max(initial=0), self.sizes.max(initial=0) ** 0.5)
            err = 16 * len(self.pivots) * np.finfo(float).eps * top**2 * (1 + self.stretch * top)
            (qc, qh), (vc, vh) = self.places(q_far, err), self.places(v_far, err)
            sums = q_sq[:, None] + v_sq[None, :]
            apart = (sums - (q_far[:, 0] ** 2)[:, None] - (v_far[:, 0] ** 2)[None, :]) / 2
            bound = apart + qc @ vc.T + np.outer(qh, vh) + err + 1e-9 * sums + 1e-6
        return np.where(np.isfinite(bound), np.maximum(bound, -(2.0**63)), np.inf)


def _kth(score: np.ndarray, k: int):
    return np.partition(score, len(score) - k)[len(score) - k]


def _block_top(q_ids, q, q_far, q_least, v_ids, v, v_far, k: int, pivots: PivotTable):
    """Best k of the block for each query: candidates by falling upper bound until none can reach the k-th score so far.

    The k-th score starts at q_least, which k rows elsewhere reach; every score that reaches the k-th is looked at, ties too.
    """
    q_sq, v_sq = (q * q).sum(1), (v * v).sum(1)
    for lo in range(0, len(q), 64):
        part = slice(lo, lo + 64)
        bound = pivots.bounds(q_sq[part], q_far[part], v_sq, v_far)
        for i, one in enumerate(bound, lo):
            kth = q_least[i]
            rest = np.flatnonzero((one >= kth) & (v_ids != q_ids[i]))
            rest = rest[np.argsort(-one[rest], kind="stable")]
            at, score, step = rest[:0], np.empty(0, np.int64), max(64, 2 * k)
            while len(rest) and one[rest[0]] >= kth:
                at = np.concatenate([at, rest[:step]])
                score = np.concatenate([score, _products(q[i : i + 1], v[rest[:step]])[0]])
                rest, step = rest[step:], step * 2
                if len(score) >= k:
                    kth = max(kth, _kth(score, k))
            best = np.lexsort((v_ids[at], -score))[:k]
            yield q_ids[i], v_ids[at[best]], score[best]


def exact_top_k(df: DataFrame, is_query: Column, k: int = 20, pivots: int = 64, block: int = 8192, query_block: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 64.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the k largest integer inner products of floor(scale * x).

    Up to `pivots` vectors are spread out over a sample of at most 1,024 rows (fixed bounds; they decide
    speed only).  A first pass writes every vector with its distances to the pivots, and every query with
    its k-th score in the sample, below which nothing needs a look.  Queries and rows are then cut in
    blocks; a task takes one block of queries and one of rows, so its memory is fixed; each
    task's best k go to a last ranking by query.  Ties go to the smaller id.

    Null vectors, empty ones, and those with null or non-finite components take no part; shorter vectors
    count as padded with zeros.  Rows that share the query's id are not its candidates; a query id that
    repeats is asked once, with its smallest vector.  Scores beyond a long are held at its ends.
    An empty table, or one without queries, gives no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e"), F.coalesce(is_query, F.lit(False)).alias("q")).filter(usable("e") & F.col("vec_id").isNotNull())
    sizes = rows.agg(F.count("*"), F.count(F.when(F.col("q"), 1)), F.max(F.size("e"))).first()
    n, n_q, dim = sizes[0], sizes[1], sizes[2] or 1
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(1024).select("vec_id", "e").toPandas()
    s_ids, known = sample["vec_id"].to_numpy(dtype="int64"), np.floor(scale * _pack(list(sample["e"]), dim))
    held_by = PivotTable(_spread(known, pivots))
    n_blocks, q_blocks = max(1, -(-n // block)), max(1, -(-n_q // query_block))

    def least(ids: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The k-th score in the sample, or the least long where that has fewer rows."""
        none = np.iinfo(np.int64).min
        if len(s_ids) < k:
            return np.full(len(m), none)
        score = np.where(ids[:, None] == s_ids[None, :], none, _products(m, known))
        return np.array([_kth(x, k) for x in score], dtype="int64")

    def prepare(batches):
        for whole in batches:
            for lo in range(0, len(whole), 2048):
                b = whole.iloc[lo : lo + 2048]
                m = np.floor(scale * _pack([np.asarray(x, dtype=float) for x in b["e"]], dim))
                asks, start = b["q"].to_numpy(dtype=bool), np.zeros(len(b), dtype="int64")
                start[asks] = least(b["vec_id"].to_numpy()[asks], m[asks])
                yield pd.DataFrame({"vec_id": b["vec_id"], "q": b["q"], "v": [x.tobytes() for x in m], "far": [x.tobytes() for x in held_by.distances(m)], "least": start})

    held = materialize(rows.mapInPandas(prepare, "vec_id long, q boolean, v binary, far binary, least long"), "topk")
    right = held.withColumn("b", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n_blocks)).cast("int"))
    right = right.select("b", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("a"), "vec_id", "v", "far")
    asked = held.filter("q").groupBy("vec_id").agg(F.min(F.struct("v", "far", "least")).alias("s")).select("vec_id", "s.*")
    left = asked.withColumn("a", F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int"))
    left = left.select("a", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"), "vec_id", "v", "far", "least")

    def search(ql: pd.DataFrame, vr: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(ql) and len(vr):
            for q, ids, score in _block_top(ql["vec_id"].to_numpy(), _matrix(ql["v"]), _matrix(ql["far"]), ql["least"].to_numpy(), vr["vec_id"].to_numpy(), _matrix(vr["v"]), _matrix(vr["far"]), k, held_by):
                found.append(pd.DataFrame({"query_id": q, "vec_id": ids, "score": score}))
        return pd.concat(found) if found else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    near = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


ORACLE_TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.e::double[], c.e::double[]) as bigint) as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20"""


# ---------------------------------------------------------------- near-duplicate vectors


def fit_cells(sample: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """Spherical k-means: unit centroids of a sample of unit vectors; an empty cell is moved to the worst-fitted vector."""
    rng = np.random.default_rng(seed)
    c = sample[np.sort(rng.choice(len(sample), size=min(k, len(sample)), replace=False))].copy()
    for _ in range(rounds):
        home, fit = np.empty(len(sample), np.int64), np.empty(len(sample))
        for lo in range(0, len(sample), 1024):
            s = sample[lo : lo + 1024] @ c.T
            home[lo : lo + 1024], fit[lo : lo + 1024] = s.argmax(1), s.max(1)
        new = np.zeros_like(c)
        np.add.at(new, home, sample)
        worst = iter(np.argsort(fit, kind="stable"))
        for i in np.flatnonzero(np.bincount(home, minlength=len(c)) == 0):
            new[i] = sample[next(worst)]
        norm = np.linalg.norm(new, axis=1, keepdims=True)
        new = np.where(norm > 0, new / np.where(norm > 0, norm, 1), c)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def _dense(lists: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column, shorter ones padded with zeros, and which of them are usable and not zero."""
    lens, flat = lists.value_lengths().fill_null(0).to_numpy(), lists.flatten().to_numpy(zero_copy_only=False)
    if (lens == dim).all():
        m = flat.reshape(-1, dim)
    else:
        m, starts = np.zeros((len(lens), max(dim, lens.max(initial=0))), flat.dtype), np.cumsum(lens) - lens
        m[np.repeat(np.arange(len(lens)), lens), np.arange(len(flat)) - np.repeat(starts, lens)] = flat
    return m[:, :dim], np.isfinite(m).all(1) & (m != 0).any(1)


def _units(raw: np.ndarray) -> np.ndarray:
    m = raw.astype(float)
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products row by row; the same rows give the same bits, whatever stands beside them."""
    return (a * b).sum(1)


def _slack(dim: int) -> float:
    """More than single precision can take off an inner product of unit vectors."""
    return 2e-5 + 2e-7 * dim


def _homes(unit: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Each row's best cell, the first of equal ones; a function of the row alone, so copies meet."""
    s, every = unit.astype("f4") @ cells.astype("f4").T, np.arange(len(unit))
    home = s.argmax(1)
    top = s[every, home]
    s[every, home] = -np.inf
    close = np.flatnonzero(s.max(1) >= top - _slack(unit.shape[1]))
    s[every, home] = top
    r, c = np.nonzero(s[close] >= top[close, None] - _slack(unit.shape[1]))
    exact = _dots(unit[close[r]], cells[c])
    order = np.lexsort((c, -exact, r))
    home[close] = c[order][np.unique(r[order], return_index=True)[1]]
    return home


def screen_axes(sample: np.ndarray, threshold: float) -> np.ndarray:
    """Leading axes of the sample, as columns: as many as let one unlinked pair of it in 100,000 through `_screened`."""
    axes, some = np.linalg.eigh(sample.T @ sample)[1][:, ::-1], sample[:1024]
    unlinked = some @ some.T < threshold
    for p in range(8, sample.shape[1] - 8, 8):
        kept = _screened(some, axes[:, :p])
        if ((kept @ kept.T >= threshold) & unlinked).mean() <= 1e-5:
            return np.ascontiguousarray(axes[:, :p])
    return axes


def _screened(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Rows whose inner products bound those of the unit vectors from above: places on the axes, and the length of the rest."""
    lead = unit @ axes
    return np.hstack([lead, np.sqrt(np.maximum(0, 1 - (lead * lead).sum(1, keepdims=True)))]).astype("f4")


def _merge_classes(vh, rep: np.ndarray, w: np.ndarray):
    """(place of the first member, smallest rep, sum of w) of every class in vh."""
    code, names = pd.factorize(np.array(list(vh), dtype=object))
    first, least, total = np.full(len(names), len(code)), np.full(len(names), np.iinfo(np.int64).max), np.zeros(len(names), np.int64)
    np.minimum.at(first, code, np.arange(len(code)))
    np.minimum.at(least, code, rep)
    np.add.at(total, code, w)
    return first, least, total


def _components_of(m: np.ndarray, left: np.ndarray, right: np.ndarray):
    """Of a block's boolean links: (id, smallest id of its part of the block) for all ends but the smallest."""
    seen_l, seen_r, out = np.zeros(len(left), bool), np.zeros(len(right), bool), []
    for i in np.flatnonzero(m.any(1)):
        if seen_l[i]:
            continue
        in_l, in_r, front = np.zeros(len(left), bool), np.zeros(len(right), bool), np.array([i])
        in_l[i] = True
        while len(front):
            cols = np.flatnonzero(m[front].any(0) & ~in_r)
            in_r[cols] = True
            front = np.flatnonzero(m[:, cols].any(1) & ~in_l) if len(cols) else cols
            in_l[front] = True
        seen_l |= in_l
        seen_r |= in_r
        ids = np.unique(np.concatenate([left[in_l], right[in_r]]))
        out.append(np.stack([ids[1:], np.full(len(ids) - 1, ids[0])]))
    return np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)


class _Block:
    """Classes read from files of the shared folder, in the order of their cells."""

    def __init__(self, parts: list[tuple[int, str]], kind: str, cells: np.ndarray, axes: np.ndarray) -> None:
        read = []
        for start, path in parts:
            fs, at = pafs.FileSystem.from_uri(path)
            t = pq.read_table(at, filesystem=fs, use_threads=False).to_pandas()
            read.append(t.assign(at=np.arange(start, start + len(t))))
        t = pd.concat(read).sort_values("home", kind="stable")
        self.vh, self.rep, self.w, self.home, self.at = t["vh"].to_numpy(), t["rep"].to_numpy(), t["w"].to_numpy(float), t["home"].to_numpy(), t["at"].to_numpy()
        self.raw = np.frombuffer(b"".join(t["v"]), dtype=kind).reshape(len(t), -1)
        unit = _units(self.raw)
        self.single, self.screen, self.top = unit.astype("f4"), _screened(unit, axes), _dots(unit, cells[self.home]).astype("f4")

    def units(self, at: np.ndarray) -> np.ndarray:
        return _units(self.raw[at])


def _settle(left: _Block, p: np.ndarray, right: _Block, q: np.ndarray, cell: int, cells: np.ndarray, threshold: float):
    """Of natives p of the cell and its natives and guests q: the links that this cell counts, and which q are guests.

    A link of two cells is counted in the cell that its guest lies nearer to, the first one on a tie.
    """
    a, b, home = left.units(p), right.units(q), right.home[q]
    cos = a @ b.T
    i, j = np.nonzero(np.abs(cos - threshold) < 1e-9)
    cos[i, j] = _dots(a[i], b[j])
    m = (cos >= threshold) & (left.at[p][:, None] != right.at[q][None, :])
    for h in np.unique(home[m.any(0) & (home != cell)]):
        of = np.flatnonzero(home == h)
        far_l, far_r = _dots(a, cells[cell]) - _dots(a, cells[h]), _dots(b[of], cells[h]) - _dots(b[of], cells[cell])
        m[:, of] &= (far_r[None, :] < far_l[:, None]) | ((far_r[None, :] == far_l[:, None]) & (cell < h))
    return m, home != cell


def _compare(left: _Block, rights, cells: np.ndarray, threshold: float, native_block: int, guest_block: int):
    """(vh, rep, other, links) frames: degrees of the links of the natives in `left` with all of `rights`, and a spanning forest."""
    half, slack = math.sqrt(max(0.0, 2 - 2 * threshold)) / 2 + 1e-9, _slack(cells.shape[1])
    here, starts = np.unique(left.home, return_index=True)
    ends = np.append(starts[1:], len(left.home))
    centres = cells[here].astype("f4")
    reach = np.stack([half * np.linalg.norm(cells - c, axis=1) + slack for c in cells[here]]).astype("f4")
    forest, of_left, room = [], np.zeros(len(left.rep)), np.empty(native_block * guest_block, "f4")

    def degrees(block: _Block, links: np.ndarray) -> pd.DataFrame:
        on = links > 0
        return pd.DataFrame({"vh": block.vh[on], "rep": block.rep[on], "other": block.rep[on], "links": links[on].astype("int64")})

    for right in rights:
        of_right = np.zeros(len(right.rep))
        for lo in range(0, len(right.rep), guest_block):
            part = slice(lo, lo + guest_block)
            near = centres @ right.single[part].T >= right.top[part] - reach[:, right.home[part]]
            for x, cell in enumerate(here):
                g = lo + np.flatnonzero(near[x])
                guests = right.screen[g]
                for start in range(starts[x], ends[x], native_block) if len(g) else ():
                    mine = left.screen[start : min(start + native_block, ends[x])]
                    s = np.matmul(mine, guests.T, out=room[: len(mine) * len(g)].reshape(len(mine), len(g)))
                    cols = np.flatnonzero(s.max(0) >= threshold - slack)
                    if not len(cols):
                        continue
                    p, q = start + np.flatnonzero((s[:, cols] >= threshold - slack).any(1)), g[cols]
                    m, cross = _settle(left, p, right, q, cell, cells, threshold)
                    of_left[p] += m @ right.w[q]
                    of_right[q[cross]] += left.w[p] @ m[:, cross]
                    forest.append(_components_of(m, left.rep[p], right.rep[q]))
        yield degrees(right, of_right)
    yield degrees(left, of_left)
    found = np.concatenate(forest, axis=1) if forest else np.empty((2, 0), np.int64)
    ids, at = np.unique(found, return_inverse=True)
    at = at.reshape(2, -1)
    root = ids[merge_pairs(len(ids), at[0], at[1])]
    hung = ids != root
    yield pd.DataFrame({"vh": None, "rep": ids[hung], "other": root[hung], "links": 0})


def near_duplicate_vectors(df: DataFrame, threshold: float = 0.9, sample_rows: int = 8192, native_block: int = 2048, guest_block: int = 8192, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for the links with cosine >= threshold.

    Equal vectors are one class with a weight.  Spherical k-means, fitted on at most sample_rows vectors,
    gives cells; every class lives in the cell of its best centroid.  Two unit vectors with cosine >= t
    are at most r = sqrt(2 - 2t) apart, so if they live in cells a and b, one of them lies within r / 2 of
    the plane between a and b: every class is also a guest in the cells for which this holds.  So no link
    is lost (recall 1), and a link between cells is counted in one of them.

    Guests are never written: the classes lie once in the shared folder, in files of some guest_block rows
    in the order of their cells, as they came (in single precision if the column is).  A task reads a run of files as
    natives and passes over another run, picking the guests of each cell as it reads, native_block natives
    at once; a hot cell fills more files, not a larger task.  Bounds from the leading axes of the sample, in single
    precision with a margin, pick pairs; double precision decides.  Tasks give degrees and a spanning forest of their links, not the pairs;
    components follow by star rounds.

    Null, empty, zero vectors and those with null or non-finite components have no links and are kept.
    Shorter vectors count as padded with zeros.  Repeated rows: each is a vector, linked with its copies;
    rows that share an id are one node of the graph.  No rows: no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("e"))
    kind = "<f4" if rows.schema["e"].dataType.elementType == T.FloatType() else "<f8"
    rows = rows.withColumn("e", F.col("e").cast("array<float>" if kind == "<f4" else "array<double>"))
    good = usable("e") & F.exists("e", lambda x: x != 0)
    n, dim, distinct = rows.filter(good).agg(F.count("*"), F.max(F.size("e")), F.approx_count_distinct(F.xxhash64("e"))).first()
    if not n:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    share = min(1.0, sample_rows / distinct)
    drawn = rows.select(F.xxhash64("e").alias("h"), "e").filter(F.col("h") <= min(2**63 - 1, int(share * 2.0**64) - 2**63))
    sample = drawn.filter(good).dropDuplicates(["h"]).orderBy("h").limit(sample_rows).toPandas()["e"]
    if not len(sample):
        sample = rows.filter(good).select("e").limit(1).toPandas()["e"]
    sample = _units(_pack(list(sample), dim))
    cells, axes = fit_cells(sample, k=min(4096, max(8, distinct // 256))), screen_axes(sample, threshold)

    def named(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 4096):
                p = b.slice(lo, 4096)
                raw, ok = _dense(p.column(1), dim)
                raw = raw[ok].astype(kind)
                unit = _units(raw)
                yield p.column(0), ok, raw, unit, [hashlib.md5(x.tobytes()).digest() for x in unit]

    def place(batches):
        for ids, ok, raw, unit, vh in named(batches):
            first, rep, w = _merge_classes(vh, ids.fill_null(2**63 - 1).to_numpy()[ok], np.ones(len(vh), np.int64))
            home = _homes(unit[first], cells).astype("int32")
            yield pa.RecordBatch.from_arrays([pa.array(home), pa.array([vh[i] for i in first], pa.binary()), pa.array(rep), pa.array(w), pa.array([raw[i].tobytes() for i in first], pa.binary())], ["home", "vh", "rep", "w", "v"])

    def names(batches):
        for ids, ok, _, _, vh in named(batches):
            of_all = np.full(len(ok), None, dtype=object)
            of_all[ok] = vh
            yield pa.RecordBatch.from_arrays([ids, pa.array(of_all, pa.binary())], ["vec_id", "vh"])

    def join_classes(batches):
        whole = list(batches)
        if whole:
            t = pd.concat(whole, ignore_index=True)
            first, rep, w = _merge_classes(t["vh"], t["rep"].to_numpy(), t["w"].to_numpy())
            yield t.iloc[first].assign(rep=rep, w=w).sort_values("home", kind="stable")

    columns = "home int, vh binary, rep long, w long, v binary"
    dealt = rows.mapInArrow(place, columns).repartitionByRange(max(1, -(-distinct // guest_block)), "home", "vh")
    placed = materialize(dealt.mapInPandas(join_classes, columns), "vec")
    files = placed.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min("home").alias("a"), F.max("home").alias("b"), F.count("*").alias("n")).orderBy("a", "b", "path").collect()
    blocks, start = [], 0
    for f in files:
        part = (start, f"{placed._linkmosaic_path}/{f['path'].rsplit('/', 1)[1]}")
        if blocks and start + f["n"] - blocks[-1][0][0] <= guest_block:
            blocks[-1].append(part)
        else:
            blocks.append([part])
        start += f["n"]
    run = min(8, max(1, len(blocks) // 8))
    runs = [blocks[i : i + run] for i in range(0, len(blocks), run)]

    def compare(batches):
        for t in (x for b in batches for x in b["id"]):
            i, j = divmod(int(t), len(runs))
            left = _Block([part for block in runs[i] for part in block], kind, cells, axes)
            yield from _compare(left, (_Block(block, kind, cells, axes) for block in runs[j]), cells, threshold, native_block, guest_block)

    tasks = df.sparkSession.range(0, len(runs) ** 2, 1, min(4096, len(runs) ** 2))
    found = materialize(tasks.mapInPandas(compare, "vh binary, rep long, other long, links long"), "vec")
    links = found.filter("vh is not null").groupBy("vh").agg(F.sum("links").alias("links"))
    parts = connected_components(found.filter("rep <> other").select(F.col("rep").alias("u"), F.col("other").alias("v")))
    per_class = placed.select("vh", "rep", "w").join(links, "vh", "left").join(parts.withColumnRenamed("id", "rep"), "rep", "left").filter("w > 1 or links is not null or component is not null")
    per_class = per_class.select("vh", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    linked = rows.mapInArrow(names, "vec_id long, vh binary").join(per_class, "vh", "left")
    linked = linked.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return linked.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_cell_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_NEAR = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as u, b.vec_id as v from v a join v b on a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as id, vec_id as c from embeddings union select l.v, r.c from r join l on l.u = r.id where r.c < l.v),
m as (select id, min(c) as c from r group by id),
d as (select u, count(*) as n from l group by u)
select e.vec_id, coalesce(d.n, 0) as n_links, m.c as component_id, e.vec_id = m.c as kept from embeddings e join m on m.id = e.vec_id left join d on d.u = e.vec_id"""
