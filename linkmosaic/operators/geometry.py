"""Planar geometry in numpy: areas, distances, buffers, and overlays by slabs.

A polygon is a list of rings, each an array of (x, y) without a repeated last point needed; inside is by
parity, so holes are rings as any.  An overlay is a list of trapezoids: (y0, left0, right0, y1, left1, right1).
"""

from __future__ import annotations

import heapq
import math

import numpy as np

QUADRANT = 16  # segments of a quarter circle in buffers
TINY = 1e-9


def rings(geom) -> list[np.ndarray]:
    out = []
    for ring in geom:
        p = np.array([list(x) for x in ring], dtype=float).reshape(-1, 2)
        if len(p) > 1 and (p[0] == p[-1]).all():
            p = p[:-1]
        out.append(p)
    return out


def edges(geom: list[np.ndarray]) -> np.ndarray:
    """(n, 4): x0, y0, x1, y1 of all sides."""
    parts = [np.concatenate([p, np.roll(p, -1, axis=0)], axis=1) for p in geom if len(p) > 1]
    return np.concatenate(parts) if parts else np.empty((0, 4))


def signed_area(p: np.ndarray) -> float:
    x, y = p[:, 0], p[:, 1]
    return float((x * np.roll(y, -1) - np.roll(x, -1) * y).sum() / 2)


def area(geom: list[np.ndarray]) -> float:
    """Area by parity for rings that do not cross: the outer ring less the holes."""
    sizes = sorted((abs(signed_area(p)) for p in geom if len(p) > 2), reverse=True)
    return sizes[0] - sum(sizes[1:]) if sizes else 0.0


def perimeter(geom: list[np.ndarray]) -> float:
    e = edges(geom)
    return float(np.hypot(e[:, 2] - e[:, 0], e[:, 3] - e[:, 1]).sum())


def centroid(geom: list[np.ndarray]) -> tuple[float, float]:
    total, sx, sy = 0.0, 0.0, 0.0
    for i, p in enumerate(sorted((p for p in geom if len(p) > 2), key=lambda p: -abs(signed_area(p)))):
        x, y = p[:, 0], p[:, 1]
        cross = x * np.roll(y, -1) - np.roll(x, -1) * y
        a = cross.sum() / 2
        sign = (1 if i == 0 else -1) * (1 if a >= 0 else -1)
        total += sign * a
        sx += sign * ((x + np.roll(x, -1)) * cross).sum() / 6
        sy += sign * ((y + np.roll(y, -1)) * cross).sum() / 6
    if abs(total) < 1e-300:
        q = np.concatenate(geom)
        return float(q[:, 0].mean()), float(q[:, 1].mean())
    return float(sx / total), float(sy / total)


def contains(geom: list[np.ndarray], points: np.ndarray) -> np.ndarray:
    """Whether points lie inside, by the parity of crossings to the right."""
    e = edges(geom)
    x, y = points[:, 0][:, None], points[:, 1][:, None]
    up = (e[:, 1] > y) != (e[:, 3] > y)
    with np.errstate(divide="ignore", invalid="ignore"):
        at = e[:, 0] + (y - e[:, 1]) / (e[:, 3] - e[:, 1]) * (e[:, 2] - e[:, 0])
    return (up & (x < at)).sum(axis=1) % 2 == 1


def _closest_on(p: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = e[:, 2:] - e[:, :2]
    size = np.maximum((d * d).sum(1), 1e-300)
    t = np.clip(((p[:, None, :] - e[None, :, :2]) * d).sum(2) / size, 0, 1)
    q = e[None, :, :2] + t[..., None] * d
    return np.hypot(*(q - p[:, None, :]).transpose(2, 0, 1)), q


def _crossing(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """A place where sides of a and b cross, if any."""
    if not len(a) or not len(b):
        return None
    d1, d2 = a[:, 2:] - a[:, :2], b[:, 2:] - b[:, :2]
    den = d1[:, None, 0] * d2[None, :, 1] - d1[:, None, 1] * d2[None, :, 0]
    gap = b[None, :, :2] - a[:, None, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = (gap[..., 0] * d2[None, :, 1] - gap[..., 1] * d2[None, :, 0]) / den
        u = (gap[..., 0] * d1[:, None, 1] - gap[..., 1] * d1[:, None, 0]) / den
    hit = np.argwhere((t >= 0) & (t <= 1) & (u >= 0) & (u <= 1) & (den != 0))
    if not len(hit):
        return None
    i, j = hit[0]
    return a[i, :2] + t[i, j] * d1[i]


def nearest(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[float, np.ndarray, np.ndarray]:
    """Distance of two polygons and the places on each: 0 where they touch or one holds the other."""
    ea, eb = edges(a), edges(b)
    at = _crossing(ea, eb)
    if at is not None:
        return 0.0, at, at
    for p, q in ((ea, b), (eb, a)):
        if len(p) and contains(q, p[:1, :2])[0]:
            return 0.0, p[0, :2], p[0, :2]
    d1, q1 = _closest_on(ea[:, :2], eb)
    d2, q2 = _closest_on(eb[:, :2], ea)
    i, j = np.unravel_index(d1.argmin(), d1.shape)
    k, m = np.unravel_index(d2.argmin(), d2.shape)
    if d1[i, j] <= d2[k, m]:
        return float(d1[i, j]), ea[i, :2], q1[i, j]
    return float(d2[k, m]), q2[k, m], eb[k, :2]


def lines_apart(a: np.ndarray, b: np.ndarray) -> float:
    """Distance of two open lines of points."""
    ea, eb = (np.concatenate([p[:-1], p[1:]], axis=1) if len(p) > 1 else np.concatenate([p, p], axis=1) for p in (a, b))
    if _crossing(ea, eb) is not None:
        return 0.0
    return float(min(_closest_on(a, eb)[0].min(), _closest_on(b, ea)[0].min()))


def box(geom: list[np.ndarray]) -> tuple[float, float, float, float]:
    p = np.concatenate(geom)
    return float(p[:, 0].min()), float(p[:, 1].min()), float(p[:, 0].max()), float(p[:, 1].max())


def is_valid(geom: list[np.ndarray]) -> bool:
    """Rings of three points or more with an area, whose sides meet at their ends alone."""
    for p in geom:
        if len(p) < 3 or abs(signed_area(p)) < 1e-15:
            return False
        e = edges([p])
        for i in range(len(e)):
            rest = [j for j in range(len(e)) if j not in (i, (i + 1) % len(e), (i - 1) % len(e))]
            if rest and _crossing(e[i : i + 1], e[rest]) is not None:
                return False
    return True


def buffer_line(line: np.ndarray, radius: float) -> list[list[np.ndarray]]:
    """Polygons whose union is the line widened by a radius: a rectangle a segment, a polygonal disc a point."""
    turn = np.arange(4 * QUADRANT) * (math.pi / 2 / QUADRANT)
    disc = radius * np.stack([np.cos(turn), np.sin(turn)], axis=1)
    out = [[disc + p] for p in line]
    for a, b in zip(line[:-1], line[1:], strict=True):
        d = b - a
        size = math.hypot(*d)
        if size > 0:
            n = np.array([-d[1], d[0]]) / size * radius
            out.append([np.array([a + n, b + n, b - n, a - n])])
    return out


def overlay(take: list[list[np.ndarray]], drop: list[list[np.ndarray]] = (), both: list[list[np.ndarray]] | None = None) -> list[tuple]:
    """The union of `take` without `drop`, and within `both` if given, as trapezoids.

    All sides are cut where they cross; between two neighbouring heights no two sides cross, so a walk
    from left to right knows which polygons it is in.
    """
    groups = [(0, g) for g in take] + [(1, g) for g in drop] + [(2, g) for g in (both or [])]
    if not take:
        return []
    sides, owner, kind = [], [], []
    for i, (k, g) in enumerate(groups):
        e = edges(g)
        e = e[np.abs(e[:, 1] - e[:, 3]) > 1e-12]
        sides.append(e)
        owner += [i] * len(e)
        kind.append(k)
    e = np.concatenate(sides)
    if not len(e):
        return []
    owner = np.array(owner)
    e = np.where((e[:, 1] > e[:, 3])[:, None], e[:, [2, 3, 0, 1]], e)
    slope = (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1])
    base = e[:, 0] - slope * e[:, 1]
    ys = np.unique(np.concatenate([e[:, 1], e[:, 3], *_cuts(e, slope, base)]))
    ys = ys[np.r_[True, np.diff(ys) > TINY]]
    out: list[tuple] = []
    rows = max(1, 1_000_000 // (len(e) + len(groups)))
    for lo in range(0, len(ys) - 1, rows):
        out += _walk(e, slope, base, owner, np.array(kind), ys[lo : lo + rows + 1], both is not None)
    return out


def _cuts(e: np.ndarray, slope: np.ndarray, base: np.ndarray) -> list[np.ndarray]:
    """Heights at which sides cross; so many sides at a time that the table of pairs stays small."""
    out, step = [], max(1, 1_000_000 // len(e))
    for lo in range(0, len(e), step):
        hi = min(lo + step, len(e))
        den = slope[lo:hi, None] - slope[None, lo:]
        with np.errstate(divide="ignore", invalid="ignore"):
            y = (base[None, lo:] - base[lo:hi, None]) / den
        least, most = np.maximum(e[lo:hi, 1, None], e[None, lo:, 1]), np.minimum(e[lo:hi, 3, None], e[None, lo:, 3])
        out.append(y[(den != 0) & (y > least) & (y < most)])
    return out


def _walk(e: np.ndarray, slope: np.ndarray, base: np.ndarray, owner: np.ndarray, kind: np.ndarray, ys: np.ndarray, within: bool) -> list[tuple]:
    """The trapezoids between neighbouring heights: all levels step over their sides from left to right together."""
    mid = (ys[:-1] + ys[1:]) / 2
    here = (e[None, :, 1] <= mid[:, None]) & (e[None, :, 3] >= mid[:, None])
    count = here.sum(axis=1)
    order = np.argsort(np.where(here, base + slope * mid[:, None], np.inf), axis=1, kind="stable")
    inside, n = np.zeros((len(mid), len(kind)), bool), np.zeros((len(mid), 3), int)
    start, all_rows, found = np.full(len(mid), -1), np.arange(len(mid)), []
    for place in range(int(count.max(initial=0))):
        rows = all_rows[place < count]
        side = order[rows, place]
        who = owner[side]
        n[rows, kind[who]] += np.where(inside[rows, who], -1, 1)
        inside[rows, who] ^= True
        on = (n[rows, 0] > 0) & (n[rows, 1] == 0) & ((n[rows, 2] > 0) | (not within))
        ends = ~on & (start[rows] >= 0)
        found.append((rows[ends], start[rows[ends]], side[ends]))
        start[rows] = np.where(on, np.where(start[rows] < 0, side, start[rows]), -1)
    if not found:
        return []
    k, a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    y0, y1 = ys[k], ys[k + 1]
    x = np.stack([base[a] + slope[a] * y0, base[b] + slope[b] * y0, base[a] + slope[a] * y1, base[b] + slope[b] * y1])
    wide = (x[1] - x[0] + x[3] - x[2]) * (y1 - y0) / 2 > 1e-12
    first = np.lexsort((x[0], y0))
    first = first[wide[first]]
    return list(map(tuple, np.stack([y0, x[0], x[1], y1, x[2], x[3]], axis=1)[first].tolist()))


def slabs_area(slabs: list[tuple]) -> float:
    return sum((b - a + d - c) * (y1 - y0) / 2 for y0, a, b, y1, c, d in slabs)


def slabs_parts(slabs: list[tuple]) -> list[list[tuple]]:
    """Connected parts: trapezoids that share a piece of a level line belong together."""
    by_bottom: dict[float, list[int]] = {}
    for i, s in enumerate(slabs):
        by_bottom.setdefault(s[0], []).append(i)
    part = list(range(len(slabs)))

    def find(i: int) -> int:
        while part[i] != i:
            part[i] = part[part[i]]
            i = part[i]
        return i

    levels = sorted(by_bottom)
    for i, s in enumerate(slabs):
        k = np.searchsorted(levels, s[3] - 2 * TINY)
        while k < len(levels) and levels[k] <= s[3] + 2 * TINY:
            for j in by_bottom[levels[k]]:
                if min(s[5], slabs[j][2]) - max(s[4], slabs[j][1]) > TINY:
                    part[find(i)] = find(j)
            k += 1
    out: dict[int, list[tuple]] = {}
    for i, s in enumerate(slabs):
        out.setdefault(find(i), []).append(s)
    return list(out.values())


def slabs_polygons(slabs: list[tuple]) -> list[list[np.ndarray]]:
    return [[np.array([(a, y0), (b, y0), (d, y1), (c, y1)])] for y0, a, b, y1, c, d in slabs]


def outline(slabs: list[tuple]) -> list[np.ndarray]:
    """Rings around touching trapezoids, the inside to their left: outer rings run against the clock, holes with it."""
    key = lambda x, y: (round(x, 6), round(y, 6))
    runs: list[tuple] = []
    levels: dict[float, list[tuple[float, float, int]]] = {}
    for y0, a, b, y1, c, d in slabs:
        runs += [((b, y0), (d, y1)), ((c, y1), (a, y0))]
        levels.setdefault(round(y0, 6), []).append((a, b, 1))
        levels.setdefault(round(y1, 6), []).append((c, d, -1))
    for y, spans in levels.items():
        xs = sorted({round(x, 6) for a, b, _ in spans for x in (a, b)})
        for p, q in zip(xs[:-1], xs[1:], strict=True):
            over = sum(side for a, b, side in spans if round(a, 6) <= p and q <= round(b, 6))
            if over:
                runs.append(((p, y), (q, y)) if over > 0 else ((q, y), (p, y)))
    leads: dict[tuple, list[tuple]] = {}
    for p, q in runs:
        if key(*p) != key(*q):
            leads.setdefault(key(*p), []).append(key(*q))
    rings_out = []
    while leads:
        first = at = next(iter(leads))
        ring = []
        while at in leads:
            ring.append(at)
            to = leads[at].pop()
            if not leads[at]:
                del leads[at]
            at = to
            if at == first:
                break
        p = np.array(ring)
        turn = np.cross(p - np.roll(p, 1, axis=0), np.roll(p, -1, axis=0) - p) if len(p) > 2 else np.zeros(len(p))
        p = p[np.abs(turn) > 1e-9]
        if len(p) > 2:
            rings_out.append(p)
    return sorted(rings_out, key=lambda p: -abs(signed_area(p)))


def repair(geom: list[np.ndarray]) -> list[list[np.ndarray]]:
    """A polygon whose sides cross, by parity: the parts of its inside as polygons that touch at most."""
    return slabs_polygons(overlay([geom]))


def overlap_ratio(a: list[tuple], b: list[tuple], near: float = 0.0) -> float:
    """Shared area over the smaller area; 1 for an empty one, and for two within `near`."""
    pa, pb = slabs_polygons(a), slabs_polygons(b)
    if not pa or not pb:
        return 1.0
    if near > 0 and min(nearest(x, y)[0] for x in pa for y in pb) <= near:
        return 1.0
    return slabs_area(overlay(pa, both=pb)) / min(slabs_area(a), slabs_area(b))


def least_cost_line(start, goal, extent: tuple[float, float, float, float], res: float, walls: list[list[np.ndarray]], clear: float) -> np.ndarray | None:
    """Cheapest way on a grid around walls kept at a distance; its ends are the places given; None if there is none."""
    x0, y0, x1, y1 = extent
    nx, ny = max(2, math.ceil((x1 - x0) / res)), max(2, math.ceil((y1 - y0) / res))
    gx, gy = x0 + (np.arange(nx) + 0.5) * res, y0 + (np.arange(ny) + 0.5) * res
    points = np.stack(np.meshgrid(gx, gy), axis=2).reshape(-1, 2)
    shut = np.zeros(len(points), bool)
    for w in walls:
        a, b, c, d = box(w)
        close = np.flatnonzero((points[:, 0] >= a - clear) & (points[:, 0] <= c + clear) & (points[:, 1] >= b - clear) & (points[:, 1] <= d + clear))
        for lo in range(0, len(close), 20_000):
            part = close[lo : lo + 20_000]
            shut[part] |= contains(w, points[part]) | (_closest_on(points[part], edges(w))[0].min(axis=1) <= clear)
    shut = shut.reshape(ny, nx)
    at = lambda p: (min(max(int((p[1] - y0) / res), 0), ny - 1), min(max(int((p[0] - x0) / res), 0), nx - 1))
    a, b = at(start), at(goal)
    if shut[a] or shut[b]:
        return None
    best, came, heap = {a: 0.0}, {}, [(0.0, a)]
    while heap:
        d, k = heapq.heappop(heap)
        if k == b:
            break
        if d > best[k]:
            continue
        for dr in (-1, 0, 1):
            for dc in (-1, 0, 1):
                n = (k[0] + dr, k[1] + dc)
                if (dr or dc) and 0 <= n[0] < ny and 0 <= n[1] < nx and not shut[n]:
                    now = d + (math.sqrt(2) if dr and dc else 1.0)
                    if now < best.get(n, math.inf):
                        best[n], came[n] = now, k
                        heapq.heappush(heap, (now, n))
    if b not in best:
        return None
    way = [b]
    while way[-1] in came:
        way.append(came[way[-1]])
    way = way[::-1]
    bends = [way[0]] + [k for p, k, n in zip(way, way[1:], way[2:], strict=False) if (k[0] - p[0], k[1] - p[1]) != (n[0] - k[0], n[1] - k[1])] + [way[-1]]
    line = np.array([(gx[c], gy[r]) for r, c in bends])
    return np.concatenate([[start], line, [goal]])
