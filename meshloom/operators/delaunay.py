"""Delaunay triangulation of one sample's points: incremental insertion with a vertex at infinity.

Orientation and circle tests are floating-point with an error bound, and exact rational below it. Four points on one circle
get either diagonal. Exact copies of a point stay out of the mesh.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np

GHOST = -1


def orient(a, b, c) -> float:
    """Positive if a, b, c turn to the left; zero only if they are on one line."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    det = left - right
    if abs(det) > 4e-16 * (abs(left) + abs(right)):
        return det
    (ax, ay), (bx, by), (cx, cy) = ((Fraction(p[0]), Fraction(p[1])) for p in (a, b, c))
    exact = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (exact > 0) - (exact < 0)


def in_circle(a, b, c, d) -> float:
    """Positive if d is inside the circle through a, b, c, which turn to the left."""
    rows = [(p[0] - d[0], p[1] - d[1]) for p in (a, b, c)]
    lift = [x * x + y * y for x, y in rows]
    minors = [(rows[1][0] * rows[2][1], rows[2][0] * rows[1][1]), (rows[2][0] * rows[0][1], rows[0][0] * rows[2][1]), (rows[0][0] * rows[1][1], rows[1][0] * rows[0][1])]
    det = sum(z * (p - q) for z, (p, q) in zip(lift, minors, strict=True))
    if abs(det) > 2e-15 * sum(z * (abs(p) + abs(q)) for z, (p, q) in zip(lift, minors, strict=True)):
        return det
    rows = [(Fraction(p[0]) - Fraction(d[0]), Fraction(p[1]) - Fraction(d[1])) for p in (a, b, c)]
    (ax, ay), (bx, by), (cx, cy) = rows
    exact = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
    return (exact > 0) - (exact < 0)


def triangulate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Index triples, each ascending, in ascending order; none for fewer than three points off one line."""
    pts = list(zip(x.tolist(), y.tolist(), strict=True))
    first: dict[tuple, int] = {}
    for i, p in enumerate(pts):
        first.setdefault(p, i)
    ids = list(first.values())
    if len(ids) < 3:
        return np.empty((0, 3), np.int64)
    side = max(1, int((len(ids) / 2) ** 0.5))
    low, high = np.min([pts[i] for i in ids], axis=0), np.max([pts[i] for i in ids], axis=0)
    strip = {i: min(side - 1, int((pts[i][0] - low[0]) / max(high[0] - low[0], 1e-300) * side)) for i in ids}
    ids.sort(key=lambda i: (strip[i], pts[i][1] if strip[i] % 2 else -pts[i][1], i))  # up and down in strips: walks are short
    a, b = ids[0], ids[1]
    c = next((i for i in ids[2:] if orient(pts[a], pts[b], pts[i])), None)
    if c is None:
        return np.empty((0, 3), np.int64)
    if orient(pts[a], pts[b], pts[c]) < 0:
        a, b = b, a
    apex: dict[tuple[int, int], int] = {}  # the third corner to the left of a directed edge

    def put(u, v, w):
        apex[u, v], apex[v, w], apex[w, u] = w, u, v

    put(a, b, c)
    for u, v in ((b, a), (c, b), (a, c)):
        put(u, v, GHOST)

    def conflicts(u, v, w, p):
        if GHOST in (u, v, w):
            while w != GHOST:
                u, v, w = v, w, u
            turn = orient(pts[u], pts[v], p)
            if turn:
                return turn > 0
            return min(pts[u], pts[v]) < p < max(pts[u], pts[v])
        return in_circle(pts[u], pts[v], pts[w], p) > 0

    edge = (a, b)
    for i in ids:
        if i in (a, b, c):
            continue
        p = pts[i]
        u, v = edge
        w = apex[u, v]
        while GHOST not in (u, v, w):
            for s, t in ((u, v), (v, w), (w, u)):
                if orient(pts[s], pts[t], p) < 0:
                    u, v = t, s
                    w = apex[u, v]
                    break
            else:
                break
        hull, todo = [], [(u, v, w)]
        for s, t in ((u, v), (v, w), (w, u)):
            del apex[s, t]
        while todo:
            for s, t in _sides(todo.pop()):
                r = apex.get((t, s))
                if r is None:
                    continue
                if conflicts(t, s, r, p):
                    for e in ((t, s), (s, r), (r, t)):
                        del apex[e]
                    todo.append((t, s, r))
                else:
                    hull.append((s, t))
        for s, t in hull:
            put(s, t, i)
        edge = next((s, t) for s, t in hull if GHOST not in (s, t))
    faces = {tuple(sorted((u, v, w))) for (u, v), w in apex.items() if GHOST not in (u, v, w)}
    return np.array(sorted(faces), np.int64).reshape(-1, 3)


def _sides(face):
    u, v, w = face
    return (u, v), (v, w), (w, u)
