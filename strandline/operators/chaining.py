"""Kernels on the anchors of one query and one genome, for grouped functions. An anchor is (q, t, length), begins from 0.

Groups stay small: anchors reach these kernels after seed matching by (query, genome), and nested ones are dropped first.
"""

from __future__ import annotations

import numpy as np


def clear_nested(anchors: np.ndarray, k: int) -> np.ndarray:
    """Anchors in order of query begin, longer first; dropped: those that an earlier anchor near enough holds on query and target."""
    if not len(anchors):
        return anchors
    a = anchors[np.lexsort((anchors[:, 1], -(anchors[:, 0] + anchors[:, 2]), anchors[:, 0]))]
    qe, te = a[:, 0] + a[:, 2], a[:, 1] + a[:, 2]
    keep = np.ones(len(a), bool)
    for i in range(1, len(a)):
        low = np.searchsorted(a[:i, 0], max(qe[i] - k, 0))
        held = (qe[low:i] >= qe[i]) & (a[low:i, 1] <= a[i, 1]) & (te[low:i] >= te[i])
        keep[i] = not held.any()
    return a[keep]


def _weights(n: np.ndarray) -> np.ndarray:
    n = n.astype(np.float32)
    return np.float32(0.1) * n * n


def _gap_costs(g: np.ndarray) -> np.ndarray:
    return np.where(g == 0, 0, 0.1 * g + 0.5 * np.log2(np.maximum(g, 1))).astype(np.float32)


def chain(anchors: np.ndarray, max_gap: int = 50, max_distance: int = 1000, min_score: float = 28.9, top: int | None = None) -> list[tuple[list[int], float]]:
    """Chains of anchors in clear_nested() order, best first, with scores in single precision. Directions on the target must agree."""
    n = len(anchors)
    if n == 0:
        return []
    q, t, size = (anchors[:, c].astype(np.int64) for c in range(3))
    score, prev, way = _weights(size), list(range(n)), np.zeros(n, np.int64)
    own = score.copy()
    limit = np.float32(min_score)
    if n == 1:
        return [([0], float(score[0]))] if score[0] >= limit else []
    first = np.searchsorted(q, q - max_distance)
    for i in range(1, n):
        j = np.arange(i - 1, first[i] - 1, -1)
        if not len(j):
            continue
        ahead = t[i] >= t[j]
        dt = np.where(ahead, t[i] - t[j], np.abs(t[i] + size[i] - t[j] - size[j]))
        gap = np.abs(q[i] - q[j] - dt)
        keep = (np.abs(t[i] - t[j]) <= max_distance) & (q[i] != q[j]) & (t[i] != t[j]) & (gap <= max_gap)
        j, gap, d = j[keep], gap[keep], np.where(ahead[keep], 1, -1)
        if not len(j):
            continue
        beyond = _weights(q[i] + size[i] - q[j] - size[j])
        w = np.where(q[i] > q[j] + size[j], own[i], np.where(gap == 0, _weights(q[i] + size[i] - q[j]) - own[j], beyond))
        s = np.where((way[j] == 0) | (way[j] == d), score[j], own[j]) + w - _gap_costs(gap)
        top_at = int(np.argmax(s))  # the nearest of equal ones
        if s[top_at] >= limit and s[top_at] > score[i]:
            score[i], prev[i], way[i] = s[top_at], int(j[top_at]), d[top_at]
    score, way = list(score), way.tolist()
    used, out, tries = [False] * n, [], 0
    for i in sorted(range(n), key=lambda k: (-score[k], k)):
        if score[i] < limit or (top is not None and tries >= top):
            break
        if used[i]:
            continue
        tries += 1
        path, k, good = [i], i, True
        while prev[k] != k:
            j = prev[k]
            turn = way[j] not in (0, way[k])
            if used[j] and not turn:
                good = False
                break
            path.append(j)
            if turn:
                break
            k = j
        if not good:
            used[i] = True
            continue
        for k in path:
            used[k] = True
        out.append((path[::-1], float(score[i])))
    return out


def chain_regions(anchors: np.ndarray, max_gap: int = 20, band_bases: int = 100, band_count: int = 50, min_score: float = 35, min_length: int = 50, min_identity: float = 15) -> list[tuple[int, int, int, int, int]]:
    """Regions (qb, qe, tb, te, matched), ends exclusive: the best banded chain, then those right and left of it in turn."""
    n = len(anchors)
    if not n:
        return []
    q, t, size = (anchors[:, c].astype(int).tolist() for c in range(3))
    score, prev = [float(x) for x in size], list(range(n))
    for i in range(1, n):
        for j in range(i - 1, -1, -1):
            if q[i] - q[j] - size[j] > band_bases and i - j > band_count:
                break
            if q[i] == q[j] or t[j] > t[i]:
                continue
            gap = abs((q[i] - q[j]) - (t[i] - t[j]))
            if gap <= max_gap and score[j] + size[j] - gap >= score[i]:
                score[i], prev[i] = score[j] + size[j] - gap, j
    out, todo = [], [(0, n)]
    while todo:
        low, high = todo.pop()
        if low >= high:
            continue
        top = max(range(low, high), key=lambda k: (score[k], -k))
        if score[top] < min_score:
            continue
        path, k = [top], top
        while prev[k] != k and prev[k] >= low:
            k = prev[k]
            path.append(k)
        path.reverse()
        matched, reach = 0, -1
        for k in path:
            matched += max(0, q[k] + size[k] - max(q[k], reach))
            reach = max(reach, q[k] + size[k])
        qb, tb, qe, te = q[path[0]], t[path[0]], reach, max(t[k] + size[k] for k in path)
        if qe - qb >= min_length and matched / max(qe - qb, te - tb) * 100 >= min_identity:
            out.append((qb, qe, tb, te, matched))
        todo += [(low, path[0]), (top + 1, high)]
    return sorted(out)


def reach(q: str, t: str, max_distance: int = 10, max_gap: int = 5) -> tuple[int, int]:
    """How far an alignment that ends before q and t goes on: (bases of q, bases of t), along the best chain of shared 2-mers from their begin.
    A 2-mer adds two, less the distance and the gap to the one before it; a chain must come to one or more."""
    ends: dict[str, list[int]] = {}
    for j in range(len(t) - 1):
        ends.setdefault(t[j : j + 2], []).append(j)
    rows: list[dict[int, int]] = []
    best, end = 0, (0, 0)
    for i in range(len(q) - 1):
        row = {}
        for j in ends.get(q[i : i + 2], ()):
            score = 2 - max(i, j) - abs(i - j) if max(i, j) <= max_distance and abs(i - j) <= max_gap else None
            for back in range(1, min(i, max_distance) + 1):
                for other, s in rows[i - back].items():
                    ahead = j - other
                    if 0 < ahead <= max_distance and abs(ahead - back) <= max_gap and (score is None or s + 2 - max(ahead, back) - abs(ahead - back) > score):
                        score = s + 2 - max(ahead, back) - abs(ahead - back)
            if score is not None:
                row[j] = score
                if score > best:
                    best, end = score, (i + 2, j + 2)
        rows.append(row)
    return end


def extended(q: str, t: str, region: tuple[int, int, int, int], base: int = 50) -> tuple[int, int, int, int]:
    """A region (qb, qe, tb, te) with both ends moved outward by reach(), within base bases and some more for long regions."""
    qb, qe, tb, te = region
    most = base + next((more for size, more in ((1_000_000, 80), (250_000, 40), (50_000, 20), (10_000, 10)) if qe - qb > size), 0)
    if len(q) - qe > 2 and len(t) - te > 2:
        dq, dt = reach(q[qe : qe + most], t[te : te + most])
        qe, te = qe + dq, te + dt
    if qb > 2 and tb > 2:
        dq, dt = reach(q[max(0, qb - most) : qb][::-1], t[max(0, tb - most) : tb][::-1])
        qb, tb = qb - dq, tb - dt
    return qb, qe, tb, te


def align(q: str, t: str, mismatch: int = 4, gap_open: int = 6, gap_extend: int = 2, band: int = 64) -> tuple[str, int, int, int]:
    """Global gap-affine alignment in a band around the corners' diagonals: CIGAR (=, X, I on the query, D), matches, gap bases, gap openings."""
    n, m = len(q), len(t)
    if not n or not m:
        return (f"{n}I" if n else f"{m}D" if m else ""), 0, n + m, int(n + m > 0)
    low, high = min(0, m - n) - band, max(0, m - n) + band
    width, far = high - low + 1, np.int32(1 << 29)
    a, b = np.frombuffer(q.encode(), np.uint8), np.frombuffer(t.encode(), np.uint8)
    h, up = np.full(width + 1, far, np.int32), np.full(width + 1, far, np.int32)
    trace = np.zeros((n + 1, width), np.uint8)  # 2 bits: 0 diagonal, 1 query only, 2 target only; 4: query gap goes on; 8: target gap goes on
    diag = np.arange(low, high + 1)
    j0 = diag.copy()
    ok = (j0 >= 0) & (j0 <= m)
    h[:-1][ok] = np.where(j0[ok] > 0, gap_open + gap_extend * j0[ok], 0)
    trace[0][ok & (j0 > 0)] = 2 | 8
    steps = np.arange(width) * gap_extend
    for i in range(1, n + 1):
        j = diag + i
        ok = (j >= 0) & (j <= m)
        c = np.full(width, far, np.int32)
        inner = ok & (j > 0)
        c[inner] = h[:-1][inner] + np.where(b[j[inner] - 1] == a[i - 1], 0, mismatch)
        fresh, more = h[1:] + gap_open + gap_extend, up[1:] + gap_extend
        going = more < fresh
        e = np.where(going, more, fresh)
        best = np.minimum(c, e)
        # A gap on the target side: the least of best[k] + open + extend * (x - k) over k < x, by a running minimum.
        run = np.minimum.accumulate(best - steps)
        f = np.full(width, far, np.int32)
        f[1:] = run[:-1] + gap_open + steps[1:]
        new = np.minimum(best, f)
        new[~ok] = far
        tr = np.where(new == c, 0, np.where(new == e, 1, 2)).astype(np.uint8)
        tr |= np.where(going, 4, 0).astype(np.uint8)
        onward = np.zeros(width, bool)
        onward[1:] = f[1:] == f[:-1] + gap_extend
        tr |= np.where(onward, 8, 0).astype(np.uint8)
        trace[i] = tr
        h = np.append(new, far).astype(np.int32)
        up = np.append(np.where(ok, e, far), far).astype(np.int32)
    ops, i, x = [], n, m - n - low
    while i > 0 or i + low + x > 0:
        k = trace[i, x]
        kind = k & 3
        if i == 0:
            kind, k = 2, 8
        if kind == 0:
            ops.append("=" if a[i - 1] == b[i + low + x - 1] else "X")
            i -= 1
        elif kind == 1:
            while True:
                on = trace[i, x] & 4
                ops.append("I")
                i, x = i - 1, x + 1
                if not on or i == 0:
                    break
        else:
            while True:
                on = trace[i, x] & 8
                ops.append("D")
                x -= 1
                if not on or i + low + x <= 0:
                    break
    ops.reverse()
    text, opens, last = [], 0, 0
    for k in range(1, len(ops) + 1):
        if k == len(ops) or ops[k] != ops[last]:
            text.append(f"{k - last}{ops[last]}")
            opens += ops[last] in "ID"
            last = k
    return "".join(text), ops.count("="), ops.count("I") + ops.count("D"), opens
