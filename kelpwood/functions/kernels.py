"""Batched numpy kernels of the elastic distances: one dynamic program for many pairs at once.

A batch holds pairs as arrays (pairs, channels, length), padded to the longest series, with each
pair's own lengths. The program walks the cells of one row after the other for all pairs together
and reads every pair's answer at its own last cell. Cells of all pairs lie next to each other in memory.
No Spark imports here.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Row = Callable[[dict[str, np.ndarray], int, np.ndarray], np.ndarray]


def _pairs_last(x: np.ndarray) -> np.ndarray:
    """(length, channels, pairs) of (pairs, channels, length), or (length, pairs) of one channel."""
    x = np.ascontiguousarray(x.transpose(2, 1, 0))
    return x[:, 0] if x.shape[1] == 1 else x


def _sweep(n: int, m: int, la: np.ndarray, lb: np.ndarray, s: dict[str, np.ndarray | None], row: Row, outside: float, limit: np.ndarray | None = None, least: Callable | None = None, table: np.ndarray | None = None) -> np.ndarray:
    """row(s, i, row above) gives the cells (length of b, pairs) of row i; the arrays of s have the pairs last, and the row
    above the first holds ``outside``. ``limit``: pairs whose ``least`` possible distance after a row (s, row, i) is greater are given up and get infinity. ``table`` takes all cells."""
    pairs = len(la)
    out, own = np.full(pairs, np.nan), np.arange(pairs)
    above = np.full((n, pairs), outside)
    for i in range(m):
        above = row(s, i, above)
        if table is not None:
            table[i] = above
        last = np.flatnonzero(la == i + 1)
        out[own[last]] = above[lb[last] - 1, last]
        if limit is not None and i % 3 == 1 and i + 1 < m:
            lost = least(s, above, i) > limit
            if lost.sum() * 5 > len(lost):
                left = own[lost]
                out[left[np.isnan(out[left])]] = np.inf
                kept = np.flatnonzero(~lost)
                if not len(kept):
                    break
                above, own, la, lb, limit = np.take(above, kept, 1), own[kept], la[kept], lb[kept], limit[kept]
                s = {k: v if v is None else np.take(v, kept, -1) for k, v in s.items()}
    return out


def _shifted(above: np.ndarray) -> np.ndarray:
    """The cells on the diagonal before each but the first."""
    return above[:-1]


def _costs(s: dict, i: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
    """(length of b, pairs): squared differences to entry i of a, summed over the channels."""
    away = s["b"][lo:hi] - s["a"][i]
    away *= away
    return away if away.ndim == 2 else away.sum(1)


def _far(i: int, n: int, band: np.ndarray, lo: int = 0) -> np.ndarray:
    return np.abs(i - np.arange(lo, n))[:, None] > band


def _cheapest(cost: np.ndarray, above: np.ndarray, i: int, lo: int = 0) -> np.ndarray:
    """The cells of a warping path's costs from cell ``lo`` of row i on, in place."""
    if i:
        best = above[lo : lo + len(cost)].copy()
        skip = 0 if lo else 1
        np.minimum(best[skip:], above[lo + skip - 1 : lo + len(cost) - 1], out=best[skip:])
    row = cost
    if i:
        row[0] += best[0]
    for j in range(1, len(row)):
        row[j] += np.minimum(best[j], row[j - 1]) if i else row[j - 1]
    return row


def dtw(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, w: np.ndarray | None = None, limit: np.ndarray | None = None) -> np.ndarray:
    """Root of the cheapest warping path of squared differences, summed over the channels."""
    return np.sqrt(_warped(a, b, la, lb, w, None, limit))


def _warped(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, w: np.ndarray | None, table: np.ndarray | None, limit: np.ndarray | None = None) -> np.ndarray:
    """Cost of the cheapest path; ``table`` (length of a, length of b, pairs) takes all cells."""
    m, n = a.shape[2], b.shape[2]
    band = None if w is None else np.where(w < 0, np.inf, np.maximum(w, 0))
    widest = 0 if band is None else int(min(band.max(initial=0), m + n))

    def row(s, i, above):
        if s["band"] is None:
            return _cheapest(_costs(s, i), above, i)
        lo, hi = max(0, i - widest), min(n, i + widest + 1)
        out = np.full_like(above, np.inf)
        if lo < hi:
            cost = _costs(s, i, lo, hi)
            np.copyto(cost, np.inf, where=_far(i, hi, s["band"], lo))
            out[lo:hi] = _cheapest(cost, above, i, lo)
        return out

    return _sweep(n, m, la, lb, {"a": _pairs_last(a), "b": _pairs_last(b), "band": band}, row, np.inf, limit, lambda s, v, _: np.sqrt(v.min(0)), table)


def dtw_paths(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distances, steps, i, j) of pairs: places (pairs, longest path) of the cheapest paths from their ends back; on ties
    diagonal, then up, then left."""
    pairs = len(la)
    table = np.full((a.shape[2], b.shape[2], pairs), np.inf)
    total = _warped(a, b, la, lb, None, table)
    i, j, every = la - 1, lb - 1, np.arange(pairs)
    out_i, out_j, steps = [i], [j], np.ones(pairs, np.int64)
    while (open_ := (i > 0) | (j > 0)).any():
        up, left = np.maximum(i - 1, 0), np.maximum(j - 1, 0)
        costs = np.stack([np.where((i > 0) & (j > 0), table[up, left, every], np.inf), np.where(i > 0, table[up, j, every], np.inf), np.where(j > 0, table[i, left, every], np.inf)])
        way = np.argmin(costs, axis=0)
        i, j = np.where(open_ & (way != 2), up, i), np.where(open_ & (way != 1), left, j)
        steps += open_
        out_i.append(i)
        out_j.append(j)
    return np.sqrt(total), steps, np.stack(out_i, 1), np.stack(out_j, 1)


def wdtw(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, g: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Warping path with logistic weights of the distance from the diagonal; no root."""
    m, n = a.shape[2], b.shape[2]
    off = np.abs(np.arange(1 - m, n))[:, None]  # of all diagonals
    weight = 1 + np.exp(-g * (off - np.maximum(la, lb) / 2))

    def row(s, i, above):
        cost = _costs(s, i)
        cost /= s["weight"][m - 1 - i : m - 1 - i + n]
        return _cheapest(cost, above, i)

    return _sweep(n, m, la, lb, {"a": _pairs_last(a), "b": _pairs_last(b), "weight": weight}, row, np.inf, limit, lambda s, v, _: v.min(0))


def lcss(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, epsilon: np.ndarray, delta: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """1 - longest common subsequence / shorter length; entries match within epsilon."""
    m, n = a.shape[2], b.shape[2]
    score = lambda v, s: 1 - np.maximum(v, 0) / s["short"]

    def row(s, i, above):
        match = np.abs(s["b"] - s["a"][i]) <= s["epsilon"]
        out = np.maximum(above, 0)
        np.maximum(out[1:], _shifted(above), out=out[1:])
        taken = np.ones_like(out)
        if i:
            taken[1:] += np.maximum(_shifted(above), 0)
        far = _far(i, n, s["band"])
        for j in range(n):
            if j:
                np.maximum(out[j], out[j - 1], out=out[j])
            np.copyto(out[j], taken[j], where=match[j])
            out[j][far[j]] = -np.inf
        return out

    s = {"a": _pairs_last(a[:, :1]), "b": _pairs_last(b[:, :1]), "epsilon": epsilon, "band": np.where(delta < 0, np.inf, delta), "short": np.minimum(la, lb), "la": la}
    found = _sweep(n, m, la, lb, s, row, -np.inf, limit, lambda s, v, i: score(np.maximum(v.max(0), 0) + np.maximum(s["la"] - 1 - i, 0), s))
    return np.where(np.isposinf(found), np.inf, score(found, s))


def erp(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, g: np.ndarray, w: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Edit distance with real penalty against the value g; the first pair costs nothing."""
    m, n = a.shape[2], b.shape[2]
    x, y = _pairs_last(a[:, :1]), _pairs_last(b[:, :1])

    def row(s, i, above):
        far = _far(i, n, s["band"])
        drop = np.where(far, np.inf, s["drop"])
        if i:
            out = above + s["add"][i]
            np.minimum(out[1:], _shifted(above) + _costs(s, i)[1:], out=out[1:])
            out[far] = np.inf
        else:
            out = np.full((n, far.shape[1]), np.inf)
            out[0] = 0
        for j in range(1, n):
            np.minimum(out[j], out[j - 1] + drop[j], out=out[j])
        return out

    s = {"a": x, "b": y, "add": (x - g) ** 2, "drop": (g - y) ** 2, "band": np.where(w < 0, np.inf, w)}
    return np.sqrt(_sweep(n, m, la, lb, s, row, np.inf, limit, lambda s, v, _: np.sqrt(v.min(0))))


def msm(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, c: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Move-split-merge with cost c."""
    m, n = a.shape[2], b.shape[2]

    def step(s, v, x, y):
        """c and how far v is from the values between x and y."""
        away = np.maximum(np.minimum(x, y) - v, v - np.maximum(x, y))
        np.maximum(away, 0, out=away)
        away += s["c"]
        return away

    def row(s, i, above):
        x, y = s["a"][i], s["b"]
        out = np.abs(y - x)
        merge = step(s, y[1:], x, y[:-1])
        if i:
            out[1:] += _shifted(above)
            split = step(s, x, s["a"][i - 1], y)
            split += above
            out[0] = split[0]
            np.minimum(out[1:], split[1:], out=out[1:])
            for j in range(1, n):
                np.minimum(out[j], out[j - 1] + merge[j - 1], out=out[j])
        else:
            for j in range(1, n):
                out[j] = out[j - 1] + merge[j - 1]
        return out

    return _sweep(n, m, la, lb, {"a": _pairs_last(a[:, :1]), "b": _pairs_last(b[:, :1]), "c": c}, row, np.inf, limit, lambda s, v, _: v.min(0))


def twe(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, nu: np.ndarray, lam: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
    """Time warp edit distance with stiffness nu and penalty lam, over series led by a point 0."""
    m, n = a.shape[2], b.shape[2]
    x, y = _pairs_last(a[:, :1]), _pairs_last(b[:, :1])
    da, db = (np.diff(v, axis=0, prepend=0) ** 2 for v in (x, y))
    s = {"a": x, "b": y, "da": da, "db": db, "edge_a": np.cumsum(da, axis=0), "edge_b": np.cumsum(db, axis=0), "nu": nu, "lam": lam}

    def row(s, i, above):
        pairs = s["nu"].shape[0]
        edge = s["edge_b"]
        match = _costs(s, i)
        before = np.empty((n, pairs))  # the cells on the diagonal
        before[0] = s["edge_a"][i - 1] if i else 0
        if i:
            match[1:] += (s["b"][:-1] - s["a"][i - 1]) ** 2
            before[1:] = _shifted(above)
        else:
            before[1:] = edge[:-1]
        off = np.abs(i - np.arange(n))[:, None] * (2 if i else 1)
        off[0] = i
        out = before
        out += match
        out += s["nu"] * off
        up = (above if i else edge) + s["da"][i]
        up += s["lam"]
        up += s["nu"]
        np.minimum(out, up, out=out)
        left = s["edge_a"][i]
        for j in range(n):
            step = left + s["db"][j]
            step += s["lam"]
            step += s["nu"]
            left = np.minimum(out[j], step, out=out[j])
        return out

    return _sweep(n, m, la, lb, s, row, np.inf, limit, lambda s, v, i: np.minimum(v.min(0), s["edge_a"][i]))


def sbd(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - the greatest cross-correlation of normalised series (pairs, length) of one length (not divided by it)."""
    n = a.shape[1]
    za, zb = (x - x.mean(1, keepdims=True) for x in (a, b))
    za, zb = (z / np.where(s > 0, s, 1) for z, s in ((za, za.std(1, keepdims=True)), (zb, zb.std(1, keepdims=True))))
    size = 1 << (2 * n - 1).bit_length()
    both = np.fft.irfft(np.fft.rfft(za, size) * np.conj(np.fft.rfft(zb, size)), size)
    shifts = np.concatenate([both[:, :n], both[:, size - n + 1 :]], axis=1)  # the others wrap around
    return 1 - shifts.max(1)


def keogh(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Keogh's derivative of padded series (pairs, channels, length); the ends copy their neighbours."""
    out = np.array(x, float, order="K")
    if x.shape[2] > 2:
        out[:, :, 1:-1] = ((x[:, :, 1:-1] - x[:, :, :-2]) + (x[:, :, 2:] - x[:, :, :-2]) / 2) / 2
        out[:, :, 0] = out[:, :, 1]
    for n in np.unique(size):
        if n > 2:
            own = size == n
            out[own, :, n - 1] = out[own, :, n - 2]
    return out


def gradients_histogram(x: np.ndarray, bins: int) -> np.ndarray:
    """Counts (rows, bins) of the differences of each row in equal bins between its least and greatest."""
    steps = np.diff(x, axis=1)
    if not steps.shape[1] or bins <= 0:
        return np.zeros((len(x), 0))
    low = steps.min(1, keepdims=True)
    wide = (steps.max(1, keepdims=True) - low) / bins
    at = np.where(wide == 0, 0, np.minimum(((steps - low) / np.where(wide == 0, 1, wide)).astype(np.int64), bins - 1))
    return np.bincount((at + np.arange(len(x))[:, None] * bins).ravel(), minlength=len(x) * bins).reshape(len(x), bins).astype(float)
