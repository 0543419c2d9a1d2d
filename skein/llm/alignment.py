"""Banded edit distance of many pairs at once.

A band of 2w+1 diagonals is walked row by row for a whole batch of pairs of
similar length; the band starts narrow and is widened only for pairs whose
distance may still lie within their limit. Results are exact up to the limit.
"""

from __future__ import annotations

import numpy as np

_BIG = np.int32(1 << 28)


def _trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without their common beginning and end, which no shortest edit touches."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    if n:
        differ = np.flatnonzero(a[len(a) - n :] != b[len(b) - n :])
        tail = n - 1 - int(differ[-1]) if len(differ) else n
        a, b = a[: len(a) - tail], b[: len(b) - tail]
    return a, b


def _walk(xs: list[np.ndarray], ys: list[np.ndarray], w: int, limits: np.ndarray, anywhere: bool) -> np.ndarray:
    """Distances within bands of w diagonals to each side; above the limit where they don't fit.

    ``anywhere``: x may begin and end at any place of y that the band holds.
    """
    n, width = len(xs), 2 * w + 1
    nx, ny = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    rows = int(nx.max(initial=0))
    px = np.full((n, rows + 1), -1, np.int64)
    py = np.full((n, rows + 2 * width + int(ny.max(initial=0))), -2, np.int64)
    for i, (x, y) in enumerate(zip(xs, ys, strict=True)):
        px[i, : len(x)] = x
        py[i, w : w + len(y)] = y
    step = np.arange(width, dtype=np.int32)
    first = np.where(step < w, _BIG, 0 if anywhere else step - w).astype(np.int32)
    now = np.repeat(first[None, :], n, 0)
    if anywhere:
        now[(step[None, :] - w) > ny[:, None]] = _BIG
    result = np.full(n, _BIG, np.int32)
    live = np.arange(n)

    def finish(at: int) -> None:
        done = np.flatnonzero(nx[live] == at)
        if not len(done):
            return
        who = live[done]
        if anywhere:
            j = at + step[None, :] - w
            result[who] = np.where((j >= 0) & (j <= ny[who][:, None]), now[done], _BIG).min(1)
        else:
            o = ny[who] - at + w
            fits = (o >= 0) & (o < width)
            result[who[fits]] = now[done[fits], o[fits]]

    finish(0)
    for i in range(1, rows + 1):
        below = np.empty_like(now)
        below[:, :-1] = now[:, 1:] + 1
        below[:, -1] = _BIG
        now = now + (px[live, i - 1][:, None] != py[live, i - 1 : i - 1 + width])
        np.minimum(now, below, out=now)
        now -= step
        np.minimum.accumulate(now, axis=1, out=now)
        now += step
        finish(i)
        if i % 32 == 0:
            keep = (nx[live] > i) & (now.min(1) <= limits[live])
            live, now = live[keep], now[keep]
            if not len(live):
                break
    return result


def _batches(order: np.ndarray, size: np.ndarray, most: int) -> list[np.ndarray]:
    out, i = [], 0
    while i < len(order):
        j = i + 1
        while j < len(order) and (j - i + 1) * int(size[order[j]]) <= most and size[order[j]] <= 2 * size[order[i]] + 64:
            j += 1
        out.append(order[i:j])
        i = j
    return out


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int], most: int = 1 << 18) -> np.ndarray:
    """Edit distance of each pair of integer arrays, or limit + 1 where it is larger."""
    limits = np.asarray(limits, np.int64)
    out = limits + 1
    xs, ys, todo = [], [], []
    for i, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) > limits[i]:
            xs.append(None)
            ys.append(None)
            continue
        a, b = _trimmed(a, b)
        xs.append(a)
        ys.append(b)
        if not len(a) or not len(b):
            d = max(len(a), len(b))
            out[i] = min(d, limits[i] + 1)
        else:
            todo.append(i)
    todo, w = np.array(todo, np.int64), 8
    length = np.array([len(x) if x is not None else 0 for x in xs], np.int64)
    while len(todo):
        order = todo[np.argsort(length[todo], kind="stable")]
        left = []
        for batch in _batches(order, length + 4 * w, most):
            got = _walk([xs[i] for i in batch], [ys[i] for i in batch], w, limits[batch], False)
            fit = got <= np.minimum(limits[batch], w)
            out[batch[fit]] = got[fit]
            left.append(batch[~fit & (limits[batch] > w)])
        todo = np.concatenate(left)
        w *= 4
    return out


def contained_distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int], most: int = 1 << 20) -> np.ndarray:
    """Least edit distance of each first array to any stretch of the second, or limit + 1.

    The band holds the diagonals that such a stretch can use, so it is narrow where the
    second array is a window little longer than the first.
    """
    limits = np.asarray(limits, np.int64)
    out = limits + 1
    if not pairs:
        return out
    size = np.array([len(b) + 1 for _, b in pairs])
    for batch in _batches(np.argsort(size, kind="stable"), size, most):
        w = int(max(abs(len(pairs[i][1]) - len(pairs[i][0])) + limits[i] for i in batch))
        got = _walk([pairs[i][0] for i in batch], [pairs[i][1] for i in batch], w, limits[batch], True)
        out[batch] = np.minimum(got, limits[batch] + 1)
    return out
