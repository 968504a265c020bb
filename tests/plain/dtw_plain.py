"""Plain dynamic time warping, to compare with."""

from __future__ import annotations

import math

import numpy as np

FAR = 500.0  # stands for infinity in scores


def frame_cost(x: np.ndarray, y: np.ndarray, kind: str = "cosine") -> np.ndarray:
    """Input frames x template frames; every frame is divided by its norm first."""
    def unit(m):
        n = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, n, out=np.zeros_like(m), where=n > 0)

    a, b = unit(np.asarray(x, float)), unit(np.asarray(y, float))
    if kind == "cosine":
        return np.maximum(1 - a @ b.T, 0.0)
    diff = a[:, None, :] - b[None, :, :]
    return np.abs(diff).sum(axis=2) if kind == "manhattan" else np.sqrt((diff * diff).sum(axis=2))


def accumulate(cost: np.ndarray, subsequence: bool = False, transition: str = "levenshtein") -> np.ndarray:
    """Template rows by input columns of least sums of costs."""
    c = cost.T
    rows, cols = c.shape
    d = np.full((rows, cols), FAR)
    d[0] = c[0] if subsequence else np.cumsum(c[0])
    if transition == "levenshtein":
        d[:, 0] = np.cumsum(c[:, 0])
    for t in range(1, cols):
        for i in range(1, rows):
            if transition == "levenshtein":
                least = min(d[i - 1, t - 1], d[i, t - 1], d[i - 1, t])
            else:
                least = min(d[i - 1, t - 1], d[i, t - 1], d[i - 2, t - 1] if i >= 2 else FAR)
            d[i, t] = least + c[i, t]
    return d


def goal_column(d: np.ndarray, best: bool) -> int | None:
    """Last column, or the one with the least sum at or after 0.6 of the template's length, the latest of equals."""
    rows, cols = d.shape
    if not best:
        return cols - 1
    first = int(0.6 * rows)
    if cols <= first:
        return None
    tail = d[-1, first:][::-1]
    return cols - 1 - int(np.argmin(tail))


def align(d: np.ndarray, goal: int, transition: str = "levenshtein") -> tuple[float, list[int]]:
    """Length of the path back to a border, and the matched input column of each template row (-1: none)."""
    i, t, length = d.shape[0] - 1, goal, 0.0
    path = [-1] * d.shape[0]
    path[i] = t
    while i > 0 and t > 0:
        least, move = d[i - 1, t - 1], "match"
        if d[i, t - 1] < least:
            least, move = d[i, t - 1], "insert"
        other = d[i - 1, t] if transition == "levenshtein" else d[i - 2, t - 1] if i >= 2 else FAR
        if other < least:
            move = "delete"
        if move == "match":
            i, t, length = i - 1, t - 1, length + math.sqrt(2)
        elif move == "insert":
            t, length = t - 1, length + 1
        elif transition == "levenshtein":
            i, length = i - 1, length + 1
        else:
            i, t, length = i - 2, t - 1, length + math.sqrt(5)
        path[i] = t
    return length, path


def score(x: np.ndarray, template: np.ndarray, kind: str = "cosine", subsequence: bool = False, transition: str = "levenshtein", best: bool = False) -> tuple[float, list[int]]:
    """Least cost by path length, and the path."""
    if not len(x) or not len(template):
        return FAR, [-1] * len(template)
    d = accumulate(frame_cost(x, template, kind), subsequence, transition)
    goal = goal_column(d, best)
    if goal is None:
        return FAR, [-1] * len(template)
    length, path = align(d, goal, transition)
    total = float(d[-1, goal])
    return max(0.0, total / length if length else total), path


def fuse_templates(frames: list[np.ndarray], **options) -> np.ndarray:
    """One template from several: the one nearest to all others leads, the rest are averaged in along their paths."""
    n = len(frames)
    table = np.zeros((n, n))
    paths: dict[tuple[int, int], list[int]] = {}
    for i in range(n):
        for j in range(n):
            if i != j:
                table[i, j], paths[i, j] = score(frames[j], frames[i], **options)
    lead = int(np.argmin(table.sum(axis=1)))
    weights = np.array([2.0 if j == lead else 2.0 - table[lead, j] for j in range(n)])
    weights /= weights.sum()
    out = np.zeros_like(frames[lead], float)
    for i in range(len(out)):
        for j in range(n):
            at = i if j == lead else paths[lead, j][i]
            out[i] += weights[j] * (frames[lead][i] if j == lead or at < 0 else frames[j][at])
    return out
