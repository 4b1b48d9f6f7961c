"""Similarity of whole texts as Ratcliff and Obershelp define it, without comparing every character with every other.

The longest block that both texts have is matched, of several the first in the one text and then in the other; then what
stands left of it and what stands right of it, and so on. The ratio is twice the matched characters over all characters.

Blocks are found along diagonals: all places at which the texts agree in ``width`` characters, told by rolling hashes and
joined by sorting, lie in runs on diagonals, and every block of that width or more is such a run, cut off at the edges of
what is looked at. One join so serves all blocks down to the width; where a part of the texts has no more of them, it is
joined anew with a quarter of the width. Small parts go to difflib. Parts that repeat themselves so much that a join
would be too large have their longest block found by halving over its length, one sort a step, and are split there.
"""

from __future__ import annotations

import difflib

import numpy as np

#: Width of the first join, agreeing places for each character that a join may have, cells that difflib gets.
WIDTH, MOST_PLACES, CELLS = 32, 8, 1500
BASE = 0x9E3779B97F4A7C15


class Rolling:
    """Hashes of all windows of a text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        codes = (codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        codes ^= codes >> np.uint64(32)
        ones = np.ones(len(codes), np.uint64)
        up, back = (np.concatenate([np.ones(1, np.uint64), np.cumprod(ones * np.uint64(base), dtype=np.uint64)]) for base in (BASE, pow(BASE, -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[:-1], dtype=np.uint64)])
        self.back = back

    def windows(self, low: int, high: int, width: int) -> np.ndarray:
        """Of the windows that lie in [low, high)."""
        n = max(high - low - width + 1, 0)
        h = (self.sums[low + width : low + width + n] - self.sums[low : low + n]) * self.back[low : low + n]
        return h ^ h >> np.uint64(29)


Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def runs_of(a: Rolling, b: Rolling, part: tuple[int, int, int, int], width: int) -> Runs | None:
    """(place in a, place in b, length) of all runs of ``width`` or more on diagonals; None if there are too many places."""
    alo, ahi, blo, bhi = part
    ha, hb = a.windows(alo, ahi, width), b.windows(blo, bhi, width)
    order = np.argsort(hb, kind="stable")
    hb = hb[order]
    first = np.searchsorted(hb, ha)
    there = np.flatnonzero(hb[np.minimum(first, len(hb) - 1)] == ha) if len(hb) else np.zeros(0, np.int64)
    first = first[there]
    counts = np.searchsorted(hb, ha[there], side="right") - first
    if counts.sum() > MOST_PLACES * (ahi - alo + bhi - blo) + 1000:
        return None
    i = np.repeat(there, counts)
    j = order[np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(len(i))]
    by = np.argsort((i - j).astype(np.int64) * (ahi - alo + 1) + i, kind="stable")
    i, j = i[by], j[by]
    begins = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(j) != 1))) if len(i) else np.zeros(0, np.int64)
    return i[begins] + alo, j[begins] + blo, np.diff(np.append(begins, len(i))) + width - 1


def longest(a: Rolling, b: Rolling, part: tuple[int, int, int, int]) -> tuple[int, int, int]:
    """The longest block of a part, by halving; length 0 if nothing agrees."""
    alo, ahi, blo, bhi = part

    def met(width: int) -> np.ndarray:
        return np.flatnonzero(np.isin(a.windows(alo, ahi, width), b.windows(blo, bhi, width)))

    low, high = 0, min(ahi - alo, bhi - blo)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if len(met(mid)) else (low, mid - 1)
    if not low:
        return alo, blo, 0
    i = alo + int(met(low)[0])
    return i, blo + int(np.argmax(b.windows(blo, bhi, low) == a.windows(i, i + low, low)[0])), low


def left_of(runs: Runs, i: int, j: int, width: int) -> Runs:
    length = np.minimum(runs[2], np.minimum(i - runs[0], j - runs[1]))
    keep = length >= width
    return runs[0][keep], runs[1][keep], length[keep]


def right_of(runs: Runs, i: int, j: int, width: int) -> Runs:
    skip = np.maximum(0, np.maximum(i - runs[0], j - runs[1]))
    keep = runs[2] - skip >= width
    return (runs[0] + skip)[keep], (runs[1] + skip)[keep], (runs[2] - skip)[keep]


def matched(x: str, y: str) -> int:
    """Characters that the texts have in common."""
    a, b = Rolling(x), Rolling(y)
    total, todo = 0, [((0, len(x), 0, len(y)), None, WIDTH)]
    while todo:
        part, runs, width = todo.pop()
        alo, ahi, blo, bhi = part
        if alo == ahi or blo == bhi:
            continue
        if (ahi - alo) * (bhi - blo) <= CELLS:
            total += sum(m.size for m in difflib.SequenceMatcher(None, x[alo:ahi], y[blo:bhi], autojunk=False).get_matching_blocks())
            continue
        if runs is None:
            runs = runs_of(a, b, part, width)
        if runs is None:
            i, j, n = longest(a, b, part)
        elif len(runs[0]):
            n = int(runs[2].max())
            at = np.flatnonzero(runs[2] == n)
            at = at[np.lexsort((runs[1][at], runs[0][at]))[0]]
            i, j = int(runs[0][at]), int(runs[1][at])
        elif width > 1:
            todo.append((part, None, width // 4 or 1))
            continue
        else:
            continue
        if x[i : i + n] != y[j : j + n]:
            raise RuntimeError("two windows have one hash")
        if n:
            total += n
            todo.append(((alo, i, blo, j), runs and left_of(runs, i, j, width), width))
            todo.append(((i + n, ahi, j + n, bhi), runs and right_of(runs, i + n, j + n, width), width))
    return total


def ratio(x: str, y: str) -> float:
    """1 for two empty texts."""
    if not x and not y:
        return 1.0
    short, long = sorted((x, y), key=len)
    # where one holds the other, that is the longest block
    return 2 * (len(short) if short in long else matched(x, y)) / (len(x) + len(y))
