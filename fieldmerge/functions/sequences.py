"""Gestalt similarity of two texts (twice the characters in common blocks, over all characters), for many pairs at once.

The longest common block of a pair is found first, the earliest in the first text and then in the second of equal ones, and what
is left and right of it is compared in the same way. Here all stretches of all pairs that are to be compared make a round: they
are laid out as rows of a matrix, stretches of about one size together, and the lengths of common blocks that end at a place are
carried from one character of the first texts to the next. As in the standard library, characters that make up more than a
hundredth of a second text of 200 or more start no block there, though blocks grow over them.
"""

from __future__ import annotations

import numpy as np

#: Places of a matrix that are compared at once.
CELLS = 1 << 21


def _laid_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after the other, where each begins and the last one ends)."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return codes, np.concatenate([[0], np.cumsum(sizes)])


def _popular(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character at each place is one of more than 1 % of a text of 200 or more."""
    out = np.zeros(len(codes), bool)
    for t in np.flatnonzero(np.diff(at) >= 200):
        mine = codes[at[t] : at[t + 1]]
        _, kind, n = np.unique(mine, return_inverse=True, return_counts=True)
        out[at[t] : at[t + 1]] = n[kind] > len(mine) // 100 + 1
    return out


def _longest(a: np.ndarray, b: np.ndarray, skip: np.ndarray, work: np.ndarray) -> np.ndarray:
    """(first place in a, first place in b, size) of the longest common block of each row (a0, a1, b0, b1) of work."""
    a0, a1, b0, b1 = work.T
    wide = int((b1 - b0).max())
    place = b0[:, None] + np.arange(wide)
    inside = place < b1[:, None]
    place = np.where(inside, place, 0)
    theirs = np.where(inside & ~skip[place], b[place], -1).astype(np.int32)
    best = np.column_stack([a0, b0, np.zeros(len(work), np.int64)])
    lengths = np.zeros((len(work), wide + 1), np.int32)  # of the blocks that end at the character before; column 0 stays 0
    rows = np.arange(len(work))
    for i in range(int((a1 - a0).max())):
        mine = np.where(a0 + i < a1, a[np.minimum(a0 + i, len(a) - 1)], -2).astype(np.int32)
        lengths[:, 1:] = np.where(theirs == mine[:, None], lengths[:, :-1] + 1, 0)
        j = lengths.argmax(axis=1)
        size = lengths[rows, j]
        better = np.flatnonzero(size > best[:, 2])
        best[better, 0] = a0[better] + i + 1 - size[better]
        best[better, 1] = b0[better] + j[better] - size[better]
        best[better, 2] = size[better]
    return best


def _grown(a: np.ndarray, b: np.ndarray, work: np.ndarray, best: np.ndarray) -> None:
    """Grows blocks in place over equal characters on either side, popular ones too."""
    a0, a1, b0, b1 = work.T
    on = np.arange(len(work))
    while len(on):
        i, j = best[on, 0] - 1, best[on, 1] - 1
        on = on[(i >= a0[on]) & (j >= b0[on]) & (a[np.maximum(i, 0)] == b[np.maximum(j, 0)])]
        best[on] += [-1, -1, 1]
    on = np.arange(len(work))
    while len(on):
        i, j = best[on, 0] + best[on, 2], best[on, 1] + best[on, 2]
        on = on[(i < a1[on]) & (j < b1[on]) & (a[np.minimum(i, len(a) - 1)] == b[np.minimum(j, len(b) - 1)])]
        best[on, 2] += 1


def sequence_ratios(first: list[str], second: list[str]) -> np.ndarray:
    """The ratio of each pair, 0 to 1; two empty texts are alike.

    A stretch costs the product of its lengths; a batch takes CELLS places at a time, or one pair, so memory is bounded by it.
    """
    (a, at), (b, bt) = _laid_out(first), _laid_out(second)
    skip = _popular(b, bt)
    any_skip = bool(skip.any())
    common = np.zeros(len(first), np.int64)
    work = np.column_stack([at[:-1], at[1:], bt[:-1], bt[1:]])
    pair = np.arange(len(first))
    while True:
        some = (work[:, 1] > work[:, 0]) & (work[:, 3] > work[:, 2])
        work, pair = work[some], pair[some]
        if not len(work):
            break
        order = np.lexsort((work[:, 1] - work[:, 0], work[:, 3] - work[:, 2]))
        work, pair, k, later = work[order], pair[order], 0, []
        wide = work[:, 3] - work[:, 2]  # ascending
        while k < len(work):
            to = int(np.searchsorted(wide, 2 * wide[k], "right"))  # no row is padded to more than twice its size
            to = max(k + 1, min(to, k + CELLS // int(wide[to - 1] + 1)))
            part = work[k:to]
            best = _longest(a, b, skip, part)
            if any_skip:
                _grown(a, b, part, best)
            hit = best[:, 2] > 0
            found, part, mine = best[hit], part[hit], pair[k:to][hit]
            np.add.at(common, mine, found[:, 2])
            left = np.column_stack([part[:, 0], found[:, 0], part[:, 2], found[:, 1]])
            right = np.column_stack([found[:, 0] + found[:, 2], part[:, 1], found[:, 1] + found[:, 2], part[:, 3]])
            later += [(left, mine), (right, mine)]
            k = to
        work, pair = np.concatenate([x for x, _ in later]), np.concatenate([x for _, x in later])
    total = np.diff(at) + np.diff(bt)
    return np.where(total > 0, 2.0 * common / np.maximum(total, 1), 1.0)
