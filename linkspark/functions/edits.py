"""Levenshtein distances of many texts to many others."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np

#: Characters of a text whose states are kept for the texts that follow.
KEPT = 64
counted = np.frompyfunc(int.bit_count, 1, 1)


def stripped(xs: list[str], ys: list[str]) -> tuple[list[str], list[str]]:
    """Without the prefix and the suffix that all share: no distance changes."""
    n = len(os.path.commonprefix([*xs, *ys]))
    xs, ys = [x[n:][::-1] for x in xs], [y[n:][::-1] for y in ys]
    n = len(os.path.commonprefix([*xs, *ys]))
    return [x[n:][::-1] for x in xs], [y[n:][::-1] for y in ys]


def distances(xs: list[str], ys: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """k, distances of ys[k] to all xs (code points), the ys in sorted order.

    Bit-parallel (Myers, Hyyrö): bit p of an element says how its x's column changes from p to p + 1, and one step takes
    a character of y for all xs. Sorted ys share the steps of their common prefixes. xs of over 64 characters are Python's ints.
    """
    xs, ys = stripped(xs, ys)
    longest = max(map(len, xs), default=0)
    kind = next((k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if longest <= np.iinfo(k).bits), object)
    masks = [(1 << len(x)) - 1 for x in xs]
    mask, none, bits = np.array(masks, kind), np.array([0] * len(xs), kind), {}
    for i, x in enumerate(xs):
        for p, c in enumerate(x):
            own = bits.setdefault(c, {})
            own[i] = own.get(i, 0) | 1 << p
    for c, own in bits.items():
        bits[c] = none.copy()
        bits[c][list(own)] = np.array(list(own.values()), kind)
    states, last = [(mask, none)], ""
    for k in sorted(range(len(ys)), key=ys.__getitem__):
        y = ys[k]
        same = min(len(os.path.commonprefix([last, y])), len(states) - 1)
        del states[same + 1 :]
        up, down = states[-1]
        for p in range(same, len(y)):
            m = bits.get(y[p], none) | down
            d = (((m & up) + up) ^ up) | m
            right = ((down | ~(up | d)) << 1) | 1
            up, down = (((up & d) << 1) | ~(d | right)) & mask, right & d & mask
            if p < KEPT:
                states.append((up, down))
        last = y
        if kind is object:
            yield k, len(y) + counted(up).astype(np.int64) - counted(down).astype(np.int64)
        else:
            yield k, np.bitwise_count(up) + np.int32(len(y)) - np.bitwise_count(down)
