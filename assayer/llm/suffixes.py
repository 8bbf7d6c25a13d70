"""Suffix arrays and common prefixes in numpy.

An array of symbols is cut into parts by their ends: no suffix is compared beyond the end of
its part. An end sorts after every symbol, and of two ends the first one first. `words` holds,
for each position, the `span` symbols from there on in one whole number that sorts as they do;
where a word reaches beyond its part's end, it goes on with symbols greater than all others.
"""

from __future__ import annotations

import numpy as np

#: Common prefixes are worked out at every so many positions first.
STRIDE = 256
#: Symbols compared at a time for prefixes that go on.
AHEAD = 32


def left_in_part(ends: np.ndarray, n: int) -> np.ndarray:
    """Symbols from each position to the end of its part; ends are ascending, the last is n."""
    return np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(n)


def suffix_array(words: np.ndarray, left: np.ndarray, span: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of all suffixes, by Larsson-Sadakane refinement.

    A group of suffixes that are equal so far is named by its first place; each round sorts
    the groups that still have several members by the names at twice the distance.
    """
    n = len(words)
    order = np.argsort(words)
    # Ends that look alike stand in the order of their parts.
    short = np.flatnonzero(left[order] < span)
    order[short] = order[short][np.lexsort((order[short], words[order[short]]))]
    ranked = words[order]
    first = np.ones(n, bool)
    np.not_equal(ranked[1:], ranked[:-1], out=first[1:])
    # A suffix that ends within its word is told from all others.
    first |= left[order] < span
    first[1:] |= left[order[:-1]] < span
    places = np.arange(n)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(first, places, 0))
    reach = span
    at = np.flatnonzero(~(first & np.append(first[1:], True))) if n else places
    while len(at):
        suffix = order[at]
        # One that ends at this distance comes after all others of its group.
        ended = left[suffix] <= reach
        after = np.where(ended, n + suffix, rank[np.minimum(suffix + reach, n - 1)])
        key = rank[suffix] * (2 * n) + after
        by = np.argsort(key)
        suffix, key, ended = suffix[by], key[by], ended[by]
        order[at] = suffix
        new = np.ones(len(at), bool)
        np.not_equal(key[1:], key[:-1], out=new[1:])
        new |= ended
        new[1:] |= ended[:-1]
        first[at] |= new
        rank[suffix] = np.maximum.accumulate(np.where(first[at], at, 0))
        reach *= 2
        at = at[~(first[at] & np.append(first, True)[at + 1])]
    return order, rank


def equal_bytes(x: np.ndarray) -> np.ndarray:
    """Leading bytes of 64-bit words that are zero."""
    count = np.zeros(len(x), np.int64)
    for shift in (32, 16, 8):
        clear = x >> np.uint64(64 - shift) == 0
        count += np.where(clear, shift // 8, 0)
        x = np.where(clear, x << np.uint64(shift), x)
    return count + (x == 0)


def common_prefixes(order: np.ndarray, words: np.ndarray, left: np.ndarray, span: int = 1, most: int | None = None) -> np.ndarray:
    """Symbols that each suffix in order has in common with the one before it, `most` at most.

    Kasai's bound (the suffix one further on has at most one less) starts every comparison:
    every STRIDE-th position is compared from the beginning, then those half-way between,
    from what the position before leaves them, and so on.
    """
    n = len(order)
    before = np.full(n, -1)
    before[order[1:]] = order[:-1]
    limit = np.where(before < 0, 0, np.minimum(left, left[before]))
    if most is not None:
        limit = np.minimum(limit, most)
    found = np.zeros(n, np.int64)

    def extend(at: np.ndarray) -> None:
        at = at[found[at] < limit[at]]
        ahead = 1
        while len(at):
            have = found[at]
            steps = have[:, None] + np.arange(ahead) * span
            here = words[np.minimum(at[:, None] + steps, n - 1)]
            there = words[np.minimum(before[at][:, None] + steps, n - 1)]
            differs = here != there
            stop = np.where(differs.any(1), differs.argmax(1), ahead)
            more = stop * span
            if span > 1:
                part = np.flatnonzero(stop < ahead)
                more[part] += equal_bytes(here[part, stop[part]] ^ there[part, stop[part]])
            found[at] = np.minimum(have + more, limit[at])
            at = at[(stop == ahead) & (found[at] < limit[at])]
            ahead = AHEAD if len(at) * AHEAD < 4_000_000 else 1

    stride = STRIDE
    extend(np.arange(0, n, stride))
    while stride > 1:
        half = stride // 2
        at = np.arange(half, n, stride)
        found[at] = np.minimum(np.maximum(found[at - half] - half, 0), limit[at])
        extend(at)
        stride = half
    return found[order]
