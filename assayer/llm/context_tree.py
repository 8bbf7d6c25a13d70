"""The numbers of a context-tree weighting model over bytes.

A byte is eight binary decisions, most significant bit first, each named by a node from 1
to 255 (a one followed by the bits so far). Every node has a tree of contexts of its own:
the last 0, 1, ... DEPTH bytes. At each context a Krichevsky-Trofimov estimate counts the
zeros and ones seen there, and the weighted probability is the even mixture of that
estimate and of the product over the contexts one byte longer. After training, the
chance of a bit is the mixture of the estimates at all depths, by their posterior weights.

A gram is a byte with its context, packed in a 64-bit number: the most recent context
byte first, the byte itself last, so that sorted grams have the contexts of a subtree
next to each other.
"""

from __future__ import annotations

import numpy as np

DEPTH = 5
#: What stands before the first byte of a text.
EDGE = 10
_LN2 = float(np.log(2))


def packed(stream: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """The grams of stream[depth:], each with the `depth` bytes before it."""
    n = len(stream) - depth
    wide = stream.astype(np.uint64)
    grams = wide[depth:].copy()
    for k in range(1, depth + 1):
        grams |= wide[depth - k : depth - k + n] << np.uint64(8 * (depth + 1 - k))
    return grams


def counted(grams: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order, and how often each occurs or what its weights add up to."""
    if weights is None:
        grams = np.sort(grams)
    else:
        order = np.argsort(grams, kind="stable")
        grams, weights = grams[order], weights[order]
    if not len(grams):
        return grams, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    if weights is None:
        return grams[first], np.diff(np.append(first, len(grams)))
    return grams[first], np.add.reduceat(weights, first)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1.0) - np.log(np.pi)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series above 8, the recurrence below."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        small = y < 8
        if not small.any():
            break
        shift[small] -= np.log(y[small])
        y[small] += 1
    inv = 1 / y
    inv2 = inv * inv
    return shift + (y - 0.5) * np.log(y) - y + 0.9189385332046727 + inv * (1 / 12 - inv2 * (1 / 360 - inv2 * (1 / 1260 - inv2 / 1680)))


class Level:
    """The nodes of one depth: sorted keys (context, node), zeros and ones, and the weight of the own estimate."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray | None):
        """below: the logs of the products over the longer contexts; None at the greatest depth."""
        own = log_kt(n0, n1)
        self.keys, self.n0, self.n1 = keys, n0, n1
        if below is None:
            self.log_weighted, self.own_weight = own, np.ones(len(keys))
        else:
            both = np.logaddexp(own, below)
            self.log_weighted, self.own_weight = both - _LN2, np.exp(own - both)

    def mixed(self, keys: np.ndarray, bits: np.ndarray, deeper: np.ndarray) -> np.ndarray:
        """The chance of each bit at this depth, given that at the next."""
        if not len(self.keys):
            return deeper
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        n = np.where(bits, self.n1[at], self.n0[at])
        own = (n + 0.5) / (self.n0[at] + self.n1[at] + 1)
        w = self.own_weight[at]
        # A context that was never seen has seen no longer one either; all its chances are even.
        return np.where(found, w * own + (1 - w) * deeper, 0.5)


def _nodes(context: np.ndarray, byte: np.ndarray, j: int) -> np.ndarray:
    return (context << np.uint64(8)) | np.uint64(1 << j) | (byte >> np.uint64(8 - j))


def _grouped(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys in order and the sums of the values."""
    if len(keys) > 1 and (keys[1:] < keys[:-1]).any():
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], tuple(v[order] for v in values)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return [keys[first], *(np.add.reduceat(v, first) if len(first) else v[:0] for v in values)]


def levels(grams: np.ndarray, counts: np.ndarray, top: int, depth: int = DEPTH) -> list[Level]:
    """Levels `top` to `depth` of the trees over counted grams (sorted, counts above 0)."""
    byte = grams & np.uint64(255)
    found: list[Level] = []
    below: tuple[np.ndarray, np.ndarray] | None = None
    for k in range(depth, top - 1, -1):
        context = grams >> np.uint64(8 * (depth - k + 1))
        parts = []
        for j in range(8):
            one = (byte >> np.uint64(7 - j)) & np.uint64(1)
            parts.append(_grouped(_nodes(context, byte, j), counts * (1 - one.astype(np.int64)), counts * one.astype(np.int64)))
        keys, n0, n1 = _grouped(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        product = None
        if below is not None:
            parents, product = _grouped(parent_keys(below[0]), below[1])
        found.append(Level(keys, n0.astype(float), n1.astype(float), product))
        below = (keys, found[-1].log_weighted)
    return found[::-1]


def parent_keys(keys: np.ndarray) -> np.ndarray:
    """Keys of the same nodes with the farthest context byte dropped."""
    return ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255))


def log_chances(grams: np.ndarray, trees: list[Level], depth: int = DEPTH) -> np.ndarray:
    """Natural log of the chance of each gram's byte in its context; trees: levels 0 to depth."""
    byte = grams & np.uint64(255)
    total = np.zeros(len(grams))
    for j in range(8):
        bits = ((byte >> np.uint64(7 - j)) & np.uint64(1)).astype(bool)
        chance = np.full(len(grams), 0.5)
        for k in range(depth, -1, -1):
            context = grams >> np.uint64(8 * (depth - k + 1))
            chance = trees[k].mixed(_nodes(context, byte, j), bits, chance)
        total += np.log(chance)
    return total


def grouped_by_parent(level: Level) -> list[np.ndarray]:
    """Sums for the level above, by node: its keys, zeros, ones and the logs of the products over this level."""
    return _grouped(parent_keys(level.keys), level.n0, level.n1, level.log_weighted)


def top_levels(keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, product: np.ndarray, depth: int) -> list[Level]:
    """Levels 0 to depth, from sums by node of level depth: counts, and logs of the products over the level below."""
    found = [Level(*_grouped(keys, n0, n1, product))]
    for _ in range(depth):
        found.insert(0, Level(*grouped_by_parent(found[0])))
    return found
