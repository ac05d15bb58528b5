"""Polynomial hashes of byte ranges over whole arrays, and a multikey sort of arrays of words."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTES = mix(np.arange(1, 257, dtype=_U))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                grown = np.full(max(n, 1 << 16), base, _U)
                grown[0] = 1
                setattr(self, name, np.multiply.accumulate(grown))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.get(len(data))
    out = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTES[data] * up, out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each range, the same wherever the bytes lie."""
    _, down = _POWERS.get(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(_U))


def multikey_order(words: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of rows by their words, and per word whether a row differs from the row before in it or an earlier one.

    The vectorised form of multikey quicksort: all rows are put in order by one word, and only runs of equal
    rows go on to the next word.
    """
    order = np.argsort(words[0], kind="stable")
    w = words[0][order]
    new = np.r_[True, w[1:] != w[:-1]][: len(w)]
    news = [new]
    for word in words[1:]:
        equal = ~new
        tied = np.flatnonzero(equal | np.r_[equal[1:], False])
        new = new.copy()
        if len(tied):
            runs = np.cumsum(new)[tied]
            rows = order[tied]
            rows = rows[np.lexsort((word[rows], runs))]
            order[tied] = rows
            w = word[rows]
            differs = np.r_[True, w[1:] != w[:-1]]
            new[tied] |= differs
        news.append(new)
    return order, news
