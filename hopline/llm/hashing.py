"""Words of many texts as 64-bit hashes, in NumPy, without a Python object per word."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}
_BASE = 0xD6E8FEB86659FD93  # odd, so that it has an inverse modulo 2**64
#: Bytes hashed at a time.
_STRETCH = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit values whose output bits all depend on all input bits."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            with np.errstate(over="ignore"):
                _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words, index of each text's first word and one past the last).

    A-Z count as a-z. Words are runs of anything but space, tab, line feed, vertical
    tab, form feed and carriage return. Null is the empty text.
    """
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    raw = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    ends = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) + 1
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # short stretches of whole words: little memory, few powers
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + _STRETCH, "right")))
        low, high = starts[first], ends[last - 1]
        here, there = starts[first:last] - low, ends[first:last] - low
        up, down = _powers(int(high - low) + 1)
        with np.errstate(over="ignore"):
            sums = np.zeros(high - low + 1, np.uint64)
            np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
            hashes[first:last] = mix((sums[there] - sums[here]) * down[here] + (there - here).astype(np.uint64) * _STEP)
        first = last
    at = np.cumsum([0] + [len(d) + 1 for d in data])
    return hashes, np.searchsorted(starts, at)


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words (of the whole sequence, if it is shorter)."""
    n_used = min(n, len(words))
    if not n_used:
        return np.zeros(0, np.uint64)
    count = len(words) - n_used + 1
    with np.errstate(over="ignore"):
        h = np.full(count, n_used, np.uint64)
        for k in range(n_used):
            h = mix(h * _STEP + words[k : k + count])
    return h
