"""Paths of windows: the shared ground of the operators that remove repeated passages.

A window is `window` consecutive tokens (words, or bytes). Windows are edges of a de Bruijn graph. A minimiser, the
leftmost smallest hash among the shorter anchors inside a window, is the same wherever the window occurs, so runs of
windows of one document that have the same minimiser (paths) can be compared instead of single windows: equal windows
always lie in paths of equal minimiser, at equal distance from it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import xxhash

U = np.uint64
STEP = 1 << 18  # windows that are hashed at once; longer texts go in overlapping steps
CACHED_WORDS = 300_000
#: Odd multipliers of the two polynomial hashes, and of the mixing step.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
MIX = U(0xFF51AFD7ED558CCD)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word, 17)
        return found


_WORDS = _WordHashes()


@cache
def _byte_hashes() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([i]), 18) for i in range(256)], U)


def word_tokens(text: bytes) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(_WORDS.__getitem__, words), U, len(words))


def byte_tokens(text: bytes) -> np.ndarray:
    return _byte_hashes()[np.frombuffer(text, np.uint8)]


@cache
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^n and their inverses, modulo 2^64."""
    with np.errstate(over="ignore"):
        up = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, U(base), U)]))
        down = np.multiply.accumulate(np.concatenate([[U(1)], np.full(n, U(pow(base, -1, 1 << 64)), U)]))
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(33))) * MIX
    return x ^ (x >> U(29))


class Hashes:
    """Hashes of all stretches of some tokens, from prefix sums."""

    def __init__(self, tokens: np.ndarray, which: int = 0) -> None:
        size = 1 << max(12, int(len(tokens)).bit_length())  # few sizes: the powers are kept
        up, self.down = _powers(BASES[which], size)
        self.sums = np.concatenate([[U(0)], np.cumsum(tokens * up[: len(tokens)], dtype=U)])

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mixed((self.sums[starts + length] - self.sums[starts]) * self.down[starts])

    def all(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.down[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while 2 * done <= width:
        x, done = np.minimum(x[:-done], x[done:]), 2 * done
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def steps(n_tokens: int, window: int) -> Iterator[tuple[int, int]]:
    """Token ranges that share no window and miss none."""
    for a in range(0, n_tokens - window + 1, STEP):
        yield a, min(n_tokens, a + STEP + window - 1)


def paths(tokens: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """minimiser, path hash, first window, number of windows, first window's distance from the minimiser: of each path.
    A path's hash is of its first and last windows and their number: as a path has at most window - anchor + 1 windows,
    which is at most `window`, these two windows cover all of its tokens."""
    out: list[tuple[np.ndarray, ...]] = []
    for a, b in steps(len(tokens), window):
        own = tokens[a:b]
        one, two = Hashes(own, 0), Hashes(own, 1)
        keys = one.all(anchor) >> U(20) << U(20)
        least = sliding_min(keys | np.arange(len(keys), dtype=U), window - anchor + 1)
        starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        n = np.diff(np.append(starts, len(least)))
        last = starts + n - 1
        h = mixed(one.of(starts, window) ^ mixed(one.of(last, window) + n.astype(U)) ^ mixed(two.of(starts, window) + (two.of(last, window) << U(1))))
        at = (least[starts] & U((1 << 20) - 1)).astype(np.int64)
        out.append(((least[starts] >> U(20)).view(np.int64), h.view(np.int64), starts + a, n, starts - at))
    if not out:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


TOKENS: dict[str, Callable[[bytes], np.ndarray]] = {"words": word_tokens, "bytes": byte_tokens}
