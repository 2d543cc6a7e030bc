"""Many texts as one numpy array of bytes: words, lines and n-grams hashed to 64 bits without a loop over words.

A span's hash is sum(R[byte] * M**place) modulo 2**64, read off one running sum, so that any set of spans costs a few
vector operations. R is a fixed table of random odd numbers; equal spans have equal hashes wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

U = np.uint64
M = U(0x9E3779B97F4A7C15)
M_INVERSE = U(pow(int(M), -1, 1 << 64))
R = np.random.Generator(np.random.PCG64(20)).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)

#: ASCII white space: space and \x09-\x0D.
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Powers kept between calls, at most: a longer run of texts makes its own, which go with it.
KEPT_POWERS = 1 << 19

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """M**0..M**n and the inverses."""
    if "up" in _powers and len(_powers["up"]) > n:
        return _powers["up"], _powers["down"]
    size, out = (1 << max(18, n.bit_length()) if n < KEPT_POWERS else n), []
    with np.errstate(over="ignore"):
        for base in (M, M_INVERSE):
            factors = np.full(size + 1, base, U)
            factors[0] = 1
            out.append(np.multiply.accumulate(factors))
    if n < KEPT_POWERS:
        _powers["up"], _powers["down"] = out
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class Texts:
    """Texts laid end to end, a line feed before and after each. bytes: uint8; at: where each text starts; to: where it ends."""

    def __init__(self, texts: list[str | None], lower: bool = False):
        parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        self.bytes = np.frombuffer(b"\n".join([b"", *parts, b""]), np.uint8)
        if lower:
            self.bytes = LOWER[self.bytes]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        self.to = np.cumsum(sizes + 1)
        self.at = self.to - sizes
        self.sums: np.ndarray | None = None

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash for each span of bytes."""
        up, down = powers(len(self.bytes))
        if self.sums is None:
            self.sums = np.zeros(len(self.bytes) + 1, U)
            np.cumsum(R[self.bytes] * up[: len(self.bytes)], out=self.sums[1:])
        return mix((self.sums[ends] - self.sums[starts]) * down[starts] + (ends - starts).astype(U))

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the runs between white space, and the number of the first word of each text (one more at the end)."""
        solid = np.zeros(len(self.bytes) + 2, np.int8)
        solid[1:-1] = ~SPACE[self.bytes]
        edge = np.diff(solid)
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        return starts, ends, np.append(np.searchsorted(starts, self.at), len(starts))

    def per_text(self, marks: np.ndarray) -> np.ndarray:
        """Sum over the bytes of each text."""
        run = np.zeros(len(marks) + 1, np.float64 if marks.dtype.kind == "f" else np.int64)
        np.cumsum(marks, out=run[1:])
        return run[self.to] - run[self.at]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, those across texts included."""
    if len(words) < n:
        return np.zeros(0, U)
    total = np.zeros(len(words) - n + 1, U)
    for k in range(n):
        total = total * M + words[k : len(words) - n + 1 + k]
    return mix(total)


def owners(first: np.ndarray) -> np.ndarray:
    """For each item the number of its text, from the number of each text's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def chunks(texts: Iterable[str | None], most: int = 1 << 17) -> Iterator[list[str | None]]:
    """Runs of texts of about most characters; a longer text stands alone, whole."""
    run: list[str | None] = []
    size = 0
    for text in texts:
        n = len(text or "")
        if run and size + n > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += n + 1
    if run:
        yield run
