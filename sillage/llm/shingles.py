"""Sets of hashed shingles of some words, computed for many texts at once with numpy."""

from __future__ import annotations

import numpy as np

#: Words in a shingle, unless another number is given.
WIDTH = 5

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_GOLD, _C1, _C2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_BASE = 0xD6E8FEB86659FD93  # odd, hence invertible modulo 2**64
_BYTE = np.random.Generator(np.random.PCG64(20240501)).integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_JOIN = U(0xC2B2AE3D27D4EB4F)


def mix(z: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    z = (z ^ (z >> U(30))) * _C1
    z = (z ^ (z >> U(27))) * _C2
    return z ^ (z >> U(31))


class _Powers:
    """Powers of a base modulo 2**64 and of its inverse, as many as the longest text so far needs."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 18)
            self.up, self.down = (np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, pow(_BASE, -1, 2**64)))
        return self.up, self.down


_powers = _Powers()


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of every text, and how many words each text has.

    A word's hash is a polynomial in its bytes, taken from running sums over all texts at once.
    """
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    word = np.concatenate([[False], ~_SPACE[data], [False]])
    starts, ends = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    up, down = _powers.to(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[: len(data)])])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    limits = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.diff(np.searchsorted(starts, limits))


def shingle_sets(texts: list[str], width: int = WIDTH) -> list[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles: A-Z lower-cased; a text of fewer words is one shingle; none without words."""
    out: list[np.ndarray] = []
    raw = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    at = 0
    while at < len(raw):
        to, size = at, 0
        while to < len(raw) and (to == at or size + len(raw[to]) < 1 << 18):
            size += len(raw[to])
            to += 1
        hashes, counts = word_hashes(raw[at:to])
        ends = np.cumsum(counts)
        joined = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
        for k in range(width):
            joined = joined * _JOIN + hashes[k : k + len(joined)]
        joined = mix(joined)
        for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
            if n >= width:
                out.append(np.unique(joined[end - n : end - width + 1]))
            elif n:
                short = np.full(1, n, np.uint64) * _GOLD
                for h in hashes[end - n : end]:
                    short = short * _JOIN + h
                out.append(mix(short))
            else:
                out.append(np.zeros(0, np.uint64))
        at = to
    return out


def fingerprint(values: np.ndarray) -> tuple[int, int]:
    """128 bits that two sets share only if they are equal (but for a chance of about 2**-128)."""
    with np.errstate(over="ignore"):
        a, b = mix(values + _GOLD).sum(dtype=np.uint64), mix(values ^ _C1).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))
