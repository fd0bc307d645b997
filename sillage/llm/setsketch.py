"""SetSketch: registers that keep exponentially spaced, truncated minima of a set's points.

Every element of a set owns a Poisson process of points, each with a register at random; a register keeps
the logarithm, to a base near one, of its least point. Equal sets have equal registers, registers of a
union are the greater of two, and two sets agree in a register with a chance near their Jaccard similarity.
"""

from __future__ import annotations

import numpy as np

from sillage.llm.shingles import U, mix

#: Registers; bands take BAND_ROWS neighbours each.
REGISTERS, BAND_ROWS = 384, 6
BANDS = REGISTERS // BAND_ROWS
#: The logarithm's base, the rate of points, and the largest register value.
BASE, RATE, LARGEST = 1.001, 20.0, 65535
#: Log-likelihood that a pair may lose against its best similarity and still be verified: a true link is lost with a chance of about exp(-18).
SLACK = 18.0

_STEP, _LOW = 0x9E3779B97F4A7C15, U((1 << 24) - 1)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set; empty sets have zeros. Memory follows the points of one call, about 4000 a set."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    todo = [k for k, s in enumerate(sets) if len(s)]
    reach = np.log(REGISTERS) + 4.0
    while todo:
        sizes = np.array([len(sets[k]) for k in todo])
        elements = np.concatenate([sets[k] for k in todo])
        owner = np.repeat(np.arange(len(todo)), sizes)
        limit = reach / (sizes * RATE)
        least = np.full(len(todo) * REGISTERS, np.inf)
        x, turn = np.zeros(len(elements)), 1
        while len(elements):
            drawn = mix(elements + U(_STEP * turn % 2**64))
            x = x - np.log(((drawn >> U(24)).astype(np.float64) + 0.5) / 2.0**40) / (REGISTERS * RATE)
            near = x <= limit[owner]
            elements, owner, x, drawn = elements[near], owner[near], x[near], drawn[near]
            place = (((drawn & _LOW) * U(REGISTERS)) >> U(24)).astype(np.int64)
            np.minimum.at(least, owner * REGISTERS + place, x)
            turn += 1
        least = least.reshape(len(todo), REGISTERS)
        full = np.isfinite(least).all(axis=1)
        kept = np.clip(np.floor(1 - np.log(least[full]) / np.log(BASE)), 0, LARGEST)
        out[[k for k, f in zip(todo, full, strict=True) if f]] = kept
        todo = [k for k, f in zip(todo, full, strict=True) if not f]
        reach *= 2
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union of two sets."""
    return np.maximum(a, b)


def _share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(similarity: np.ndarray, more: np.ndarray, less: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Of a Jaccard similarity, given how many registers of a are above and below those of b, and both sizes."""
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    p, q = _share(np.maximum(u - v * similarity, 0)), _share(np.maximum(v - u * similarity, 0))
    tiny = 1e-12
    return more * np.log(p + tiny) + less * np.log(q + tiny) + (REGISTERS - more - less) * np.log(np.maximum(1 - p - q, tiny))


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs whose registers and sizes, taken together, don't rule out the similarity or more. Rows of a and b are pairs."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    n_a, n_b = n_a.astype(float), n_b.astype(float)
    most = np.minimum(n_a, n_b) / np.maximum(n_a, n_b)
    grid = np.linspace(0, 1, 41)[:, None] * most[None, :]
    best = log_likelihood(grid, more, less, n_a, n_b).max(axis=0)
    high = similarity + (most - similarity)[None, :] * np.linspace(0, 1, 21)[:, None]
    return (most >= similarity - 1e-9) & (log_likelihood(np.minimum(high, most), more, less, n_a, n_b).max(axis=0) >= best - SLACK)
