"""Words of many texts at once, as numpy arrays of 64-bit hashes: no Python work per word.

A hash is a polynomial over a seeded table of byte values, finished with a bit mixer. It depends on
the word alone, so it is the same in every task and every run.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 1_000_000  # bytes worked on at once; bounds the memory of the arrays

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUES = np.random.default_rng(20260811).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a sequence made longer by one word."""
    return mixed(left * np.uint64(0xD6E8FEB86659FD93) + right)


def chunks(texts: Iterable[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``CHUNK`` bytes: (index of the first, encoded texts)."""
    first, run, held = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if run and held + len(b) > CHUNK:
            yield first, run
            first, run, held = i, [], 0
        run.append(b)
        held += len(b)
    if run:
        yield first, run


def split(run: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, words per text). Words are what blanks separate; A-Z are lower-cased."""
    raw = _LOWER[np.frombuffer(b" ".join(run), np.uint8)]
    ends = np.cumsum(np.fromiter(map(len, run), np.int64, len(run)) + 1) - 1
    inside = ~_SPACE[raw]
    edge = np.diff(np.concatenate(([False], inside, [False])).astype(np.int8))
    start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    per_text = np.diff(np.searchsorted(start, np.concatenate(([0], ends))))
    return (run_hashes(raw, start, stop) if start.size else np.empty(0, np.uint64)), per_text


def run_hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hash of each byte range ``[start, stop)`` of ``data``; ranges are sorted, apart and not empty."""
    sizes = stop - start
    total = int(sizes.sum())
    at = np.cumsum(sizes) - sizes
    place = np.arange(total) - np.repeat(at, sizes)
    powers = np.full(int(sizes.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    return mixed(np.add.reduceat(_VALUES[data[np.repeat(start, sizes) + place]] * powers[place], at))
