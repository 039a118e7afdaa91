"""Sets of word shingles as 64-bit hashes, worked out for many texts at once."""

from __future__ import annotations

import numpy as np

_rng = np.random.default_rng(20240101)
#: A random number for each byte, A-Z having those of a-z; 0 marks the blanks.
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        with np.errstate(over="ignore"):
            _powers[name] = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(max(n, 1 << 16), base, np.uint64))))
    return _powers[name]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words of all texts, and how many words each text has."""
    flat = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(flat)
    word = _IS_WORD[flat]
    edge = np.diff(word.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    values = _BYTE[flat]
    values[~word] = 0
    values *= _power("up", _STEP, n)[:n]
    total = np.cumsum(values, dtype=np.uint64)
    before = np.where(begin > 0, total[begin - 1], np.uint64(0))
    hashes = mixed((total[end - 1] - before) * _power("down", _BACK, n)[begin])
    stops = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(begin, stops), prepend=0)
    return hashes, counts


def shingle_sets(texts: list[bytes], k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, ascending within each text, and each set's size.

    A text with fewer than ``k`` words, but with one, has its whole sequence as
    its one shingle.
    """
    words, counts = word_hashes(texts)
    starts = np.cumsum(counts) - counts
    n_sh = np.where(counts >= k, counts - k + 1, (counts > 0).astype(counts.dtype))
    owner = np.repeat(np.arange(len(texts)), n_sh)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(n_sh) - n_sh, n_sh) + starts[owner]
    h = np.zeros(len(owner), np.uint64)
    size = np.minimum(counts, k)[owner]
    for j in range(k):
        here = j < size
        h[here] = mixed(h[here] * _STEP + words[at[here] + j])
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[new], np.bincount(owner[new], minlength=len(texts))
