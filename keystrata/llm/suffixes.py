"""Suffix sorting in two stages, and common prefixes of neighbours, to a bounded depth (numpy)."""

from __future__ import annotations

import numpy as np

#: Bytes of a block: the unit that suffixes are sorted and compared by.
BLOCK = 24


def _words(text: np.ndarray, depth: int) -> np.ndarray:
    """Big-endian 8-byte words at every position of the text and of zeros after it."""
    padded = np.zeros(len(text) + depth + 40, np.uint8)
    padded[: len(text)] = text
    out = np.zeros(len(text) + depth + 32, np.uint64)
    raw = padded.tobytes()
    for o in range(8):
        part = np.frombuffer(raw, ">u8", (len(raw) - o) // 8, o)
        out[o::8] = part[: len(out[o::8])]
    return out


def ascending(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the last isn't."""
    n = len(text)
    step = np.zeros(n, np.int8)
    step[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1])
    step[-1] = -1
    decides = np.where(step != 0, np.arange(n), n)
    decides = np.minimum.accumulate(decides[::-1])[::-1]
    return step[decides] > 0


def _ranked(keys: np.ndarray) -> np.ndarray:
    """The place of each key among the distinct keys."""
    order = np.argsort(keys)
    sorted_ = keys[order]
    rank = np.empty(len(keys), np.uint64)
    rank[order] = np.cumsum(np.concatenate(([False], sorted_[1:] != sorted_[:-1])))
    return rank


def block_ranks(text: np.ndarray, depth: int) -> tuple[np.ndarray, int]:
    """Ranks of the ``BLOCK`` bytes at every position, and how many bits they take."""
    rank, width = _ranked(_words(text, depth + 2 * BLOCK)), 8
    bits = max(1, int(rank.max()).bit_length())
    while width < BLOCK:
        times = min(64 // bits, BLOCK // width)
        n = len(rank) - (times - 1) * width
        key = np.zeros(n, np.uint64)
        for k in range(times):
            key = (key << np.uint64(bits)) | rank[k * width : k * width + n]
        rank, width = _ranked(key), width * times
        bits = max(1, int(rank.max()).bit_length())
        if times == 1:
            raise ValueError("too much text at once")
    return rank, bits


def _sorted_directly(at: np.ndarray, rank: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Positions in order of the ``depth`` bytes there: some blocks a round, ties alone going on."""
    order = at.copy()
    active = np.arange(len(at))
    group = np.zeros(len(at), np.uint64)  # of the active ones
    o = 0
    while o < depth and len(active):
        p = order[active]
        key, left = group, 64 - (int(group[-1]).bit_length() if len(group) else 0)
        while left >= bits and o < depth:
            key = (key << np.uint64(bits)) | rank[p + o]
            left -= bits
            o += BLOCK
        by = np.argsort(key, kind="stable")
        key, p = key[by], p[by]
        order[active] = p
        new = np.concatenate(([True], key[1:] != key[:-1]))
        tied = ~(new & np.append(new[1:], True))
        group = np.cumsum(new)[tied].astype(np.uint64)
        if len(group):
            group = _dense(group)
        active = active[tied]
    return order


def _dense(sorted_: np.ndarray) -> np.ndarray:
    """Ascending numbers made dense."""
    return np.cumsum(np.concatenate(([False], sorted_[1:] != sorted_[:-1]))).astype(np.uint64)


def suffix_array(text: np.ndarray, depth: int, blocks: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """Suffixes in order of their first ``depth`` bytes at least.

    Only suffixes smaller than their successors are sorted directly. One scan
    over the buckets of first bytes induces the others: whenever a suffix is
    passed, the one before it is put at the front of its bucket if it is larger.
    Byte runs inside a bucket come in waves, each the predecessors of the last.
    """
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    asc = ascending(text)
    blocks = blocks or block_ranks(text, depth)
    direct = _sorted_directly(np.flatnonzero(asc), *blocks, depth)
    starts = np.searchsorted(text[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[text[n - 1]].append(np.array([n - 1]))
    out: list[np.ndarray] = []

    def passed(some: np.ndarray, byte: int) -> np.ndarray:
        """Hands larger predecessors to their buckets; those of this bucket itself are returned."""
        before = some[some > 0] - 1
        before = before[~asc[before]]
        first = text[before]
        if len(before):
            by = np.argsort(first, kind="stable")
            by = by[first[by] > byte]
            for part in np.split(by, np.flatnonzero(np.diff(first[by])) + 1):
                if len(part):
                    waiting[first[part[0]]].append(before[part])
        return before[first == byte]

    for byte in range(256):
        wave = np.concatenate(waiting[byte]) if waiting[byte] else np.empty(0, np.int64)
        while len(wave):
            out.append(wave)
            wave = passed(wave, byte)
        small = direct[starts[byte] : starts[byte + 1]]
        if len(small):
            out.append(small)
            passed(small, byte)
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, order: np.ndarray, depth: int, blocks: tuple[np.ndarray, int] | None = None) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in order, ``depth`` at most; 0 for the first."""
    rank, _ = blocks or block_ranks(text, depth)
    rank = rank.astype(np.uint32)
    lcp = np.zeros(len(order), np.int64)
    active = np.arange(1, len(order))
    one, two = order[1:], order[:-1]
    for o in range(0, depth, BLOCK):
        same = rank[one + o] == rank[two + o]
        lcp[active[~same]] = o
        active, one, two = active[same], one[same], two[same]
    lcp[active] = depth
    # The first block that differs, word by word.
    words = _words(text, depth)
    rest = np.flatnonzero(lcp[1:] < depth) + 1 if len(order) else active
    one, two = order[rest] + lcp[rest], order[rest - 1] + lcp[rest]
    for _ in range(0, BLOCK, 8):
        differ = words[one] ^ words[two]
        part = np.full(len(rest), 8)
        for b in range(8):
            part -= differ >= np.uint64(1 << (8 * b))
        lcp[rest] += part
        more = differ == 0
        rest, one, two = rest[more], one[more] + 8, two[more] + 8
    return np.minimum(lcp, depth)
