"""Words, lines and shingles of many texts at once, as numpy operations over their UTF-8 bytes.

A batch is worked off in blocks of whole texts of about BLOCK_BYTES, so that the temporaries stay small whatever the batch
holds; one text longer than that is a block of its own. Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which
in UTF-8 never occur inside another character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_BYTE = np.random.Generator(np.random.PCG64(20260311)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        grown = np.full(max(n, 2 * len(_POWERS), 4096), _BASE, np.uint64)
        grown[0] = 1
        _POWERS = np.cumprod(grown, dtype=np.uint64)
    return _POWERS


class Block:
    """Whole texts next to one another: bytes, and offsets where each begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def code_points(self, flags: np.ndarray | None = None) -> np.ndarray:
        lead = (self.data & 0xC0) != 0x80
        return self.per_text(lead if flags is None else lead & flags)

    def _hash(self, starts: np.ndarray, member: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Of the member bytes of each stretch from one start to the next."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        ends = np.append(starts[1:], len(data))
        at = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(data))))
        values = _BYTE[data] * powers(int((ends - starts).max()) + 1)[np.minimum(at, (ends - starts).max())]
        values[~member] = 0
        return mix(np.add.reduceat(values, starts))

    def words(self, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and bounds: word i of text t has bounds[t] <= i < bounds[t+1]."""
        data = _LOWER[self.data] if lower else self.data
        member = ~_SPACE[data]
        fresh = np.empty(len(data), bool)
        if len(data):
            fresh[0] = True
            fresh[1:] = ~member[:-1]
            fresh[self.offsets[:-1][self.offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(member & fresh)
        return self._hash(starts, member, data), np.searchsorted(starts, self.offsets)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r"""Hash of each \n-split line, whether it has a word, and bounds as for words. An empty text has one empty line."""
        is_end = self.data == 10
        cut = np.flatnonzero(is_end)
        # every text opens a line, and so does each byte after a \n, also where the text ends there
        opens = np.concatenate([self.offsets[:-1], cut + 1])
        owner = np.concatenate([np.arange(self.n), np.searchsorted(self.offsets, cut, "right") - 1])
        order = np.lexsort((opens, owner))
        opens, owner = opens[order], owner[order]
        closes = np.append(opens[1:] - 1, len(self.data))
        last = np.append(owner[1:] != owner[:-1], True)
        closes[last] = self.offsets[owner[last] + 1]
        length = closes - opens
        full = length > 0
        hashes = np.zeros(len(opens), np.uint64)
        has_word = np.zeros(len(opens), bool)
        if full.any():
            starts = opens[full]
            hashes[full] = self._hash(starts, ~is_end, self.data)
            seen = np.zeros(len(self.data) + 1, np.int64)
            np.cumsum(~_SPACE[self.data], out=seen[1:])
            has_word[full] = seen[closes[full]] > seen[starts]
        return hashes, has_word, np.searchsorted(owner, np.arange(self.n + 1))


def windows(hashes: np.ndarray, k: int, salt: int) -> np.ndarray:
    """Hash of every k hashes in a row; one per start, len(hashes) - k + 1 of them."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(salt))
    for j in range(k):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[j : j + n]
        out ^= out >> np.uint64(29)
    return mix(out)


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts; a null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(offs, offs[first] + size, "right")) - 1)
        yield Block(data[offs[first] : offs[last]], offs[first : last + 1] - offs[first], first)
        first = last
