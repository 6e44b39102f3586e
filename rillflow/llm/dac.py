"""Directly addressable codes: a file of token ids in which any one can be read without decoding others.

An id is split into chunks of BITS bits, lowest first. Level k holds the k-th chunk of every id that
has one, and a bitmap that says which of them go on. The place of an id's next chunk is the rank of
its bit, read from a directory of one count per BLOCK bits plus the bits within the block.

File, little-endian: MAGIC; int64 ids, documents, levels; int64 doc_id of each document, with a byte
each that says if it is null; int64 first id of each document and the end; then per level int64 length,
the chunks (a byte each), the bitmap (64-bit words), the directory (uint32, one more than blocks).
"""

from __future__ import annotations

import numpy as np

MAGIC, BITS, BLOCK = b"RILLDAC1", 8, 512


def _ranks(bits: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(bits) // BLOCK) * BLOCK, np.uint8)
    padded[: len(bits)] = bits
    return np.concatenate([[0], np.cumsum(padded.reshape(-1, BLOCK).sum(1, dtype=np.uint32))]).astype("<u4")


def encode(ids: np.ndarray, doc_ids: list[int | None], starts: np.ndarray) -> bytes:
    """ids of all documents one after another; starts has one more entry than doc_ids."""
    levels, left = [], ids.astype(np.uint32)
    while len(left) or not levels:
        on = left >> BITS > 0
        bitmap = np.zeros(-(-len(on) // 64) * 8, np.uint8)
        packed = np.packbits(on, bitorder="little")
        bitmap[: len(packed)] = packed
        levels.append(np.array([len(left)], "<i8").tobytes() + (left & ((1 << BITS) - 1)).astype(np.uint8).tobytes() + bitmap.tobytes() + _ranks(on).tobytes())
        left = left[on] >> BITS
    head = np.array([len(ids), len(doc_ids), len(levels)], "<i8").tobytes()
    docs = np.array([x or 0 for x in doc_ids], "<i8").tobytes() + np.array([x is None for x in doc_ids], np.uint8).tobytes()
    return b"".join([MAGIC, head, docs, starts.astype("<i8").tobytes(), *levels])


class Reader:
    """Random access to one file's bytes (any buffer, such as a memory map)."""

    def __init__(self, data):
        if bytes(data[:8]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        self._at, self._data = 8, data
        self.n, docs, levels = self._take("<i8", 3).tolist()
        values, null = self._take("<i8", docs).tolist(), self._take("u1", docs)
        self.doc_ids = [None if x else v for v, x in zip(values, null)]
        self.starts = self._take("<i8", docs + 1)
        self.levels = []
        for _ in range(levels):
            n = int(self._take("<i8", 1)[0])
            chunks, bitmap = self._take("u1", n), self._take("u1", -(-n // 64) * 8)
            self.levels.append((chunks, bitmap, self._take("<u4", -(-n // BLOCK) + 1)))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def _rank(self, level: int, i: int) -> int:
        """How many ids before place i of a level go on: the directory's count and the bits of one block."""
        _, bitmap, ranks = self.levels[level]
        block = i // BLOCK
        count = int(ranks[block]) + int(np.bitwise_count(bitmap[block * BLOCK // 8 : i >> 3]).sum())
        return count + (int(bitmap[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else count

    def get(self, i: int) -> int:
        """The id at place i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            i, shift = self._rank(level, i), shift + BITS
        return value

    def slice(self, a: int, b: int) -> np.ndarray:
        """The ids at places a to before b: on each level they are a stretch between two ranks, so nothing else is decoded."""
        if not 0 <= a <= b <= self.n:
            raise IndexError((a, b))
        out = np.zeros(b - a, np.uint32)
        at, shift = np.arange(b - a), 0
        for level, (chunks, bitmap, _) in enumerate(self.levels):
            if a == b:
                break
            out[at] |= chunks[a:b].astype(np.uint32) << np.uint32(shift)
            bits = np.unpackbits(bitmap[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 :][: b - a].view(bool)
            first = self._rank(level, a)
            at, shift = at[bits], shift + BITS
            a, b = first, first + len(at)
        return out

    def ids(self) -> np.ndarray:
        """All ids."""
        return self.slice(0, self.n)
