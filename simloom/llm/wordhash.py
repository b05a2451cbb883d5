"""Words of whole Arrow batches as NumPy arrays: places, hashes and shingles, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together.
CHUNK_BYTES = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _lowered() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWERED = _lowered()
#: A random value for each byte, the same for both cases of a letter.
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[LOWERED]
_STEP = 0xD1342543DE82EF95
_PLACE = _mix(np.arange(1001, 1001 + 64, dtype=np.uint64)) | np.uint64(1)

#: Bytes that are not white space (space, and tab to carriage return).
NOT_BLANK = np.ones(256, dtype=bool)
NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False


def chunks(batch: pa.RecordBatch, text: int, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, starts of the rows and the end) of a batch with a string column without nulls."""
    column = batch.column(text)
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        end = min(end, len(column))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Words:
    """The words of the texts of a chunk.

    at, size: place and bytes of each word; hash: of its lower-cased bytes; first: number of the
    first word of each text, and the number of words.
    """

    def __init__(self, data: np.ndarray, starts: np.ndarray, inside: np.ndarray = NOT_BLANK):
        word = inside[data]
        edge = starts[:-1][starts[:-1] < starts[1:]]  # texts that are not empty
        begins = word.copy()
        begins[1:] &= ~word[:-1]
        begins[edge] = word[edge]
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        ends[edge[1:] - 1] = word[edge[1:] - 1]
        self.at = np.flatnonzero(begins)
        self.size = np.flatnonzero(ends) + 1 - self.at
        self.first = np.searchsorted(self.at, starts)
        self.hash = np.zeros(len(self.at), dtype=np.uint64)
        ends = np.cumsum(self.size)
        i, n = 0, len(self.at)
        powers = np.full(int(self.size.max()) if n else 0, _STEP, dtype=np.uint64)
        powers[:1] = 1
        powers = np.cumprod(powers)
        while i < n:  # words of bounded bytes at a time, as the numbers take many bytes a byte
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + CHUNK_BYTES, side="right")))
            part = slice(self.at[i], self.at[j - 1] + self.size[j - 1])
            letters, size = data[part][word[part]], self.size[i:j]
            head = np.cumsum(size) - size
            inner = np.arange(len(letters)) - np.repeat(head, size)
            self.hash[i:j] = _mix(np.add.reduceat(_BYTE[letters] * powers[inner], head) + size.astype(np.uint64))
            i = j

    def shingles(self, k: int) -> list[np.ndarray]:
        """Each text's sorted distinct hashes (int64) of k consecutive words; of all its words if fewer."""
        n, out = len(self.hash), []
        if n >= k:
            sums = np.zeros(n - k + 1, dtype=np.uint64)
            for i in range(k):
                sums += self.hash[i : n - k + 1 + i] * _PLACE[i]
            hashed = _mix(sums + np.uint64(k)).view(np.int64)
        for a, b in zip(self.first[:-1], self.first[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(hashed[a : b - k + 1]))
            elif b > a:
                own = np.zeros(1, dtype=np.uint64)
                for i in range(b - a):
                    own += self.hash[a + i : a + i + 1] * _PLACE[i]
                out.append(_mix(own + np.uint64(b - a)).view(np.int64))
            else:
                out.append(np.zeros(0, dtype=np.int64))
        return out


def lists(arrays: list[np.ndarray]) -> pa.ListArray:
    """An Arrow list<int64> column."""
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int64()))
