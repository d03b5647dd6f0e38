"""Words of whole batches of texts at once, as positions in their bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time; a longer text is handled alone.
SLICE = 1 << 20

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, n + 1 offsets) of a string column; a null text is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(column.buffers()[2], np.uint8, last - first, first) if last > first else np.zeros(0, np.uint8)
    return data, offsets - first


def slices(batch: pa.RecordBatch, name: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in pieces whose texts have about `limit` bytes."""
    if not batch.num_rows:
        return
    _, offsets = text_bytes(batch.column(name))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of texts: `starts` and `ends` in `data`, those of text i from `first[i]` to `first[i + 1]`.

    data: lower-case (A-Z) bytes, each run of separators one space, so consecutive words of a text are space-joined.
    """

    def __init__(self, column: pa.Array, lower: bool = True):
        data, offsets = text_bytes(column)
        word = ~_SEPARATOR[data]
        before = np.empty_like(word)
        before[:1], before[1:] = False, word[:-1]
        cut = offsets[:-1][offsets[:-1] < len(data)]
        opens = before.copy()
        opens[cut] = False  # a text's first byte follows nothing
        starts = np.flatnonzero(word & ~opens)
        keep = word | before
        place = np.cumsum(keep) - keep  # of each byte in the compacted data
        ends_mask = np.empty_like(word)
        ends_mask[:-1], ends_mask[-1:] = ~word[1:], True
        inner = offsets[1:-1]
        ends_mask[inner[(inner > 0) & (inner <= len(data))] - 1] = True
        ends = np.flatnonzero(word & ends_mask)
        data = np.where(word, LOWER[data] if lower else data, np.uint8(32))[keep]
        self.first = np.searchsorted(starts, offsets)
        self.starts, self.ends, self.data = place[starts], place[ends] + 1, data

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first) of the k-word shingles, repeats included; a text of fewer words is one shingle."""
        n = np.diff(self.first)
        count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        first = np.concatenate([[0], np.cumsum(count)])
        word = np.arange(first[-1]) + np.repeat(self.first[:-1] - first[:-1], count)
        last = np.minimum(word + k, np.repeat(self.first[1:], count)) - 1
        return self.starts[word], self.ends[last], first


_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 that spreads every bit over all (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), mod 2 ** 64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each data[start:end]; equal bytes have equal hashes wherever they stand."""
    up = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_P, len(data)), out=up[1:])
    return mix64((up[ends] - up[starts]) * powers(_INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))
