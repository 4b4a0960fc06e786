"""Vectorised kernels over the UTF-8 buffers of Arrow string columns.

Every kernel works on whole texts. A batch is cut at row borders into chunks of
about ``CHUNK_BYTES`` so that memory stays flat whatever the batch holds; one
text longer than that is a chunk of its own, which takes some 30 bytes a byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 4 << 20

_rng = np.random.default_rng(20240517)
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_POS = _rng.integers(1, 2**64, 4096, dtype=np.uint64) | np.uint64(1)
_BLOCK = np.concatenate([[np.uint64(1)], _rng.integers(1, 2**64, 4095, dtype=np.uint64) | np.uint64(1)])
_LANE = _rng.integers(1, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_BYTE2 = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row borders (int64, one more than rows) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32, n + 1, column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[offs[0] : offs[-1]]
    return raw, offs - offs[0]


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with the bytes and borders of their texts."""
    raw, offs = utf8(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offs, offs[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at), raw[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def _spans(inside: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at borders."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = borders[(borders > 0) & (borders < n)]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, second: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte span; ``second`` is an independent function."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lens = ends - starts
    heads = np.cumsum(lens) - lens
    total = int(heads[-1] + lens[-1])
    within = np.arange(total, dtype=np.int64) - np.repeat(heads, lens)
    taken = data[within + np.repeat(starts, lens)]
    v = (_BYTE2 if second else _BYTE)[taken] * _POS[within & 4095]
    if lens.max() > 4096:
        v *= _BLOCK[(within >> 12) & 4095]
    out = np.zeros(len(starts), np.uint64)
    full = lens > 0
    out[full] = np.add.reduceat(v, heads[full]) if total else 0
    return mix(out + lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@dataclass
class Words:
    """Words of a chunk in order: byte spans, hashes, and each text's border in them."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    borders: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.borders)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.borders) - 1), self.counts)


def words(data: np.ndarray, offs: np.ndarray, hashed: bool = True) -> Words:
    """Runs of bytes outside x20 and x09-x0D; UTF-8 keeps those bytes for themselves."""
    starts, ends = _spans(~SPACE[data], offs)
    return Words(starts, ends, span_hash(data, starts, ends) if hashed else np.zeros(0, np.uint64), np.searchsorted(starts, offs))


def windows(w: Words, k: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in words of the chunk) where k words of one text start, and their hashes."""
    n = len(w.hashes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    last = w.borders[1:][w.text_of]
    at = np.flatnonzero(np.arange(n) + k <= last)
    acc = np.zeros(n - k + 1, np.uint64)
    lane = _LANE[::-1] if second else _LANE
    for i in range(k):
        acc += w.hashes[i : n - k + 1 + i] * lane[i]
    if second:
        acc ^= acc >> np.uint64(29)
    return at, mix(acc[at])


def lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the \\n-split lines of every text (an empty text has one), and each text's border in them."""
    cut = np.flatnonzero(data == 10)
    which = np.searchsorted(offs, cut, "right") - 1
    per = np.bincount(which, minlength=len(offs) - 1) + 1
    borders = np.concatenate([[0], np.cumsum(per)])
    starts = np.empty(borders[-1], np.int64)
    ends = np.empty(borders[-1], np.int64)
    inner = np.arange(len(cut)) + which  # the line that each \n ends
    starts[borders[:-1]] = offs[:-1]
    ends[borders[1:] - 1] = offs[1:]
    starts[inner + 1] = cut + 1
    ends[inner] = cut
    return starts, ends, borders


def per_span(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of values over each span."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[ends] - total[starts]


def per_text(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return per_span(values, offs[:-1], offs[1:])


def ngram_counts(data: np.ndarray, offs: np.ndarray, buckets: int, n: int = 3, block: int = 1 << 20) -> np.ndarray:
    """Texts x buckets: how often each hashed n-byte gram stands in each text; in blocks of bytes, so that memory is flat."""
    rows = len(offs) - 1
    out = np.zeros(rows * buckets, np.int64)
    for a in range(0, max(0, len(data) - n + 1), block):
        size = min(block, len(data) - n + 1 - a)
        code = np.zeros(size, np.uint64)
        for i in range(n):
            code = code * np.uint64(257) + data[a + i : a + i + size] + np.uint64(1)
        code = (mix(code) & np.uint64(buckets - 1)).astype(np.int64)
        lo, hi = int(np.searchsorted(offs, a, "right")) - 1, int(np.searchsorted(offs, a + size, "left"))
        taken = np.minimum(offs[lo + 1 : hi + 1], a + size) - np.maximum(offs[lo:hi], a)
        whole = np.arange(a, a + size) + n <= np.repeat(offs[lo + 1 : hi + 1], taken)
        found = np.bincount((np.repeat(np.arange(hi - lo), taken) * buckets + code)[whole])
        out[lo * buckets : lo * buckets + len(found)] += found
    return out.reshape(rows, buckets).astype(np.float32)


def row_groups(offs: np.ndarray, rows: int = 256, size: int = 4 << 20) -> Iterator[slice]:
    """Slices of at most so many texts and, but for single longer texts, so many bytes."""
    a = 0
    while a < len(offs) - 1:
        b = min(a + rows, len(offs) - 1, max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1))
        yield slice(a, b)
        a = b


def has_letter(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Whether each text has a letter of any script."""
    ascii_letter = ((data >= 65) & (data <= 90)) | ((data >= 97) & (data <= 122))
    found = per_text(ascii_letter, offs) > 0
    for i in np.flatnonzero(~found & (per_text(data >= 128, offs) > 0)):
        found[i] = any(c.isalpha() for c in data[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace"))
    return found
