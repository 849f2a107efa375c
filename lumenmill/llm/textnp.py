"""Vectorised text scanning over the UTF-8 buffers of Arrow batches.

All separators that the operators use are ASCII, so bytes of 0x80 and above belong to words and scanning bytes gives the
same words as scanning code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_M3 = np.uint64(0x9FB21C651E98DF25)
#: Longer spans are hashed one by one.
LONG = 64
#: Masks of the low bytes of a word.
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of text scanned at once; a longer text is a piece of its own.
PIECE = 2 << 20

def table_of(chars: bytes, *, invert: bool = False) -> np.ndarray:
    """A 256-entry boolean table of the bytes given."""
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return ~out if invert else out


BLANK = table_of(b" \t\n\x0b\x0c\r")
#: Bytes of words of digits, ASCII letters and non-ASCII characters.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


class Texts:
    """A piece of a batch: the bytes of its texts, one after the other, and where each begins."""

    def __init__(self, column: pa.Array):
        column = pc.fill_null(column, "")
        wide = pa.types.is_large_string(column.type)
        kind = np.int64 if wide else np.int32
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
        self.data = raw[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        self.n = len(column)

    def lower(self) -> None:
        """Lower-case A-Z."""
        self.data = LOWER[self.data]

    def words(self, in_word: np.ndarray) -> None:
        """Sets starts, ends and bounds: words i of text k are those from bounds[k] to bounds[k + 1]."""
        size = len(self.data)
        inside = in_word[self.data]
        first = np.empty(size, bool)
        last = np.empty(size, bool)
        if size:
            first[0] = last[-1] = True
            np.logical_not(inside[:-1], out=first[1:])
            np.logical_not(inside[1:], out=last[:-1])
            edges = self.offsets[:-1][self.offsets[:-1] < size]
            first[edges] = True
            edges = self.offsets[1:][self.offsets[1:] > 0]
            last[edges - 1] = True
        self.starts = np.flatnonzero(inside & first)
        self.ends = np.flatnonzero(inside & last) + 1
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.inside = inside

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of the byte spans: eight bytes at a time, each step scrambled; spans over ``LONG`` bytes by BLAKE2.

        Up to eight bytes and for one length the hash is a bijection, so equal hashes there are equal bytes.
        """
        padded = np.append(self.data, np.zeros(8, np.uint8))
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))  # the eight bytes from each place on
        size = ends - starts
        h = mix(size.astype(np.uint64) * _M3)
        live = np.flatnonzero((size > 0) & (size <= LONG))
        at, left = starts[live], size[live]
        while len(live):
            h[live] = mix((h[live] ^ (eight[at] & _LOW[np.minimum(left, 8)])) * _M3)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
        raw = memoryview(np.ascontiguousarray(self.data))
        for k in np.flatnonzero(size > LONG).tolist():
            h[k] = int.from_bytes(blake2b(raw[starts[k] : ends[k]], digest_size=8).digest(), "little")
        return h

    def hash_words(self) -> np.ndarray:
        """A hash for each word."""
        return self.hash_spans(self.starts, self.ends)

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each text are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in runs of rows of about ``most`` bytes of text; texts are never cut."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(sizes, base + most, "right")))
        part = batch.slice(at, stop - at)
        yield part, Texts(part.column(column))
        at = stop


def span_union(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Boolean array of ``size``: positions inside any [start, end)."""
    delta = np.zeros(size + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0
