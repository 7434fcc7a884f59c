"""Numpy helpers over the UTF-8 bytes of Arrow string columns: runs of word bytes and their 64-bit hashes.

Tasks see one bounded chunk of rows at a time; a chunk holds whole texts, so a single very long text makes a chunk of its own.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

CHUNK_BYTES = 512 << 10
LONG_RUN = 64
_MUL = np.uint64(0x9E3779B97F4A7C15 | 1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Class tables over bytes. White space is U+0020 and U+0009 to U+000D; all other bytes belong to words.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
#: Letters: ASCII letters and every byte of a longer UTF-8 sequence.
LETTERS = np.zeros(256, bool)
LETTERS[ord("A") : ord("Z") + 1] = LETTERS[ord("a") : ord("z") + 1] = LETTERS[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads the bits of 64-bit values (a bijection)."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes in column ``text``, one row at least."""
    for batch in batches:
        _, off = utf8(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def runs(member: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row numbers of the maximal runs of member bytes; no run crosses a row."""
    n = len(member)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[0] = last[-1] = True
    first[1:], last[:-1] = ~member[:-1], ~member[1:]
    full = off[1:] > off[:-1]
    first[off[:-1][full]] = last[off[1:][full] - 1] = True
    starts, ends = np.flatnonzero(member & first), np.flatnonzero(member & last) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def run_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    size = ends - starts
    h = np.zeros(len(starts), np.uint64)
    long = size > LONG_RUN
    order = np.argsort(-np.where(long, 0, size), kind="stable")
    begin, count = starts[order], np.where(long, 0, size)[order]
    acc = np.zeros(len(order), np.uint64)
    for j in range(int(count[0]) if len(count) else 0):
        k = int(np.searchsorted(-count, -j, "left"))
        acc[:k] = acc[:k] * _MUL + raw[begin[:k] + j] + np.uint64(1)
    h[order] = acc
    for i in np.flatnonzero(long):
        h[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    return mix64(h + size.astype(np.uint64) * _M1)


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The indexes start, start + 1, ... of every span, one after another."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ahead = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return np.repeat(starts - ahead, sizes) + np.arange(total)


def unlike(a: np.ndarray, a_at: np.ndarray, a_size: np.ndarray, b: np.ndarray, b_at: np.ndarray, b_size: np.ndarray, block: int = 1 << 17) -> np.ndarray:
    """The places at which the runs of ``a`` and ``b`` differ in length or content; about ``block`` elements are held at once."""
    wrong = a_size != b_size
    same = np.flatnonzero(~wrong)
    ends = np.cumsum(a_size[same])
    at = 0
    while at < len(same):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + block, "right")))
        part = same[at:to]
        off = np.flatnonzero(a[spans(a_at[part], a_size[part])] != b[spans(b_at[part], a_size[part])])
        wrong[part[np.searchsorted(np.cumsum(a_size[part]), off, "right")]] = True
        at = to
    return np.flatnonzero(wrong)


OTHER, LETTER, NUMBER, SPACE = range(4)
#: Code points with the Unicode property White_Space; fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def code_point_classes() -> np.ndarray:
    """OTHER, LETTER, NUMBER or SPACE of every code point, by its general category."""
    table = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for i in range(0x110000):
        if (k := kinds.get(unicodedata.category(chr(i))[0])) is not None:
            table[i] = k
    table[WHITE_SPACE] = SPACE
    return table


def code_points(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, the byte at which each begins (and the end), and the rows' offsets in code points."""
    cp = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
    return cp, at, np.searchsorted(at, off)
