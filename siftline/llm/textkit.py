"""Vectorised word and shingle hashing over Arrow string columns.

Texts are handled as UTF-8 bytes. All separators used here are ASCII, so cutting bytes is cutting
code points. Work arrays are bounded by STEP bytes of text, however long a document is.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 1 << 19

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE_LOWER = _BYTE[_LOWER]
_BASE = np.uint64(0x9E3779B97F4A7C15 | 5)
_BASE_INV = np.uint64(pow(int(_BASE), -1, 2**64))
_power: dict[str, np.ndarray] = {}


def byte_class(separators: bytes) -> np.ndarray:
    """True for the bytes that belong to words."""
    table = np.ones(256, dtype=bool)
    table[np.frombuffer(separators, dtype=np.uint8)] = False
    return table


#: words [^\x20\x09-\x0D]+
SPACED = byte_class(b"\x20\x09\x0a\x0b\x0c\x0d")
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lowered: digits, ASCII letters and all that is not ASCII
PLAIN = np.zeros(256, dtype=bool)
PLAIN[48:58] = PLAIN[65:91] = PLAIN[97:123] = True
PLAIN[128:] = True


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BASE_INV)):
            steps = np.full(max(n, STEP), base, dtype=np.uint64)
            steps[0] = 1
            _power[name] = np.multiply.accumulate(steps)
    return _power["up"], _power["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, head: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lowered, in order, and for each row the index of its first word (n + 1 long).

    With head, only the first head bytes of each word are hashed.
    """
    found, first, at, total = [], [], 0, len(data)
    cut = np.zeros(total + 1, dtype=bool)
    cut[offsets] = True
    while at < total:
        end = min(total, at + STEP)
        if end < total and not cut[end] and table[data[end]] and table[data[end - 1]]:  # end at a separator or a row's end
            back = np.flatnonzero(~table[data[at:end]] | cut[at:end])
            if len(back) and back[-1] > 0:
                end = at + int(back[-1])
            else:
                ahead = np.flatnonzero(~table[data[end:]] | cut[end:total])
                end = end + int(ahead[0]) if len(ahead) else total
        part = data[at:end]
        inside = table[part]
        edge = cut[at : end + 1]
        before = np.empty(len(part), dtype=bool)
        before[0], before[1:] = False, inside[:-1]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.empty(len(part), dtype=bool)
        after[-1], after[:-1] = False, inside[1:]
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        if head:
            ends = np.minimum(ends, starts + head)
        up, down = _powers(len(part) + 1)
        sums = np.empty(len(part) + 1, dtype=np.uint64)
        sums[0] = 0
        np.cumsum(_BYTE_LOWER[part] * up[: len(part)], out=sums[1:])
        found.append(mix((sums[ends] - sums[starts]) * down[starts]))
        first.append(starts + at)
        at = end
    hashes = np.concatenate(found) if found else np.zeros(0, np.uint64)
    begins = np.concatenate(first) if first else np.zeros(0, np.int64)
    return hashes, np.searchsorted(begins, offsets)


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k words; len(hashes) - k + 1 of them (none for shorter input)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(k):
        out = mix(out + hashes[j : j + n])  # order counts: a sum of multiples would let some permutations collide
    return out


def shingle_sets(hashes: np.ndarray, first: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its sorted distinct shingles: with fewer than k words the whole sequence as one, without words none."""
    every, out = shingles(hashes, k), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = b - a
        out.append(np.unique(every[a : b - k + 1]) if n >= k else shingles(hashes[a:b], n) if n else every[:0])
    return out


def relax() -> None:
    """Give memory that is not in use back to the system: a worker stays alive beside the next stage's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def row_blocks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = STEP) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut batches to runs of rows of about limit bytes of text (one row at least), with their bytes and offsets."""
    for batch in batches:
        data, offsets = column_bytes(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
            end = min(end, n)
            yield batch.slice(at, end - at), data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
            at = end
        del data, offsets
    relax()
