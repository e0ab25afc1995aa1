"""Vectorised work on Arrow string columns: words, word hashes and n-gram hashes over whole batches.

All functions take the UTF-8 bytes of many texts at once, so that no Python code runs per row or per word.
White space is [\\x20\\x09-\\x0D]; those bytes never occur inside a multi-byte UTF-8 sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
U64 = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


def _byte_table(seed: int, fold_ascii: bool) -> np.ndarray:
    table = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
    if fold_ascii:
        table[65:91] = table[97:123]
    return table


_TABLES = {fold: _byte_table(20240229, fold) for fold in (False, True)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: All ASCII bytes but letters and digits part words.
MARKS = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(size, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        have = (out[0], out[1])
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its row offsets into them; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut so that their texts have about `limit` bytes at most; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = buffers(batch.column(batch.schema.get_field_index(column)))
        begin = 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1
            end = min(max(end, begin + 1), batch.num_rows)
            yield batch.slice(begin, end - begin)
            begin = end


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words in bytes, and the row of each; `separators` says which bytes part words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~separators[data]
    first = np.zeros(len(data), dtype=bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    before = np.empty(len(data), dtype=bool)
    before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | first))
    after = np.empty(len(data), dtype=bool)
    after[-1], after[:-1] = True, ~solid[1:] | first[1:]
    ends = np.flatnonzero(solid & after) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_ascii: bool = False) -> np.ndarray:
    """64-bit hashes of the words; equal words have equal hashes wherever they stand."""
    up, down = powers(_BYTE_BASE, len(data) + 1)
    prefix = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_TABLES[fold_ascii][data] * up[: len(data)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def strong_word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold_ascii: bool = False) -> np.ndarray:
    """As word_hashes, but each byte is mixed with its place before they are added up, so that no two words share a hash by
    their build (a polynomial modulo 2**64 has such pairs: a Thue-Morse word of 2048 letters and its complement)."""
    sizes = ends - starts
    owner, place = ranges(sizes)
    mixed = mix(_TABLES[fold_ascii][data[starts[owner] + place]] + place.astype(np.uint64) * U64(_WORD_BASE))
    total = np.zeros(len(mixed) + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    edge = np.concatenate([[0], np.cumsum(sizes)])
    return mix(total[edge[1:]] - total[edge[:-1]] + sizes.astype(np.uint64))


def gram_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, by first word; runs over the border of two rows are included."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    up, down = powers(_WORD_BASE, len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=prefix[1:])
    k = len(hashes) - n + 1
    return mix((prefix[n:] - prefix[:k]) * down[:k])


def span_hashes(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the word runs [begins, ends)."""
    up, down = powers(_WORD_BASE, len(hashes) + 1)
    prefix = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * up[: len(hashes)], out=prefix[1:])
    return mix((prefix[ends] - prefix[begins]) * down[begins] + (ends - begins).astype(np.uint64))


def ranges(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 0, 3): the owners 0 0 2 2 2 and the places 0 1 0 1 2."""
    owners = np.repeat(np.arange(len(counts)), counts)
    places = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts)
    return owners, places
