"""Suffix-array dedup (operator 12): a logarithmic family of suffix arrays in each bucket of suffixes.

A match of SPAN bytes holds at least one anchor: the rightmost least hash among its runs of ANCHOR bytes, which its bytes
alone decide. So suffixes are indexed by their anchors (a sparse suffix array), and neighbouring strings of SPAN bytes
with one anchor form a block. The documents are dealt by a hash into groups; a group is a batch.

1. `_arrays`: each batch sorts its blocks by (anchor, block) and deals the sorted array out to buckets of anchors.
2. `_families`: a bucket takes the arrays of all batches into a `Family`. An array joins as level 0; two levels of equal
   rank are merge-scanned and become one of the next rank. Of blocks that match in full the scan keeps those of the
   least document and reports the others. What is left of an anchor with several different blocks is asked for again.
3. `_texts`, `_long_matches`: the bytes of these blocks go to buckets by anchor, where every string of SPAN bytes is a
   suffix in a second family, sorted by its bytes and merged by the same rule.
4. `_strip`: each batch takes out what was reported of its documents.

No pairs are made: a block that stands in a third of all documents is one entry a batch. An anchor with many different
blocks (over WIDE in a batch or WIDE_ALL in a bucket) has its strings dealt out one by one by their own hash. The whole
is one plan: the exchange of the texts is made once and read by all three steps; nothing is collected. A bucket holds
about PART_BYTES of text, so arrays fit in a worker however many documents there are.

Blocks are compared by 32 bits of the anchor's hash, which the bucket extends, and 48 of the block's; blocks are under
100 bytes long and their hash mixes eight bytes at a time. Strings in step 3 are compared byte for byte.

Defined cases: null or empty text has no bytes and keeps an empty one; a text under SPAN bytes keeps all; rows without
doc_id keep all and take from nobody; rows that share a doc_id take nothing from one another; a very long text is
worked through in pieces; kept bytes need not be valid UTF-8; other columns are dropped, clashing names do no harm; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm.arrow_text import buffers, mix, ranges, span_hashes
from dossierflow.session import read_table

SPAN, ANCHOR = 50, 16
#: Bytes of text a group and, about, a bucket; bytes worked on at a time.
PART_BYTES, PIECE_BYTES = 8 << 20, 1 << 20
#: Different blocks of one anchor in a batch, and in a bucket, beyond which its strings are dealt out one by one.
WIDE, WIDE_ALL = 64, 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)
_PACKET = "bucket int, grp int, kind int, n int, data binary, bytes binary"
#: Kinds of packets: blocks of a batch, blocks that match in full, blocks asked for, blocks with their bytes.
BLOCKS, FULL, ASKED, TEXTS = range(4)
#: Fields of an entry. `sort` is the anchor's 32 bits over 32 of the block, `check` 16 more of the block.
_BLOCK = np.dtype([("sort", "<u8"), ("check", "<u2"), ("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("n", "u1")])
_RANGE = np.dtype([("row", "<u4"), ("at", "<u4"), ("n", "<u4")])
_ASK = np.dtype([("anchor", "<u4"), ("row", "<u4"), ("at", "<u4"), ("n", "u1"), ("wide", "u1")])
_TEXT = np.dtype([("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("n", "u1")])
#: `n` of an entry that only says that its anchor is wide.
_MARK = 255


def _pack(entries: np.ndarray) -> bytes:
    """Entries byte plane by byte plane, which lets the exchange compress sorted and small fields."""
    return entries.view(np.uint8).reshape(len(entries), -1).T.tobytes()


def _unpack(data: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def _packets(rows: list[tuple]) -> pa.RecordBatch:
    names, types = zip(*(x.split() for x in _PACKET.split(", ")), strict=True)
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], list(names))


def _runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Begin and end of each run of equal values."""
    edge = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return list(zip(edge.tolist(), [*edge[1:].tolist(), len(values)], strict=False))


def _dealt(entries: np.ndarray, bucket: np.ndarray, group: int, kind: int) -> list[tuple]:
    """Packets of the entries by bucket, in the order given within each."""
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    return [(int(bucket[a]), group, kind, b - a, _pack(entries[a:b]), b"") for a, b in _runs(bucket)]


class Family:
    """Sorted arrays of entries in levels; two levels of one rank merge into one of the next.

    `same` tells for a sorted array which entries equal the one before. Of equal entries those of the least `doc` stay,
    the rest go to `report` as covered by a smaller document.
    """

    def __init__(self, sort: Callable[[np.ndarray], np.ndarray], same: Callable[[np.ndarray], np.ndarray], report: Callable[[np.ndarray], None]):
        self.levels: dict[int, np.ndarray] = {}
        self.sort, self.same, self.report = sort, same, report

    def _scan(self, entries: np.ndarray) -> np.ndarray:
        """The merge scan: entries sorted and rid of those that a smaller document covers."""
        entries = entries[self.sort(entries)]
        if len(entries) < 2:
            return entries
        starts = np.flatnonzero(~self.same(entries))
        least = np.minimum.reduceat(entries["doc"], starts)
        covered = entries["doc"] > np.repeat(least, np.diff(np.append(starts, len(entries))))
        if covered.any():
            self.report(entries[covered])
            entries = entries[~covered]
        return entries

    def add(self, batch: np.ndarray) -> None:
        array, rank = self._scan(batch), 0
        while rank in self.levels:
            array, rank = self._scan(np.concatenate([self.levels.pop(rank), array])), rank + 1
        self.levels[rank] = array

    def whole(self, kind: np.dtype) -> np.ndarray:
        """All levels merged into one, the small ones first."""
        array = np.zeros(0, kind)
        for rank in sorted(self.levels):
            array = self._scan(np.concatenate([array, self.levels[rank]]))
        self.levels = {rank: array for rank in [max(self.levels, default=0)]}
        return array


def _rightmost_least(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams the place of its rightmost least one, by the upper 42 bits; a piece has under 4 million grams."""
    low = np.uint64((1 << 22) - 1)
    best, have = (grams & ~low) | (low - np.arange(len(grams), dtype=np.uint64)), 1
    while have * 2 <= width:
        best, have = np.minimum(best[:-have], best[have:]), have * 2
    if have < width:
        best = np.minimum(best[: len(best) - (width - have)], best[width - have :])
    return (low - (best & low)).astype(np.int64)


def _blocks_of(data: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks of a piece: first byte, number of strings, anchor hash, block hash. `row` tells the text of each byte."""
    if len(data) < SPAN:
        return (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    eight = _eights(data)
    mixed = mix(eight ^ _ODD)
    grams = mix(eight[: len(data) - ANCHOR + 1] * _ODD ^ mixed[ANCHOR - 8 : len(data) - 7])
    picks = _rightmost_least(grams, SPAN - ANCHOR + 1)
    whole = np.flatnonzero(row[: len(picks)] == row[SPAN - 1 :])
    if not len(whole):
        return (whole, whole, np.zeros(0, np.uint64), np.zeros(0, np.uint64))
    pick = picks[whole]
    edge = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (whole[1:] != whole[:-1] + 1)]))
    begin, n = whole[edge], np.diff(np.append(edge, len(whole)))
    anchor = pick[edge]
    block = span_hashes(mixed, begin, begin + n + SPAN - 8) ^ (anchor - begin).astype(np.uint64) * _ODD
    return begin, n, grams[anchor], mix(block)


def _group(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A batch in its own order, the bytes of its texts and their offsets."""
    table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("uid", "doc_id", "text")])).combine_chunks()
    text = table.column("text")
    parts = [buffers(c) for c in text.chunks] if table.num_rows else []
    sizes = np.concatenate([np.diff(o) for _, o in parts]) if parts else np.zeros(0, np.int64)
    data = parts[0][0] if len(parts) == 1 else np.concatenate([d for d, _ in parts]) if parts else np.zeros(0, np.uint8)
    return table, data, np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _arrays(buckets: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table, data, offsets = _group(table)
        missing = table.column("doc_id").is_null().to_numpy()
        doc = table.column("doc_id").fill_null(0).to_numpy()
        found = []
        for start in range(0, len(data), PIECE_BYTES):
            piece = data[start : start + PIECE_BYTES + SPAN - 1]
            first, last = np.searchsorted(offsets, [start, start + len(piece)], side="right") - 1
            inside = np.clip(offsets[first : last + 2], start, start + len(piece)) - start
            row = np.repeat(np.arange(first, first + len(inside) - 1), np.diff(inside))
            begin, n, anchor, block = _blocks_of(piece, row)
            entries = np.zeros(len(begin), _BLOCK)
            owner = row[begin] if len(begin) else np.zeros(0, np.int64)
            entries["sort"] = (anchor << np.uint64(32)) | (block >> np.uint64(32))
            entries["check"] = (block & np.uint64(0xFFFF)).astype(np.uint16)
            entries["doc"], entries["row"], entries["at"], entries["n"] = doc[owner], owner, start + begin - offsets[owner], n
            keep = ~missing[owner]
            found.append((entries[keep], (anchor[keep] >> np.uint64(32)) % np.uint64(buckets)))
        if not found:
            return pa.Table.from_batches([_packets([])])
        entries, bucket = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(bucket, kind="stable")
        entries, bucket = entries[order], bucket[order].astype(np.int64)
        rows, edge = [], np.searchsorted(bucket, np.arange(buckets + 1))
        full: list[np.ndarray] = []
        for b in np.flatnonzero(np.diff(edge)):
            family = Family(_by_block, _same_block, full.append)
            family.add(entries[edge[b] : edge[b + 1]])
            array, asked = _narrowed(family.whole(_BLOCK), WIDE)
            rows.append((int(b), key[0].as_py(), BLOCKS, len(array), _pack(array), b""))
            if len(asked):
                rows.append((int(b), key[0].as_py(), ASKED, len(asked), _pack(asked), b""))
        if full:
            covered = _as_ranges(np.concatenate(full))
            rows.append((key[0].as_py() % buckets, key[0].as_py(), FULL, len(covered), _pack(covered), b""))
        return pa.Table.from_batches([_packets(rows)])

    return run


def _by_block(e: np.ndarray) -> np.ndarray:
    return np.argsort(e["sort"], kind="stable")


def _same_block(e: np.ndarray) -> np.ndarray:
    """Blocks that differ in `check` alone, which is next to impossible, count as different wherever they are not neighbours, and are compared byte for byte."""
    return np.concatenate([[False], (e["sort"][1:] == e["sort"][:-1]) & (e["check"][1:] == e["check"][:-1]) & (e["n"][1:] != _MARK) & (e["n"][:-1] != _MARK)])


def _anchors(array: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry of a sorted array: the number of its anchor, and how many different blocks that has."""
    anchor = array["sort"] >> np.uint64(32)
    number = np.cumsum(np.concatenate([[True], anchor[1:] != anchor[:-1]])) - 1 if len(array) else np.zeros(0, np.int64)
    different = np.bincount(number[~_same_block(array)]) if len(array) else np.zeros(0, np.int64)
    return number, different


def _asked(entries: np.ndarray, wide: np.ndarray) -> np.ndarray:
    out = np.zeros(len(entries), _ASK)
    out["anchor"] = (entries["sort"] >> np.uint64(32)).astype(np.uint32)
    out["row"], out["at"], out["n"], out["wide"] = entries["row"], entries["at"], entries["n"], wide
    return out


def _narrowed(array: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """An array in which every wide anchor is one mark, and the blocks of those anchors as asked for."""
    number, different = _anchors(array)
    if not len(array) or different.max() <= most:
        return array, np.zeros(0, _ASK)
    wide = (different > most)[number]
    marks = array[wide][[a for a, _ in _runs(number[wide])]]
    marks["n"] = _MARK
    rest = np.concatenate([array[~wide], marks])
    return rest[_by_block(rest)], _asked(array[wide], np.ones(int(wide.sum()), np.uint8))


def _as_ranges(entries: np.ndarray) -> np.ndarray:
    """(row, at, n) with neighbouring strings of a row in one range."""
    out = np.zeros(len(entries), _RANGE)
    for k in ("row", "at", "n"):
        out[k] = entries[k]
    out = out[np.lexsort((out["at"], out["row"]))]
    if len(out) < 2:
        return out
    end = out["at"].astype(np.int64) + out["n"]
    fresh = np.concatenate([[True], (out["row"][1:] != out["row"][:-1]) | (out["at"][1:] != end[:-1])])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(out)) - 1
    merged = out[first]
    merged["n"] = end[last] - merged["at"]
    return merged


def _grouped(entries: np.ndarray, group: np.ndarray, bucket: int, kind: int) -> list[tuple]:
    return [(bucket, g, kind, n, data, b"") for g, _, _, n, data, _ in _dealt(entries, group, bucket, kind)]


def _families(key: tuple, table: pa.Table) -> pa.Table:
    """One bucket: all batches' arrays through a family, then what is to be looked at byte for byte."""
    bucket, rows = key[0].as_py(), []
    reported: list[np.ndarray] = []
    kind = np.dtype([*_BLOCK.descr, ("grp", "<i4")])
    family = Family(_by_block, _same_block, reported.append)
    for group, what, data in sorted(zip(*(table.column(c).to_pylist() for c in ("grp", "kind", "data")), strict=True), key=lambda r: r[:2]):
        if what != BLOCKS:
            entries = _unpack(data, _RANGE if what == FULL else _ASK)
            rows.append((bucket, group, what, len(entries), data, b""))
            continue
        entries = _unpack(data, _BLOCK)
        batch = np.zeros(len(entries), kind)
        for name in _BLOCK.names:
            batch[name] = entries[name]
        batch["grp"] = group
        family.add(batch)
    left = family.whole(kind)
    number, different = _anchors(left)
    if len(left):
        marked = np.bincount(number, left["n"] == _MARK) > 0
        wide = (marked | (different > WIDE_ALL))[number]
        again = (wide | (different > 1)[number]) & (left["n"] != _MARK)
        rows += _grouped(_asked(left[again], wide[again]), left["grp"][again], bucket, ASKED)
    if reported:
        covered = np.concatenate(reported)
        covered = covered[np.argsort(covered["grp"], kind="stable")]
        for a, b in _runs(covered["grp"]):
            merged = _as_ranges(covered[a:b])
            rows.append((bucket, int(covered["grp"][a]), FULL, len(merged), _pack(merged), b""))
    return pa.Table.from_batches([_packets(rows)])


def _texts(buckets: int):
    """Adds their bytes to the blocks asked for; ranges pass."""

    def run(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
        group, out = key[0].as_py(), []
        table, data, offsets = _group(docs)
        doc = table.column("doc_id").fill_null(0).to_numpy()
        asked = [np.zeros(0, _ASK)]
        home = []
        for bucket, kind, packed in zip(*(found.column(c).to_pylist() for c in ("bucket", "kind", "data")), strict=True):
            if kind == FULL:
                out.append((group % buckets, group, FULL, len(packed) // _RANGE.itemsize, packed, b""))
            else:
                asked.append(_unpack(packed, _ASK))
                home.append(np.full(len(asked[-1]), bucket))
        ask = np.concatenate(asked)
        home = np.concatenate([np.zeros(0, np.int64), *home]).astype(np.int64)
        wide = ask["wide"] > 0
        # An anchor's strings meet in a bucket of its own hash; those of wide anchors are blocks of one string each.
        owner, place = ranges(np.where(wide, ask["n"], 1).astype(np.int64))
        entries = np.zeros(len(owner), _TEXT)
        entries["row"], entries["at"], entries["n"] = ask["row"][owner], ask["at"][owner] + place, np.where(wide, 1, ask["n"])[owner]
        entries["doc"] = doc[entries["row"]]
        begin = offsets[entries["row"]] + entries["at"]
        bucket = (mix(ask["anchor"].astype(np.uint64) + home.astype(np.uint64) * _ODD) % np.uint64(buckets)).astype(np.int64)[owner]
        alone = np.flatnonzero(wide[owner])
        for part in np.array_split(alone, 1 + len(alone) * SPAN // (8 * PIECE_BYTES)):
            if len(part):
                eight = np.ascontiguousarray(data[begin[part][:, None] + np.arange(SPAN - SPAN % 8)]).view("<u8")
                h = np.full(len(part), 7, np.uint64)
                for column in eight.T:
                    h = mix(h * _ODD ^ column)
                bucket[part] = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        entries, begin, bucket = entries[order], begin[order], bucket[order]
        for a, b in _runs(bucket):
            which, step = ranges(entries["n"][a:b].astype(np.int64) + SPAN - 1)
            out.append((int(bucket[a]), group, TEXTS, b - a, _pack(entries[a:b]), data[begin[a:b][which] + step].tobytes()))
        return pa.Table.from_batches([_packets(out)])

    return run


_STRING = np.dtype([("doc", "<i8"), ("row", "<u4"), ("at", "<u4"), ("n", "u1"), ("grp", "<i4"), ("suffix", f"S{SPAN}")])


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on, zeros behind the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view("<u8").ravel()


def _string_hashes(text: bytes) -> np.ndarray:
    """Hashes of all SPAN-byte strings of a text by first byte."""
    data = np.frombuffer(text, np.uint8)
    eight, count = _eights(data), max(0, len(data) - SPAN + 1)
    out = np.full(count, 7, np.uint64)
    for at in [*range(0, SPAN - 7, 8), SPAN - 8]:
        out = mix(out * _ODD ^ eight[at : at + count])
    return out


def _among(sorted_: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def _long_matches(key: tuple, table: pa.Table) -> pa.Table:
    """One bucket of blocks with their bytes: the suffixes of all batches, cut to SPAN bytes, through a family."""
    bucket, rows, reported = key[0].as_py(), [], []
    same = lambda e: np.concatenate([[False], e["suffix"][1:] == e["suffix"][:-1]])
    family = Family(lambda e: np.argsort(e["suffix"], kind="stable"), same, lambda e: reported.append(e[["row", "at", "n", "grp"]].copy()))
    order = ("grp", "kind", "data", "bytes")
    batches = []
    for group, kind, data, text in sorted(zip(*(table.column(c).to_pylist() for c in order), strict=True), key=lambda r: r[:2]):
        if kind == FULL:
            rows.append((bucket, group, FULL, len(data) // _RANGE.itemsize, data, b""))
            continue
        blocks = _unpack(data, _TEXT)
        owner, place = ranges(blocks["n"].astype(np.int64))
        size = blocks["n"].astype(np.int64) + SPAN - 1
        start = (np.cumsum(size) - size)[owner] + place
        batches.append((group, blocks, owner, place, start, np.frombuffer(text, np.uint8), _string_hashes(text)[start]))
    # Suffixes whose hash stands alone in the bucket match nothing.
    every = np.sort(np.concatenate([np.zeros(0, np.uint64), *(b[-1] for b in batches)]))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    for group, blocks, owner, place, start, text, hashes in batches:
        use = np.flatnonzero(_among(again, hashes))
        owner, place = owner[use], place[use]
        strings = np.zeros(len(use), _STRING)
        strings["doc"], strings["row"], strings["at"], strings["n"], strings["grp"] = blocks["doc"][owner], blocks["row"][owner], blocks["at"][owner] + place, 1, group
        if len(use):
            windows = np.lib.stride_tricks.sliding_window_view(text, SPAN)
            strings["suffix"] = windows[start[use]].copy().view(f"S{SPAN}").ravel()
        family.add(strings)
    family.whole(_STRING)
    if reported:
        covered = np.concatenate(reported)
        covered = covered[np.argsort(covered["grp"], kind="stable")]
        for a, b in _runs(covered["grp"]):
            merged = _as_ranges(covered[a:b])
            rows.append((bucket, int(covered["grp"][a]), FULL, len(merged), _pack(merged), b""))
    return pa.Table.from_batches([_packets(rows)])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _strip(key: tuple, docs: pa.Table, found: pa.Table) -> pa.Table:
    table, data, offsets = _group(docs)
    gone = np.concatenate([np.zeros(0, _RANGE), *(_unpack(d, _RANGE) for d in found.column("data").to_pylist())])
    edge = np.zeros(len(data) + 1, np.int32)
    begin = offsets[gone["row"]] + gone["at"]
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + gone["n"] + SPAN - 1, -1)
    removed = np.cumsum(edge[:-1]) > 0
    first = removed.copy()
    first[1:] &= ~removed[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    first[starts] = removed[starts]
    total = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    lost, kept = total(removed), data[~removed]
    ends = np.concatenate([[0], np.cumsum(np.diff(offsets) - lost)])
    texts = [kept[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
    return pa.table(
        {"doc_id": table.column("doc_id"), "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(lost.astype(np.int64)), "n_spans": pa.array(total(first).astype(np.int64)), "kept": pa.array(texts, pa.binary())}
    )


def remove_seen(docs: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary): texts without the bytes that a smaller document has in SPAN-byte strings."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2, -(-size // part_bytes))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", "text").alias("uid"))
    keyed = keyed.withColumn("grp", F.pmod("uid", F.lit(parts)).cast("int"))
    arrays = keyed.groupBy("grp").applyInArrow(_arrays(parts), _PACKET)
    found = arrays.groupBy("bucket").applyInArrow(_families, _PACKET)
    texts = keyed.groupBy("grp").cogroup(found.groupBy("grp")).applyInArrow(_texts(parts), _PACKET)
    ranges_ = texts.groupBy("bucket").applyInArrow(_long_matches, _PACKET)
    return keyed.groupBy("grp").cogroup(ranges_.groupBy("grp")).applyInArrow(_strip, _RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_seen(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = """
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
bytes AS (SELECT doc_id, t, unnest(range(1, octet_length(t) + 1)) AS p FROM texts),
strings AS (SELECT doc_id, p, CASE WHEN p + 49 <= octet_length(t) THEN t[p:p + 49] END AS s, t[p:p] AS b FROM bytes),
firsts AS (SELECT s, min(doc_id) AS least FROM strings WHERE s IS NOT NULL GROUP BY s),
seen AS (SELECT doc_id, p, b, coalesce(least < doc_id, false) AS hit FROM strings LEFT JOIN firsts USING (s)),
covered AS (SELECT doc_id, p, b, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM seen),
runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS starts FROM covered),
digests AS (
  SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (WHERE gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans,
    coalesce(string_agg(hex(b), '' ORDER BY p) FILTER (WHERE NOT gone), '') AS kept
  FROM runs GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents d LEFT JOIN digests USING (doc_id)
"""
