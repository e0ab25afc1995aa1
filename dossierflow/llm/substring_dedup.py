"""Substring dedup (operator 8): seed and extend on winnowed anchors.

Every window of WINDOW words picks one anchor: the rightmost least hash among its runs of ANCHOR words. The choice
depends on the window's words alone, so equal windows pick equal anchors (winnowing). Neighbouring windows with the
same anchor form a block; a block's anchor is the seed, its words on both sides the extension.

1. Anchors that occur once are dropped: none of their windows can repeat.
2. Blocks that are equal word for word repeat as a whole: they are counted by (anchor, block hash), so that a
   thousand copies cost a row each and no pairs.
3. Only blocks that share an anchor but differ are extended window by window: the windows of one representative
   a block are compared by hash. Maximal repeats are the unions of the repeated windows.

Hashes have 64 bits. Rows are identified by a hash of (doc_id, text), so repeated rows and shared ids do no harm.
Defined cases: null or empty text has no words and keeps an empty text; a text shorter than WINDOW words keeps all;
extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm.arrow_text import buffers, gram_hashes, ranges, slices, span_hashes, strong_word_hashes, words
from dossierflow.llm.durable import cut
from dossierflow.session import read_table

WINDOW, ANCHOR = 35, 18


def _picks(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of `width` grams: the place of its rightmost least one."""
    better = lambda a, b: np.where(grams[b] <= grams[a], b, a)
    best, have = np.arange(len(grams)), 1
    while have * 2 <= width:
        best, have = better(best[:-have], best[have:]), have * 2
    if have < width:
        best = better(best[: len(best) - (width - have)], best[width - have :])
    return best


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, the row of each word, and the first word of each row."""
    data, offsets = buffers(column)
    starts, ends, rows = words(data, offsets)
    return strong_word_hashes(data, starts, ends), rows, np.searchsorted(rows, np.arange(len(column) + 1))


def _blocks(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, rows, first = _hashed(batch.column(1))
            if len(hashes) < window:
                continue
            grams = gram_hashes(hashes, anchor)
            picks = _picks(grams, window - anchor + 1)
            whole = np.flatnonzero(rows[: len(picks)] == rows[window - 1 :])
            if not len(whole):
                continue
            pick, row = picks[whole], rows[whole]
            edge = np.flatnonzero(np.concatenate([[True], (pick[1:] != pick[:-1]) | (row[1:] != row[:-1])]))
            n = np.diff(np.append(edge, len(whole)))
            begin, at, row = whole[edge], pick[edge], row[edge]
            block = span_hashes(hashes, begin, begin + n + window - 1) ^ (at - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": pa.array(grams[at].view(np.int64)),
                    "block": pa.array(block.view(np.int64)),
                    "uid": batch.column(0).take(pa.array(row)),
                    "start": pa.array((begin - first[row]).astype(np.int32)),
                    "n": pa.array(n.astype(np.int32)),
                }
            )

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, _, first = _hashed(batch.column(1))
            grams = gram_hashes(hashes, window)
            asked = batch.column(2)
            owner = np.repeat(np.arange(len(asked)), np.diff(asked.offsets.to_numpy()))
            flat = asked.flatten()
            start, n, dup = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            which, place = ranges(n)
            at = start[which] + place
            row = owner[which]
            yield pa.RecordBatch.from_pydict(
                {
                    "hash": pa.array(grams[first[row] + at].view(np.int64)),
                    "uid": batch.column(0).take(pa.array(row)),
                    "start": pa.array(at.astype(np.int32)),
                    "dup": pa.array(dup[which]),
                }
            )

    return run


def _strip(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = batch.column(1).fill_null("").to_pylist()
            spans = batch.column(2).to_pylist()
            total, removed, kept = [], [], []
            for text, found in zip(texts, spans, strict=True):
                have = text.encode().split()
                gone = 0
                if found:
                    edge = np.zeros(len(have) + 1, np.int32)
                    np.add.at(edge, [s["start"] for s in found], 1)
                    np.add.at(edge, [s["start"] + s["n"] + window - 1 for s in found], -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = len(have) - int(keep.sum())
                    rest = list(compress(have, keep.tolist()))
                else:
                    rest = have
                total.append(len(have))
                removed.append(gone)
                kept.append(b" ".join(rest).decode())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept_text": pa.array(kept, pa.string())})

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """uid, start, n: word positions at which n windows in a row repeat somewhere. `docs` has uid, doc_id, text."""
    blocks = docs.select("uid", "text").mapInArrow(_blocks(window, anchor), "anchor long, block long, uid long, start int, n int")
    seeds = blocks.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    shared = cut(blocks.join(seeds, "anchor", "left_semi"), "substring-seeds")
    kinds = cut(
        shared.groupBy("anchor", "block").agg(F.count("*").alias("c"), F.min(F.struct("uid", "start", "n")).alias("rep")),
        "substring-blocks",
    )
    alike = shared.join(kinds.where("c > 1").select("anchor", "block"), ["anchor", "block"], "left_semi").select("uid", "start", "n")
    odd = kinds.where("c = 1").select("anchor").distinct()
    asked = kinds.join(odd, "anchor", "left_semi").select("rep.uid", "rep.start", "rep.n", (F.col("c") > 1).alias("dup"))
    asked = asked.groupBy("uid").agg(F.collect_list(F.struct("start", "n", "dup")).alias("asked"))
    windows = cut(
        docs.join(asked, "uid").select("uid", "text", "asked").mapInArrow(_windows(window), "hash long, uid long, start int, dup boolean"),
        "substring-windows",
    )
    again = windows.groupBy("hash").agg(F.count("*").alias("c"), F.max("dup").alias("d")).where("c > 1 OR d").select("hash")
    extended = windows.where("NOT dup").join(again, "hash", "left_semi").select("uid", "start", F.lit(1).alias("n"))
    return alike.unionByName(extended)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))
    spans = repeated_spans(keyed, window, anchor).groupBy("uid").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return keyed.join(spans, "uid", "left").select("doc_id", "text", "spans").mapInArrow(_strip(window), "doc_id long, n_words long, n_removed long, kept_text string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
