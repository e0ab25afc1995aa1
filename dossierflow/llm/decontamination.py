"""Benchmark decontamination (operator 1): a BM25 index of test items with block-max pruning.

Every passage of the corpus is a query against the items. A document is cut into cells of as many words as the
longest item has, and two neighbouring cells are a passage, so each copy of an item lies whole in some passage.
Scores are BM25 with impacts divided by the item's own score: 1 means that every term of the item is there, and one
threshold TAU serves all items. Postings are grouped into blocks of BLOCK items with their greatest impact.

WAND's bound is used twice. Terms are taken in order of how common they are; an item's most common terms that
together weigh at most TAU / 2 are left to the second step, since a passage that lacks the rarer terms cannot reach
TAU. The rarer terms' block maxima are summed for each (passage, block), and a block is opened only if that sum and
what its items' common terms can add reach TAU. Opened blocks are scored in full; all items at or over TAU are kept.
Last, the item's first three quarters (question) and its rest (answer) must each share MIN_OVERLAP of their
word triples (pairs, single words, where shorter) with the passage.

The index is broadcast in shards of at most SHARD_ITEMS items and SHARD_TERMS term entries; more items mean more
passes, not a larger broadcast. Words are runs of letters, digits and non-ASCII characters, in lower case (A-Z).
Defined cases: null and empty texts have no passages; null, empty or wordless items are ignored; a document is reported once an
item, with its best passage; repeated rows are one document; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from dossierflow.llm.arrow_text import MARKS, buffers, gram_hashes, ranges, slices, word_hashes, words
from dossierflow.session import read_table

K1, B = 1.2, 0.75
TAU, MIN_OVERLAP = 0.6, 0.5
BLOCK = 8
SHARD_ITEMS, SHARD_TERMS = 50_000, 4_000_000
ANSWER_SHARE = 4


def _hashed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffers(column)
    starts, ends, rows = words(data, offsets, MARKS)
    return word_hashes(data, starts, ends, fold_ascii=True), rows


def _pieces(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the word triples, or of the whole where there are fewer than three words."""
    return gram_hashes(hashes, min(3, max(1, len(hashes))))


@dataclass
class Index:
    """One shard. Terms are sorted hashes; postings and items are in compressed sparse rows."""

    ids: list
    cell: int
    terms: np.ndarray
    item_at: np.ndarray
    item_terms: np.ndarray
    item_impacts: np.ndarray
    common: np.ndarray  # per block: the most that the common terms of one of its items weigh
    block_at: np.ndarray  # per term: its range in block_ids, block_max (rare terms only)
    block_ids: np.ndarray
    block_max: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    n_words: np.ndarray
    maybe: np.ndarray

    @staticmethod
    def build(rows: list[tuple], df: dict[int, int], total: int, mean: float) -> Index:
        """rows: (item_id, word hashes); df, total, mean: statistics over all items."""
        terms = np.unique(np.concatenate([h for _, h in rows]))
        idf = np.array([np.log(1 + (total - df[int(t)] + 0.5) / (df[int(t)] + 0.5)) for t in terms])
        at, own_terms, own_impacts, common, question, answer = [0], [], [], np.zeros(-(-len(rows) // BLOCK)), [], []
        owner, rare = [], []
        for j, (_, hashes) in enumerate(rows):
            t, tf = np.unique(hashes, return_counts=True)
            place = np.searchsorted(terms, t)
            impact = idf[place] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(hashes) / mean))
            impact /= impact.sum()
            order = np.lexsort((place, idf[place]))
            place, impact = place[order], impact[order]
            low = np.cumsum(impact) <= TAU / 2
            common[j // BLOCK] = max(common[j // BLOCK], impact[low].sum())
            own_terms.append(place)
            own_impacts.append(impact)
            rare.append(~low)
            owner.append(np.full(len(place), j))
            at.append(at[-1] + len(place))
            cut = len(hashes) - len(hashes) // ANSWER_SHARE
            question.append(np.unique(_pieces(hashes[:cut])))
            answer.append(np.unique(_pieces(hashes[cut:]) if cut < len(hashes) else _pieces(hashes)))
        item_terms, item_impacts = np.concatenate(own_terms), np.concatenate(own_impacts)
        keep = np.concatenate(rare)
        key, where = np.unique(item_terms[keep].astype(np.int64) * len(common) + np.concatenate(owner)[keep] // BLOCK, return_inverse=True)
        top = np.zeros(len(key))
        np.maximum.at(top, where, item_impacts[keep])
        maybe = np.zeros(1 << 20, bool)
        maybe[(terms & np.uint64(0xFFFFF)).astype(np.int64)] = True
        sizes = np.array([len(h) for _, h in rows])
        return Index([i for i, _ in rows], int(sizes.max()), terms, np.array(at), item_terms, item_impacts, common, np.searchsorted(key // len(common), np.arange(len(terms) + 1)), key % len(common), top, question, answer, sizes, maybe)

    def search(self, hashes: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, float, float, float]]:
        """(row, item, score, question overlap, answer overlap) of the verified passages of a slice."""
        near = np.flatnonzero(self.maybe[(hashes & np.uint64(0xFFFFF)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.terms, hashes[near]), len(self.terms) - 1)
        hit = self.terms[place] == hashes[near]
        near, place = near[hit], place[hit]
        if not len(near):
            return
        first = np.searchsorted(rows, rows)  # first word of each word's row
        cells_before = np.zeros(int(rows[-1]) + 2, np.int64)
        counts = np.bincount(rows, minlength=int(rows[-1]) + 1)
        cells_before[1:] = np.cumsum(-(-counts // self.cell) + 1)  # one empty cell parts the rows
        cell = cells_before[rows[near]] + (near - first[near]) // self.cell
        pair = np.unique(cell * len(self.terms) + place)
        at_cell, at_term = pair // len(self.terms), pair % len(self.terms)
        sizes = self.block_at[at_term + 1] - self.block_at[at_term]
        which, step = ranges(sizes)
        if not len(which):
            return
        posting = self.block_at[at_term[which]] + step
        blocks = len(self.common)
        key, where = np.unique(at_cell[which] * blocks + self.block_ids[posting], return_inverse=True)
        bound = np.bincount(where, self.block_max[posting])
        windows = np.unique(np.concatenate([key, key - blocks]))
        windows = windows[windows >= 0]

        def of(wanted: np.ndarray) -> np.ndarray:
            spot = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
            return np.where(key[spot] == wanted, bound[spot], 0.0)

        opened = windows[of(windows) + of(windows + blocks) + self.common[windows % blocks] >= TAU - 1e-9]
        present = np.zeros(len(self.terms), bool)
        starts = np.searchsorted(rows, np.arange(int(rows[-1]) + 2))
        last, pieces, mine = -1, None, None
        for window in opened.tolist():
            c, block = divmod(window, blocks)
            if c != last:
                if mine is not None:
                    present[mine] = False
                mine = at_term[np.searchsorted(at_cell, c) : np.searchsorted(at_cell, c + 2)]
                present[mine] = True
                last, pieces = c, None
            for item in range(block * BLOCK, min(len(self.ids), (block + 1) * BLOCK)):
                own = slice(self.item_at[item], self.item_at[item + 1])
                score = float(self.item_impacts[own][present[self.item_terms[own]]].sum())
                if score < TAU - 1e-9:
                    continue
                if pieces is None:
                    row = int(np.searchsorted(cells_before, c, side="right")) - 1
                    begin = starts[row] + (c - cells_before[row]) * self.cell
                    here = hashes[max(begin, starts[row]) : min(begin + 2 * self.cell, starts[row + 1])]
                    pieces = np.concatenate([gram_hashes(here, n) for n in (1, 2, 3)])
                asked, said = np.isin(self.question[item], pieces).mean(), np.isin(self.answer[item], pieces).mean()
                if asked >= MIN_OVERLAP and said >= MIN_OVERLAP:
                    yield row, item, score, float(asked), float(said)


def _indexes(items: DataFrame, id_column: str) -> Iterator[Index]:
    """The shards of the index. Statistics come from all items; a shard is what the driver holds at a time."""
    clean = items.where(F.col("text").isNotNull()).select(id_column, "text")

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, rows = _hashed(batch.column(1))
            edge = np.searchsorted(rows, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edge), pa.array(found.view(np.int64)))], [id_column, "words"])

    hashed = clean.mapInArrow(hashes, clean.select(id_column, F.lit(None).cast("array<long>").alias("words")).schema).where(F.size("words") > 0)
    total, volume = hashed.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    if not total:
        return
    shards = max(-(-total // SHARD_ITEMS), -(-volume // SHARD_TERMS))
    frequencies = hashed.select(F.explode(F.array_distinct("words")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    placed = hashed.withColumn("shard", F.pmod(F.xxhash64(id_column, "words"), F.lit(shards)))
    for k in range(shards):
        own = placed.where(F.col("shard") == k)
        rows = sorted(((r[0], np.array(r[1], np.int64).view(np.uint64)) for r in own.select(id_column, "words").collect()), key=lambda r: (len(r[1]), str(r[0])))
        if rows:
            used = own.select(F.explode("words").alias("term")).distinct()
            df = {t & 2**64 - 1: n for t, n in frequencies.join(used, "term", "left_semi").collect()}
            yield Index.build(rows, df, total, volume / total)


def contaminated(docs: DataFrame, items: DataFrame, id_column: str = "item_id") -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: each document with an item that it holds."""
    id_type = items.schema[id_column].dataType.simpleString()
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {id_column} {id_type}, score double, question_overlap double, answer_overlap double"
    id_arrow = to_arrow_type(items.schema[id_column].dataType)
    texts, parts = docs.select("doc_id", "text"), []
    for index in _indexes(items, id_column):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                hashes, rows = _hashed(batch.column(1))
                found = list(shared.value.search(hashes, rows)) if len(hashes) else []
                if found:
                    at, item, score, asked, said = zip(*found, strict=True)
                    ids = pa.array([shared.value.ids[i] for i in item], id_arrow)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids, pa.array(score), pa.array(asked), pa.array(said)], ["doc_id", id_column, "score", "question_overlap", "answer_overlap"])

        parts.append(texts.mapInArrow(run, schema))
    if not parts:
        return docs.sparkSession.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    best = F.max(F.struct("score", "question_overlap", "answer_overlap")).alias("best")
    return out.groupBy("doc_id", id_column).agg(best).select("doc_id", id_column, "best.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
