"""Toxicity (operator 4): a convolutional text classifier trained in numpy.

A word's embedding is the sum of three hashed rows: the whole word, its first four and its first six bytes (lower
case in A-Z), so inflected forms share parts. Filters of WIDTHS words slide over the whole text; each keeps its
greatest response (max pooling), and a logistic layer scores the pooled responses. Buckets that fewer than MIN_DOCS
training documents hit share the zero row.

All labelled rows are learned from but those whose crc32(doc_id) mod 4 is 2: the network from four fifths, the thresholds from
the other fifth. Rows are dealt into parts by hash; each round every part is fitted from the same network by one task, and the parts'
means are the next one. A threshold per language is set on the fifth aside; the language is guessed from the text's words (naive Bayes over hashed
words, counted over all rows), and scores are shifted so that each language's threshold lies at THRESHOLD. Labels, lang, source and doc_id are no inputs of a score.

Defined cases: null or empty text is scored as a text without words; rows with a null label or no document are not
learned; repeated rows are learned once; without both classes every score is 0; other columns are passed through by `score_texts`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm.arrow_text import buffers, slices, word_hashes, words
from dossierflow.llm.durable import cut, drop, release
from dossierflow.session import read_table

DIM, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
WORD_BITS, LANG_BITS = 17, 12
SIZE = 1 + (3 << WORD_BITS)
#: Rows of a part, which is fitted as a whole by one task; passes over all rows in each round, the same for tables of every size.
PART_ROWS, FEW_PASSES = 2500, (2, 2, 2, 2)
MIN_DOCS, BATCH, RATE = 3, 32, 0.02
#: Parts of one in which means are added up, and steps of a logit in which thresholds are looked for.
FIXED, STEPS = float(1 << 32), 1024
THRESHOLD = 0.3
PAD = max(WIDTHS) - 1
HELD = 2
U64 = np.uint64


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket numbers of all words (three parts a word), language buckets, and the row of each word."""
    data, offsets = buffers(column)
    starts, ends, rows = words(data, offsets)
    whole = word_hashes(data, starts, ends, fold_ascii=True)
    parts = [whole] + [word_hashes(data, starts, np.minimum(starts + n, ends), fold_ascii=True) + U64(n * 0x9E3779B97F4A7C15 & 2**64 - 1) for n in (4, 6)]
    at = [(h >> U64(64 - WORD_BITS)).astype(np.int32) + (k << WORD_BITS) + 1 for k, h in enumerate(parts)]
    return np.stack(at, axis=1) if len(starts) else np.zeros((0, 3), np.int32), (whole & U64((1 << LANG_BITS) - 1)).astype(np.int64), rows


def _layout(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words when PAD + 1 empty words follow each row, and where each row begins."""
    counts = np.bincount(rows, minlength=n)
    begin = np.concatenate([[0], np.cumsum(counts + PAD + 1)])
    return np.arange(len(rows)) + rows * (PAD + 1), begin


@dataclass
class Network:
    embed: np.ndarray
    filters: list[np.ndarray]  # per width: width x DIM x FILTERS
    bias: np.ndarray
    out: np.ndarray
    base: float

    @staticmethod
    def start(live: np.ndarray) -> Network:
        rng = np.random.default_rng(4)
        embed = rng.normal(0, 0.1, (len(live), DIM)).astype(np.float32)
        embed[~live] = 0
        filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        n = FILTERS * len(WIDTHS)
        return Network(embed, filters, np.zeros(n, np.float32), np.full(n, 0.5, np.float32), -1.0)

    def pooled(self, at: np.ndarray, rows: np.ndarray, n: int, places: bool = False):
        """Greatest response of each filter in each row, and, if asked, where it is."""
        spot, begin = _layout(rows, n)
        x = np.zeros((begin[-1] + PAD, DIM), np.float32)
        x[spot] = self.embed[at[:, 0]] + self.embed[at[:, 1]] + self.embed[at[:, 2]]
        parts, where = [], []
        for w in self.filters:
            z = x[: begin[-1]] @ w[0]
            for k in range(1, len(w)):
                z += x[k : begin[-1] + k] @ w[k]
            top = np.maximum.reduceat(z, begin[:-1], axis=0)
            parts.append(top)
            if places:
                first = np.full(top.shape, -1)
                owner = np.repeat(np.arange(n), np.diff(begin))
                hit = z == top[owner]
                for f in range(z.shape[1]):
                    i = np.flatnonzero(hit[:, f])[::-1]
                    first[owner[i], f] = i
                where.append(first)
        return np.concatenate(parts, axis=1), x, where, spot

    def dense(self) -> np.ndarray:
        """All that is no embedding, as rows of DIM numbers."""
        flat = np.concatenate([*(w.ravel() for w in self.filters), self.bias, self.out, [self.base], np.zeros(DIM - 1)])
        return flat.reshape(-1, DIM)

    def set_dense(self, rows: np.ndarray) -> None:
        flat, at = rows.astype(np.float32).ravel(), 0
        for p in (*self.filters, self.bias, self.out):
            p[...] = flat[at : at + p.size].reshape(p.shape)
            at += p.size
        self.base = float(flat[at])

    def logits(self, at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        top = self.pooled(at, rows, n)[0]
        return np.maximum(top + self.bias, 0) @ self.out + self.base


class Adam:
    def __init__(self, params: list[np.ndarray]):
        self.params, self.m, self.v, self.t = params, [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0

    def step(self, grads: list) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for p, m, v, g in zip(self.params, self.m, self.v, grads, strict=True):
            rows, g = g if isinstance(g, tuple) else (slice(None), g)
            m[rows] = 0.9 * m[rows] + 0.1 * g
            v[rows] = 0.999 * v[rows] + 0.001 * g * g
            p[rows] -= RATE * fix * m[rows] / (np.sqrt(v[rows]) + 1e-6)


def learn(net: Network, at: np.ndarray, rows: np.ndarray, labels: np.ndarray, weight: np.ndarray, passes: int, seed: int) -> np.ndarray:
    """Fits `net` to the rows in place and returns which embeddings took part. Logistic loss, a weight for each class; the
    gradient of max pooling goes to the greatest windows only."""
    base = np.array([net.base], np.float32)
    adam = Adam([net.embed, *net.filters, net.bias, net.out, base])
    moved = np.zeros(len(net.embed), bool)
    weight = weight[labels.astype(int)]
    edge = np.searchsorted(rows, np.arange(len(labels) + 1))
    rng = np.random.default_rng(seed)
    for _ in range(passes):
        order = rng.permutation(len(labels))
        for begin in range(0, len(order), BATCH):
            batch = order[begin : begin + BATCH]
            take = np.concatenate([np.arange(edge[i], edge[i + 1]) for i in batch])
            own = np.repeat(np.arange(len(batch)), edge[batch + 1] - edge[batch])
            top, x, where, spot = net.pooled(at[take], own, len(batch), places=True)
            hidden = np.maximum(top + net.bias, 0)
            logit = hidden @ net.out + base[0]
            wrong = (weight[batch] * (1 / (1 + np.exp(-logit)) - labels[batch]) / len(batch)).astype(np.float32)
            g_hidden = wrong[:, None] * net.out * (hidden > 0)
            g_x, g_filters = np.zeros_like(x), []
            for j, w in enumerate(net.filters):
                g = g_hidden[:, j * FILTERS : (j + 1) * FILTERS]
                g_w = np.zeros_like(w)
                for k in range(len(w)):
                    seen = where[j] + k
                    g_w[k] = np.einsum("bfd,bf->df", x[seen], g)
                    np.add.at(g_x, seen.ravel(), (g[:, :, None] * w[k].T[None]).reshape(-1, DIM))
                g_filters.append(g_w)
            touched = np.flatnonzero(np.any(g_x[spot] != 0, axis=1))
            ids, back = np.unique(at[take][touched].ravel(), return_inverse=True)
            g_embed = np.zeros((len(ids), DIM), np.float32)
            np.add.at(g_embed, back, np.repeat(g_x[spot][touched], 3, axis=0))
            g_embed += 1e-4 * net.embed[ids]
            g_embed[ids == 0] = 0
            moved[ids] = True
            adam.step([(ids, g_embed), *g_filters, g_hidden.sum(axis=0), hidden.T @ wrong, np.array([wrong.sum()], np.float32)])
    net.base = float(base[0])
    moved[0] = False
    return moved


@dataclass
class Model:
    net: Network | None
    langs: np.ndarray  # log probability of each language bucket, buckets x languages
    shift: np.ndarray  # logit shift a guessed language

    def guess(self, buckets: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        total = np.zeros((n, self.langs.shape[1]))
        for j in range(self.langs.shape[1]):
            total[:, j] = np.bincount(rows, self.langs[buckets, j], n)
        return total.argmax(axis=1)

    def scores(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        if self.net is None:
            return np.zeros(n)
        at, buckets, rows = features(column)
        logit = self.net.logits(at, rows, n) + self.shift[self.guess(buckets, rows, n)]
        return 1 / (1 + np.exp(-logit.astype(np.float64)))


def _held(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == HELD


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """text, lang, toxic, aside and key of all documents that may be learned from; repeated rows count once."""
    known = labels.where(F.col("toxic").isNotNull() & ~F.coalesce(_held(), F.lit(True))).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    rows = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull()).join(known, "doc_id").dropDuplicates()
    key = F.xxhash64("doc_id", "text", F.lit("toxicity"))
    return rows.select("text", F.coalesce("lang", F.lit("")).alias("lang"), "toxic", (F.pmod(F.xxhash64("doc_id", "text", F.lit("aside")), F.lit(5)) == 0).alias("aside"), key.alias("key"))


def _all_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`features` of all texts, a slice at a time."""
    parts, before = [(np.zeros((0, 3), np.int32), np.zeros(0, np.int32), np.zeros(0, np.int64))], 0
    for batch in slices(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
        at, buckets, rows = features(batch.column(0))
        parts.append((at, buckets.astype(np.int32), (rows + before).astype(np.int64)))
        before += batch.num_rows
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def _spoken(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages of the rows and the log probability of each language bucket, by counts over all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, buckets, owner = features(batch.column(0))
            names = batch.column(1).dictionary_encode()
            cells, n = np.unique(names.indices.to_numpy()[owner].astype(np.int64) << LANG_BITS | buckets, return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": names.dictionary.take(pa.array(cells >> LANG_BITS)), "bucket": pa.array((cells & (1 << LANG_BITS) - 1).astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    counted = rows.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(r.lang for r in rows.select("lang").distinct().collect())
    counts = np.full((1 << LANG_BITS, len(langs)), 0.5)
    if counted.num_rows:
        place = {x: j for j, x in enumerate(langs)}
        counts[counted.column("bucket").to_numpy(), [place[x] for x in counted.column("lang").to_pylist()]] += counted.column("n").to_numpy()
    return langs, np.log(counts / counts.sum(axis=0))


def _live(rows: DataFrame) -> np.ndarray:
    """Which buckets MIN_DOCS documents or more hit."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, _, owner = features(batch.column(0))
            pairs = np.unique(owner[:, None] * SIZE + at)
            ids, n = np.unique(pairs % SIZE, return_counts=True)
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids.astype(np.int32)), "n": pa.array(n.astype(np.int64))})

    found = rows.select("text").mapInArrow(hits, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_DOCS).select("id").toArrow()
    live = np.zeros(SIZE, bool)
    live[found.column("id").to_numpy()] = True
    return live


def _gathered(rows: DataFrame) -> DataFrame:
    """One row for each part, with its documents: written once, as every round would shuffle all texts anew."""
    # As the rows come in any order, sorted, so that equal tables give equal models.
    docs = F.sort_array(F.collect_list(F.struct("key", "text", "toxic")))
    return cut(rows.groupBy("part").agg(docs.alias("docs")), "toxicity-parts")


def _mean(net: Network, live: np.ndarray, parts: DataFrame, weight: np.ndarray, turn: int, passes: int) -> Network:
    """Every part goes on from `net` by itself; the mean of what they come to, an embedding's over the parts that moved it."""
    shared = parts.sparkSession.sparkContext.broadcast((net, live))
    values = [f"v{k}" for k in range(DIM)]

    def one(part: int, docs: pa.StructArray) -> pa.RecordBatch:
        start, alive = shared.value
        own = Network(start.embed.copy(), [w.copy() for w in start.filters], start.bias.copy(), start.out.copy(), start.base)
        at, _, owner = _all_features(docs.field("text"))
        labels = docs.field("toxic").to_numpy().astype(np.float32)
        moved = np.flatnonzero(learn(own, np.where(alive[at], at, 0), owner, labels, weight, passes, 1000 * turn + part))
        dense = own.dense()
        ids = np.concatenate([moved, SIZE + np.arange(len(dense))]).astype(np.int32)
        # Whole numbers add up to the same sum in any order.
        sums = np.round(np.concatenate([own.embed[moved], dense]).astype(np.float64) * FIXED).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ids), *(pa.array(np.ascontiguousarray(sums[:, k])) for k in range(DIM))], ["id", *values])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, edge = batch.column(1), batch.column(1).offsets.to_pylist()
            for part, begin, end in zip(batch.column(0).to_pylist(), edge[:-1], edge[1:], strict=True):
                yield one(part, docs.values.slice(begin, end - begin))

    found = parts.mapInArrow(run, f"id int, {', '.join(f'{v} long' for v in values)}")
    means = found.groupBy("id").agg(F.count("*").alias("n"), *(F.sum(v).alias(v) for v in values)).toArrow()
    shared.unpersist()
    ids = means.column("id").to_numpy()
    mean = np.stack([means.column(v).to_numpy() for v in values], axis=1) / FIXED / means.column("n").to_numpy()[:, None]
    inner = ids < SIZE
    net.embed[ids[inner]] = mean[inner]
    net.set_dense(mean[~inner][np.argsort(ids[~inner])])
    return net


def _round(net: Network, live: np.ndarray, rows: DataFrame, weight: np.ndarray, passes: tuple[int, ...]) -> Network:
    """Round after round over all parts of the rows, with so many passes each."""
    release(rows.sparkSession)
    parts = _gathered(rows)
    for turn, n in enumerate(passes):
        release(rows.sparkSession)
        net = _mean(net, live, parts, weight, turn, n)
    drop(parts)
    return net


def _shifts(model: Model, rows: DataFrame) -> np.ndarray:
    """The logit shift of each guessed language: its cut with the best F1 over all rows aside, by counts of logits in steps of 1 / STEPS."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            at, buckets, owner = features(batch.column(0))
            n = batch.num_rows
            level = np.clip(np.floor(shared.value.net.logits(at, owner, n) * STEPS), -64 * STEPS, 64 * STEPS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.guess(buckets, owner, n).astype(np.int32)), pa.array(level), batch.column(1), batch.column(2)], ["guess", "level", "toxic", "aside"])

    found = rows.select("text", "toxic", "aside").mapInArrow(levels, "guess int, level int, toxic int, aside boolean").groupBy("guess", "level", "toxic", "aside").agg(F.count("*").alias("n")).toArrow()
    shared.unpersist()
    guess, level, toxic, aside, n = (found.column(c).to_numpy() for c in ("guess", "level", "toxic", "aside", "n"))
    goal = np.log(THRESHOLD / (1 - THRESHOLD))
    out = np.zeros(len(model.shift))
    both = lambda chosen: len(np.unique(toxic[chosen])) == 2
    for j in range(len(out)):
        chosen = next(x for x in (aside & (guess == j), aside, np.ones(len(n), bool)) if both(x) or x.all())
        values, back = np.unique(level[chosen], return_inverse=True)
        bad = np.bincount(back, n[chosen] * toxic[chosen], len(values))
        every = np.bincount(back, n[chosen], len(values))
        # Cuts below each level: what lies at it or above is taken for toxic.
        over = lambda x: np.cumsum(x[::-1])[::-1]
        right = 2 * over(bad) / (over(every) + bad.sum())
        cuts = np.concatenate([[values[0] - STEPS], (values[1:] + values[:-1] + 1) / 2]) / STEPS
        best = np.flatnonzero(right == right.max())
        out[j] = goal - cuts[best[len(best) // 2]]
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of all labelled documents: parts of about PART_ROWS rows are fitted side by side, round after round from the mean of the parts."""
    rows = cut(_labelled(docs, labels), "toxicity-rows")
    release(docs.sparkSession)
    sizes = {(r.toxic, r.aside): r.n for r in rows.groupBy("toxic", "aside").agg(F.count("*").alias("n")).collect()}
    bad, fine = (sum(sizes.get((k, x), 0) for x in (True, False)) for k in (1, 0))
    if not bad or not fine:
        drop(rows)
        return Model(None, np.zeros((1 << LANG_BITS, 1)), np.zeros(1))
    langs, logs = _spoken(rows)
    # Where a class has no row but those aside, all are learned.
    whole = not all(sizes.get((k, False), 0) for k in (0, 1))
    inner = rows if whole else rows.where("NOT aside")
    a, b = (bad, fine) if whole else (sizes[1, False], sizes[0, False])
    weight = np.array([0.5 * (a + b) / b, 0.5 * (a + b) / a], np.float32)
    live = _live(inner)
    net = Network.start(live)
    parted = inner.select(F.pmod("key", F.lit(-(-(a + b) // PART_ROWS))).cast("int").alias("part"), "key", "text", "toxic")
    net = _round(net, live, parted, weight, FEW_PASSES)
    net.embed[~live] = 0
    model = Model(net, logs, np.zeros(len(langs)))
    model.shift = _shifts(model, rows)
    drop(rows)
    return model


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """Adds toxicity, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("toxicity")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = shared.value.scores(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, "toxicity"])

    return kept.mapInArrow(run, kept.withColumn("toxicity", F.lit(0.0)).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = score_texts(docs.select("doc_id", "text"), train(docs, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(_held(), F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
