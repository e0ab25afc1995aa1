"""Language ID (operator 7): interpolated Kneser-Ney character models, one per language, in sorted hash arrays.

Highest-order character n-gram counts come from a Spark job over a bounded sample of the labelled training
documents (TRAIN_DOCS a language, chosen by a hash of doc_id); lower orders use continuation counts, as Kneser-Ney
asks. The packed n-grams of all languages share one sorted array per order, with a row of log probabilities (one
column a language) beside it. A text gets the language of the lowest cross-entropy per character. Rejection is
calibrated on sample documents that the counts have not seen: a text is rejected if its cross-entropy lies a tenth
above what 99 of 100 of these cost, with an allowance that shrinks with the root of its length; a language with fewer
than CALIBRATE_DOCS of them has a wide limit.

Defined cases: null text or a text without a letter is `und` and rejected, with score 0; null languages are not
learned; with no labelled rows every text is `und`; of languages of one cross-entropy the first by name is taken; a text
of any length is scored whole; repeated rows give repeated rows and count as often in the fit; an empty table gives an
empty table. Other columns are passed through by `identify`, ones named like its output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm.arrow_text import SLICE_BYTES, buffers, slices
from dossierflow.session import read_table

ORDER = 4
#: Bound of the fit: documents sampled a language. All their n-grams count.
TRAIN_DOCS = 1500
#: Held-aside documents a language from which on the calibration stands alone.
CALIBRATE_DOCS = 25
UND = "und"
_SPACE_CODE = 32


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its folded 16-bit symbol (lower case, digits as 0, white space as one), and letterhood."""
    fold = np.full(0x110000, 0xFFFF, np.uint16)
    letter = np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        letter[i] = c.isalpha()
        if i < 0xFFFF:
            low = c.lower()
            fold[i] = _SPACE_CODE if c.isspace() else 48 if c.isdigit() else ord(low) if len(low) == 1 else i
    return fold, letter


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded symbols of all texts, the row offsets into them, and whether each row has a letter."""
    fold, letter = _tables()
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    heads = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=heads[1:])
    at = heads[offsets]
    seen = np.zeros(len(points) + 1, np.int64)
    np.cumsum(letter[points], out=seen[1:])
    return fold[points], at, seen[at[1:]] > seen[at[:-1]]


def grams(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The packed n-gram that ends at each symbol; before a text's start stand spaces."""
    keys = codes.astype(np.uint64)
    for back in range(1, ORDER):
        before = np.full(len(codes), _SPACE_CODE, np.uint64)
        before[back:] = codes[:-back] if back < len(codes) else codes[:0]
        for k in range(back):
            begin = at[:-1] + k
            before[begin[begin < at[1:]]] = _SPACE_CODE
        keys |= before << np.uint64(16 * back)
    return keys


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _mask(n: int) -> np.uint64:
    return np.uint64(2 ** (16 * n) - 1)


class KneserNey:
    """The models of all languages over shared sorted arrays of packed n-grams."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        own = [self._levels(*counts[lang]) for lang in self.langs]
        alphabet = len({int(k) for levels in own for k in levels[0][0]}) + 1
        self.floor = -np.log(alphabet)
        self.keys: list[np.ndarray] = []
        self.logs: list[np.ndarray] = []
        self.contexts: list[np.ndarray] = []
        self.backs: list[np.ndarray] = []
        for n in range(1, ORDER + 1):
            keys = np.unique(np.concatenate([levels[n - 1][0] for levels in own])) if own else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(16))
            backs = np.zeros((len(contexts), len(own)))
            probs = np.zeros((len(keys), len(own)))
            lower = np.exp(self._score(n - 1, keys & _mask(n - 1)) if n > 1 else np.full((len(keys), len(own)), self.floor))
            for j, levels in enumerate(own):
                k, c = levels[n - 1]
                once, twice = (c == 1).sum(), (c == 2).sum()
                discount = once / (once + 2 * twice) if once and twice else 0.5
                heads, where = np.unique(k >> np.uint64(16), return_inverse=True)
                total = np.bincount(where, c, len(heads))
                kinds = np.bincount(where, minlength=len(heads))
                spot = np.searchsorted(contexts, heads)
                back = np.ones(len(contexts))
                back[spot] = discount * kinds / total
                backs[:, j] = np.log(back)
                at = np.searchsorted(keys, k)
                probs[:, j] = back[np.searchsorted(contexts, keys >> np.uint64(16))] * lower[:, j]
                probs[at, j] += np.maximum(c - discount, 0) / total[where]
            self.keys.append(keys)
            self.logs.append(np.log(probs).astype(np.float32))
            self.contexts.append(contexts)
            self.backs.append(backs.astype(np.float32))

    @staticmethod
    def _levels(keys: np.ndarray, counts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Counts of the highest order; below it, how many different symbols stand before each n-gram."""
        order = np.argsort(keys)
        out = [(keys[order], counts[order].astype(np.float64))]
        for n in range(ORDER - 1, 0, -1):
            k, c = np.unique(out[0][0] & _mask(n), return_counts=True)
            out.insert(0, (k, c.astype(np.float64)))
        return out

    def _score(self, n: int, wanted: np.ndarray) -> np.ndarray:
        if n == 0:
            return np.full((len(wanted), len(self.langs)), self.floor, np.float32)
        at, hit = _find(self.keys[n - 1], wanted)
        out = self.logs[n - 1][at]
        if not hit.all():
            miss = np.flatnonzero(~hit)
            rest = wanted[miss]
            low = self._score(n - 1, rest & _mask(n - 1))
            spot, known = _find(self.contexts[n - 1], rest >> np.uint64(16))
            low[known] += self.backs[n - 1][spot[known]]
            out[miss] = low
        return out

    def cross_entropy(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Nats per symbol, rows x languages; 0 for an empty text."""
        rows = len(at) - 1
        sums = np.zeros((rows + 1, len(self.langs)))
        keys = grams(codes, at)
        total = np.zeros((rows, len(self.langs)))
        step = 1 << 18
        for begin in range(0, len(keys), step):
            logs = self._score(ORDER, keys[begin : begin + step])
            lo, hi = np.clip(at[:-1] - begin, 0, len(logs)), np.clip(at[1:] - begin, 0, len(logs))
            sums = np.zeros((len(logs) + 1, len(self.langs)))
            np.cumsum(logs, axis=0, out=sums[1:])
            total -= sums[hi] - sums[lo]
        return total / np.maximum(np.diff(at), 1)[:, None]


@dataclass
class Model:
    lm: KneserNey
    #: Per language: the highest cross-entropy of a clean text is level + spread / sqrt(symbols).
    level: np.ndarray
    spread: np.ndarray

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language (-1: und), score, and whether it is rejected."""
        codes, at, lettered = symbols(*buffers(column))
        if not self.lm.langs:
            return np.full(len(column), -1), np.zeros(len(column)), np.ones(len(column), bool)
        far = self.lm.cross_entropy(codes, at)
        best = far.argmin(axis=1)
        low = far[np.arange(len(far)), best]
        size = np.diff(at)
        score = 1 / np.exp((low[:, None] - far) * np.minimum(size, 40)[:, None]).sum(axis=1)
        rejected = ~lettered | (low > self.level[best] + self.spread[best] / np.sqrt(np.maximum(size, 1)))
        return np.where(lettered, best, -1), np.where(lettered, score, 0.0), rejected


def held_out(key: str = "doc_id"):
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2


def _sample(docs: DataFrame) -> DataFrame:
    """About TRAIN_DOCS labelled documents a language, the same ones in every run."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(), F.lit(True))).select("doc_id", "text", "lang")
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return labelled.withColumn("draw", F.lit(0.0)).limit(0)
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, TRAIN_DOCS / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language id")), F.lit(1 << 20)) / (1 << 20)
    return labelled.withColumn("draw", draw / share[F.col("lang")]).where("draw < 1")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        codes, at, _ = symbols(*buffers(batch.column(0)))
        langs = batch.column(1).dictionary_encode()
        owner = np.repeat(langs.indices.to_numpy(), np.diff(at))
        keys = grams(codes, at)
        for j, lang in enumerate(langs.dictionary.to_pylist()):
            k, c = np.unique(keys[owner == j], return_counts=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(k), pa.string()), "gram": pa.array(k.view(np.int64)), "n": pa.array(c.astype(np.int64))})


def train(docs: DataFrame) -> Model:
    sample = _sample(docs)
    fit, calibrate = sample.where("draw < 0.8"), sample.where("draw >= 0.8")
    counted = fit.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    kept = counted.orderBy("lang", "gram").toArrow()
    langs, keys, sizes = np.array(kept.column(0).to_pylist(), object), kept.column(1).to_numpy().view(np.uint64), kept.column(2).to_numpy()
    counts = {lang: (keys[langs == lang], sizes[langs == lang]) for lang in sorted(set(langs))}
    lm = KneserNey(counts)
    shared = docs.sparkSession.sparkContext.broadcast(lm)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes, at, _ = symbols(*buffers(batch.column(0)))
            far = shared.value.cross_entropy(codes, at)
            yield pa.RecordBatch.from_pydict({"lang": batch.column(1), "far": pa.array(far.min(axis=1)), "size": pa.array(np.diff(at))})

    seen = calibrate.select("text", "lang").mapInArrow(measure, "lang string, far double, size long").where("size > 0")
    usual = seen.groupBy("lang").agg((F.sum(F.col("far") * F.col("size")) / F.sum("size")).alias("level"))
    beyond = (F.col("far") - F.col("level")) * F.sqrt("size")
    over = seen.join(F.broadcast(usual), "lang").groupBy("lang").agg(F.percentile("far", 0.99).alias("most"), F.percentile(beyond, 0.95).alias("spread"), F.count("*").alias("n"))
    found = {r.lang: (r.most, r.spread, r.n) for r in over.collect()}
    # With few held-aside documents never below most of what evenly random symbols cost, so a small fit doesn't reject clean ones.
    least = lambda n: 0.0 if n >= CALIBRATE_DOCS else -0.85 * lm.floor
    level = np.array([max(found[x][0] * 1.1, least(found[x][2])) if x in found else np.inf for x in lm.langs])
    spread = np.array([2 * max(found[x][1], 4.0) if x in found else 0.0 for x in lm.langs])
    return Model(lm, level, spread)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Adds lang_pred, lang_score and lang_rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.drop("lang_pred", "lang_score", "lang_rejected")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.lm.langs, UND], dtype=object)
        for batch in slices(batches, limit=SLICE_BYTES // 2):
            best, score, rejected = shared.value.predict(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score), pa.array(rejected)], [*batch.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    schema = kept.withColumns({"lang_pred": F.lit(""), "lang_score": F.lit(0.0), "lang_rejected": F.lit(False)}).schema
    return kept.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
