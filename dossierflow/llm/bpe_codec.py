"""BPE encoding and decoding (operator 3) with a pair occurrence index.

The words of a slice of a partition that were not met before are laid out in one symbol array. An index maps each
adjacent pair of symbols to all its positions; the pairs that have a merge wait in a heap by rank. The lowest active
rank is applied at all its positions, the lists of the neighbouring pairs are updated, and so on until no rank is
left. Results are kept per word in a bounded cache of the Python worker.

Normalisation and splitting follow the vocabulary file (NFC, lower case, letters / single digits / other marks,
byte symbols, word-end suffix); the two special tokens are taken verbatim before that. Letters, numbers and lower case
are those of the library's Unicode tables, whatever the tables of `regex` and Python; single code points are tested
against it, sequences that only NFC of Unicode 16.0 composes are not.

Defined cases: null and empty text have no ids; a text of any length is encoded whole, as a slice of its own beyond a
mebibyte; repeated rows give repeated rows; an empty table gives an empty table; ties of one rank are merged from left
to right; other columns are passed through by `encode` and `decode`, one that is named like their output is replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm.arrow_text import slices
from dossierflow.session import read_table

VOCABULARY = "word_bpe_49k.json"
#: Words kept per Python worker before the cache starts anew.
CACHE_WORDS = 300_000
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

#: Code points that newer tables count as letters or numbers, but Unicode 16.0, which the library splits by, does not.
_LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7
10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6
187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E
2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
#: Lower-case forms that Python's tables may lack (upper range and first lower form), from Unicode 16.0 and 17.0.
_LOWER = {(0x1C89, 0x1C89): 0x1C8A, (0xA7CB, 0xA7CB): 0x264, (0xA7CC, 0xA7CC): 0xA7CD, (0xA7CE, 0xA7CE): 0xA7CF, (0xA7D2, 0xA7D2): 0xA7D3, (0xA7D4, 0xA7D4): 0xA7D5,
          (0xA7DA, 0xA7DA): 0xA7DB, (0xA7DC, 0xA7DC): 0x19B, (0x10D50, 0x10D65): 0x10D70, (0x16EA0, 0x16EB8): 0x16EBB}
_later = "".join("-".join(f"\\U{int(x, 16):08x}" for x in part.split("-")) for part in _LATER.split())
_FOLD = {code: low + code - first for (first, last), low in _LOWER.items() for code in range(first, last + 1)}
#: Texts without any of these characters, nearly all, are split by the plain pattern.
_ODD = regex.compile("[" + _later + "".join(map(chr, _FOLD)) + "]")
_SPLIT_ODD = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_later}]]+|[\p{{N}}--[{_later}]]|[^\s[\p{{L}}\p{{N}}--[{_later}]]]+")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: Latin-1 ones for themselves, the rest from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


class Codec:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, vocabulary: bytes):
        spec = json.loads(vocabulary)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, (a, b) in enumerate(spec["model"]["merges"]):
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.cache: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        if text.isascii():
            return _SPLIT.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if _ODD.search(text):
            return _SPLIT_ODD.findall(text.translate(_FOLD).lower())
        return _SPLIT.findall(text.lower())

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        parts = []
        for text in texts:
            if "<|" in text:
                pieces = self.cut.split(text)
                parts.append([w for k, p in enumerate(pieces) for w in ([p] if k % 2 else self.words(p))])
                self.cache |= {s: np.array([i], "<u4").tobytes() for s, i in self.special.items()}
            else:
                parts.append(self.words(text))
        known = self.cache
        fresh = list(set().union(*parts).difference(known)) if parts else []
        if fresh:
            if len(known) + len(fresh) > CACHE_WORDS:
                keep = set().union(*parts).intersection(known)
                known = self.cache = {w: known[w] for w in keep}
            known.update(zip(fresh, self._merge(fresh), strict=True))
        get = known.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def _merge(self, fresh: list[str]) -> Iterator[bytes]:
        """Applies the merges to all the words at once, by the pair occurrence index."""
        sym: list[int] = []
        ends = []
        for w in fresh:
            raw = w.encode()
            sym += map(self.inner.__getitem__, raw[:-1])
            sym.append(self.final[raw[-1]])
            ends.append(len(sym))
        nxt, prv = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        begin = 0
        for end in ends:
            prv[begin], nxt[end - 1] = -1, -1
            begin = end
        merges, at = self.merges, {}
        for p, q in enumerate(nxt):
            if q >= 0:
                key = sym[p] << 32 | sym[q]
                if key in merges:
                    if key in at:
                        at[key].append(p)
                    else:
                        at[key] = [p]
        active = [(merges[key][0], key) for key in at]
        heapq.heapify(active)
        while active:
            _, key = heapq.heappop(active)
            a, b, new = key >> 32, key & 0xFFFFFFFF, merges[key][1]
            for p in sorted(at.pop(key)):
                q = nxt[p]
                if q < 0 or sym[p] != a or sym[q] != b:
                    continue
                sym[p], sym[q] = new, -1
                after, before = nxt[q], prv[p]
                nxt[p] = after
                if after >= 0:
                    prv[after] = p
                for left, right in ((before, p), (p, after)):
                    if left >= 0 and right >= 0:
                        pair = sym[left] << 32 | sym[right]
                        if pair in merges:
                            if pair in at:
                                at[pair].append(left)
                            else:
                                at[pair] = [left]
                                heapq.heappush(active, (merges[pair][0], pair))
        ids = np.array(sym, dtype=np.int64)
        live = ids >= 0
        bounds = np.concatenate([[0], np.cumsum(live)])[[0, *ends]] * 4
        packed = ids[live].astype("<u4").tobytes()
        return (packed[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))

    def decode(self, packed: bytes) -> str:
        """The token strings joined by a space: this vocabulary file has no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


_codecs: dict[bytes, Codec] = {}


def codec(vocabulary: bytes) -> Codec:
    """One codec per vocabulary and Python worker, so that its cache lives as long as the worker."""
    key = hashlib.sha256(vocabulary).digest()
    if key not in _codecs:
        _codecs[key] = Codec(vocabulary)
    return _codecs[key]


def _shared_vocabulary(spark: SparkSession, path: str | None):
    with open(path or vocabulary_path(), "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, column: str = "text", out: str = "token_ids") -> DataFrame:
    """Adds `out`: the ids of the whole text as binary, four little-endian bytes an id."""
    vocabulary = _shared_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary.value)
        for batch in slices(batches, column):
            texts = batch.column(batch.schema.get_field_index(column)).fill_null("").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.encode(texts), pa.binary())], [*batch.schema.names, out])

    kept = docs.drop(out)
    return kept.mapInArrow(run, kept.withColumn(out, F.lit(b"")).schema)


def decode(docs: DataFrame, path: str | None = None, column: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Adds `out`: the text of the ids in `column`."""
    vocabulary = _shared_vocabulary(docs.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary.value)
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(column)).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(own.decode, ids), pa.string())], [*batch.schema.names, out])

    kept = docs.drop(out)
    return kept.mapInArrow(run, kept.withColumn(out, F.lit("")).schema)


def digests(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """doc_id, the columns in `keep`, n_tokens, token_ids if asked for, ids_sha256 and decoded_sha256.

    Encoding and decoding share one pass and one worker, so that each task holds one codec and one word cache.
    """
    vocabulary = _shared_vocabulary(docs.sparkSession, path)
    rows = docs.select("doc_id", "text", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary.value)
        for batch in slices(batches):
            ids = own.encode(batch.column(1).fill_null("").to_pylist())
            hashed = lambda x: hashlib.sha256(x).hexdigest()
            out = {"doc_id": batch.column(0)} | {c: batch.column(2 + k) for k, c in enumerate(keep)}
            out["n_tokens"] = pa.array([len(i) // 4 for i in ids], pa.int64())
            if with_ids:
                out["token_ids"] = pa.array(ids, pa.binary())
            out["ids_sha256"] = pa.array(map(hashed, ids), pa.string())
            out["decoded_sha256"] = pa.array([hashed(own.decode(i).encode()) for i in ids], pa.string())
            yield pa.RecordBatch.from_pydict(out)

    added = [F.lit(0).cast("long").alias("n_tokens"), *[F.lit(b"").alias("token_ids")] * with_ids, F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")]
    return rows.mapInArrow(run, rows.select("doc_id", *keep, *added).schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
