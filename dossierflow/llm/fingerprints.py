"""Document fingerprints (operator 6): quartile bucket digests of byte triplets.

Each window of four bytes adds its triplets (0,1,2), (0,1,3) and (0,2,3), hashed, to BUCKETS counters. The digest
holds for each bucket its quartile among the text's own counters (two bits), and the length on a logarithmic scale.
Two digests are compared by a difference score that is bounded by DIFF_MAX; likeness = 1 - difference / DIFF_MAX.

The next document in ascending doc_id is found without a global sort in one task: rows go to buckets between
sampled doc_id bounds, each bucket is read in order, and the first row of each bucket is also sent to the bucket
before it. Defined cases: null or empty text has the digest of an empty counter set; a null doc_id sorts first; rows
with one doc_id are ordered by text; a single row is its own next document; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm.arrow_text import SLICE_BYTES, buffers, slices
from dossierflow.session import read_table

BUCKETS = 256
#: Digest: 1 byte of length, then two bits a bucket.
DIGEST_BYTES = 1 + BUCKETS // 4
#: Most that one bucket adds (quartiles three apart), and the length part.
BUCKET_MAX, LENGTH_MAX = 6, 255
DIFF_MAX = BUCKETS * BUCKET_MAX + LENGTH_MAX
_STEP = np.array([0, 1, 3, 6], dtype=np.int64)


def _counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    rows = len(offsets) - 1
    if len(data) < 4:
        return np.zeros((rows, BUCKETS), np.int64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(rows, dtype=np.int32), sizes)
    wide = data.astype(np.uint32)
    inside = np.flatnonzero(row[:-3] == row[3:])
    out = np.zeros(rows * BUCKETS, np.int64)
    base = row[inside].astype(np.int64) * BUCKETS
    first = wide[inside] * np.uint32(0x9E3779B1)
    for salt, (a, b) in enumerate(((1, 2), (1, 3), (2, 3)), 1):
        h = first ^ (wide[inside + a] * np.uint32(0x85EBCA77)) ^ (wide[inside + b] * np.uint32(0xC2B2AE3D) + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF))
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out += np.bincount(base + (h >> np.uint32(24)).astype(np.int64), minlength=rows * BUCKETS)
    return out.reshape(rows, BUCKETS)


def digest(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Digests of many texts: rows x DIGEST_BYTES."""
    counts = _counts(data, offsets)
    ranked = np.sort(counts, axis=1)
    quart = ranked[:, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, :, None] > quart[:, None, :]).sum(axis=2).astype(np.uint8).reshape(len(counts), -1, 4)
    packed = code[:, :, 0] | code[:, :, 1] << 2 | code[:, :, 2] << 4 | code[:, :, 3] << 6
    length = np.minimum(255, np.round(12 * np.log1p(np.diff(offsets)))).astype(np.uint8)
    return np.concatenate([length[:, None], packed], axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - bounded difference of the digests, row by row."""
    codes = [np.stack([x[:, 1:] >> s & 3 for s in (0, 2, 4, 6)], axis=2).astype(np.int64) for x in (a, b)]
    far = _STEP[np.abs(codes[0] - codes[1])].sum(axis=(1, 2)) + np.abs(a[:, 0].astype(np.int64) - b[:, 0])
    return 1 - far / DIFF_MAX


def _of(texts: list[bytes]) -> np.ndarray:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return digest(np.frombuffer(b"".join(texts), np.uint8), offsets)


def _hex(digests: np.ndarray) -> list[str]:
    return [d.tobytes().hex() for d in digests]


def fingerprint(docs: DataFrame, column: str = "text", out: str = "fingerprint") -> DataFrame:
    """Adds `out`, the hexadecimal digest of the whole text."""
    kept = docs.drop(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column):
            found = _hex(digest(*buffers(batch.column(batch.schema.get_field_index(column)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, out])

    return kept.mapInArrow(run, kept.withColumn(out, F.lit("")).schema)


def compare(a: str, b: str) -> float:
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8)[None] for s in (a, b))
    return float(likeness(x, y)[0])


def with_next(docs: DataFrame, key: str = "doc_id", parts: int | None = None) -> DataFrame:
    """Rows (bucket, look, key, text): each bucket's rows and, marked by look, the first row behind the bucket."""
    spark = docs.sparkSession
    parts = parts or max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bounds = docs.stat.approxQuantile(key, [k / parts for k in range(1, parts)], 0.1 / parts) if parts > 1 else []
    bounds = sorted({int(b) for b in bounds})
    edges = F.array(*[F.lit(b).cast("long") for b in bounds]) if bounds else F.array().cast("array<long>")
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("bucket", F.when(F.col(key).isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e <= F.col(key)))))
    # One row a bucket, so bounded by `parts`: the first key of each, and the bucket that must look at it.
    firsts = sorted((r.bucket, r.least) for r in rows.groupBy("bucket").agg(F.min(F.coalesce(key, F.lit(-(2**63)))).alias("least")).collect())
    look = {least: firsts[k - 1][0] for k, (_, least) in enumerate(firsts)}
    to = F.lit(None).cast("int") if not look else F.try_element_at(F.create_map(*[F.lit(x) for kv in look.items() for x in kv]), F.coalesce(key, F.lit(-(2**63))))
    targets = F.array_compact(F.array(F.struct(F.col("bucket").cast("int").alias("b"), F.lit(False).alias("look")), F.when(to.isNotNull(), F.struct(to.alias("b"), F.lit(True).alias("look")))))
    spread = rows.select(key, "text", F.explode(targets).alias("t")).select(F.col("t.b").alias("bucket"), F.col("t.look").alias("look"), key, "text")
    return spread.repartition(parts, "bucket").sortWithinPartitions("bucket", "look", key, "text")


def _edit(text: str, following: str) -> str:
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the ordered rows of a partition, holding a few texts at a time."""
    held: list[tuple[int | None, str]] = []

    def flush(after: str | None) -> pa.RecordBatch:
        keys, texts = [k for k, _ in held], [t for _, t in held]
        follow = texts[1:] + ([after] if after is not None else [])
        own = [t.encode() for t in texts]
        edited = [_edit(t, n).encode() for t, n in zip(texts, follow, strict=False)]
        prints, changed, next_prints = _of(own), _of(edited), _of([n.encode() for n in follow])
        n = len(follow)
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(keys[:n], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:n]], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(e).hexdigest() for e in edited], pa.string()),
                "fingerprint": pa.array(_hex(prints[:n]), pa.string()),
                "edited_fingerprint": pa.array(_hex(changed), pa.string()),
                "near_edited": pa.array(likeness(prints[:n], changed), pa.float64()),
                "near_next": pa.array(likeness(prints[:n], next_prints), pa.float64()),
            }
        )

    size, current, closed = 0, None, False
    for batch in slices(batches):
        for bucket, look, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != current:
                current, closed, held, size = bucket, False, [], 0
            if closed:
                continue
            if held and (look or size > SLICE_BYTES):
                yield flush(text)
                held, size = [], 0
            if look:
                closed = True
            else:
                held.append((key, text))
                size += len(text)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document's digest against that of its edited text and of the next document."""
    return with_next(docs).mapInArrow(
        _compared,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(read_table(spark, sf_dir, "documents"))
