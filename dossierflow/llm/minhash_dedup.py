"""MinHash near-dedup (operator 2) with HyperMinHash registers.

A document's set holds its distinct 5-word shingles (64-bit hashes; words lower-cased in A-Z). Sets are sketched
into REGISTERS buckets: each shingle falls into one bucket, and the bucket keeps the least hash in compressed form,
the number of leading zeros and MANTISSA bits after them. Buckets that stay empty borrow from a filled one, in an
order of their own, so short texts have full sketches too.

1. Documents with equal sets are merged first, whatever their number; one representative of each goes on.
2. Bands of ROWS compressed registers are the candidate buckets. A first round tests every member of a bucket
   against its least id; a second round takes the documents of buckets that are still in several components and
   tests those outside the largest component against the others. Pairs inside one component need no test, so a
   large group of near copies costs no pairs between its members.
3. A candidate is dropped if its collision-corrected Jaccard estimate lies far below the threshold
   (SLACK, over five standard deviations); the rest are confirmed on the full sets.

With 32 bands of 4 registers a pair at Jaccard 0.75 stays unseen with probability 6e-6. Sets count as equal in step 1 if
their sizes and two 64-bit sums over mixed shingle hashes are equal, 128 bits besides the size.
Defined cases: a text without words or null has an empty set, no links and is its own component; fewer than five
words are one shingle; a row with a null doc_id takes no part in linking and is kept; repeated rows are one document
and are all returned (doc_id is otherwise a key); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierflow.llm.arrow_text import buffers, gram_hashes, mix, slices, span_hashes, strong_word_hashes, words
from dossierflow.llm.components import components
from dossierflow.llm.durable import cut
from dossierflow.session import read_table

SHINGLE, THRESHOLD_PERCENT = 5, 75
REGISTERS, ROWS, MANTISSA = 128, 4, 10
#: Estimates this far under the threshold are not confirmed on full sets.
SLACK = 0.2
#: Ids of candidate documents are broadcast up to this many, beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Shingles and documents of one part of a cluster, and bytes of the incidence matrix that a cell holds at a time.
PART_SHINGLES, PART_DOCS, CELL_BYTES = 200_000, 2_000, 32 << 20
U64 = np.uint64


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all rows, sorted by row and hash, and the row of each."""
    data, offsets = buffers(column)
    starts, ends, rows = words(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes = strong_word_hashes(data, starts, ends, fold_ascii=True)
    grams = gram_hashes(hashes, SHINGLE)
    whole = np.flatnonzero(rows[: len(grams)] == rows[SHINGLE - 1 :]) if len(grams) else np.zeros(0, np.int64)
    first = np.searchsorted(rows, np.arange(len(column) + 1))
    short = np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < SHINGLE))
    found = np.concatenate([grams[whole], span_hashes(hashes, first[short], first[short + 1])])
    owner = np.concatenate([rows[whole], short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], owner[new]


#: For each register the order in which it looks for another to borrow from.
_RANK = np.argsort(np.random.default_rng(20240301).random((REGISTERS, REGISTERS)), axis=1).argsort(axis=1).astype(np.uint8)


def _borrowed(least: np.ndarray, empty: np.uint64) -> np.ndarray:
    """Empty registers of each row take the value of the filled one that comes first in their own fixed order.

    Two sets agree in such a register if the first that either has filled belongs to what they share, so it is as good as
    any; orders differ between registers, so they are independent. Rows are taken by how many registers they have filled.
    """
    filled = least != empty
    count = filled.sum(axis=1)
    out = least.copy()
    for m in np.unique(count[(count > 0) & (count < REGISTERS)]).tolist():
        rows = np.flatnonzero(count == m)
        for part in np.array_split(rows, 1 + len(rows) * m * REGISTERS // (16 << 20)):
            donors = np.nonzero(filled[part])[1].reshape(len(part), m)
            best = donors[np.arange(len(part))[:, None], _RANK.T[donors].argmin(axis=1)]
            out[part] = np.where(filled[part], least[part], least[part[:, None], best])
    return out


def registers(found: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """HyperMinHash registers, rows x REGISTERS (0 for an empty set): leading zeros << MANTISSA | mantissa."""
    empty = U64(np.iinfo(np.uint64).max)
    least = np.full(rows * REGISTERS, empty, np.uint64)
    h = mix(found)
    value = h << U64(REGISTERS.bit_length() - 1)
    value[value == empty] -= U64(1)
    np.minimum.at(least, owner * REGISTERS + (h >> U64(64 - REGISTERS.bit_length() + 1)).astype(np.int64), value)
    least = _borrowed(least.reshape(rows, REGISTERS), empty).ravel()
    # Leading zeros by the exponent of a float; the top 52 bits are exact there.
    top = np.maximum(least >> U64(12), U64(1))
    zeros = 51 - (np.frexp(top.astype(np.float64))[1] - 1)
    mantissa = ((least << np.minimum(zeros + 1, 63).astype(np.uint64)) >> U64(64 - MANTISSA)).astype(np.int64)
    out = (np.minimum(zeros, 63).astype(np.int64) << MANTISSA | mantissa).astype(np.uint16).reshape(rows, REGISTERS)
    out[np.bincount(owner, minlength=rows)[:rows] == 0] = 0
    return out


def collision_rate(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Chance that one register of two unrelated sets of n and m shingles is equal by compression alone.

    The least of s uniform hashes has density s(1-x)^(s-1). A cell of z leading zeros has width 2^-(z+1+MANTISSA);
    densities are taken as even inside a cell and are averaged over eight parts of each z.
    """
    sizes = [np.maximum(s / REGISTERS, 1.0)[:, None, None] for s in (n, m)]
    z = np.arange(40)[None, :, None]
    x = 2.0 ** -(z + 1) * (1 + (np.arange(8)[None, None, :] + 0.5) / 8)
    density = [s * (1 - x) ** (s - 1) for s in sizes]
    return (density[0] * density[1] * 2.0 ** -(2 * (z + 1) + MANTISSA)).sum(axis=1).mean(axis=1)


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimate of register rows a and b."""
    same, chance = (a == b).mean(axis=1), np.minimum(collision_rate(n, m), 0.5)
    return (same - chance) / (1 - chance)


_SKETCH = "doc_id long, n_shingles long, d1 long, d2 long, sketch binary, bands array<long>"


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows = batch.num_rows
        found, owner = shingle_sets(batch.column(1))
        sizes = np.bincount(owner, minlength=rows)
        sums = []
        for salt in (1, 2):
            total = np.zeros(len(found) + 1, np.uint64)
            np.cumsum(mix(found ^ U64(salt * 0xA0761D6478BD642F & 2**64 - 1)), out=total[1:])
            edge = np.concatenate([[0], np.cumsum(sizes)])
            sums.append((total[edge[1:]] - total[edge[:-1]]).view(np.int64))
        regs = registers(found, owner, rows)
        grouped = np.ascontiguousarray(regs).view(np.uint64)[:, : REGISTERS // ROWS] if ROWS == 4 else None
        bands = mix(grouped + np.arange(1, REGISTERS // ROWS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                pa.array(sizes.astype(np.int64)),
                pa.array(sums[0]),
                pa.array(sums[1]),
                pa.array([r.tobytes() for r in regs], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel())),
            ],
            ["doc_id", "n_shingles", "d1", "d2", "sketch", "bands"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found, owner = shingle_sets(batch.column(1))
        edge = np.searchsorted(owner, np.arange(batch.num_rows + 1))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "shingles": pa.array([found[x:y].tobytes() for x, y in zip(edge[:-1], edge[1:], strict=True)], pa.binary())})


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        get = lambda k: batch.column(batch.schema.get_field_index(k))
        a, b = (np.frombuffer(b"".join(get(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("sketch_a", "sketch_b"))
        near = estimate(a, b, get("n_a").to_numpy(), get("n_b").to_numpy()) >= THRESHOLD_PERCENT / 100 - SLACK
        yield pa.RecordBatch.from_arrays([get("a").filter(pa.array(near)), get("b").filter(pa.array(near))], ["a", "b"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        get = lambda k: batch.column(batch.schema.get_field_index(k))
        keep = []
        for x, y in zip(get("set_a"), get("set_b"), strict=True):
            u, v = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(u, v, assume_unique=True))
            keep.append(100 * both >= THRESHOLD_PERCENT * (len(u) + len(v) - both))
        keep = pa.array(keep, pa.bool_())
        yield pa.RecordBatch.from_arrays([get("a").filter(keep), get("b").filter(keep)], ["a", "b"])


def _links(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b) those that are links."""
    side = lambda k: reps.select(F.col("doc_id").alias(k), F.col("n_shingles").alias(f"n_{k}"), F.col("sketch").alias(f"sketch_{k}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {THRESHOLD_PERCENT} * greatest(n_a, n_b)")
    likely = cut(sized.mapInArrow(_likely, "a long, b long"), "minhash-likely")
    ids = cut(likely.select(F.col("a").alias("doc_id")).unionByName(likely.select(F.col("b").alias("doc_id"))).distinct(), "minhash-ids")
    few = ids.count() <= BROADCAST_IDS
    sets = cut(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary"), "minhash-sets")
    full = lambda k: sets.select(F.col("doc_id").alias(k), F.col("shingles").alias(f"set_{k}"))
    return likely.join(full("a"), "a").join(full("b"), "b").mapInArrow(_confirm, "a long, b long")


def _crossing(key: tuple, rows: pa.Table) -> pa.Table:
    """A link for each pair of components that the documents of side x and those of side y of a cell connect."""
    sets = [np.frombuffer(v, np.uint64) for v in rows.column("shingles").to_pylist()]
    ids, component = rows.column("doc_id").to_numpy(), rows.column("component").to_numpy()
    on_x = rows.column("on_x").to_numpy(zero_copy_only=False)
    x = np.flatnonzero(on_x)
    y = x if not (~on_x).any() else np.flatnonzero(~on_x)
    sizes = np.array([len(v) for v in sets], np.int64)
    found, where = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    # Only shingles of two documents or more count for an intersection; rows of the incidence are taken some at a time.
    often = np.flatnonzero(np.bincount(where, minlength=len(found)) > 1)
    place = np.full(len(found), -1)
    place[often] = np.arange(len(often))
    where, owner = place[where[place[where] >= 0]], owner[place[where] >= 0]
    both = np.zeros((len(x), len(y)), np.float32)
    row_of = [np.full(len(sets), -1) for _ in range(2)]
    row_of[0][x], row_of[1][y] = np.arange(len(x)), np.arange(len(y))
    order = np.argsort(where, kind="stable")
    where, owner = where[order], owner[order]
    step = max(1, CELL_BYTES // (4 * (len(x) + len(y))))
    for begin in range(0, len(often), step):
        own = slice(*np.searchsorted(where, (begin, begin + step)))
        sides = []
        for row, n in zip(row_of, (len(x), len(y)), strict=True):
            m = np.zeros((n, min(step, len(often) - begin)), np.float32)
            here = row[owner[own]]
            m[here[here >= 0], where[own][here >= 0] - begin] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    union = sizes[x][:, None] + sizes[y][None] - both
    i, j = np.nonzero((100 * both >= THRESHOLD_PERCENT * union) & (component[x][:, None] != component[y][None]))
    pairs = np.sort(np.stack([component[x[i]], component[y[j]]], axis=1), axis=1)
    first = np.unique(pairs, axis=0, return_index=True)[1] if len(pairs) else np.zeros(0, np.int64)
    return pa.table({"a": pa.array(ids[x[i[first]]], pa.int64()), "b": pa.array(ids[y[j[first]]], pa.int64())})


def _across(open_: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links between different components among documents that share a bucket; `open_` has band, doc_id, component.

    Documents are brought together by cluster (connected by shared buckets). Members outside a cluster's largest component
    must meet all others, exactly. A cluster is dealt into cells of two parts of about PART_SHINGLES shingles and PART_DOCS
    documents at most, each a group of its own, so no task holds more than that of a cluster, whatever its size; intersections are matrix products.
    The largest component's members don't meet one another. Cells grow with the square of what lies outside it:
    documents that share much and yet stay below the threshold are compared, none is passed over.
    """
    hubs = open_.groupBy("band").agg(F.min("doc_id").alias("a"))
    clusters = components(open_.join(hubs, "band").select("a", F.col("doc_id").alias("b"))).select(F.col("id").alias("doc_id"), F.col("component").alias("cluster"))
    members = cut(open_.select("doc_id", "component").distinct().join(clusters, "doc_id").join(reps.select("doc_id", "n_shingles"), "doc_id"), "minhash-members")
    few = members.count() <= BROADCAST_IDS
    sizes = members.groupBy("cluster", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("volume"))
    parts = lambda v, n: F.greatest(F.ceil(v / PART_SHINGLES), F.ceil(n / PART_DOCS), F.lit(1)).cast("int")
    main = sizes.groupBy("cluster").agg(F.max_by(F.struct("component", "volume", "n"), F.struct("n", "component")).alias("m"), F.sum("volume").alias("all"), F.sum("n").alias("docs"))
    plan = main.select("cluster", F.col("m.component").alias("main"), parts(F.col("m.volume"), F.col("m.n")).alias("main_parts"), parts(F.col("all") - F.col("m.volume"), F.col("docs") - F.col("m.n")).alias("rest_parts"))
    placed = members.join(plan, "cluster").withColumn("is_main", F.col("component") == F.col("main"))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.when(F.col("is_main"), F.col("main_parts")).otherwise(F.col("rest_parts")).cast("long")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    cell = lambda kind, i, j, on_x: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(on_x).alias("on_x"))
    p = F.col("part")
    against_main = F.transform(upto(F.col("main_parts")), lambda j: cell("main", p, j, True))
    among_rest = F.transform(upto(F.col("rest_parts")), lambda k: F.when(k >= p, cell("rest", p, k, True)).otherwise(cell("rest", k, p, False)))
    cells = F.when(F.col("is_main"), F.transform(upto(F.col("rest_parts")), lambda i: cell("main", i, p, False))).otherwise(F.concat(against_main, among_rest))
    dealt = placed.withColumn("part", part).select("doc_id", "cluster", "component", F.explode(cells).alias("c")).select("doc_id", "cluster", "component", "c.*")
    ids = members.select("doc_id")
    sets = cut(docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(_sets, "doc_id long, shingles binary").dropDuplicates(["doc_id"]), "minhash-sets")
    return dealt.join(sets, "doc_id").groupBy("cluster", "kind", "i", "j").applyInArrow(_crossing, "a long, b long")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept."""
    docs = documents.select("doc_id", "text")
    sketches = cut(docs.mapInArrow(_sketches, _SKETCH), "minhash-sketches")
    equal = ["n_shingles", "d1", "d2"]
    classes = cut(sketches.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*equal).agg(F.min("doc_id").alias("rep")), "minhash-classes")
    reps = cut(sketches.join(classes.select(F.col("rep").alias("doc_id"), *equal), ["doc_id", *equal], "left_semi").dropDuplicates(["doc_id"]), "minhash-reps")
    banded = reps.select("doc_id", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("doc_id").alias("centre"), F.count("*").alias("c")).where("c > 1").drop("c")
    buckets = cut(banded.join(shared, "band"), "minhash-buckets")
    ordered = lambda p: p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    stars = cut(ordered(buckets.where("doc_id <> centre").select(F.col("centre").alias("a"), F.col("doc_id").alias("b"))), "minhash-pairs")
    links = cut(_links(stars, reps, docs), "minhash-links")
    labels = components(links)
    placed = buckets.join(labels.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    split = placed.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("band")
    open_ = cut(placed.join(split, "band", "left_semi"), "minhash-open")
    found = links.unionByName(cut(_across(open_, reps, docs), "minhash-links"))
    final = components(found).withColumnRenamed("id", "rep")
    own = classes.join(final, "rep", "left").select(*equal, F.coalesce("component", "rep").alias("component_id"))
    out = sketches.select("doc_id", *equal).join(own, equal, "left")
    placed_in = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", placed_in.alias("component_id"), F.coalesce(F.col("doc_id") == placed_in, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
