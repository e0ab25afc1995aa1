"""Whitening, suffix dedup and delta Lloyd against brute force, on nulls, empty and long texts, ties, repeated rows, clashing columns and empty tables."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from harness import oracle, ours

from dossierflow.llm import delta_lloyd, suffix_dedup, whitening

DOCS = "doc_id long, text string, grp string, uid string, bucket int, kept int"
VECTORS = "vec_id long, embedding array<float>, n int, cluster string, x string, component string"


# ---------------------------------------------------------------- 12


def brute(rows):
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            if d is not None:
                least[b[p : p + 50]] = min(least.get(b[p : p + 50], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if d is not None and least[b[p : p + 50]] < d:
                gone[p : p + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((d, len(b), int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in df.collect()), key=repr)


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("aeioußlñ日") for _ in range(rng.randrange(2, 8)))
    say = lambda n: " ".join(word() for _ in range(n))
    passage, common = say(40), "the same sixteen bytes and some more"
    rows = [(0, None), (1, ""), (2, "x" * 49), (3, "x" * 50), (4, "x" * 3000), (5, passage), (6, passage), (6, passage), (7, None)]
    rows += [(None, passage), (None, passage), (8, passage[:60] + say(3) + passage[60:]), (8, say(9) + passage[5:70]), (9, "\0" * 120), (10, "\0" * 51 + "a")]
    # Many different contexts of one anchor, and one passage that repeats within and across documents.
    rows += [(100 + i, say(3) + common + say(2) + (passage[20 : 80 + i] if i % 3 else "")) for i in range(60)]
    rows += [(50, (say(6) + "\n") * 40), (-3, say(12_000)), (300, say(5) + passage + say(4) + passage)]
    long = rows[-2][1]
    rows += [(301, long[500:90_000]), (302, long[:40] + "#" + long[40:100] + "#" + long[100:30_000])]
    return rows


@pytest.mark.parametrize("part,piece,wide,wide_all", [(12 << 20, 1 << 20, 64, 4096), (20_000, 4_000, 2, 3)])
def test_suffix_dedup_against_all_strings(spark, monkeypatch, part, piece, wide, wide_all):
    monkeypatch.setattr(suffix_dedup, "WIDE", wide)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", piece)
    monkeypatch.setattr(suffix_dedup, "WIDE_ALL", wide_all)
    rows = texts()
    docs = spark.createDataFrame([(d, t, "clash", "clash", 1, 2) for d, t in rows], DOCS).repartition(5)
    want = brute(rows)
    assert sum(w[2] for w in want) > 50_000
    assert found(suffix_dedup.remove_seen(docs, part)) == want


def test_suffix_dedup_of_no_rows(spark):
    assert suffix_dedup.remove_seen(spark.createDataFrame([], DOCS)).collect() == []
    got = suffix_dedup.remove_seen(spark.createDataFrame([(1, None, "", "", 0, 0)], DOCS)).collect()
    assert [(r.doc_id, r.n_bytes, bytes(r.kept)) for r in got] == [(1, 0, b"")]


def test_levels_are_equal_sized_and_merge():
    reported = []
    family = suffix_dedup.Family(suffix_dedup._by_block, suffix_dedup._same_block, reported.append)
    rng = np.random.default_rng(1)
    for k in range(11):
        batch = np.zeros(100, suffix_dedup._BLOCK)
        batch["sort"], batch["doc"], batch["n"] = rng.integers(0, 2**60, 100), k, 1
        batch["sort"][:10] = np.arange(10)
        family.add(batch)
    assert sorted(family.levels) == [0, 1, 3]
    assert all((np.diff(level["sort"].astype(np.int64)) >= 0).all() for level in family.levels.values())
    left = family.whole(suffix_dedup._BLOCK)
    assert len(left) == 11 * 90 + 10 and sum(map(len, reported)) == 100
    assert set(left["doc"][left["sort"] < 10]) == {0}


def test_suffix_dedup_equals_its_sql(spark, sf):
    assert ours(suffix_dedup.query(spark, sf)) == oracle(sf, suffix_dedup.ORACLE)


# ---------------------------------------------------------------- 11


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 7, "clash", "clash", "clash") for i, v in rows], VECTORS).repartition(3)


ODD = [(90, None), (91, []), (92, [1.0, None, 2.0]), (93, [float("nan"), 1.0, 2.0]), (94, [1.0, float("inf"), 2.0]), (95, [1.0, 2.0]), (96, [-float("inf")] * 3)]


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 3)) @ np.array([[1.0, 0.5, 0.0], [0.0, 0.4, 0.1], [0.0, 0.0, 0.05]])
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base)] + ODD
    rows += [rows[0], (None, rows[1][1]), (5, rows[3][1])]
    clean, size = whitening.clean(vectors(spark, rows))
    model = whitening.fit(clean, size)
    got = whitening.whiten(clean, size, model).collect()
    use = [(i, v) for i, v in rows if v is not None and len(v) == 3 and all(x is not None and np.isfinite(x) for x in v)]
    x = np.floor(1024 * np.array([v for _, v in use])).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    e, axes = np.linalg.eigh(y.T @ y / n)
    e, axes = e[::-1], axes[:, ::-1]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
    white, far = y @ axes / np.sqrt(e), ((n * x - s) ** 2).sum(axis=1)
    want = sorted((repr(i), k + 1, n, int(far[r]), round(white[r, k], 7), round(e[k] / e.sum(), 9)) for r, (i, _) in enumerate(use) for k in range(3))
    assert sorted((repr(r.vec_id), r.component, r.n, r.deviation, round(r.whitened, 7), round(r.explained, 9)) for r in got) == want
    assert {r.identity_error for r in got} == {model.identity_error} and model.identity_error < 1e-9


def test_whitening_of_flat_huge_and_no_vectors(spark):
    clean, size = whitening.clean(vectors(spark, ODD))
    assert size == 2 and [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(clean, size, whitening.fit(clean, size)).collect()] == [(k, 1, 0, None, None, None) for k in (1, 2)]
    clean, size = whitening.clean(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0])]))
    rows = whitening.whiten(clean, size, whitening.fit(clean, size)).collect()
    assert sorted((r.vec_id, r.component, r.whitened) for r in rows if r.component == 1) == [(1, 1, -1.0), (2, 1, 1.0)]
    assert {(r.whitened, r.explained) for r in rows if r.component == 2} == {(None, 0.0)}
    clean, size = whitening.clean(vectors(spark, [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.5, 1.0])]))
    assert whitening.whiten(clean, size, whitening.fit(clean, size)).count() == 6
    clean, size = whitening.clean(vectors(spark, ODD[:3]))
    assert size == 0 and whitening.whiten(clean, size, whitening.fit(clean, size)).collect() == []


def test_deviations_are_exact_or_null():
    x = np.array([[2**36, 5], [0, 7]])
    exact = lambda n, s: [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
    for n, s in ((2, [2**36, 12]), (2**20, [2**55, 2**20]), (2**30, [2**66, 0])):
        assert whitening._deviations(x, n, s) == [v if v < 2**63 else None for v in exact(n, s)]


# ---------------------------------------------------------------- 13


def plain(rows, clusters, rounds, dimensions):
    use = [(i, [int(min(max(np.floor(64 * float(c)), -(2**27)), 2**27)) for c in v]) for i, v in rows if v is not None and len(v) == dimensions and all(c is not None and np.isfinite(c) for c in v)]
    order = sorted(use, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes()))
    centroids = [v for _, v in order[:clusters]]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    for k in range(rounds + 1):
        owner = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in use]
        if k < rounds:
            members = defaultdict(list)
            for (_, v), (_, j) in zip(use, owner, strict=True):
                members[j].append(v)
            centroids = [[sum(c) // len(members[j]) for c in zip(*members[j], strict=True)] if members[j] else centroids[j] for j in range(len(centroids))]
    total = defaultdict(int)
    for d, j in owner:
        total[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((repr(i), j, d, total[j], sum(total.values()), sha[j]) for (i, _), (d, j) in zip(use, owner, strict=True))


@pytest.mark.parametrize("rounds", [0, 1, 5])
def test_delta_lloyd_against_plain_rounds(spark, rounds):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(150, 3)).round(1))] + ODD
    rows += [rows[0], rows[0], (None, rows[1][1]), (5, rows[3][1]), (200, [3e38, -3e38, 0.0])]
    rows += [(300 + i, [1.0, 1.0, 1.0]) for i in range(80)]
    got = delta_lloyd.lloyd(vectors(spark, rows), clusters=7, rounds=rounds, dimensions=3).collect()
    assert sorted((repr(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == plain(rows, 7, rounds, 3)


def test_delta_lloyd_of_few_and_no_vectors(spark):
    same = [(i, [0.5, 0.5, 0.5]) for i in range(4)]
    got = delta_lloyd.lloyd(vectors(spark, same), clusters=7, rounds=3, dimensions=3).collect()
    assert {(r.cluster, r.distance) for r in got} == {(0, 0)} and len(got) == 4
    assert delta_lloyd.lloyd(vectors(spark, ODD[:2]), dimensions=3).collect() == []


def test_delta_lloyd_equals_its_sql(spark, sf):
    assert ours(delta_lloyd.query(spark, sf)) == oracle(sf, delta_lloyd.ORACLE)
