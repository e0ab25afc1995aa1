"""Nested documents: flatten and assemble, both merges, validation, against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from dossierflow.operators import nested

DAY = "2025-06-15"


def frame(spark, rows):
    return spark.createDataFrame([(k, json.dumps(d, ensure_ascii=False) if not isinstance(d, str) else d) for k, d in rows], "pk long, doc string")


def anything(rng, depth=0):
    kind = rng.randrange(9 if depth < 4 else 6)
    if kind >= 6:
        return {rng.choice(['a', 'b', 'c.d', 'e"f', "g[0]", "è\n", "~/x"]): anything(rng, depth + 1) for _ in range(rng.randrange(4))}
    return [rng.randrange(5), rng.choice(["x", "yy", "", "è \\ \" \n" * 9, "long " * 20]), None, rng.random() < 0.5, [rng.choice([1, "1", {"k": 2}, None]) for _ in range(rng.randrange(4))], 1.5][kind]


def test_documents_come_back(spark):
    rng = random.Random(2)
    rows = [(k, {f"f{i}": anything(rng) for i in range(rng.randrange(1, 6))}) for k in range(60)] + [(100, {}), (101, {"a": {}}), (102, [1]), (103, "no json"), (104, None)]
    docs = frame(spark, rows[:-2]).unionByName(spark.createDataFrame([(103, "{broken"), (104, None)], "pk long, doc string"))
    got = {r.pk: json.loads(r.document) for r in nested.assembled(nested.leaves(docs, ["pk"], "doc"), ["pk"]).collect()}
    assert got == {k: d for k, d in rows[:-2]}


def review(v, c):
    """The rules in plain recursion."""
    out = dict(v)
    for key, new in c.items():
        if key not in v or v[key] == new and type(v[key]) is type(new):
            out[key] = new
            continue
        old = v[key]
        if isinstance(old, list) and isinstance(new, list):
            seen = []
            out[key] = [x for x in old + new if not (json.dumps(x, sort_keys=True) in seen or seen.append(json.dumps(x, sort_keys=True)))]
        elif isinstance(old, dict) and isinstance(new, dict):
            out[key] = review(old, new)
        elif isinstance(old, str) and isinstance(new, str) and ("\n" in old or "\n" in new or len(old) > 80 or len(new) > 80):
            out[key] = old if new in old else f"{old}\n\n— aggiornamento {DAY} —\n{new}"
        else:
            out[key] = new
    return out


def test_nested_merge_against_plain_recursion(spark):
    old = {"nome": "A", "cond": {"sconto": "10%", "resi": "si", "fondo": {"x": 1, "y": [1, 2]}}, "prodotti": ["a", "b"], "note": "x" * 90, "n": 1, "t": {"u": 1}, "w": "flat", "e": {}}
    new = {"nome": "B", "cond": {"sconto": "12%", "fondo": {"y": [2, 3, {"z": 1}], "z": None}}, "prodotti": ["b", "c"], "note": "y", "n": 1.5, "t": "now a text", "w": {"in": {"deep": 2}}, "e": {"k": 1}}
    rng = random.Random(5)
    pairs = [(0, old, new), (1, new, old), (2, old, old), (3, {"a": {"b": 1}}, {"a": {}}), (4, {"a": {}}, {"a": {}}), (5, {"a": 1}, {"a": {}}), (6, {"a": {"b": {"c": 1}}}, {"a": {"b": 2}})]
    pairs += [(10 + k, {f"f{i}": anything(rng) for i in range(3)}, {f"f{i}": anything(rng) for i in range(4)}) for k in range(80)]
    merged = nested.merge_documents(frame(spark, [(k, a) for k, a, _ in pairs] + [(900, {"only": 1})]), frame(spark, [(k, b) for k, _, b in pairs] + [(901, {"only": {"new": 1}})]), ["pk"], "doc", DAY)
    got = {r.pk: json.loads(r.doc) for r in merged.collect()}
    want = {k: review(a, b) for k, a, b in pairs} | {900: {"only": 1}, 901: {"only": {"new": 1}}}
    assert {k for k in want if got.get(k) != want[k]} == set(), [(k, got.get(k), want[k]) for k in want if got.get(k) != want[k]][:2]


def test_candidates_fold_by_confidence(spark):
    rows = [
        (1, 1, {"nome": "A", "cond": {"sconto": "10%", "resi": ""}, "tags": ["x"], "note": "one"}, 0.8),
        (1, 2, {"nome": "B", "cond": {"sconto": "12%", "resi": "si", "porto": {"zona": 1}}, "tags": ["y", "x"], "note": "two"}, 0.6),
        (1, 3, {"nome": "C", "cond": {"sconto": "15%"}, "tags": None, "note": "two", "extra": 5}, 0.75),
        (2, 1, {}, 0.3),
        (3, 2, {"nome": "later"}, 0.5),
        (3, 1, {"nome": "sooner"}, 0.5),
    ]
    df = spark.createDataFrame([(a, b, json.dumps(d), c) for a, b, d, c in rows], "entity long, k0 long, doc string, confidence double")
    got = {r.entity: (json.loads(r.doc), round(r.confidence, 6), r.n) for r in nested.merge_confident(df, ["entity"], "k0", "doc", "confidence").collect()}
    assert got[1] == ({"nome": "C", "cond": {"sconto": "15%", "resi": "si", "porto": {"zona": 1}}, "tags": ["x", "y"], "note": "one\n\n---\n\ntwo\n\n---\n\ntwo", "extra": 5}, 0.725, 3)
    assert got[2] == ({}, 0.3, 1) and got[3][0] == {"nome": "sooner"}


def test_nested_errors_are_sorted_by_path(spark):
    sample = {"tipo": "cliente", "nome": "A", "anni": 3, "quota": 1.5, "vivo": True, "cond": {"sconto": "1%", "fondo": {"n": 1}}, "tags": ["x"], "eventi": [{"data": "d", "n": 1}], "vuoto": None}
    rules = nested.infer_rules(frame(spark, [(0, sample)]), "doc")
    assert {(r.rule, r.kind, r.required) for r in rules.collect()} == {
        ("tipo", "string", True), ("nome", "string", True), ("anni", "integer", False), ("quota", "number", False), ("vivo", "boolean", False), ("cond", "object", False), ("cond/sconto", "string", False),
        ("cond/fondo", "object", False), ("cond/fondo/n", "integer", False), ("tags", "array", False), ("tags/[]", "string", False), ("eventi", "array", False), ("eventi/[]", "object", False), ("eventi/[]/data", "string", False), ("eventi/[]/n", "integer", False),
    }
    docs = [
        (1, sample),
        (2, {"nome": None, "anni": 3.0, "quota": 2, "vivo": "si", "cond": {"sconto": 5, "fondo": {"n": "x"}}, "tags": ["a", 2, None], "eventi": [{"data": 1}] * 2 + [7] + [{"n": 1.5}] * 9, "altro": 1}),
        (3, {"tipo": "x", "nome": "y", "cond": "flat", "tags": {"a": 1}, "vuoto": 9}),
        (4, {}),
    ]
    got = {r.pk: r.errors for r in nested.errors(frame(spark, docs), ["pk"], "doc", rules).collect()}
    assert got[1] == [] and got[4] == ["nome: missing", "tipo: missing"]
    assert got[3] == ["cond: expected object, found string", "tags: expected array, found object"]
    assert got[2] == [
        "cond.fondo.n: expected integer, found string", "cond.sconto: expected string, found integer", "eventi.0.data: expected string, found integer", "eventi.1.data: expected string, found integer",
        "eventi.2: expected object, found integer", *[f"eventi.{k}.n: expected integer, found number" for k in range(3, 12)], "nome: expected string, found null", "tags.1: expected string, found integer", "tipo: missing", "vivo: expected boolean, found string",
    ]


@pytest.mark.parametrize("f", [lambda d: nested.leaves(d, ["pk"], "doc"), lambda d: nested.merge_documents(d, d, ["pk"], "doc", DAY), lambda d: nested.errors(d, ["pk"], "doc", nested.infer_rules(d, "doc"))])
def test_no_documents(spark, f):
    assert f(spark.createDataFrame([], "pk long, doc string")).where(F.lit(True)).collect() == []
