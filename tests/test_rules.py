"""Golden cases of the rule operators and text functions."""

import pytest
from pyspark.sql import functions as F

from dossierflow.functions import text as X
from dossierflow.operators import categorize, dashboard, dedup, documents, incremental, objects, redaction

def now():
    return F.timestamp_seconds(F.lit(1_750_000_000))


DAY = 86400


def record(spark, **kw):
    base = {"name": "x.pdf", "path": "/srv/x.pdf", "size": 10, "age": 10}
    row = base | kw
    df = spark.createDataFrame([(row["name"], row["path"], row["size"], 1_750_000_000 - row["age"] * DAY)], "name string, path string, size long, m long")
    return df.withColumn("mtime", F.timestamp_seconds("m"))


@pytest.mark.parametrize(
    ("kw", "category", "confidence"),
    [
        ({"age": 10}, "vivo", 0.6),
        ({"age": 89}, "vivo", 0.6),
        ({"age": 90}, "da-chiarire", 0.3),
        ({"age": 1095}, "archivio", 0.6),
        ({"age": 10, "path": "/srv/clienti/a/x.pdf"}, "vivo", 1.0),
        ({"age": 10, "path": "clienti/a/x.pdf"}, "vivo", 0.6),
        ({"age": 400, "path": "/x/contratti/a.pdf"}, "da-consultare", 0.9),
        ({"age": 10, "name": "~$untitled.docx"}, "cestino", 1.0),
        ({"age": 400, "name": "gold_old.pdf", "path": "/x/gold_old.pdf"}, "archivio", 1.0),
    ],
)
def test_classify(spark, kw, category, confidence):
    row = categorize.classify(record(spark, **kw), now()).first()
    assert (row.category, round(row.confidence, 6)) == (category, confidence)


def test_classify_takes_nulls(spark):
    df = spark.createDataFrame([(None, None, None, None)], "name string, path string, size long, mtime timestamp")
    assert categorize.classify(df, now()).count() == 1


@pytest.mark.parametrize(
    ("name", "base", "matched"),
    [("nome copia.pdf", "nome", True), ("Copia di nome.pdf", "nome", True), ("nome_v2_FINAL.docx", "nome", True), ("nome (2).txt", "nome", True), ("nome.txt", "nome", False), ("rev10.txt", "re", True), (".bashrc", "", False), ("a", "a", False)],
)
def test_normalize_base(spark, name, base, matched):
    row = spark.createDataFrame([(name,)], "name string").select(X.base_passes(F.col("name")).alias("b")).first().b
    assert (row.base, row.matched) == (base, matched)


def test_slugify(spark):
    rows = spark.createDataFrame([("Caffè & Figli S.r.l.",), ("日本",), ("",)], "v string").select(X.slugify(F.col("v")).alias("s")).collect()
    assert [r.s for r in rows] == ["caffe-figli-s-r-l", "ignoto", "ignoto"]


def test_mark_duplicates_priority_and_missing(spark):
    rows = [("nas", "1", "h", 5, 0), ("gdrive", "2", "h", 1, 1), ("email", "3", None, 1, 2), ("email", "4", None, 1, 3)]
    df = spark.createDataFrame(rows, "source string, source_id string, sha256 string, mtime long, ord long")
    role = {r.source_id: r.role for r in dedup.mark_duplicates(df, F.col("ord")).collect()}
    assert role == {"1": "duplicate-of", "2": "canonical", "3": "unique", "4": "unique"}
    role = {r.source_id: r.role for r in dedup.mark_duplicates(df, F.col("ord"), group_missing=True).collect()}
    assert role["3"] == "canonical" and role["4"] == "duplicate-of"


def test_addresses(spark):
    raw = '"Anna Rossi" <A@Rossi.it>, b@x.com, "no mail", Mario <m@y.org>'
    got = spark.createDataFrame([(raw,), (None,)], "r string").select(objects.addresses(F.col("r")).alias("a")).collect()
    assert [(x.name, x.email) for x in got[0].a] == [("Anna Rossi", "a@rossi.it"), ("", "b@x.com"), ("Mario", "m@y.org")]
    assert got[1].a == []


def test_signature(spark):
    body = "Buongiorno\n\nCordiali saluti\nMario Rossi\nDirettore\nTel. +39 02 1234567"
    row = spark.createDataFrame([(body,), ("none",)], "b string").select(objects.signature(F.col("b")).alias("s")).collect()
    assert row[0].s.role == "Direttore" and row[0].s.phone.endswith("02 1234567") and row[1].s is None


def test_redaction_round_trip_and_known_ids(spark):
    docs = spark.createDataFrame([(1, "a@b.it tel 02 1234 567"), (2, "c@d.it a@b.it"), (3, None)], "doc_id long, text string")
    names = redaction.dictionary(docs)
    got = {r.value: r.placeholder for r in names.collect()}
    assert got["a@b.it"] == "<email-1>" and got["c@d.it"] == "<email-2>"
    hidden = redaction.redact(docs, names)
    assert "@" not in "".join(r.text or "" for r in hidden.collect())
    back = {r.doc_id: r.text for r in redaction.unredact(hidden, names).collect()}
    assert back == {1: "a@b.it tel 02 1234 567", 2: "c@d.it a@b.it", 3: None}
    more = redaction.dictionary(spark.createDataFrame([(9, "z@z.it a@b.it")], "doc_id long, text string"), known=names)
    assert {r.value: r.placeholder for r in more.collect()}["z@z.it"] == "<email-3>"


def test_merge_rules(spark):
    rows = [("k", 1, 0.5, "A", "n1"), ("k", 2, 0.5, "B", "n2"), ("k", 3, 0.9, "C", "n2 "), ("z", 1, 0.2, None, None)]
    df = spark.createDataFrame(rows, "id string, ord int, confidence double, nome string, note string")
    got = {r.id: r for r in incremental.merge_candidates(df, ["id"], "ord", ["nome"], ["note"]).collect()}
    assert got["k"].nome == "C" and got["k"].confidence == pytest.approx(0.7) and got["k"].note == "n1\n\n---\n\nn2\n\n---\n\nn2"
    assert got["z"].nome is None and got["z"].n == 1


def test_chunks_by_heading(spark):
    text = "# A\n" + "x" * 100 + "\n# B\n" + "y" * 100
    got = documents.chunks(spark.createDataFrame([(1, text), (2, "short"), (3, None), (4, " ")], "doc_id long, text string"), 30).collect()
    assert sorted((r.doc_id, r.chunk_index, r.chunk[:3]) for r in got) == [(1, 0, "# A"), (1, 1, "# B"), (2, 0, "sho")]


def test_actions_of_nothing_and_of_all_well(spark):
    progress = spark.createDataFrame([("nas", 5, 5, 5)], "source string, discovered long, extracted long, categorized long")
    named = lambda *rows: spark.createDataFrame(list(rows), "name string, n long")
    notes, objects = spark.createDataFrame([], "path string"), spark.createDataFrame([], "area string, object string, need string")
    ask = lambda *parts: [(r.place, r.action, r.n) for r in dashboard.all_actions(*parts).orderBy("place").collect()]
    assert ask(progress.where("false"), named(), named(), notes, objects) == [(1, "scan", 0.0)]
    assert ask(progress, named(("approved", 3)), named(("vivo", 4), ("da-chiarire", 1)), notes, objects) == [(8, "fine", 0.0)]
    missing = spark.createDataFrame([("clienti", "a", "x"), ("clienti", "a", "y"), ("clienti", "b", "x")], objects.schema)
    got = ask(progress.selectExpr("source", "discovered", "extracted - 2 AS extracted", "categorized"), named(("pending", 2)), named(("vivo", 3), ("da-chiarire", 1)), notes, missing)
    assert got == [(2, "extract", 2.0), (4, "approve", 2.0), (5, "review-rules", 25.0), (7, "complete-objects", 2.0)]
