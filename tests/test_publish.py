"""Publishing: notes written with backups, logs, and edge cases of reviews."""

import json

import pytest
from pyspark.sql import functions as F

from dossierflow.operators import model_stage, publish, review
from dossierflow.operators.filters import guard_root, leaves_root


def test_notes_are_written_once_and_backed_up(spark, tmp_path):
    notes = lambda *rows: spark.createDataFrame(list(rows), "path string, text string")
    run = lambda df, at=None: {r.path: r.action for r in publish.write_notes(df, str(tmp_path / "v"), at).collect()}
    assert run(notes(("a/x.md", "one"), ("y.md", None), ("../out.md", "no"))) == {"a/x.md": "created", "y.md": "created", "../out.md": "refused"}
    assert run(notes(("a/x.md", "one"), ("y.md", "two\r\n")), "T1") == {"a/x.md": "identical", "y.md": "replaced"}
    assert (tmp_path / "v/.backups/y_T1.md").read_text() == "" and (tmp_path / "v/y.md").read_bytes() == b"two\r\n"
    assert not (tmp_path / "out.md").exists()
    assert run(notes()) == {}


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, raw string")
    publish.append_log(rows, f"{tmp_path}/log")
    publish.append_log(rows, f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 6
    publish.append_new(rows, f"{tmp_path}/cache", "id")
    publish.append_new(spark.createDataFrame([(2, "changed"), (3, "c")], rows.schema), f"{tmp_path}/cache", "id")
    assert {(r.id, r.raw) for r in spark.read.json(f"{tmp_path}/cache").collect()} == {(1, "a"), (2, "b"), (3, "c")}


def test_unique_targets_fill_gaps(spark):
    rows = spark.createDataFrame([(i, "d/a.md") for i in range(3)] + [(9, "free.md")], "id long, target string")
    existing = spark.createDataFrame([("d/a.md",), ("d/a-2.md",), ("free-1.md",)], "target string")
    assert {r.id: r.target for r in review.unique_targets(rows, existing, "id").collect()} == {0: "d/a-1.md", 1: "d/a-3.md", 2: "d/a-4.md", 9: "free.md"}


def test_merges_of_nulls(spark):
    df = spark.sql("SELECT map('a', '1', 'b', NULL) AS o, CAST(NULL AS map<string,string>) AS n")
    assert df.select(review.merge_maps(F.col("o"), F.col("n"), "d").alias("m")).first().m == {"a": "1", "b": None}
    assert spark.sql("SELECT CAST(NULL AS array<int>) AS a, array(2, 1, 2) AS b").select(review.merge_lists(F.col("a"), F.col("b")).alias("m")).first().m == [2, 1]


def test_roots():
    for bad in ("/", "/home", "/etc/", "/srv/../tmp"):
        with pytest.raises(ValueError, match="root"):
            guard_root(bad)
    assert guard_root("/srv/clienti/../dati") == "/srv/dati" and guard_root("/", force=True) == "/"


def test_paths_that_leave_the_root(spark):
    rows = spark.createDataFrame([("/srv/a/x",), ("/srv/a/../b",), ("/srv/ab",), ("/srv/a/b/../c",), ("/srv/a",), ("/srv/a/./x/../../b/x",)], "path string")
    got = {r.path: r.out for r in rows.select("path", leaves_root(F.col("path"), "/srv/a").alias("out")).collect()}
    assert got == {"/srv/a/x": False, "/srv/a/../b": True, "/srv/ab": True, "/srv/a/b/../c": False, "/srv/a": False, "/srv/a/./x/../../b/x": True}


def test_failing_model_gives_reasons(spark):
    def model(prompts):
        if any("bad" in p for p in prompts):
            raise RuntimeError("no")
        return ["[]" for _ in prompts]

    rows = spark.createDataFrame([("k1", "fine"), ("k900", "bad"), ("k5", "fine")], "doc_id string, name string")
    asked = model_stage.prompts(rows, ["name"], batch=1)
    got = {r.ids[0]: (r.answer, r.error) for r in model_stage.ask(asked, model).collect()}
    assert got == {"k1": ("[]", None), "k5": ("[]", None), "k900": ("", "RuntimeError: no")}
    assert json.loads(asked.where(F.array_contains("ids", "k5")).first().prompt)[0]["name"] == "fine"
    assert sorted(len(r.ids) for r in model_stage.prompts(rows, ["name"], batch=2).collect()) == [1, 2]


def test_many_rows_of_one_target_build_no_list_each(spark):
    rows = spark.range(3000).select("id", F.lit("d/a.md").alias("target"))
    existing = spark.createDataFrame([("d/a.md",), ("d/a-2.md",), ("d/a-2.md",), ("d/a-1500.md",), ("d/b-7.md",)], "target string")
    found = review.unique_targets(rows, existing, "id")
    assert "sequence(" not in found._jdf.queryExecution().optimizedPlan().toString()
    free = [k for k in range(1, 3003) if k not in (2, 1500)]
    assert {r.id: r.target for r in found.collect()} == {i: f"d/a-{free[i]}.md" for i in range(3000)}


def test_a_document_is_parsed_once(spark):
    rows = spark.createDataFrame([('{"nome": 1, "sconto": 2, "x": {"a": 1.5}}',), ("no json",), (None,)], "j string")
    found = rows.select(review.validation_errors(F.col("j"), {"nome": "string", "sconto": "number", "x": "array"}).alias("e"))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 1
    missing = ["nome: missing", "tipo: missing"]
    assert [r.e for r in found.collect()] == [["nome: expected string, found integer", "tipo: missing", "x: expected array, found object"], missing, missing]
