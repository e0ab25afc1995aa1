"""The paged source: pushed filters, guards, bad items, numbered pages, waits."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dossierflow.sources import paged


def rows(df):
    return sorted(((r.resource, r.page, r.item_id, r.problem) for r in df.collect()), key=repr)


@pytest.fixture()
def stored(spark, tmp_path):
    """Ninety messages of two mailboxes, newest first, ten a page."""
    items = [(f"box{k % 2}", k * 3600, json.dumps({"id": f"m{k}", "at": f"2026-01-01T{k // 4:02d}:{k % 4}0:00Z"})) for k in range(90)]
    df = spark.createDataFrame(items, "resource string, s long, item string").select("resource", F.timestamp_seconds("s").alias("at"), "item")
    paged.write_pages(df, f"{tmp_path}/pages", per_page=10)
    return f"{tmp_path}/pages"


def test_pages_come_back_whole_and_in_order(spark, stored):
    found = paged.read_pages(spark, f"file://{stored}", ("box0", "box1")).collect()
    assert sorted(r.item_id for r in found) == sorted(f"m{k}" for k in range(90))
    assert {r.problem for r in found} == {None}
    last = {}
    for r in sorted(found, key=lambda r: (r.resource, r.page)):
        assert last.get(r.resource, r.at) >= r.at or last[r.resource] >= min(x.at for x in found if (x.resource, x.page) == (r.resource, r.page))
        last[r.resource] = r.at


def test_filters_reach_the_reader(spark, stored, tmp_path):
    requests = lambda name: sorted(x.rpartition("-resource=")[2] for x in os.listdir(tmp_path / name))
    read = lambda name: paged.read_pages(spark, stored, ("box0", "box1"), order="newest-first", request_log=f"{tmp_path}/{name}")
    assert read("all").count() == 90 and len(requests("all")) >= 10
    late = read("late").where("resource = 'box0' AND at >= timestamp'2026-01-01 20:00:00'")
    assert sorted(r.item_id for r in late.collect()) == sorted(f"m{k}" for k in range(80, 90, 2))
    assert set(requests("late")) == {"box0_page=1", "box0_page=2"}
    strict = read("strict").where("resource IN ('box1') AND at > timestamp'2026-01-01 21:30:00'")
    assert [r.item_id for r in strict.collect()] == ["m89"]
    # A filter that the reader does not know stays with Spark.
    assert read("other").where("item_id = 'm3' AND resource = 'box1'").count() == 1
    assert read("none").where("resource = 'box2'").count() == 0


def use(spark, name, resources=("r",), **options):
    return paged.read_pages(spark, "none", resources, transport=f"transports:{name}", **options)


def test_a_looped_link_ends_the_resource(spark):
    assert rows(use(spark, "Circle", ("a", "b"))) == sorted([(r, *x) for r in "ab" for x in ((1, "m1", None), (2, "m2", None), (2, None, "loop"))], key=repr)


def test_one_bad_item_leaves_the_rest(spark):
    got = use(spark, "Odd").collect()
    assert [(r.item_id, r.problem) for r in got] == [(None, "no id"), ("m1", None), (None, "no object"), ("late", None), ("m2", None)]
    assert json.loads(got[0].item) == {"id": None, "subject": "broken"} and got[3].at is None
    assert use(spark, "Odd").where("at >= timestamp'2026-01-02 00:00:00'").count() == 1


def test_repeated_ids_and_the_page_bound_end_it(spark):
    assert rows(use(spark, "Endless", paging="numbers", per_page="2")) == sorted([("r", 1, "m1", None), ("r", 1, "m2", None), ("r", 2, "m3", None), ("r", 2, "m4", None), ("r", 3, "m1", None), ("r", 3, "m2", None), ("r", 3, None, "loop")], key=repr)
    assert rows(use(spark, "Endless", paging="numbers", per_page="3")) == [("r", 1, "m1", None), ("r", 1, "m2", None)]
    got = rows(use(spark, "Long", max_pages="5"))
    assert len(got) == 6 and [r for r in got if r[3]] == [("r", 6, None, "page bound")]


def test_waits_and_gives_up(spark, tmp_path):
    assert len(rows(use(spark, "Busy", busy="2", state=f"{tmp_path}/a"))) == 2
    with pytest.raises(PySparkException, match="try again"):
        use(spark, "Busy", busy="3", state=f"{tmp_path}/b").collect()


def test_numbered_pages_are_parts(spark, tmp_path, monkeypatch):
    items = spark.range(45).select(F.lit("r").alias("resource"), F.timestamp_seconds("id").alias("at"), F.to_json(F.struct(F.col("id"))).alias("item"))
    paged.write_pages(items, f"{tmp_path}/p", per_page=2, numbered=True)
    monkeypatch.setattr(paged, "SPLIT_PAGES", 5)
    options = {"root": f"{tmp_path}/p", "resources": "r", "paging": "numbers", "per_page": "2"}
    parts = paged.PagedReader(options).partitions()
    found = [i for p in parts for b in paged.PagedReader(options).read(p) for i in b.column(2).to_pylist()]
    assert len(parts) >= 5 and sorted(map(int, found)) == list(range(45))
    bound = paged.PagedReader(options | {"max_pages": "7"})
    assert [b.column(5).to_pylist()[-1] for p in bound.partitions() for b in bound.read(p)] == [None] * 7 + ["page bound"]
