"""Keyed tables: commits touch their buckets only, replays count once, lost updates are refused."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from reliq.operators import triage
from reliq.sources.keyed import ConcurrentWrite, KeyedTable
from reliq.sources.tables import Store
from reliq.streaming import ingest

ROW = "k string, n int, bucket int"


def upsert(old, new):
    return new if old is None else old.join(new.select("k"), "k", "left_anti").unionByName(new)


@pytest.fixture
def table(spark, tmp_path):
    made = KeyedTable(spark, str(tmp_path / "t"), ("k",), buckets=8)
    made.merge(spark.createDataFrame([(f"k{i}", i, 7) for i in range(100)] + [(None, -1, 7)], ROW), upsert)
    return made


def rows(table, version=None):
    return {r.k: r.n for r in table.read(version).collect()}


def test_an_update_of_one_key_leaves_other_buckets_untouched(spark, table, tmp_path):
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    before = table.manifest()["folders"]
    assert table.merge(spark.createDataFrame([("k5", 500, 1)], ROW), upsert) == 2
    after = table.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(before) == 8
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    assert rows(table) == {f"k{i}": i for i in range(100)} | {"k5": 500, None: -1}
    assert rows(table, 1)["k5"] == 5  # the commit before stays readable


def test_rows_can_go_and_buckets_can_become_empty(spark, table):
    gone = table.read().filter("k <> 'k7'").select("k")
    table.merge(gone, lambda old, keys: old.join(keys, "k", "left_anti"))
    assert rows(table) == {"k7": 7, None: -1}
    assert len(table.manifest()["folders"]) <= 2
    assert table.merge(gone.limit(0), upsert) is None
    table.merge(table.read().select("k"), lambda old, keys: old.limit(0))
    assert rows(table) == {} and table.read().columns == ["k", "n", "bucket"]


def test_a_replayed_batch_is_skipped(spark, table):
    one = spark.createDataFrame([("a", 1, 1)], ROW)
    add = lambda old, new: old.unionByName(new)
    assert table.merge(one, add, "w", 3) == 2
    assert table.merge(one, add, "w", 3) is None and table.merge(one, add, "w", 2) is None
    assert table.merge(one, add, "other", 2) == 3
    assert table.merge(one.limit(0), add, "w", 4) == 4  # an empty batch is remembered too
    assert table.read().filter("k = 'a'").count() == 2
    assert table.replace(table.read()) == 5 and table.merge(one, add, "w", 4) is None


def test_a_lost_race_raises_and_a_stale_hint_is_overcome(spark, table):
    manifest = table.manifest()
    table._commit(2, manifest)
    with pytest.raises(ConcurrentWrite):
        table._commit(2, {**manifest, "folders": {}})
    assert table.manifest(2) == manifest
    table._save("latest", "1")  # as after a crash between the commit and the hint
    assert table.version() == 2
    assert not list(table._fs().globStatus(table._path("manifests/.*-*")) or [])


def test_vacuum_keeps_what_the_newest_commits_name(spark, table):
    for n in (1, 2, 3):
        table.merge(spark.createDataFrame([("k5", n, 1)], ROW), upsert)
    before = rows(table), rows(table, 3)
    assert table.vacuum(keep=2) == 1  # the folder that only commit 2 names
    assert (rows(table), rows(table, 3)) == before


def test_an_older_stores_snapshot_is_taken_over(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    old = spark.createDataFrame([("A", "old"), ("B", "old")], "key string, summary string")
    for version in (1, 2):
        old.write.parquet(f"{tmp_path}/db/incidents/v_{version}")
    assert store.version("incidents") == 2 and store.exists("incidents")
    new = spark.createDataFrame([("B", "new")], old.schema)
    store.merge("incidents", new, lambda s, b: s.join(b, "key", "left_anti").unionByName(b))
    assert {r.key: r.summary for r in store.read("incidents").collect()} == {"A": "old", "B": "new"}
    assert {r.key: r.summary for r in store.read("incidents", 2).collect()} == {"A": "old", "B": "old"}


OBSERVED = "project string, signature string, category string, excerpt string, seen_at timestamp_ntz, log_id string"


def test_patterns_are_counted_once_per_batch(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    land = str(tmp_path / "land")

    def day(n):
        return datetime(2026, 1, n)

    first = [("p", "s", "timeout", "x", day(2), "l1"), ("p", "s", "data", "y", day(3), "l2"), ("p", None, "data", "z", day(3), "l3")]
    second = [("p", "s", "timeout", "late", day(5), "l4"), ("q", "s", "data", "new", day(4), "l5")]
    for rows in (first, second):
        spark.createDataFrame(rows, OBSERVED).write.mode("append").parquet(land)
        ingest.stream_patterns(spark, land, OBSERVED, store, str(tmp_path / "cp")).awaitTermination()
    expected = {("p", "timeout", 3, day(2), day(5), "late"), ("q", "data", 1, day(4), day(4), "new")}

    def counted():
        return {tuple(r) for r in store.read("failure_patterns").select("project", "category", "occurrences", "first_seen", "last_seen", "sample").collect()}

    assert counted() == expected
    writer, last = next(iter(store.keyed("failure_patterns").manifest()["writers"].items()))
    assert ingest.count_patterns(store, spark.createDataFrame(second, OBSERVED), writer, last) is None  # replayed
    assert counted() == expected
    whole = triage.record_patterns(None, spark.createDataFrame(first + second, OBSERVED).filter(F.col("signature").isNotNull()))
    assert {(r.project, r.occurrences) for r in whole.collect()} == {(p, n) for p, _, n, *_ in expected}


def test_layers_replace_and_remove_without_rewriting(spark, table, tmp_path):
    files = set((tmp_path / "t").rglob("*.parquet"))

    def put(*found):
        return table.put(spark.createDataFrame([(*r, True) for r in found], ROW + ", changed boolean"), ["k", "n", "bucket"], "changed")

    put(("k5", 500, 1), ("new", 1, 1))
    put(("k5", 501, 1))
    table.remove(spark.createDataFrame([("k6",), ("unknown",)], "k string"))
    put(("k7", 700, 1))
    expected = {f"k{i}": i for i in range(100) if i != 6} | {"k5": 501, "k7": 700, "new": 1, None: -1}
    assert rows(table) == expected and table.read().count() == len(expected)
    new = set((tmp_path / "t").rglob("*.parquet")) - files
    assert files <= set((tmp_path / "t").rglob("*.parquet"))
    assert sum(spark.read.parquet(str(f)).count() for f in new) == 6
    found = table.find(spark.createDataFrame([("k5",), ("k6",), ("k8",), ("none",)], "k string"), ["n"])
    assert {tuple(r) for r in found.collect()} == {("k5", 501), ("k8", 8)}
    version = table.compact()
    assert not table.manifest()["layers"] and rows(table) == expected and rows(table, version - 1) == expected
    put(("k1", 100, 1))
    table.merge(spark.createDataFrame([("k2", 200, 1)], ROW), upsert)  # folds first
    assert rows(table) == expected | {"k1": 100, "k2": 200}
    table.vacuum(keep=1)
    assert rows(table) == expected | {"k1": 100, "k2": 200}


def test_layers_fold_after_some(spark, table, monkeypatch):
    monkeypatch.setattr("reliq.sources.keyed.LAYERS", 2)
    for n in range(6):
        table.put(spark.createDataFrame([("k5", n, 1, True)], ROW + ", changed boolean"), ["k", "n", "bucket"], "changed")
    assert rows(table)["k5"] == 5 and table.read().count() == 101
    assert len(table.manifest()["layers"]) == 2 and table.manifest()["folded"] == 4
