from datetime import datetime

import pytest

from reliq import checks
from reliq.functions import times
from reliq.operators import history, search

T = datetime(2026, 5, 1)


@pytest.fixture(scope="module")
def db(spark):
    runs = spark.createDataFrame(
        [(1, datetime(2026, 5, 1)), (2, datetime(2026, 5, 10)), (3, datetime(2026, 5, 18)), (4, None)], "run_id bigint, effective_ts timestamp_ntz")
    cases = [
        (1, 1, "a.Auth", "test_oauth_login", "src/a.py", "failed", "token expired", "E", "x" * 600),
        (2, 2, "a.Auth", "test_oauth_login", "src/a.py", "error", "token expired", "E", "y" * 10),
        (3, 3, "a.Auth", "test_oauth_login", "src/a.py", "passed", None, None, None),
        (4, 1, None, "weird*name\"x", "src/a_b.py", "failed", "boom", "E", "tr"),
        (5, 1, None, "t", "src/aXb.py", "failed", None, None, None),
        (6, 4, "a.Auth", "test_logout", "src/a.py", "failed", None, None, None),
        (7, 2, "a.Auth", "test_logout", "Src/a.py", "failed", None, None, None),
    ]
    return spark.createDataFrame(
        cases, "case_id bigint, run_id bigint, classname string, name string, file_path string, status string, failure_message string, failure_type string, stack_trace string"), runs


def lookup(spark, db, *ids, **kw):
    df = spark.createDataFrame([(i,) for i in ids], "test_id string")
    return {r.test_id: r for r in history.failure_lookup(df, *db, **kw).collect()}


def test_lookup_by_class_file_and_name(spark, db):
    out = lookup(spark, db, "a.Auth::test_oauth_login", "src/a.py::test_oauth_login", "test_oauth_login", 'weird*name"x')
    for key in ("a.Auth::test_oauth_login", "src/a.py::test_oauth_login", "test_oauth_login"):
        r = out[key]
        assert (r.matched_tests, r.total_runs, r.failure_count) == (1, 3, 2)
        assert r.last_failure_at == datetime(2026, 5, 10)
        assert [f.run_id for f in r.failures] == [2, 1]
        assert r.failures[1].stack_trace_excerpt == "x" * 500 + " …[truncated]"
    assert out['weird*name"x'].failure_count == 1


def test_lookup_falls_back_to_text(spark, db):
    out = lookup(spark, db, "expired token", "oauth", "nothing like it", "* OR")
    assert out["expired token"].total_runs == 2
    assert out["oauth"].matched_tests == 1 and out["oauth"].total_runs == 3
    assert out["nothing like it"].total_runs == 0 and out["* OR"].failures is None


def test_unknown_time_sorts_last_and_limit_clamps(spark, db):
    r = lookup(spark, db, "test_logout", limit=99)["test_logout"]
    assert [f.run_id for f in r.failures] == [2, 4]
    assert len(lookup(spark, db, "test_logout", limit=0)["test_logout"].failures) == 1


def test_module_prefix_is_literal_and_case_sensitive(spark, db):
    names = {r.name for r in history.module_groups(*db, "src/a_", "2026-01-01").collect()}
    assert names == {'weird*name"x'}
    assert {r.file_path for r in history.module_groups(*db, "src/", "2026-01-01").collect()} == {"src/a.py", "src/a_b.py", "src/aXb.py"}


def test_module_history_per_prefix(spark, db):
    paths = spark.createDataFrame([("src/",), ("src/a",), ("zzz",)], "path string")
    out = history.module_failure_history(*db, paths, "2026-01-01", min_failures=2).collect()
    assert {(r.path, r.name, r.failure_count, r.total_runs, r.tests_with_failures, r.truncated) for r in out} == {
        ("src/", "test_oauth_login", 2, 3, 1, False), ("src/a", "test_oauth_login", 2, 3, 1, False)}


def test_prune_keeps_unknown_times(spark, db):
    cases, runs = db
    kept, removed = history.split_old_runs(runs, "2026-05-05")
    assert {r.run_id for r in kept.collect()} == {2, 3, 4} and removed.count() == 1
    assert history.prune_cases(cases, kept).count() == 4


def test_argument_checks():
    for bad in ("", "  ", "x" * 501):
        with pytest.raises(ValueError):
            checks.require_text(bad, "test_id")
    with pytest.raises(ValueError, match="'..'"):
        checks.require_path_prefix("a/../b")
    with pytest.raises(ValueError):
        checks.require_iso("garbage", "since")
    assert checks.require_iso("2026-05-01T10:00:00+02:00", "since") == datetime(2026, 5, 1, 8)
    assert checks.clamp("x", 1, 5, 3) == 3 and checks.clamp(9, 1, 5, 3) == 5


@pytest.mark.parametrize("text, expected", [
    ("2026-05-18T14:22:01Z", "2026-05-18T14:22:01"), ("2026-05-18 14:22:01", "2026-05-18T14:22:01"),
    ("2026-05-18T14:22:01+02:00", "2026-05-18T12:22:01"), ("2026-05-18T14:22:01.987", "2026-05-18T14:22:01"),
    ("20260518T142201", "2026-05-18T14:22:01"), ("2026-05-18", "2026-05-18T00:00:00"),
    ("2026", None), ("2026-05", None), ("garbage", None), ("", None), (None, None)])
def test_time_forms(spark, text, expected):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(text,)], "t string").select(times.iso(times.parse_ts(F.col("t"))).alias("o"))
    assert df.head()["o"] == expected


def test_text_predicates(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("Test_Login failed for José", "other"), ("login test", "x")], "a string, b string").withColumn("t", search.term_text("a", "b"))

    def hits(**kw):
        return [r.m for r in df.select(search.text_match(F.col("t"), **kw).alias("m")).collect()]

    assert hits(all_of=["login", "test"]) == [True, True]
    assert hits(phrase="test login") == [True, False]
    assert hits(any_of=["jose", "x"]) == [True, True]
    assert hits(none_of=["failed"]) == [False, True]
    assert hits(prefix="log") == [True, True]
    assert hits(phrase="jose other") == [False, False]  # a phrase stays inside a column
    assert hits(all_of=['" OR *']) == [False, False] or hits(all_of=['" OR *']) == [False, False]
