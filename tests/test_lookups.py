"""Literal substrings and failure rollups against brute force over cases."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from reliq.operators import history, literals, rollups
from reliq.sources.tables import Store

CASES = "case_id bigint, run_id bigint, classname string, name string, file_path string, status string, failure_message string, failure_type string, stack_trace string"
RUNS = "run_id bigint, effective_ts timestamp_ntz"


def test_literal_needles(spark, tmp_path):
    texts = ["100% sure", "a_b", "", None, "ünïcode 😀 text", "ab", "aXb", "tab\there", "b" * 500 + "needle" + "c" * 500, "x\ny", "(a*b)", "É"]
    rows = [(i, texts[i % len(texts)], texts[(i * 5 + 1) % len(texts)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, a string, b string")
    needles = ["%", "_", "a_b", "😀 t", "ab", "needlec", "\n", "*b)", "É", "é", "", "zzz", "b" * 499, None, "a", "bcn", "100% sure"]
    index = literals.LiteralIndex(Store(spark, str(tmp_path)))
    index.add(frame.filter("id < 20"), ["a", "b"], 1)
    index.add(frame, ["a", "b"], 2)
    index.add(frame, ["a", "b"], 2)  # a repeated batch replaces itself
    assert index.texts().count() == len({t for t in texts if t is not None})
    asked = spark.createDataFrame([(n,) for n in needles], "needle string")
    got = {(r.needle, r.id) for r in index.matching_rows(asked, frame, ["a", "b"], ["id"]).collect()}
    assert got == {(n, i) for n in needles if n for i, a, b in rows if n in (a or "") or n in (b or "")}
    assert index.matching_rows(asked.limit(0), frame, ["a", "b"], ["id"]).collect() == []


def test_an_id_that_is_no_term_query_is_sought_literally(spark):
    cases = spark.createDataFrame([
        (1, 1, "a.B", "test_one", "f.py", "failed", "got 50% of it", "E", "at a/b-c.py:3"),
        (2, 2, "a.B", "test_two", "f.py", "passed", None, None, None), (3, 3, None, "x", None, "error", "50 of it", "E", "b-c")], CASES)
    runs = spark.createDataFrame([(1, datetime(2026, 1, 1)), (2, None), (3, datetime(2026, 1, 3))], RUNS)
    ids = spark.createDataFrame([("50%",), ("a/b-c.py",), ("B-C",), ("50 of",), ("a.B::test_t%",), ("nothing-here",)], "test_id string")
    for answer in (history.failure_lookup(ids, cases, runs), rollups.failure_lookup(ids, rollups.build(cases, runs), cases, runs)):
        out = {r.test_id: (r.total_runs, r.failure_count, r.matched_tests) for r in answer.collect()}
        assert out == {"50%": (1, 1, 1), "a/b-c.py": (1, 1, 1), "B-C": (0, 0, 0), "50 of": (2, 2, 2), "a.B::test_t%": (0, 0, 0), "nothing-here": (0, 0, 0)}


@pytest.fixture(scope="module")
def many(spark):
    draw = random.Random(2)
    start = datetime(2025, 12, 30)
    runs = [(i, None if i % 11 == 0 else start + timedelta(hours=i * 7 % 400)) for i in range(80)]
    cases = []
    for i in range(1500):
        status = draw.choice(["passed", "failed", "error", "skipped"])
        cases.append((i, draw.randrange(80), draw.choice([None, "a.A", "b.B"]), draw.choice(["t1", "t2", "t3"]), draw.choice([None, "x.py", "a.A"]), status, f"m{i}", "E", "s" * (i % 700)))
    return cases, runs


def test_rollups_answer_like_the_cases(spark, many, tmp_path):
    cases, runs = many
    made = rollups.Rollups(Store(spark, str(tmp_path)))
    for batch in (1, 2, 2):  # runs of two batches, the second twice
        some = [r for r in runs if r[0] % 2 == batch - 1]
        ids = {r[0] for r in some}
        made.add(spark.createDataFrame([c for c in cases if c[1] in ids], CASES), spark.createDataFrame(some, RUNS), batch)
    c, r = spark.createDataFrame(cases, CASES), spark.createDataFrame(runs, RUNS)
    ids = spark.createDataFrame([(x,) for x in ["t1", "a.A::t1", "x.py::t2", "b.B::t3", "a.A::t9", "m7", "", "t1"]], "test_id string")
    for limit in (1, 10, 50, 99):
        got = {x.test_id: x for x in rollups.failure_lookup(ids, made, c, r, limit).collect()}
        want = {x.test_id: x for x in history.failure_lookup(ids, c, r, limit).collect()}
        assert got == want and set(got) == {"t1", "a.A::t1", "x.py::t2", "b.B::t3", "a.A::t9", "m7", ""}
    assert len(got["t1"].failures) == 50 and got["m7"].total_runs == 1
    kept = rollups.latest_failures(c.withColumn("name", F.lit("t")), r, keep=2).groupBy("classname", "file_path", F.to_date("effective_ts").alias("d")).count()
    assert kept.agg(F.max("count")).head()[0] == 2


def test_rollups_of_nothing(spark):
    made = rollups.build(spark.createDataFrame([], CASES), spark.createDataFrame([], RUNS))
    out = rollups.failure_lookup(spark.createDataFrame([("a::b",)], "test_id string"), made, spark.createDataFrame([], CASES), spark.createDataFrame([], RUNS)).collect()
    assert [(r.test_id, r.total_runs, r.failures) for r in out] == [("a::b", 0, None)]


def test_index_stores_long_pieces_only_and_a_row_counts_once_per_needle(spark, tmp_path):
    index = literals.LiteralIndex(Store(spark, str(tmp_path)))
    rows = spark.createDataFrame([(1, "abcd", "abx"), (2, "xab", None), (3, None, None), (4, "abcd", "abx")], "id int, a string, b string")
    index.add(rows, ["a", "b"], 1)
    assert {len(r.piece) for r in index.postings().collect()} == {3}
    needles = spark.createDataFrame([("ab",), ("x",), ("bcd",), ("zz",), ("zzz",)], "needle string")
    found = sorted((r.needle, r.id) for r in index.matching_rows(needles, rows, ["a", "b"], ["id"]).collect())
    assert found == [("ab", 1), ("ab", 2), ("ab", 4), ("bcd", 1), ("bcd", 4), ("x", 1), ("x", 2), ("x", 4)]


def test_matches_by_terms_and_signals_are_written_once(spark):
    """Several branches read them: what is read again is the found keys and the signal lines, not the texts."""
    from reliq.plans import stabilize

    cases = spark.createDataFrame([(1, 1, "c", "n", None, "failed", "expected 1 but got 2", "t")],
                                  "case_id int, run_id int, classname string, name string, file_path string, status string, failure_message string, stack_trace string")
    triaged = spark.createDataFrame([("l1", "\n  expected 1 but got 2\nnext")], "log_id string, excerpt string")
    out = stabilize.history_enrichment(triaged, cases)
    assert {f.split("/")[-2].rsplit("-", 1)[0] for f in out.inputFiles()} >= {"signals", "text-hits"}
    assert [(r.log_id, r.signal, r.total_runs, r.failure_count) for r in out.collect()] == [("l1", "expected 1 but got 2", 1, 1)]


def test_what_is_broadcast_has_a_known_size(spark, tmp_path):
    """The pieces of all texts are many more than their files' size says; needles are sent to them, however large what they come from."""
    index = literals.LiteralIndex(Store(spark, str(tmp_path)))
    rows = spark.createDataFrame([(i, f"step {i} of test_{i % 7}") for i in range(50)], "id int, a string")
    index.add(rows, ["a"], 1)
    needles = spark.range(2_000_000).select((F.col("id") % 30).cast("string").alias("needle"))
    found = index.matching_texts(needles)
    lines = found._jdf.queryExecution().executedPlan().toString().splitlines()
    for at, line in enumerate(lines):
        if (depth := line.find("BroadcastExchange")) >= 0:
            below = next((k for k in range(at + 1, len(lines)) if len(lines[k]) - len(lines[k].lstrip(" :+-*")) <= depth), len(lines))
            assert not any("Generate explode(flatten" in x for x in lines[at:below]), "\n".join(lines[at:below])
    want = {(str(n), i) for n in range(30) for i in range(50) if str(n) in f"step {i} of test_{i % 7}"}
    assert {(r.needle, r.id) for r in index.matching_rows(needles, rows, ["a"], ["id"]).collect()} == want
    joins = index.matching_rows(needles, rows, ["a"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in joins and "BroadcastHashJoin" not in joins
