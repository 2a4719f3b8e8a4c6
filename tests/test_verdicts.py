from datetime import datetime

import pytest

from reliq.operators import verdicts

SCHEMA = "case_id bigint, run_id bigint, classname string, name string, file_path string, status string, effective_ts timestamp_ntz"


def rows(spark, data):
    full = []
    for i, (status, day, *rest) in enumerate(data):
        classname, name, path = rest if rest else ("pkg.mod", "test_a", "src/mod.py")
        full.append((i, i, classname, name, path, status, datetime(2026, 5, day, 9)))
    return spark.createDataFrame(full, SCHEMA)


def classify(spark, data, min_fails=3, errors=True):
    return {r.test_key: r for r in verdicts.compute_verdicts(rows(spark, data), 14, min_fails, errors).collect()}


@pytest.mark.parametrize("statuses, errors, expected", [
    (["failed"] * 3 + ["passed"] * 2, True, ("flaky", 2, 3)),
    (["failed"] * 4, True, ("consistently_failing", 0, 4)),
    (["failed"] * 2 + ["passed"], True, ("stable", 1, 2)),
    (["failed", "error", "error", "passed"], True, ("flaky", 1, 3)),
    (["failed", "error", "error", "passed"], False, ("stable", 1, 1)),
    (["failed"] * 3 + ["passed"], True, ("flaky", 1, 3)),
])
def test_truth_table(spark, statuses, errors, expected):
    v = classify(spark, [(s, 10 + i) for i, s in enumerate(statuses)], errors=errors)["pkg.mod::test_a"]
    assert (v.status, v.passes, v.fails) == expected
    assert v.runs == v.passes + v.fails


def test_uncounted_error_moves_no_time_but_gives_identity(spark):
    v = classify(spark, [("error", 1, "c", " t ", None), ("passed", 5, "c", "t", "f.py")], errors=False)["c::t"]
    assert (v.first_seen.day, v.last_seen.day, v.last_failure) == (5, 5, None)
    assert v.name == "t" and v.file_path == "f.py"


def test_file_stands_in_for_a_missing_class(spark):
    v = classify(spark, [("passed", 1, None, "t", "a.js"), ("passed", 1, None, "t", "b.js"), ("passed", 2, None, "t", None)])
    assert set(v) == {"a.js::t", "b.js::t", "::t"}


def test_bad_arguments(spark):
    with pytest.raises(ValueError, match="window must be >= 1.*min-fails"):
        verdicts.compute_verdicts(rows(spark, [("passed", 1)]), 0, 0)


def run_rows(spark, data):
    return spark.createDataFrame(data, "run_id bigint, source_file string, effective_ts timestamp_ntz, ingested_at timestamp_ntz, run_timestamp timestamp_ntz")


def test_reingested_run_counts_once(spark):
    t = datetime(2026, 5, 1)
    runs = run_rows(spark, [(1, "a.xml", t, datetime(2026, 5, 1), t), (2, "a.xml", t, datetime(2026, 5, 2), t), (3, "a.xml", t, datetime(2026, 5, 2), t), (4, "b.xml", t, t, t)])
    assert {r.run_id for r in verdicts.surviving_runs(runs, datetime(2026, 4, 1)).collect()} == {3, 4}
    assert verdicts.surviving_runs(runs, datetime(2026, 5, 1)).count() == 2  # the lower bound is closed


def test_changes_and_report(spark):
    def table(keys):
        return spark.createDataFrame([(k, "flaky") for k in keys] + [("z", "stable")], "test_key string, status string")

    changes = verdicts.flaky_changes(table(["a", "b"]), table(["b", "c"]))
    lines = {r.line for r in verdicts.report_lines(None, changes).collect()}
    assert lines == {"  + now flaky: c", "  - no longer flaky: a"}
    assert verdicts.report_lines(None, verdicts.flaky_changes(table(["a"]), table(["a"]))).count() == 0


def test_is_flaky_tiers(spark):
    v = verdicts.compute_verdicts(rows(spark, [
        ("failed", 1, "a.B", "t", "x.py"), ("failed", 2, "a.B", "t", "x.py"), ("failed", 3, "a.B", "t", "x.py"), ("passed", 4, "a.B", "t", "x.py"), ("passed", 4, "other", "t", "y.py")]), 14, 3)
    ids = spark.createDataFrame([("a.B::t",), ("x.py::t",), ("t",), ("nope",)], "test_id string")
    out = {r.test_id: r for r in verdicts.is_flaky(ids, v).collect()}
    assert out["a.B::t"].is_flaky and out["x.py::t"].is_flaky
    assert out["t"].is_flaky and out["t"].matched == 2
    assert out["nope"].status == "unknown" and not out["nope"].is_flaky


def test_same_result_with_other_partition_counts(spark):
    data = [("failed" if i % 3 else "passed", 1 + i % 20, f"c{i % 4}", f"t{i % 5}", None) for i in range(200)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for n in ("1", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(sorted(map(tuple, verdicts.compute_verdicts(rows(spark, data), 14, 3).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
