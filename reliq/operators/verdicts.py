"""Flaky / consistently failing / stable verdicts over a time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliq.checks import require_window
from reliq.functions import text as X
from reliq.functions import times

# Case and verdict vocabulary.
PASSED, FAILED, ERROR, SKIPPED = "passed", "failed", "error", "skipped"
FAILING = (FAILED, ERROR)
FLAKY, CONSISTENTLY_FAILING, STABLE, UNKNOWN = "flaky", "consistently_failing", "stable", "unknown"


def fail_statuses(include_errors: bool) -> tuple[str, ...]:
    return FAILING if include_errors else (FAILED,)


def _recent(rows: DataFrame, cutoff) -> DataFrame:
    """Only partitions that can hold rows of the window, where rows carry their run's day."""
    return rows.filter(F.col("run_date") >= F.lit(cutoff).cast("date")) if "run_date" in rows.columns else rows


def surviving_runs(runs: DataFrame, cutoff) -> DataFrame:
    """One run per (source_file, effective time): the last ingested, then the highest id.

    A max over a struct rather than a row number: it combines map-side, so a
    source that holds a third of all runs is never sorted in one task.
    """
    return (
        _recent(runs, cutoff).filter(F.col("effective_ts") >= F.lit(cutoff))
        .groupBy("source_file", "effective_ts")
        .agg(F.max(F.struct("ingested_at", "run_id")).alias("_last"))
        .select(F.col("_last.run_id").alias("run_id"), "effective_ts")
    )


def windowed_cases(cases: DataFrame, runs: DataFrame, cutoff) -> DataFrame:
    """Non-skipped cases of the surviving runs, with the run's effective time."""
    kept = _recent(cases, cutoff).filter(F.col("status") != SKIPPED).select(
        "case_id", "run_id", "classname", "name", "file_path", "status"
    )
    return kept.join(surviving_runs(runs, cutoff), "run_id")


def _order(ts: Column, case_id: Column) -> Column:
    """(time, case id) as one number, so that a hash aggregate can hold the minimum."""
    micros = F.unix_micros(ts.cast("timestamp")).cast("decimal(20,0)")
    return (micros * F.lit("20000000000000000000").cast("decimal(20,0)")).cast("decimal(38,0)") + case_id.cast("decimal(20,0)")


def compute_verdicts(rows: DataFrame, window_days: int, min_fails: int, include_errors: bool = True) -> DataFrame:
    """One verdict row per test from ``windowed_cases`` rows.

    Counting happens per raw identity first, in a hash aggregate with fixed-width
    buffers; keys are built and merged on that much smaller result.
    """
    require_window(window_days, min_fails)
    ok = F.col("status") == PASSED
    bad = F.col("status").isin(*fail_statuses(include_errors))
    ts = F.col("effective_ts")
    per_identity = (
        rows.groupBy("classname", "name", "file_path")
        .agg(
            F.count_if(ok).alias("passes"),
            F.count_if(bad).alias("fails"),
            F.min(F.when(ok | bad, ts)).alias("first_seen"),
            F.max(F.when(ok | bad, ts)).alias("last_seen"),
            F.max(F.when(bad, ts)).alias("last_failure"),
            F.min(_order(ts, F.col("case_id"))).alias("_ord"),
        )
        .withColumn("classname", X.strip(F.col("classname")))
        .withColumn("name", X.strip(F.col("name")))
        .withColumn("test_key", X.test_key(F.col("classname"), F.col("name"), F.col("file_path")))
    )
    named = F.when(F.col("file_path") != "", F.col("file_path"))
    verdicts = per_identity.groupBy("test_key").agg(
        F.min_by("classname", "_ord").alias("classname"),
        F.min_by("name", "_ord").alias("name"),
        F.coalesce(
            F.min_by(named, F.when(named.isNotNull(), F.col("_ord"))), F.min_by("file_path", "_ord")
        ).alias("file_path"),
        F.sum("passes").alias("passes"),
        F.sum("fails").alias("fails"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max("last_failure").alias("last_failure"),
    )
    status = (
        F.when((F.col("fails") >= min_fails) & (F.col("passes") >= 1), FLAKY)
        .when(F.col("fails") >= min_fails, CONSISTENTLY_FAILING)
        .otherwise(STABLE)
    )
    return (
        verdicts.withColumn("runs", F.col("passes") + F.col("fails"))
        .withColumn("window_days", F.lit(int(window_days)))
        .withColumn("status", status)
        .select("test_key", "classname", "name", "file_path", "passes", "fails", "runs", "window_days",
                "first_seen", "last_seen", "last_failure", "status")
    )


def scan_verdicts(cases: DataFrame, runs: DataFrame, now, window_days: int = 14, min_fails: int = 3,
                  include_errors: bool = True) -> DataFrame:
    """Verdicts as of ``now``; tests with nothing counted are left out."""
    require_window(window_days, min_fails)
    rows = windowed_cases(cases, runs, times.window_cutoff(now, window_days))
    return compute_verdicts(rows, window_days, min_fails, include_errors).filter(F.col("runs") > 0)


def flaky_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """``(test_key, change)``: newly_flaky or newly_resolved, one full-outer join."""
    def keys(df: DataFrame, tag: str) -> DataFrame:
        return df.filter(F.col("status") == FLAKY).select("test_key", F.lit(True).alias(tag))

    both = keys(previous, "_was").join(keys(current, "_is"), "test_key", "full_outer")
    change = F.when(F.col("_was").isNull(), "newly_flaky").when(F.col("_is").isNull(), "newly_resolved")
    return both.select("test_key", change.alias("change")).filter(F.col("change").isNotNull())


def scan_summary(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(
        F.count("*").alias("tests_examined"), F.count_if(F.col("status") == FLAKY).alias("flaky_found")
    )


def undedupable_sources(runs: DataFrame, cutoff) -> DataFrame:
    """Sources with several in-window runs that carry no reported time."""
    return (
        runs.filter(F.col("run_timestamp").isNull() & (F.col("ingested_at") >= F.lit(cutoff)))
        .groupBy("source_file").agg(F.count("*").alias("undated_runs"))
        .filter(F.col("undated_runs") > 1)
    )


def list_verdicts(verdicts: DataFrame, statuses=None) -> DataFrame:
    """Worst first: fails, then runs, then key."""
    if statuses:
        verdicts = verdicts.filter(F.col("status").isin(*statuses))
    return verdicts.orderBy(F.desc("fails"), F.desc("runs"), "test_key")


def verdict_hits(ids: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts that a ``test_id`` can mean, with the tier: 1 exact key, 2 class or file + name, 3 bare name.

    Both sides list the keys they can meet on, each with its tier, and meet in one equi-join.
    """
    wanted = ids.select("test_id").distinct().select("test_id", F.explode(asked_keys(F.col("test_id"), F.col("test_id"))).alias("_k"))
    offered = verdicts.withColumn("_k", F.explode(offered_keys(F.col("test_key"))))
    return wanted.join(offered, "_k").withColumn("_tier", F.col("_k.tier")).drop("_k")


def _key(tier: int, *parts: Column) -> Column:
    return F.struct(F.lit(tier).alias("tier"), F.concat_ws("\u0001", *parts).alias("key"))


def asked_keys(test_id: Column, exact: Column | None = None) -> Column:
    left, right = X.id_parts(test_id)
    scoped = F.when(left.isNotNull(), _key(2, left, right)).otherwise(_key(3, right))
    return F.array(scoped) if exact is None else F.array(_key(1, exact), scoped)


def offered_keys(exact: Column | None = None) -> Column:
    """Class + name, file + name (when not the same text) and bare name of a row, and its full key."""
    cls, file, name = F.col("classname"), F.col("file_path"), F.col("name")
    keys = [
        F.when(cls.isNotNull(), _key(2, cls, name)),
        F.when(file.isNotNull() & ~cls.eqNullSafe(file), _key(2, file, name)),
        _key(3, name),
    ]
    return F.array_compact(F.array(*keys, *([] if exact is None else [_key(1, exact)])))


def is_flaky(ids: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The worst matching verdict of the lowest tier that found any, per id; ``unknown`` when there is none."""
    # One aggregate, no window: an ambiguous name with very many matches combines map-side, and verdicts are read once.
    rank = F.struct("_tier", (-F.col("fails")).alias("f"), (-F.col("runs")).alias("r"), F.col("test_key").alias("k"))
    fields = ["test_key", "status", "fails", "passes", "runs", "window_days", "last_failure"]
    best = verdict_hits(ids, verdicts).groupBy("test_id").agg(
        F.min("_tier").alias("_tier"), *(F.count_if(F.col("_tier") == n).alias(f"_n{n}") for n in (1, 2, 3)), F.min_by(F.struct(*fields), rank).alias("_best"))
    out = ids.select("test_id").distinct().join(best, "test_id", "left")
    return out.select(
        "test_id",
        F.coalesce(F.col("_best.status"), F.lit(UNKNOWN)).alias("status"),
        (F.coalesce(F.col("_best.status"), F.lit(UNKNOWN)) == FLAKY).alias("is_flaky"),
        *[F.col(f"_best.{f}").alias(f) for f in fields if f != "status"],
        F.coalesce(F.get(F.array("_n1", "_n2", "_n3"), F.col("_tier") - 1), F.lit(0)).alias("matched"),
    )


def _line(flag: str) -> Column:
    return F.format_string(
        f"  {flag} %s  [%d fail / %d pass of %d]  last failure %s",
        "test_key", "fails", "passes", "runs", F.coalesce(times.iso(F.col("last_failure")), F.lit("-")),
    )


def report_lines(verdicts: DataFrame, changes: DataFrame | None = None, scope: str = "changes-only") -> DataFrame:
    """``(section, line, …order columns)`` of the nightly report; empty means stay silent."""
    if scope == "changes-only":
        return changes.select(
            "change", "test_key",
            F.when(F.col("change") == "newly_flaky", F.concat(F.lit("  + now flaky: "), F.col("test_key")))
            .otherwise(F.concat(F.lit("  - no longer flaky: "), F.col("test_key"))).alias("line"),
        )
    flaky = verdicts.filter(F.col("status") == FLAKY).select(
        F.lit(FLAKY).alias("section"), "fails", "runs", "test_key", _line("•").alias("line"))
    if scope == "full-set":
        return flaky
    broken = verdicts.filter(F.col("status") == CONSISTENTLY_FAILING).select(
        F.lit(CONSISTENTLY_FAILING).alias("section"), "fails", "runs", "test_key",
        F.format_string("  • %s  [%d fail of %d]", "test_key", "fails", "runs").alias("line"))
    return flaky.unionByName(broken)
