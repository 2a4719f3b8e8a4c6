"""Failure history in mergeable rollups: lookups read these instead of cases.

Two batch tables in a ``Store``, in folders by year of the run:

- ``<name>_runs``: one row per (test, run): (name, classname, file_path, run_id, failing), where a run belongs to one batch;
- ``<name>_latest``: the latest ``KEEP`` failures of every (test, day), with their texts. Sketches of several days or batches merge by
  taking the latest of their union, so any answer of up to ``KEEP`` failures is exact.

A batch number that exists is replaced, so a retried load does no harm. Ids meet the distinct tests, then the rollups of these.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reliq import checks
from reliq.functions import text as X
from reliq.operators import history, literals, search
from reliq.session import run_dir
from reliq.sources.tables import Store

#: Failures kept per test and day: the most that a lookup may ask for.
KEEP = checks.MAX_LIMIT
TEST = ["name", "classname", "file_path"]
_RUNS = "name string, classname string, file_path string, run_id {run}, failing boolean, year int"
_LATEST = ("name string, classname string, file_path string, run_id {run}, case_id {case}, status string, effective_ts timestamp_ntz, failure_type string, "
           "failure_message string, stack_trace string, year int")
#: Folder of runs without a time.
NO_YEAR = 0


def by_run(cases: DataFrame, runs: DataFrame) -> DataFrame:
    """One row per test and run."""
    timed = runs.select("run_id", F.coalesce(F.year("effective_ts"), F.lit(NO_YEAR)).alias("year"))
    merged = cases.groupBy(*TEST, "run_id").agg(F.max(history.is_failing()).alias("failing"))
    return merged.join(timed, "run_id").select(*TEST, "run_id", "failing", "year")


def latest_failures(cases: DataFrame, runs: DataFrame, keep: int = KEEP) -> DataFrame:
    """The latest failures of every test and day; the rank cuts each task's rows before they move."""
    failing = cases.filter(history.is_failing()).select(*TEST, "run_id", "case_id", "status", "failure_type", "failure_message", "stack_trace")
    timed = failing.join(runs.select("run_id", "effective_ts"), "run_id").withColumn("_day", F.to_date("effective_ts"))
    order = Window.partitionBy(*TEST, "_day").orderBy(F.desc_nulls_last("effective_ts"), "case_id")
    kept = timed.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= keep).drop("_rank", "_day")
    return kept.withColumn("year", F.coalesce(F.year("effective_ts"), F.lit(NO_YEAR)))


class Rollups:
    def __init__(self, store: Store, name: str = "history"):
        self.store, self.name = store, name

    def add(self, cases: DataFrame, runs: DataFrame, batch: int) -> None:
        """The cases of new runs."""
        self.types = cases.schema["run_id"].dataType.simpleString(), cases.schema["case_id"].dataType.simpleString()
        for table, rows in (("runs", by_run(cases, runs)), ("latest", latest_failures(cases, runs))):
            self.store.append(f"{self.name}_{table}", rows.repartition("year", F.pmod(F.xxhash64("name"), F.lit(8))).sortWithinPartitions("year", *TEST), f"{batch:010d}",
                              partition_by=("year",))

    def _read(self, table: str, schema: str) -> DataFrame:
        run, case = getattr(self, "types", ("bigint", "bigint"))
        return self.store.read(f"{self.name}_{table}", schema=schema.format(run=run, case=case))

    def runs(self) -> DataFrame:
        return self._read("runs", _RUNS)

    def latest(self) -> DataFrame:
        return self._read("latest", _LATEST)

    def tests(self) -> DataFrame:
        """The distinct tests."""
        return self.runs().select(*TEST).distinct()


def _of(tests: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of resolved tests (test_id, name, classname, file_path), with their test_id; nulls are equal."""
    t = tests.select("test_id", *(F.col(c).alias(f"_{c}") for c in TEST))
    return rows.join(t, (F.col("name") == F.col("_name")) & F.col("classname").eqNullSafe(F.col("_classname")) & F.col("file_path").eqNullSafe(F.col("_file_path"))).drop(
        *(f"_{c}" for c in TEST))


def resolve(ids: DataFrame, rollups: Rollups) -> DataFrame:
    """(test_id, name, classname, file_path) of every id, written once; no name for an id without a test."""
    asked = ids.select("test_id").distinct()
    return search.materialize(asked.join(history.known_tests(asked, rollups.tests()), "test_id", "left"), "resolved-tests")


def counts(resolved: DataFrame, rollups: Rollups) -> DataFrame:
    """(test_id, total_runs, failure_count, matched_tests) of the ids with tests."""
    met = resolved.filter("name IS NOT NULL")
    tests = met.select("test_id", "classname", "name").distinct().groupBy("test_id").agg(F.count("*").alias("matched_tests"))
    merged = _of(met, rollups.runs()).groupBy("test_id", "run_id").agg(F.max("failing").alias("failing"))
    totals = merged.groupBy("test_id").agg(F.count("*").alias("total_runs"), F.count_if("failing").alias("failure_count"))
    return totals.join(tests, "test_id").select("test_id", "total_runs", "failure_count", "matched_tests")


def failures(resolved: DataFrame, rollups: Rollups, limit: int) -> DataFrame:
    """The latest failing cases per id, with ``rank``."""
    order = Window.partitionBy("test_id").orderBy(F.desc_nulls_last("effective_ts"), "case_id")
    met = _of(resolved.filter("name IS NOT NULL"), rollups.latest())
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def failure_lookup(ids: DataFrame, rollups: Rollups, cases: DataFrame, runs: DataFrame, limit: int = checks.DEFAULT_LIMIT, max_trace_chars: int = 500,
                   index: literals.LiteralIndex | None = None) -> DataFrame:
    """Counts and the latest failures for every id, from rollups; cases are read for ids without a test only, which are sought in texts."""
    limit = checks.clamp(limit, checks.MIN_LIMIT, KEEP, checks.DEFAULT_LIMIT)
    resolved = resolve(ids, rollups)
    answers = history.lookup_answers(resolved.select("test_id").distinct(), counts(resolved, rollups), failures(resolved, rollups, limit), max_trace_chars)
    rest = resolved.filter("name IS NULL").select("test_id")
    found = history.fallback_lookup(rest, cases, runs, limit, max_trace_chars, index)
    return answers if found is None else answers.join(rest, "test_id", "left_anti").unionByName(found)


def build(cases: DataFrame, runs: DataFrame) -> Rollups:
    """Rollups of one batch in this application's folder."""
    spark = cases.sparkSession
    made = Rollups(Store(spark, f"{run_dir(spark)}/rollups-{uuid.uuid4().hex}"))
    made.add(cases, runs, 1)
    return made
