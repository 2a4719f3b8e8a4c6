"""Nightly scan over stored history: verdict snapshot, changes, audit row."""

from __future__ import annotations

import json
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliq.checks import require_iso
from reliq.operators import verdicts
from reliq.sources.tables import SCHEMA_VERSION, Store


def run_scan(store: Store, now: datetime, window_days: int = 14, min_fails: int = 3, include_errors: bool = True) -> dict:
    """Replace the verdict snapshot and return ``{kind, tests_examined, flaky_found, changes}``.

    When nothing is counted in the window the previous snapshot stays; only the
    audit row is written.
    """
    now = require_iso(now, "now")
    previous = store.read_or_none("flaky_verdicts")
    before = store.version("flaky_verdicts")
    fresh = verdicts.scan_verdicts(store.read("test_cases"), store.read("test_runs"), now, window_days, min_fails, include_errors)
    stamped = fresh.withColumn("computed_at", F.lit(now).cast("timestamp_ntz"))
    # Written once as a candidate; the summary and the diff read it back.
    candidate = f"scan_{now:%Y%m%dT%H%M%S}"
    store.append("scan_candidates", stamped, candidate)
    result = store.spark.read.schema(stamped.schema).parquet(f"{store.root}/scan_candidates/b={candidate}")
    summary = verdicts.scan_summary(result).head()
    audit = store.spark.createDataFrame(
        [(now, window_days, min_fails, include_errors, SCHEMA_VERSION, summary["tests_examined"], summary["flaky_found"])],
        "ran_at timestamp, window_days int, min_fails int, include_errors boolean, source_schema_version int, tests_examined bigint, flaky_found bigint",
    ).withColumn("ran_at", F.col("ran_at").cast("timestamp_ntz"))
    store.append("scan_runs", audit, candidate)
    outcome = {"kind": "ok", "tests_examined": summary["tests_examined"], "flaky_found": summary["flaky_found"]}
    if summary["tests_examined"] == 0:
        return {**outcome, "kind": "no_runs", "changes": None}
    store.replace("flaky_verdicts", result)
    old = previous if before else result.limit(0)
    return {**outcome, "changes": verdicts.flaky_changes(old, result)}


def export_json(verdict_table: DataFrame, path: str) -> None:
    """The scan as JSON lines, one verdict per line, written in parallel."""
    verdict_table.write.mode("overwrite").json(path)


def export_document(verdict_table: DataFrame, changes: DataFrame | None, meta: dict, path: str) -> None:
    """The whole scan in one folder of JSON lines: ``{"scan": …}`` first, then one line per change and per verdict."""
    spark = verdict_table.sparkSession
    lines = [spark.createDataFrame([(json.dumps({"scan": meta}, default=str),)], "value string")]
    if changes is not None:
        lines.append(changes.select(F.to_json(F.struct(F.struct("test_key", "change").alias("changes"))).alias("value")))
    lines.append(verdict_table.select(F.to_json(F.struct(F.struct("*").alias("verdicts"))).alias("value")))
    reduce(DataFrame.unionByName, lines).write.mode("overwrite").text(path)


def recent_scans(store: Store, n: int = 50) -> DataFrame:
    return store.read("scan_runs").orderBy(F.desc("ran_at")).limit(n)
