"""From a table of failures to a routed ledger: history, verdicts, triage, fork, gate, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliq.functions import loglines as L
from reliq.operators import history, incidents, stability, verdicts
from reliq.operators.search import materialize


#: Leads a stand-in key that meets no other key.
_NOTHING = "\0"


def join_known(rows: DataFrame, facts: DataFrame, key: str, row_id: str = "failure_id") -> DataFrame:
    """Left join on a key that many rows lack, read once: rows without it get a key of their own, so that nulls do not meet in one task."""
    own = F.coalesce(key, F.concat(F.lit(_NOTHING), F.col(row_id).cast("string")))
    return rows.withColumn("_key", own).join(facts.withColumnRenamed(key, "_key"), "_key", "left").drop("_key")


def incident_context(failures: DataFrame, triaged: DataFrame, stored: DataFrame, limit: int = 3, index=None) -> DataFrame:
    """Related incidents per failure, sought by the log's signal line, else by the test id; every distinct text is sought once."""
    signal = triaged.select("log_id", F.nullif(L.top_signal_line(F.col("excerpt")), F.lit("")).alias("_s"))
    asked = join_known(failures.select("failure_id", "test_id", "log_id"), signal, "log_id").select(
        "failure_id", F.coalesce("_s", "test_id").alias("_text")).filter(F.col("_text").isNotNull())
    found = incidents.related_lines(asked.select(F.col("_text").alias("query_id"), F.col("_text").alias("text")).distinct(), stored, limit, index)
    return asked.join(found.select(F.col("query_id").alias("_text"), F.col("lines").alias("incident_lines")), "_text").select("failure_id", "incident_lines")


def history_enrichment(triaged: DataFrame, cases: DataFrame) -> DataFrame:
    """History counts for the signal line of each log, where it matches a known test."""
    # Written before the lines are sought in them: else the filter on a line goes below whatever made the logs distinct.
    logs = materialize(triaged.select("log_id", "excerpt"), "triaged")
    asked = materialize(logs.select("log_id", F.substring(L.top_signal_line(F.col("excerpt")), 1, 200).alias("test_id")).filter("test_id <> ''"), "signals")
    counts = history.lookup_counts(history.matches(asked, cases)).filter("matched_tests > 0")
    return asked.join(counts, "test_id").select("log_id", F.col("test_id").alias("signal"), "matched_tests", "total_runs", "failure_count")


def test_facts(ids: DataFrame, cases: DataFrame, runs: DataFrame, verdict_table: DataFrame, burnin: DataFrame | None = None) -> DataFrame:
    """What is known of every test id: flaky answer, runs, failures, last failure, burn-in."""
    flaky = verdicts.is_flaky(ids, verdict_table).select("test_id", "is_flaky", F.col("status").alias("verdict"))
    facts = flaky.join(history.failure_totals(ids, cases, runs), "test_id", "left")
    if burnin is not None:
        facts = facts.join(stability.stability_report(burnin, "test_id").select("test_id", "all_green", "passed"), "test_id", "left")
    return facts


def stabilize(failures: DataFrame, cases: DataFrame, runs: DataFrame, verdict_table: DataFrame, triaged: DataFrame,
              burnin: DataFrame | None = None, gates: DataFrame | None = None, reports: DataFrame | None = None, write_enabled: bool | Column = False,
              heal_categories=stability.HEAL_CATEGORIES, pulls: DataFrame | None = None, tickets: DataFrame | None = None,
              context: DataFrame | None = None) -> DataFrame:
    """One ledger row per failure ``(failure_id, test_id, log_id, project)``.

    Stage results come in as tables: ``triaged`` per log, ``burnin`` runs per test, ``gates`` per failure (ticket_id),
    ``reports`` per failure (report_id), ``pulls`` and ``tickets`` that were opened per failure (failure_id), and ``context`` with the
    related incidents of a failure (``incident_context``). Every stage meets the failures in one join.
    """
    failures = failures.select("failure_id", "test_id", "log_id", "project")
    ids = failures.filter("test_id IS NOT NULL").select("test_id").distinct()
    category = triaged.select("log_id", F.col("category").alias("triage_category"), "classification_method", "confidence", "evidence")
    joined = join_known(join_known(failures, test_facts(ids, cases, runs, verdict_table, burnin), "test_id"), category, "log_id")
    routed = stability.route(joined.withColumn("category", F.col("triage_category")), heal_categories)
    done = F.lit(True)
    stages = (
        None if gates is None else gates.select(F.col("ticket_id").alias("failure_id"), F.col("ok").alias("gate_ok")),
        None if reports is None else reports.select(F.col("report_id").alias("failure_id"), done.alias("has_report")),
        None if pulls is None else pulls.select("failure_id", done.alias("has_pr")).distinct(),
        None if tickets is None else tickets.select("failure_id", done.alias("created")).distinct(),
        None if context is None else context.select("failure_id", "incident_lines"),
    )
    for stage in stages:
        if stage is not None:
            routed = routed.join(stage, "failure_id", "left")
    if context is None:
        routed = routed.withColumn("incident_lines", F.lit(None).cast("string"))
    decided = stability.outcome(routed.withColumn("write_enabled", write_enabled if isinstance(write_enabled, Column) else F.lit(write_enabled)))
    return decided.withColumn("evidence_text", stability.evidence_text(decided)).select(
        "failure_id", "test_id", "project", "verdict", F.coalesce("total_runs", F.lit(0)).alias("total_runs"),
        F.coalesce("failure_count", F.lit(0)).alias("failure_count"), "category", "branch", "outcome", "evidence_text", "incident_lines")


def ledger(decided: DataFrame) -> DataFrame:
    """The ledger with its free text scrubbed."""
    return stability.safe_columns(decided, "failure_id", ["evidence_text"])
