"""Burn-in stability, routing of failures, bug reports and tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliq.functions import redact
from reliq.functions.text import strip
from reliq.operators import evidence
from reliq.operators.search import materialize

# Outcomes, report limits and severities.
HEAL_CATEGORIES = ("flaky", "timeout")
HEALED, PR_OPENED = "healed", "pr_opened"
TICKET_CREATED, TICKET_READY, NEEDS_ATTENTION = "ticket_created", "ticket_ready", "needs_attention"
SEVERITIES = ("critical", "high", "medium", "low", "unknown")
REPORT_FIELDS = ("title", "summary", "reproduction_steps", "expected_behavior", "actual_behavior", "severity", "severity_rationale", "missing_evidence")
EXPLODE_STEP = 10_000
MAX_RAW_BYTES, MAX_CONTEXT_BYTES = 16 * 1024, 4 * 1024
MAX_TITLE, MAX_FIELD, MAX_ITEMS, MAX_ITEM = 80, 4000, 50, 1000
TICKET_TITLE, TICKET_BODY, TICKET_LABELS, TICKET_LABEL = 255, 100_000, 50, 255


def stability_report(runs: DataFrame, *group: str) -> DataFrame:
    """Per group: runs, passed, failed, time, timeouts and how often each exit code came up.

    Exit codes are counted per code first, so a group of any size stays a small map.
    """
    group = group or ("test_id", "phase")
    timed = F.col("timed_out") if "timed_out" in runs.columns else F.lit(False)
    per_code = runs.groupBy(*group, "exit_code").agg(
        F.count("*").alias("n"), F.sum("duration_s").alias("d"), F.count_if(timed).alias("t"))
    return per_code.groupBy(*group).agg(
        F.sum("n").alias("runs"), F.sum(F.when(F.col("exit_code") == 0, F.col("n")).otherwise(0)).alias("passed"),
        F.sum(F.when(F.col("exit_code") == 0, 0).otherwise(F.col("n"))).alias("failed"),
        F.round(F.sum("d"), 2).alias("duration_s"), F.sum("t").alias("timed_out_runs"),
        F.map_from_entries(F.collect_list(F.struct("exit_code", "n"))).alias("exit_codes"),
    ).withColumn("all_green", (F.col("runs") > 0) & (F.col("failed") == 0)).withColumn("any_failed", F.col("failed") > 0)


def green_runs(reports: DataFrame, run_time: str) -> DataFrame:
    """One passing case per green burn-in run (at least one), ready for ``synthetic_runs``."""
    # Numbered in two steps, so that no array grows with the number of runs.
    wanted = F.greatest(F.lit(1), F.col("passed")).cast("bigint")
    numbered = reports.filter("all_green").withColumn("_to", wanted).withColumn(
        "_from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_to"), F.lit(EXPLODE_STEP).cast("bigint")))).withColumn(
        "_n", F.explode(F.sequence("_from", F.least(F.col("_to"), F.col("_from") + EXPLODE_STEP - 1))))
    name = F.substring_index("test_id", "::", -1)
    cls = F.when(F.contains("test_id", F.lit("::")), F.left("test_id", F.length("test_id") - F.length(name) - 2))
    return numbered.select(
        "test_id", name.alias("name"), cls.alias("classname"), F.col("test_id").alias("file_path"), F.lit("passed").alias("status"),
        F.lit(run_time).alias("run_time"), "_n",
    ).withColumn("run_key", F.concat_ws("#", "test_id", F.lit(run_time), "_n")).drop("_n")


def route(failures: DataFrame, heal_categories=HEAL_CATEGORIES) -> DataFrame:
    """``branch`` per failure from its triage category, else its flaky verdict."""
    category = F.coalesce("category", F.when(F.coalesce("is_flaky", F.lit(False)), F.lit("flaky")))
    return failures.withColumn("category", category).withColumn(
        "branch", F.when(F.col("category").isin(*heal_categories), "heal").when(F.col("category").isNotNull(), "bug"))


def outcome(routed: DataFrame) -> DataFrame:
    """``outcome`` from branch, burn-in (``all_green``, ``has_pr``), gate (``gate_ok``) and ticket (``created``)."""
    def flag(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False)) if name in routed.columns else F.lit(False)

    writing = flag("write_enabled")
    result = (
        F.when((F.col("branch") == "heal") & flag("all_green"), F.when(flag("has_pr"), PR_OPENED).otherwise(HEALED))
        .when((F.col("branch") == "bug") & flag("has_report") & flag("gate_ok"),
              F.when(~writing, TICKET_READY).when(flag("created"), TICKET_CREATED).otherwise(NEEDS_ATTENTION))
        .otherwise(NEEDS_ATTENTION)
    )
    return routed.withColumn("outcome", result)


def check_raw_reports(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejects) of ``(report_id, raw_text, context)`` by blankness and size in bytes."""
    text, context = F.col("raw_text"), F.coalesce(F.col("context"), F.lit(""))
    reason = (
        F.when(F.coalesce(strip(text), F.lit("")) == "", "raw_text is required")
        .when(F.octet_length(text) > MAX_RAW_BYTES, "raw_text exceeds the 16 KB limit")
        .when(F.octet_length(context) > MAX_CONTEXT_BYTES, "context exceeds the 4 KB limit")
    )
    tagged = raw.withColumn("reason", reason)
    return tagged.filter("reason IS NULL").drop("reason"), tagged.filter("reason IS NOT NULL").select("report_id", "reason")


def normalize_reports(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reports, rejects) from ``(report_id, json)``: required fields, severity in the rubric, lists, all within limits."""
    v = parsed.withColumn("_v", F.try_parse_json("json"))

    def kind(field: str) -> Column:
        return F.schema_of_variant(F.try_variant_get("_v", f"$.{field}", "variant"))

    def text(field: str) -> Column:
        return F.coalesce(F.try_variant_get("_v", f"$.{field}", "string"), F.lit("None"))

    missing = F.array_join(F.array_compact(F.array(*[F.when(kind(f).isNull(), F.lit(f)) for f in REPORT_FIELDS])), ", ")
    lists = ("reproduction_steps", "missing_evidence")
    reason = (
        F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "not a JSON object")
        .when(missing != "", F.concat(F.lit("missing fields: "), missing))
        .when(~F.coalesce(text("severity").isin(*SEVERITIES), F.lit(False)), "invalid severity")
        .when(~(kind(lists[0]).startswith("ARRAY") & kind(lists[1]).startswith("ARRAY")), "a list field is no array")
    )
    tagged = v.withColumn("reason", reason)
    line = F.trim(F.regexp_replace(strip(text("title")), r"(?U)\s+", " "))
    title = F.when(F.length(line) > MAX_TITLE, F.concat(F.rtrim(F.substring(line, 1, MAX_TITLE - 1)), F.lit("…"))).otherwise(line)
    good = tagged.filter("reason IS NULL").select(
        "report_id", title.alias("title"),
        *[F.substring(text(f), 1, MAX_FIELD).alias(f) for f in ("summary", "expected_behavior", "actual_behavior", "severity_rationale")],
        text("severity").alias("severity"),
        *[F.transform(F.slice(F.try_variant_get("_v", f"$.{f}", "array<string>"), 1, MAX_ITEMS), lambda x: F.substring(x, 1, MAX_ITEM)).alias(f) for f in lists])
    return good, tagged.filter("reason IS NOT NULL").select("report_id", "reason")


def evidence_text(failures: DataFrame) -> Column:
    """The collected evidence of a failure as lines, from triage, history and log columns."""
    triage = F.when(F.col("triage_category").isNotNull(), F.concat(
        F.lit("CI triage: category="), F.col("triage_category"), F.lit(" ("), F.col("classification_method"), F.lit(", confidence "),
        F.col("confidence").cast("string"), F.lit(")")))
    shown = F.when(F.col("evidence").isNotNull(), F.concat(F.lit("evidence: "), F.col("evidence")))
    test = F.when(F.coalesce("test_id", F.lit("")) != "", F.concat(F.lit("Failing test: "), F.col("test_id")))
    history = F.when(F.coalesce("failure_count", F.lit(0)) > 0, F.concat(
        F.lit("History: "), F.col("failure_count").cast("string"), F.lit(" failure(s) over "), F.col("total_runs").cast("string"),
        F.lit(" run(s); last at "), F.coalesce(F.col("last_failure_at").cast("string"), F.lit("None"))))
    log = F.when(F.col("log_id").isNotNull(), F.concat(F.lit("CI log: "), F.substring_index("log_id", "/", -1)))
    return F.coalesce(
        F.nullif(F.concat_ws("\n", triage, shown, test, history, log), F.lit("")),
        F.lit("CI failure (no further evidence collected)"))


def ticket_text(reports: DataFrame) -> Column:
    steps = F.array_join(F.transform("reproduction_steps", lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s)), "\n")
    labelled = [
        F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(c)))
        for label, c in (("Expected", "expected_behavior"), ("Actual", "actual_behavior"), ("Severity", "severity"), ("Severity rationale", "severity_rationale"))
    ]
    return F.concat_ws(
        "\n", F.col("summary"),
        F.when(F.size("reproduction_steps") > 0, F.concat(F.lit("\nReproduction steps:\n"), steps)), *labelled,
        F.when(F.size("missing_evidence") > 0, F.concat(F.lit("Missing evidence: "), F.array_join("missing_evidence", "; "))))


def ticket_rows(reports: DataFrame, key: str = "report_id", max_chars: int | None = None) -> DataFrame:
    """Rows ready to file: redacted, then masked once more; ``egress_masked`` when that second pass found anything."""
    drafted = materialize(reports.select(
        key, redact.redact_text(F.col("title"), max_chars).alias("title"), redact.redact_text(ticket_text(reports), max_chars).alias("body"), "severity"), "tickets")
    masked = evidence.mask_columns(drafted, key, ["title", "body"])
    return masked.select(
        key, F.substring("title", 1, TICKET_TITLE).alias("title"), F.substring("body", 1, TICKET_BODY).alias("body"), "severity",
        (F.size("masked") > 0).alias("egress_masked"))


def ticket_labels(labels: Column) -> Column:
    kept = F.filter(F.slice(labels, 1, TICKET_LABELS), lambda x: strip(x) != "")
    return F.transform(kept, lambda x: F.substring(strip(redact.redact_text(x)), 1, TICKET_LABEL))


def safe_columns(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Redact and mask every named text column before it reaches a ledger."""
    redacted = df
    for c in columns:
        redacted = redacted.withColumn(c, redact.redact_text(F.col(c)))
    return evidence.mask_columns(materialize(redacted, "safe"), key, columns).drop("masked")
