"""Log triage as one chain of DataFrame steps over a corpus of logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliq.functions import secrets
from reliq.functions import taxonomy as T
from reliq.operators import logs, search, triage


def signed_excerpts(lines: DataFrame, **bounds) -> DataFrame:
    """Scrubbed excerpts with signature and words; ``lines`` also carries ``project``."""
    projects = lines.groupBy("log_id").agg(F.first("project").alias("project"))
    excerpts = logs.log_excerpts(lines, **bounds).withColumn("excerpt", secrets.scrub(F.col("excerpt")))
    return triage.sign(excerpts.join(projects, "log_id"))


def triage_logs(lines: DataFrame, patterns: DataFrame | None, now, categories=T.CATEGORIES, classifier=None, max_per_project: int | None = None,
                **bounds) -> tuple[DataFrame, DataFrame]:
    """(results per log, pattern table after learning from them).

    A column ``seen_at`` of ``lines`` dates what a log teaches; without it ``now`` does. Learned
    patterns are cut per project only on request; ``triage.prune_patterns`` is a job of its own.
    """
    # Numbered lines, known patterns, and one bounded row per log: each is read by several branches below and computed once.
    lines = search.materialize(lines, "log-lines")
    patterns = None if patterns is None else search.materialize(patterns, "known-patterns")
    signed = search.materialize(signed_excerpts(lines, **bounds), "excerpts")
    classified = triage.classify(signed, categories, classifier)
    if patterns is not None:
        prior = triage.prior_patterns(signed.select("log_id", "project", "signature", "tokens"), patterns)
        classified = classified.join(prior, "log_id", "left")
    else:
        classified = (
            classified.withColumn("prior_category", F.lit(None).cast("string")).withColumn("prior_occurrences", F.lit(None).cast("bigint"))
            .withColumn("prior_signature", F.lit(None).cast("string")).withColumn("fuzzy", F.lit(None).cast("boolean"))
        )
    observed = triage.observations(classified)
    if "seen_at" in lines.columns:
        observed = observed.join(lines.groupBy("log_id").agg(F.max("seen_at").cast("timestamp_ntz").alias("seen_at")), "log_id")
    else:
        observed = observed.withColumn("seen_at", F.lit(now).cast("timestamp_ntz"))
    learned = triage.prune_patterns(triage.record_patterns(patterns, observed), now, max_per_project=max_per_project)
    results = classified.select(
        "log_id", "project", "category", F.round("confidence", 3).alias("confidence"), "evidence",
        F.col("method").alias("classification_method"),
        F.col("prior_signature").isNotNull().alias("prior_seen"),
        F.coalesce("prior_occurrences", F.lit(0)).alias("prior_occurrences"),
        F.when(F.col("fuzzy"), "fuzzy").alias("prior_match"),
        F.coalesce("signature", F.lit("")).alias("signature"),
        "excerpt", "original_bytes", "hit_count", "truncated", "low_signal",
    )
    return results, learned
