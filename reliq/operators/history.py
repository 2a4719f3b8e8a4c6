"""Failure history: per test id, per module, store status, retention."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliq import checks
from reliq.functions import text as X
from reliq.operators import literals, search
from reliq.operators.verdicts import FAILING, asked_keys, offered_keys

MAX_OFFENDERS = 50
CASE_COLUMNS = ["case_id", "run_id", "classname", "name", "file_path", "status"]
#: Columns that a text or literal lookup reads.
TEXT_COLUMNS = ["classname", "name", "failure_message", "stack_trace"]


def is_failing() -> Column:
    return F.col("status").isin(*FAILING)


def known_tests(ids: DataFrame, cases: DataFrame) -> DataFrame:
    """``(test_id, name, classname, file_path)``: the distinct tests an id names exactly.

    Ids meet the distinct tests, not the cases: that table is reduced map-side and
    stays small however many runs there are.
    """
    tests = cases.select("name", "classname", "file_path").distinct()
    wanted = ids.select("test_id").distinct().select("test_id", F.explode(asked_keys(F.col("test_id"))).alias("_k"))
    return wanted.join(tests.withColumn("_k", F.explode(offered_keys())), "_k").drop("_k")


def cases_of(tests: DataFrame, cases: DataFrame) -> DataFrame:
    """The cases of ``known_tests`` rows; null-safe equality is still an equi-join."""
    t = tests.select("test_id", F.col("name").alias("_n"), F.col("classname").alias("_c"), F.col("file_path").alias("_f"))
    same = (F.col("_n") == F.col("name")) & F.col("_c").eqNullSafe(F.col("classname")) & F.col("_f").eqNullSafe(F.col("file_path"))
    return cases.join(t, same).select("test_id", *cases.columns)


def exact_matches(ids: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases per ``test_id``: class or file plus name, or the bare name."""
    return cases_of(known_tests(ids, cases), cases)


def text_matches(ids: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases that hold every word of the id's name part in class, name, message or trace.

    Cases with the same four texts are read as one; what is found meets the cases by the texts' hash.
    """
    _, right = X.id_parts(F.col("test_id"))
    wanted = ids.select("test_id", search.phrases(right).alias("phrases"))
    keyed = cases.withColumn("_texts", literals.combination(TEXT_COLUMNS))
    # Written once: the search reads the terms several times, and what reads the matches in several ways joins the found keys only.
    docs = search.materialize(keyed.select("_texts", *TEXT_COLUMNS).distinct().select("_texts", search.term_text(*TEXT_COLUMNS).alias("_terms")), "case-terms")
    found = search.materialize(search.all_terms_join(wanted, "test_id", docs, "_texts", "_terms"), "text-hits")
    return keyed.join(found, "_texts").select("test_id", *cases.columns)


def is_term_query(test_id: Column) -> Column:
    """Whether the id's name part can be read as terms: letters, digits, ``_`` and blanks, or quotes and ``*`` around these."""
    _, right = X.id_parts(test_id)
    return right.rlike(r'^(?U)[\w\s"*]+$')


def literal_matches(ids: DataFrame, cases: DataFrame, index: literals.LiteralIndex | None = None) -> DataFrame:
    """Cases that hold the id's name part literally in class, name, message or trace; ``index`` is a stored one over these columns."""
    _, right = X.id_parts(F.col("test_id"))
    wanted = ids.select("test_id", right.alias("needle"))
    found = (index or literals.build(cases, TEXT_COLUMNS)).matching_rows(wanted, cases, TEXT_COLUMNS, CASE_COLUMNS)
    return wanted.join(found, "needle").select("test_id", *CASE_COLUMNS)


def matches(ids: DataFrame, cases: DataFrame, index: literals.LiteralIndex | None = None) -> DataFrame:
    """(test_id, case columns) of exact matches; ids that have none are sought as terms, or literally if they cannot be terms.

    The resolved ids are small tables and used several times, so they are written
    once; without unmatched ids the case texts are not read at all.
    """
    asked = search.materialize(ids.select("test_id").distinct(), "ids")
    tests = search.materialize(known_tests(asked, cases), "known-tests")
    exact = cases_of(tests, cases).select("test_id", *CASE_COLUMNS)
    missing = search.materialize(asked.join(tests.select("test_id"), "test_id", "left_anti"), "unmatched-ids")
    found = fallback_matches(missing, cases, index)
    return exact if found is None else exact.unionByName(found)


def fallback_matches(missing: DataFrame, cases: DataFrame, index: literals.LiteralIndex | None = None) -> DataFrame | None:
    """Matches of ids that name no test; None, and no case read, if there is no such id. ``missing`` is a written table."""
    kinds = {r.terms for r in missing.select(is_term_query(F.col("test_id")).alias("terms")).distinct().collect()}
    found = []
    if True in kinds:
        found.append(text_matches(missing.filter(is_term_query(F.col("test_id"))), cases))
    if False in kinds:
        found.append(literal_matches(missing.filter(~is_term_query(F.col("test_id"))), cases, index))
    return reduce(DataFrame.unionByName, [f.select("test_id", *CASE_COLUMNS) for f in found]) if found else None


def lookup_counts(matched: DataFrame, with_cases: bool = False) -> DataFrame:
    """Distinct runs, distinct failing runs, distinct tests per id; on request also the cases.

    Rows first collapse per (id, run) and per (id, test), spread over both
    columns, so one popular id does not load one task.
    """
    per_run = matched.groupBy("test_id", "run_id").agg(F.max(is_failing()).alias("_bad"), F.count("*").alias("_n"))
    by_run = per_run.groupBy("test_id").agg(F.count("*").alias("total_runs"), F.count_if("_bad").alias("failure_count"), F.sum("_n").alias("cases"))
    per_test = matched.select("test_id", "classname", "name").distinct().groupBy("test_id").agg(F.count("*").alias("matched_tests"))
    return by_run.join(per_test, "test_id").select("test_id", "total_runs", "failure_count", "matched_tests", *["cases"] * with_cases)


def failure_totals(ids: DataFrame, cases: DataFrame, runs: DataFrame) -> DataFrame:
    """(test_id, total_runs, failure_count, last_failure_at) of exactly matching cases, in one pass over them."""
    timed = exact_matches(ids, cases).select("test_id", "run_id", is_failing().alias("_bad")).groupBy("test_id", "run_id").agg(F.max("_bad").alias("_bad")).join(
        runs.select("run_id", "effective_ts"), "run_id")
    return timed.groupBy("test_id").agg(F.count("*").alias("total_runs"), F.count_if("_bad").alias("failure_count"),
                                        F.max(F.when(F.col("_bad"), F.col("effective_ts"))).alias("last_failure_at"))


def recent_failures(matched: DataFrame, runs: DataFrame, limit: int = checks.DEFAULT_LIMIT) -> DataFrame:
    """The latest failing cases per id, ranked by effective time then case id."""
    limit = checks.clamp(limit, checks.MIN_LIMIT, checks.MAX_LIMIT, checks.DEFAULT_LIMIT)
    timed = matched.filter(is_failing()).join(runs.select("run_id", "effective_ts"), "run_id")
    order = Window.partitionBy("test_id").orderBy(F.desc_nulls_last("effective_ts"), "case_id")
    # The rank filter becomes a WindowGroupLimit before the shuffle: at most `limit` rows per id and task move.
    return timed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def failure_lookup(ids: DataFrame, cases: DataFrame, runs: DataFrame, limit: int = checks.DEFAULT_LIMIT,
                   max_trace_chars: int = 500, index: literals.LiteralIndex | None = None) -> DataFrame:
    """Counts and the latest failures (an array of at most 50) for every id, from the cases; ``rollups.failure_lookup`` reads rollups."""
    # Kept slim and computed once: counts need no texts, and only failing rows are ranked.
    return _answers_of(ids, search.materialize(matches(ids, cases, index), "matches"), cases, runs, limit, max_trace_chars)


def fallback_lookup(missing: DataFrame, cases: DataFrame, runs: DataFrame, limit: int, max_trace_chars: int,
                    index: literals.LiteralIndex | None = None) -> DataFrame | None:
    """``failure_lookup`` for ids that are known to name no test; None if there are none."""
    found = fallback_matches(missing, cases, index)
    return None if found is None else _answers_of(missing, search.materialize(found, "matches"), cases, runs, limit, max_trace_chars)


def _answers_of(ids: DataFrame, slim: DataFrame, cases: DataFrame, runs: DataFrame, limit: int, max_trace_chars: int) -> DataFrame:
    texts = cases.filter(is_failing()).select("case_id", "run_id", "failure_type", "failure_message", "stack_trace")
    latest = recent_failures(slim, runs, limit).join(texts, ["case_id", "run_id"])
    return lookup_answers(ids.select("test_id").distinct(), lookup_counts(slim), latest, max_trace_chars)


def lookup_answers(ids: DataFrame, counts: DataFrame, latest: DataFrame, max_trace_chars: int) -> DataFrame:
    """One row per id from its counts and ranked failures; zeros and no failures for an id without."""
    failures = latest.groupBy("test_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "rank", "run_id", F.col("effective_ts").alias("timestamp"), "status", "classname", "name",
            "file_path", "failure_type", F.col("failure_message").alias("message"),
            X.truncate(F.col("stack_trace"), max_trace_chars).alias("stack_trace_excerpt"),
        ))).alias("failures"))
    zero = F.lit(0)
    return (
        ids.join(counts, "test_id", "left")
        .join(failures, "test_id", "left")
        .select(
            "test_id",
            F.coalesce("matched_tests", zero).alias("matched_tests"),
            F.coalesce("total_runs", zero).alias("total_runs"),
            F.coalesce("failure_count", zero).alias("failure_count"),
            F.element_at("failures", 1)["timestamp"].alias("last_failure_at"),
            "failures",
        )
    )


def module_groups(cases: DataFrame, runs: DataFrame, prefix: str | None, since, min_failures: int = 1) -> DataFrame:
    """Per (file, name, class): all rows, failing rows, last failing time.

    Counts every row, skipped ones and re-ingested runs included. The prefix
    reaches the parquet scan as StringStartsWith.
    """
    min_failures = checks.clamp(min_failures, 1, None, 1)
    since = checks.require_iso(since, "since")
    if prefix is not None:
        cases = cases.filter(F.col("file_path").startswith(checks.require_path_prefix(prefix)))
    in_window = runs.filter(F.col("effective_ts") >= F.lit(since)).select("run_id", "effective_ts")
    return (
        cases.filter(F.col("file_path").isNotNull()).select("run_id", "file_path", "name", "classname", "status")
        .join(in_window, "run_id")
        .groupBy("file_path", "name", "classname")
        .agg(
            F.count("*").alias("total_runs"),
            F.count_if(is_failing()).alias("failure_count"),
            F.max(F.when(is_failing(), F.col("effective_ts"))).alias("last_failure_at"),
        )
        .filter(F.col("failure_count") >= min_failures)
    )


def module_failure_history(cases: DataFrame, runs: DataFrame, paths: DataFrame, since, min_failures: int = 1) -> DataFrame:
    """Top offenders per requested path prefix, with the total before the cut.

    ``paths`` is a table of prefixes. Each group row meets only the prefixes it
    starts with: prefixes join on their text up to the last slash of the file.
    """
    groups = module_groups(cases, runs, None, since, min_failures)
    # A file meets a prefix by its own first n characters, for the lengths that were asked for
    # (at most 500 different ones), so the match is an equi-join.
    lengths = paths.agg(F.collect_set(F.length("path")).alias("_lengths"))
    fitting = F.filter("_lengths", lambda n: n <= F.length("file_path"))
    probe = groups.join(F.broadcast(lengths)).withColumn(
        "path", F.explode(F.transform(fitting, lambda n: F.substring("file_path", F.lit(1), n)))).drop("_lengths")
    hit = probe.join(paths.select("path").distinct(), "path")
    totals = hit.groupBy("path").agg(F.count("*").alias("tests_with_failures"))
    order = Window.partitionBy("path").orderBy(
        F.desc("failure_count"), F.desc("total_runs"), "name", F.asc_nulls_first("file_path"), F.asc_nulls_first("classname"))
    top = hit.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= MAX_OFFENDERS)
    return top.join(totals, "path").withColumn("truncated", F.col("tests_with_failures") > MAX_OFFENDERS)


def store_status(runs: DataFrame, cases: DataFrame) -> DataFrame:
    by_run = runs.agg(F.count("*").alias("runs"), F.min("effective_ts").alias("earliest"), F.max("effective_ts").alias("latest"))
    by_case = cases.agg(F.count("*").alias("cases"))
    both = by_run.unionByName(by_case, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("runs", "earliest", "latest", "cases")])


def split_old_runs(runs: DataFrame, cutoff) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) runs; an unknown time is kept."""
    old = F.col("effective_ts") < F.lit(checks.require_iso(cutoff, "before"))
    return runs.filter(~F.coalesce(old, F.lit(False))), runs.filter(old)


def prune_cases(cases: DataFrame, kept_runs: DataFrame) -> DataFrame:
    return cases.join(kept_runs.select("run_id"), "run_id", "left_semi")
