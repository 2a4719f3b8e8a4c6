"""Queries over runs and cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliq.functions import times
from reliq.operators import history, rollups, verdicts
from reliq.workload import views
from reliq.workload.registry import Tables, query
from reliq.workload.views import CASES, MIN_FAILS, NOW, RUNS, WINDOW_DAYS

CUTOFF = times.window_cutoff(NOW, WINDOW_DAYS)
_CUT = f"TIMESTAMP '{CUTOFF.isoformat(sep=' ')}'"
_TS = "'%Y-%m-%dT%H:%M:%S'"


def _stamp(df, *cols):
    for c in cols:
        df = df.withColumn(c, times.iso(F.col(c)))
    return df


def _verdict_sql(cut: str, min_fails: int = MIN_FAILS, errors: bool = True) -> str:
    fails = "('failed','error')" if errors else "('failed')"
    counted = f"(status = 'passed' OR status IN {fails})"
    return f"""
logical AS (
  SELECT run_id, effective_ts FROM (
    SELECT *, row_number() OVER (PARTITION BY source_file, effective_ts ORDER BY ingested_at DESC, run_id DESC) AS rn
    FROM v_runs WHERE effective_ts >= {cut}) WHERE rn = 1),
counted AS (
  SELECT c.*, l.effective_ts AS et,
    COALESCE(NULLIF(trim(classname), ''), trim(file_path), '') || '::' || trim(name) AS test_key
  FROM v_cases c JOIN logical l USING (run_id) WHERE status <> 'skipped'),
v_verdicts AS (
  SELECT *, CASE WHEN fails >= {min_fails} AND passes >= 1 THEN 'flaky'
                 WHEN fails >= {min_fails} THEN 'consistently_failing' ELSE 'stable' END AS status
  FROM (
    SELECT test_key,
      arg_min(struct_pack(v := classname), struct_pack(et := et, c := case_id)).v AS classname,
      arg_min(name, struct_pack(et := et, c := case_id)) AS name,
      arg_min(file_path, struct_pack(et := et, c := case_id)) FILTER (WHERE file_path <> '') AS file_path,
      count(*) FILTER (WHERE status = 'passed') AS passes,
      count(*) FILTER (WHERE status IN {fails}) AS fails,
      count(*) FILTER (WHERE {counted}) AS runs,
      {WINDOW_DAYS} AS window_days,
      strftime(min(et) FILTER (WHERE {counted}), {_TS}) AS first_seen,
      strftime(max(et) FILTER (WHERE {counted}), {_TS}) AS last_seen,
      strftime(max(et) FILTER (WHERE status IN {fails}), {_TS}) AS last_failure
    FROM counted GROUP BY test_key)
  WHERE runs > 0)"""


def base(t: Tables):
    return views.cases(t), views.runs(t)


def scanned(t: Tables, now=NOW, errors=True):
    return verdicts.scan_verdicts(*base(t), now, WINDOW_DAYS, MIN_FAILS, errors)


VERDICTS = f"WITH {RUNS}, {CASES}, {_verdict_sql(_CUT)}"
ALL_IDS_SQL = """
ids AS (
  SELECT DISTINCT CASE run_id % 3 WHEN 0 THEN COALESCE(classname, file_path, '') || '::' || name
       WHEN 1 THEN COALESCE(file_path, classname, '') || '::' || name ELSE name END AS test_id FROM v_cases)"""


def all_ids(t: Tables):
    """Every test of the case table asked for, by class, by file or by bare name."""
    ns1 = F.concat(F.coalesce("classname", "file_path", F.lit("")), F.lit("::"), F.col("name"))
    ns2 = F.concat(F.coalesce("file_path", "classname", F.lit("")), F.lit("::"), F.col("name"))
    return views.cases(t).select(
        F.when(F.col("run_id") % 3 == 0, ns1).when(F.col("run_id") % 3 == 1, ns2).otherwise(F.col("name")).alias("test_id")
    ).distinct()


@query("verdicts", VERDICTS + " SELECT * FROM v_verdicts")
def _(t):
    return _stamp(scanned(t), "first_seen", "last_seen", "last_failure")


@query("verdicts_without_errors", f"WITH {RUNS}, {CASES}, {_verdict_sql(_CUT, errors=False)} SELECT * FROM v_verdicts")
def _(t):
    return _stamp(scanned(t, errors=False), "first_seen", "last_seen", "last_failure")


@query("surviving_runs", f"""WITH {RUNS}, {CASES}, {_verdict_sql(_CUT)}
SELECT run_id, strftime(effective_ts, {_TS}) AS effective_ts FROM logical""")
def _(t):
    return _stamp(verdicts.surviving_runs(views.runs(t), CUTOFF), "effective_ts")


@query("verdict_status_counts", VERDICTS + " SELECT status, count(*) AS n FROM v_verdicts GROUP BY status")
def _(t):
    return scanned(t).groupBy("status").agg(F.count("*").alias("n"))


@query("scan_summary", VERDICTS + """
SELECT count(*) AS tests_examined, count(*) FILTER (WHERE status = 'flaky') AS flaky_found FROM v_verdicts""")
def _(t):
    return verdicts.scan_summary(scanned(t))


@query("worst_first_listing", VERDICTS + """
SELECT test_key, status, fails, runs, row_number() OVER (ORDER BY fails DESC, runs DESC, test_key) AS pos
FROM v_verdicts WHERE status IN ('flaky','consistently_failing')""")
def _(t):
    bad = verdicts.list_verdicts(scanned(t), [verdicts.FLAKY, verdicts.CONSISTENTLY_FAILING])
    from pyspark.sql import Window
    pos = F.row_number().over(Window.orderBy(F.desc("fails"), F.desc("runs"), "test_key"))
    return bad.select("test_key", "status", "fails", "runs", pos.alias("pos"))


PREV = NOW.replace(year=2001, month=4)
_PREV_CUT = f"TIMESTAMP '{times.window_cutoff(PREV, WINDOW_DAYS).isoformat(sep=' ')}'"


@query("flaky_changes", f"""WITH {RUNS}, {CASES}, {_verdict_sql(_CUT)},
cur AS (SELECT test_key FROM v_verdicts WHERE status = 'flaky'),
prev AS (SELECT test_key FROM (WITH {_verdict_sql(_PREV_CUT).replace('v_verdicts', 'p_verdicts').replace('logical', 'p_logical').replace('counted AS', 'p_counted AS').replace('FROM counted', 'FROM p_counted')}
  SELECT * FROM p_verdicts) WHERE status = 'flaky')
SELECT test_key, 'newly_flaky' AS change, '  + now flaky: ' || test_key AS line FROM cur WHERE test_key NOT IN (SELECT test_key FROM prev)
UNION ALL
SELECT test_key, 'newly_resolved', '  - no longer flaky: ' || test_key FROM prev WHERE test_key NOT IN (SELECT test_key FROM cur)""")
def _(t):
    return verdicts.report_lines(None, verdicts.flaky_changes(scanned(t, PREV), scanned(t)))


@query("full_report_lines", VERDICTS + """
SELECT status AS section, fails, runs, test_key,
  CASE status WHEN 'flaky' THEN '  • ' || test_key || '  [' || fails || ' fail / ' || passes || ' pass of ' || runs || ']  last failure ' || COALESCE(last_failure, '-')
  ELSE '  • ' || test_key || '  [' || fails || ' fail of ' || runs || ']' END AS line
FROM v_verdicts WHERE status <> 'stable'""")
def _(t):
    return verdicts.report_lines(scanned(t), scope="human")


@query("undedupable_sources", f"""WITH {RUNS}
SELECT source_file, count(*) AS undated_runs FROM v_runs
WHERE run_timestamp IS NULL AND ingested_at >= {_CUT} GROUP BY source_file HAVING count(*) > 1""")
def _(t):
    return verdicts.undedupable_sources(views.runs(t), CUTOFF)


_RESOLVE = """
parts AS (
  SELECT test_id, CASE WHEN contains(test_id, '::') THEN split_part(test_id, '::', 1) END AS l,
    CASE WHEN contains(test_id, '::') THEN split_part(test_id, '::', 2) ELSE test_id END AS r FROM ids)"""


@query("is_flaky", VERDICTS + "," + ALL_IDS_SQL + "," + _RESOLVE + """,
tiers AS (
  SELECT p.test_id, v.*, 1 AS tier FROM parts p JOIN v_verdicts v ON v.test_key = p.test_id
  UNION ALL SELECT p.test_id, v.*, 2 FROM parts p JOIN v_verdicts v ON v.name = p.r AND (v.classname = p.l OR v.file_path = p.l)
  UNION ALL SELECT p.test_id, v.*, 3 FROM parts p JOIN v_verdicts v ON v.name = p.r AND p.l IS NULL),
best AS (
  SELECT *, count(*) OVER (PARTITION BY test_id) AS matched,
    row_number() OVER (PARTITION BY test_id ORDER BY fails DESC, runs DESC, test_key) AS rn
  FROM (SELECT *, min(tier) OVER (PARTITION BY test_id) AS mt FROM tiers) WHERE tier = mt)
SELECT i.test_id, COALESCE(b.status, 'unknown') AS status, COALESCE(b.status = 'flaky', false) AS is_flaky, b.test_key, b.fails,
  b.passes, b.runs, b.window_days, b.last_failure, COALESCE(b.matched, 0) AS matched
FROM ids i LEFT JOIN (SELECT * FROM best WHERE rn = 1) b USING (test_id)""")
def _(t):
    return _stamp(verdicts.is_flaky(all_ids(t), scanned(t)), "last_failure")


_MATCHED = """
matched AS (
  SELECT p.test_id, c.*, r.effective_ts AS et FROM parts p
  JOIN v_cases c ON c.name = p.r AND (p.l IS NULL OR c.classname = p.l OR c.file_path = p.l)
  JOIN v_runs r USING (run_id))"""
_TERMS = """
terms AS (
  SELECT case_id, run_id, ' ' || array_to_string(list_transform(
    [COALESCE(classname, ''), COALESCE(name, ''), COALESCE(failure_message, ''), COALESCE(stack_trace, '')],
    lambda c: trim(regexp_replace(lower(c), '[^\\p{L}\\p{N}]+', ' ', 'g'))), ' | ') || ' ' AS hay FROM v_cases)"""
_LOOKUP = f"WITH {RUNS}, {CASES}, {ALL_IDS_SQL}, {_RESOLVE}, {_MATCHED}"


@query("failure_lookup", _LOOKUP + "," + _TERMS + f""",
fuzzy AS (
  SELECT p.test_id, c.*, r.effective_ts AS et
  FROM parts p JOIN terms ON contains(hay, ' ' || trim(regexp_replace(p.r, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' ')
  JOIN v_cases c USING (case_id, run_id) JOIN v_runs r USING (run_id)
  WHERE p.test_id NOT IN (SELECT test_id FROM matched)),
hits AS (SELECT * FROM matched UNION ALL SELECT * FROM fuzzy),
top AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY et DESC NULLS LAST, case_id) AS rank FROM hits WHERE status IN ('failed','error')),
shown AS (SELECT test_id, count(*) AS failures_returned, string_agg(concat_ws('|', rank, run_id, strftime(et, {_TS}), status, classname, name, file_path, failure_type,
  failure_message, stack_trace), chr(10) ORDER BY rank) AS failures FROM top WHERE rank <= 10 GROUP BY test_id)
SELECT test_id, count(DISTINCT struct_pack(c := classname, n := name)) AS matched_tests,
  count(DISTINCT run_id) AS total_runs,
  count(DISTINCT CASE WHEN status IN ('failed','error') THEN run_id END) AS failure_count,
  strftime(max(CASE WHEN status IN ('failed','error') THEN et END), {_TS}) AS last_failure_at,
  coalesce(any_value(failures_returned), 0) AS failures_returned, coalesce(any_value(failures), '') AS failures
FROM hits LEFT JOIN shown USING (test_id) GROUP BY test_id""")
def _(t):
    out = rollups.failure_lookup(all_ids(t), views.history_rollups(t), *base(t))
    line = F.transform("failures", lambda f: F.concat_ws(
        "|", f["rank"], f["run_id"], times.iso(f["timestamp"]), f["status"], f["classname"], f["name"], f["file_path"], f["failure_type"], f["message"], f["stack_trace_excerpt"]))
    return _stamp(out, "last_failure_at").withColumn("failures_returned", F.coalesce(F.size("failures"), F.lit(0)).cast("long")).withColumn(
        "failures_returned", F.greatest("failures_returned", F.lit(0).cast("long"))).withColumn("failures", F.coalesce(F.array_join(line, "\n"), F.lit("")))


@query("recent_failures", _LOOKUP + f"""
SELECT test_id, case_id, status, strftime(et, {_TS}) AS at, rank, failure_message FROM (
  SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY et DESC NULLS LAST, case_id) AS rank
  FROM matched WHERE status IN ('failed','error')) WHERE rank <= 5""")
def _(t):
    cases, runs = base(t)
    top = history.recent_failures(history.exact_matches(all_ids(t), cases), runs, 5)
    return top.select("test_id", "case_id", "status", times.iso(F.col("effective_ts")).alias("at"), "rank", "failure_message")


_SINCE = "2001-01-01T00:00:00"
_GROUPS = f"""
groups AS (
  SELECT file_path, name, classname, count(*) AS total_runs,
    count(*) FILTER (WHERE status IN ('failed','error')) AS failure_count,
    max(CASE WHEN status IN ('failed','error') THEN effective_ts END) AS last_failure_at
  FROM v_cases JOIN v_runs USING (run_id)
  WHERE file_path IS NOT NULL AND effective_ts >= TIMESTAMP '2001-01-01'
  GROUP BY ALL HAVING failure_count >= 1)"""


@query("module_groups", f"""WITH {RUNS}, {CASES}, {_GROUPS}
SELECT file_path, name, classname, total_runs, failure_count, strftime(last_failure_at, {_TS}) AS last_failure_at
FROM groups WHERE starts_with(file_path, 'src/m')""")
def _(t):
    return _stamp(history.module_groups(*base(t), "src/m", _SINCE), "last_failure_at")


@query("module_failure_history", f"""WITH {RUNS}, {CASES}, {_GROUPS},
paths AS (SELECT DISTINCT split_part(file_path, 't.py', 1) AS path FROM v_cases WHERE file_path IS NOT NULL)
SELECT path, file_path, name, classname, total_runs, failure_count, strftime(last_failure_at, {_TS}) AS last_failure_at,
  row_number() OVER (PARTITION BY path ORDER BY failure_count DESC, total_runs DESC, name, file_path NULLS FIRST, classname NULLS FIRST) AS rank,
  count(*) OVER (PARTITION BY path) AS tests_with_failures, count(*) OVER (PARTITION BY path) > 50 AS truncated
FROM groups JOIN paths ON starts_with(file_path, path) QUALIFY rank <= 50""")
def _(t):
    cases, runs = base(t)
    paths = cases.filter("file_path IS NOT NULL").select(F.substring_index("file_path", "t.py", 1).alias("path"))
    return _stamp(history.module_failure_history(cases, runs, paths, _SINCE), "last_failure_at")


@query("text_fallback", f"""WITH {RUNS}, {CASES}, {_TERMS},
ids AS (SELECT DISTINCT 'step ' || (l_suppkey % 50) || ' expected' AS test_id, l_suppkey % 50 AS n FROM lineitem)
SELECT test_id, count(*) AS cases FROM ids JOIN terms
ON contains(hay, ' step ') AND contains(hay, ' ' || n || ' ') AND contains(hay, ' expected ') GROUP BY test_id""")
def _(t):
    ids = t("lineitem").select(
        F.concat(F.lit("step "), (F.col("l_suppkey") % 50).cast("string"), F.lit(" expected")).alias("test_id")).distinct()
    return history.text_matches(ids, views.cases(t)).groupBy("test_id").agg(F.count("*").alias("cases"))


#: Needles of the literal lookup: of one, two and more characters, wildcards of SQL, other case, blanks, none at all.
_NEEDLES = ["%", "_", "e", "t_", "_9", "9 b", "step 1", " of test_4", "pected 3 but g", "TEST_4", "got 6", "mod_1", "%_", "zz", "", "  "]


@query("substring_lookup", f"""WITH {RUNS}, {CASES},
n AS (SELECT unnest({_NEEDLES}) AS needle UNION SELECT 'step ' || (l_suppkey % 50) || ' of test_' || (l_partkey % 10) FROM lineitem),
m AS (SELECT needle, c.* FROM n JOIN v_cases c ON needle <> '' AND (contains(classname, needle) OR contains(name, needle) OR contains(failure_message, needle) OR contains(stack_trace, needle)))
SELECT needle, count(*) AS cases, count(DISTINCT run_id) AS total_runs, count(DISTINCT CASE WHEN status IN ('failed','error') THEN run_id END) AS failure_count,
  count(DISTINCT struct_pack(c := classname, n := name)) AS matched_tests FROM m GROUP BY needle""")
def _(t):
    spark, cases = t.spark, views.cases(t)
    step = F.concat(F.lit("step "), (F.col("l_suppkey") % 50).cast("string"), F.lit(" of test_"), (F.col("l_partkey") % 10).cast("string"))
    needles = spark.createDataFrame([(n,) for n in _NEEDLES], "test_id string").union(t("lineitem").select(step)).distinct()
    found = history.literal_matches(needles, cases, views.literal_index(t))
    return history.lookup_counts(found, with_cases=True).select(F.col("test_id").alias("needle"), "cases", "total_runs", "failure_count", "matched_tests")


@query("store_status", f"""WITH {RUNS}
SELECT count(*) AS runs, strftime(min(effective_ts), {_TS}) AS earliest, strftime(max(effective_ts), {_TS}) AS latest,
  (SELECT count(*) FROM lineitem) AS cases FROM v_runs""")
def _(t):
    return _stamp(history.store_status(views.runs(t), views.cases(t)), "earliest", "latest")


@query("prune_history", f"""WITH {RUNS}, {CASES}
SELECT status, count(*) AS cases, count(DISTINCT run_id) AS runs FROM v_cases
WHERE run_id IN (SELECT run_id FROM v_runs WHERE effective_ts >= TIMESTAMP '1999-01-01') GROUP BY status""")
def _(t):
    kept, _ = history.split_old_runs(views.runs(t), "1999-01-01")
    left = history.prune_cases(views.cases(t), kept)
    return left.groupBy("status").agg(F.count("*").alias("cases"), F.count_distinct("run_id").alias("runs"))
