"""Queries over burn-in runs, traces, recipes, reports and the ledger."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliq.functions import secrets
from reliq.functions import signatures as S
from reliq.operators import recipes, stability, traces, triage
from reliq.operators.search import materialize
from reliq.plans import stabilize as plan
from reliq.session import spread
from reliq.sources import files, junit, ledgers
from reliq.workload import history as H
from reliq.workload import views
from reliq.workload.evidence import redact_sql
from reliq.workload.registry import query
from reliq.workload.search import BM25
from reliq.workload.views import BURNIN, CASES, NOW, RUNS

_REPORT = """SELECT test_id, phase, count(*) AS runs, count(*) FILTER (WHERE exit_code = 0) AS passed, count(*) FILTER (WHERE exit_code <> 0) AS failed,
 round(sum(duration_s), 2) AS duration_s, count(*) FILTER (WHERE timed_out) AS timed_out_runs, count(*) FILTER (WHERE exit_code <> 0) = 0 AS all_green,
 count(*) FILTER (WHERE exit_code <> 0) > 0 AS any_failed, count(DISTINCT exit_code) AS codes FROM v_burnin GROUP BY ALL"""


@query("stability_report", f"WITH {BURNIN} {_REPORT}")
def _(t):
    return stability.stability_report(views.burnin(t)).withColumn("codes", F.size("exit_codes")).drop("exit_codes")


@query("burnin_feedback", f"""WITH {BURNIN}, r AS ({_REPORT})
SELECT 'synthetic://burn-in/' || test_id || '@' || phase || '#2024-02-01T00:00:00#' || n AS source_file, 1 AS total, 0 AS failures, 'passed' AS status, test_id || '@' || phase AS name
FROM r, unnest(range(1, greatest(1, passed) + 1)) AS u(n) WHERE all_green""")
def _(t):
    rep = stability.stability_report(views.burnin(t)).withColumn("test_id", F.concat_ws("@", "test_id", "phase"))
    runs, cases = junit.synthetic_runs(stability.green_runs(rep, "2024-02-01T00:00:00"), NOW)
    return runs.select("run_id", "source_file", "total", "failures").join(cases.select("run_id", "name", "status"), "run_id").drop("run_id")


def _trace_lines(t):
    """Each event as the NDJSON lines a browser trace would hold."""
    e = t.spread("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    call = F.concat(F.lit("c"), F.col("event_id").cast("string"))
    error = F.when(F.col("event_type") == "error", F.struct(
        F.when(F.col("k") % 3 == 0, "Error").otherwise("TimeoutError").alias("name"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("AssertionError: got "), F.col("k").cast("string"))).otherwise("Timeout 30000ms exceeded").alias("message")))
    before = F.to_json(F.struct(
        F.lit("before").alias("type"), call.alias("callId"), F.lit("Frame").alias("class"),
        F.when(F.col("k") % 2 == 0, "expect").otherwise(F.col("event_type")).alias("method"), F.lit('expect "toBeVisible"').alias("title"),
        F.struct(F.concat(F.lit("#btn-"), F.col("k").cast("string"), F.lit("f")).alias("selector"), F.lit(30000).alias("timeout")).alias("params")))
    after = F.to_json(F.struct(F.lit("after").alias("type"), call.alias("callId"), error.alias("error"),
                               F.struct((F.col("k") % 3 != 0).alias("timedOut"), F.array(F.lit("waiting"), call).alias("log")).alias("result")))
    request = F.when(F.col("event_type") == "purchase", F.to_json(F.struct(
        F.lit("resource-snapshot").alias("type"), F.struct(
            F.when(F.col("value") < 10, -1.0).otherwise(F.col("value")).alias("time"),
            F.struct(F.concat(F.lit("https://Shop.example.com:8443/cart?token="), F.col("k").cast("string")).alias("url"), F.lit("POST").alias("method")).alias("request"),
            F.struct(F.lit(200).alias("status")).alias("response")).alias("snapshot"))))
    dom = F.when((F.col("event_type") == "signup") & (F.col("user_id") % 2 == 0), F.concat(
        F.lit('{"type":"frame-snapshot","snapshot":{"html":["HTML",{},["DIV",{"id":"btn-'), F.col("k").cast("string"),
        F.lit('f","data-testid":"t'), (F.col("k") % 2).cast("string"), F.lit('"},"text {"]]}}')))
    version = F.when(F.col("k") == 1, F.lit('{"type":"context-options","version":8}'))
    lines = F.array_compact(F.array(version, before, after, dom, request, F.lit("not json")))
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("trace_id"), F.lit("0.trace").alias("entry"),
                    F.posexplode(lines).alias("i", "line"), "event_id").withColumn("line_no", F.col("event_id") * 10 + F.col("i")).drop("i", "event_id")


_TRACE_SQL = """
te AS (SELECT *, 'u' || user_id AS trace_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
bad AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY event_id DESC) AS rn FROM te WHERE event_type = 'error'),
f AS (SELECT trace_id, k, CASE WHEN k % 2 = 0 THEN 'expect.toBeVisible' ELSE event_type END AS failing_action, '#btn-' || k || 'f' AS selector, '30000' AS timeout_ms,
  CASE WHEN k % 3 = 0 THEN 'AssertionError' ELSE 'TimeoutError' END AS error_name,
  CASE WHEN k % 3 = 0 THEN 'AssertionError: got ' || k ELSE 'Timeout 30000ms exceeded' END AS error_message, k % 3 <> 0 AS timed_out FROM bad WHERE rn = 1),
dom AS (SELECT DISTINCT trace_id, k, 't' || (k % 2) AS tid FROM te WHERE event_type = 'signup' AND user_id % 2 = 0),
tgt AS (SELECT f.trace_id, COALESCE((SELECT tid FROM dom d WHERE d.trace_id = f.trace_id AND d.k = f.k),
  (SELECT CASE WHEN count(DISTINCT tid) = 1 THEN min(tid) END FROM dom d WHERE d.trace_id = f.trace_id AND (d.k >= 10) = (f.k >= 10))) AS testid_on_target FROM f),
v_traces AS (SELECT a.*, f.failing_action, f.selector, f.timeout_ms, f.error_name, f.error_message, COALESCE(f.timed_out, false) AS timed_out, tgt.testid_on_target
  FROM (SELECT trace_id, count(*) AS actions_total, max(CASE WHEN k = 1 THEN 8 END) AS trace_version,
    count(*) FILTER (WHERE event_type = 'purchase' AND value < 10) AS pending_requests FROM te GROUP BY trace_id) a LEFT JOIN f USING (trace_id) LEFT JOIN tgt USING (trace_id))"""
_TRACE_COLS = ["trace_id", "actions_total", "trace_version", "pending_requests", "failing_action", "selector", "timeout_ms", "error_name", "error_message", "timed_out", "testid_on_target"]


@query("trace_summaries", f"WITH {_TRACE_SQL} SELECT * FROM v_traces")
def _(t):
    return traces.summarize(_trace_lines(t)).select(*_TRACE_COLS)


@query("trace_requests", """SELECT 'u' || user_id AS trace_id, count(*) AS requests, count(*) FILTER (WHERE value < 10) AS pending, 'https://shop.example.com:8443' AS url
FROM events WHERE event_type = 'purchase' GROUP BY user_id""")
def _(t):
    r = traces.requests(traces.events(_trace_lines(t)))
    return r.groupBy("trace_id").agg(F.count("*").alias("requests"), F.count_if("pending").alias("pending"), F.max("url").alias("url"))


@query("trace_diagnosis", f"""WITH {_TRACE_SQL}, c AS (SELECT *, CASE
  WHEN timed_out AND testid_on_target IS NOT NULL THEN 'fragile_selector' WHEN timed_out AND pending_requests > 0 THEN 'race_condition'
  WHEN timed_out THEN 'timeout' WHEN error_name IS NOT NULL AND contains(failing_action, 'expect') THEN 'data' ELSE 'unknown' END AS cause FROM v_traces)
SELECT trace_id, cause, CAST(CASE cause WHEN 'fragile_selector' THEN 0.85 WHEN 'race_condition' THEN 0.8 WHEN 'timeout' THEN 0.75 WHEN 'data' THEN 0.5 ELSE 0.3 END AS DOUBLE) AS confidence,
 CASE cause WHEN 'timeout' THEN 'timeout' WHEN 'data' THEN 'data' WHEN 'unknown' THEN 'broken_test' ELSE 'flaky' END AS triage_label,
 CASE cause WHEN 'timeout' THEN 'bump_timeout' WHEN 'fragile_selector' THEN 'testid_selector' WHEN 'race_condition' THEN 'await_state' END AS recommended_strategy FROM c""")
def _(t):
    return traces.diagnose(traces.summarize(_trace_lines(t))).select("trace_id", "cause", "confidence", "triage_label", "recommended_strategy")


_RX = "'(?i)'"
_SHAPE = "trim(regexp_replace(regexp_replace({}, '\\\\b[0-9]+[a-f][0-9a-f]*\\\\b', '<h>', 'g'), '\\\\d+', '<n>', 'g'))"


def _failed_actions(t):
    a = traces.actions(traces.events(_trace_lines(t))).filter("failed")
    return recipes.with_parts(a, "error_name", "api_name", "selector", "error_message")


_ACT_SQL = """
fa AS (SELECT 'c' || event_id AS call_id, event_id, CASE WHEN k % 2 = 0 THEN 'expect.toBeVisible' ELSE event_type END AS failing_action,
  CASE WHEN k % 3 = 0 THEN 'AssertionError' ELSE 'TimeoutError' END AS error_class,
  CASE WHEN k >= 10 THEN '#btn-<h>' ELSE '#btn-<n>f' END AS selector_shape,
  CASE WHEN k % 3 = 0 THEN 'AssertionError: got <n>' ELSE 'Timeout <n>ms exceeded' END AS message_shape
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events) WHERE event_type = 'error'),
fs AS (SELECT *, sha256('{"error_class": "' || error_class || '", "failing_action": "' || failing_action || '", "framework": "playwright", "message_shape": "' || message_shape ||
    '", "selector_shape": "' || selector_shape || '"}') AS signature,
  sha256('{"error_class": "' || error_class || '", "failing_action": "' || failing_action || '", "framework": "playwright"}') AS relaxed_key FROM fa)"""


@query("recipe_signatures", f"WITH {_ACT_SQL} SELECT call_id, signature, relaxed_key, false AS degenerate FROM fs")
def _(t):
    return _failed_actions(t).select("call_id", "signature", "relaxed_key", "degenerate")


def _recipes(t):
    a = _failed_actions(t).withColumn("event_id", F.substring("call_id", 2, 20).cast("bigint"))
    base = a.withColumn("created_ts", F.col("event_id").cast("timestamp").cast("timestamp_ntz")).withColumn("strategy", F.concat(F.lit("s"), (F.col("event_id") % 3).cast("string"))).withColumn(
        "patch_ops_json", F.lit("[]")).withColumn("diagnosis_json", F.lit("{}"))
    # read several times; the traces are parsed once
    return materialize(base.select("call_id", "event_id", "signature", "relaxed_key", "degenerate", "created_ts", "strategy", "patch_ops_json", "diagnosis_json"), "failed-actions")


@query("recipe_upsert_and_outcomes", f"""WITH {_ACT_SQL},
lo AS (SELECT signature, min(event_id) AS c, arg_max(event_id % 3, event_id) AS st FROM fs WHERE event_id % 2 = 0 GROUP BY signature),
bp AS (SELECT signature, count(*) AS h, count(*) FILTER (WHERE event_id % 5 = 0) AS s FROM fs GROUP BY signature),
hi AS (SELECT signature, min(event_id) AS c, arg_max(event_id % 3, event_id) AS st FROM fs WHERE event_id % 2 = 1 GROUP BY signature)
SELECT signature, COALESCE(lo.c, hi.c) AS created, 's' || COALESCE(hi.st, lo.st) AS strategy,
  CASE WHEN lo.c IS NULL THEN 0 WHEN hi.st IS NOT NULL AND hi.st <> lo.st THEN 0 ELSE COALESCE(bp.h, 0) END AS hits,
  CASE WHEN lo.c IS NULL THEN 0 WHEN hi.st IS NOT NULL AND hi.st <> lo.st THEN 0 ELSE COALESCE(bp.s, 0) END AS successes
FROM lo FULL JOIN hi USING (signature) LEFT JOIN bp USING (signature)""")
def _(t):
    a = _recipes(t)
    first = recipes.upsert(None, a.filter("event_id % 2 = 0"))
    used = recipes.bump(first, a.select("signature", (F.col("event_id") % 5 == 0).alias("success"), F.col("created_ts").alias("ts")))
    after = recipes.upsert(used, a.filter("event_id % 2 = 1"))
    return after.select("signature", F.unix_seconds(F.col("created_ts").cast("timestamp")).alias("created"), "strategy", "hits", "successes")


@query("recipe_match", f"""WITH {_ACT_SQL},
st AS (SELECT signature, any_value(relaxed_key) AS relaxed_key, min(event_id) AS c FROM fs WHERE event_id % 40 = 0 GROUP BY signature),
b AS (SELECT relaxed_key, arg_min(signature, struct_pack(c := c, s := signature)) AS signature FROM st GROUP BY relaxed_key)
SELECT call_id, COALESCE(st.signature, b.signature) AS recipe, CASE WHEN st.signature IS NOT NULL THEN 'exact' WHEN b.signature IS NOT NULL THEN 'relaxed' ELSE 'miss' END AS kind
FROM fs LEFT JOIN st USING (signature) LEFT JOIN b ON b.relaxed_key = fs.relaxed_key""")
def _(t):
    a = _recipes(t)
    stored = recipes.upsert(None, a.filter("event_id % 40 = 0"))
    return recipes.match(a, stored, "call_id").select("call_id", "recipe", "kind")


@query("dom_ids", """SELECT page_id AS trace_id, '#p' || page_id AS id, CASE WHEN page_id % 3 <> 0 THEN 't' || (page_id % 10) END AS testid FROM pages WHERE page_id % 5 <> 0
UNION ALL SELECT page_id, NULL, 'end' FROM pages""")
def _(t):
    page = F.col("page_id")
    number = page.cast("string")
    element = F.when(page % 5 != 0, F.concat(
        F.lit('["DIV",{"id":"#p'), number, F.lit('"'), F.when(page % 3 != 0, F.concat(F.lit(',"data-testid":"t'), (page % 10).cast("string"), F.lit('"'))).otherwise(""),
        F.lit(',"n":'), number, F.lit(',"open":true},')))
    text = F.to_json(F.struct(F.col("html").alias("v")))
    html = F.concat(F.coalesce(element, F.lit('["DIV",{},')), F.substring(text, F.lit(6), F.length(text) - 6), F.lit(',["P",{"data-testid":"end"}]]'))
    line = F.concat(F.lit('{"type":"frame-snapshot","snapshot":{"html":'), html, F.lit("}}"))
    lines = t("pages").select(page.alias("trace_id"), F.lit("0.trace").alias("entry"), F.lit(0).alias("line_no"), line.alias("line"))
    return traces.dom_ids(traces.events(lines)).select("trace_id", "id", "testid")


@query("trace_brief", """SELECT doc_id AS trace_id, 'to ' || lang || ' a***@e****.com' AS error_message, 'click' AS failing_action, '#x' AS selector, 'waiting for b***@e****.com' AS log FROM documents""")
def _(t):
    lang = F.col("lang")
    before = F.lit('{"type":"before","callId":"c","class":"Frame","method":"click","params":{"selector":"#x"}}')
    after = F.concat(F.lit('{"type":"after","callId":"c","error":{"name":"Error","message":"to '), lang, F.lit(' ann@e12x.com"},"result":{"log":["waiting for bob@exam.com"]}}'))
    lines = t("documents").select(F.col("doc_id").alias("trace_id"), F.lit("0.trace").alias("entry"), F.posexplode(F.array(before, after)).alias("line_no", "line"))
    return traces.brief(traces.summarize(lines)).select("trace_id", "error_message", "failing_action", "selector", F.get("call_log", 0).alias("log"))


@query("backfilled_keys", """SELECT doc_id AS id, doc_id % 3 <> 1 AS has_key, CASE WHEN doc_id % 3 = 0 THEN 'old' END AS old FROM documents""")
def _(t):
    doc = F.col("doc_id")
    parts = F.to_json(F.struct(F.struct(F.lit("timeout").alias("cause")).alias("diagnosis"), F.struct(
        F.lit("playwright").alias("framework"), F.col("lang").alias("error_class"), F.lit("click").alias("failing_action"), F.col("source").alias("selector_shape"),
        F.col("text").alias("message_shape")).alias("signature_parts")))
    stored = t("documents").select(doc.alias("id"), F.when(doc % 3 == 0, "old").alias("relaxed_key"), F.when(doc % 3 == 1, '{"cause":"x"}').otherwise(parts).alias("diagnosis_json"))
    return recipes.backfill_relaxed_keys(stored).select("id", F.col("relaxed_key").isNotNull().alias("has_key"), F.when(F.col("relaxed_key") == "old", "old").alias("old"))


@query("stable_diagnoses", """SELECT doc_id AS id, lang AS cause, md5(text) AS note, NULL::VARCHAR AS stage FROM documents""")
def _(t):
    raw = F.to_json(F.struct(F.col("lang").alias("cause"), F.lit("rules").alias("diagnosis_stage"), (F.col("doc_id") % 2 == 0).alias("llm_used"), F.col("text").alias("note")))
    clean = t("documents").select(F.col("doc_id").alias("id"), recipes.stable_diagnosis(raw).alias("d"))
    return clean.select("id", F.get_json_object("d", "$.cause").alias("cause"), F.md5(F.get_json_object("d", "$.note")).alias("note"), F.get_json_object("d", "$.diagnosis_stage").alias("stage"))


@query("ledger_defaults", """SELECT '2024-01-01' AS day, CASE WHEN doc_id % 2 = 0 THEN 'tool' ELSE source END AS trigger, lang AS project, '' AS outcome, '{}' AS stage_results_json, count(*) AS n
FROM documents GROUP BY ALL""")
def _(t):
    rows = t("documents").select(F.when(F.col("doc_id") % 2 != 0, F.col("source")).alias("trigger"), F.col("lang").alias("project"), "text")
    made = ledgers.ledger_rows("pipeline_runs", rows, NOW.replace(year=2024, month=1, day=1))
    return made.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "trigger", "project", "outcome", "stage_results_json").agg(F.count("*").alias("n"))


@query("safe_urls", r"""SELECT page_id, CASE WHEN regexp_matches(url, '^https?://') THEN regexp_extract(url, '^https?://[^/?#]+') ELSE '[redacted-url]' END AS url FROM pages""")
def _(t):
    return t("pages").select("page_id", secrets.safe_url(F.col("url")).alias("url"))


@query("shapes", r"""SELECT event_id, trim(regexp_replace(regexp_replace('#btn-' || k || 'f at ' || k || '0', '\b\d{2,}f\b', '<h>', 'g'), '\d+', '<n>', 'g')) AS shape
FROM (SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)""")
def _(t):
    k = F.get_json_object("props", "$.k")
    return t("events").select("event_id", S.shape(F.concat(F.lit("#btn-"), k, F.lit("f at "), k, F.lit("0"))).alias("shape"))


@query("ci_failed_jobs", """SELECT o_orderkey AS run_id, o_orderstatus AS conclusion, 1 AS failed_steps FROM orders WHERE o_orderstatus NOT IN ('O')""")
def _(t):
    conclusion = F.when(F.col("o_orderstatus") == "O", "success").otherwise(F.col("o_orderstatus"))
    job = F.struct(F.col("o_orderkey").alias("id"), F.lit("build").alias("name"), conclusion.alias("conclusion"), F.array(
        F.struct(F.lit("checkout").alias("name"), F.lit("success").alias("conclusion")), F.struct(F.lit("test").alias("name"), conclusion.alias("conclusion"))).alias("steps"))
    pages = t("orders").select(F.col("o_orderkey").alias("run_id"), F.to_json(F.struct(F.array(job).alias("jobs"))).alias("text"))
    return files.ci_jobs(pages).select("run_id", "conclusion", F.size("failed_steps").alias("failed_steps"))


@query("failed_job_logs", """WITH e AS (SELECT l_orderkey AS run_id, 'job' || (l_linenumber % 3) || '/' || l_partkey || '.txt' AS entry, l_linenumber % 3 AS j FROM lineitem),
fj AS (SELECT o_orderkey AS run_id, o_custkey % 4 AS j FROM orders), m AS (SELECT e.run_id FROM e JOIN fj USING (run_id, j))
SELECT run_id, entry FROM e WHERE EXISTS (SELECT 1 FROM fj WHERE fj.run_id = e.run_id AND fj.j = e.j) OR run_id NOT IN (SELECT run_id FROM m)""")
def _(t):
    entry = F.concat(F.lit("job"), (F.col("l_linenumber") % 3).cast("string"), F.lit("/"), F.col("l_partkey").cast("string"), F.lit(".txt"))
    entries = t("lineitem").select(F.col("l_orderkey").alias("run_id"), entry.alias("entry"), F.lit("").alias("text"))
    jobs = t("orders").select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("job"), (F.col("o_custkey") % 4).cast("string")).alias("name"))
    return files.failed_job_entries(entries, jobs).select("run_id", "entry")


@query("junit_shred", f"""WITH {CASES}
SELECT case_id, name, COALESCE(classname, '') AS classname, status, duration_ms * 1000 AS duration_ms, failure_message, stack_trace,
 1 AS total, CASE WHEN status = 'failed' THEN 1 ELSE 0 END AS failures FROM v_cases WHERE case_id % 101 <> 7""")
def _(t):
    c = views.cases(t)
    tag = F.when(F.col("status") == "failed", "failure").otherwise(F.col("status"))
    child = F.when(F.col("status") == "passed", "").otherwise(F.concat(
        F.lit("<"), tag, F.coalesce(F.concat(F.lit(' message="'), F.col("failure_message"), F.lit('"')), F.lit("")), F.lit(">"), F.coalesce("stack_trace", F.lit("")), F.lit("</"), tag, F.lit(">")))
    xml = F.concat(
        F.when(F.col("case_id") % 101 == 7, F.lit("<!DOCTYPE x>")).otherwise(F.lit("")),
        F.lit('<testsuites><testsuite name="s" timestamp="2024-05-01T10:00:00Z"><testcase name="'), F.col("name"), F.lit('" classname="'),
        F.coalesce("classname", F.lit("")), F.lit('" time="'), F.col("duration_ms").cast("string"), F.lit('">'), child, F.lit("</testcase></testsuite></testsuites>"))
    docs = spread(c).select(F.col("case_id").cast("string").alias("path"), xml.cast("binary").alias("content")).withColumn(
        "length", F.octet_length("content").cast("bigint")).withColumn("modificationTime", F.lit(NOW).cast("timestamp"))
    rep = junit.Reports(materialize(junit.shred(docs), "junit"), F.lit(NOW), "b1")
    both = rep.cases.join(rep.runs.select("run_id", "source_file", "total", "failures"), "run_id")
    return both.select(F.col("source_file").cast("bigint").alias("case_id"), "name", F.coalesce("classname", F.lit("")).alias("classname"), "status", "duration_ms",
                       "failure_message", "stack_trace", "total", "failures")


@query("report_input_checks", """SELECT doc_id AS report_id, CASE WHEN trim(text) = '' THEN 'raw_text is required' ELSE 'raw_text exceeds the 16 KB limit' END AS reason
FROM documents WHERE trim(text) = '' OR strlen(text) > 16384""")
def _(t):
    raw = t("documents").select(F.col("doc_id").alias("report_id"), F.col("text").alias("raw_text"), F.lit(None).cast("string").alias("context"))
    return stability.check_raw_reports(raw)[1]


def _report_json(t):
    sev = F.element_at(F.array(*[F.lit(s) for s in (*stability.SEVERITIES, "urgent")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return t.spread("documents").select(F.col("doc_id").alias("report_id"), F.to_json(F.struct(
        F.concat(F.lit("  Report\n "), F.col("source"), F.lit(" "), F.repeat(F.lit("x"), (F.col("doc_id") % 100).cast("int"))).alias("title"),
        F.col("text").alias("summary"), F.array(F.col("lang"), F.lit("mail a.b@example.com")).alias("reproduction_steps"), F.lit("works").alias("expected_behavior"),
        F.lit("call 123-45-6789").alias("actual_behavior"), sev.alias("severity"), F.lit("why").alias("severity_rationale"), F.array().cast("array<string>").alias("missing_evidence"))).alias("json"))


@query("bug_reports", """SELECT doc_id AS report_id, CASE WHEN length(t) > 80 THEN rtrim(left(t, 79)) || '…' ELSE t END AS title, least(length(text), 4000) AS summary_chars,
 ['critical', 'high', 'medium', 'low', 'unknown'][doc_id % 6 + 1] AS severity FROM (SELECT *, trim('Report ' || source || ' ' || repeat('x', doc_id % 100)) AS t FROM documents) WHERE doc_id % 6 < 5""")
def _(t):
    return stability.normalize_reports(_report_json(t))[0].select("report_id", "title", F.length("summary").alias("summary_chars"), "severity")


@query("rejected_reports", "SELECT doc_id AS report_id, 'invalid severity' AS reason FROM documents WHERE doc_id % 6 = 5")
def _(t):
    return stability.normalize_reports(_report_json(t))[1]


_BODY = """left(text, 4000) || chr(10) || chr(10) || 'Reproduction steps:' || chr(10) || '1. ' || lang || chr(10) || '2. mail a.b@example.com' || chr(10) ||
 'Expected: works' || chr(10) || 'Actual: call 123-45-6789' || chr(10) || 'Severity: ' || ['critical', 'high', 'medium', 'low', 'unknown'][doc_id % 6 + 1] || chr(10) || 'Severity rationale: why'"""


@query("ticket_rows", f"""SELECT doc_id AS report_id, CASE WHEN length(t) > 80 THEN rtrim(left(t, 79)) || '…' ELSE t END AS title, {redact_sql(_BODY)} AS body,
 ['critical', 'high', 'medium', 'low', 'unknown'][doc_id % 6 + 1] AS severity, false AS egress_masked
 FROM (SELECT *, trim('Report ' || source || ' ' || repeat('x', doc_id % 100)) AS t FROM documents) WHERE doc_id % 6 < 5""")
def _(t):
    return stability.ticket_rows(stability.normalize_reports(_report_json(t))[0])


def _failures(t):
    c = views.cases(t).filter(F.col("status").isin("failed", "error"))
    tid = F.concat(F.coalesce("classname", "file_path", F.lit("")), F.lit("::"), F.col("name"))
    log = F.when(F.col("case_id") % 4 != 0, F.concat(F.lit("log"), (F.col("run_id") % 200).cast("string")))
    return c.select(F.col("case_id").cast("string").alias("failure_id"), tid.alias("test_id"), log.alias("log_id"), F.lit("p").alias("project")).dropDuplicates(["failure_id"])


_LEDGER = H.VERDICTS + f""",
fl AS (SELECT DISTINCT CAST(case_id AS VARCHAR) AS failure_id, COALESCE(classname, file_path, '') || '::' || name AS test_id, CASE WHEN case_id % 4 <> 0 THEN run_id % 200 END AS u
  FROM v_cases WHERE status IN ('failed', 'error')),
ev AS (SELECT user_id AS u, CASE WHEN user_id % 3 = 0 THEN 'flaky' ELSE 'data' END AS category FROM events GROUP BY user_id),
gr AS (SELECT user_id AS u, user_id % 2 = 0 AS ok FROM events GROUP BY user_id),
c AS (SELECT fl.*, COALESCE(ev.category, CASE WHEN v.status = 'flaky' THEN 'flaky' END) AS category, v.status AS vs FROM fl LEFT JOIN ev USING (u) LEFT JOIN v_verdicts v ON v.test_key = fl.test_id),
d AS (SELECT *, CASE WHEN category = 'flaky' THEN 'heal' WHEN category IS NOT NULL THEN 'bug' END AS branch FROM c)"""


@query("failure_routes", f"{_LEDGER} SELECT failure_id, test_id, category, branch FROM d")
def _(t):
    f = _failures(t)
    users = t("events").select(F.concat(F.lit("log"), F.col("user_id").cast("string")).alias("log_id"), F.when(F.col("user_id") % 3 == 0, "flaky").otherwise("data").alias("category")).distinct()
    v = H.scanned(t).select(F.col("test_key").alias("test_id"), (F.col("status") == "flaky").alias("is_flaky"))
    return stability.route(f.join(users, "log_id", "left").join(v, "test_id", "left")).select("failure_id", "test_id", "category", "branch")


# The stages' results by the failure's number and the test's number: burn-ins that are all green, pull requests, gates, reports, tickets.
@query("stabilize_ledger", f"""{_LEDGER},
past AS (SELECT i.test_id, count(DISTINCT run_id) AS total_runs, count(DISTINCT CASE WHEN status IN ('failed', 'error') THEN run_id END) AS failure_count
  FROM (SELECT DISTINCT test_id, split_part(test_id, '::', 1) AS l, split_part(test_id, '::', 2) AS r FROM fl) i
  JOIN v_cases c ON c.name = i.r AND (c.classname = i.l OR c.file_path = i.l) GROUP BY i.test_id),
tiers AS (
  SELECT test_id, v.*, CASE WHEN v.test_key = test_id THEN 1 ELSE 2 END AS tier
  FROM (SELECT DISTINCT test_id, split_part(test_id, '::', 1) AS l, split_part(test_id, '::', 2) AS r FROM fl) i
  JOIN v_verdicts v ON v.test_key = test_id OR (v.name = r AND (v.classname = l OR v.file_path = l))),
best AS (SELECT test_id, status AS answer FROM tiers QUALIFY row_number() OVER (PARTITION BY test_id ORDER BY tier, fails DESC, runs DESC, test_key) = 1),
num AS (SELECT *, CAST(failure_id AS BIGINT) AS n, CAST(split_part(test_id, '::test_', 2) AS INTEGER) AS k, COALESCE(answer, 'unknown') AS verdict,
  CASE category WHEN 'flaky' THEN 'heal' WHEN 'data' THEN 'bug' END AS branch
  FROM (SELECT failure_id, fl.test_id, u, answer, COALESCE(ev.category, CASE WHEN answer = 'flaky' THEN 'flaky' END) AS category
    FROM fl LEFT JOIN ev USING (u) LEFT JOIN best ON best.test_id = fl.test_id))
SELECT failure_id, test_id, verdict, COALESCE(total_runs, 0) AS total_runs, COALESCE(failure_count, 0) AS failure_count, category, branch,
  CASE WHEN branch = 'heal' AND k % 4 = 0 THEN CASE WHEN n % 3 = 0 THEN 'pr_opened' ELSE 'healed' END
    WHEN branch = 'bug' AND n % 7 <> 0 AND u % 2 = 0 THEN CASE WHEN n % 2 <> 0 THEN 'ticket_ready' WHEN n % 5 = 0 THEN 'ticket_created' ELSE 'needs_attention' END
    ELSE 'needs_attention' END AS outcome
FROM num LEFT JOIN past USING (test_id)""")
def _(t):
    f = _failures(t)
    number = F.col("failure_id").cast("bigint")
    triaged = t("events").select(F.concat(F.lit("log"), F.col("user_id").cast("string")).alias("log_id"), F.when(F.col("user_id") % 3 == 0, "flaky").otherwise("data").alias("category"),
                                 F.lit("heuristic").alias("classification_method"), F.lit(0.3).alias("confidence"), F.lit("x").alias("evidence")).distinct()
    tests = views.cases(t)
    burnin = tests.select(F.concat(F.coalesce("classname", "file_path", F.lit("")), F.lit("::"), F.col("name")).alias("test_id"), F.col("duration_ms").alias("duration_s"),
                          F.when(F.substring("name", 6, 9).cast("int") % 4 == 0, 0).otherwise(1).alias("exit_code"))
    gates = f.select(F.col("failure_id").alias("ticket_id"), (F.regexp_extract("log_id", r"(\d+)", 1).try_cast("int") % 2 == 0).alias("ok"))
    reports = f.filter(number % 7 != 0).select(F.col("failure_id").alias("report_id"))
    pulls, tickets = f.filter(number % 3 == 0), f.filter(number % 5 == 0)
    led = plan.stabilize(f, *H.base(t), H.scanned(t), triaged, burnin, gates, reports, number % 2 == 0, pulls=pulls, tickets=tickets)
    return led.select("failure_id", "test_id", "verdict", "total_runs", "failure_count", "category", "branch", "outcome")


_CONTEXT = BM25.replace("item_id AS query_id", "text AS query_id").replace("FROM benchmark", "FROM asked")


@query("incident_context", f"""{_LEDGER},
logs AS (SELECT DISTINCT user_id AS u, 'ERROR: token src' || (user_id % 5) || ' step ' || (user_id % 7) || ' failed' AS s FROM events),
fa AS (SELECT failure_id, COALESCE(s, test_id) AS text FROM fl LEFT JOIN logs USING (u)),
asked AS (SELECT DISTINCT text FROM fa), {_CONTEXT},
h AS (SELECT query_id, string_agg('- ' || key || ': ' || trim({redact_sql('summary')}) || ' [[redacted-name]]', chr(10) ORDER BY rank) AS lines
  FROM ranked JOIN v_incidents ON key = ranked.doc_id WHERE rank <= 3 GROUP BY query_id)
SELECT failure_id, lines AS incident_lines FROM fa JOIN h ON h.query_id = fa.text""")
def _(t):
    user = F.col("user_id").cast("string")
    triaged = t("events").select(F.concat(F.lit("log"), user).alias("log_id"), F.format_string(
        "ERROR: token src%d step %d failed", F.col("user_id") % 5, F.col("user_id") % 7).alias("excerpt")).distinct()
    return plan.incident_context(_failures(t), triaged, views.incidents(t), 3, views.incident_index(t))
