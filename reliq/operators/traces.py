"""Browser traces: summary per trace, DOM ids, rule-based diagnosis.

Input rows: ``(trace_id, entry, line_no, line)`` of NDJSON events. Actions, requests
and DOM ids stay tables; per trace only extremes are aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliq.functions import loglines as L
from reliq.functions import secrets
from reliq.functions import signatures as S
from reliq.functions.text import strip
from reliq.operators import evidence
from reliq.operators.search import materialize

# Bounds, bookkeeping classes, diagnosis patterns, confidences and labels.
NON_ACTIONS = ("Test", "Tracing", "LocalUtils")
BRIEF_CALL_LOG, BRIEF_ERROR = 20, 500
ERROR_NAME = r"(?U)\b([A-Z][a-zA-Z]*Error)\b"
ENVIRONMENT = (
    r"(?i)(ECONNREFUSED|ENOTFOUND|EHOSTUNREACH|EAI_AGAIN|ERR_CONNECTION_REFUSED|ERR_NAME_NOT_RESOLVED|ERR_INTERNET_DISCONNECTED)"
)
INFRA = (
    r"(?i)(target page, context or browser has been closed|browser has been closed|browserType\.launch|browser crash|crashed"
    r"|SIGKILL|SIGSEGV|out of memory)"
)
LOG_TIMEOUT = r"(?i)Timeout \d+ms exceeded"
LOG_SELECTOR = r"waiting for locator\('([^']+)'\)"
CONFIDENCE = {
    "environment": 0.8, "infra": 0.75, "fragile_selector": 0.85, "race_condition": 0.8, "timeout": 0.75,
    "log_timeout": 0.6, "data": 0.5, "unknown": 0.3,
}
LABELS = {
    "timeout": "timeout", "fragile_selector": "flaky", "race_condition": "flaky", "environment": "environment",
    "data": "data", "infra": "infra", "unknown": "broken_test",
}
STRATEGIES = {"timeout": "bump_timeout", "fragile_selector": "testid_selector", "race_condition": "await_state"}
# A flat object inside JSON: an element's attributes.
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_PLAIN = r"[-+.0-9a-zA-Z]++"
ATTRIBUTES = rf"\{{\s*+(?:{_STRING}\s*+:\s*+(?:{_STRING}|{_PLAIN})\s*+,?\s*+)*+\}}"


def events(lines: DataFrame) -> DataFrame:
    """Typed event columns, each line parsed once; ``pos`` orders events inside a trace.

    ``.network`` entries come after ``.trace`` ones. Lines that are no JSON object are left out.
    """
    pos = F.struct(F.endswith("entry", F.lit(".network")).alias("n"), F.col("entry").alias("e"), F.col("line_no").alias("l"))
    # other lines cost an exception each in the parser
    objects = lines.filter(F.col("line").rlike(r"^[ \t\r\n]*+\{"))
    parsed = objects.select("trace_id", pos.alias("pos"), F.try_parse_json("line").alias("_v"))

    def get(path: str, t: str = "string") -> Column:
        return F.try_variant_get("_v", path, t)

    def kind(path: str) -> Column:
        return F.coalesce(F.schema_of_variant(F.try_variant_get("_v", path, "variant")), F.lit(""))

    err = F.coalesce(get("$.error.error", "variant"), get("$.error", "variant"))

    def of_error(field: str) -> Column:
        return F.coalesce(get(f"$.error.error.{field}"), get(f"$.error.{field}"), F.lit(""))

    type_ = get("$.type")
    return parsed.filter(F.schema_of_variant("_v").startswith("OBJECT")).select(
        "trace_id", "pos", type_.alias("type"), get("$.callId").alias("call_id"), get("$.class").alias("klass"),
        F.coalesce(get("$.method"), F.lit("")).alias("method"), get("$.title").alias("title"), get("$.message").alias("message"),
        get("$.version", "int").alias("version"),
        F.when(kind("$.params.selector") == "STRING", get("$.params.selector")).alias("selector"),
        F.when(kind("$.params.timeout").rlike("INT|DECIMAL|DOUBLE"), get("$.params.timeout")).alias("timeout_ms"),
        F.when((type_ == "after") & F.coalesce(F.to_json(err), F.lit("{}")).rlike(r"^\{.+\}$"), F.struct(
            strip(of_error("name")).alias("name"), of_error("message").alias("message"), of_error("stack").alias("stack"))).alias("error"),
        F.coalesce(get("$.result.timedOut", "boolean"), F.lit(False)).alias("timed_out"),
        F.when(type_ == "log", F.array(get("$.message"))).when(type_ == "after", get("$.result.log", "array<string>")).alias("log"),
        F.when(type_ == "frame-snapshot", F.to_json(get("$.snapshot.html", "variant"))).alias("html"),
        F.when((type_ == "resource-snapshot") & kind("$.snapshot").startswith("OBJECT"), F.struct(
            F.coalesce(get("$.snapshot.request.url"), F.lit("")).alias("url"), F.coalesce(get("$.snapshot.request.method"), F.lit("GET")).alias("method"),
            get("$.snapshot.response.status", "bigint").alias("status"), get("$.snapshot.time", "double").alias("time"))).alias("request"),
    )


def safe_text(text: Column) -> Column:
    return secrets.scrub(L.strip_ansi(F.coalesce(text, F.lit(""))))


def actions(ev: DataFrame) -> DataFrame:
    """One row per (trace, call): the first ``before`` with the last error of its ``after`` events."""
    title = F.regexp_extract("title", '"([^"]+)"', 1)
    api = F.when((F.col("method") == "expect") & (title != ""), F.concat(F.lit("expect."), title)).otherwise(F.col("method"))
    is_before = (F.col("type") == "before") & ~F.coalesce(F.col("klass").isin(*NON_ACTIONS), F.lit(False))
    rows = ev.filter(F.col("type").isin("before", "after") & (F.coalesce("call_id", F.lit("")) != "")).select(
        "trace_id", "call_id",
        F.when(is_before, F.struct("pos", api.alias("api_name"), "selector", "timeout_ms")).alias("_b"),
        F.when(F.col("error").isNotNull(), F.struct("pos", "error", "timed_out")).alias("_a"),
    )
    rows = rows.filter(F.col("_b").isNotNull() | F.col("_a").isNotNull())
    per_call = rows.groupBy("trace_id", "call_id").agg(F.min("_b").alias("_b"), F.max("_a").alias("_a")).filter(F.col("_b").isNotNull())
    name, message, late = F.col("_a.error.name"), F.col("_a.error.message"), F.col("_a.timed_out")
    found = [F.nullif(F.regexp_extract(F.substring_index(x, "\n", 1), ERROR_NAME, 1), F.lit("")) for x in (F.col("_a.error.stack"), message)]
    resolved = F.when(~name.isin("", "Expect", "Error"), name).otherwise(
        F.coalesce(*found, F.when(late, F.lit("TimeoutError")), F.nullif(name, F.lit("")), F.lit("Error")))
    low = F.lower(message)
    failed = F.col("_a").isNotNull()
    return per_call.select(
        "trace_id", "call_id", "_b.*", F.when(failed, resolved).alias("error_name"), F.when(failed, safe_text(message)).alias("error_message"),
        F.when(failed, late | (F.contains(low, F.lit("timeout")) & F.contains(low, F.lit("exceeded")))).alias("timed_out"), failed.alias("failed"))


def requests(ev: DataFrame) -> DataFrame:
    r = ev.filter(F.col("request").isNotNull()).select("trace_id", "pos", "request.*")
    return r.select(
        "trace_id", "pos", secrets.safe_url(F.col("url")).alias("url"), F.substring("method", 1, 16).alias("method"),
        F.nullif("status", F.lit(0)).alias("status"), F.col("time").alias("duration_ms"),
        (F.coalesce(F.col("time") < 0, F.lit(False)) | (F.coalesce("status", F.lit(0)) == 0)).alias("pending"))


def dom_ids(ev: DataFrame) -> DataFrame:
    """Elements of the snapshots with an id or test id: the first test id seen per (trace, id)."""
    attrs = ev.filter(F.col("html").isNotNull()).select(
        "trace_id", "pos", F.posexplode(F.regexp_extract_all("html", F.lit(ATTRIBUTES), F.lit(0))).alias("i", "a"))
    fields = attrs.select(
        "trace_id", F.struct("pos", "i").alias("at"), F.nullif(F.get_json_object("a", "$.id"), F.lit("")).alias("id"),
        F.nullif(F.get_json_object("a", "$['data-testid']"), F.lit("")).alias("testid"))
    return fields.filter(F.col("id").isNotNull() | F.col("testid").isNotNull()).groupBy("trace_id", "id", "testid").agg(F.min("at").alias("at"))


def target_testids(failing: DataFrame, dom: DataFrame) -> DataFrame:
    """``(trace_id, testid)`` of the failing selector's element, for a plain ``#id`` selector.

    The exact id decides when it exists; otherwise ids of the same shape do,
    when they all carry one and the same test id.
    """
    plain = failing.withColumn("_id", F.regexp_extract(strip(F.col("selector")), r"(?U)^#([\w-]+)$", 1)).filter("_id <> ''").select("trace_id", "_id")
    first = dom.filter("id IS NOT NULL").groupBy("trace_id", "id").agg(F.min(F.struct("at", "testid")).alias("f")).select("trace_id", "id", "f.testid")
    exact = plain.join(first.withColumnRenamed("id", "_id"), ["trace_id", "_id"]).select("trace_id", "testid")
    rest = plain.join(first.select("trace_id", F.col("id").alias("_id")), ["trace_id", "_id"], "left_anti")
    shaped = first.filter("testid IS NOT NULL").withColumn("_shape", S.shape(F.col("id")))
    similar = rest.withColumn("_shape", S.shape(F.col("_id"))).join(shaped, ["trace_id", "_shape"]).groupBy("trace_id").agg(
        F.count_distinct("testid").alias("n"), F.first("testid").alias("testid")).filter("n = 1")
    return exact.unionByName(similar.select("trace_id", "testid"))


def call_logs(ev: DataFrame, failing: DataFrame) -> DataFrame:
    """``(trace_id, k, text)``: the failing call's log lines in order."""
    lines = ev.filter(F.col("log").isNotNull()).join(failing.select("trace_id", "call_id"), ["trace_id", "call_id"], "left_semi")
    rows = lines.select("trace_id", "pos", F.posexplode("log").alias("i", "line"))
    order = Window.partitionBy("trace_id").orderBy("pos", "i")
    return rows.select("trace_id", F.row_number().over(order).alias("k"), strip(safe_text(F.col("line"))).alias("text"))


MASKED = ("selector", "error_message", "test_error_message", "testid_on_target", "pending_urls")


def mask_summaries(rows: DataFrame, logs: DataFrame) -> DataFrame:
    """The summaries with personal data masked in every text column, and the masked call log added."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.lit(0).alias("k"), F.col(c).alias("text")) for c in MASKED]))
    texts = rows.select("trace_id", fields.alias("x")).select("trace_id", "x.*").unionByName(logs.withColumn("what", F.lit("call_log"))).filter("text <> ''")
    keyed = materialize(texts.withColumn("_place", F.concat_ws("\0", "trace_id", "what", "k")), "trace-texts")
    masked = evidence.mask_columns(keyed, "_place", ["text"]).groupBy("trace_id").agg(
        *[F.max(F.when(F.col("what") == c, F.col("text"))).alias(f"_{c}") for c in MASKED],
        F.sort_array(F.collect_list(F.when(F.col("what") == "call_log", F.struct("k", "text")))).alias("_log"))
    joined = rows.join(masked, "trace_id", "left")
    for c in MASKED:
        joined = joined.withColumn(c, F.coalesce(f"_{c}", c))
    log = F.coalesce(F.transform("_log", lambda x: x["text"]), F.array().cast("array<string>"))
    return joined.withColumn("call_log", log).select(*rows.columns, "call_log")


def summarize(lines: DataFrame) -> DataFrame:
    """One row per trace that holds a recognisable event."""
    ev = materialize(events(lines), "trace-events")
    acts = actions(ev)
    reqs = requests(ev)
    failing = acts.filter("failed").groupBy("trace_id").agg(
        F.max_by(F.struct("call_id", "api_name", "selector", "timeout_ms", "error_name", "error_message", "timed_out"), "pos").alias("_f")
    ).select("trace_id", "_f.*")
    totals = acts.groupBy("trace_id").agg(F.count("*").alias("actions_total"))
    version = F.col("version")
    message = F.nullif(safe_text(F.col("message")), F.lit(""))
    general = ev.groupBy("trace_id").agg(
        F.max(F.when(F.col("type") == "context-options", version)).alias("trace_version"),
        F.min_by(F.when(F.col("type") == "error", message), F.when((F.col("type") == "error") & message.isNotNull(), F.col("pos"))).alias("test_error_message"))
    first = Window.partitionBy("trace_id").orderBy("pos")
    waiting = reqs.filter("pending")
    shown = waiting.withColumn("_k", F.row_number().over(first)).filter("_k <= 3").groupBy("trace_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", "url"))), lambda x: x["url"]), ", ").alias("pending_urls"))
    pending = waiting.groupBy("trace_id").agg(F.count("*").alias("pending_requests")).join(shown, "trace_id")
    logs = materialize(call_logs(ev, failing), "call-logs")
    resolved = logs.groupBy("trace_id").agg(F.max(F.contains("text", F.lit("resolved to"))).alias("selector_resolved"))
    found = (
        general.join(totals, "trace_id", "left").join(failing, "trace_id", "left")
        .join(resolved, "trace_id", "left").join(pending, "trace_id", "left")
        .join(target_testids(failing, dom_ids(ev)).withColumnRenamed("testid", "testid_on_target"), "trace_id", "left")
        .filter(F.col("actions_total").isNotNull() | F.col("trace_version").isNotNull())
        .select(
            "trace_id", F.lit("playwright").alias("framework"), "trace_version", F.col("api_name").alias("failing_action"), "selector", "timeout_ms",
            "error_name", "error_message", "test_error_message", F.coalesce("timed_out", F.lit(False)).alias("timed_out"),
            F.coalesce("selector_resolved", F.lit(False)).alias("selector_resolved"),
            F.coalesce("pending_requests", F.lit(0)).alias("pending_requests"), F.coalesce("pending_urls", F.lit("")).alias("pending_urls"),
            "testid_on_target", F.coalesce("actions_total", F.lit(0)).alias("actions_total"))
    )
    return mask_summaries(materialize(found, "trace-summaries"), logs)


def brief(summaries: DataFrame) -> DataFrame:
    """The view that may leave: scrubbed and masked already, error text and call log cut."""
    return summaries.withColumn("error_message", F.substring(F.coalesce("error_message", F.lit("")), 1, BRIEF_ERROR)).withColumn(
        "call_log", F.slice("call_log", F.greatest(F.lit(1), F.size("call_log") - BRIEF_CALL_LOG + 1), BRIEF_CALL_LOG))


def _quoted(text: Column) -> Column:
    mark = F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), F.lit('"')).otherwise(F.lit("'"))
    return F.coalesce(F.concat(mark, text, mark), F.lit("None"))


def diagnose(cases: DataFrame) -> DataFrame:
    """Rule diagnosis per row of summary columns and an optional ``log_excerpt``; ``has_trace`` tells logs-only rows."""
    log = F.col("log_excerpt") if "log_excerpt" in cases.columns else F.lit(None).cast("string")
    has_trace = F.col("has_trace") if "has_trace" in cases.columns else F.lit(True)
    pieces = F.filter(
        F.concat(F.array(F.coalesce("error_message", F.lit("")), F.coalesce("test_error_message", F.lit(""))),
                 F.coalesce("call_log", F.array().cast("array<string>")), F.array(log)), lambda x: x.isNotNull())
    text = F.array_join(pieces, "\n")
    selector = F.coalesce("selector", F.nullif(F.regexp_extract(log, LOG_SELECTOR, 1), F.lit("")))
    action = F.coalesce("failing_action", F.lit("None"))
    timed_out = has_trace & F.coalesce("timed_out", F.lit(False))
    env, infra = F.regexp_extract(text, ENVIRONMENT, 1), F.regexp_extract(text, INFRA, 1)
    fragile = timed_out & (F.coalesce(selector, F.lit("")) != "") & ~F.col("selector_resolved") & (F.coalesce("testid_on_target", F.lit("")) != "")
    rules = [
        (env != "", "environment", F.concat(F.lit("network-level failure marker '"), env, F.lit("' in the failure output"))),
        (infra != "", "infra", F.concat(F.lit("browser/runner infrastructure failure: '"), infra, F.lit("'"))),
        (fragile, "fragile_selector", F.concat(
            action, F.lit(" timed out waiting for "), _quoted(selector), F.lit(" which never attached, but the DOM snapshot shows a same-shaped element carrying data-testid="),
            _quoted(F.col("testid_on_target")))),
        (timed_out & (F.col("pending_requests") > 0), "race_condition", F.concat(
            action, F.lit(" timed out while network requests were still unsettled ("), F.col("pending_urls"),
            F.lit("); the assertion ran before the data it depends on arrived"))),
        (timed_out, "timeout", F.concat(
            action, F.lit(" on "), _quoted(selector), F.lit(" timed out after "), F.coalesce("timeout_ms", F.lit("None")),
            F.lit("ms; the element resolved but did not reach the expected state in time and no network requests were pending"))),
        (~has_trace & log.rlike(LOG_TIMEOUT), "log_timeout", F.lit("timeout marker found in CI log (no trace available for deeper analysis)")),
        (has_trace & F.col("error_name").isNotNull() & F.contains(action, F.lit("expect")), "data", F.concat(
            F.lit("assertion "), action, F.lit(" failed without timing out — received value likely differs from expectation (possible test-data drift)"))),
    ]
    rule, why = F.lit("unknown"), F.lit("no deterministic rule matched the failure evidence")
    for when, name, note in reversed(rules):
        hit = F.coalesce(when, F.lit(False))
        rule, why = F.when(hit, F.lit(name)).otherwise(rule), F.when(hit, note).otherwise(why)

    def lookup(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])

    out = cases.withColumn("_rule", rule).withColumn("evidence", why).withColumn("selector", selector)
    cause = F.when(F.col("_rule") == "log_timeout", "timeout").otherwise(F.col("_rule"))
    return out.withColumn("cause", cause).withColumn("confidence", lookup(CONFIDENCE)[F.col("_rule")]).withColumn(
        "triage_label", lookup(LABELS)[F.col("cause")]).withColumn("recommended_strategy", F.try_element_at(lookup(STRATEGIES), F.col("cause"))).drop("_rule")
