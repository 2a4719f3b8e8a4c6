"""The given tables seen as runs, cases, logs, documents and incidents.

Each view is written once for Spark and once as SQL text, side by side.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reliq.operators import incidents as I
from reliq.operators import history as H
from reliq.operators import lines, literals, rollups, text_index
from reliq.workload.registry import Tables

NOW = datetime(2001, 8, 1)
WINDOW_DAYS = 180
MIN_FAILS = 3


def _text(col) -> F.Column:
    return col.cast("string")


def runs(t: Tables) -> DataFrame:
    o = t("orders")
    run_ts = F.when(F.col("o_orderkey") % 7 != 0, F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"))
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderpriority").alias("suite_name"),
        F.concat(F.lit("ci/"), _text(F.col("o_custkey")), F.lit(".xml")).alias("source_file"),
        run_ts.alias("run_timestamp"),
        F.col("o_orderdate").alias("ingested_at"),
        F.coalesce(run_ts, F.col("o_orderdate")).alias("effective_ts"),
    )


RUNS = """
v_runs AS (
  SELECT o_orderkey AS run_id, o_orderpriority AS suite_name,
         'ci/' || o_custkey || '.xml' AS source_file,
         CASE WHEN o_orderkey % 7 <> 0 THEN date_trunc('month', o_orderdate)::TIMESTAMP END AS run_timestamp,
         o_orderdate AS ingested_at,
         COALESCE(CASE WHEN o_orderkey % 7 <> 0 THEN date_trunc('month', o_orderdate)::TIMESTAMP END,
                  o_orderdate) AS effective_ts
  FROM orders)"""


def cases(t: Tables) -> DataFrame:
    li = t.spread("lineitem")
    status = (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "failed")
        .when((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 10), "error")
        .when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "skipped")
        .otherwise("passed")
    )
    bad = status.isin("failed", "error")
    name = F.concat(F.lit("test_"), _text(F.col("l_partkey") % 100))
    return li.select(
        (((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 100000 + F.col("l_partkey")) * 10000
         + F.col("l_suppkey")).alias("case_id"),
        F.col("l_orderkey").alias("run_id"),
        F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("pkg.mod_"), _text(F.col("l_suppkey") % 20))).alias("classname"),
        name.alias("name"),
        F.when(F.col("l_partkey") % 3 != 0,
               F.concat(F.lit("src/m"), _text(F.col("l_partkey") % 10), F.lit("/t.py"))).alias("file_path"),
        status.alias("status"),
        F.col("l_quantity").alias("duration_ms"),
        F.when(bad, F.concat(F.lit("expected "), _text(F.col("l_linenumber")), F.lit(" but got "),
                             _text(F.col("l_suppkey") % 7))).alias("failure_message"),
        F.when(bad, F.when(status == "error", "RuntimeError").otherwise("AssertionError")).alias("failure_type"),
        F.when(bad, F.concat(F.lit("at step "), _text(F.col("l_suppkey")), F.lit(" of "), name)).alias("stack_trace"),
    )


CASES = """
v_cases AS (
  SELECT b.*,
    CASE WHEN status IN ('failed','error') THEN 'expected ' || l_linenumber || ' but got ' || (l_suppkey % 7) END AS failure_message,
    CASE status WHEN 'failed' THEN 'AssertionError' WHEN 'error' THEN 'RuntimeError' END AS failure_type,
    CASE WHEN status IN ('failed','error') THEN 'at step ' || l_suppkey || ' of ' || name END AS stack_trace
  FROM (
    SELECT ((l_orderkey*8 + l_linenumber)*100000 + l_partkey)*10000 + l_suppkey AS case_id,
      l_orderkey AS run_id, l_linenumber, l_suppkey,
      CASE WHEN l_suppkey % 5 <> 0 THEN 'pkg.mod_' || (l_suppkey % 20) END AS classname,
      'test_' || (l_partkey % 100) AS name,
      CASE WHEN l_partkey % 3 <> 0 THEN 'src/m' || (l_partkey % 10) || '/t.py' END AS file_path,
      CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'failed'
           WHEN l_returnflag = 'R' AND l_quantity < 10 THEN 'error'
           WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'skipped' ELSE 'passed' END AS status,
      l_quantity AS duration_ms
    FROM lineitem) b)"""


def log_events(t: Tables) -> DataFrame:
    """One log line per event; the line order inside a log is (ts, event_id)."""
    line = F.concat_ws(
        " ",
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("ERROR step "), F.get_json_object("props", "$.k"), F.lit(" failed")))
        .otherwise(F.col("event_type")),
        F.concat(F.lit("user="), _text(F.col("user_id"))),
        F.when(F.col("event_type") != "view", F.concat(F.lit("value="), _text(F.floor("value")))),
    )
    return t.spread("events").select(
        F.concat(F.lit("log"), _text(F.col("user_id"))).alias("log_id"),
        F.concat(F.lit("p"), _text(F.col("user_id") % 5)).alias("project"),
        "ts", "event_id", line.alias("line"),
    )


def log_lines(t: Tables) -> DataFrame:
    return lines.number_lines(log_events(t), "ts", "event_id")


LOG_LINES = """
v_lines AS (
  SELECT 'log' || user_id AS log_id, 'p' || (user_id % 5) AS project,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no,
    concat_ws(' ', strftime(ts, '%Y-%m-%dT%H:%M:%S'),
      CASE WHEN event_type = 'error' THEN 'ERROR step ' || json_extract_string(props, '$.k') || ' failed' ELSE event_type END,
      'user=' || user_id,
      CASE WHEN event_type <> 'view' THEN 'value=' || CAST(floor(value) AS BIGINT) END) AS line
  FROM events)"""


def incidents(t: Tables) -> DataFrame:
    d = t.spread("documents")
    updated = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")), "yyyy-MM-dd'T'00:00:00")
    return d.select(
        F.concat(F.lit("INC-"), _text(F.col("doc_id"))).alias("key"),
        F.substring("text", 1, 120).alias("summary"),
        F.col("source").alias("status"),
        F.lit("").alias("root_cause"),
        F.concat(F.lit("Dana "), F.initcap("source")).alias("reporter"),
        F.lit("").alias("assignee"),
        F.lit("2024-01-01T00:00:00").alias("created"),
        updated.alias("updated"),
        F.col("text").alias("body"),
        "doc_id",
    )


INCIDENTS = """
v_incidents AS (
  SELECT 'INC-' || doc_id AS key, substring(text, 1, 120) AS summary, source AS status, '' AS root_cause,
    'Dana ' || upper(source[1]) || lower(source[2:]) AS reporter, '' AS assignee,
    '2024-01-01T00:00:00' AS created,
    strftime(DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER), '%Y-%m-%dT00:00:00') AS updated,
    text AS body, doc_id
  FROM documents)"""


_INDEXES: dict[tuple, object] = {}


def _index(t: Tables, name: str, build):
    """The stored index over a view: made by the first query of an application that needs it, read by all others."""
    key = (t.spark.sparkContext.applicationId, t.path, name)
    if key not in _INDEXES:
        _INDEXES[key] = build()
    return _INDEXES[key]


def incident_index(t: Tables) -> text_index.TextIndex:
    return _index(t, "incidents", lambda: I.index_incidents(incidents(t)))


def document_index(t: Tables) -> text_index.TextIndex:
    return _index(t, "documents", lambda: text_index.build(t.spread("documents"), ["text"]))


def literal_index(t: Tables) -> literals.LiteralIndex:
    return _index(t, "literals", lambda: literals.build(cases(t), H.TEXT_COLUMNS))


def history_rollups(t: Tables) -> rollups.Rollups:
    return _index(t, "rollups", lambda: rollups.build(cases(t), runs(t)))


def search_queries(t: Tables) -> DataFrame:
    return t("benchmark").select(F.col("item_id").alias("query_id"), "text")


def evidence(t: Tables) -> DataFrame:
    return t.spread("documents").select(
        F.concat_ws("/", "source", _text(F.col("doc_id"))).alias("path"), "source", "doc_id", "text"
    )


def burnin(t: Tables) -> DataFrame:
    return t("events").select(
        F.concat(F.lit("u"), _text(F.col("user_id"))).alias("test_id"),
        F.date_format("ts", "yyyy-MM-dd").alias("phase"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("exit_code"),
        F.col("value").alias("duration_s"),
        (F.col("value") > 100).alias("timed_out"),
        F.col("event_id").alias("position"),
    )


BURNIN = """
v_burnin AS (
  SELECT 'u' || user_id AS test_id, strftime(ts, '%Y-%m-%d') AS phase,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS exit_code, value AS duration_s,
    value > 100 AS timed_out, event_id AS position
  FROM events)"""
