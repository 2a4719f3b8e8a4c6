"""Queries for small text and time rules, and for history looked up from log lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliq.functions import signatures as S
from reliq.functions import text as X
from reliq.functions import times
from reliq.operators import logs, text_index
from reliq.plans import stabilize as plan
from reliq.workload import history as H
from reliq.workload import views
from reliq.workload.registry import query
from reliq.workload.views import CASES, INCIDENTS, LOG_LINES, RUNS


@query("parsed_times", """SELECT event_id, CASE event_id % 5 WHEN 4 THEN NULL ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS at FROM events""")
def _(t):
    ts = F.col("ts")
    forms = [F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSS"), F.date_format(ts, "yyyyMMdd'T'HHmmss"),
             F.concat(F.date_format(ts + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+02:00")), F.date_format(ts, "MM/dd/yyyy")]
    text = F.element_at(F.array(*forms), (F.col("event_id") % 5 + 1).cast("int"))
    return t.spread("events").select("event_id", times.iso(times.parse_ts(text)).alias("at"))


@query("source_datetimes", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y/%m/%d %H:%M') ELSE strftime(ts, '%Y/%m/%d 00:00') END AS at FROM events""")
def _(t):
    text = F.when(F.col("event_id") % 2 == 0, times.iso(F.col("ts"))).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    return t("events").select("event_id", times.source_datetime(text).alias("at"))


@query("safe_labels", r"SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9._-]', '-', 'g'), 30) AS label FROM pages")
def _(t):
    return t("pages").select("page_id", X.safe_label(F.col("url"), 30).alias("label"))


@query("test_keys", f"""WITH {CASES} SELECT case_id, COALESCE(classname, file_path, '') || '::' || name AS test_key FROM v_cases""")
def _(t):
    return views.cases(t).select("case_id", X.test_key(F.col("classname"), F.col("name"), F.col("file_path")).alias("test_key"))


@query("telling_words", f"""WITH {LOG_LINES} SELECT log_id, line_no, array_to_string(list_sort(list_distinct(list_filter(list_transform(
  regexp_extract_all(regexp_replace(line, '^\\S+ ', ''), '[A-Za-z][A-Za-z0-9_]{{2,}}'), lambda x: lower(x)), lambda x: x NOT IN ('error', 'failed')))), ' ') AS words FROM v_lines""")
def _(t):
    return views.log_lines(t).select("log_id", "line_no", F.array_join(F.sort_array(S.fuzzy_tokens(S.normalize_failure(F.col("line")))), " ").alias("words"))


@query("log_statistics", f"""WITH {LOG_LINES} SELECT log_id, count(*) AS original_lines, CAST(sum(strlen(line)) + count(*) - 1 AS BIGINT) AS original_bytes, count(*) FILTER (WHERE contains(line, 'ERROR')) AS hit_count
FROM v_lines GROUP BY log_id""")
def _(t):
    li = views.log_lines(t)
    return logs.log_stats(li.withColumn("raw_line", F.col("line")).withColumn("hit", F.contains("line", F.lit("ERROR"))))


@query("history_enrichment", f"""WITH {RUNS}, {CASES}, {H._TERMS},
q AS (SELECT DISTINCT l_linenumber AS a, l_suppkey % 7 AS b FROM lineitem),
m AS (SELECT a, b, c.* FROM q JOIN terms ON contains(hay, ' expected ') AND contains(hay, ' ' || a || ' ') AND contains(hay, ' but ') AND contains(hay, ' got ') AND contains(hay, ' ' || b || ' ')
  JOIN v_cases c USING (case_id, run_id))
SELECT a || '-' || b AS log_id, 'expected ' || a || ' but got ' || b AS signal, count(DISTINCT struct_pack(c := classname, n := name)) AS matched_tests, count(DISTINCT run_id) AS total_runs,
 count(DISTINCT CASE WHEN status IN ('failed', 'error') THEN run_id END) AS failure_count FROM m GROUP BY a, b""")
def _(t):
    a, b = F.col("l_linenumber").cast("string"), (F.col("l_suppkey") % 7).cast("string")
    triaged = t("lineitem").select(F.concat_ws("-", a, b).alias("log_id"), F.concat(F.lit("\n  expected "), a, F.lit(" but got "), b, F.lit("\nnext")).alias("excerpt")).distinct()
    return plan.history_enrichment(triaged, views.cases(t))


@query("incident_status_counts", f"""WITH {INCIDENTS} SELECT (SELECT count(*) FROM v_incidents) AS incidents, (SELECT count(*) FROM labels) AS links, max(updated) AS watermark FROM v_incidents""")
def _(t):
    n = views.incidents(t).agg(F.count("*").alias("incidents"), F.max("updated").alias("watermark"))
    both = n.unionByName(t("labels").agg(F.count("*").alias("links")), allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in ("incidents", "links", "watermark")])


@query("overlap_scores", """WITH a AS (SELECT doc_id, list_distinct(list_filter(list_transform(regexp_extract_all(left(text, length(text) // 2), '[\\p{L}\\p{N}_]+'), lambda x: lower(x)), lambda x: length(x) > 2)) AS q,
  list_distinct(list_transform(regexp_extract_all(substring(text, length(text) // 2 + 1), '[\\p{L}\\p{N}_]+'), lambda x: lower(x))) AS d FROM documents)
SELECT doc_id, CASE WHEN len(q) = 0 THEN 0::DOUBLE ELSE round(len(list_intersect(q, d)) / len(q), 6) END AS score FROM a""")
def _(t):
    half = F.floor(F.char_length("text") / 2).cast("int")
    q = X.long_word_set(F.substring("text", F.lit(1), half))
    d = X.long_word_set(F.substring("text", half + 1, F.char_length("text")))
    return t.spread("documents").select("doc_id", F.round(X.overlap_ratio(q, d), 6).alias("score"))


@query("index_integrity", """SELECT doc_id FROM documents WHERE doc_id % 9 = 4 AND regexp_matches(text, '[\\p{L}\\p{N}]')""")
def _(t):
    # an index that lost documents: all are added, some removed by a later batch
    index = text_index.build(t.spread("documents"), ["text"])
    index.remove(t("documents").filter("doc_id % 9 = 4").select("doc_id"), 2)
    return index.gaps(t("documents").filter(F.col("text").rlike(r"[\p{L}\p{N}]")).select("doc_id"))
