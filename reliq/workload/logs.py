"""Queries over logs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reliq.functions import loglines as L
from reliq.functions import signatures as S
from reliq.functions import times
from reliq.operators import logs, triage
from reliq.plans import triage as plan
from reliq.session import run_dir
from reliq.sources.tables import Store
from reliq.streaming import ingest
from reliq.workload import views
from reliq.workload.registry import query
from reliq.workload.views import LOG_LINES, NOW

_HIT = r"""regexp_matches(line, '(?i)\b(fail(ed|ure|ing)?|error(s|ed)?)\b') OR regexp_matches(line, '\bERROR\b')"""


def _excerpt_sql(before=8, after=12, chars=12000, cap=200) -> str:
    note = L.TRUNCATION_NOTE
    return f"""
{LOG_LINES},
h AS (SELECT *, {_HIT} AS hit FROM v_lines),
st AS (SELECT log_id, any_value(project) AS project, count(*) AS original_lines, CAST(sum(strlen(line)) + count(*) - 1 AS BIGINT) AS original_bytes,
  count(*) FILTER (WHERE hit) AS hit_count FROM h GROUP BY log_id),
k AS (SELECT *, max(hit) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN {after} PRECEDING AND {before} FOLLOWING) AS keep FROM h),
kp AS (SELECT *, lag(line_no) OVER w AS pn, lag(line) OVER w AS pl FROM k WHERE keep WINDOW w AS (PARTITION BY log_id ORDER BY line_no)),
rr AS (SELECT *, sum(CASE WHEN pn IS NULL OR line_no <> pn + 1 OR pl <> line THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY line_no) AS run FROM kp),
rn AS (SELECT log_id, run, count(*) AS n, arg_min(line, line_no) AS line, min(line_no) - 1 - arg_min(pn, line_no) AS gap FROM rr GROUP BY ALL),
pt AS (SELECT log_id, run, list_concat(CASE WHEN gap > 0 THEN ['        ... (' || gap || ' lines omitted) ...'] ELSE [] END,
  CASE WHEN n >= 3 THEN [line, '        ⟪ previous line repeated ' || (n-1) || ' more times ⟫'] WHEN n = 2 THEN [line, line] ELSE [line] END) AS p FROM rn),
al AS (SELECT log_id, flatten(list(p ORDER BY run)) AS p FROM pt GROUP BY log_id),
tx AS (SELECT log_id, len(p) > {cap} AS cut, array_to_string(list_slice(p, greatest(1, len(p) - {cap} + 1), len(p)), chr(10)) AS x FROM al),
ty AS (SELECT log_id, cut, x, length(x) > {chars} AS lng, right(x, {chars}) AS r FROM tx),
ex AS (SELECT log_id, cut OR lng AS truncated, CASE WHEN lng THEN '{note}' || chr(10) ||
    CASE WHEN strpos(r, chr(10)) > 0 AND strpos(r, chr(10)) < length(r) THEN substring(r, strpos(r, chr(10)) + 1) ELSE r END
  WHEN cut THEN '{note}' || chr(10) || x ELSE x END AS excerpt FROM ty),
v_excerpts AS (SELECT st.log_id, project, excerpt, original_bytes, original_lines, hit_count, truncated, false AS low_signal,
  length(excerpt) - length(replace(excerpt, chr(10), '')) + 1 AS excerpt_lines, length(excerpt) AS excerpt_chars FROM st JOIN ex USING (log_id)
  WHERE hit_count > 0
  UNION ALL
  SELECT st.log_id, any_value(st.project), array_to_string(list(line ORDER BY line_no), chr(10)), any_value(original_bytes), any_value(original_lines),
    0, false, true, 0, 0 FROM st JOIN h USING (log_id) WHERE hit_count = 0 AND line_no >= original_lines - 60 GROUP BY st.log_id)"""


_COLS = "log_id, excerpt, original_bytes, original_lines, hit_count, truncated, low_signal, excerpt_lines, excerpt_chars"


@query("log_excerpts", f"WITH {_excerpt_sql()} SELECT {_COLS} FROM v_excerpts")
def _(t):
    return logs.log_excerpts(views.log_lines(t))


@query("log_excerpts_small_caps", f"WITH {_excerpt_sql(1, 2, 900, 30)} SELECT {_COLS} FROM v_excerpts")
def _(t):
    return logs.log_excerpts(views.log_lines(t), before=1, after=2, char_cap=900, line_cap=30)


@query("failure_windows", f"""WITH {_excerpt_sql(1, 2)}
SELECT log_id, count(*) AS kept_lines, count(*) FILTER (WHERE pn IS NULL OR line_no <> pn + 1) AS islands, count(*) FILTER (WHERE hit) AS hits FROM kp GROUP BY log_id""")
def _(t):
    c = logs.failure_context(views.log_lines(t), 1, 2)
    return c.groupBy("log_id").agg(F.count("*").alias("kept_lines"), F.count_if("island_start").alias("islands"), F.count_if("hit").alias("hits"))


@query("failure_lines", f"""WITH {LOG_LINES} SELECT log_id, line_no, {_HIT} AS failing,
 regexp_matches(line, '\\bFAIL(ED|URE)?\\b|\\b[A-Z][A-Za-z]+Error\\b|\\bError\\b|\\b[1-9]\\d* failed\\b') AS anchor FROM v_lines""")
def _(t):
    return views.log_lines(t).select("log_id", "line_no", L.is_failure_line(F.col("line")).alias("failing"), L.is_anchor_line(F.col("line")).alias("anchor"))


def _re(p: str) -> str:
    return p.replace("(?iU)", "(?i)").replace("(?U)", "").replace("'", "''")


def _norm_sql(col: str) -> str:
    out = col
    for p, r in S.VOLATILE:
        out = f"regexp_replace({out}, '{_re(p)}', '{r}', 'g')"
    return rf"trim(regexp_replace(regexp_replace({out}, '[ \t]+', ' ', 'g'), '\n{{2,}}', chr(10), 'g'), ' ' || chr(10) || chr(9))"


_TOK = "list_distinct(list_filter(list_transform(regexp_extract_all(n, '[A-Za-z][A-Za-z0-9_]{2,}'), lambda x: lower(x)), lambda x: NOT list_contains(%s, x)))" % str(list(S.COMMON_FAILURE_WORDS))
SIGNED = f"""{_excerpt_sql(1, 2, 900, 30)},
nx AS (SELECT *, {_norm_sql('excerpt')} AS n FROM v_excerpts),
v_signed AS (SELECT *, CASE WHEN n <> '' THEN sha1(n) END AS signature FROM nx)"""


@query("failure_signatures", f"WITH {SIGNED} SELECT log_id, project, signature FROM v_signed")
def _(t):
    return plan.signed_excerpts(views.log_lines(t), before=1, after=2, char_cap=900, line_cap=30).select("log_id", "project", "signature")


@query("line_signatures", f"""WITH {LOG_LINES}, n AS (SELECT project, {_norm_sql('line')} AS n FROM v_lines)
SELECT project, sha1(n) AS signature, count(*) AS occurrences, any_value(n) AS normalized FROM n WHERE n <> '' GROUP BY ALL""")
def _(t):
    n = views.log_lines(t).select("project", S.normalize_failure(F.col("line")).alias("normalized"))
    s = n.withColumn("signature", S.failure_signature(F.col("normalized"))).filter(F.col("signature").isNotNull())
    return s.groupBy("project", "signature").agg(F.count("*").alias("occurrences"), F.first("normalized").alias("normalized"))


@query("signal_lines", f"""WITH {_excerpt_sql(1, 2)}
SELECT log_id, arg_min(line, line_no) AS signal FROM (SELECT *, min(line_no) FILTER (WHERE hit) OVER (PARTITION BY log_id) AS f FROM h) WHERE f IS NULL OR hit GROUP BY log_id""")
def _(t):
    e = logs.log_excerpts(views.log_lines(t), before=1, after=2)
    return e.select("log_id", L.top_signal_line(F.col("excerpt")).alias("signal"))


_CTX, _CAP = 1, 600
BLOCKS = f"""
{LOG_LINES},
bh AS (SELECT *, regexp_matches(line, '\\bFAIL(ED|URE)?\\b|\\b[A-Z][A-Za-z]+Error\\b|\\bError\\b|\\b[1-9]\\d* failed\\b') AS hit FROM v_lines),
bs AS (SELECT log_id, count(*) AS n, CAST(sum(strlen(line)) + count(*) - 1 AS BIGINT) AS bytes_raw, count(*) FILTER (WHERE hit) AS anchor_count FROM bh GROUP BY log_id),
bk AS (SELECT *, max(hit) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN {_CTX} PRECEDING AND {_CTX} FOLLOWING) AS keep FROM bh),
bp AS (SELECT *, CASE WHEN coalesce(lag(line_no) OVER w, -9) <> line_no - 1 THEN line_no END AS s0 FROM bk WHERE keep WINDOW w AS (PARTITION BY log_id ORDER BY line_no)),
bb AS (SELECT *, max(s0) OVER (PARTITION BY log_id ORDER BY line_no) AS s FROM bp),
blk AS (SELECT log_id, s, '[lines ' || (s+1) || '-' || (max(line_no)+1) || ']' || chr(10) || string_agg(line, chr(10) ORDER BY line_no) AS body,
  sha256(string_agg(trim(regexp_replace(regexp_replace(line, '(?i)\\b[0-9a-f]{{6,}}\\b', '<h>', 'g'), '\\d+', '<n>', 'g')), chr(10) ORDER BY line_no)) AS dg FROM bb GROUP BY log_id, s),
bd AS (SELECT *, row_number() OVER (PARTITION BY log_id, dg ORDER BY s) AS copy FROM blk),
bu AS (SELECT *, strlen(body) + 2 AS size, row_number() OVER (PARTITION BY log_id ORDER BY s) AS i FROM bd WHERE copy = 1),
g AS (SELECT log_id, 0 AS i, 0 AS used, false AS keep FROM bs UNION ALL
  SELECT g.log_id, u.i, CASE WHEN used + size <= {_CAP} THEN used + size ELSE used END, used + size <= {_CAP} FROM g JOIN bu u ON u.log_id = g.log_id AND u.i = g.i + 1),
kb AS (SELECT bu.* FROM g JOIN bu USING (log_id, i) WHERE g.keep),
agg AS (SELECT bu.log_id, count(*) AS d, (SELECT count(*) FROM kb WHERE kb.log_id = bu.log_id) AS k FROM bu GROUP BY bu.log_id)"""


@query("log_blocks", f"""WITH RECURSIVE {BLOCKS},
cl AS (SELECT log_id, left(body, {_CAP - 2}) || chr(10) || '[... block truncated to fit size cap ...]' AS body FROM bu WHERE i = 1 AND size > {_CAP}),
res AS (SELECT bs.log_id, bytes_raw, anchor_count, CASE WHEN cl.body IS NULL THEN k ELSE 1 END AS blocks_kept, CASE WHEN cl.body IS NULL THEN d - k ELSE d END AS blocks_dropped_cap,
  (SELECT count(*) FROM bd WHERE bd.log_id = bs.log_id AND copy > 1) AS blocks_dropped_duplicate, cl.body AS clip
  FROM bs JOIN agg USING (log_id) LEFT JOIN cl USING (log_id)),
re2 AS (SELECT *, CASE WHEN blocks_dropped_cap > 0 THEN blocks_dropped_cap || ' additional failure block(s) omitted to stay under the size cap' ELSE '' END AS note FROM res)
SELECT * EXCLUDE (clip), strlen(text) AS bytes_filtered FROM (
  SELECT re2.*, concat_ws(chr(10) || chr(10), COALESCE(clip, (SELECT string_agg(body, chr(10) || chr(10) ORDER BY s) FROM kb WHERE kb.log_id = re2.log_id)),
    CASE WHEN note <> '' THEN '[... ' || note || ' ...]' END) AS text FROM re2)""")
def _(t):
    return logs.log_blocks(views.log_lines(t), context=_CTX, cap_bytes=_CAP)


RULES = """CASE WHEN regexp_matches(x, '(?i)\\bflak(?:y|e|iness)\\b|\\bintermittent\\b|race condition') THEN 'flaky'
  WHEN regexp_matches(x, '(?i)timed out|timeouterror|deadline exceeded|\\btimeout\\b') THEN 'timeout'
  WHEN regexp_matches(x, '(?i)rate limit|connection (refused|reset)|\\b5\\d\\d\\b.*(gateway|server|service)') THEN 'infra'
  WHEN regexp_matches(x, '(?i)command not found|permission denied|enoent') THEN 'environment'
  WHEN regexp_matches(x, '(?i)fixture|migration|malformed|invalid (json|yaml|csv|payload)') THEN 'data'
  ELSE 'broken_test' END"""
_PHRASE = """CASE event_id % 11 WHEN 0 THEN 'flaky run' WHEN 1 THEN 'request timed out' WHEN 2 THEN 'HTTP 503 bad gateway' WHEN 3 THEN 'bash: command not found'
  WHEN 4 THEN 'missing fixture file' WHEN 5 THEN 'AssertionError: expected 1 but got 2' WHEN 6 THEN 'flake8 clean' WHEN 7 THEN 'Invalid JSON payload'
  WHEN 8 THEN 'passed on retry with race condition' WHEN 9 THEN 'retry: connection refused' ELSE 'nothing special' END"""


@query("failure_categories", f"""WITH s AS (SELECT event_id, user_id || ' ' || {_PHRASE} AS x FROM events),
c AS (SELECT event_id, x, {RULES} AS category FROM s)
SELECT event_id, category, CASE WHEN category <> 'broken_test' OR regexp_matches(x, 'expected') THEN x END AS evidence,
  CASE WHEN category <> 'broken_test' OR regexp_matches(x, 'expected') THEN 0.3::DOUBLE ELSE 0.1::DOUBLE END AS confidence FROM c""")
def _(t):
    x = F.concat_ws(" ", F.col("user_id").cast("string"), F.expr(_PHRASE))
    e = t.spread("events").select("event_id", F.concat(F.lit("step"), F.lit(chr(10)), x, F.lit(chr(10)), F.lit("done")).alias("excerpt"))
    return triage.classify(e).select("event_id", "category", "evidence", "confidence")


def _observed(t):
    """One observation per log line: failing lines as tiny excerpts of their project."""
    n = views.log_events(t).filter(F.contains("line", F.lit("ERROR")))
    signed = triage.sign(n.withColumn("excerpt", F.regexp_replace("line", r"step (\d)", "step_$1 st")))
    return signed.select("project", "signature", F.lit("broken_test").alias("category"), "excerpt", F.col("ts").alias("seen_at"), "log_id", "event_id", "tokens")


_OBS = f"""
{LOG_LINES},
e0 AS (SELECT 'log' || user_id AS log_id, 'p' || (user_id % 5) AS project, ts, event_id, regexp_replace(
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ERROR step ' || json_extract_string(props, '$.k') || ' failed user=' || user_id || ' value=' || CAST(floor(value) AS BIGINT),
  'step (\\d)', 'step_\\1 st') AS excerpt FROM events WHERE event_type = 'error'),
obs AS (SELECT *, sha1({_norm_sql('excerpt')}) AS signature FROM e0)"""


@query("pattern_table", f"""WITH {_OBS}
SELECT project, signature, 'broken_test' AS category, count(*) AS occurrences, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_seen,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_seen, arg_max(excerpt, struct_pack(t := ts, l := log_id)) AS sample FROM obs GROUP BY ALL""")
def _(t):
    p = triage.record_patterns(None, _observed(t))
    return p.withColumn("first_seen", times.iso(F.col("first_seen"))).withColumn("last_seen", times.iso(F.col("last_seen")))


_CUT = "TIMESTAMP '2024-01-15'"


@query("pattern_upsert", f"""WITH {_OBS},
s AS (SELECT project, signature, count(*) AS n0 FROM obs WHERE ts < {_CUT} GROUP BY ALL)
SELECT project, signature, count(*) AS occurrences, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_seen, strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_seen FROM obs GROUP BY ALL""")
def _(t):
    o = _observed(t)
    cut = F.expr(f"timestamp_ntz'2024-01-15'")
    stored = triage.record_patterns(None, o.filter(F.col("seen_at") < cut))
    p = triage.record_patterns(stored, o.filter(F.col("seen_at") >= cut))
    return p.select("project", "signature", "occurrences", times.iso(F.col("first_seen")).alias("first_seen"), times.iso(F.col("last_seen")).alias("last_seen"))


@query("pattern_stream", f"""WITH {_OBS}
SELECT project, signature, 'broken_test' AS category, count(*) AS occurrences, strftime(min(ts), '%Y-%m-%dT%H:%M:%S') AS first_seen,
  strftime(max(ts), '%Y-%m-%dT%H:%M:%S') AS last_seen, arg_max(excerpt, struct_pack(t := ts, l := log_id)) AS sample FROM obs GROUP BY ALL""")
def _(t):
    """Observations land in two lots; the stream counts each into the stored table, and a replay of the first changes nothing."""
    o = _observed(t).select(F.col("project"), "signature", "category", "excerpt", F.col("seen_at").cast("timestamp_ntz").alias("seen_at"), "log_id")
    root = f"{run_dir(t.spark)}/patterns-{uuid.uuid4().hex}"
    store, schema = Store(t.spark, f"{root}/store"), "project string, signature string, category string, excerpt string, seen_at timestamp_ntz, log_id string"
    cut = F.expr(_CUT.replace("TIMESTAMP ", "timestamp_ntz"))
    for lot in (F.col("seen_at") < cut, F.col("seen_at") >= cut):
        o.filter(lot).write.mode("append").parquet(f"{root}/landed")
        ingest.stream_patterns(t.spark, f"{root}/landed", schema, store, f"{root}/checkpoint").awaitTermination()
    writer = next(iter(store.keyed("failure_patterns").manifest()["writers"]))
    ingest.count_patterns(store, o.filter(F.col("seen_at") < cut), writer, 0)
    p = store.read("failure_patterns")
    return p.withColumn("first_seen", times.iso(F.col("first_seen"))).withColumn("last_seen", times.iso(F.col("last_seen")))


@query("pattern_retention", f"""WITH {_OBS},
p AS (SELECT project, signature, max(ts) AS last_seen FROM obs GROUP BY ALL)
SELECT project, signature FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY last_seen DESC, signature) AS k FROM p
  WHERE last_seen >= TIMESTAMP '2024-01-30 12:00:00') WHERE k <= 3""")
def _(t):
    p = triage.record_patterns(None, _observed(t))
    return triage.prune_patterns(p, "2024-02-09T12:00:00", retention_days=10, max_per_project=3).select("project", "signature")


@query("prior_exact", f"""WITH {_OBS},
p AS (SELECT project, signature, count(*) AS n FROM obs WHERE ts < {_CUT} GROUP BY ALL)
SELECT event_id, n AS prior_occurrences FROM obs JOIN p USING (project, signature) WHERE ts >= {_CUT}""")
def _(t):
    o = _observed(t)
    cut = F.expr("timestamp_ntz'2024-01-15'")
    stored = triage.record_patterns(None, o.filter(F.col("seen_at") < cut))
    wanted = o.filter(F.col("seen_at") >= cut).select(F.col("event_id").alias("log_id"), "project", "signature", "tokens")
    out = triage.prior_patterns(wanted, stored)
    return out.filter(~F.col("fuzzy")).select(F.col("log_id").alias("event_id"), "prior_occurrences")


_TELLING = "list_filter(list_transform(regexp_extract_all(%s, '[A-Za-z][A-Za-z0-9_]{2,}'), lambda x: lower(x)), lambda x: NOT list_contains(" + str(list(S.COMMON_FAILURE_WORDS)) + ", x))"


@query("prior_fuzzy", rf"""WITH p AS (SELECT lang AS project, 'd' || doc_id AS signature, source AS category, doc_id % 7 AS occurrences,
  regexp_extract_all(lower(strip_accents(COALESCE(text, ''))), '[\p{{L}}\p{{N}}]+') AS toks,
  list_distinct(list_transform(regexp_extract_all({_norm_sql('text')}, '[A-Za-z][A-Za-z0-9_]{{2,}}'), lambda x: lower(x))) AS words FROM documents WHERE doc_id % 3 <> 1),
w0 AS (SELECT lang AS project, 'd' || doc_id AS wanted, {_TELLING % "text"} AS l FROM documents WHERE doc_id % 3 = 1),
w AS (SELECT project, wanted, list_filter(l, lambda x, i: list_position(l, x) = i)[1:12] AS tokens FROM w0),
stats AS (SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM p),
post AS (SELECT project, signature, len(toks) AS dl, token, count(*) AS tf FROM (SELECT *, unnest(toks) AS token FROM p) GROUP BY ALL),
dfs AS (SELECT token, count(*) AS df FROM post GROUP BY token),
terms AS (SELECT DISTINCT project, wanted, unnest(string_split(t, '_')) AS token FROM (SELECT *, unnest(tokens) AS t FROM w)),
scores AS (SELECT project, wanted, signature, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
  FROM terms JOIN post USING (project, token) JOIN dfs USING (token), stats GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY project, wanted ORDER BY score DESC, signature) AS k FROM scores),
near AS (SELECT r.project, r.wanted, r.signature, p.category, p.occurrences, k FROM ranked r JOIN w USING (project, wanted) JOIN p ON p.project = r.project AND p.signature = r.signature
  WHERE k <= 10 AND len(list_intersect(w.tokens, p.words)) >= least(2, len(w.tokens)))
SELECT project, wanted, arg_min(signature, k) AS signature, arg_min(category, k) AS category, arg_min(occurrences, k) AS occurrences FROM near GROUP BY project, wanted""")
def _(t):
    """Two thirds of the documents stand for stored patterns, the others for failures that ask for a similar one of their language."""
    docs = t.spread("documents").withColumn("signature", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    stored = docs.filter("doc_id % 3 <> 1").select(F.col("lang").alias("project"), "signature", F.col("source").alias("category"), (F.col("doc_id") % 7).alias("occurrences"), F.col("text").alias("sample"))
    asked = docs.filter("doc_id % 3 = 1").select(F.col("lang").alias("project"), F.col("signature").alias("wanted"), S.fuzzy_tokens(F.col("text")).alias("tokens"))
    return triage.similar_patterns(asked, stored)


@query("triage_logs")
def _(t):
    o = _observed(t)
    stored = triage.prune_patterns(triage.record_patterns(None, o), "2024-02-01")
    results, _learned = plan.triage_logs(views.log_lines(t), stored, NOW.replace(year=2024, month=2))
    return results
