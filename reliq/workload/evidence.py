"""Queries over documents as evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from reliq.functions import redact, secrets
from reliq.operators import evidence
from reliq.workload import views
from reliq.workload.registry import query


def _sql_chain(col, rules):
    for p, r in rules:
        flags = "gi" if p.startswith("(?i") else "g"
        body = p.split(")", 1)[1] if p.startswith("(?") and p[2] in "iU" else p
        body = body.replace("'", "''").replace(r"\z", "$")
        col = f"regexp_replace({col}, '{body}', '{r.replace('$1', chr(92) + '1')}', '{flags}')"
    return col


# The phone rule needs no look-behind: word runs are cut off first, and each match is judged whole.
_EMAIL = r"regexp_extract_all(text, '[\p{L}\p{N}_.%+\-]{1,64}@[\p{L}\p{N}_.\-]{1,255}\.[A-Za-z]{2,24}')"


@query("pii_emails", f"""SELECT doc_id, len({_EMAIL}) AS n, array_to_string(list_transform({_EMAIL}, lambda e: left(e, 1) || '***@' || left(split_part(e, '@', 2), 1) || '****.' || regexp_extract(e, '[^.]*$')), ' ') AS previews
FROM documents WHERE len({_EMAIL}) > 0""")
def _(t):
    f = evidence.findings(views.evidence(t), "doc_id", types=["email"])
    return f.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "preview"))), lambda x: x["preview"]), " ").alias("previews"))


@query("evidence_gate", f"""WITH d AS (SELECT source, doc_id, len({_EMAIL}) = 0 AS clean, doc_id % 50 <> 7 AS complete FROM documents)
SELECT 'T' || source AS ticket_id, count(*) AS checked_paths, count(*) FILTER (WHERE NOT clean) AS dirty_paths,
 count(*) FILTER (WHERE NOT complete) AS incomplete_paths, 0 AS errors,
 count(*) FILTER (WHERE NOT clean OR NOT complete) = 0 AS ok FROM d GROUP BY source""")
def _(t):
    docs = views.evidence(t)
    hits = evidence.findings(docs, types=["email"]).groupBy("path").agg(F.count("*").alias("n"))
    scans = docs.join(hits, "path", "left").select("path", F.col("n").isNull().alias("clean"), (F.col("doc_id") % 50 != 7).alias("complete"))
    named = docs.select(F.concat(F.lit("T"), F.col("source")).alias("ticket_id"), "path")
    return evidence.gate(named.select("ticket_id").distinct(), named, scans)


_SCRUB = ((secrets.PRIVATE_KEY, "<REDACTED>"), (secrets.URL_CREDENTIALS, "$1<REDACTED>@"), (secrets.TOKEN_SHAPES, "<REDACTED>"), (secrets.ASSIGNMENT, "$1<REDACTED>"))


@query("scrub_secrets", f"SELECT doc_id, {_sql_chain('text', _SCRUB)} AS text FROM documents")
def _(t):
    return t.spread("documents").select("doc_id", secrets.scrub(F.col("text")).alias("text"))


def re2_rules() -> list[tuple[str, str]]:
    """The redaction rules as RE2 can run them: look-behind becomes a captured neighbour."""
    out = []
    for pattern, token in redact.RULES:
        body = pattern.replace(r"[\w.%+\-]", r"[\p{L}\p{N}_.%+\-]").replace(r"[\w.\-]", r"[\p{L}\p{N}_.\-]")
        if r"(?<![\w:.])" in body:
            body = body.replace(r"(?<![\w:.])", r"(^|[^\p{L}\p{N}_:.])").replace(r"(?![\w:.])", r"($|[^\p{L}\p{N}_:.])")
            token = r"\1" + token + r"\2"
        elif r"(?<![\w.])" in body:
            body = body.replace(r"(?<![\w.])", r"(^|[^\p{L}\p{N}_.])")
            token = r"\1" + token
        out.append((body, token))
    return out


def redact_sql(col: str) -> str:
    return _sql_chain(col, re2_rules())


@query("redact_documents", f"""SELECT doc_id, safe, safe <> text AS contains_pii, text FROM (SELECT doc_id, text, {redact_sql('text')} AS safe FROM documents)""")
def _(t):
    d = t.spread("documents").select("doc_id", redact.redact_text(F.col("text"), None).alias("safe"), "text")
    return d.select("doc_id", "safe", "text", (F.col("safe") != F.col("text")).alias("contains_pii"))


# The rules without look-around, as RE2 can run them; \\w is spelled out for Unicode.
_PLAIN = [r for i, r in enumerate(redact.RULES) if i in (0, 3, 4)]


@query("redact_labelled_secrets", f"SELECT doc_id, {_sql_chain('text', _PLAIN)} AS text FROM documents")
def _(t):
    text = F.col("text")
    for p, r in _PLAIN:
        text = F.regexp_replace(text, p, r)
    return t.spread("documents").select("doc_id", text.alias("text"))


@query("scrub_known_names", """SELECT conv_id, turn, CASE WHEN role = 'user' THEN regexp_replace(x, '\\bDana Scully\\b|\\bScully\\b|\\bDana\\b', '[redacted-name]', 'gi') ELSE x END AS note
FROM (SELECT conv_id, turn, role, 'seen by dana scully, then SCULLY and Dana: turn ' || turn AS x FROM conversations)""")
def _(t):
    x = F.concat(F.lit("seen by dana scully, then SCULLY and Dana: turn "), F.col("turn").cast("string"))
    who = F.when(F.col("role") == "user", "Dana Scully")
    return t("conversations").select("conv_id", "turn", redact.scrub_names(x, redact.known_names([who])).alias("note"))


@query("neutralize_turns", """SELECT conv_id, turn, regexp_replace(role || ': ' || text, '^([ \\t]*)(system|assistant|user|developer|human|ai|tool)([ \\t]*):', '\\1\\2\\3 -', 'gim') AS text FROM conversations""")
def _(t):
    return t("conversations").select("conv_id", "turn", redact.neutralize(F.concat_ws(": ", "role", "text")).alias("text"))


_GREEDY = """
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
g AS (SELECT doc_id, 0 AS k, 0 AS reach, false AS take FROM (SELECT DISTINCT doc_id FROM n)
  UNION ALL SELECT g.doc_id, n.k, CASE WHEN n.i >= reach THEN n.i + n.l ELSE reach END, n.i >= reach FROM g JOIN n ON n.doc_id = g.doc_id AND n.k = g.k + 1)
SELECT n.doc_id, n.i - 1 AS start, n.i - 1 + n.l AS "end", {preview} AS preview FROM n JOIN g USING (doc_id, k) WHERE g.take {where}"""


def _spans_sql(gate: str, first: str, before: str, lengths: str, shape: str, after: str, valid: str, preview: str, where: str = "") -> str:
    """Every position that can start a match, its longest match there, then left to right without overlap."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, text, string_split(text, '') AS ch FROM documents WHERE regexp_matches(text, '{gate}')),
p AS (SELECT doc_id, text, i FROM (SELECT doc_id, text, ch, unnest(range(1, len(ch) + 1)) AS i FROM d)
  WHERE regexp_matches(ch[i], '{first}') AND (i = 1 OR NOT regexp_matches(ch[i - 1], '{before}'))),
s AS (SELECT doc_id, i, substring(text, i, 40) AS x FROM p),
c AS (SELECT doc_id, i, x, unnest({lengths}) AS l FROM s),
m AS (SELECT doc_id, i, max(l) AS l, left(any_value(x), max(l)) AS raw FROM c
  WHERE l <= length(x) AND regexp_full_match(left(x, l), '{shape}') AND (length(x) = l OR NOT regexp_matches(substring(x, l + 1, 1), '{after}')) GROUP BY ALL HAVING {valid}),
""".replace("GROUP BY ALL", "GROUP BY doc_id, i") + _GREEDY.format(preview=preview, where=where)


_DIGITS = "regexp_replace(raw, '[^0-9]', '', 'g')"
_LUHN = ("list_sum(list_transform(range(0, length({d})), lambda j: CASE WHEN j % 2 = 0 THEN CAST(substring({d}, length({d}) - j, 1) AS INTEGER) "
         "ELSE (2 * CAST(substring({d}, length({d}) - j, 1) AS INTEGER)) // 10 + (2 * CAST(substring({d}, length({d}) - j, 1) AS INTEGER)) % 10 END)) % 10 = 0").format(d=_DIGITS)


def _positions(t, kind):
    return evidence.findings(views.evidence(t), "doc_id", types=[kind]).select("doc_id", "start", "end", "preview")


_CARDS = _spans_sql(
    r"([0-9][ -]?){12}[0-9]", "[0-9]", "[0-9]", "range(13, 38)", r"([0-9][ -]?){12,18}[0-9]", "[0-9]", _LUHN,
    f"repeat('*', length({_DIGITS}) - 4) || right({_DIGITS}, 4)")


@query("pii_cards", _CARDS)
def _(t):
    return _positions(t, "credit_card")


_PHONE_OK = (f"AND NOT regexp_matches(raw, '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}})') AND replace({_DIGITS}, left({_DIGITS}, 1), '') <> '' AND "
             f"CASE WHEN raw LIKE '+%' THEN length({_DIGITS}) BETWEEN 8 AND 15 ELSE length({_DIGITS}) BETWEEN 9 AND 11 AND length({_DIGITS}) <> length(raw) END")


_PHONES = _spans_sql(
    r"[0-9][0-9 ()\-]{6}", r"[0-9+]", r"[\p{L}\p{N}_+]", "range(8, 22)", r"\+?[0-9][0-9 ()\-]{6,17}[0-9]", r"[\p{L}\p{N}_:]", "true",
    """array_to_string(list_transform(range(1, length(raw) + 1), lambda j: CASE WHEN regexp_matches(substring(raw, j, 1), '[0-9]')
      AND length(regexp_replace(substring(raw, j + 1), '[^0-9]', '', 'g')) >= 4 THEN '*' ELSE substring(raw, j, 1) END), '')""", _PHONE_OK)
_EMAILS = _spans_sql(
    r"@[\p{L}\p{N}_.\-]+\.[A-Za-z]{2}", r"[\p{L}\p{N}_.%+\-]", r"[\p{L}\p{N}_.%+\-]", "range(6, 41)", r"[\p{L}\p{N}_.%+\-]{1,64}@[\p{L}\p{N}_.\-]{1,255}\.[A-Za-z]{2,24}", "^$", "true",
    "left(raw, 1) || '***@' || left(split_part(raw, '@', 2), 1) || '****.' || regexp_extract(raw, '[^.]*$')")
# All findings: the kinds the given documents hold (the others find nothing there; tests cover them).
FOUND = f"""found AS (SELECT *, 'credit_card' AS type FROM ({_CARDS}) UNION ALL SELECT *, 'phone' FROM ({_PHONES}) UNION ALL SELECT *, 'email' FROM ({_EMAILS}))"""


@query("pii_phones", _PHONES)
def _(t):
    return _positions(t, "phone")


@query("pii_findings", f"""WITH {FOUND} SELECT source || '/' || doc_id AS path, type, start, "end", preview,
 1 + length(left(text, start)) - length(replace(left(text, start), chr(10), '')) AS line FROM found JOIN documents USING (doc_id)""")
def _(t):
    return evidence.findings(views.evidence(t).select("path", "text")).drop("raw")


@query("pii_summary", f"""WITH {FOUND}, n AS (SELECT doc_id, count(*) AS n FROM found GROUP BY doc_id)
SELECT source, count(*) AS scanned_files, 0 AS skipped_files, CAST(COALESCE(sum(n), 0) AS BIGINT) AS findings, COALESCE(sum(n), 0) = 0 AS clean, true AS complete
FROM documents LEFT JOIN n USING (doc_id) GROUP BY source""")
def _(t):
    docs = views.evidence(t).withColumn("skip_reason", F.lit(None).cast("string")).withColumn("truncated", F.lit(False))
    return evidence.scan_summary(docs, evidence.findings(docs), "source")


@query("pii_by_type", f"WITH {FOUND} SELECT source, type, count(*) AS n FROM found JOIN documents USING (doc_id) GROUP BY ALL")
def _(t):
    docs = views.evidence(t)
    return evidence.findings_by_type(docs, evidence.findings(docs), "source")


MASKED = f"""WITH {FOUND}, o AS (SELECT *, lag("end", 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS f FROM found),
m AS (SELECT doc_id, string_agg(substring(text, f + 1, start - f) || preview, '' ORDER BY start) || substring(any_value(text), max("end") + 1) AS x
  FROM o JOIN documents USING (doc_id) GROUP BY doc_id)
SELECT doc_id, COALESCE(x, text) AS text, x IS NOT NULL AS masked FROM documents LEFT JOIN m USING (doc_id)"""


@query("pii_masked_documents", MASKED)
def _(t):
    return evidence.mask_pii(views.evidence(t).select("doc_id", "text"), "doc_id")
