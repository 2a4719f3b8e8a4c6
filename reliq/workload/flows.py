"""Queries over imports, ledgers, exports, masks and evidence texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from reliq.functions import secrets
from reliq.operators import evidence, incidents, stability
from reliq.operators.search import materialize
from reliq.plans import scan, stabilize
from reliq.session import run_dir
from reliq.sources import tables
from reliq.workload import history as H
from reliq.workload.evidence import FOUND, MASKED, redact_sql
from reliq.workload.registry import query


@query("import_rows", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE lang END AS lang, md5(text) AS text FROM documents")
def _(t):
    docs = t("documents").select("doc_id", "lang", "text")
    target = docs.filter("doc_id % 3 = 0").withColumn("lang", F.lit("kept"))
    merged = target.unionByName(tables.import_rows(docs.unionByName(docs), target, ["doc_id"]))
    return merged.withColumn("text", F.md5("text"))


@query("import_report", """SELECT 'documents' AS "table", count(*) AS rows FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'notes', count(*) FROM labels""")
def _(t):
    root = f"{run_dir(t.spark)}/import-{uuid.uuid4().hex}"
    old, new = tables.Store(t.spark, f"{root}/old"), tables.Store(t.spark, f"{root}/new")
    old.replace("docs", t("documents"))
    old.append("labels", t("labels"), "1")
    new.replace("documents", t("documents").filter("doc_id % 3 = 0"))
    return tables.import_tables(old, new, {"docs": ("documents", ["doc_id"]), "labels": ("notes", []), "absent": ("absent", [])}, "old")


@query("scan_export", H.VERDICTS + """
SELECT kind, count(*) AS n FROM (SELECT 'verdicts' AS kind FROM v_verdicts UNION ALL SELECT 'scan' UNION ALL SELECT 'changes' FROM v_verdicts WHERE status = 'flaky') GROUP BY kind""")
def _(t):
    path = f"{run_dir(t.spark)}/export-{uuid.uuid4().hex}"
    found = H.scanned(t)
    changes = found.filter("status = 'flaky'").select("test_key", F.lit("newly_flaky").alias("change"))
    scan.export_document(found, changes, {"window_days": H.WINDOW_DAYS}, path)
    lines = t.spark.read.text(path).select(F.get(F.json_object_keys("value"), 0).alias("kind"))
    return lines.groupBy("kind").agg(F.count("*").alias("n"))


@query("ledger_safe", f"SELECT doc_id AS failure_id, {redact_sql('text')} AS evidence_text FROM documents")
def _(t):
    return stabilize.ledger(t("documents").select(F.col("doc_id").alias("failure_id"), F.col("text").alias("evidence_text")))


@query("evidence_texts", """SELECT doc_id AS failure_id, CASE WHEN doc_id % 12 = 7 THEN 'CI failure (no further evidence collected)' ELSE concat_ws(chr(10),
 CASE WHEN doc_id % 2 = 0 THEN 'CI triage: category=' || lang || ' (heuristic, confidence 0.5)' END, CASE WHEN doc_id % 3 = 0 THEN 'evidence: ' || text END,
 CASE WHEN doc_id % 12 <> 7 AND doc_id % 5 > 0 THEN 'Failing test: t' || doc_id END,
 CASE WHEN doc_id % 4 > 0 AND doc_id % 12 <> 7 THEN 'History: ' || (doc_id % 4) || ' failure(s) over 9 run(s); last at None' END,
 CASE WHEN doc_id % 12 <> 7 THEN 'CI log: ' || source END) END AS evidence_text FROM documents""")
def _(t):
    doc = F.col("doc_id")
    bare = doc % 12 == 7
    rows = t("documents").select(
        doc.alias("failure_id"), F.when(doc % 2 == 0, F.col("lang")).alias("triage_category"), F.lit("heuristic").alias("classification_method"), F.lit(0.5).alias("confidence"),
        F.when(doc % 3 == 0, F.col("text")).alias("evidence"), F.when(~bare & (doc % 5 > 0), F.concat(F.lit("t"), doc.cast("string"))).alias("test_id"),
        F.when(~bare, doc % 4).alias("failure_count"), F.lit(9).alias("total_runs"), F.lit(None).cast("string").alias("last_failure_at"),
        F.when(~bare, F.concat(F.lit("a/b/"), F.col("source"))).alias("log_id"))
    return rows.select("failure_id", stability.evidence_text(rows).alias("evidence_text"))


@query("egress_flags", f"""SELECT doc_id, doc_id % 4 = 1 AS egress_fired, md5(CASE WHEN doc_id % 4 = 1 THEN text || ' mail a***@e****.com' ELSE text END) AS note FROM ({MASKED})""")
def _(t):
    """All documents are masked, an address slips into some of them, and the second pass finds what is left."""
    once = evidence.mask_pii(t.spread("documents").select("doc_id", "text"), "doc_id")
    slipped = F.when(F.col("doc_id") % 4 == 1, F.concat("text", F.lit(" mail ann@ex.com"))).otherwise(F.col("text"))
    sent = materialize(once.select("doc_id", slipped.alias("note")), "sent")
    again = evidence.mask_pii(sent, "doc_id", "note")
    return incidents.egress_check(sent, again, "doc_id", "note").select("doc_id", "egress_fired", F.md5("note").alias("note"))


@query("masked_maps", """SELECT doc_id, '***' AS secret, CASE WHEN doc_id % 2 = 0 THEN '***' ELSE lang END AS odd, source AS plain FROM documents""")
def _(t):
    lang = F.col("lang")
    values = F.create_map(F.lit("api_key"), F.col("text"), F.when(F.col("doc_id") % 2 == 0, "Password2").otherwise("passage"), lang, F.lit("source"), F.col("source"))
    masked = t("documents").select("doc_id", secrets.mask_map(values).alias("m"))
    return masked.select("doc_id", F.col("m")["api_key"].alias("secret"), F.coalesce(F.col("m")["Password2"], F.col("m")["passage"]).alias("odd"), F.col("m")["source"].alias("plain"))


_VALUES = {
    "email": "ann@example.com", "credit_card": "4111 1111 1111 1111", "iban": "GB82 WEST 1234 5698 7654 32", "spanish_dni_nie": "12345678Z",
    "phone": "+34 600 123 456", "us_ssn": "123-45-6789", "us_itin": "912-70-1234", "passport": "AB123456",
}
_KINDS = "[" + ", ".join(f"'{k}'" for k in _VALUES) + "][doc_id % 8 + 1]"
_RAWS = "[" + ", ".join(f"'{v}'" for v in _VALUES.values()) + "][doc_id % 8 + 1]"


@query("pii_all_types", f"""WITH {FOUND}
SELECT doc_id, type, start, "end" FROM found
UNION ALL SELECT doc_id, {_KINDS}, length(COALESCE(text, '')) + 11, length(COALESCE(text, '')) + 11 + length({_RAWS}) FROM documents""")
def _(t):
    """Whole documents, each with a value of one of the eight kinds at its end."""
    raw = F.element_at(F.array(*[F.lit(v) for v in _VALUES.values()]), (F.col("doc_id") % 8 + 1).cast("int"))
    text = F.concat(F.coalesce("text", F.lit("")), F.lit("\npassport: "), raw)
    return evidence.findings(t.spread("documents").select("doc_id", text.alias("text")), key="doc_id").select("doc_id", "type", "start", "end")
