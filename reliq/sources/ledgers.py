"""Append-only ledgers with declared columns; a batch id written again replaces its own rows only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliq.sources.tables import Store

#: Per ledger: column, type, and the value of a missing or null field.
LEDGERS = {
    "healer_runs": (
        ("ts", "timestamp_ntz", None), ("source", "string", None), ("build_id", "string", None), ("test_id", "string", None), ("diagnosis_json", "string", None),
        ("strategy", "string", None), ("result", "string", None), ("isolation", "string", None), ("duration_s", "double", None)),
    "audit": (("ts", "timestamp_ntz", None), ("event", "string", None), ("payload_json", "string", None)),
    "pipeline_runs": (
        ("ts", "timestamp_ntz", None), ("trigger", "string", "tool"), ("test_id", "string", None), ("project", "string", None), ("triage_category", "string", None),
        ("branch", "string", None), ("outcome", "string", ""), ("stage_results_json", "string", "{}"), ("duration_s", "double", None)),
    "links": (("created_at", "timestamp_ntz", None), ("session_id", "string", ""), ("incident_key", "string", ""), ("note", "string", "")),
}


def ledger_rows(ledger: str, rows: DataFrame, now) -> DataFrame:
    """``rows`` in the ledger's columns: missing ones filled, others left out, the time column set to ``now`` where it is null."""
    (stamp, kind, _), *rest = LEDGERS[ledger]
    time = F.lit(now).cast(kind)

    def field(name: str, kind: str, default):
        value = F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)
        return (value if default is None else F.coalesce(value, F.lit(default))).alias(name)

    first = F.coalesce(F.col(stamp).cast(kind), time) if stamp in rows.columns else time
    return rows.select(first.alias(stamp), *[field(*x) for x in rest])


def record(store: Store, ledger: str, rows: DataFrame, batch_id: str, now) -> None:
    store.append(ledger, ledger_rows(ledger, rows, now), batch_id)
