"""Secret scrubbing of log text, and URL and key-name masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliq.functions.text import bind

PLACEHOLDER = "<REDACTED>"
MASK = "***"

# Well-known credential shapes, and labels whose value is a secret.
PRIVATE_KEY = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|\z)"
TOKEN_SHAPES = (
    r"\bgh[pousr]_[A-Za-z0-9]{20,}|\bgithub_pat_[A-Za-z0-9_]{20,}|\bAKIA[0-9A-Z]{16}\b"
    r"|\bxox[abprs]-[A-Za-z0-9-]{10,}|\bAIza[0-9A-Za-z_\-]{30,}|\bsk-[A-Za-z0-9_\-]{16,}"
    r"|\beyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+|\bAT[A-Z]TT[A-Za-z0-9_\-=.]{8,}"
    r"|\bBearer\s+[A-Za-z0-9._\-]{10,}"
)
SECRET_LABELS = r"password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|authorization|credential"
ASSIGNMENT = (
    r"(?i)((?:" + SECRET_LABELS + r")[A-Za-z0-9_\-]*[\"']?\s*[:=]\s*)[\"']?(?:Bearer\s+)?[^\s\"',;<]{4,}[\"']?"
)
URL_CREDENTIALS = r"(?i)\b([a-z][a-z0-9+.\-]*://)[^/\s:@]+:[^/\s:@]+@"
SENSITIVE_KEY = r"(?i)password|passwd|pwd|secret|token|api[_-]?key|authorization|credential|private[_-]?key"


def _if_has(text: Column, piece: str, pattern: str, token: str) -> Column:
    # A plain substring test is far cheaper than the pattern it guards.
    return bind(text, lambda x: F.when(F.contains(x, F.lit(piece)), F.regexp_replace(x, pattern, token)).otherwise(x))


def scrub(text: Column, placeholder: str = PLACEHOLDER) -> Column:
    text = _if_has(text, "PRIVATE KEY-----", PRIVATE_KEY, placeholder)
    text = _if_has(text, "://", URL_CREDENTIALS, "$1" + placeholder + "@")
    text = F.regexp_replace(text, TOKEN_SHAPES, placeholder)
    return F.regexp_replace(text, ASSIGNMENT, "$1" + placeholder)


def mask_map(values: Column) -> Column:
    """A string map with sensitive keys masked whole and every other value scrubbed."""
    return F.transform_values(values, lambda k, v: F.when(k.rlike(SENSITIVE_KEY), F.lit(MASK)).otherwise(scrub(v, MASK)))


def safe_url(url: Column) -> Column:
    """Scheme and host (and port) only: paths and queries may carry secrets."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^:/?#@]+)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^:/?#@]+)(:\d+)?(?:[/?#]|$)", 1)
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, port)).otherwise(F.lit("[redacted-url]"))
