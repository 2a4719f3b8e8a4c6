"""Stable fingerprints: failure signatures, shapes, recipe signatures."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# What varies between two runs of one failure, most specific first.
VOLATILE = (
    (r"(?U)\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?", "<TS>"),
    (r"(?U)\b\d{2}:\d{2}:\d{2}(?:[.,]\d+)?\b", "<TS>"),
    (r"(?U)\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<UUID>"),
    (r"(?U)\b0x[0-9a-fA-F]+\b", "<ADDR>"),
    (r"(?U)\b[0-9a-fA-F]{7,}\b", "<HEX>"),
    (r"(?U)(?:/tmp|/var/folders|/var/tmp|/private/var/folders)/[^\s:'\"]+", "<TMP>"),
    (r"(?iU)\b(?:line|offset|byte)\s+\d+\b", "<POS>"),
    (r"(?U):\d+:\d+\b", ":<POS>"),
    (r"(?U):\d+\b", ":<POS>"),
    (r"(?U)\b\d+\b", "<N>"),
)
# Words found in nearly every failure log.
COMMON_FAILURE_WORDS = (
    "error", "errors", "errored", "fail", "fails", "failed", "failing", "failure", "failures",
    "exception", "exceptions",
)
MAX_FUZZY_TOKENS = 12
HEX_TOKEN = r"(?U)\b(?=[0-9a-fA-F]*[a-fA-F])(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{3,}\b"
PART_KEYS = ("framework", "error_class", "failing_action", "selector_shape", "message_shape")
RELAXED_KEYS = ("framework", "error_class", "failing_action")


def normalize_failure(text: Column) -> Column:
    for pattern, token in VOLATILE:
        text = F.regexp_replace(text, pattern, token)
    text = F.regexp_replace(F.regexp_replace(text, r"[ \t]+", " "), r"\n{2,}", "\n")
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def failure_signature(normalized: Column) -> Column:
    """SHA-1 of normalised text; null when nothing is left (such logs would all collide)."""
    return F.when(normalized != "", F.sha1(normalized.cast("binary")))


def _words(normalized: Column) -> Column:
    return F.transform(F.regexp_extract_all(normalized, F.lit(r"[A-Za-z][A-Za-z0-9_]{2,}"), F.lit(0)), F.lower)


def fuzzy_tokens(normalized: Column) -> Column:
    """The first twelve distinct telling words."""
    telling = F.filter(_words(normalized), lambda w: ~w.isin(*COMMON_FAILURE_WORDS))
    return F.slice(F.array_distinct(telling), 1, MAX_FUZZY_TOKENS)


def sample_tokens(normalized: Column) -> Column:
    return F.array_distinct(_words(normalized))


def shape(text: Column) -> Column:
    """Ids and numbers out: ``#btn-1f9c`` becomes ``#btn-<h>``."""
    out = F.regexp_replace(F.coalesce(text, F.lit("")), HEX_TOKEN, "<h>")
    out = F.regexp_replace(F.regexp_replace(out, r"(?U)\d+", "<n>"), r"(?U)\s+", " ")
    return F.trim(out)


def message_shape(message: Column, limit: int = 200) -> Column:
    first = F.regexp_extract(F.regexp_replace(F.coalesce(message, F.lit("")), r"(?U)^\s+", ""), r"^[^\r\n\x0b\x0c\x1c-\x1e\x85\u2028\u2029]*", 0)
    return F.substring(shape(first), 1, limit)


def is_degenerate(*parts: Column) -> Column:
    """No letter or digit is left once placeholders are dropped."""
    text = F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    return ~F.regexp_replace(text, "<n>|<h>|<uuid>|<id>", "").rlike(r"[\p{L}\p{N}]")


def _json_object(fields: dict[str, Column]) -> Column:
    """A JSON object with sorted keys and ``", "`` / ``": "`` separators, as text."""
    pieces: list[Column] = []
    for i, name in enumerate(sorted(fields)):
        pieces.append(F.lit(("{" if i == 0 else ", ") + json.dumps(name) + ": "))
        # to_json of a one-field struct quotes and escapes the value.
        quoted = F.to_json(F.struct(F.coalesce(fields[name], F.lit("")).alias("v")))
        pieces.append(F.substring(quoted, F.lit(6), F.length(quoted) - 6))
    return F.concat(*pieces, F.lit("}"))


def recipe_signature(parts: dict[str, Column]) -> Column:
    return F.sha2(_json_object({k: parts[k] for k in PART_KEYS}), 256)


def relaxed_key(parts: dict[str, Column]) -> Column:
    return F.sha2(_json_object({k: parts[k] for k in RELAXED_KEYS}), 256)
