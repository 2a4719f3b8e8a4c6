"""Predicates and cleaning for log lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# What marks a failure line. Two rule sets exist on purpose: one
# for triage excerpts, one for CI log blocks.
FAILURE_WORDS = (
    r"(?iU)\b(?:fail(?:ed|ure|ing)?|error(?:s|ed)?|exception|traceback \(most recent|panic(?::|\b)|fatal"
    r"|segfault|segmentation fault|timed out|timeout|deadline exceeded|killed|oomkilled|assertion failed"
    r"|no space left on device|connection (?:refused|reset)|could not resolve host)\b"
)
FAILURE_CLASSES = r"(?U)\b[A-Z][A-Za-z0-9_]*(?:Error|Exception|Warning)\b"
FAILURE_EXITS = (
    r"(?iU)(?:exit(?:ed)?(?: with)?(?: code| status)?|returned(?: non-zero exit status)?)[:=\s]+([1-9]\d*)\b"
)
FAILURE_MARKS = r"(?iU)(?:\b\d+ (?:failed|errors?)\b|<(?:failure|error)[\s>]|FAILED |✕|✗|×|npm ERR!)"
ANCHORS = (
    r"(?U)(\bFAIL(?:ED|URE)?\b|\b[A-Z][A-Za-z]+Error\b|\bError\b|Timeout \d+ms|✘|✗|×|\bTraceback\b"
    r"|exit code [1-9]\d*|##\[error\]|\b[1-9]\d* failed\b|\bexpect\()"
)
ANSI = r"\x1b\[[0-9;?]*[ -/]*[@-~]"
ANSI_SHORT = r"\x1b\[[0-9;]*[A-Za-z]"
CI_STAMP = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d+Z ?"
UNIVERSAL_NEWLINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

TRUNCATION_NOTE = "[pre-filter truncated — showing the most recent failure context; earlier matching regions were omitted]"
MARKER_LINE = (
    r"(?U)^\s*(?:\.\.\. \(\d+ lines omitted\) \.\.\.|⟪ previous line repeated \d+ more times? ⟫)\s*$"
)
SIGNAL_CHARS = 200


def is_failure_line(line: Column) -> Column:
    rules = (FAILURE_WORDS, FAILURE_CLASSES, FAILURE_EXITS, FAILURE_MARKS)
    return (line != "") & reduce(lambda a, b: a | b, [line.rlike(r) for r in rules])


def is_anchor_line(line: Column) -> Column:
    return line.rlike(ANCHORS)


def _if_escaped(line: Column, pattern: str) -> Column:
    # Most lines hold no escape byte; the regex runs only where one is.
    return F.when(F.contains(line, F.lit("\x1b")), F.regexp_replace(line, pattern, "")).otherwise(line)


def strip_ansi(line: Column) -> Column:
    return _if_escaped(line, ANSI)


def clean_ci_line(line: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(_if_escaped(line, ANSI_SHORT), CI_STAMP, ""), r"(?U)\s+$", "")


def omitted_marker(n: Column) -> Column:
    return F.concat(F.lit("        ... ("), n.cast("string"), F.lit(" lines omitted) ..."))


def repeat_marker(n: Column) -> Column:
    return F.concat(
        F.lit("        ⟪ previous line repeated "), n.cast("string"), F.lit(" more time"), F.when(n != 1, "s").otherwise(""), F.lit(" ⟫")
    )


def is_injected_line(line: Column) -> Column:
    """Lines the excerpt added itself; they are no evidence."""
    return F.startswith(F.ltrim(line), F.lit(TRUNCATION_NOTE)) | line.rlike(MARKER_LINE)


def top_signal_line(excerpt: Column) -> Column:
    """First real failure line of an excerpt, else its first non-blank line, 200 characters."""
    lines = F.filter(F.split(excerpt, "\n", -1), lambda x: ~is_injected_line(x))
    hit = F.get(F.filter(lines, is_failure_line), 0)
    plain = F.get(F.filter(lines, lambda x: x.rlike(r"(?U)\S")), 0)
    first = F.coalesce(hit, plain, F.lit(""))
    return F.substring(F.regexp_replace(first, r"(?U)^\s+|\s+$", ""), 1, SIGNAL_CHARS)


def cap_tail(text: Column, chars: int) -> Column:
    """Keep the last ``chars`` characters from a line start, under the note; shorter text as is."""
    tail = F.right(text, F.lit(chars))
    cut = F.locate("\n", tail)
    whole = F.when((cut > 0) & (cut < F.length(tail)), F.substring(tail, cut + 1, F.length(tail))).otherwise(tail)
    return F.when(F.length(text) > chars, F.concat(F.lit(TRUNCATION_NOTE + "\n"), whole)).otherwise(text)
