"""Rule-based failure categories."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliq.functions.text import bind, strip

DEFAULT_CATEGORY = "broken_test"
RULE_CONFIDENCE, DEFAULT_CONFIDENCE, UNKNOWN_CONFIDENCE = 0.3, 0.1, 0.5
EVIDENCE_CHARS = 400


@dataclass(frozen=True)
class Category:
    key: str
    priority: int  # lower is tried first
    rule: str | None


# Category keys, their order of trial and their patterns.
CATEGORIES: tuple[Category, ...] = (
    Category("flaky", 10, (
        r"\bflak(?:y|e|iness)\b|\bintermittent\b|pass(?:ed|es)? (?:on|after) (?:\d+ |the )?retr(?:y|ies)\b"
        r"|succeed(?:ed|s)? (?:on|after) (?:\d+ )?retr(?:y|ies)\b|race condition")),
    Category("timeout", 20, r"timed out|timeouterror|deadline exceeded|\btimeout\b|exceeded the (?:time|timeout)"),
    Category("infra", 30, (
        r"no space left on device|oomkilled|out of memory|cannot allocate memory|connection (?:refused|reset)"
        r"|could not resolve host|network is unreachable|\b5\d\d\b.*(?:gateway|server|service)|rate limit"
        r"|too many requests|runner (?:lost|disconnect|terminated)|error pulling image|manifest unknown|docker(?:d)?: ")),
    Category("environment", 40, (
        r"modulenotfounderror|no module named|importerror|cannot find module|command not found"
        r"|no such file or directory.*(?:/bin/|\.exe\b|\bbinary\b)|(?:/bin/|\.exe\b|\bbinary\b).*no such file or directory"
        r"|version `?\S+'? not found|incompatible version|unsupported version|permission denied"
        r"|could not find a version that satisfies|enoent|\bglibc\b|\.so(?:\.\d+)*: cannot open")),
    Category("data", 50, (
        r"jsondecodeerror|fixture|seed data|schema (?:mismatch|validation|error)|migration|malformed"
        r"|could not (?:parse|deserialize|decode)|unexpected (?:eof|token)|invalid (?:json|yaml|csv|payload)")),
    Category("broken_test", 60, (
        r"assertionerror|assert\b|\d+ failed\b|FAILED \S|expected .* (?:but|to)|test failure|<failure")),
)
CATEGORY_KEYS = tuple(c.key for c in CATEGORIES)


def check_categories(categories) -> tuple[Category, ...]:
    """Rules in order of trial; a repeated key or priority is refused."""
    if len({c.key for c in categories}) != len(categories):
        raise ValueError("duplicate category key")
    if len({c.priority for c in categories}) != len(categories):
        raise ValueError("duplicate category priority")
    return tuple(sorted((c for c in categories if c.rule), key=lambda c: c.priority))


def classify(text: Column, categories=CATEGORIES) -> Column:
    """Struct of category, confidence, evidence line and method; the first rule that fires wins.

    ``.`` stays inside a line, so the evidence is the whole first line with a hit.
    """
    rules = check_categories(categories)
    first = F.lit(len(rules))
    for n in reversed(range(len(rules))):
        first = F.when(text.rlike(f"(?iUd)(?:{rules[n].rule})"), F.lit(n)).otherwise(first)

    def answer(fired: Column) -> Column:
        category, evidence = F.lit(DEFAULT_CATEGORY), F.lit(None).cast("string")
        for n in reversed(range(len(rules))):
            line = F.regexp_extract(text, f"(?imUd)^.*?(?:{rules[n].rule}).*$", 0)
            category = F.when(fired == n, F.lit(rules[n].key)).otherwise(category)
            evidence = F.when(fired == n, F.substring(strip(line), 1, EVIDENCE_CHARS)).otherwise(evidence)
        confidence = F.when(fired < len(rules), F.lit(RULE_CONFIDENCE)).otherwise(F.lit(DEFAULT_CONFIDENCE))
        return F.struct(category.alias("category"), confidence.alias("confidence"), evidence.alias("evidence"), F.lit("heuristic").alias("method"))

    return bind(first, answer)
