"""Text helpers: cleaning, keys, tokens."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

TRUNCATED = " …[truncated]"


def strip(text: Column) -> Column:
    """Strip any Unicode white space (Spark's trim takes spaces only)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_long(text: Column) -> Column:
    """``strip`` for long texts: few have white space at an end, and to look for it at every place of a text costs much more than to look there."""
    def ends(x: Column) -> Column:
        return F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1))

    return bind(text, lambda x: F.when(ends(x).rlike(r"(?U)\s"), strip(x)).otherwise(x))


def bind(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once, however often ``fn`` uses it.

    A chain of steps that each use their input several times would otherwise
    multiply the expression at every step.
    """
    return F.get(F.transform(F.array(value), fn), 0)


def clean(text: Column) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def truncate(text: Column, limit: int) -> Column:
    if limit <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit(TRUNCATED))).otherwise(text)


def test_key(classname: Column, name: Column, file_path: Column) -> Column:
    """``namespace::name``; the file stands in for a missing class."""
    space = F.coalesce(F.nullif(strip(classname), F.lit("")), strip(file_path), F.lit(""))
    return F.concat(space, F.lit("::"), F.coalesce(strip(name), F.lit("")))


def id_parts(test_id: Column) -> tuple[Column, Column]:
    """(left, right) of a test id, split on its last ``::``; left is null without one."""
    cut = F.length(F.substring_index(test_id, "::", -1))
    left = F.when(
        F.contains(test_id, F.lit("::")),
        strip(F.substring(test_id, F.lit(1), F.length(test_id) - cut - 2)),
    )
    right = F.when(F.contains(test_id, F.lit("::")), strip(F.substring_index(test_id, "::", -1))).otherwise(test_id)
    return left, right


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from Unicode decomposition."""
    src, dst = [], []
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code):
            src.append(chr(code))
            dst.append(base)
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def fold(text: Column) -> Column:
    """Lower case without accents on Latin letters, as the text index stores terms."""
    return F.lower(F.translate(text, _ACCENTED, _PLAIN))


def index_tokens(text: Column) -> Column:
    """Terms as the text index sees them: letters and digits only, ``_`` separates."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def word_tokens(text: Column) -> Column:
    """Word runs (``_`` is part of a word), lower case, in order, with repeats."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"(?U)\w+"), F.lit(0)), F.lower
    )


def long_word_set(text: Column) -> Column:
    """Distinct lower-case words of more than two characters."""
    return F.array_distinct(F.filter(word_tokens(text), lambda t: F.length(t) > 2))


def overlap_ratio(query_set: Column, candidate_set: Column) -> Column:
    """Share of the query's words that the candidate has; 0 for an empty side."""
    n = F.size(query_set)
    return F.when(n > 0, F.size(F.array_intersect(query_set, candidate_set)) / n).otherwise(F.lit(0.0))


def safe_label(text: Column, limit: int) -> Column:
    """An id as a label: other characters become ``-``, capped."""
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._-]", "-"), 1, limit)
