"""PII detectors as column expressions: patterns, checks, masked previews."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Private-use characters that fence a match inside its text.
FENCE = "\ue000"
FENCE_STAND_IN = "\ue001"

# Detector patterns, check letters and number ranges.
EMAIL_BODY = r"[\w.%+\-]{1,64}@[\w.\-]{1,255}\."
EMAIL = r"(?U)" + EMAIL_BODY + r"[A-Za-z]{2,24}"
CARD = r"(?U)(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
IBAN = r"(?U)\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]){11,30}\b"
DNI = r"(?U)\b(?:[XYZxyz]\d{7}|\d{8})[A-Za-z]\b"
SSN = r"(?U)(?<!\d)\d{3}[- ]\d{2}[- ]\d{4}(?!\d)"
PHONE = r"(?U)(?<![\w+])\+?\d[\d ()\-]{6,17}\d(?![\w:])"
PASSPORT = r"(?U)\b(?=[A-Z0-9]*[0-9])[A-Z0-9]{6,9}\b"
PASSPORT_WORD = r"(?iU)passport|pasaporte"
PASSPORT_WINDOW = 30
DATE_START = r"(?U)^(?:\d{4}-\d{2}-\d{2}|\d{2}-\d{2}-\d{4})"
DNI_LETTERS = "TRWAGMYFPDXBNJZSQVHLCKE"


def digits(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\D", "")


def _card_ok(raw: Column) -> Column:
    d = F.regexp_replace(raw, "[ -]", "")
    return F.length(d).between(13, 19) & F.call_function("luhn_check", d)


def _iban_ok(raw: Column) -> Column:
    s = F.upper(F.replace(raw, F.lit(" "), F.lit("")))
    turned = F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda acc, c: F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97)
        .when(c != "", (acc * 100 + F.ascii(c) - 55) % 97)
        .otherwise(acc),
    )
    return s.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9]{11,30}$") & (rest == 1)


def _dni_ok(raw: Column) -> Column:
    s = F.upper(raw)
    number = F.expr("try_cast(translate(substring(upper(raw), 1, 8), 'XYZ', '012') AS int)")
    letter = F.substring(F.lit(DNI_LETTERS), (number % 23 + 1).cast("int"), F.lit(1))
    return number.isNotNull() & (F.substring(s, 9, 1) == letter)


def _part(raw: Column, start: int, n: int) -> Column:
    return F.try_to_number(F.substring(raw, start, n), F.lit("9" * n)).cast("int")


def _ssn_ok(raw: Column) -> Column:
    area, group, serial = _part(raw, 1, 3), _part(raw, 5, 2), _part(raw, 8, 4)
    return ~area.isin(0, 666) & (area < 900) & (group != 0) & (serial != 0)


def _itin_ok(raw: Column) -> Column:
    area, group, serial = _part(raw, 1, 3), _part(raw, 5, 2), _part(raw, 8, 4)
    ranges = group.between(50, 65) | group.between(70, 88) | group.between(90, 92) | group.between(94, 99)
    return (area >= 900) & ranges & (serial != 0)


def _phone_ok(raw: Column) -> Column:
    d = digits(raw)
    n = F.length(d)
    national = n.between(9, 11) & (n != F.length(raw))
    varied = F.replace(d, F.substring(d, 1, 1), F.lit("")) != ""
    return ~raw.rlike(DATE_START) & F.when(F.startswith(raw, F.lit("+")), n.between(8, 15)).otherwise(national) & varied


def _always(raw: Column) -> Column:
    return F.lit(True)


def _keep_tail(raw: Column, keep: int) -> Column:
    n = F.length(raw)
    return F.when(n <= keep, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.repeat(F.lit("*"), n - keep), F.right(raw, F.lit(keep))))


def _mask_last4(raw: Column) -> Column:
    # A digit with four more digits after it becomes a star; separators stay.
    return F.regexp_replace(raw, r"(?U)\d(?=(?:\D*\d){4})", "*")


def _mask_card(raw: Column) -> Column:
    return _keep_tail(digits(raw), 4)


def _mask_iban(raw: Column) -> Column:
    s = F.replace(raw, F.lit(" "), F.lit(""))
    n = F.length(s)
    return F.when(n <= 6, F.repeat(F.lit("*"), n)).otherwise(
        F.concat(F.substring(s, 1, 2), F.repeat(F.lit("*"), n - 6), F.right(s, F.lit(4))))


def _mask_email(raw: Column) -> Column:
    return F.regexp_replace(raw, r"^(.?)[^@]*@(.?).*\.([^.]*)$", "$1***@$2****.$3")


@dataclass(frozen=True)
class Detector:
    """``every_start``: a failed check resumes one character later, so a valid
    value inside an invalid longer one is found. Otherwise matches are judged as
    they come, left to right."""

    name: str
    priority: int  # lower wins an overlap
    pattern: str
    gate: str  # cheap test that a text can hold a match at all
    valid: Callable[[Column], Column]
    mask: Callable[[Column], Column]
    every_start: bool = True


DETECTORS: tuple[Detector, ...] = (
    Detector("email", 6, EMAIL, "@", _always, _mask_email, every_start=False),
    Detector("credit_card", 0, CARD, r"(?U)(?:\d[ -]?){12}\d", _card_ok, _mask_card),
    Detector("iban", 1, IBAN, r"(?U)[A-Z]{2}\d{2}", _iban_ok, _mask_iban),
    Detector("spanish_dni_nie", 4, DNI, r"(?U)\d{7}[A-Za-z]", _dni_ok, lambda r: _keep_tail(r, 1)),
    Detector("phone", 7, PHONE, r"(?U)\d[\d ()\-]{6}", _phone_ok, _mask_last4, every_start=False),
    Detector("us_ssn", 2, SSN, r"(?U)\d{3}[- ]\d{2}[- ]\d{4}", _ssn_ok, _mask_last4),
    Detector("us_itin", 3, SSN, r"(?U)\d{3}[- ]\d{2}[- ]\d{4}", _itin_ok, _mask_last4),
    Detector("passport", 5, PASSPORT, PASSPORT_WORD, _always, lambda r: _keep_tail(r, 2), every_start=False),
)
DETECTOR_NAMES = tuple(d.name for d in DETECTORS)


def check_detectors(detectors) -> tuple[Detector, ...]:
    if len({d.name for d in detectors}) != len(detectors):
        raise ValueError("duplicate detector name")
    if len({d.priority for d in detectors}) != len(detectors):
        raise ValueError("duplicate detector priority")
    return tuple(detectors)


def fenced(text: Column, pattern: str, every_start: bool, gate: str) -> Column:
    """Segments of ``text``: odd ones are matches, even ones the text between them.

    With ``every_start`` each position where a match can begin is listed and the
    even segments alone make up the text.
    """
    flags_end = pattern.index(")") + 1
    flags, body = pattern[:flags_end], pattern[flags_end:]
    wrapped = f"{flags}(?=({body}))" if every_start else f"{flags}({body})"
    plain = F.translate(text, FENCE, FENCE_STAND_IN)
    marked = F.regexp_replace(plain, wrapped, f"{FENCE}$1{FENCE}")
    return F.when(text.rlike(gate), F.split(marked, FENCE, -1))
