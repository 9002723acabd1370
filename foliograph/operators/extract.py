"""Pattern extraction of entities with checksum validation.

`extract` runs all families in one Arrow function; the families that SQL can express are
also column expressions (`*_sql`), which the queries and their oracles use.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.constants import BASE36, CLASSES, CURRENCIES, ENTITY_CAP, VIN_VALUES, VIN_WEIGHTS

ENTITY = T.StructType([
    T.StructField("label", T.StringType()), T.StructField("value", T.StringType()), T.StructField("entity_type", T.StringType()),
    T.StructField("canonical_id", T.StringType()), T.StructField("class", T.StringType()), T.StructField("subclass", T.StringType()),
    T.StructField("canonical_short_name", T.StringType()), T.StructField("confidence", T.FloatType()),
])
ENTITIES = T.ArrayType(ENTITY)

#: The shapes of the entity families.
MONTH = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
DATES = re.compile(
    r"\b(?:\d{4}-\d{2}-\d{2}(?:T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?)?|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}"
    rf"|\d{{1,2}}\s+{MONTH}\.?\s+\d{{4}}|{MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}})\b"
)
EMAIL = re.compile(r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b")
PHONE = re.compile(r"(?:\+\d{1,3}[\s\-.]?\(?\d{1,4}\)?[\s\-.]?\d{3,5}[\s\-.]?\d{4,7}|\(?\d{3}\)?[\s\-.]\d{3}[\s\-.]\d{4})")
AMOUNT = re.compile(r"(?P<sym>[$₹€£¥])\s*(?P<num1>[\d,]+(?:\.\d{1,2})?)|\b(?P<num2>[\d,]+(?:\.\d{1,2})?)\s*(?P<code>USD|INR|EUR|GBP|JPY)\b")
URL = re.compile(r"https?://[^\s<>]{3,}")
WEAK = re.compile(r"(?:policy|folio|account|receipt|invoice|plot)\s*(?:number|no\.?|#)?\s*[:.\-]?\s*([A-Z0-9][A-Z0-9\-]{3,19})", re.I)
AADHAAR = re.compile(r"\b\d{4}\s?\d{4}\s?\d{4}\b")
IBAN = re.compile(r"\b[A-Z]{2}\d{2}[A-Z0-9\s]{4,32}\b")
CARD = re.compile(r"\b(?:\d{4}[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{1,4}|\d{4}[\s\-]?\d{6}[\s\-]?\d{5})\b")
PAN = re.compile(r"\b[A-Z]{5}[0-9]{4}[A-Z]\b")
SSN = re.compile(r"\b\d{3}-\d{2}-\d{4}\b")
NINO = re.compile(r"\b[A-CEGHJ-PR-TW-Z]{2}\d{6}[A-D]\b")
SIN = re.compile(r"\b\d{3}[\s\-]?\d{3}[\s\-]?\d{3}\b")
VIN = re.compile(r"\b[A-HJ-NPR-Z0-9]{17}\b")
GSTIN = re.compile(r"\b\d{2}[A-Z]{5}\d{4}[A-Z][A-Z0-9]Z[A-Z0-9]\b")

#: Words near card numbers, and prefixes of card issuers (first and last, by their number of digits).
CARD_WORDS = ("card", "visa", "mastercard", "amex", "credit")
CARD_PREFIXES = ((4, 4), (51, 55), (2221, 2720), (34, 34), (37, 37), (65, 65), (6011, 6011), (644000, 649999))

#: Lengths of the account numbers (IBAN) of countries.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22,
    "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28,
    "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24,
    "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


# --- checksums ---------------------------------------------------------------

def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) if n % 2 else int(d) for n, d in enumerate(reversed(digits)))
    return bool(digits) and sum(doubled) % 10 == 0


def _dihedral(a: int, b: int) -> int:
    """Product in the dihedral group of order ten, on which the Verhoeff check rests."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
    return 5 + (a - b) % 5 if b < 5 else (a - b) % 5


def verhoeff(digits: str) -> bool:
    step = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
    check = 0
    for place, d in enumerate(reversed(digits)):
        d = int(d)
        for _ in range(place % 8):
            d = step[d]
        check = _dihedral(check, d)
    return check == 0


def valid_aadhaar(value: str) -> bool:
    digits = re.sub(r"\s", "", value)
    return len(digits) == 12 and digits.isdigit() and verhoeff(digits)


def valid_iban(value: str) -> bool:
    compact = re.sub(r"\s", "", value)
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", compact) or IBAN_LENGTHS.get(compact[:2], len(compact)) != len(compact):
        return False
    return int("".join(str(BASE36.index(c)) for c in compact[4:] + compact[:4])) % 97 == 1


def known_card_prefix(digits: str) -> bool:
    return any(a <= int(digits[: len(str(a))]) <= b for a, b in CARD_PREFIXES)


def valid_card(digits: str, around: str = "") -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits) and (known_card_prefix(digits) or any(w in around.lower() for w in CARD_WORDS))


def valid_ssn(value: str) -> bool:
    area, group, serial = value.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def valid_nino(value: str) -> bool:
    return bool(re.fullmatch(r"[A-Z]{2}[0-9]{6}[A-D]", value)) and not set(value[:2]) & set("DFIQUV")


def valid_sin(value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    return len(digits) == 9 and luhn(digits)


def valid_vin(value: str) -> bool:
    if not re.fullmatch("[A-HJ-NPR-Z0-9]{17}", value):
        return False
    total = sum(w * (int(c) if c.isdigit() else VIN_VALUES[c]) for w, c in zip(VIN_WEIGHTS, value, strict=True))
    return value[8] == ("X" if total % 11 == 10 else str(total % 11))


def valid_gstin(value: str) -> bool:
    if not re.fullmatch(r"[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][A-Z0-9]Z[A-Z0-9]", value):
        return False
    total = sum(sum(divmod(BASE36.index(c) * (1 + n % 2), 36)) for n, c in enumerate(value[:14]))
    return value[14] == BASE36[-total % 36]


# --- one text ----------------------------------------------------------------

DATE_SHAPES = ("%Y-%m-%d", "%m/%d/%Y", "%d-%m-%Y", "%d %b %Y", "%d %B %Y", "%b %d %Y", "%B %d %Y")


def parse_date(raw: str) -> str | None:
    """YYYY-MM-DD of a date in one of the known shapes; null if there is no such day."""
    plain = re.sub(r"[.,]", "", raw.split("T")[0] if raw[:4].isdigit() else raw)
    plain = re.sub(r"\s+", " ", plain).replace("Sept ", "Sep ")
    for shape in DATE_SHAPES:
        try:
            return datetime.strptime(plain, shape).strftime("%Y-%m-%d")
        except ValueError:
            continue
    return None


def _entity(value: str, kind: str, label: str | None = None, cls: str | None = None, subclass: str | None = None, confidence: float = 1.0) -> dict:
    return {
        "label": label if label is not None else kind.capitalize(), "value": value, "entity_type": kind, "canonical_id": None,
        "class": cls, "subclass": subclass, "canonical_short_name": None, "confidence": confidence,
    }


def _identifier(value: str, subclass: str, confidence: float = 1.0) -> dict:
    return _entity(value, "identifier", "Identifier", "Identifier", subclass, confidence)


#: Marks without which a family has no match: at least so many digits, and one of these strings.
_SYMBOLS = tuple(CURRENCIES)
_DIGIT = re.compile(r"\d")
_PLAIN = (
    (AADHAAR, "aadhaar", valid_aadhaar, 12), (IBAN, "iban", valid_iban, 2), (CARD, "credit_card", None, 13), (PAN, "pan", lambda v: True, 4), (SSN, "ssn", valid_ssn, 9),
    (NINO, "nino", valid_nino, 6), (SIN, "sin", valid_sin, 9), (VIN, "vin", valid_vin, 0), (GSTIN, "gstin", valid_gstin, 6),
)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CAPITALS = re.compile("[A-Z0-9]{9}")
_WEAK_CUES = re.compile("policy|folio|account|receipt|invoice|plot", re.I)


def find_emails(text: str) -> Iterator[re.Match]:
    """The matches of `EMAIL`, from each at-sign to the left: linear where a search from the left is quadratic."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        word = lambda k: 0 <= k < len(text) and (text[k].isalnum() or text[k] == "_")
        while start < at and word(start - 1) == word(start):
            start += 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            yield found
            last = found.end()
        at = text.find("@", max(at + 1, last))


def _families(text: str) -> Iterator[dict]:
    digits = sum(1 for _ in islice(_DIGIT.finditer(text), 13))
    for m in DATES.finditer(text) if digits >= 5 else ():
        if day := parse_date(m.group()):
            yield _entity(day, "date", m.group(), "Date")
    for m in find_emails(text):
        yield _entity(m.group(), "email", cls="Email")
    for m in PHONE.finditer(text) if digits >= 9 else ():
        if len(m.group().strip().encode()) >= 7:
            yield _entity(m.group().strip(), "phone", cls="Phone")
    for m in AMOUNT.finditer(text) if any(mark in text for mark in _SYMBOLS) else ():
        sym = m["sym"]
        value = f"{sym}{m['num1']}" if sym else f"{m['num2']} {m['code']}"
        yield _entity(value, "amount", cls="Amount", subclass=CURRENCIES[sym or m["code"]])
    for m in URL.finditer(text) if "http" in text else ():
        yield _entity(m.group(), "url", subclass="url")
    capitals = bool(_CAPITALS.search(text))
    for pattern, subclass, valid, least in _PLAIN:
        if digits < least or (pattern in (PAN, NINO, VIN, GSTIN) and not capitals):
            continue
        for m in pattern.finditer(text):
            value = m.group().strip()
            if valid is None:
                around = text[max(0, m.start() - 40) : m.end() + 40]
                good = valid_card(re.sub(r"\D", "", value), around)
            else:
                good = valid(value)
            if good:
                yield _identifier(value, subclass)
    for m in WEAK.finditer(text) if _WEAK_CUES.search(text) else ():
        yield _identifier(m.group(1).upper(), "unknown", 0.7)


def sort_dedup_cap(entities: list[dict], cap: int = ENTITY_CAP) -> list[dict]:
    """By (type, value), the first of equal ones, at most `cap`."""
    out = {}
    for e in sorted(entities, key=lambda e: (e["entity_type"], e["value"])):
        out.setdefault((e["entity_type"], e["value"]), e)
    return list(out.values())[:cap]


def extract_text(text: str | None) -> list[dict]:
    return sort_dedup_cap(list(_families(text or "")))


def extract(docs: DataFrame, text: str = "text", out: str = "extracted_entities", failed: str | None = None) -> DataFrame:
    """`docs` with their entities; text goes to Python in Arrow batches, once.

    With `failed` a document on which extraction fails has null entities and that column true; without it
    the failure ends the job.
    """

    @F.pandas_udf(ENTITIES)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(extract_text if failed is None else _or_none)

    done = docs.withColumn(out, run(F.col(text)))
    return done if failed is None else done.withColumn(failed, F.col(out).isNull())


def _or_none(text: str | None) -> list[dict] | None:
    try:
        return extract_text(text)
    except Exception:  # one document's failure is not another's
        return None


# --- families as expressions -------------------------------------------------

def emails_sql(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,})"), F.lit(1))))


def phones_sql(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4})"), F.lit(1))))


def urls_sql(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(https?://[^ \t\r\n<>]{3,})"), F.lit(1))))


def iso_dates_sql(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(r"([0-9]{4}-[0-9]{2}-[0-9]{2})"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(found, lambda d: F.try_to_date(d, "yyyy-MM-dd").isNotNull())))


def amounts_sql(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"([$€£¥₹][0-9,]+(?:\.[0-9]{1,2})?)"), F.lit(1))))


def cards_sql(text: Column) -> Column:
    """Runs of 13 to 16 digits, bare or in groups of four, that pass Luhn and have a known prefix."""
    found = F.regexp_extract_all(text, F.lit(r"([0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,4})"), F.lit(1))
    digits = F.transform(found, lambda v: F.regexp_replace(v, "[ -]", ""))
    two, four = (lambda v: F.left(v, F.lit(2)).cast("int")), (lambda v: F.left(v, F.lit(4)).cast("int"))
    known = lambda v: v.startswith("4") | two(v).between(51, 55) | four(v).between(2221, 2720) | two(v).isin(34, 37, 65) | (four(v) == 6011) | F.left(v, F.lit(6)).cast("int").between(644000, 649999)
    return F.array_sort(F.array_distinct(F.filter(digits, lambda v: F.call_function("luhn_check", v) & known(v))))


def weak_ids_sql(text: Column) -> Column:
    pattern = r"(?i)(?:policy|folio|account|receipt|invoice|plot)\s*(?:number|no\.?|#)?\s*[:.\-]?\s*([A-Z0-9][A-Z0-9\-]{3,19})"
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.upper)))


def persons_sql(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z])([A-Z][a-z]+ [A-Z][a-z]+)"), F.lit(1))))


def legacy_entities(text: Column, cap: int = ENTITY_CAP) -> Column:
    """The older extractor: raw dates, amounts, e-mails and capitalised pairs, by (type, value), capped."""
    month = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*"
    shapes = {
        "date": ("Date", rf"\b([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2,4}}|{month}\.?\s+[0-9]{{1,2}},?\s+[0-9]{{4}})\b"),
        "amount": ("Amount", r"((?:USD\s*)?[$£€]\s*[0-9,]+(?:\.[0-9]{2})?|[0-9,]+(?:\.[0-9]{2})?\s*(?:USD|EUR|GBP))"),
        "email": ("Email", r"\b([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b"),
        "person": ("Person/Org", r"\b([A-Z][a-z]+\s+[A-Z][a-z]+)\b"),
    }
    def found(kind: str, label: str, shape: str) -> Column:
        matches = F.regexp_extract_all(text, F.lit(shape), F.lit(1))
        return F.transform(matches, lambda v: F.struct(F.lit(kind).alias("entity_type"), v.alias("value"), F.lit(label).alias("label")))

    parts = [found(kind, label, shape) for kind, (label, shape) in shapes.items()]
    return F.slice(F.array_sort(F.array_distinct(F.concat(*parts))), 1, cap)


def merge_passes(first: list[dict], refined: list[dict], additions: list[dict], cap: int = ENTITY_CAP) -> list[dict]:
    """Pattern entities with a model's class, subclass and confidence by their names `e_N`, then its own, sorted and capped.

    Label, value and type of a pattern entity stay.  Values of e-mail shape are e-mails whatever the model
    says; names out of range and classes that are not known change nothing.
    """
    out = [dict(e) for e in first]
    for r in refined:
        number = re.fullmatch("e_([0-9]+)", r.get("pass1_id") or "")
        if not number or int(number[1]) >= len(out) or r.get("class") not in CLASSES:
            continue
        e = out[int(number[1])]
        if r["class"] != "Email" and looks_like_email(e["value"]):
            e |= {"class": "Email", "entity_type": "email", "subclass": None}
        else:
            e |= {"class": r["class"], "subclass": r.get("subclass")}
        e["confidence"] = r.get("confidence")
    for a in additions:
        if a.get("class") in CLASSES and a.get("value"):
            cls = "Email" if looks_like_email(a["value"]) else a["class"]
            out.append(_entity(a["value"], cls.lower(), a["value"], cls, a.get("subclass"), a.get("confidence")))
    return sort_dedup_cap(out, cap)


def looks_like_email(value: str) -> bool:
    return bool(re.fullmatch(r"[^@\s]+@[^@\s]+\.[A-Za-z]{2,}", value.strip()))
