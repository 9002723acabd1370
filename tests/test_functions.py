"""Golden values of text functions, checksums, filters and vectors."""

import random
import time

import pytest
from pyspark.sql import functions as F

from foliograph.functions import text as T
from foliograph.functions import vectors as V
from foliograph.operators import extract as X
from foliograph.operators import filters as L


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("check, good, bad", [
    (X.valid_aadhaar, ["234123412346"], ["234123412340", "23412341234", "2341234123461"]),
    (X.valid_iban, ["GB29 NWBK 6016 1331 9268 19", "GB29NWBK60161331926819"], ["GB29NWBK60161331926820", "GB29NWB"]),
    (X.valid_ssn, ["123-45-6789"], ["000-45-6789", "666-45-6789", "900-45-6789"]),
    (X.valid_nino, ["AB123456C", "SW123456A"], ["DA123456C", "QA123456C", "AB123456E", "AB123456Z"]),
    (X.valid_sin, ["046454286"], ["046454287"]),
    (X.valid_vin, ["1M8GDM9AXKP042788"], ["1M8GDM9AYKP042788", "1M8GDM9AXK"]),
    (X.valid_gstin, ["27AABCU9603R1ZN", "29GGGGG9999G1ZY"], ["27AABCU9603R1ZX", "29GGGGG9999G1ZA", "27AABCU9603R1AY"]),
])
def test_checksums(check, good, bad):
    assert all(map(check, good)) and not any(map(check, bad))


def test_card_needs_prefix_or_context():
    assert X.valid_card("4532015112830366") and not X.valid_card("4532015112830367")
    assert not X.valid_card("3800000000000006") and X.valid_card("3800000000000006", "credit card: ")


def test_extract_text():
    found = X.extract_text("Due 07/15/1985, paid $1,234.56 by a@b.com, Policy number: POL-2024-4531, on 3 Jul 2026 and 2024-01-15 or Jan 1, 2025; 500 USD")
    values = {(e["entity_type"], e["value"]) for e in found}
    assert {("date", "1985-07-15"), ("date", "2026-07-03"), ("date", "2024-01-15"), ("date", "2025-01-01"), ("amount", "$1,234.56"), ("amount", "500 USD"), ("email", "a@b.com"), ("identifier", "POL-2024-4531")} <= values
    assert X.extract_text("") == X.extract_text(None) == []
    assert len(X.extract_text(" ".join(f"u{n}@x.com" for n in range(30)))) == 20
    assert len(X.extract_text("2024-01-15 2024-01-15 2024-01-15")) == 1


def test_merge_keeps_emails():
    first = [{"value": "a@b.com", "entity_type": "email", "class": "Email", "subclass": None}]
    assert X.merge_passes(first, [{"pass1_id": "e_0", "class": "Person"}], [])[0]["class"] == "Email"


@pytest.mark.parametrize("value, cls, expected", [
    ("Acme Corp Ltd", "Organization", "Acme Corp"), ("Foo Pvt Ltd", "Organization", "Foo"), ("Alpha Beta Complex-Unit-204", "Location", "Unit 204"),
    ("Alpha-Beta-Complex-Unit-204", "Location", "Unit 204"), ("Building-P705", "Location", "P705"), ("Complex-Unit", "Location", None), ("Jane Q Doe", "Person", None), ("  Foo   Bar  ", "Person", "Foo Bar"),
])
def test_short_name(spark, value, cls, expected):
    assert one(spark, T.short_name(F.lit(value), F.lit(cls))) == expected


@pytest.mark.parametrize("tag, expected", [("Term Insurance", "term_insurance"), ("term-insurance", "term_insurance"), ("Investments 2024!", "investments_2024"), ("café", "caf"), ("-", "")])
def test_normalize_tag(spark, tag, expected):
    assert one(spark, T.normalize_tag(F.lit(tag))) == expected


def test_chunks(spark):
    spans = one(spark, T.chunks(F.lit("x" * 1200), 500, 50))
    assert [(c["start"], c["end"]) for c in spans] == [(0, 500), (450, 950), (900, 1200)]
    assert one(spark, T.chunks(F.lit(""), 500, 50)) == []


def test_excerpts():
    text = "The quick brown fox jumps over the lazy dog and the fox runs fast"
    assert {"fox", "jumps"} <= set(T.excerpt_of(text, "fox jumps", 5).split())
    assert T.excerpt_of("alpha beta gamma delta", "zeta", 3) == "alpha beta gamma" and T.excerpt_of("", "x") == "" and T.excerpt_of("one two three four", "", 3) == "one two three"


def test_query_filters(spark):
    f = one(spark, L.parse_entity_filter(F.lit("Invoices over $1,500 and under $2000 before 2024-01-01 after 2023-06-01")))
    assert (f["min_amount"], f["max_amount"], f["before_date"], f["after_date"]) == (1500.0, 2000.0, "2024-01-01", "2023-06-01")
    assert one(spark, L.parse_entity_filter(F.lit("hello"))) is None
    assert one(spark, L.is_placeholder_label(F.lit("Space 3"))) and not one(spark, L.is_placeholder_label(F.lit("Tax")))


def test_vectors(spark):
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, V.normalise(arr(3.0, 4.0))) == pytest.approx([0.6, 0.8])
    assert one(spark, V.normalise(arr(0.0, 0.0))) == [0.0, 0.0]
    assert one(spark, V.cosine(arr(0.0, 0.0), arr(1.0, 0.0))) == 0
    sets = lambda *v: F.array(*map(F.lit, v))
    assert one(spark, V.jaccard_distance(sets(*"abcde"), sets(*"abcd"))) == pytest.approx(0.2)
    assert one(spark, V.recency(F.lit(None).cast("timestamp"), F.current_timestamp())) == 0.5
    assert one(spark, V.related_score(F.lit(1.0), F.lit(1.0), F.lit(1.0))) == pytest.approx(1.0)


def test_model_reply(spark):
    reply = F.lit('<think>{"x"}</think>\n```json\n{"label": "Tax", "description": "d"}\n```')
    assert one(spark, T.parse_json_reply(reply, "label string, description string"))["label"] == "Tax"
    assert one(spark, T.parse_json_reply(F.lit("nothing"), "label string")) is None


def test_emails_as_by_the_pattern():
    """The search from the at-signs finds what the pattern finds from the left."""
    rng = random.Random(9)
    parts = ["a", "b.c", "@", ".", "org", "x@y.zz", " ", "-", "_", "%", "é", "+", "1", "@@", "..", ".co", "\n"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [m.span() for m in X.find_emails(text)] == [m.span() for m in X.EMAIL.finditer(text)], text
    began = time.perf_counter()
    assert not list(X.find_emails("a." * 200_000)) and time.perf_counter() - began < 1


def test_families_by_their_marks():
    """Leaving a family out where its marks are missing changes nothing."""
    rng = random.Random(10)
    parts = ["2024-01-15", "1 Jan 2024", "a@b.org", "+1 415 555 2671", "$5", "5 USD", "http://x.yy", "ABCDE1234F", "123-45-6789", "4111 1111 1111 1111", "policy no. ABCD", " ", ",", "word", "7", "AB123456C"]
    patterns = (X.DATES, X.EMAIL, X.PHONE, X.AMOUNT, X.URL, X.AADHAAR, X.IBAN, X.CARD, X.PAN, X.SSN, X.NINO, X.SIN, X.VIN, X.GSTIN, X.WEAK)
    for _ in range(3000):
        text = " ".join(rng.choices(parts, k=rng.randint(0, 8)))
        found = sum(1 for _ in X._families(text))
        assert found <= sum(1 for p in patterns for _ in p.finditer(text))
        assert (found == 0) <= (not X.DATES.search(text) or not X.parse_date(X.DATES.search(text).group()))


def test_chunks_are_linear():
    text = "x" * 3_000_000
    began = time.perf_counter()
    out = T.chunks_of(text, 1500, 200)
    assert out[-1]["end"] == len(text) and time.perf_counter() - began < 2 and T.chunks_of("", 5, 1) == T.chunks_of(None, 5, 1) == []
    assert [(c["start"], c["end"]) for c in T.chunks_of("abcdefgh", 4, 1)] == [(0, 4), (3, 7), (6, 8)]
