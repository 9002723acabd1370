"""Fixed values of the data model: closed vocabularies, thresholds and check tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Entity classes.
CLASSES = ("Person", "Organization", "Location", "Date", "Amount", "Email", "Phone", "Identifier")

#: Seed predicates, directed inverse pairs, symmetric predicates.
PREDICATES = (
    "owns", "owned_by", "purchased_from", "sold_to", "located_in", "part_of", "address_of", "married_to", "parent_of", "child_of", "member_of",
    "employer_of", "employee_of", "partner_of", "issued_by", "dated", "signed_by", "uses_pan", "uses_aadhaar", "has_voter_id", "mentioned_with",
)
INVERSES = {
    "owns": "owned_by", "owned_by": "owns", "purchased_from": "sold_to", "sold_to": "purchased_from",
    "employer_of": "employee_of", "employee_of": "employer_of", "parent_of": "child_of", "child_of": "parent_of",
}
SYMMETRIC = ("married_to", "partner_of", "mentioned_with")

#: Corporate suffixes of organisation names.
CORPORATE_SUFFIXES = (
    " Ltd", " Ltd.", " Limited", " Inc", " Inc.", " Corp", " Corp.", " Corporation", " LLC", " L.L.C.", " LLP", " L.L.P.", " GmbH", " AG",
    " Pvt Ltd", " Pvt. Ltd.", " Private Limited", " Co", " Co.", " Company", " Sons", " & Sons",
)
UNIT_PATTERN = r"^[A-Za-z]{1,6}[- ]?[0-9]+$"

#: Currency marks.
CURRENCIES = {"$": "usd", "₹": "inr", "€": "eur", "£": "gbp", "¥": "jpy", "USD": "usd", "INR": "inr", "EUR": "eur", "GBP": "gbp", "JPY": "jpy"}

#: Document type names.
TYPE_NAMES = {"doc": "docx", "jpeg": "jpg", "xls": "xlsx", "unknown": "other"}

#: Identifier subclasses that are financial, hints of property and vehicle names.
FINANCIAL = ("bank_account", "iban", "policy_number", "folio_number", "credit_card")
PROPERTY_HINTS, VEHICLE_HINTS = ("plot", "land", "property"), ("car", "vehicle", "bike", "scooter")

#: Limits and thresholds.
ENTITY_CAP, VOCABULARY_CAP, PROMOTION_SUPPORT, BOOTSTRAP_DOCS = 20, 200, 2, 30
TARGET_VERSION, PATTERN_VERSION, MERGED_VERSION = 3.5, 2.5, 3.0
SEARCH_K, RELATED_FLOOR, RECENCY_DAYS, MERGE_COSINE = 20, 0.3, 1095, 0.75
CHUNK_SIZE, CHUNK_OVERLAP, CHUNKS_PER_DOC, CHUNKS_IN_ALL, ANSWER_FLOOR, CHAT_K = 1500, 200, 5, 15, 0.20, 12

#: Vehicle number weights and letter values by letter.
VIN_WEIGHTS = (8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2)
VIN_VALUES = {
    "A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8, "J": 1, "K": 2, "L": 3, "M": 4, "N": 5, "P": 7, "R": 9,
    "S": 2, "T": 3, "U": 4, "V": 5, "W": 6, "X": 7, "Y": 8, "Z": 9,
}
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Rule-based space names: (name, icon, colour).
SPACE_STYLES = {
    "invoices": ("Invoices & Receipts", "Receipt", "#10B981"), "property": ("Property", "Home", "#6366F1"), "sheets": ("Spreadsheets & Data", "Table", "#3B82F6"),
    "work": ("Work", "Briefcase", "#8B5CF6"), "medical": ("Medical", "Heart", "#EF4444"), "education": ("Kids & Education", "GraduationCap", "#F97316"),
    "photos": ("Photos & Images", "Image", "#EC4899"), "other": ("Space", "Folder", "#6B7280"),
}


def inverse_table(spark: SparkSession) -> DataFrame:
    """(predicate, partner): the predicate of the reverse triple (11 rows, so it may be broadcast)."""
    rows = [*INVERSES.items(), *((p, p) for p in SYMMETRIC)]
    return spark.createDataFrame(rows, "predicate string, partner string")


def predicate_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PREDICATES], "predicate string")
