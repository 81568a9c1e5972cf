"""Regular expressions of the text operators in Java syntax, and string helpers.

Flags: (?Ud) makes classes and boundaries Unicode and `.` stop at \\n only; (?iuUd) also ignores
case.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

CASED, ANY_CASE = "(?Ud)", "(?iuUd)"

# What the entities look like.
ENTITIES = {
    "email": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "phone": r"(?:\+\d{1,3}[- ]?)?\(?\d{3}\)?[- ]?\d{3}[- ]?\d{4}",
    "date": r"\b(?:\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{2,4}[-/]\d{1,2}[-/]\d{1,2}|(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{2,4})\b",
    "url": r"https?://(?:[-\w.]|%[\da-fA-F]{2})++(?:/[-\w%!$&'()*+,;=:~]++)*+(?:\?[-\w%!$&'()*+,;=:~/?]+)?",
    "price": r"\$\s*\d+(?:\.\d{2})?|\d+\s*(?:USD|dollars|EUR|euros)",
    "address": r"\d+\s+[A-Za-z0-9\s,.-]+(?:Avenue|Ave|Street|St|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Plaza|Plz|Terrace|Way)\b[A-Za-z0-9\s,.-]+",
    "time": r"\b(?:1[0-2]|0?[1-9]):[0-5][0-9](?:\s?[AP]M)?|\b(?:2[0-3]|[01]?[0-9]):[0-5][0-9](?:\s?hrs)?",
    "credit_card": r"\b(?:\d{4}[-\s]?){3}\d{4}\b|\b\d{4}[-\s]?\d{6}[-\s]?\d{5}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "zip_code": r"\b\d{5}(?:-\d{4})?\b",
}
# Keywords of the document types, in the order that decides ties.
KEYWORDS = {
    "receipt": ("total", "subtotal", "tax", "amount", "payment", "change", "cash", "credit card", "item", "qty", "quantity", "price",
                "receipt", "store", "transaction", "order", "purchase", "customer", "cashier", "date", "time"),
    "business_card": ("name", "phone", "email", "website", "address", "company", "title", "position", "cell", "mobile", "tel", "fax", "linkedin"),
    "id_card": ("name", "birth", "issue", "expiration", "identification", "id number", "gender", "height", "weight", "eyes", "hair", "address",
                "class", "restrictions"),
    "form": ("form", "name", "address", "date", "signature", "please", "print", "check", "select", "complete", "sign", "submit", "office", "use", "only"),
    "text_document": ("chapter", "section", "page", "paragraph", "introduction", "conclusion", "references", "figure", "table", "appendix"),
}
# Payment methods, in the order in which they are tried.
PAYMENTS = ("cash", "credit", "debit", "visa", "mastercard", "amex", "american express", "discover", "paypal", "check")
# Labelled amounts and fields, in linear form: white space may stand between all parts.
TOTAL = r"total\s*+(?:amount\s*+)?+(?:[:=]\s*+)?+(?:\$\s*+)?+(\d++\.\d{2})"
AMOUNT = r"(?:total|amount)\s*+(?:[:=]\s*+)?+(?:\$\s*+)?+(\d++\.\d{2})"
SUBTOTAL = r"subtotal\s*+(?:[:=]\s*+)?+\$?+(\d++\.\d{2})"
TAX = r"tax\s*+(?:[:=]\s*+)?+\$?+(\d++\.\d{2})"
ID_NUMBER = r"(?:id|license|number|#)\s*+(?:[:=]\s*+)?+([A-Z0-9-]++)"
NAME = r"name\s*+(?:[:=]\s*+)?+([^\n]*+)"
BIRTH = r"(?:date of birth|birth date|dob|born)\s*+(?:[:=]\s*+)?+(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
ISSUED = r"(?:issue|issued)\s*+(?:(?:date|on)\s*+)?+(?:[:=]\s*+)?+(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
EXPIRES = r"(?:expiration|expires|exp)\s*+(?:(?:date|on)\s*+)?+(?:[:=]\s*+)?+(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})"
# A host without a scheme.
WWW = r"www\.[a-zA-Z0-9][-a-zA-Z0-9]{0,62}+(?:\.[a-zA-Z0-9][-a-zA-Z0-9]{0,62}+)++"
# The entities whose plain patterns try a run of characters from each of its places. Here a run is tried once, from where it starts
# or the last match ended; group 1 is what the plain pattern matches. An address starts at the first number before
# white space in its run, since later ones end at the same street word.
LINEAR = {
    "email": r"(?:\G|(?<![a-zA-Z0-9._%+-]))([a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,})",
    "price": r"(\$\s*+\d++(?:\.\d{2})?|(?:\G|(?<!\d))\d++\s*+(?:USD|dollars|EUR|euros))",
    "address": r"(?:\G|(?<![A-Za-z0-9\s,.\d-])|(?<!\d)(?=[0-9]*+[\d&&[^0-9]]))(?:\d++(?!\s))?+(?:[A-Za-z\s,.-]++|[0-9]++(?![\d\s]))*+"
    r"(\d++\s[A-Za-z0-9\s,.-]+(?:Avenue|Ave|Street|St|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr|Court|Ct|Plaza|Plz|Terrace|Way)\b[A-Za-z0-9\s,.-]++)",
}


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first(text: Column, pattern: str) -> Column:
    """The first whole match, null if none."""
    return F.regexp_substr(text, F.lit(pattern))


def group(text: Column, pattern: str, n: int = 1) -> Column:
    """Group n of the first match, which is never empty; null if none."""
    return F.nullif(F.regexp_extract(text, pattern, n), F.lit(""))


def entity(text: Column, name: str, flags: str) -> Column:
    """All matches of an entity, in order."""
    return all_matches(text, flags + LINEAR[name], 1) if name in LINEAR else all_matches(text, flags + ENTITIES[name])


def first_entity(text: Column, name: str, flags: str = CASED) -> Column:
    return group(text, flags + LINEAR[name]) if name in LINEAR else first(text, flags + ENTITIES[name])


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s++|(?<!\s)\s++\z", "")


def lines(c: Column) -> Column:
    return F.split(strip(c), "\n", -1)


def keyword_pattern(words: tuple[str, ...]) -> str:
    return ANY_CASE + r"\b(?:" + "|".join(words) + r")\b"
