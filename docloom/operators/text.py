"""Text operators: entities, document types, typed records, key/value pairs, redaction.

All are Column to Column: one scan and one projection, no shuffle. Null or blank text gives an
`error` in `analyze` and null or empty parts elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docloom.functions import rx
from docloom.functions.rx import ANY_CASE, CASED, ENTITIES, KEYWORDS, PAYMENTS

MAX_KEY, MAX_VALUE = 30, 100


def entities(text: Column) -> Column:
    """map of entity to its matches in the order of the text; only entities that occur. A pattern
    is tried only on texts with a character that all its matches have."""
    digit, none = F.rlike(text, F.lit(r"(?U)\d")), F.array().cast("array<string>")
    sign = {"email": F.contains(text, F.lit("@")), "url": F.contains(text, F.lit("://")), "ssn": digit & F.contains(text, F.lit("-")), "time": digit & F.contains(text, F.lit(":"))}
    pairs = [x for k in ENTITIES for x in (F.lit(k), F.when(sign.get(k, digit), rx.entity(text, k, ANY_CASE)).otherwise(none))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: F.size(v) > 0)


def type_scores(text: Column) -> dict[str, Column]:
    return {k: F.regexp_count(text, F.lit(rx.keyword_pattern(w))).cast("long") for k, w in KEYWORDS.items()}


def doc_type(text: Column) -> Column:
    """The type of the largest score; ties go to the earlier type, no hit to text_document."""
    ranked = [F.struct(s.alias("score"), F.lit(-i).alias("order"), F.lit(k).alias("type")) for i, (k, s) in enumerate(type_scores(text).items())]
    best = F.array_max(F.array(*ranked))
    return F.when(best["score"] > 0, best["type"]).otherwise("text_document")


def payment(text: Column) -> Column:
    """The first of the methods that the text names; one pass finds them all. No method's name holds another's; letters that only Unicode folds become plain ones."""
    said = F.transform(rx.all_matches(text, rx.keyword_pattern(PAYMENTS)), lambda m: F.lower(F.translate(m, "ſıİ\u212a", "siik")))
    return F.array_min(F.transform(said, lambda m: F.struct(F.array_position(F.array(*map(F.lit, PAYMENTS)), m).alias("rank"), m.alias("method"))))["method"]


# A line item, quantity, description and price.
ITEM = ANY_CASE + r"(\d+)\s*(?:x)?\s*(.+?)\s*\$?(\d+\.\d{2})"
_BLANK = r"[^\S\n]"
_LAST = rf"{_BLANK}*+x?+{_BLANK}*+(?=\n)"  # what stands between a line's last number and its end
_OTHER = rf"\d++(?!\.\d{{2}})(?!{_LAST})"  # a number that is neither an amount nor that last one
_QUANTITY = rf"(?:0++(?=\d))?+(\d{{1,11}}+)\d*+({_LAST})"  # that last number as far as an int shows it
#: What follows a line's last amount (or the whole of a line without one), has numbers, and is not followed by an amount.
DEAD = rf"{ANY_CASE}(?:(?<=\d\.\d{{2,20}})(?!\d|\.\d{{2}})|(?<=\d\.\d{{20}})(?=\d)|(?<=\n)|\A)[^\d\n]*+(?:{_OTHER}(?:[^\d\n]|{_OTHER})*+(?:{_QUANTITY})?|{_QUANTITY})(?=\n|\z)(?!\s*+\$?\d++\.\d{{2}})"


def items(text: Column) -> Column:
    """Line items. ITEM tries each number of a line that leads to no amount up to the line's end; so
    what cannot be part of an item is cut out first, and long gaps at line ends are shortened,
    which makes the search linear and leaves the items as they are (numbers of more than 20 digits
    behind a point excepted)."""
    live = F.regexp_replace(text, rf"{ANY_CASE}(?<!{_BLANK})({_BLANK}){_BLANK}++(?=\n)", "$1")
    live = F.regexp_replace(live, rf"{ANY_CASE}\n\n*+(?:({_BLANK})\s*+)?+(?<=(\s))", "\n$1$2")
    live = F.regexp_replace(live, DEAD, "#$1$2$3$4")
    found = F.transform(rx.all_matches(live, ITEM), lambda m: F.struct(*[F.regexp_extract(m, ITEM, g).alias(n) for g, n in ((1, "q"), (2, "d"), (3, "p"))]))
    read = F.transform(found, lambda x: F.struct(
        x["q"].try_cast("int").alias("quantity"), rx.strip(x["d"]).alias("description"), x["p"].cast("double").alias("price"),
        (x["q"].try_cast("int") * x["p"].cast("double")).alias("subtotal"),
    ))
    kept = F.filter(read, lambda x: x["quantity"].isNotNull())
    return F.when(F.rlike(text, F.lit(r"(?U)\d\.\d{2}")), kept).otherwise(F.array().cast("array<struct<quantity:int,description:string,price:double,subtotal:double>>"))


# Records are structs of independent fields: taking some of them, as in receipt(text)["total"], leaves the work of the others out.
def receipt(text: Column) -> Column:
    amount = lambda pattern: rx.group(text, ANY_CASE + pattern).cast("double")
    return F.struct(
        F.get(rx.lines(text), F.lit(0)).alias("merchant"), rx.first_entity(text, "date").alias("date"), rx.first_entity(text, "time").alias("time"),
        F.coalesce(amount(rx.TOTAL), amount(rx.AMOUNT)).alias("total"), amount(rx.SUBTOTAL).alias("subtotal"), amount(rx.TAX).alias("tax"),
        payment(text).alias("payment_method"), items(text).alias("items"),
    )


def business_card(text: Column) -> Column:
    lines, phones = rx.lines(text), rx.entity(text, "phone", CASED)
    return F.struct(
        *[rx.strip(F.get(lines, F.lit(i))).alias(n) for i, n in enumerate(("name", "title", "company"))],
        F.get(phones, F.lit(0)).alias("phone"), F.get(phones, F.lit(1)).alias("mobile"), rx.first_entity(text, "email").alias("email"),
        F.coalesce(rx.first_entity(text, "url"), rx.first(text, CASED + rx.WWW)).alias("website"), rx.first_entity(text, "address").alias("address"),
    )


def id_card(text: Column) -> Column:
    field = lambda pattern: rx.group(text, ANY_CASE + pattern)
    named = rx.first(text, ANY_CASE + rx.NAME)  # never empty, but the name in it may be
    return F.struct(
        field(rx.ID_NUMBER).alias("id_number"), rx.strip(F.regexp_extract(named, ANY_CASE + rx.NAME, 1)).alias("name"),
        field(rx.BIRTH).alias("date_of_birth"), field(rx.ISSUED).alias("issue_date"), field(rx.EXPIRES).alias("expiration_date"), rx.first_entity(text, "address").alias("address"),
    )


def _pairs(text: Column, pattern: str) -> Column:
    zipped = F.arrays_zip(rx.all_matches(text, pattern, 1).alias("k"), rx.all_matches(text, pattern, 2).alias("v"))
    entries = F.transform(zipped, lambda x: F.struct(F.lower(rx.strip(x["k"])).alias("key"), rx.strip(x["v"]).alias("value")))
    return F.filter(entries, lambda e: (F.length(e["key"]) <= MAX_KEY) & (F.length(e["value"]) <= MAX_VALUE))


def _last_wins(entries: Column) -> Column:
    """A map in which of equal keys the last entry stays, whatever the session's policy: entries
    sorted by key and place, of which those stay that another key follows."""
    ranked = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("i"), e["value"].alias("value"))))
    after = F.slice(ranked, 2, F.greatest(F.size(ranked), F.lit(1)))
    stay = F.zip_with(ranked, after, lambda e, o: F.when(o.isNull() | (e["key"] != o["key"]), F.struct(e["key"], e["value"])))
    return F.map_from_entries(F.array_compact(stay))


# The key run is taken whole, from where it starts or the last match ended, or up to its first gap of two
# blanks; linear in its length.
_RUN = CASED + r"(?:\G|(?<![\w\s]))([\w\s]++)"


GAP_PAIR = CASED + r"(?:\G|(?<![\w\s]))([\w\s](?:(?!\s\s)[\w\s])*+)\s{2,}([^\n]+)"


def form_fields(text: Column) -> Column:
    return _last_wins(_pairs(text, _RUN + r"(?::|=)\s*([^\n]+)"))


def form(text: Column) -> Column:
    signed = F.rlike(text, F.lit(ANY_CASE + r"\b(?:signature|sign here|signed|authorized signature)\b"))
    return F.struct(rx.strip(F.get(rx.lines(text), F.lit(0))).alias("title"), form_fields(text).alias("fields"), signed.alias("signature"))


def key_values(text: Column) -> Column:
    patterns = (_RUN + r":\s*([^\n]+)", _RUN + r"=\s*([^\n]+)", GAP_PAIR)
    return _last_wins(F.concat(*[_pairs(text, p) for p in patterns]))


def general(text: Column) -> Column:
    lines = rx.lines(text)
    title = rx.strip(F.get(lines, F.lit(0)))
    return F.struct(
        title.alias("title"),
        F.struct(F.length(text).cast("long").alias("characters"), F.regexp_count(text, F.lit(r"(?U)\S+")).cast("long").alias("words"), F.size(lines).cast("long").alias("lines")).alias("length"),
        F.lit("en").alias("language"),
        F.when((title != "") & (F.size(lines) > 1), rx.strip(F.get(lines, F.lit(1)))).otherwise(rx.strip(F.substring(text, 1, 100))).alias("summary"),
    )


TYPES = {"receipt": receipt, "business_card": business_card, "id_card": id_card, "form": form}


def is_blank(text: Column) -> Column:
    return text.isNull() | (rx.strip(text) == "")


def record_type(text: Column, kind: Column) -> Column:
    """The type of a text's record: kinds without a record of their own are text documents; null for blank texts."""
    return F.when(~is_blank(text), F.when(kind.isin(*TYPES), kind).otherwise("text_document"))


def field_of(text: Column, kind: Column, fields: dict[str, str]) -> Column:
    """One field of each text's record, by its type: fields names it for each type."""
    of, makers = record_type(text, kind), TYPES | {"text_document": general}
    return F.coalesce(*[F.when(of == name, makers[name](text)[field]) for name, field in fields.items()])


def analyze(text: Column, kind: Column | None = None) -> Column:
    """One record of a superset schema; only the part of the text's type is set."""
    blank = is_blank(text)
    of = record_type(text, kind if kind is not None else doc_type(text))
    parts = [F.when(of == name, make(text)).alias(name) for name, make in (TYPES | {"text_document": general}).items()]
    return F.struct(F.when(blank, F.lit("Empty text")).alias("error"), of.alias("type"), *parts, F.when(~blank, entities(text)).alias("metadata"))


def redact(text: Column) -> Column:
    out = F.regexp_replace(text, CASED + ENTITIES["credit_card"], "[REDACTED CARD]")
    out = F.regexp_replace(out, CASED + ENTITIES["ssn"], "[REDACTED SSN]")
    return F.regexp_replace(out, rf"{CASED}(?=(.{{4}})){ENTITIES['phone']}", "$1XXX-XXXX")


def clean_lines(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, "\n", -1), rx.strip), lambda x: x != ""), "\n")


def ink(text: Column) -> Column:
    """Characters other than spaces and line ends."""
    return F.length(F.translate(text, " \n", "")).cast("long")


def truncated(text: Column, n: int) -> Column:
    """The first n characters and dots of a longer text, a shorter text as it is."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)
