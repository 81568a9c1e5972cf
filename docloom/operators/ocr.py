"""Operators on OCR word tables: doc_id, psm, pos, text, conf, top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from docloom.functions import rx

from . import scan, text as tx

GAP = 5
NO_TEXT = "No text detected"


def confidence(words: DataFrame) -> DataFrame:
    """doc_id, psm, confidence: mean of positive confidences, 0 if there are none."""
    return words.groupBy("doc_id", "psm").agg(F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), F.lit(0.0)).alias("confidence"))


#: Words of a document that one task takes at most to find their blocks.
CHUNK = 1 << 16


def blocks(words: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, psm, block, text: kept words in order, a new block where the top moves by more
    than GAP from the kept word before. Long documents are scanned in chunks of places."""
    kept = words.where((F.col("conf") >= 0) & (F.trim("text") != ""))
    moved = lambda now, before: F.abs(now - before) > GAP
    placed = scan.runs(kept, ["doc_id", "psm"], ["pos"], "top", moved, "block", F.floor(F.col("pos") / chunk))
    words_ = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return placed.groupBy("doc_id", "psm", "block").agg(F.array_join(F.transform(words_, lambda x: x["text"]), " ").alias("text"))


def _joined() -> Column:
    kept = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("pos", "text"))))
    return F.array_join(F.transform(kept, lambda x: x["text"]), " ")


def full_text(words: DataFrame) -> DataFrame:
    """doc_id, psm, text: the words that are not blank, in order."""
    return words.groupBy("doc_id", "psm").agg(_joined().alias("text"))


def best_mode(words: DataFrame) -> DataFrame:
    """doc_id, psm, confidence, text: the mode of the largest positive confidence with text; ties to 3, 6, 4."""
    sure = F.coalesce(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), F.lit(0.0))
    scored = words.groupBy("doc_id", "psm").agg(sure.alias("confidence"), _joined().alias("text")).where("confidence > 0 and text <> ''")
    order = F.when(F.col("psm") == 3, 0).when(F.col("psm") == 6, -1).otherwise(-2)
    return scored.groupBy("doc_id").agg(F.max_by(F.struct("psm", "confidence", "text"), F.struct("confidence", order)).alias("b")).select("doc_id", "b.*")


def longest(candidates: DataFrame, size: Column, key: str = "doc_id") -> DataFrame:
    """The candidate (text, ord) of the largest size; the first one on ties; a sentinel if all
    are blank."""
    best = F.max_by("text", F.when(F.trim("text") != "", F.struct(size.alias("n"), (-F.col("ord")).alias("o"))))
    return candidates.groupBy(key).agg(F.coalesce(best, F.lit(NO_TEXT)).alias("text"))


# What the fields of recognised text look like.
FIELDS = {
    "dates": (
        r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}",
        r"\d{4}[-/]\d{1,2}[-/]\d{1,2}",
        r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b",
    ),
    "emails": (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",),
    "phones": (r"\b(?:\+\d{1,2}\s?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b",),
    "addresses": (r"\d+\s+[A-Za-z0-9\s,]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)\b",),
    "amounts": (r"\$\s*\d+(?:\.\d{2})?|\d+(?:\.\d{2})?\s*(?:USD|EUR|GBP)",),
}


# The fields whose plain patterns try a run of characters from each of its places, once a run; see rx.LINEAR.
LINEAR = {
    "emails": r"(?:\G|(?<![A-Za-z0-9._%+-]))(?:(?!\b)[A-Za-z0-9._%+-])*+\b([A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b)",
    "addresses": r"(?:\G|(?<![A-Za-z0-9\s,\d])|(?<!\d)(?=[0-9]*+[\d&&[^0-9]]))(?:\d++(?!\s))?+(?:[A-Za-z\s,]++|[0-9]++(?![\d\s]))*+"
    r"(\d++\s[A-Za-z0-9\s,]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Lane|Ln|Drive|Dr)\b)",
    "amounts": r"(\$\s*+\d++(?:\.\d{2})?|(?:\G|(?<!\d))\d++(?:\.\d{2})?\s*+(?:USD|EUR|GBP))",
}


def structured_info(text: Column) -> Column:
    """All matches of each field's patterns, pattern after pattern; only addresses ignore case."""
    flags = lambda name: rx.ANY_CASE if name == "addresses" else rx.CASED
    found = lambda name: [rx.all_matches(text, flags(name) + LINEAR[name], 1)] if name in LINEAR else [rx.all_matches(text, flags(name) + p) for p in FIELDS[name]]
    return F.struct(*[F.concat(*found(name)).alias(name) for name in FIELDS])


def empty_info() -> Column:
    """The structured record of a document without recognised text."""
    return F.struct(*[F.array().cast("array<string>").alias(n) for n in FIELDS])


def n_items(info: Column) -> Column:
    return sum((F.size(info[c]) for c in FIELDS), F.lit(0)).cast("long")


NO_DOCUMENT = "No document detected"


def settings(variants: Column, scales: tuple[float, ...] = (1.0,), modes: tuple[int, ...] = (6, 4, 11, 3)) -> Column:
    """array of variant, scale, psm in the order in which they are tried; variants: array of names."""
    inner = F.array(*[F.struct(F.lit(s).alias("scale"), F.lit(m).alias("psm")) for s in scales for m in modes])
    return F.flatten(F.transform(variants, lambda v: F.transform(inner, lambda x: F.struct(v.alias("variant"), x["scale"].alias("scale"), x["psm"].alias("psm")))))


def best_candidate(documents: DataFrame, candidates: DataFrame, key: str = "doc_id", advanced: bool = False) -> DataFrame:
    """key, text for each row of documents (key, found, and with advanced raw): the longest candidate (text, ord) that is not
    blank. advanced: lines are stripped and blank ones dropped first, length is without spaces, and
    without a candidate the raw text stays. Then NO_TEXT, or NO_DOCUMENT where found is false."""
    text = F.col("text")
    if advanced:
        text = tx.clean_lines(text)
    rows = candidates.select(F.col(key).alias("__k"), "ord", text.alias("text"))
    size = tx.ink(F.col("text")) if advanced else F.length("text")
    best = rows.groupBy("__k").agg(F.max_by("text", F.when(F.trim("text") != "", F.struct(size.alias("n"), (-F.col("ord")).alias("o")))).alias("__best"))
    raw = F.when(F.trim("raw") != "", tx.clean_lines(F.col("raw"))) if advanced else F.lit(None).cast("string")
    out = documents.join(best, documents[key].eqNullSafe(F.col("__k")), "left")
    return out.select(key, F.when(~F.col("found"), NO_DOCUMENT).otherwise(F.coalesce("__best", raw, F.lit(NO_TEXT))).alias("text"))
