"""Benchmark decontamination with a distributed positional inverted index.

Postings of the training text, (term, document, position), are stored for every term that a
window of the test text looks up. A window is `window` consecutive words of an item, or the whole
of a shorter item. Each window looks up its two rarest terms, by their frequency in all training
documents; the posting lists, less the terms' offsets in the item, are intersected, and what
they have in common are the alignments of item and document at which a window can occur. An
alignment is then compared word by word, which gives its exact phrase matches; windows whose
rarest terms only come within `slop` words of their places are proximity matches.

Test terms reach the executors as broadcasts whose rows were counted first; a test set beyond
BROADCAST_ROWS is taken in blocks, one pass over the documents each. Native DataFrame
operations only.

Defined cases: null and empty texts have no words; an item without words has no windows; equal
items match under each of their ids; documents that share an id are told apart by their text,
and rows that share both get equal results; an empty test table leaves all documents clean;
further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import blocks, n_words_col, words_col, written

WINDOW = 10
#: Words that the terms of a proximity match may be out of place to each other.
SLOP = 3
BROADCAST_ROWS = 1_000_000


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text"))


def _items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, item (a number for the words), words of items that have words."""
    it = items.select(items[id_col].alias("item_id"), words_col(items[text_col]).alias("words")).where(F.size("words") > 0)
    return it.withColumn("item", F.xxhash64("words"))


def _passages(named: DataFrame, window: int) -> DataFrame:
    """item, words, size (of its windows), once for each different item."""
    return named.select("item", "words").dropDuplicates(["item"]).withColumn("size", F.least(F.size("words"), F.lit(window)))


def _window_terms(passages: DataFrame) -> DataFrame:
    """item, start, size, term, at: the words of every window, of equal ones the first; at counts from start. A word of
    an item goes into `size` windows at most, whatever the item's length."""
    each = passages.select("item", "size", (F.size("words") - F.col("size")).alias("last"), F.posexplode("words").alias("pos", "term"))
    start = F.explode(F.sequence(F.greatest(F.col("pos") - F.col("size") + 1, F.lit(0)), F.least("pos", "last")))
    return each.select("item", "size", "term", "pos", start.alias("start")).groupBy("item", "start", "size", "term").agg(F.min(F.col("pos") - F.col("start")).alias("at"))


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the terms occurs in docs (id, h, text)."""
    parts = [
        docs.select(F.explode(words_col(F.col("text"))).alias("term")).join(F.broadcast(b), "term").groupBy("term").agg(F.count("*").alias("n"))
        for b in blocks(terms, "term", BROADCAST_ROWS)
    ]
    return reduce(DataFrame.union, parts)


def lookups(docs: DataFrame, passages: DataFrame, terms: int = 2) -> DataFrame:
    """item, start, size, need, k, term, offset: the rarest terms of each window, k from 1; of
    equal terms in a window the first. offset is the term's place in the item."""
    each = _window_terms(passages)
    freq = frequencies(docs, each.select("term").distinct())
    order = Window.partitionBy("item", "start").orderBy(F.coalesce("n", F.lit(0)), "at")
    ranked = each.join(freq, "term", "left").withColumn("k", F.row_number().over(order)).where(F.col("k") <= terms)
    need = F.max("k").over(Window.partitionBy("item", "start"))
    return ranked.select("item", "start", "size", "k", "term", (F.col("start") + F.col("at")).alias("offset"), need.alias("need"))


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """term, id, h, pos of the given terms, stored."""
    parts = [
        docs.select("id", "h", F.posexplode(words_col(F.col("text"))).alias("pos", "term")).join(F.broadcast(b), "term").select("term", "id", "h", "pos")
        for b in blocks(terms, "term", BROADCAST_ROWS)
    ]
    return written(reduce(DataFrame.union, parts), "postings")


def _same(c: Column, d: Column) -> Column:
    return c.eqNullSafe(d)


def alignments(index: DataFrame, looked: DataFrame) -> DataFrame:
    """id, h, item, shift at which the lookups of some window meet: the word `i` of the item
    would stand at `shift + i` in the document."""
    asks = looked.groupBy("term", "offset", "item", "need").agg(F.collect_list(F.struct("start", "k")).alias("asks"))
    parts = [
        index.join(F.broadcast(b), "term").select("id", "h", "item", (F.col("pos") - F.col("offset")).alias("shift"), "need", F.explode("asks").alias("ask"))
        for b in blocks(asks, "term", BROADCAST_ROWS)
    ]
    hits = reduce(DataFrame.union, parts)
    met = hits.groupBy("id", "h", "item", "shift", F.col("ask.start").alias("start"), "need").agg(F.countDistinct("ask.k").alias("c"))
    return met.where("c = need").select("id", "h", "item", "shift").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """id, h, item (its id), first, last: each run of document words, numbered from 0, that stands in
    windows of the item which occur at one alignment."""
    rows = _keyed(docs, id_col, text_col)
    named = _items(items, item_col, item_text)
    return _phrases(rows, named, *_index(rows, named, window))


def _index(rows: DataFrame, named: DataFrame, window: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The items' words, the lookups of their windows, and the stored postings of these."""
    passages = written(_passages(named, window), "passages")
    looked = written(lookups(rows, passages), "lookups")
    return passages, looked, postings(rows, looked.select("term").distinct())


def _phrases(rows: DataFrame, named: DataFrame, passages: DataFrame, looked: DataFrame, index: DataFrame) -> DataFrame:
    found = written(alignments(index, looked), "alignments")
    texts = passages.select(F.col("item").alias("i2"), F.col("words").alias("item_words"), "size")
    docs_of = found.select(F.col("id").alias("d2"), F.col("h").alias("h2")).distinct().hint("merge")  # grows with the documents
    held = rows.join(docs_of, _same(F.col("id"), F.col("d2")) & _same(F.col("h"), F.col("h2")), "left_semi").dropDuplicates(["id", "h"])
    held = held.select(F.col("id").alias("d3"), F.col("h").alias("h3"), words_col(F.col("text")).alias("doc_words"))
    checked = found.join(held, _same(F.col("id"), F.col("d3")) & _same(F.col("h"), F.col("h3"))).join(texts, F.col("item") == F.col("i2"))
    n, size = F.size("item_words"), F.col("size")
    lined = checked.where(F.col("shift") + n > 0).select("id", "h", "item", "shift", "size", F.zip_with(
        F.slice(F.col("doc_words"), F.greatest(F.col("shift"), F.lit(0)) + 1, n + F.least(F.col("shift"), F.lit(0))),
        F.slice(F.col("item_words"), 1 - F.least(F.col("shift"), F.lit(0)), n), lambda a, b: _same(a, b) & a.isNotNull()).alias("same"))
    runs = lined.select("id", "h", "item", F.greatest("shift", F.lit(0)).alias("base"), "size", F.aggregate(
        F.col("same"),
        F.struct(F.lit(0).alias("at"), F.lit(0).alias("run"), F.array().cast("array<struct<first:int,last:int>>").alias("out")),
        lambda s, x: F.struct(
            (s["at"] + 1).alias("at"),
            F.when(x, s["run"] + 1).otherwise(0).alias("run"),
            F.when(~x & (s["run"] >= size), F.concat(s["out"], F.array(F.struct((s["at"] - s["run"]).alias("first"), (s["at"] - 1).alias("last"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: F.when(s["run"] >= size, F.concat(s["out"], F.array(F.struct((s["at"] - s["run"]).alias("first"), (s["at"] - 1).alias("last"))))).otherwise(s["out"]),
    ).alias("runs"))
    ids = named.select(F.col("item").alias("i4"), "item_id")
    return runs.select("id", "h", "item", "base", F.explode("runs").alias("r")).join(ids, F.col("item") == F.col("i4")).select(
        "id", "h", F.col("item_id").alias("item"), (F.col("base") + F.col("r.first")).alias("first"), (F.col("base") + F.col("r.last")).alias("last")
    )


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """id, h, item, start: windows whose rarest terms stand within slop words of their places
    to each other in the document, exact places included. Windows of one term are left out."""
    rows, named = _keyed(docs, id_col, text_col), _items(items, item_col, item_text)
    return _close(named, *_index(rows, named, window)[1:], slop)


def _close(named: DataFrame, looked: DataFrame, index: DataFrame, slop: int) -> DataFrame:
    asks = looked.where("need > 1").select("term", "offset", "item", "start", "k")
    parts = [index.join(F.broadcast(b), "term").withColumn("shift", F.col("pos") - F.col("offset")) for b in blocks(asks, "term", BROADCAST_ROWS)]
    hits = reduce(DataFrame.union, parts)
    line = Window.partitionBy("id", "h", "item", "start").orderBy("shift", "k")
    other = F.last(F.when(F.col("k") == 1, F.col("shift")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    other2 = F.last(F.when(F.col("k") == 2, F.col("shift")), ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("shift") - F.when(F.col("k") == 1, other2).otherwise(other)
    return hits.withColumn("gap", gap).where(F.col("gap") <= slop).join(
        named.select(F.col("item").alias("i4"), "item_id"), F.col("item") == F.col("i4")
    ).select("id", "h", F.col("item_id").alias("item"), "start").distinct()


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """One row per row of docs: id, h, n_words, n_hit, items (sorted strings), n_near (items with a
    proximity match, phrase matches of windows with two different words included), contaminated (by phrases)."""
    all_, named = _keyed(docs, id_col, text_col), _items(items, item_col, item_text)
    passages, looked, index = _index(all_, named, window)
    runs = written(_phrases(all_, named, passages, looked, index), "runs")
    near = written(_close(named, looked, index, slop).groupBy("id", "h").agg(F.countDistinct("item").alias("n_near")), "near")
    order = Window.partitionBy("id", "h").orderBy("first", "last")
    before = F.coalesce(F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    covered = F.greatest(F.lit(0), F.col("last") - F.greatest(F.col("first") - 1, before))
    hits = runs.withColumn("new", covered).groupBy("id", "h").agg(
        F.sum("new").alias("n_hit"), F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items")
    ).select(F.col("id").alias("d2"), F.col("h").alias("h2"), "n_hit", "items")
    rows = written(all_.select("id", "h", n_words_col(F.col("text")).alias("n_words")), "counted")
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    met = rows.join(hits, _same(F.col("id"), F.col("d2")) & _same(F.col("h"), F.col("h2")), "left")
    met = met.join(near.select(F.col("id").alias("d3"), F.col("h").alias("h3"), "n_near"), _same(F.col("id"), F.col("d3")) & _same(F.col("h"), F.col("h3")), "left")
    return met.select(
        "id", "h", "n_words", hit.alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without contaminated rows, all columns kept."""
    bad = phrase_matches(docs, items, id_col, text_col, item_col, item_text, window).select(F.col("id").alias("__b_id"), F.col("h").alias("__b_h")).distinct().hint("merge")
    keyed = docs.withColumns({"__r_id": docs[id_col], "__r_h": F.xxhash64(docs[text_col])})
    return keyed.join(bad, _same(F.col("__r_id"), F.col("__b_id")) & _same(F.col("__r_h"), F.col("__b_h")), "left_anti").drop("__r_id", "__r_h")
