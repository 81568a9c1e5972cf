import json
import random
import re
import time

from pyspark.sql import functions as F

from docloom.functions import rx
from docloom.operators import classify, geometry, ocr, text as tx
from docloom.sources import files, sinks
from docloom.streaming import throttle


def one(spark, fn, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.r for r in rows.select("i", fn(F.col("text")).alias("r")).orderBy("i").collect()]


def test_redaction_and_blank(spark):
    a, b = one(spark, tx.redact, "card 1111-2222-3333-4444, 123-45-6789, (212) 555-0199", None)
    assert a == "card [REDACTED CARD], [REDACTED SSN], (212XXX-XXXX" and b is None
    empty, null, full = one(spark, tx.analyze, " \n", None, "Hello\nthere")
    assert empty.error and null.error and full.error is None and full.text_document.summary == "there"


def test_receipt_takes_the_subtotal_for_the_total(spark):
    (r,) = one(spark, tx.receipt, "\n        Corner Shop\n        05/06/2024 14:30\n        2 x Bread $3.50\n        Subtotal: $7.00\n        Tax (8%): $0.56\n        Total: $7.56\n        VISA")
    assert (r.merchant, r.date, r.time, r.total, r.subtotal, r.tax, r.payment_method) == ("Corner Shop", "05/06/2024", "14:30", 7.0, 7.0, None, "visa")


def test_type_ties_and_double_counts(spark):
    assert one(spark, tx.doc_type, "name", "", "email x@email.com phone; form please sign") == ["business_card", "text_document", "business_card"]


def test_linear_key_pattern_equals_the_plain_one(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab: =\n;é", k=rng.randrange(40))) for _ in range(1500)]
    got = one(spark, tx.form_fields, *texts)
    for t, r in zip(texts, got, strict=True):
        want = {}
        for m in re.finditer(r"([\w\s]+)(?::|\s*=)\s*([^\n]+)", t):
            want[m[1].strip().lower()] = m[2].strip()
        assert r == want, repr(t)


def random_texts(spark, letters, seed, n=20_000, longest=40):
    rng = random.Random(seed)
    return spark.createDataFrame([("".join(rng.choices(letters, k=rng.randrange(longest))),) for _ in range(n)], "text string")


def test_linear_gap_pattern_equals_the_plain_one(spark):
    texts = random_texts(spark, "ab  \n\t;:é", 3)
    plain = rx.CASED + r"([\w\s]+?)\s{2,}([^\n]+)"
    pairs = lambda p: F.arrays_zip(rx.all_matches(F.col("text"), p, 1), rx.all_matches(F.col("text"), p, 2))
    rows = texts.select("text", F.to_json(pairs(plain)).alias("want"), F.to_json(pairs(tx.GAP_PAIR)).alias("got"))
    assert rows.where("want <> got").take(3) == [] and rows.where("want <> '[]'").count() > 5000


def test_linear_items_equal_the_plain_ones(spark):
    for seed, letters in ((4, "1 2.00x$\n\na "), (5, "12.34  \n"), (6, "1.00\n$x ab"), (7, "1 x\n\t2.50")):
        texts = random_texts(spark, letters, seed)
        text = F.col("text")
        plain = F.arrays_zip(*[rx.all_matches(text, tx.ITEM, g) for g in (1, 2, 3)])
        plain = F.filter(F.transform(plain, lambda x: F.struct(x["0"].try_cast("int").alias("q"), rx.strip(x["1"]).alias("d"), x["2"].cast("double").alias("p"))), lambda x: x["q"].isNotNull())
        mine = F.transform(tx.items(text), lambda x: F.struct(x["quantity"].alias("q"), x["description"].alias("d"), x["price"].alias("p")))
        rows = texts.select("text", F.to_json(plain).alias("want"), F.to_json(mine).alias("got"))
        assert rows.where("want <> got").take(3) == [] and rows.where("want <> '[]'").count() > 200, letters


def test_linear_entities_equal_the_plain_ones(spark):
    fields = [(rx.ANY_CASE, tx_name, rx.ENTITIES[tx_name], rx.LINEAR[tx_name]) for tx_name in rx.LINEAR] + [(rx.CASED, tx_name, rx.ENTITIES[tx_name], rx.LINEAR[tx_name]) for tx_name in rx.LINEAR]
    fields += [(rx.ANY_CASE if n == "addresses" else rx.CASED, n, ocr.FIELDS[n][0], ocr.LINEAR[n]) for n in ocr.LINEAR]
    alphabets = {
        "address": ["1", "22", "٣", " ", "\n", "St", "ave", "Way", "x", ",", ".", "-", ";", "é", "ſt"], "email": ["a", "b.", "@", "@", ".", "co", "c", "é", "_", "-", "|", " ", "+"],
        "price": ["1", "23", "٣", ".", ".50", "$", " ", "\t", "USD", "usd", "dollars", "EUR", "GBP", "x"],
    }
    for k, (flags, name, plain, linear) in enumerate(fields):
        letters = next(v for n, v in alphabets.items() if n[:4] == {"amou": "pric"}.get(name[:4], name[:4]))
        texts = random_texts(spark, letters, 20 + k, longest=24)
        rows = texts.select("text", rx.all_matches(F.col("text"), flags + plain).alias("want"), rx.all_matches(F.col("text"), flags + linear, 1).alias("got"))
        assert rows.where("want <> got").take(3) == [], (name, flags)
        assert rows.where("size(want) > 0").count() > 200, name


def test_linear_labels_equal_the_plain_ones(spark):
    day, label = r"(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})", r"\s*(?::\s*|\s*=\s*)?"
    plain = {
        "TOTAL": r"total\s*(?:amount)?(?:\s*:|\s*=)?\s*\$?\s*(\d+\.\d{2})", "AMOUNT": r"(?:total|amount)(?:\s*:|\s*=)?\s*\$?\s*(\d+\.\d{2})",
        "SUBTOTAL": rf"subtotal{label}\$?(\d+\.\d{{2}})", "TAX": rf"tax{label}\$?(\d+\.\d{{2}})", "ID_NUMBER": r"(?:id|license|number|#)\s*(?::\s*|\s*=\s*|\s+)?([A-Z0-9-]+)",
        "NAME": rf"name{label}(.*?)(?:\n|$)", "BIRTH": rf"(?:date of birth|birth date|dob|born){label}{day}",
        "ISSUED": rf"(?:issue|issued)\s*(?:date|on)?{label}{day}", "EXPIRES": rf"(?:expiration|expires|exp)\s*(?:date|on)?{label}{day}",
    }
    words = ["total", "subtotal", "amount", "tax", "id", "number", "#", "name", "born", "issue", "issued", "exp", "date", "on", ":", "=", " ", " ", "\n", "$", "1.50", "12", "1/2/20", "03-04-2021", "Xy", "."]
    texts, text = random_texts(spark, words, 77, longest=14), F.col("text")
    for name, old in plain.items():
        new = rx.ANY_CASE + getattr(rx, name)
        got = F.regexp_extract(rx.first(text, new), new, 1) if name == "NAME" else rx.group(text, new)
        want = F.when(F.rlike(text, F.lit(rx.ANY_CASE + old)), F.regexp_extract(text, rx.ANY_CASE + old, 1))
        rows = texts.select("text", want.alias("want"), got.alias("got"))
        assert rows.where("not want <=> got").take(3) == [] and rows.where("want is not null").count() > 100, name


def test_payment_is_the_first_of_the_list(spark):
    texts = ["Check and VISA", "american express or paypal", "CASH", "cashier", None, "", "credits debit", "master card", "MasterCard caſh", "DİSCOVER"]
    assert one(spark, tx.payment, *texts) == ["visa", "american express", "cash", None, None, None, "debit", None, "cash", "discover"]


OPERATORS = {
    "items": tx.items, "key_values": tx.key_values, "form": tx.form, "entities": tx.entities, "receipt": tx.receipt, "business_card": tx.business_card, "id_card": tx.id_card, "general": tx.general,
    "analyze": tx.analyze, "redact": tx.redact, "clean_lines": tx.clean_lines, "doc_type": tx.doc_type, "structured_info": ocr.structured_info,
}


def test_hostile_texts_take_linear_time(spark):
    n = 60_000
    pieces = ["1 ", "1 a ", "1", "a", "a b ", "a\n", " ", "\n", "1 \n", "1.50", "1\n\n", "=", "a  ", "a@", "a.b@c.", "$ ", "1 St ", "total ", "total = ", "id   ", "name", "www.a.", "http://a/", "Jan", "Jan ", "(555) ", "12/", "1-", "a:  \n", "k = v\n", "٣ "]
    hostile = [(p * n)[:n] for p in pieces] + ["3" + " " * n + "4", "1\n\n" * (n // 3) + "x 2.00", "a" * n + "@", "1" * n + " " * n, "total" + " " * n + "x", "id" + " " * n + "!", "issued" + " " * n, "a@" + "b." * n + "é", "www" + ".a" * n]
    half = [t[: len(t) // 2] for t in hostile]
    frames = [spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).cache() for texts in (half, hostile)]
    for f in frames:
        f.count()
    for name, fn in OPERATORS.items():
        run = lambda f: f.select(F.hash(F.to_json(F.struct(fn(F.col("text")).alias("r")))).alias("n")).agg(F.sum("n")).collect()  # noqa: B023, E731
        run(frames[0])  # code is generated and compiled
        took = []
        for f in frames:
            start = time.time()
            run(f)
            took.append(time.time() - start)
        assert took[1] < 2.5 * took[0] + 1.5, (name, took)


def test_blocks_follow_the_word_before(spark):
    rows = [(1, 3, i, w, c, t) for i, (w, c, t) in enumerate([("a", 9.0, 0), ("b", 9.0, 5), ("", 9.0, 99), ("c", -1.0, 50), ("d", 0.0, 10), ("e", 5.0, 16)])]
    words = spark.createDataFrame(rows, "doc_id long, psm int, pos int, text string, conf double, top int")
    assert [r.text for r in ocr.blocks(words).orderBy("block").collect()] == ["a b d", "e"]
    assert ocr.confidence(words).first().confidence == 8.0


def test_geometry(spark):
    q = spark.sql("select array(struct(300.0D as x, 300.0D as y), struct(100.0D as x, 100.0D as y), struct(300.0D as x, 100.0D as y), struct(100.0D as x, 300.0D as y)) as p")
    r = q.select(geometry.ordered(F.col("p")).alias("o")).select("o", geometry.size(F.col("o")).alias("s")).first()
    assert [(p.x, p.y) for p in r.o] == [(100, 100), (300, 100), (300, 300), (100, 300)] and (r.s.width, r.s.height) == (200, 200)


def test_throttle_and_debounce_at_equality(spark):
    rows = spark.sql("select 1 as k, id, timestamp_seconds(id) as ts from range(9)")
    assert [r.id for r in throttle.throttled(rows, "k", 2.0).orderBy("id").collect()] == [0, 3, 6]
    assert [r.id for r in throttle.debounced(rows, "k", 2.0).orderBy("id").collect()] == [0, 2, 4, 6, 8]


def test_split_sizes_and_evaluation(spark):
    rows = spark.range(103).withColumnRenamed("id", "k")
    assert classify.exact_split(rows, "k").where("is_test").count() == 20
    ev = spark.createDataFrame([("a", "a"), ("a", "b"), ("z", "a")], "true string, pred string")
    assert [(r.total, r.correct) for r in classify.evaluate(ev, ["a", "b"]).collect()] == [(2, 1)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in/x").mkdir(parents=True)
    (tmp_path / "in/x/a.png").write_bytes(b"1")
    (tmp_path / "in/b.JPG").write_bytes(b"2")
    got = {bytes(r.content): r.label for r in files.labelled_files(spark, str(tmp_path / "in")).collect()}
    assert got == {b"1": "x", b"2": "text_document"}
    sinks.write_json(spark.sql("select 1 as a, cast(null as string) as b"), str(tmp_path / "out"))
    assert json.loads(spark.read.text(str(tmp_path / "out")).first()[0]) == {"a": 1, "b": None}
