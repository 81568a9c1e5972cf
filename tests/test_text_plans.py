import re

from pyspark.sql import functions as F

from docloom.functions import rx
from docloom.plans import text_plans as tp


def test_entities_keep_zip_codes(spark, tmp_path):
    keys = [7, 9999, 10000, 12345, 149999]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"{tmp_path}/customer.parquet")
    text = {r.k: r.t for r in spark.read.parquet(f"{tmp_path}/customer.parquet").select(F.col("c_custkey").alias("k"), F.expr(tp.NOTE).alias("t")).collect()}
    got = sorted((r.c_custkey, r.value) for r in tp.txt_1_entities(spark, str(tmp_path)).where("entity = 'zip_code'").collect())
    assert got == sorted((k, x) for k, t in text.items() for x in re.findall(rx.ENTITIES["zip_code"], t))
    assert got == [(10000, "10000"), (12345, "12345")]


def test_analyze_returns_the_whole_record(spark, tmp_path):
    texts = ["Shop\nreceipt total: 5.00\ncash subtotal 4.00 tax 1.00", "Name Phone Fax Website\nBoss\nfirm", "ID: S1 birth eyes hair height weight",
             "please sign and submit the form\nsign here", "chapter one\nsection 12345", " ", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in tp.txt_10_analyze(spark, str(tmp_path)).collect()}
    parts = ("receipt", "business_card", "id_card", "form", "text_document")
    for i, kind in enumerate(parts):
        r = got[i]
        assert r.type == kind and not r.is_error and [p for p in parts if r[p] is not None] == [kind]
    assert got[0].receipt.merchant == "Shop" and got[3].form.signature and got[4].text_document.title == "chapter one"
    assert got[4].metadata == {"zip_code": ["12345"]}
    assert all(got[i].is_error and got[i].error and got[i].type is None and got[i].metadata is None for i in (5, 6))


def test_truncations_match_plain_slices(spark, tmp_path):
    texts = [None, "", "ab", "é" * 200, "é" * 201, "x\n" * 250, "ab " * 167, "word " * 900]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cut = lambda t, n: t[:n] + "..." if t and len(t) > n else t
    got = {r.doc_id: (r.head, r.preview, r.excerpt) for r in tp.srt_12_truncated(spark, str(tmp_path)).collect()}
    assert got == {i: (t and t[:100] if t else t, cut(t, 200), cut(t, 500)) for i, t in enumerate(texts)}
