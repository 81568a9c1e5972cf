"""The corpus pipeline on a small fixture, stage by stage against plain versions."""

import os
import random
import subprocess
import sys
import re
import zlib

import pytest

import corpus_pipeline
from docloom.llm import common, queries, toxicity
from docloom.sources import shared

from . import cases
from .test_near import brute as near_classes

ITEM = "one two three four five six seven eight nine ten eleven twelve"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with nulls, copies, near copies, leaks, insults, clashing columns and repeated rows."""
    path = str(tmp_path_factory.mktemp("corpus"))
    texts = [*cases.texts(), f"before it {ITEM} after it", f"{ITEM[:-8]} other"]
    base = len(texts)
    for i in range(120):
        w = cases.prose(random.Random(i), 60).split(" ")
        if i % 6 == 0:
            w[3::9] = ["vile"] * len(w[3::9])
        texts.append(" ".join(w))
    cases.frame(spark, texts).write.parquet(f"{path}/documents.parquet")
    rows = [(base + i, 1, int(i % 6 == 0)) for i in range(0, 120)]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(7, ITEM), (8, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_against_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    toxic, exact, near, clean, pack = (f for _, f in corpus_pipeline.STAGES)

    out = toxic(spark, docs, folder)
    assert out.columns == columns
    kept = sorted((r.doc_id, r.text or "") for r in out.collect())
    assert kept == sorted((i, t or "") for i, t in rows if "vile" not in (t or "").split(" "))

    docs = common.written(out, "test")
    out = exact(spark, docs, folder)
    assert out.columns == columns
    best = {}
    for i, t in [(r.doc_id, r.text) for r in docs.collect()]:
        key = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        best[key] = min(best.get(key, (1, 0, "")), (-len(t or ""), i, t or ""))
    assert sorted((r.doc_id, r.text or "") for r in out.collect()) == sorted((i, t) for _, i, t in best.values())

    docs = common.written(out, "test")
    out = near(spark, docs, folder)
    assert out.columns == columns
    assert sorted(r.doc_id for r in out.collect()) == sorted({c for _, c in near_classes([(r.doc_id, r.text) for r in docs.collect()])})

    docs = common.written(out, "test")
    out = clean(spark, docs, folder)
    windows = [ITEM.split(" ")[i : i + 10] for i in range(3)]
    leaks = lambda t: any(cases.words(t)[i : i + 10] in windows for i in range(len(cases.words(t))))
    want = sorted(r.doc_id for r in docs.collect() if not leaks(r.text))
    assert sorted(r.doc_id for r in out.collect()) == want and len(want) < docs.count()

    packed = pack(spark, common.written(out, "test"), folder).collect()
    assert sorted({r.doc_id for r in packed}) == sorted(set(want))


def test_run_frees_what_it_wrote(spark, folder):
    with common.watched() as made:
        out = corpus_pipeline.run(spark, folder)
    assert out.count() > 50 and len(made) > 5 and len([p for p in made if p in shared._made]) == 1


def test_scratch_goes_when_it_is_released_and_at_the_end(spark):
    with common.watched() as outer:
        with common.watched() as inner:
            common.written(spark.range(3), "a")
        common.written(spark.range(3), "b")
    assert len(outer) == 2 and inner == outer[:1] and all(os.path.isdir(p) for p in outer)
    common.released(spark, *inner)
    assert [os.path.isdir(p) for p in outer] == [False, True]
    code = (
        "from pyspark.sql import SparkSession; from docloom.llm import common\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {0!r}).getOrCreate()\n"
        "common.written(s.range(3), 'x'); s.stop()\n"
    )
    held = os.path.dirname(outer[0])
    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    subprocess.run([sys.executable, "-c", code.format(held)], check=True, cwd=home, env={**os.environ, "PYTHONPATH": home})
    assert os.listdir(f"{held}/docloom") == []


def test_empty_tables(spark, tmp_path):
    cases.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_queries_return_a_row_for_every_document(spark, folder):
    spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string").write.mode("ignore").parquet(f"{folder}/pages.parquet")
    spark.range(12).selectExpr("id as vec_id", "transform(sequence(1, 64), i -> cast(i * id as float)) as embedding").write.mode("ignore").parquet(f"{folder}/embeddings.parquet")
    n = spark.read.parquet(f"{folder}/documents.parquet").count()
    others = {"op7_warc": 1, "op11_html_extract": 1, "op12_ball_kmeans": 12}
    for name, query in queries.queries().items():
        got = query(spark, folder).count()
        assert got >= n if name == "op5_packing" else got == others.get(name, n), name


def test_scorer_words_are_hashed_as_documented():
    assert toxicity._buckets(b"moron") == [zlib.crc32(x) % 2**20 for x in (b"moron", b"\x01moro")]
