import json
import os

from pyspark.sql import functions as F

from docloom.operators import classify
from docloom.sources import files, sinks
from docloom.streaming import workers


def test_split_is_exact_with_repeated_and_null_keys(spark):
    for keys in ([None] * 50 + list(range(50)), [i % 7 for i in range(103)], [1] * 40, [i // 2 for i in range(100)], [], [5]):
        rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, i int").repartition(3)
        out = classify.exact_split(rows, "k").collect()
        assert sorted(r.i for r in out) == list(range(len(keys)))
        assert sum(r.is_test for r in out) == int(len(keys) * 0.2)


def test_worker_hands_on_what_it_gets_and_queue_keeps_the_first(spark, tmp_path):
    rows = spark.sql("select id % 2 as k, id as event_id, timestamp_seconds(id / 10) as ts from range(9)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    workers.run(stream, lambda b: b.select("k", "event_id"), workers.batch_folder(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(9))
    assert sorted(r.event_id for r in workers.queued(rows, "k", 2).collect()) == [0, 1, 2, 3]
    assert sorted(r.event_id for r in workers.queued(rows, "k", 1, newest=True).collect()) == [7, 8]
    assert workers.captured(rows, F.when(F.col("k") == 1, True)).count() == 4


def test_newest_files_and_frames(spark, tmp_path):
    for i in range(4):
        (tmp_path / f"{i}.png").write_bytes(bytes([i]))
        os.utime(tmp_path / f"{i}.png", (1_700_000_000 + i % 3,) * 2)
    (tmp_path / "x.txt").write_bytes(b"no")
    assert {bytes(r.content) for r in files.newest_files(spark, str(tmp_path), 2).collect()} == {b"\2", b"\1"}
    workers.run(files.frames(spark, str(tmp_path)), lambda b: b.select("content"), workers.batch_folder(str(tmp_path / "out")), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4


def test_plain_fields(spark):
    rows = spark.sql("select named_struct('a', 1, 'b', array(1, 2), 'c', map('x', 1.5D), 'd', named_struct('e', null, 'f', array('g')), 'h', cast(null as array<int>)) as analysis union all select null")
    texts = [json.loads(r.j) if r.j else None for r in rows.select(sinks.analysis_json(rows).alias("j")).collect()]
    assert texts[0] == {"a": 1, "b": ["1", "2"], "c": {"x": "1.5"}, "d": {"e": None, "f": '["g"]'}, "h": None} and texts[1] is None
    kept = json.loads(rows.select(sinks.analysis_json(rows, keep_scalars=True).alias("j")).first().j)
    assert kept["b"] == [1, 2]


def test_models_fall_back_to_rules(spark, tmp_path):
    from pyspark.ml.functions import array_to_vector

    rows = spark.createDataFrame([(i, [0.5 + i % 3, i / 40.0]) for i in range(40)], "k int, f array<double>").select("k", array_to_vector("f").alias("features"), (F.col("k") % 3).cast("double").alias("label"))
    assert {(r.doc_type, r.confidence) for r in classify.predict_or_rules(None, rows.where("k = 0"), []).collect()} == {("receipt", 0.6)}
    model = classify.train(rows, trees=5, depth=3)
    assert classify.save(model, str(tmp_path / "m")) and not classify.save(None, str(tmp_path / "n")) and classify.load(str(tmp_path / "n")) is None
    got = classify.predict_or_rules(classify.load(str(tmp_path / "m")), rows, ["a", "b"]).collect()
    assert {r.doc_type for r in got} >= {"a", "b", "text_document"}
    assert all((r.confidence == 0.5) == (r.doc_type not in "ab") for r in got)
