import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from docloom.streaming import keyed, throttle, workers

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "k long, id long, ts timestamp, v long, said string"


def rows(n=240, seed=5):
    rng = random.Random(seed)
    return [(rng.choice([1, 2, 2, 2, None]), i, DAY + dt.timedelta(seconds=rng.randrange(n), microseconds=rng.choice([0, 0, 5])), rng.choice([None, None, i]), rng.choice([None, "a"])) for i in range(n)]


def files(spark, path, data, late, layout):
    """Writes data in files, in an order that is late by `late` seconds at most; the last file has the tick that ends the stream."""
    rng = random.Random(layout)
    line = sorted(data, key=lambda r: ((r[2] - DAY).total_seconds() + rng.random() * late * 0.9, r[1]))
    cuts = sorted(rng.sample(range(1, len(line)), layout - 1)) if layout > 1 else []
    for a, z in zip([0, *cuts], [*cuts, len(line)], strict=True):
        part = line[a:z]
        rng.shuffle(part)
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)
    spark.createDataFrame([(-1, -1, DAY + dt.timedelta(days=300), None, None)], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def stream(spark, path, per_batch=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(path)


def ended(spark, df, path):
    q = keyed.started(df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True))
    q.awaitTermination()
    state = q.lastProgress["stateOperators"]
    return [r for r in spark.read.schema(df.schema).parquet(f"{path}/out").collect() if r.id >= 0], state


@pytest.mark.parametrize("layout", [1, 4])
def test_streams_equal_batches_whatever_the_files(spark, tmp_path, layout):
    data, late = rows(), 30
    batch = spark.createDataFrame(data, SCHEMA)
    files(spark, str(tmp_path / "in"), data, late, layout)
    source = lambda: stream(spark, str(tmp_path / "in"))
    delay = f"{late} seconds"
    for name, made, want in (
        ("throttle", keyed.throttled_stream(source(), "k", 7.0, order="id", late=delay), throttle.throttled(batch, "k", 7.0, order="id")),
        ("debounce", keyed.throttled_stream(source(), "k", 7.0, True, order="id", late=delay), throttle.debounced(batch, "k", 7.0, order="id")),
        ("held", keyed.held_stream(source(), "k", "v", order="id", late=delay), throttle.last_value(batch, "k", "v", ["ts", "id"])),
        ("first", keyed.queued_stream(source(), "k", 2, "20 seconds", order="id", late=delay), workers.queued(batch, "k", 2, "20 seconds", order="id")),
        ("newest", keyed.queued_stream(source(), "k", 1, "20 seconds", order="id", late=delay, newest=True), workers.queued(batch, "k", 1, "20 seconds", order="id", newest=True)),
    ):
        got, state = ended(spark, made, tmp_path / name)
        assert sorted(map(repr, got)) == sorted(map(repr, want.select(*made.columns).collect())), name
        assert {r.said for r in got} == {None, "a"}
        if name == "throttle":  # only the tick is left: it waits, and has its alarm
            assert state[0]["numRowsTotal"] <= 4 and state[0]["numRowsRemoved"] > 0, state


def test_values_are_forgotten(spark, tmp_path):
    data = [(1, 0, DAY, 5, None), (1, 1, DAY + dt.timedelta(seconds=8), None, None), (1, 2, DAY + dt.timedelta(seconds=11), None, "a"), (1, 3, DAY + dt.timedelta(seconds=12), 9, None), (1, 4, DAY + dt.timedelta(seconds=40), None, None)]
    files(spark, str(tmp_path / "in"), data, 0, 3)
    got, _ = ended(spark, keyed.held_stream(stream(spark, str(tmp_path / "in")), "k", "v", order="id", late="0 seconds", keep=10.0), tmp_path / "x")
    assert [r.held for r in sorted(got, key=lambda r: r.id)] == [5, 5, None, 9, None]


def test_frames_without_words_come_out_once(spark, tmp_path):
    data = [r for r in rows(120) if r[0] is not None]
    files(spark, str(tmp_path / "in"), data, 20, 3)
    said = lambda df: df.where("id < 0 or id % 3 > 0").select("id", (F.col("ts") + F.make_dt_interval(secs=F.col("id") % 20)).alias("said_at"), F.concat(F.lit("t"), "id").alias("text"))
    source = lambda: stream(spark, str(tmp_path / "in"))
    got, _ = ended(spark, workers.recognised(source(), said(source()), "id", within="10 seconds", late="25 seconds").select("id", "recognised"), tmp_path / "y")
    want = [(i, f"t{i}" if i % 3 and i % 20 <= 10 else "No text detected") for _, i, *_ in data]
    assert sorted(map(tuple, got)) == sorted(want)
    batch = spark.createDataFrame(data, SCHEMA)
    assert sorted((r.id, r.recognised) for r in workers.recognised(batch, said(batch), "id").collect()) == sorted(want)


def test_spaced_jumps():
    import numpy as np

    times = np.array([0, 1, 1, 5, 9, 10, 30])
    assert keyed.spaced(times, 5, None)[0].tolist() == [0, 3, 5, 6]
    places, last = keyed.spaced(times, 5, 4)
    assert places.tolist() == [4, 6] and last == 30
    assert keyed.spaced(times[:0], 5, 7)[1] == 7 and keyed.spaced(times, 0, None)[0].tolist() == list(range(7))


def test_state_grows_by_groups_not_by_keys(spark, tmp_path, monkeypatch):
    """400 keys that each carry a value to the end lie in four groups."""
    monkeypatch.setattr(keyed, "GROUPS", 4)
    data = [(i % 400, i, DAY + dt.timedelta(seconds=i), i if i < 400 else None, "a") for i in range(800)]
    files(spark, str(tmp_path / "in"), data, 0, 2)
    got, state = ended(spark, keyed.held_stream(stream(spark, str(tmp_path / "in")), "k", "v", order="id", late="0 seconds"), tmp_path / "z")
    assert sorted((r.id, r.held) for r in got) == [(i, i % 400) for i in range(800)]
    assert state[0]["numRowsTotal"] <= 12, state


def test_a_slot_in_many_files_is_one_micro_batch(spark, tmp_path):
    from docloom.plans import flow_plans

    events = spark.range(240).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"))
    events.repartition(24).write.parquet(str(tmp_path / "events.parquet"))
    made = flow_plans._stream(spark, str(tmp_path), str(tmp_path / "events.parquet"))
    q = made.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    read = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert len(read) == flow_plans.SLOTS + 2 and sum(read) == 240


def test_the_newest_row_of_an_interval_is_an_aggregate(spark, tmp_path):
    data = [r for r in rows(200) if r[0] is not None]
    files(spark, str(tmp_path / "in"), data, 10, 2)
    got, state = ended(spark, keyed.queued_stream(stream(spark, str(tmp_path / "in")), "k", 1, "20 seconds", order="id", late="10 seconds"), tmp_path / "q")
    want = workers.queued(spark.createDataFrame(data, SCHEMA), "k", 1, "20 seconds", order="id")
    assert sorted(map(tuple, got)) == sorted(map(tuple, want.collect()))
    assert [s["operatorName"] for s in state] == ["stateStoreSave"]
