"""Pictures go to Python and back in batches of some megabytes, and no picture is made twice."""

import contextlib
import io
import tracemalloc

import numpy as np
import pandas as pd

from docloom.functions import pixels as px
from docloom.operators import enhancers, images

PAGE = np.full((200, 300, 3), 7, np.uint8)


def plan_of(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_portions_hold_some_megabytes():
    parts = list(images.portions(images.to_value(PAGE) for _ in range(200)))
    assert sum(map(len, parts)) == 200
    assert len(parts) > 3 and max(sum(len(v["data"]) for v in p) for p in parts) <= images.BATCH + PAGE.size
    assert list(images.portions(iter([None, None]))) == [[None, None]] and not list(images.portions(iter([])))


def test_small_batches_of_many_pictures(spark):
    """600 pages of 180,000 bytes in one partition: drawn from keys, changed, and read in another function."""
    keys = spark.range(600).coalesce(1)
    drawn = keys.select("id", images.pictures(keys["id"], lambda k: PAGE + np.uint8(k % 3), spark).alias("image"))
    changed = images.each(drawn, lambda a: images.to_value(a + np.uint8(1)), "out", images.IMAGE)

    def sizes(batches):
        for pdf in batches:
            yield pd.DataFrame({"n": [len(pdf)], "size": [sum(len(v["data"]) for v in pdf["out"])], "level": [max(v["data"][0] for v in pdf["out"])]})

    got = changed.select("out").mapInPandas(sizes, "n long, size long, level long").toPandas()
    assert got["n"].sum() == 600 and got["level"].max() == 10
    assert got["size"].max() <= 2 * images.BATCH


def test_a_lower_limit_of_the_caller_stays(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "1000000")
        images.small_batches(spark)
        assert spark.conf.get(key).rstrip("b") == "1000000"
    finally:
        spark.conf.set(key, before)


def test_pictures_are_coded_once(spark):
    rows = spark.createDataFrame([(1, images.to_value(PAGE)), (2, None)], f"id long, image {images.IMAGE}")
    coded = images.encoded(rows, "content", kind="jpeg").where("content is not null")
    back = images.decoded(coded, out="back")
    assert plan_of(coded).count("ArrowEvalPython") == 1
    assert plan_of(back).count("ArrowEvalPython") == 2
    assert [r["id"] for r in back.collect()] == [1]


def test_turning_holds_few_planes():
    """A page of 1,000 x 1,000 in three channels; places and weights are planes, not pictures."""
    tracemalloc.start()
    try:
        out = px.rotated(np.zeros((1000, 1000, 3), np.uint8), 2.0)
        assert out.shape == (1000, 1000, 3) and tracemalloc.get_traced_memory()[1] < 130e6
    finally:
        tracemalloc.stop()


def test_places_between_pixels():
    plane = np.array([[0, 100], [200, 40]], np.uint8)
    x, y = np.array([[0, 0.5, 1, 7]]), np.array([[0, 0.5, 1, np.nan]])
    assert px.sampled(plane, x, y).tolist() == [[0, 85, 40, 100]]
    three = np.stack([plane, 255 - plane, plane // 2], axis=2)
    assert px.sampled(three, x, y).tolist() == [[[0, 255, 0], [85, 170, 42], [40, 215, 20], [100, 155, 50]]]


def test_features_are_taken_once(spark):
    """Typing pictures whose features are known adds no Python."""
    rows = spark.createDataFrame([(1, images.to_value(PAGE)), (2, images.to_value(PAGE[:, :100]))], f"id long, image {images.IMAGE}")
    seen = images.features(rows)
    made, again = enhancers.typed(seen, features="features"), enhancers.typed(rows)
    assert plan_of(made).count("ArrowEvalPython") == 1
    told = lambda df: sorted(df.select("id", "doc_type", "confidence").collect())
    assert "features" in made.columns and told(made) == told(again)
