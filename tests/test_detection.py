import numpy as np
import pytest

from docloom.functions import pixels as px
from docloom.operators import detection, enhancers, images
from docloom.plans import image_plans


@pytest.mark.parametrize(("name", "within"), [("simple", 4), ("improved", 4), ("advanced", 4), ("fast", 16), ("exact", 6)])
def test_every_tuning_finds_a_drawn_page(name, within):
    for k in range(5):
        h, w, x0, y0, x1, y1 = image_plans._shape(k)
        quad = detection.corners_of(image_plans.draw_page(k), detection.tuning(name))
        assert np.abs(quad - [[x0, y0], [x1, y0], [x1, y1], [x0, y1]]).max() <= within
    assert detection.corners_of(np.full((90, 120, 3), 7, np.uint8), detection.tuning(name)) is None


def test_sensitivity_boxes_other_shapes():
    img = np.zeros((200, 200, 3), np.uint8)
    y, x = np.mgrid[:200, :200]
    img[(y > 40) & (y < 160) & (np.abs(x - 100) < (y - 40))] = 255  # a triangle
    assert detection.corners_of(img, detection.tuning("advanced", 0.4)) is None
    boxed = detection.corners_of(img, detection.tuning("advanced", 0.9))
    assert boxed is not None and px.area(boxed) > 120 * 120


def test_corner_refinement_takes_the_nearest_edge():
    edges = np.zeros((60, 60), np.uint8)
    edges[28, 31] = edges[35, 35] = 255
    got = detection.refined(np.array([[30, 30], [55, 5], [30, 30], [5, 55]], np.float32), edges)
    assert got.tolist() == [[31, 28], [55, 5], [31, 28], [5, 55]]


def test_smallest_box_of_a_turned_rectangle():
    c, s = np.cos(0.4), np.sin(0.4)
    flat = np.array([[0, 0], [40, 0], [40, 10], [0, 10], [20, 5]]) @ np.array([[c, s], [-s, c]])
    assert px.area(px.smallest_box(px.hull(flat))) == pytest.approx(400)


def test_resizing_keeps_lines_and_constants():
    ramp = np.tile(np.arange(0, 200, 10, dtype=np.uint8), (8, 1))
    for cubic in (False, True):
        big = px.resized(ramp, 16, 40, cubic)
        assert big.shape == (16, 40) and np.abs(big[5, 4:-4].astype(float) - (np.arange(40) * 5 - 2.5)[4:-4]).max() <= 1
        assert (px.resized(np.full((5, 7, 3), 9, np.uint8), 11, 3, cubic) == 9).all()
    rng = np.random.default_rng(1)
    img = rng.integers(0, 256, (9, 9, 3)).astype(np.uint8)
    assert (px.from_yuv(px.yuv(img)) == img).all()


def test_modes_choose_themselves():
    light, dark = np.full((40, 40, 3), 220, np.uint8), np.full((40, 40, 3), 30, np.uint8)
    gaudy = light.copy()
    gaudy[:, ::2] = [255, 20, 20]
    assert [enhancers.display_mode(x) for x in (light, dark, gaudy)] == ["text", "inverted", "color"]
    assert [enhancers.light_mode(x) for x in (light, dark, gaudy)] == ["text", "photo", "color"]
    assert (enhancers.improved(dark) == dark).all() and (enhancers.simple(light, "none") == light).all()
    assert [n for n, _ in enhancers.variants(light)] == ["otsu", "adaptive", "adaptive_mean", "equalised", "bilateral", "edged", "closed"]
    assert len(enhancers.variants(dark)) == 8 and len(enhancers.variants(light, "dark")) == 8
    assert enhancers.prepared(light[:20]).shape == (1000, 2000)


def test_nulls_and_bad_images_give_null(spark):
    good = images.to_value(image_plans.draw_page(1))
    rows = spark.createDataFrame([(1, good), (2, None), (3, {"h": 3, "w": 3, "channels": 1, "data": b"x"})], f"k int, image {images.IMAGE}")
    out = enhancers.document_enhanced(detection.detected_by(images.background(images.histogram(rows)), "simple"), "bw")
    got = {r.k: (r.quad, r.enhanced, r.background, r.histogram) for r in out.collect()}
    assert all(v is not None for v in got[1]) and got[2] == got[3] == (None,) * 4
    assert enhancers.reading_variants(rows, "k").select("k").distinct().count() == 1
