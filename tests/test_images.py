import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.functions import pixels as px
from docloom.operators import images as im
from docloom.plans import image_plans


def page(h=220, w=320, box=(40, 50, 180, 270), colour=True):
    a = np.full((h, w), 30, np.uint8)
    y0, x0, y1, x1 = box
    a[y0:y1, x0:x1] = 240
    for y in range(y0 + 15, y1 - 15, 12):
        a[y : y + 3, x0 + 20 : x1 - 20] = 20
    return np.repeat(a[..., None], 3, axis=2) if colour else a


@pytest.fixture(scope="module")
def frames(spark):
    bad = {"h": 5, "w": 5, "channels": 3, "data": b"x"}
    rows = [(1, im.to_value(page()), "form"), (2, im.to_value(page(colour=False)), "receipt"), (3, None, "form"), (4, bad, None)]
    return spark.createDataFrame(rows, f"id long, image {im.IMAGE}, kind string")


def rows(df, col):
    return {r["id"]: r[col] for r in df.select("id", col).collect()}


def test_pixel_kernels_follow_their_definitions():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 256, (40, 33, 3)).astype(np.uint8)
    assert (px.from_hsv(px.hsv(a)) == a).all() and (px.from_lab(px.lab(a)) == a).all()
    plane = px.gray(a)
    p = np.pad(plane.astype(float), 2, mode="reflect")
    k = np.outer(px.gaussian(5), px.gaussian(5))
    want = [[(p[y : y + 5, x : x + 5] * k).sum() for x in range(33)] for y in range(40)]
    assert np.abs(px.blur(plane) - np.array(want)).max() <= 0.5001
    two = np.where(plane > 128, 200, 50).astype(np.uint8)
    assert 50 <= px.otsu_level(two) < 200 and (px.otsu(two) == np.where(two == 200, 255, 0)).all()
    ring = np.zeros((30, 30), np.uint8)
    ring[5:25, 5:25], ring[10:20, 10:20] = 255, 0
    assert px.n_outlines(ring) == 2 and px.components(ring).max() == 1
    assert px.n_outlines(np.zeros((4, 4))) == 0


def test_components_match_a_search():
    rng = np.random.default_rng(1)
    for corners in (True, False):
        mask = rng.random((25, 31)) < 0.5
        got, seen = px.components(mask, corners), {}
        near = [(y, x) for y in (-1, 0, 1) for x in (-1, 0, 1) if (y or x) and (corners or not y * x)]
        for start in zip(*np.nonzero(mask), strict=True):
            todo = [start]
            while todo:
                y, x = at = todo.pop()
                if at not in seen and 0 <= y < 25 and 0 <= x < 31 and mask[at]:
                    seen[at] = start if start not in seen else seen[start]
                    todo += [(y + dy, x + dx) for dy, dx in near]
        pairs = {(got[k], v) for k, v in seen.items()}
        assert len(pairs) == got.max() == len(set(seen.values())) and (got > 0).sum() == len(seen)


def test_warp_of_the_known_square():
    quad = np.array([[300, 100], [100, 300], [100, 100], [300, 300]])
    a = np.zeros((400, 400), np.uint8)
    a[100:301, 100:301] = 9
    out = px.warp(a, quad)
    assert out.shape == (200, 200) and (out == 9).all()


def test_png_round_trip(spark, frames):
    coded = im.encoded(frames.where("id < 3"))
    back = rows(im.decoded(coded.select("id", F.col("png").alias("content"))), "image")
    assert np.array_equal(im.to_array(back[1]), page()) and np.array_equal(im.to_array(back[2]), page(colour=False))
    assert im.decoded(spark.createDataFrame([(1, b"no picture"), (2, None)], "id long, content binary")).count() == 0


def test_detection_and_warp(frames):
    found = im.detected(frames)
    quads = rows(found, "quad")
    assert quads[3] is None and quads[4] is None
    for i in (1, 2):
        got = np.array([[p["x"], p["y"]] for p in quads[i]])
        assert np.abs(got - [[50, 40], [269, 40], [269, 179], [50, 179]]).max() <= 3
    made = rows(im.warped(found), "document")
    assert abs(made[1]["w"] - 219) <= 5 and abs(made[1]["h"] - 139) <= 5 and made[1]["channels"] == 3 and made[3] is None
    assert rows(im.centre_crop(frames), "document")[1]["h"] == 220 - 2 * 22


def test_enhancement_of_every_type_and_mode(spark, frames):
    small = im.to_value(page(60, 80, (10, 10, 50, 70)))
    kinds = [*im.BY_TYPE, "unknown", None]
    df = spark.createDataFrame([(i, small, k) for i, k in enumerate(kinds)], frames.schema)
    out = rows(im.enhanced(df, "kind"), "enhanced")
    for i, k in enumerate(kinds):
        a = im.to_array(out[i])
        assert a.shape == (60, 80, 3)
        if k not in ("business_card", "id_card"):
            assert set(np.unique(a)) <= {0, 255}
    got = im.ocr_variants(frames, "id").select("id", "variant").collect()
    assert sorted((r.id, r.variant) for r in got) == sorted((i, m) for i in (1, 2) for m in im.BY_MODE)
    assert rows(im.enhanced_as(frames, "inverted"), "enhanced")[3] is None


def test_features_quality_and_rules(frames):
    f = rows(im.features(frames), "features")
    assert len(f[1]) == 39 and f[1][0] == 320 / 220 and abs(sum(f[1][7:]) - 1) < 1e-9 and f[3] is None
    assert f[1] == f[2]
    q = im.quality(frames)
    got = {r.id: r for r in q.select("id", "quality", im.good_enough(F.col("quality")).alias("ok")).collect()}
    plane = page(colour=False)
    assert abs(got[1].quality.brightness - plane.mean()) < 1e-9 and got[1].ok and got[1].quality.dark == ((plane < 128).mean() > 0.5)
    assert rows(im.rule_typed(frames), "doc_type")[1] in ("form", "text_document")


def test_rotation_is_undone(spark):
    a = np.full((260, 300), 255, np.uint8)
    a[60:200:20, 20:280] = 0
    df = spark.createDataFrame([(1, im.to_value(px.rotated(a, 4)), None)], f"id long, image {im.IMAGE}, kind string")
    straight = im.to_array(rows(im.straightened(df), "straight")[1])
    assert np.abs(straight[40:220, 60:240].astype(int) - a[40:220, 60:240]).mean() < np.abs(px.rotated(a, 4)[40:220, 60:240].astype(int) - a[40:220, 60:240]).mean() / 2


def test_augmentation_depends_on_key_and_copy_alone(frames):
    good = frames.where("id < 3")
    a, b = (sorted((r.id, r.copy, bytes(r.image["data"])) for r in im.augmented(d, "id").collect()) for d in (good, good.repartition(4)))
    assert a == b and len(a) == 8 and a[0][2] == page().tobytes() and a[1][2] != a[0][2]


def _means_by_definition(plane, patch=7, window=21, strength=10):
    """Patches compared place by place, with borders mirrored: the filter's definition, without tables or strips."""
    base, box = plane.astype(float), np.full(patch, 1 / patch)
    total, weight = np.zeros_like(base), np.zeros_like(base)
    for _, _, moved in px.shifts(base, window // 2):
        k = np.exp(-px.separable((moved - base) ** 2, box) / strength**2)
        weight += k
        total += k * moved
    return px.clip8(total / weight)


def test_non_local_means_by_table_equal_the_definition():
    rng = np.random.default_rng(5)
    page = px.gray(image_plans.draw_page(4))
    noisy = px.clip8(page + rng.normal(0, 12, page.shape))
    planes = [noisy, px.adaptive(page, 15, 5), px.adaptive(noisy), np.where(page > 100, 120, 110).astype(np.uint8), np.full((9, 9), 3, np.uint8)]
    planes += [rng.integers(0, 256, shape).astype(np.uint8) for shape in ((1, 1), (1, 30), (4, 4), (9, 40), (90, 13))]
    for plane in planes:
        assert np.array_equal(px.non_local_means(plane), _means_by_definition(plane)), plane.shape


def test_non_local_means_count_two_levels():
    """A thresholded page takes a fraction of the time of the definition, which took 650 ms."""
    page = px.adaptive(px.gray(image_plans.draw_page(4)), 15, 5)
    ratio = min(_seconds(px.non_local_means, page) for _ in range(3)) / min(_seconds(_means_by_definition, page) for _ in range(2))
    assert ratio < 0.4


def test_bilateral_weights_by_table_equal_the_definition():
    rng = np.random.default_rng(6)
    for img in (rng.integers(0, 256, (40, 30)).astype(np.uint8), rng.integers(0, 256, (30, 40, 3)).astype(np.uint8)):
        base = img.astype(float)
        total, weight = np.zeros_like(base), np.zeros(img.shape[:2])
        for dy, dx, moved in px.shifts(base, 4):
            if dy * dy + dx * dx <= 16:
                far = np.abs(moved - base) if img.ndim == 2 else np.abs(moved - base).sum(axis=2)
                k = np.exp(-(far**2 + dy * dy + dx * dx) / 11250)
                weight += k
                total += moved * (k if img.ndim == 2 else k[..., None])
        assert np.array_equal(px.bilateral(img), px.clip8(total / (weight if img.ndim == 2 else weight[..., None])))


def _seconds(make, *args) -> float:
    import time

    start = time.perf_counter()
    make(*args)
    return time.perf_counter() - start


def test_hull_of_a_filled_shape_looks_at_the_ends_of_its_columns():
    def by_all_points(points):
        pts = sorted(set(map(tuple, points.tolist())))

        def chain(seq):
            out = []
            for p in seq:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                    out.pop()
                out.append(p)
            return out[:-1]

        return np.array(pts if len(pts) < 3 else chain(pts) + chain(pts[::-1]), float)

    rng = np.random.default_rng(9)
    for n, span in ((1, 1), (2, 3), (5, 2), (9, 3), (40, 60), (900, 60)):
        points = rng.integers(0, span, (n, 2))
        for p in (points, points * [0, 1], points * [1, 0]):
            assert np.array_equal(px.hull(p), by_all_points(p)), (n, span)
    disk = np.argwhere(np.hypot(*np.mgrid[-150:151, -150:151]) < 150)
    assert np.array_equal(px.hull(disk), by_all_points(disk))
    assert min(_seconds(px.hull, disk) for _ in range(3)) < 0.5 * min(_seconds(by_all_points, disk) for _ in range(3))


def test_components_are_numbered_in_reading_order():
    rng = np.random.default_rng(10)
    for shape in ((1, 1), (1, 20), (20, 1), (17, 23)):
        for share in (0.0, 0.4, 0.7, 1.0):
            mask = rng.random(shape) < share
            for corners in (True, False):
                want, n = np.zeros(shape, int), 0
                for y, x in np.argwhere(mask).tolist():
                    if want[y, x]:
                        continue
                    n, todo = n + 1, [(y, x)]
                    while todo:
                        i, j = todo.pop()
                        if 0 <= i < shape[0] and 0 <= j < shape[1] and mask[i, j] and not want[i, j]:
                            want[i, j] = n
                            todo += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1) if corners or not a or not b]
                assert np.array_equal(px.components(mask, corners), want)


def test_non_local_means_leave_settled_pixels():
    """Pages of dark and light tones, with specks and soft edges, give the definition's pixels; a clean page takes a fraction of a noisy one's time."""
    rng = np.random.default_rng(12)
    page = px.gray(image_plans.draw_page(4))
    planes = [page[:70, :90], 255 - page[-60:, -80:], np.where(page > 100, 232, page)[20:90, 10:99]]
    for low, high in ((0, 255), (40, 230), (30, 210), (20, 190)):
        mask = (page > 100)[:60, :80] ^ (rng.random((60, 80)) < 0.004)
        planes += [np.where(mask, high, low).astype(np.uint8), (np.where(mask, high, low) + rng.integers(0, 2, mask.shape) * (rng.random(mask.shape) < 0.01)).astype(np.uint8)]
    planes += [(rng.integers(0, 2, shape) * 200 + 20).astype(np.uint8) for shape in ((1, 30), (4, 4), (12, 9), (40, 5))]
    for plane in planes:
        assert np.array_equal(px.non_local_means(plane), _means_by_definition(plane)), plane.shape
    noisy = px.clip8(page + rng.normal(0, 3, page.shape))
    assert min(_seconds(px.non_local_means, page) for _ in range(3)) < 0.3 * min(_seconds(px.non_local_means, noisy) for _ in range(2))


def test_pictures_of_equal_channels_are_worked_on_as_one_plane(monkeypatch):
    from docloom.operators import enhancers

    rng = np.random.default_rng(13)
    grown = [np.repeat(a[..., None], 3, axis=2) for a in (rng.integers(0, 256, (40, 50)).astype(np.uint8), np.arange(256, dtype=np.uint8)[None].repeat(9, 0))]
    makes = [enhancers.comprehensive, *(lambda a, m=m: im.mode_pixels(a, m) for m in ("glare", "hdr")), lambda a: im._as_card(a, False), px.bilateral]
    drawn = image_plans.draw_page(4)
    short, got = min(_seconds(enhancers.comprehensive, drawn) for _ in range(3)), [[make(a) for a in [*grown, drawn]] for make in makes]
    monkeypatch.setattr(px, "one_plane", lambda img: img if img.ndim == 2 else None)
    assert all(np.array_equal(x, make(a)) for make, done in zip(makes, got, strict=True) for x, a in zip(done, [*grown, drawn], strict=True))
    assert short < 0.8 * min(_seconds(enhancers.comprehensive, drawn) for _ in range(3))


def test_outlines_are_counted_by_runs():
    page = px.gray(image_plans.draw_page(4))
    ink = px.adaptive(page)
    assert min(_seconds(px.n_outlines, ink) for _ in range(5)) < 3 * min(_seconds(px.adaptive, page) for _ in range(5))


def test_all_angles_are_found_together():
    edges = np.zeros((260, 300), np.uint8)
    edges[50::40, 20:280], edges[10:250, 30::90] = 255, 255
    y, x = np.nonzero(edges)
    want = []
    for a in range(180):
        n = np.unique(np.rint(x * np.cos(np.radians(a)) + y * np.sin(np.radians(a))), return_counts=True)[1]
        want += [a - 90 if 45 <= a <= 135 else a] * int((n > 150).sum())
    assert len(want) > 5 and px.line_angles(edges, 150).tolist() == want


def test_means_that_single_precision_leaves_open_are_taken_again(monkeypatch):
    """All pixels taken again in double precision, and none, give the definition's pixels; half levels are told apart."""
    rng = np.random.default_rng(14)
    planes = [rng.integers(90, 120, (30, 34)).astype(np.uint8), rng.integers(0, 256, (4, 25)).astype(np.uint8)]
    for unsure in (2.0, px.UNSURE):
        monkeypatch.setattr(px, "UNSURE", unsure)
        for plane in planes:
            assert np.array_equal(px.non_local_means(plane), _means_by_definition(plane)), (unsure, plane.shape)
