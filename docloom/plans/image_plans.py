"""Queries of the image operators. Pages are drawn from keys: a light sheet with five lines on a
dark ground, so corners, sizes and levels are known. Where a result follows from these, the SQL
computes it from the keys; other pictures are given as checksums, without SQL.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.operators import classify, detection, enhancers, images

from .text_plans import table

K = "s_suppkey"
GROUND, SHEET, INK = 40, 230, 20


def _shape(k: int) -> tuple[int, int, int, int, int, int]:
    """Height, width and the sheet's left, top, right and bottom."""
    h, w = 160 + k % 3 * 10, 220 + k % 4 * 10
    return h, w, 12 + k % 9, 10 + k % 7, w - 20 + k % 5, h - 22 + k % 6


def draw_page(k: int) -> np.ndarray:
    h, w, x0, y0, x1, y1 = _shape(k)
    img = np.full((h, w, 3), GROUND, np.uint8)
    img[y0:y1, x0:x1] = SHEET
    for y in range(y0 + 20, y0 + 110, 18):
        img[y : y + 4, x0 + 20 : x1 - 20] = INK
    return img


def draw_lines(k: int) -> np.ndarray:
    """Three lines that fall by k % 5 degrees to the right."""
    img = np.full((200, 320, 3), 255, np.uint8)
    x = np.arange(10, 310)
    for top in (40, 90, 140):
        y = np.rint(top + np.tan(np.radians(k % 5)) * x).astype(int)
        for d in range(3):
            img[y + d, x] = 0
    return img


def draw_square(k: int) -> np.ndarray:
    return np.full((80 + k % 5 * 10, 130), k % 256, np.uint8)


def drawn(spark: SparkSession, sf_dir: str, draw=draw_page) -> DataFrame:
    """s_suppkey, image for all suppliers."""
    n = spark.sparkContext.defaultParallelism
    keys = table(spark, sf_dir, "supplier").select(K).repartition(n, K)
    return keys.select(K, images.pictures(F.col(K), lambda k: draw(int(k)), spark).alias("image"))


_SHAPE = f"160 + {K} % 3 * 10 as h, 220 + {K} % 4 * 10 as w, 12 + {K} % 9 as x0, 10 + {K} % 7 as y0, 200 + {K} % 4 * 10 + {K} % 5 as x1, 138 + {K} % 3 * 10 + {K} % 6 as y1"


def _told(df: DataFrame) -> DataFrame:
    return df.selectExpr("*", *[x.strip() for x in _SHAPE.split(", ")])


def _sum(image: Column) -> list[Column]:
    return [image["h"].alias("h"), image["w"].alias("w"), image["channels"].alias("channels"), F.crc32(image["data"]).alias("checksum")]


def _found(df: DataFrame, within: int) -> DataFrame:
    want = (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))
    off = [F.abs(F.get("quad", F.lit(i))[c] - F.col(n)) for i, pair in enumerate(want) for c, n in zip("xy", pair, strict=True)]
    return _told(df).select(K, (F.greatest(*off) <= within).alias("near"))


def img_1_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(images.detected(drawn(spark, sf_dir)), 4)


def img_2_detect_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detection.detected_by(drawn(spark, sf_dir), "exact"), 6)


def img_3_detect_simple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detection.detected_by(drawn(spark, sf_dir), "simple"), 4)


def img_4_detect_improved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detection.detected_by(drawn(spark, sf_dir), "improved"), 4)


def img_5_detect_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detection.detected_by(drawn(spark, sf_dir), "advanced"), 4)


def img_6_detect_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(detection.detected_by(drawn(spark, sf_dir), "fast"), 16)


def agg_11_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = images.histogram(images.background(drawn(spark, sf_dir)))
    return rows.select(K, "background.*", *[F.get("histogram", F.lit(i)).alias(f"level_{i}") for i in (2, 5, 28)])


def flt_7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = images.quality(drawn(spark, sf_dir))
    return q.select(K, F.round("quality.brightness", 6).alias("brightness"), F.round("quality.contrast", 6).alias("contrast"), "quality.dark", images.good_enough(F.col("quality")).alias("good"))


def flt_8_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(spark, sf_dir, draw_square).where(images.large_enough(F.col("image"))).select(K, F.col("image.h").cast("long").alias("h"))


def cls_1_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = images.features(drawn(spark, sf_dir))
    at = {"aspect": 0, "texture": 3, "brightness": 5, "contrast": 6, "share_2": 9, "share_5": 12, "share_28": 35}
    return f.select(K, F.size("features").cast("long").alias("n"), *[F.round(F.get("features", F.lit(i)), 6).alias(n) for n, i in at.items()])


def cls_5_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.rule_typed(drawn(spark, sf_dir)).select(K, "doc_type")


def cls_8_diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = images.features(drawn(spark, sf_dir)).withColumn("truth", F.when(F.col(K) % 3 > 0, F.when(F.col(K) % 3 == 1, "form").otherwise("text_document")))
    rows = enhancers.typed(seen, features="features")
    out = classify.diagnosed(rows.withColumnRenamed("doc_type", "prediction"), "truth")
    return out.select(K, F.round("named_features.aspect_ratio", 6).alias("aspect_ratio"), F.round("named_features.brightness", 6).alias("brightness"), "prediction", "confidence", "correct")


def geo_3_warp(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.struct(F.col(x).cast("float").alias("x"), F.col(y).cast("float").alias("y"))
    rows = _told(drawn(spark, sf_dir)).withColumn("quad", F.array(point("x1", "y1"), point("x0", "y0"), point("x1", "y0"), point("x0", "y1")))
    out = images.warped(rows)
    return out.select(K, F.col("document.h").cast("long").alias("rows"), F.col("document.w").cast("long").alias("cols"), F.hex(F.substring("document.data", 1, 1)).alias("first"))


def geo_6_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.centre_crop(drawn(spark, sf_dir))
    return out.select(K, F.col("document.h").cast("long").alias("rows"), F.col("document.w").cast("long").alias("cols"), F.hex(F.substring("document.data", 1, 1)).alias("first"))


def img_27_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.rotation(drawn(spark, sf_dir, draw_lines)).select(K, F.col("angle").cast("long").alias("angle"))


def img_28_straightened(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the angle after the page was turned."""
    rows = images.straightened(drawn(spark, sf_dir, draw_lines), "image")
    return images.rotation(rows).select(K, (F.abs("angle") <= 1).alias("straight"))


def img_30_augmented(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.augmented(drawn(spark, sf_dir, draw_square), K)
    return out.select(K, "copy", F.col("image.h").cast("long").alias("h"), F.col("image.w").cast("long").alias("w"))


def _white(image: Column) -> Column:
    """Pixels of full brightness in a picture of levels 0 and 255."""
    return (F.length(F.regexp_replace(F.hex(image["data"]), "00", "")) / 2 / image["channels"]).cast("long")


def img_11_inverted(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = images.enhanced_as(drawn(spark, sf_dir), "inverted")
    return out.select(K, _white(F.col("enhanced")).alias("white"))


def img_24_simple_bw(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = enhancers.styled(drawn(spark, sf_dir), "simple", "bw")
    return out.select(K, _white(F.col("enhanced")).alias("white"))


def prj_2_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Black and white for forms, gray else: the first ink pixel of either."""
    rows = _told(drawn(spark, sf_dir)).withColumn("kind", F.when(F.col(K) % 2 == 0, "form").otherwise("receipt"))
    out = enhancers.made_ready(rows, "kind")
    at = lambda y, x: F.hex(F.substring("readable.data", (F.expr(y) * F.col("w") + F.expr(x) + 1).cast("int"), F.lit(1)))
    return out.select(K, F.col("readable.channels").cast("long").alias("channels"), at("y0 + 20", "x0 + 20").alias("ink"), at("y0", "x0").alias("sheet"))


def img_20_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = enhancers.made_ready(drawn(spark, sf_dir))
    return out.select(K, F.col("readable.h").cast("long").alias("rows"), F.col("readable.w").cast("long").alias("cols"), F.col("readable.channels").cast("long").alias("channels"))


def img_21_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with odd keys are turned to light on dark first."""
    rows = drawn(spark, sf_dir, lambda k: 255 - draw_page(k) if k % 2 else draw_page(k))
    return enhancers.reading_variants(rows, K).select(K, "ord", "variant", F.col("image.h").cast("long").alias("h"), F.col("image.channels").cast("long").alias("channels"))


def img_33_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole chain on all pages; place keeps the order of the batch."""
    rows = _told(drawn(spark, sf_dir)).withColumn("place", F.col(K) - 1)
    out = enhancers.processed(rows)
    near = (F.abs(F.col("processed.rows") - F.expr("y1 - y0")) <= 12) & (F.abs(F.col("processed.cols") - F.expr("x1 - x0")) <= 12)
    return out.select(K, "place", F.col("processed.angle").alias("angle"), F.col("processed.found").alias("found"), near.alias("near"))


def _checksums(make):
    """Of each picture that make adds as `enhanced`."""
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return make(drawn(spark, sf_dir)).select(K, *_sum(F.col("enhanced")))

    return query


_BY_NAME = {
    "img_8_black_white": lambda d: images.enhanced_as(d, "bw"),
    "img_9_text": lambda d: images.enhanced_as(d, "text"),
    "img_10_color": lambda d: images.enhanced_as(d, "color"),
    "img_12_by_type": lambda d: images.enhanced(d.withColumn("t", F.element_at(F.array(*[F.lit(t) for t in images.BY_TYPE]), (F.col(K) % 5 + 1).cast("int"))), "t"),
    "img_13_text_document": lambda d: images.enhanced(d.withColumn("t", F.lit("text_document")), "t"),
    "img_14_id_card": lambda d: images.enhanced(d.withColumn("t", F.lit("id_card")), "t"),
    "img_15_receipt": lambda d: images.enhanced(d.withColumn("t", F.lit("receipt")), "t"),
    "img_16_form": lambda d: images.enhanced(d.withColumn("t", F.lit("form")), "t"),
    "img_17_business_card": lambda d: images.enhanced(d.withColumn("t", F.lit("business_card")), "t"),
    "img_18_default": lambda d: images.enhanced(d),
    "img_19_comprehensive": lambda d: enhancers.fully_enhanced(d),
    "img_22_display": lambda d: enhancers.styled(d, "display"),
    "img_23_improved": lambda d: enhancers.styled(d, "improved"),
    "img_24_simple_text": lambda d: enhancers.styled(d, "simple", "text"),
    "img_25_hdr": lambda d: images.enhanced_as(d, "hdr"),
    "img_26_for_text": lambda d: enhancers.optimised_for_text(d, "enhanced"),
    "img_29_glare": lambda d: images.enhanced_as(d, "glare"),
    "img_7_dispatch": lambda d: enhancers.document_enhanced(d),
}


def img_31_densities(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = images.quality(drawn(spark, sf_dir))
    return q.select(K, F.round("quality.ink", 6).alias("ink"), F.round("quality.edges", 6).alias("edges"), F.round("quality.sharpness", 4).alias("sharpness"))


_P = f"(select {K}, {_SHAPE}, 5 * 4 * (200 + {K} % 4 * 10 + {K} % 5 - 12 - {K} % 9 - 40) as ink from supplier)"
_C = f"(select *, (x1 - x0) * (y1 - y0) - ink as sheet, h * w - (x1 - x0) * (y1 - y0) as ground from {_P})"
_M = f"(select *, ({GROUND} * ground + {SHEET} * sheet + {INK} * ink) / (h * w) as mean from {_C})"
_D = f"(select *, sqrt({GROUND}**2 * ground / (h * w) + {SHEET}**2 * sheet / (h * w) + {INK}**2 * ink / (h * w) - mean**2) as dev from {_M})"
_NEAR = f"select {K}, true as near from supplier"
_LIGHT = "['otsu', 'adaptive', 'adaptive_mean', 'equalised', 'bilateral', 'edged', 'closed']"
_DARK = "['otsu', 'inverted', 'inverted_otsu', 'inverted_adaptive', 'inverted_contrast', 'bilateral', 'edged', 'closed']"
SQL = {f"img_{n}": _NEAR for n in ("1_detect", "2_detect_exact", "3_detect_simple", "4_detect_improved", "5_detect_advanced", "6_detect_fast")} | {
    "agg_11_background": f"select {K}, cast(ground + ink as bigint) as dark, cast(sheet as bigint) as light, ground + ink > sheet as is_dark, cast(ink as bigint) as level_2, cast(ground as bigint) as level_5, cast(sheet as bigint) as level_28 from {_C}",
    "flt_7_quality": f"select {K}, round(mean, 6) as brightness, round(dev, 6) as contrast, ground + ink > sheet as dark, mean > 20 and mean < 235 and dev > 40 as good from {_D}",
    "flt_8_large": f"select {K}, cast(80 + {K} % 5 * 10 as bigint) as h from supplier where {K} % 5 >= 2",
    "cls_1_features": f"""select {K}, cast(39 as bigint) as n, round(w / h, 6) as aspect, round(dev / mean, 6) as texture, round(mean / 255, 6) as brightness, round(dev / 255, 6) as contrast,
      round(ink / (h * w), 6) as share_2, round(ground / (h * w), 6) as share_5, round(sheet / (h * w), 6) as share_28 from {_D}""",
    "cls_5_typed": f"select {K}, 'text_document' as doc_type from supplier",
    "cls_8_diagnosed": f"select {K}, round(w / h, 6) as aspect_ratio, round(mean / 255, 6) as brightness, 'text_document' as prediction, cast(0.6 as double) as confidence, case {K} % 3 when 1 then false when 2 then true end as correct from {_D}",
    "geo_3_warp": f"select {K}, cast(y1 - y0 as bigint) as rows, cast(x1 - x0 as bigint) as cols, 'E6' as first from {_P}",
    "geo_6_crop": f"select {K}, cast(h - 2 * floor(h / 10) as bigint) as rows, cast(w - 2 * floor(w / 10) as bigint) as cols, 'E6' as first from {_P}",
    "img_27_rotation": f"select {K}, cast({K} % 5 as bigint) as angle from supplier",
    "img_28_straightened": f"select {K}, true as straight from supplier",
    "img_30_augmented": f"select {K}, cast(c as int) as copy, cast(80 + {K} % 5 * 10 as bigint) as h, cast(130 as bigint) as w from supplier, range(-1, 3) t(c) where c = -1 or {K} % 5 >= 2",
    "img_11_inverted": f"select {K}, cast(ground + ink as bigint) as white from {_C}",
    "img_24_simple_bw": f"select {K}, cast(sheet as bigint) as white from {_C}",
    "prj_2_by_type": f"select {K}, cast(1 as bigint) as channels, if({K} % 2 = 0, '00', '14') as ink, if({K} % 2 = 0, 'FF', 'E6') as sheet from supplier",
    "img_20_prepared": f"select {K}, cast(1000 as bigint) as rows, cast(round_even(w * 1000.0 / h, 0) as bigint) as cols, cast(1 as bigint) as channels from {_P}",
    "img_21_variants": f"""with v as (select {K}, h, if({K} % 2 = 1, {_DARK}, {_LIGHT}) as names from {_P})
      select {K}, cast(i as int) as ord, names[i + 1] as variant, cast(h as bigint) as h, cast(1 as bigint) as channels from v, range(0, 8) t(i) where i < len(names)""",
    "img_33_processed": f"select {K}, {K} - 1 as place, 0.0::double as angle, true as found, true as near from supplier",
}
QUERIES = {f.__name__: f for f in (
    img_1_detect, img_2_detect_exact, img_3_detect_simple, img_4_detect_improved, img_5_detect_advanced, img_6_detect_fast, agg_11_background, flt_7_quality, flt_8_large,
    cls_1_features, cls_5_typed, cls_8_diagnosed, geo_3_warp, geo_6_crop, img_27_rotation, img_28_straightened, img_30_augmented, img_11_inverted, img_24_simple_bw, prj_2_by_type,
    img_20_prepared, img_21_variants, img_33_processed, img_31_densities,
)} | {n: _checksums(f) for n, f in _BY_NAME.items()}
