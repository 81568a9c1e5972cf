"""Queries of pixel filters, pixel by pixel: small gray pictures made from keys, and SQL that follows
the filters' definitions on a table of pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.operators import enhancers, images

from .image_plans import K, drawn

H, W = 14, 16


def draw_noise(k: int) -> np.ndarray:
    y, x = np.mgrid[:H, :W]
    return ((k * 7 + y * y * 13 + x * 29 + x * y * 5) % 256).astype(np.uint8)


def _pixels(df: DataFrame, image: str = "enhanced") -> DataFrame:
    """s_suppkey, y, x, v of the first channel."""
    told = images.each(df, lambda a: (a if a.ndim == 2 else a[..., 0]).ravel().tolist(), "v", "array<bigint>", image)
    rows = told.select(K, F.posexplode("v").alias("p", "v"))
    return rows.select(K, F.expr(f"cast(p div {W} as bigint)").alias("y"), (F.col("p") % W).cast("long").alias("x"), "v")


def _noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drawn(spark, sf_dir, draw_noise)


def img_8_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(images.enhanced_as(_noise(spark, sf_dir), "bw"))


def img_9_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(images.enhanced_as(_noise(spark, sf_dir), "text"))


def img_16_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(images.enhanced(_noise(spark, sf_dir).withColumn("t", F.lit("form")), "t"))


def img_24_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pixels(enhancers.styled(_noise(spark, sf_dir), "simple", "text"))


def img_31_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of ink and sharpness of each picture."""
    q = images.quality(_noise(spark, sf_dir))
    return q.select(K, F.round("quality.ink", 6).alias("ink"), F.round("quality.sharpness", 4).alias("sharpness"), F.round("quality.brightness", 6).alias("brightness"))


def _inside(i: str, n: int) -> str:
    """A place beyond the border, mirrored without the edge pixel."""
    return f"case when {i} < 0 then -({i}) when {i} >= {n} then {2 * (n - 1)} - ({i}) else {i} end"


def _around(source: str, size: int, value: str, where: str = "true") -> str:
    """A value of the pixels b in the square around each pixel a; dy and dx are the offsets."""
    off = f"range({-(size // 2)}, {size // 2 + 1})"
    return f"""(select a.k, a.y, a.x, {value} as v from (select k, y, x, v, dy, dx, {_inside('y + dy', H)} as ny, {_inside('x + dx', W)} as nx from {source}, {off} p(dy), {off} q(dx) where {where}) a
      join {source} b on b.k = a.k and b.y = a.ny and b.x = a.nx group by a.k, a.y, a.x)"""


def _blur(source: str, size: int) -> str:
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    w = f"exp(-(dy * dy + dx * dx) / {2 * sigma * sigma})"
    return _around(source, size, f"round_even(sum({w} * b.v) / sum({w}), 0)")


def _adaptive(source: str, size: int, c: int) -> str:
    return f"(select s.k, s.y, s.x, case when s.v > m.v - {c} then 255 else 0 end as v from {source} s join {_blur(source, size)} m using (k, y, x))"


def _bilateral(source: str) -> str:
    w = "exp(-((b.v - a.v) * (b.v - a.v) + dy * dy + dx * dx) / 11250.0)"
    return _around(source, 9, f"round_even(sum({w} * b.v) / sum({w}), 0)", "dy * dy + dx * dx <= 16")


def _extreme(source: str, of: str, step: int) -> str:
    """max or min over the pixel and those behind (-1) or ahead (1) of it."""
    near = f"b.y between least(a.y, a.y + {step}) and greatest(a.y, a.y + {step}) and b.x between least(a.x, a.x + {step}) and greatest(a.x, a.x + {step})"
    return f"(select a.k, a.y, a.x, {of}(b.v) as v from {source} a join {source} b on a.k = b.k and {near} group by a.k, a.y, a.x)"


_PX = f"with px as (select {K} as k, y, x, ({K} * 7 + y * y * 13 + x * 29 + x * y * 5) % 256 as v from supplier, range({H}) p(y), range({W}) q(x))"


def _sql(last: str, **steps: str) -> str:
    each = "".join(f", {n} as {s}" for n, s in steps.items())
    return f"{_PX}{each} select k as {K}, cast(y as bigint) as y, cast(x as bigint) as x, cast(v as bigint) as v from {last}"


SQL = {
    "img_8_pixels": _sql("out", smooth=_blur("px", 5), out=_adaptive("smooth", 11, 2)),
    "img_9_pixels": _sql("out", smooth=_bilateral("px"), out=_adaptive("smooth", 11, 2)),
    "img_16_pixels": _sql("out", smooth=_bilateral("px"), ink=_adaptive("smooth", 25, 5), wide=_extreme("ink", "max", -1), out=_extreme("wide", "min", 1)),
    "img_24_pixels": _sql("out", out=_adaptive("px", 11, 2)),
    "img_31_pixels": f"""{_PX}, ink as {_adaptive("px", 11, 2)}, rough as {_around("px", 3, "sum(case when abs(dy) + abs(dx) = 1 then b.v when dy = 0 and dx = 0 then -4 * b.v else 0 end)")}
      select k as {K}, round(avg(case when i.v = 0 then 1.0 else 0.0 end), 6) as ink, round(var_pop(r.v), 4) as sharpness, round(avg(p.v), 6) as brightness
      from px p join ink i using (k, y, x) join rough r using (k, y, x) group by k""",
}
QUERIES = {f.__name__: f for f in (img_8_pixels, img_9_pixels, img_16_pixels, img_24_pixels, img_31_pixels)}
