"""Corner geometry on arrays of points: array<struct<x, y>> of length 4."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ordered(points: Column) -> Column:
    """Top left, top right, bottom right, bottom left; the first of equal points."""
    corners = [F.get(points, F.lit(i)) for i in range(4)]

    def pick(key, sign: int) -> Column:
        ranked = [F.when(p.isNotNull(), F.struct((sign * key(p)).alias("k"), F.lit(i).alias("i"), p.alias("p"))) for i, p in enumerate(corners)]
        return F.least(*ranked)["p"]

    total, diff = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return F.array(pick(total, 1), pick(diff, 1), pick(total, -1), pick(diff, -1))


def size(quad: Column) -> Column:
    """Width and height of the upright picture of an ordered quad."""
    side = lambda a, b: F.sqrt(F.pow(quad[a]["x"] - quad[b]["x"], 2) + F.pow(quad[a]["y"] - quad[b]["y"], 2)).cast("int")
    return F.struct(F.greatest(side(2, 3), side(1, 0)).alias("width"), F.greatest(side(1, 2), side(0, 3)).alias("height"))


def aspect(width: Column, height: Column) -> Column:
    return width / height
