"""Document detection in several tunings over one engine, and corner refinement.

A tuning says how edges are made and which outlines count. Outlines are the convex hulls of
connected edge parts, the largest first; the first one that passes gives the corners. A null
image, or one without such an outline, gives null.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from docloom.functions import pixels as px

from . import images


@dataclass(frozen=True)
class Tuning:
    """edges: image to edge mask. thick: side of the square that edges are dilated by. least: share of the image
    that an outline covers at least (or least_area, in pixels). top: outlines that are looked at.
    slack: tolerance of the simplified outline, as a share of its length. corners: numbers of corners that
    count; those other than four are boxed, if boxed. scale: size at which edges are sought.
    smallest: sides that the upright picture has at least."""

    edges: Callable[[np.ndarray], np.ndarray]
    thick: int = 3
    least: float = 0.0
    least_area: float = 0.0
    top: int | None = None
    slack: float = 0.02
    corners: tuple[int, int] = (4, 4)
    boxed: bool = False
    scale: float = 1.0
    smallest: int = 0
    refined: bool = False


def _plain(low: float, high: float) -> Callable[[np.ndarray], np.ndarray]:
    return lambda a: px.canny(px.blur(px.gray(a)), low, high)


def _by_level(sensitivity: float) -> Callable[[np.ndarray], np.ndarray]:
    def edges(a: np.ndarray) -> np.ndarray:
        smooth = px.blur(px.gray(a))
        high = px.otsu_level(smooth)
        return px.canny(smooth, high * (0.3 + 0.2 * sensitivity), high)

    return edges


def _three_ways(a: np.ndarray) -> np.ndarray:
    """Edges of the gray image, of its saturation and of its inverse, put together."""
    plane = px.gray(a)
    found = px.canny(px.blur(plane), 50, 150) | px.canny(px.blur(255 - plane), 50, 150)
    return found if a.ndim == 2 else found | px.canny(px.clip8(px.hsv(a)[..., 1] * 255), 50, 150)


def _ink_or_edges(a: np.ndarray) -> np.ndarray:
    smooth = px.blur(px.gray(a))
    return (255 - px.adaptive(smooth, 11, 2)) | px.canny(smooth, 50, 150)


def _of_threshold(a: np.ndarray) -> np.ndarray:
    return px.canny(px.adaptive(px.bilateral(px.gray(a)), 11, 2), 50, 200)


def tuning(name: str, sensitivity: float | None = None) -> Tuning:
    """simple; improved (sensitivity 0.5 if not given) and advanced (0.7): more sensitive means thicker edges,
    smaller outlines and rougher shapes; fast (0.7): half size, the five largest; exact: the largest
    outline of thresholded pictures, corners refined."""
    if name == "simple":
        return Tuning(_plain(75, 200), thick=5, least=0.05)
    if name in ("improved", "advanced"):
        s = sensitivity if sensitivity is not None else 0.5 if name == "improved" else 0.7
        return Tuning(
            _by_level(s) if name == "improved" else _three_ways, thick=int(3 + 4 * s), least=0.03 * (1 - s), top=10, slack=0.04 - 0.02 * s,
            corners=(3, 6), boxed=s > (0.7 if name == "improved" else 0.5),
        )
    if name == "fast":
        s = 0.7 if sensitivity is None else sensitivity
        return Tuning(_ink_or_edges, least=0.05 * (1 - 0.5 * s), top=5, scale=0.5, smallest=100)
    if name == "exact":
        return Tuning(_of_threshold, least_area=5000, top=1, refined=True)
    raise ValueError(f"no tuning {name}")


def outlines(mask: np.ndarray) -> list[tuple[float, np.ndarray]]:
    """(area, hull) of the connected parts of a mask, the largest first; parts on one line left out."""
    parts = px.components(mask)
    y, x = np.nonzero(parts)
    if not len(y):
        return []
    owner = parts[y, x]
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    hulls = [px.hull(p) for p in np.split(np.stack([x, y], axis=1)[order], cuts)]
    return sorted(((px.area(h), h) for h in hulls if len(h) > 2), key=lambda t: -t[0])


def refined(corners: np.ndarray, edges: np.ndarray, reach: int = 10) -> np.ndarray:
    """Each corner moved to the nearest edge pixel (the first in reading order on ties) of the square that
    reaches `reach` pixels back and short of `reach` ahead; distances are from the place `reach` from the square's start."""
    out = corners.astype(float).copy()
    h, w = edges.shape
    for i, (x, y) in enumerate(corners.astype(int)):
        left, top = max(0, x - reach), max(0, y - reach)
        ys, xs = np.nonzero(edges[top : min(h, y + reach), left : min(w, x + reach)])
        if len(xs):
            k = int(((xs - reach) ** 2 + (ys - reach) ** 2).argmin())
            out[i] = left + xs[k], top + ys[k]
    return out


def corners_of(img: np.ndarray, t: Tuning) -> np.ndarray | None:
    small = img if t.scale == 1 else px.resized(img, max(1, round(img.shape[0] * t.scale)), max(1, round(img.shape[1] * t.scale)))
    edges = t.edges(small)
    least = t.least_area or t.least * edges.size
    for size, shape in outlines(px.dilate(edges, t.thick))[: t.top]:
        if size < least:
            break
        poly = px.simplified(shape, t.slack * px.perimeter(shape))
        if not t.corners[0] <= len(poly) <= t.corners[1]:
            continue
        if len(poly) != 4:
            if not t.boxed:
                continue
            poly = np.trunc(px.smallest_box(shape))
        quad = px.ordered(poly)
        if t.refined:
            quad = refined(quad, edges)
        if t.scale != 1:
            quad = np.trunc(quad / t.scale)
        if t.smallest and min(px.warp(img, quad).shape[:2]) < t.smallest:
            continue
        return quad
    return None


def detected_by(df: DataFrame, name: str, sensitivity: float | None = None, out: str = "quad", image: str = "image") -> DataFrame:
    """df with the corners that a tuning finds, top left first, clockwise; null where it finds none."""
    t = tuning(name, sensitivity)

    def make(a: np.ndarray) -> list | None:
        q = corners_of(a, t)
        return None if q is None else [{"x": float(x), "y": float(y)} for x, y in q]

    return images.each(df, make, out, images.QUAD, image)
