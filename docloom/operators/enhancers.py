"""Enhancement for display, for recognition and of whole scans.

Modes choose themselves by background, brightness and colour where they are `auto`. Pictures come
back with three channels, unless stated otherwise. A null image gives null; an unknown mode gives the image itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from docloom.functions import pixels as px

from . import classify, detection, images


def _colour(img: np.ndarray) -> np.ndarray:
    return img if img.ndim == 3 else np.repeat(img[..., None], 3, axis=2)


def saturated(img: np.ndarray, colour: float, light: float = 1.0) -> np.ndarray:
    """Saturation and value times a gain, then sharpened: nine times a pixel less its neighbours."""
    x = px.hsv(img)
    x[..., 1], x[..., 2] = np.minimum(x[..., 1] * colour, 1), np.minimum(x[..., 2] * light, 255)
    strong = px.from_hsv(x).astype(np.float64)
    return px.clip8(10 * strong - sum(m for _, _, m in px.shifts(strong, 1)))


def colour_spread(img: np.ndarray) -> float:
    """Deviation of the saturation, 0 to 255; 0 for gray pictures."""
    return float((px.hsv(img)[..., 1] * 255).std()) if img.ndim == 3 else 0.0


def _clear_text(img: np.ndarray) -> np.ndarray:
    return px.non_local_means(px.adaptive(px.gray(img), 15, 5))


def _black_white(img: np.ndarray) -> np.ndarray:
    return px.closed(px.otsu(px.equalise_tiles(px.gray(img))))


def display_mode(img: np.ndarray) -> str:
    """inverted on a dark background, color where colours vary, else text."""
    return "inverted" if images.dark_background(px.gray(img)) else "color" if colour_spread(img) > 50 else "text"


def light_mode(img: np.ndarray) -> str:
    """color where colours vary, photo if dark, else text."""
    return "color" if colour_spread(img) > 50 else "photo" if px.gray(img).mean() < 150 else "text"


def for_display(img: np.ndarray, mode: str = "auto") -> np.ndarray:
    mode = display_mode(img) if mode == "auto" else mode
    if mode == "text":
        return _colour(_clear_text(img))
    if mode == "bw":
        return _colour(_black_white(img))
    if mode == "inverted":
        return _colour(255 - px.non_local_means(px.otsu(255 - px.gray(img))))
    return saturated(_colour(img), 1.3, 1.1) if mode == "color" else _colour(img)


def improved(img: np.ndarray, mode: str = "auto") -> np.ndarray:
    mode = light_mode(img) if mode == "auto" else mode
    if mode == "text":
        return _colour(_clear_text(img))
    if mode == "bw":
        return _colour(_black_white(img))
    return saturated(_colour(img), 1.2) if mode == "color" else img


def simple(img: np.ndarray, mode: str = "text") -> np.ndarray:
    if mode == "text":
        return _colour(px.adaptive(px.gray(img), 11, 2))
    if mode == "bw":
        return _colour(px.otsu(px.gray(img)))
    return saturated(_colour(img), 1.2) if mode == "color" else img


def basic(img: np.ndarray, mode: str = "auto") -> np.ndarray:
    """Without a model: bw, text, color; else inverted on a dark background and as text on a light one."""
    if mode not in ("bw", "text", "color"):
        mode = "inverted" if images.dark_background(px.gray(img)) else "text"
    return images.mode_pixels(img, mode)


def by_mode_or_type(img: np.ndarray, mode: str, doc_type: str | None) -> np.ndarray:
    """With a known document type: bw as the basic mode, text and color as text and id cards are
    enhanced, other modes by the type."""
    if mode == "bw":
        return images.mode_pixels(img, "bw")
    if mode == "text":
        return px.like(images.BY_TYPE["text_document"](img, False), img)
    if mode == "color":
        return images.BY_TYPE["id_card"](_colour(img), False)
    return images.enhance_pixels(img, doc_type)


def comprehensive(img: np.ndarray) -> np.ndarray:
    """Denoised, colours balanced, contrast evened and sharpened. A picture without colours is worked on as one plane: its tints are
    all 128 and stay so, and its luma is its level."""
    if (plane := px.one_plane(img)) is not None:
        even = px.equalise_tiles(px.non_local_means(px.LIGHT[plane]))
        return _colour(_edges_raised(px.equalise_tiles(px.level_of_light(np.arange(256))[even])))
    cells = px.lab(img) * [2.55, 1, 1] + [0, 128, 128]
    quiet = np.stack([px.non_local_means(px.clip8(cells[..., i])) for i in range(3)], axis=2)
    light, *tints = np.moveaxis(quiet, 2, 0)
    balanced = [np.clip((t - t.mean()) * (1 + t.std() / 128) + t.mean(), 0, 255).astype(np.uint8) for t in tints]
    even = np.stack([px.equalise_tiles(light) / 2.55, *(b - 128.0 for b in balanced)], axis=2)
    x = px.yuv(px.from_lab(even))
    x[..., 0] = px.equalise_tiles(px.clip8(x[..., 0]))
    return _edges_raised(px.from_yuv(x))


def _edges_raised(img: np.ndarray) -> np.ndarray:
    out = img.astype(np.float64)
    near = sum(m for _, _, m in px.shifts(out, 1))
    return px.clip8(0.55 * out + 0.45 * px.clip8((10 * out - near) / 7.5))


def read_ready(img: np.ndarray, lift: float = 0.0) -> np.ndarray:
    """Gray picture with more contrast, thresholded, denoised, dark on light."""
    out = px.non_local_means(px.adaptive(images.contrast(px.gray(img), 1.3, lift), 11, 2))
    return 255 - out if out.mean() < 127 else out


def prepared(img: np.ndarray, least: int = 1000) -> np.ndarray:
    """`read_ready`, enlarged to `least` rows."""
    out = read_ready(img, 10)
    scale = max(1.0, least / out.shape[0])
    return px.resized(out, round(out.shape[0] * scale), round(out.shape[1] * scale), cubic=True) if scale > 1 else out


def by_type_for_reading(img: np.ndarray, doc_type: str | None) -> np.ndarray:
    """Black and white for text documents and forms, else gray."""
    return px.otsu(px.gray(img)) if doc_type in ("text_document", "form") else px.gray(img)


def variants(img: np.ndarray, mode: str = "auto") -> list[tuple[str, np.ndarray]]:
    """Named pictures to read from, in the order in which they are tried: seven on a light
    background (text, light), eight on a dark one (dark, inverted)."""
    plane = px.gray(img)
    if mode == "auto":
        mode = "dark" if images.dark_background(plane) else "text"
    level = px.otsu(plane)
    out = [("otsu", level)]
    if mode in ("text", "light"):
        out += [("adaptive", px.adaptive(plane, 11, 2)), ("adaptive_mean", px.adaptive_mean(plane, 15, 5)), ("equalised", px.otsu(px.equalise_tiles(plane)))]
    elif mode in ("dark", "inverted"):
        turned = 255 - plane
        out += [("inverted", turned), ("inverted_otsu", px.otsu(turned)), ("inverted_adaptive", px.adaptive(turned, 11, 2)),
                ("inverted_contrast", px.otsu(images.contrast(turned, 1.5, 10)))]
    edged = px.clip8(1.5 * plane.astype(np.float64) - 0.5 * px.blur_by(plane, 3).astype(np.float64))
    return [*out, ("bilateral", px.otsu(px.bilateral(plane))), ("edged", px.otsu(edged)), ("closed", px.closed(level))]


STYLES = {"display": for_display, "improved": improved, "simple": simple, "basic": basic}


def styled(df: DataFrame, style: str, mode: str = "auto", out: str = "enhanced", image: str = "image") -> DataFrame:
    """df with the image enhanced in a style of STYLES and a mode."""
    make = STYLES[style]
    return images.each(df, lambda a: images.to_value(make(a, mode)), out, images.IMAGE, image)


def document_enhanced(df: DataFrame, mode: str = "auto", doc_type: str | None = None, out: str = "enhanced", image: str = "image") -> DataFrame:
    """df with the image enhanced by mode; where that leaves it open, by the type in the column
    doc_type, or (null, or no column) by the type that the rules give."""
    typed = images.rule_typed(df, "__rule", image)
    kind = F.coalesce(F.col(doc_type), F.col("__rule")) if doc_type else F.col("__rule")
    rows = typed.withColumn("__type", kind)
    return images.each(rows, lambda a, t: images.to_value(by_mode_or_type(a, mode, t)), out, images.IMAGE, image, ("__type",)).drop("__rule", "__type")


def fully_enhanced(df: DataFrame, out: str = "enhanced", image: str = "image") -> DataFrame:
    return images.each(df, lambda a: images.to_value(comprehensive(a)), out, images.IMAGE, image)


def made_ready(df: DataFrame, doc_type: str | None = None, out: str = "readable", image: str = "image", least: int = 1000) -> DataFrame:
    """df with the gray picture to read from: by document type if a column is named, else
    `prepared`."""
    if doc_type:
        return images.each(df, lambda a, t: images.to_value(by_type_for_reading(a, t)), out, images.IMAGE, image, (doc_type,))
    return images.each(df, lambda a: images.to_value(prepared(a, least)), out, images.IMAGE, image)


def optimised_for_text(df: DataFrame, out: str = "readable", image: str = "image") -> DataFrame:
    return images.each(df, lambda a: images.to_value(read_ready(a)), out, images.IMAGE, image)


def reading_variants(df: DataFrame, id_col: str, mode: str = "auto", image: str = "image") -> DataFrame:
    """id, ord, variant, image: a row for each picture of `variants`, made in one pass."""
    return images.rows_of(df, id_col, image, lambda img: [(i, *v) for i, v in enumerate(variants(img, mode))], ("ord", "variant"), "ord int, variant string")


PROCESSED = "struct<h:int,w:int,channels:int,data:binary,angle:double,found:boolean,rows:int,cols:int>"


def process(img: np.ndarray) -> tuple[np.ndarray, float, bool, tuple[int, int]]:
    """A whole scan: turned upright by more than half a degree, cut out where a document is found, glare
    removed, enhanced; with the angle, whether it was cut out, and the size before enhancement."""
    img = _colour(img)
    angles = px.line_angles(px.canny(px.gray(img), 50, 150))
    turn = float(np.median(angles)) if len(angles) else 0.0
    if abs(turn) > 0.5:
        img = px.rotated(img, turn)
    quad = detection.corners_of(img, detection.tuning("exact"))
    cut = px.warp(img, quad) if quad is not None else img
    img, found = (cut, True) if quad is not None and cut.size else (img, False)
    img = images.mode_pixels(img, "glare")
    return comprehensive(img), turn, found, img.shape[:2]


def processed(df: DataFrame, out: str = "processed", image: str = "image") -> DataFrame:
    """df with a record of the processed picture and its angle, found, rows and cols. Rows keep their
    columns, so a place in a batch kept as a column restores its order."""
    def make(a: np.ndarray) -> dict | None:
        picture, angle, found, (h, w) = process(a)
        value = images.to_value(picture)
        return None if value is None else value | {"angle": angle, "found": found, "rows": h, "cols": w}

    return images.each(df, make, out, PROCESSED, image)


def typed(df: DataFrame, model=None, classes: list[str] | None = None, out: str = "doc_type", image: str = "image", features: str | None = None) -> DataFrame:
    """df with the document type: the model's where there is one, else the rules' on aspect and
    edge density. features names a column that has the image's `features` already."""
    from pyspark.ml.functions import array_to_vector

    name = model.stages[0].getInputCol() if model is not None else "__v"
    rows = (df if features else images.features(df, "__f", image)).withColumn(name, array_to_vector(features or "__f"))
    said = classify.predict_or_rules(model, rows, classes or [], name)
    return said.withColumn(out, F.col("doc_type")).select(*[c for c in df.columns if c != name], out, "confidence")
