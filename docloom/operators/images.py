"""Image operators over a column image: struct<h int, w int, channels int, data binary>, data being
the pixels row by row, blue-green-red where there are three channels.

Images are worked on one at a time in Arrow batches of some megabytes; no operator shuffles. A null image, one whose
data does not fit its shape, and an empty one give null (or no row, where an operator makes rows)."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docloom.functions import jpeg, pixels as px

from . import classify

IMAGE = "struct<h:int,w:int,channels:int,data:binary>"
QUAD = "array<struct<x:float,y:float>>"
#: Bytes of pictures in an Arrow batch, to Python and back; one row at least.
BATCH = 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Holds the batches that go to Python to BATCH bytes; a lower setting of the caller stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("b"))
    if now <= 0 or now > BATCH:
        spark.conf.set(key, str(BATCH))


def _weight(value) -> int:
    """Bytes of a result, about."""
    if isinstance(value, dict):
        return sum(map(_weight, value.values()))
    return len(value) * (1 if isinstance(value, bytes) else 32) if isinstance(value, bytes | list) else 32


def portions(values: Iterator) -> Iterator[list]:
    """values in lists of about BATCH bytes, so that what grows in Python is handed on in parts."""
    held, size = [], 0
    for v in values:
        held.append(v)
        size += _weight(v)
        if size >= BATCH:
            yield held
            held, size = [], 0
    if held:
        yield held


def pictures(keys: Column, make: Callable[[object], np.ndarray | None], spark: SparkSession) -> Column:
    """An image for each key, make(key)."""
    return _nested(lambda batches: (to_value(make(k)) for b in batches for k in b), IMAGE, pd.Series, spark)(keys)


def _nested(values: Callable[[Iterator], Iterator[dict | None]], kind: str, taken: type, spark: SparkSession) -> Callable[..., Column]:
    """A function of columns to a struct. It runs once for a row: Spark repeats what it may take for a plain
    expression in the filters above it."""
    small_batches(spark)
    names = [f.split(":")[0] for f in kind[len("struct<") : -1].split(",")]

    def run(batches):
        for part in portions(values(batches)):
            yield pd.DataFrame([v or dict.fromkeys(names) for v in part], columns=names)

    run.__annotations__ = {"batches": Iterator[taken], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, kind).asNondeterministic()


def _plain(values: Callable[[Iterator], Iterator], kind: str, taken: type, spark: SparkSession) -> Callable[..., Column]:
    """A function of columns to anything but a struct, run once for a row."""
    small_batches(spark)

    def run(batches):
        for part in portions(values(batches)):
            yield pd.Series(part, dtype=object)

    run.__annotations__ = {"batches": Iterator[taken], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind).asNondeterministic()


def to_array(value) -> np.ndarray | None:
    if value is None or value["data"] is None or not value["h"] or not value["w"]:
        return None
    h, w, c = value["h"], value["w"], value["channels"]
    if c not in (1, 3) or len(value["data"]) != h * w * c:
        return None
    return np.frombuffer(value["data"], np.uint8).reshape((h, w) if c == 1 else (h, w, 3))


def to_value(img: np.ndarray | None) -> dict | None:
    if img is None or not img.size:
        return None
    return {"h": img.shape[0], "w": img.shape[1], "channels": 1 if img.ndim == 2 else 3, "data": np.ascontiguousarray(img).tobytes()}


def each(df: DataFrame, make: Callable[[np.ndarray, pd.Series], object], out: str, kind: str, image: str = "image", with_: tuple = ()) -> DataFrame:
    """df with a column out of type kind: make(pixels, the values of the columns with_)."""

    def values(batches: Iterator[pd.DataFrame]) -> Iterator:
        for packed in batches:
            for row in packed.itertuples(index=False, name=None):
                a = to_array(row[0])
                yield None if a is None else make(a, *row[1:])

    packed = F.struct(F.col(image).alias("c0"), *[F.col(c).alias(f"c{i + 1}") for i, c in enumerate(with_)])
    if not kind.startswith("struct<"):
        return df.withColumn(out, _plain(values, kind, pd.DataFrame, df.sparkSession)(packed))
    first = kind[len("struct<") :].split(":")[0]
    made = df.withColumn(out, _nested(values, kind, pd.DataFrame, df.sparkSession)(packed))
    return made.withColumn(out, F.when(F.col(out)[first].isNotNull(), F.col(out)))


def decode_png(data: bytes) -> np.ndarray | None:
    """Gray or colour PNG of eight bits, not interlaced, as blue-green-red; None for anything else."""
    try:
        if data[:8] != b"\x89PNG\r\n\x1a\n":
            return None
        at, body = 8, b""
        while at < len(data):
            n, tag = struct.unpack(">I4s", data[at : at + 8])
            part = data[at + 8 : at + 8 + n]
            if tag == b"IHDR":
                w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", part)
            body += part if tag == b"IDAT" else b""
            at += 12 + n
        step = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
        if depth != 8 or laced:
            return None
        lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * step)
        out = np.zeros((h, w * step), np.uint8)
        for y, (kind, line) in enumerate(zip(lines[:, 0].tolist(), lines[:, 1:], strict=True)):
            above = out[y - 1] if y else np.zeros(w * step, np.uint8)
            if kind == 0:
                out[y] = line
            elif kind == 2:
                out[y] = line + above
            elif kind == 1:
                out[y] = np.cumsum(line.reshape(w, step), axis=0, dtype=np.uint8).ravel()
            else:
                row, up = bytearray(w * step), above.tolist()
                for i, v in enumerate(line.tolist()):
                    a, b, c = (row[i - step], up[i], up[i - step]) if i >= step else (0, up[i], 0)
                    if kind == 4:
                        pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                        guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                    else:
                        guess = (a + b) // 2
                    row[i] = (v + guess) & 255
                out[y] = np.frombuffer(bytes(row), np.uint8)
        planes = out.reshape(h, w, step)
        return planes[..., 0].copy() if step < 3 else planes[..., 2::-1].copy()
    except (KeyError, ValueError, struct.error, zlib.error, UnboundLocalError):
        return None


def decode_file(data: bytes) -> np.ndarray | None:
    """A PNG or JPEG file's picture."""
    return jpeg.decode(data) if data[:2] == b"\xff\xd8" else decode_png(data)


def encode_png(img: np.ndarray) -> bytes:
    h, w = img.shape[:2]
    lines = (img if img.ndim == 2 else img[..., ::-1]).reshape(h, -1)
    body = zlib.compress(np.concatenate([np.zeros((h, 1), np.uint8), lines], axis=1).tobytes())
    part = lambda tag, x: struct.pack(">I", len(x)) + tag + x + struct.pack(">I", zlib.crc32(tag + x))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if img.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", body) + part(b"IEND", b"")


def decoded(files: DataFrame, content: str = "content", out: str = "image") -> DataFrame:
    """files with their picture, PNG or baseline JPEG; files that cannot be read go."""

    def read(batches: Iterator[pd.Series]) -> Iterator[dict | None]:
        return (to_value(decode_file(bytes(x))) if x is not None else None for data in batches for x in data)

    return files.withColumn(out, _nested(read, IMAGE, pd.Series, files.sparkSession)(content)).where(F.col(out)["h"].isNotNull())


def encoded(df: DataFrame, out: str = "png", image: str = "image", kind: str = "png") -> DataFrame:
    """df with the file content of the image, kind png (exact) or jpeg."""
    make = {"png": encode_png, "jpeg": jpeg.encode}[kind]
    return each(df, lambda a: make(a), out, "binary", image)


def contrast(img: np.ndarray, gain: float, lift: float) -> np.ndarray:
    return np.minimum(np.rint(np.abs(img * gain + lift)), 255).astype(np.uint8)


def _value_equalised(img: np.ndarray) -> np.ndarray:
    x = px.hsv(img)
    x[..., 2] = px.equalise_tiles(px.clip8(x[..., 2]))
    return px.from_hsv(x)


def _light_equalised(img: np.ndarray, limit: float = 2.0, gain: float = 1.0) -> np.ndarray:
    if (plane := px.one_plane(img)) is not None:
        even = px.equalise_tiles(px.LIGHT[plane], limit)
        return px.like(px.level_of_light(np.minimum(np.arange(256) * gain, 255))[even], img)
    x = px.lab(img)
    x[..., 0] = np.minimum(px.equalise_tiles(px.clip8(x[..., 0] * 2.55), limit) * gain, 255) / 2.55
    return px.from_lab(x)


def dark_background(plane: np.ndarray) -> bool:
    """More pixels below 128 than from there on."""
    return bool((plane < 128).sum() > (plane >= 128).sum())


def _wiener(plane: np.ndarray, size: int = 5, balance: float = 0.3) -> np.ndarray:
    """Deconvolution of a mean of size x size with a Laplacian as regulariser."""
    h, w = plane.shape
    def transfer(kernel):
        k = np.zeros((h, w))
        for (i, j), v in np.ndenumerate(kernel):
            k[(i - kernel.shape[0] // 2) % h, (j - kernel.shape[1] // 2) % w] += v
        return np.fft.rfft2(k)
    point, rough = transfer(np.full((size, size), 1 / size**2)), transfer(np.array([[0, -1, 0], [-1, 4, -1], [0, -1, 0]], float) / 4)
    spectrum = np.fft.rfft2(plane / 255.0) * point.conj() / (np.abs(point) ** 2 + balance * np.abs(rough) ** 2)
    return np.clip(np.fft.irfft2(spectrum, s=(h, w)), 0, 1)


def _as_text(img, dark):
    plane = px.gray(img)
    smooth = px.equalise_tiles(px.non_local_means(255 - plane if dark else plane))
    return px.closed(px.adaptive(smooth, 15, 5))


def _as_form(img, dark):
    return px.closed(px.adaptive(px.bilateral(px.gray(img)), 25, 5))


def _as_receipt(img, dark):
    return px.otsu((_wiener(contrast(px.gray(img), 1.5, 10)) * 255).astype(np.uint8))


def _as_inverted(img, dark=True):
    return 255 - px.opened(px.otsu(px.equalise_tiles(255 - px.gray(img))))


def _as_card(img, dark):
    return _as_text(img, dark) if img.ndim == 2 else px.sharpened(_light_equalised(img))


def _as_id(img, dark):
    return _as_text(img, dark) if img.ndim == 2 else px.sharpened(_value_equalised(img))


BY_TYPE = {"text_document": _as_text, "form": _as_form, "receipt": _as_receipt, "business_card": _as_card, "id_card": _as_id}
BY_MODE = {
    "bw": lambda a: px.adaptive(px.blur(px.gray(a))),
    "text": lambda a: px.adaptive(px.bilateral(px.gray(a))),
    "color": lambda a: _value_equalised(a if a.ndim == 3 else np.repeat(a[..., None], 3, axis=2)),
    "inverted": lambda a: px.otsu(255 - px.gray(a)),
    "hdr": lambda a: _light_equalised(a, 3.0, 1.2) if a.ndim == 3 else px.equalise_tiles(a, 3.0),
    "glare": lambda a: px.bilateral(_light_equalised(a, 3.0)) if a.ndim == 3 else px.bilateral(px.equalise_tiles(a, 3.0)),
}


def enhance_pixels(img: np.ndarray, doc_type: str | None = None) -> np.ndarray:
    """By document type; other types by background: inverted if dark, else as text."""
    dark = dark_background(px.gray(img))
    out = (BY_TYPE.get(doc_type) or (_as_inverted if dark else _as_text))(img, dark)
    return px.like(out, img) if out.ndim == 2 else out


def mode_pixels(img: np.ndarray, mode: str) -> np.ndarray:
    out = BY_MODE[mode](img)
    return px.like(out, img) if out.ndim == 2 else out


def enhanced(df: DataFrame, doc_type: str | None = None, out: str = "enhanced", image: str = "image") -> DataFrame:
    """df with the enhanced image; doc_type names a column, null types count as unknown."""
    if doc_type is None:
        return each(df, lambda a: to_value(enhance_pixels(a)), out, IMAGE, image)
    return each(df, lambda a, t: to_value(enhance_pixels(a, t)), out, IMAGE, image, (doc_type,))


def enhanced_as(df: DataFrame, mode: str, out: str = "enhanced", image: str = "image") -> DataFrame:
    """df with the image in a mode of BY_MODE."""
    return each(df, lambda a: to_value(mode_pixels(a, mode)), out, IMAGE, image)


def ocr_variants(df: DataFrame, id_col: str, image: str = "image") -> DataFrame:
    """id, variant, image: a row for each mode, made in one pass over the images."""
    return rows_of(df, id_col, image, lambda img: [(mode, mode_pixels(img, mode)) for mode in BY_MODE], ("variant",), "variant string")


def rows_of(df: DataFrame, id_col: str, image: str, make: Callable[[np.ndarray], list[tuple]], names: tuple[str, ...], kinds: str) -> DataFrame:
    """id, names, image: the rows that make gives for each image, in portions."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = ((key, img) for key, img in zip(pdf[id_col], map(to_array, pdf["image"]), strict=True) if img is not None)
            rows = ({"id": key, "told": told, "image": to_value(made)} for key, img in found for *told, made in make(img))
            for part in portions(rows):
                yield pd.DataFrame([(r["id"], *r["told"], r["image"]) for r in part], columns=[id_col, *names, "image"])

    return df.select(id_col, F.col(image).alias("image")).mapInPandas(run, f"`{id_col}` {kind}, {kinds}, image {IMAGE}")


def find_quad(img: np.ndarray, sensitivity: float = 0.7) -> np.ndarray | None:
    """The corners of the largest four-cornered outline, by area of its convex hull."""
    plane = px.gray(img)
    parts = px.components(px.dilate(px.canny(px.blur(plane), 75, 200)))
    y, x = np.nonzero(parts)
    if not len(y):
        return None
    owner = parts[y, x]
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    hulls = [px.hull(p) for p in np.split(np.stack([x, y], axis=1)[order], cuts)]
    sized = sorted(((px.area(h), h) for h in hulls if len(h) > 3), key=lambda t: -t[0])
    for size, h in sized:
        if size < plane.size * 0.03 * (1 - sensitivity):
            break
        quad = px.simplified(h, 0.02 * px.perimeter(h) * (2 - sensitivity))
        if len(quad) == 4:
            return px.ordered(quad)
    return None


def detected(df: DataFrame, sensitivity: float = 0.7, out: str = "quad", image: str = "image") -> DataFrame:
    """df with the quad of the document, null where none is found."""
    def make(a):
        q = find_quad(a, sensitivity)
        return None if q is None else [{"x": float(x), "y": float(y)} for x, y in q]

    return each(df, make, out, QUAD, image)


def warped(df: DataFrame, quad: str = "quad", out: str = "document", image: str = "image") -> DataFrame:
    """df with the upright picture of the quad; null without one."""
    def make(a, q):
        return None if q is None or len(q) != 4 else to_value(px.warp(a, np.array([[p["x"], p["y"]] for p in q])))

    return each(df, make, out, IMAGE, image, (quad,))


def centre_crop(df: DataFrame, margin: float = 0.1, out: str = "document", image: str = "image") -> DataFrame:
    def make(a):
        dy, dx = int(a.shape[0] * margin), int(a.shape[1] * margin)
        return to_value(a[dy : a.shape[0] - dy, dx : a.shape[1] - dx])

    return each(df, make, out, IMAGE, image)


def straightened(df: DataFrame, out: str = "straight", image: str = "image", at_least: float = 0.5) -> DataFrame:
    """df with the image turned by the median angle of its lines if that is over at_least degrees."""
    def make(a):
        angles = px.line_angles(px.canny(px.gray(a), 50, 150))
        turn = float(np.median(angles)) if len(angles) else 0.0
        return to_value(px.rotated(a, turn) if abs(turn) > at_least else a)

    return each(df, make, out, IMAGE, image)


def rotation(df: DataFrame, out: str = "angle", image: str = "image") -> DataFrame:
    """df with the median angle of the image's straight lines in degrees, 0 without lines."""
    def make(a):
        angles = px.line_angles(px.canny(px.gray(a), 50, 150))
        return float(np.median(angles)) if len(angles) else 0.0

    return each(df, make, out, "double", image)


BACKGROUND = "struct<dark:bigint,light:bigint,is_dark:boolean>"


def background(df: DataFrame, out: str = "background", image: str = "image") -> DataFrame:
    """df with the number of pixels below 128 and from there on, and whether the first is larger."""
    def make(a):
        dark = int((px.gray(a) < 128).sum())
        light = a.shape[0] * a.shape[1] - dark
        return {"dark": dark, "light": light, "is_dark": dark > light}

    return each(df, make, out, BACKGROUND, image)


def histogram(df: DataFrame, bins: int = 32, out: str = "histogram", image: str = "image") -> DataFrame:
    """df with the number of pixels in each of `bins` equal ranges of gray levels (a divisor of 256)."""
    return each(df, lambda a: np.bincount(px.gray(a).ravel() // (256 // bins), minlength=bins).tolist(), out, "array<bigint>", image)


def feature_vector(img: np.ndarray) -> list[float]:
    """Aspect, edge density, outline density, deviation by mean, deviation of row sums, mean and
    deviation by 255, and 32 shares of gray levels: 39 numbers."""
    plane = px.gray(img)
    h, w = plane.shape
    ink = px.adaptive(plane, 11, 2)
    mean, dev = float(plane.mean()), float(plane.std())
    levels = np.bincount(plane.ravel() >> 3, minlength=32) / plane.size
    return [w / h, float((px.canny(plane, 100, 200) > 0).mean()), px.n_outlines(ink) / plane.size, dev / mean if mean else 0.0,
            float((ink.sum(axis=1, dtype=np.int64) / w).std()), mean / 255, dev / 255, *levels.tolist()]


def features(df: DataFrame, out: str = "features", image: str = "image") -> DataFrame:
    return each(df, feature_vector, out, "array<double>", image)


QUALITY = "struct<sharpness:double,brightness:double,contrast:double,ink:double,edges:double,dark:boolean>"


def quality(df: DataFrame, out: str = "quality", image: str = "image") -> DataFrame:
    """Variance of the Laplacian, mean, deviation, shares of ink and edge pixels, dark background."""
    def make(a):
        p = px.gray(a)
        return {"sharpness": float(px.laplacian(p).var()), "brightness": float(p.mean()), "contrast": float(p.std()),
                "ink": float((px.adaptive(p, 11, 2) == 0).mean()), "edges": float((px.canny(p, 50, 150) > 0).mean()), "dark": dark_background(p)}

    return each(df, make, out, QUALITY, image)


def good_enough(q: Column) -> Column:
    """Sharp, neither dark nor washed out, and with contrast."""
    return (q["sharpness"] > 100) & (q["brightness"] > 20) & (q["brightness"] < 235) & (q["contrast"] > 40)


def large_enough(image: Column, least: int = 100) -> Column:
    return (image["h"] >= least) & (image["w"] >= least)


def rule_typed(df: DataFrame, out: str = "doc_type", image: str = "image") -> DataFrame:
    """df with the type by rules on aspect and edge density."""
    made = features(df, "__f", image)
    return made.withColumn(out, classify.rule_type(F.col("__f")[0], F.col("__f")[1])).drop("__f")


def augmented(df: DataFrame, key: str, factor: int = 3, image: str = "image", seed: int = 42) -> DataFrame:
    """df, and for each image of 100 pixels a side or more `factor` changed ones: blurred (even
    copies), noisy (each third), of changed contrast, turned (each fourth). copy counts from 0, -1
    is the original. The changes depend on key, copy and seed alone."""
    grown = df.withColumn("copy", F.explode(F.when(large_enough(F.col(image)), F.sequence(F.lit(-1), F.lit(factor - 1))).otherwise(F.array(F.lit(-1)))))
    grown = grown.withColumn("__s", F.xxhash64(F.lit(seed), F.col(key), F.col("copy")))

    def make(a, j, s):
        if j < 0:
            return to_value(a)
        rng = np.random.default_rng(int(s) & (2**63 - 1))
        if j % 2 == 0:
            a = px.blur(a, 2 * int(rng.integers(3, 7)) + 1)
        if j % 3 == 0:
            a = px.clip8(a + rng.normal(0, 15, a.shape))
        a = contrast(a, rng.uniform(0.8, 1.2), rng.uniform(-30, 30))
        return to_value(px.rotated(a, rng.uniform(-5, 5)) if j % 4 == 0 else a)

    return each(grown, make, image, IMAGE, image, ("copy", "__s")).drop("__s")
