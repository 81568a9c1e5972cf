"""Sinks of scans: images, text and JSON by document, in folders of part files.

Null fields stay in the JSON. A stamp names what belongs together: `scan_<stamp>` and the like, as
a column `name` of each table that is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, AtomicType, DataType, MapType, StructType

from docloom.operators import images, ocr


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def write_texts(rows: DataFrame, path: str, text: str = "text") -> None:
    rows.where(F.trim(text) != "").select(text).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def _said(c: Column, kind: DataType) -> Column:
    """A value in words: scalars as they are, anything nested as JSON."""
    return c.cast("string") if isinstance(kind, AtomicType) else F.to_json(c)


def plain(c: Column, kind: DataType, keep_scalars: bool = False) -> Column:
    """A field as the JSON sinks write it: scalars stay, a list becomes a list of strings (with
    keep_scalars a list of scalars stays), a map or record a map of strings."""
    if isinstance(kind, ArrayType):
        if keep_scalars and isinstance(kind.elementType, AtomicType):
            return c
        return F.transform(c, lambda x: _said(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.map_from_entries(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), _said(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, StructType):
        pairs = [x for f in kind.fields for x in (F.lit(f.name), _said(c[f.name], f.dataType))]
        return F.when(c.isNotNull(), F.create_map(*pairs)) if pairs else F.lit(None).cast("map<string,string>")
    return c


def analysis_json(rows: DataFrame, analysis: str = "analysis", keep_scalars: bool = False) -> Column:
    """The JSON text of a record column with plain fields; null for a null record."""
    kind = rows.schema[analysis].dataType
    fields = [plain(F.col(analysis)[f.name], f.dataType, keep_scalars).alias(f.name) for f in kind.fields]
    return F.when(F.col(analysis).isNotNull(), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}))


def _picture(rows: DataFrame, image: str, name: Column, path: str, kind: str = "jpeg") -> None:
    """name, content of the rows with a picture."""
    made = images.encoded(rows.where(F.col(image).isNotNull()).select(name.alias("name"), F.col(image).alias("image")), "content", kind=kind)
    made.where("content is not null").select("name", "content").write.mode("overwrite").parquet(path)


def write_scans(rows: DataFrame, path: str, keep_scalars: bool = False, suffix: str = "_text", prefix: str = "scan") -> None:
    """Saved documents: rows with ts, image, enhanced, text and analysis. Four tables below path, keyed by
    file name: originals, enhanced (pictures, JPEG), texts (where there is text), analyses (JSON)."""
    base = F.concat(F.lit(f"{prefix}_"), stamp(F.col("ts")))
    _picture(rows, "image", F.concat(base, F.lit(".jpg")), f"{path}/originals")
    _picture(rows, "enhanced", F.concat(base, F.lit("_enhanced.jpg")), f"{path}/enhanced")
    rows.where("text <> ''").select(F.concat(base, F.lit(f"{suffix}.txt")).alias("name"), "text").write.mode("overwrite").parquet(f"{path}/texts")
    told = rows.select(F.concat(base, F.lit("_analysis.json")).alias("name"), analysis_json(rows, "analysis", keep_scalars).alias("json"))
    told.where("json is not null").write.mode("overwrite").parquet(f"{path}/analyses")


def write_documents(rows: DataFrame, path: str) -> None:
    """Saved documents with found text: rows with ts, image and text. Pictures (PNG) of all; texts where
    they are not blank; structured records as JSON where in addition some list of them is not empty."""
    base = F.concat(F.lit("doc_"), stamp(F.col("ts")))
    _picture(rows, "image", F.concat(base, F.lit(".png")), f"{path}/pictures", "png")
    told = rows.where(F.trim("text") != "").select(base.alias("base"), "text", ocr.structured_info(F.col("text")).alias("info"))
    told.select(F.concat("base", F.lit(".txt")).alias("name"), "text").write.mode("overwrite").parquet(f"{path}/texts")
    some = told.where(ocr.n_items(F.col("info")) > 0)
    some.select(F.concat("base", F.lit(".json")).alias("name"), F.to_json("info").alias("json")).write.mode("overwrite").parquet(f"{path}/records")


def scan_parts(rows: DataFrame, prefix: str = "scan", suffix: str = "_text", pictures: tuple[str, ...] = (), keep_scalars: bool = False) -> DataFrame:
    """part, name, content of saved scans, for `committed.write_parts`: a row for each picture (columns of encoded bytes), for the text where
    there is any, and for the analysis. rows: ts, the pictures, text, analysis. Names: <prefix>_<part><stamp> as the demo
    saves them (<prefix>_document_<stamp>.jpg), with suffix None; else <prefix>_<stamp><suffix>.txt and so on."""
    time = stamp(F.col("ts"))

    def name(kind: str, ending: str) -> Column:
        if suffix is None:
            return F.concat(F.lit(f"{prefix}_{kind}_"), time, F.lit(ending))
        tail = {"text": suffix, "analysis": "_analysis", "document": ""}.get(kind, f"_{kind}")
        return F.concat(F.lit(f"{prefix}_"), time, F.lit(f"{tail}{ending}"))

    part = lambda kind, ending, content: F.struct(F.lit(kind).alias("part"), name(kind, ending).alias("name"), content.alias("content"))
    parts = [part(p, ".jpg", F.col(p)) for p in pictures]
    parts.append(part("text", ".txt", F.when(F.col("text") != "", F.col("text").cast("binary"))))
    parts.append(part("analysis", ".json", analysis_json(rows, "analysis", keep_scalars).cast("binary")))
    return rows.select(F.explode(F.filter(F.array(*parts), lambda x: x["content"].isNotNull())).alias("p")).select("p.*")


def saved_mode(doc_type: Column, mode: Column) -> Column:
    """The enhancement of a document that is saved: the chosen mode; where that is auto, text and
    photo documents get the mode of their name."""
    return F.when((mode == "auto") & doc_type.isin("text", "photo"), doc_type).otherwise(mode)


def save_enhanced(rows: DataFrame, path: str, enhance: Callable[[DataFrame], DataFrame]) -> None:
    """Rows with ts and image: pictures enhanced by `enhance` (which adds `enhanced`), the image itself
    where that gives none, as scan_<stamp>.jpg. Rows without an image are not saved."""
    made = enhance(rows.where("image is not null"))
    kept = made.withColumn("image", F.coalesce("enhanced", "image"))
    _picture(kept, "image", F.concat(F.lit("scan_"), stamp(F.col("ts")), F.lit(".jpg")), path)
