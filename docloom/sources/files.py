"""Sources: labelled image folders and frame files. Null: files that no reader decodes stay rows
of bytes; the caller filters them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

IMAGES = "*.{jpg,jpeg,png,JPG,JPEG,PNG}"


def labelled_files(spark: SparkSession, root: str, pattern: str = IMAGES, default: str = "text_document") -> DataFrame:
    """path, content, label: the first folder below root, or `default` for files at the top."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    below = F.element_at(F.split("path", F.lit(root.rstrip("/") + "/"), 2), 2)
    parts = F.split(below, "/")
    return rows.select("path", "content", "modificationTime", F.when(F.size(parts) > 1, parts[0]).otherwise(default).alias("label"))


def frames(spark: SparkSession, root: str, pattern: str = IMAGES, per_batch: int = 100) -> DataFrame:
    """A stream of image files as they appear below root: path, modificationTime, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(root)
    return rows.select("path", "modificationTime", "content")


def newest_files(spark: SparkSession, root: str, n: int = 5, pattern: str = IMAGES) -> DataFrame:
    """path, modificationTime, content of the n newest files below root, ties by path; contents are
    read of these n only."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    top = listed.select("path", "modificationTime").orderBy(F.desc("modificationTime"), "path").limit(n)
    return listed.join(F.broadcast(top.select("path")), "path").select("path", "modificationTime", "content")
