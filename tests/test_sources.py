import os
import time

import pytest
from pyspark.sql import functions as F

from docloom.sources import committed, labelled


def test_labelled_files_are_planned_from_metadata(spark, tmp_path):
    for i, name in enumerate(["a/1.jpg", "a/deep/2.PNG", "b/3.jpeg", "4.JPG", "b/no.txt", "b/5.png"]):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(bytes([i]) * (i + 1))
        os.utime(tmp_path / name, (1_700_000_000 + i // 2, 1_700_000_000 + i // 2))
    got = {os.path.basename(r.path): (r.label, bytes(r.content), r.length) for r in labelled.labelled(spark, str(tmp_path), bytes=4).collect()}
    assert got == {"1.jpg": ("a", b"\0", 1), "2.PNG": ("a", b"\1\1", 2), "3.jpeg": ("b", b"\2" * 3, 3), "4.JPG": ("text_document", b"\3" * 4, 4), "5.png": ("b", b"\5" * 6, 6)}
    assert labelled.labelled(spark, str(tmp_path), bytes=4).rdd.getNumPartitions() == 4  # 1 | 2, 3 alone, ...
    newest = labelled.labelled(spark, str(tmp_path), newest=2).collect()
    assert [os.path.basename(r.path) for r in sorted(newest, key=lambda r: (-r.modificationTime.timestamp(), r.path))] == ["5.png", "4.JPG"]
    assert labelled.labelled(spark, f"file://{tmp_path}").count() == 5 and labelled.labelled(spark, str(tmp_path / "none")).count() == 0


def test_stream_of_files_is_admitted_in_order_and_restarts(spark, tmp_path):
    put = lambda names: [((tmp_path / f"in/x").mkdir(parents=True, exist_ok=True), (tmp_path / f"in/x/{n}.png").write_bytes(n.encode())) for n in names]
    put("abcde")

    def run():
        sizes = []

        def sink(rows, number):
            rows.write.mode("overwrite").parquet(str(tmp_path / f"out/n={number}"))
            sizes.append(rows.count())

        files = labelled.labelled_stream(spark, str(tmp_path / "in"), str(tmp_path / "place"), per_batch=2)
        q = files.select("label", "content").writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.processAllAvailable()
        q.stop()
        return sizes

    first = run()
    assert sum(first) == 5 and max(first) <= 2
    time.sleep(0.05)
    put("fg")
    assert sum(run()) == 2
    assert sorted(bytes(r.content) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [c.encode() for c in "abcdefg"]


def parts(spark, n, tag=""):
    return spark.range(n).select(F.when(F.col("id") % 3 > 0, F.concat(F.lit("p"), F.col("id") % 3)).alias("part"), F.concat(F.lit(tag), F.col("id")).alias("name"), F.when(F.col("id") % 5 > 0, F.col("id").cast("string").cast("binary")).alias("content")).repartition(3)


def test_parts_have_one_commit(spark, tmp_path):
    path = str(tmp_path / "sink")
    read = lambda part=None: sorted((r.part or "", r.name, bytes(r.content or b"-")) for r in committed.read_parts(spark, path, part).collect())
    want = sorted((r.part or "", r.name, bytes(r.content or b"-")) for r in parts(spark, 20).collect())
    assert read() == []
    committed.write_parts(parts(spark, 20), path, "one")
    assert read() == want and read("p1") == [w for w in want if w[0] == "p1"]
    committed.write_parts(parts(spark, 20), path, "one")  # the same batch again
    assert read() == want
    fail = F.udf(lambda name: 1 // 0 if name == "x7" else name)
    before = sorted(str(p) for p in (tmp_path / "sink").rglob("*.parquet"))
    with pytest.raises(Exception, match="ZeroDivision"):
        committed.write_parts(parts(spark, 20, "x").withColumn("name", fail("name")), path, "two")
    assert read() == want
    time.sleep(1)
    committed.sweep(path, 0.0)  # what killed tasks have left
    assert sorted(str(p) for p in (tmp_path / "sink").rglob("*.parquet")) == before and read() == want
    committed.write_parts(parts(spark, 4, "y"), path, "two")
    assert len(read()) == 24
    committed.write_parts(parts(spark, 2, "z"), path, overwrite=True)
    assert [r[1] for r in read()] == ["z0", "z1"]


def test_stream_into_parts_is_written_once(spark, tmp_path):
    for i in range(3):
        parts(spark, 5, f"f{i}-").write.parquet(str(tmp_path / f"in/{i}"))
    spark.dataSource.register(committed.CommittedParts)

    def run(checkpoint):
        rows = spark.readStream.schema(committed.SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        rows.writeStream.format("committed_parts").option("path", str(tmp_path / "sink")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start().awaitTermination()
        return sorted(r.name for r in committed.read_parts(spark, str(tmp_path / "sink")).collect())

    want = sorted(f"f{i}-{k}" for i in range(3) for k in range(5))
    assert run("cp") == want
    assert run("other") == want  # the same batches again, from a lost checkpoint


def test_what_is_written_leaves_no_shuffle_files(spark):
    import time

    from docloom.sources import shared

    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in map(str, spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles().toSeq())) if "shuffle_" in n}
    before, setting = files(), spark.conf.get(shared.CLEAN_UP, None)
    shared.written(spark.range(100_000).repartition(7, "id"), "few")
    assert spark.conf.get(shared.CLEAN_UP, None) == setting
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
