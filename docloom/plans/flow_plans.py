"""Queries of streams, sinks, models and candidates. Streams read the events as they lie there and
end when all are worked on; sinks are written to a new shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.operators import classify, images, ocr, scan, text as tx
from docloom.sources import committed, labelled, sinks
from docloom.sources.shared import new_path
from docloom.streaming import keyed, workers

from .image_plans import _C, drawn
from .table_plans import HOUR, SQL as TABLE_SQL
from .text_plans import table


SLOTS = 4


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _pieces(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Events in files in mixed order, written one time slot after the other, and how late rows come at most. The last file has a tick
    (event -1) long after all events, which lets the watermark pass them."""
    events, path = _events(spark, sf_dir), new_path(spark, "events")
    low, high = events.agg(F.min(F.unix_micros("ts")), F.max(F.unix_micros("ts"))).first()
    low, high = low or 0, high or 0
    width = (high - low) // SLOTS + 1
    slot = F.floor((F.unix_micros("ts") - low) / width) + F.pmod(F.xxhash64("event_id"), F.lit(2))
    for i in range(SLOTS + 1):
        events.where(slot == i).write.mode("append").parquet(path)
    tick = {"event_id": F.lit(-1), "ts": F.timestamp_micros(F.lit(high + 4 * width + 86_400_000_000))}
    last = spark.range(1).select(*[tick.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])
    last.write.mode("append").parquet(path)
    return path, f"{2 * width // 1_000_000 + 1} seconds"


def _stream(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """The pieces as a stream, about one time slot a micro-batch, in however many files a slot was written."""
    per_batch = -(-len(spark.read.schema(_events(spark, sf_dir).schema).parquet(path).inputFiles()) // (SLOTS + 2))
    return spark.readStream.schema(_events(spark, sf_dir).schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _ended(spark: SparkSession, out: DataFrame) -> DataFrame:
    """What a stream writes until its end."""
    path, checkpoint = new_path(spark, "streamed"), new_path(spark, "progress")
    keyed.started(out.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)).awaitTermination()
    return spark.read.schema(out.schema).parquet(path)


def str_2_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounded queues of two places for each type and hour, in streaming state."""
    path, late = _pieces(spark, sf_dir)
    out = keyed.queued_stream(_stream(spark, sf_dir, path), "event_type", 2, "1 hour", late=late)
    return _ended(spark, out).where("event_id >= 0").select("event_id", "event_type")


def str_3_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful form of the throttle on the stream of events."""
    path, late = _pieces(spark, sf_dir)
    out = keyed.throttled_stream(_stream(spark, sf_dir, path), "user_id", HOUR, order="event_id", late=late)
    return _ended(spark, out).where("event_id >= 0").select("event_id", "user_id")


def str_4_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, late = _pieces(spark, sf_dir)
    out = keyed.throttled_stream(_stream(spark, sf_dir, path), "user_id", HOUR, True, order="event_id", late=late)
    return _ended(spark, out).where("event_id >= 0").select("event_id", "user_id")


def str_7_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last click of each user, held over the events that follow."""
    path, late = _pieces(spark, sf_dir)
    seen = _stream(spark, sf_dir, path).withColumn("seen", F.when(F.col("event_type") == "click", F.col("event_id")))
    return _ended(spark, keyed.held_stream(seen, "user_id", "seen", order="event_id", late=late)).where("event_id >= 0").select("event_id", "held")


def str_6_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A worker that takes the newest event of each user and day and sorts it by rules, whatever files the events come in."""
    rule = classify.rule_type(F.col("event_id") % 300 / 100.0, F.col("event_id") % 40 / 100.0)
    path, late = _pieces(spark, sf_dir)
    out, checkpoint = new_path(spark, "batches"), new_path(spark, "progress")
    work = lambda rows: rows.select("event_id", "user_id", rule.alias("kind"))
    workers.run(_stream(spark, sf_dir, path), work, workers.batch_folder(out), checkpoint, "user_id", every="1 day", late=late).awaitTermination()
    return spark.read.parquet(out).where("event_id >= 0").select("event_id", "user_id", "kind")


def str_6_recognised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and the words that come up to two hours after them, as two streams; frames without words come out once."""
    path, late = _pieces(spark, sf_dir)
    frames = _stream(spark, sf_dir, path)
    words = _stream(spark, sf_dir, path).where("event_id < 0 or event_id % 3 > 0").select(
        "event_id", F.expr("ts + make_dt_interval(0, 0, cast(event_id % 200 as int))").alias("said_at"), F.concat(F.lit("text "), "event_id").alias("text"))
    out = workers.recognised(frames, words, "event_id", within="2 hours", late=late).select("event_id", F.col("recognised").alias("text"))
    return _ended(spark, out).where("event_id >= 0")


def str_7_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last detection of another table carried onto each frame: views get the last click of their user, by full hours."""
    hour = table(spark, sf_dir, "events").select("event_id", "user_id", F.date_trunc("hour", "ts").alias("ts"), "event_type")
    clicks = hour.where("event_type = 'click'").withColumn("det_id", F.col("event_id"))
    out = scan.asof(hour.where("event_type = 'view'").select("event_id", "user_id", "ts"), clicks, "user_id", "ts", ["det_id"], "event_id", "event_id")
    return out.select("event_id", "det_id", F.unix_timestamp("found_ts").alias("found_s"))


def str_8_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, checkpoint = new_path(spark, "batches"), new_path(spark, "progress")
    frames = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "events*").parquet(sf_dir)
    workers.run(workers.captured(frames, (F.col("value") > 50) & (F.col("event_type") != "view")), lambda rows: rows, workers.batch_folder(path), checkpoint).awaitTermination()
    return spark.read.parquet(path).select("event_id", "user_id")


def _scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan of each page with text and an analysis record; texts of every third one are blank."""
    key = F.col("s_suppkey")
    parts = F.array(F.struct(key.alias("a"), F.lit("x").alias("b")))
    record = F.struct(F.lit("form").alias("type"), (key % 7).alias("n"), F.lit(None).cast("string").alias("title"), F.array(key, key + 1).alias("list"), parts.alias("parts"), F.create_map(F.lit("k"), key).alias("map"))
    return drawn(spark, sf_dir).select(
        "s_suppkey", F.timestamp_seconds(F.lit(1_700_000_000) + key).alias("ts"), "image", F.when(key % 2 == 0, F.col("image")).alias("enhanced"),
        F.when(key % 3 > 0, F.concat(F.lit("Paid $"), key.cast("string"))).otherwise(F.when(key % 2 == 0, "note").otherwise("  ")).alias("text"), F.when(key % 5 > 0, record).alias("analysis"),
    )


def snk_2_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was written of documents: pictures of all, texts if not blank, records if they hold anything."""
    path = new_path(spark, "documents")
    sinks.write_documents(_scans(spark, sf_dir), path)
    read = [spark.read.parquet(f"{path}/{part}").select("name", value.alias("value")) for part, value in (
        ("texts", F.col("text")), ("records", F.get_json_object("json", "$.amounts[0]")), ("pictures", F.hex(F.substring("content", 2, 3))))]
    return read[0].union(read[1]).union(read[2])


def snk_3_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analyses as they were written, with their lists and maps in words."""
    path = new_path(spark, "scans")
    sinks.write_scans(_scans(spark, sf_dir), path)
    return spark.read.parquet(f"{path}/analyses").select("name", "json")


def snk_3b_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "scans")
    sinks.write_scans(_scans(spark, sf_dir), path, suffix="")
    return spark.read.parquet(f"{path}/texts").select("name", "text")


def snk_5_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form that keeps lists of scalars, as JSON without a file."""
    rows = _scans(spark, sf_dir)
    return rows.select("s_suppkey", sinks.analysis_json(rows, "analysis", True).alias("json"))


def snk_1_saved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved pictures by name: the enhanced one where there is one, else the page itself."""
    path = new_path(spark, "saved")
    sinks.save_enhanced(_scans(spark, sf_dir), path, lambda rows: rows)
    modes = sinks.saved_mode(F.lit("text"), F.lit("auto"))
    return spark.read.parquet(path).select("name", F.hex(F.substring("content", 1, 2)).alias("begins"), modes.alias("mode"))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result of each page: a time, bytes for two pictures (of every second page), its text and an analysis record."""
    key, page = F.col("page_id"), F.col("html")
    record = F.struct(F.lit("form").alias("type"), F.length("url").alias("size"), F.lit(None).cast("string").alias("title"), F.array(key, key + 1).alias("list"))
    return table(spark, sf_dir, "pages").select(
        F.timestamp_seconds(F.lit(1_700_000_000) + key).alias("ts"), F.encode(F.coalesce("url", F.lit("")), "utf-8").alias("document"),
        F.when(key % 2 == 0, F.encode(F.coalesce(page, F.lit("")), "utf-8")).alias("enhanced"), F.when(key % 3 > 0, F.substring(page, 1, 40)).otherwise("").alias("text"), F.when(key % 5 > 0, record).alias("analysis"))


def snk_4_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Demo results, all parts by one commit, written twice under one batch name, and read again."""
    path = new_path(spark, "demo")
    parts = sinks.scan_parts(_results(spark, sf_dir), "demo", None, ("document", "enhanced"))
    for _ in range(2):
        committed.write_parts(parts, path, "demo")
    return committed.read_parts(spark, path).select("part", "name", F.sha2("content", 256).alias("sha256"))


def _files(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Pages as files below folders of their first letter, of several endings; some lie at the top. The five of the largest ids are written last."""
    root = new_path(spark, "files")
    ending = F.element_at(F.array(*map(F.lit, ("jpg", "JPEG", "png", "txt"))), (F.col("page_id") % 4 + 1).cast("int"))
    folder = F.when(F.col("page_id") % 7 == 0, "").otherwise(F.concat(F.lit("class"), F.col("page_id") % 3, F.when(F.col("page_id") % 2 == 0, "/more/").otherwise("/")))
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(folder, F.lit("p"), "page_id", F.lit("."), ending).alias("name"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("content"))
    border = pages.where("page_id % 4 < 3").orderBy(F.desc("page_id")).limit(5).agg(F.min("page_id")).first()[0]
    labelled.write_files(pages.where(F.col("page_id") < F.lit(border)), root)
    labelled.write_files(pages.where(F.col("page_id") >= F.lit(border)), root)
    return root, r"/p(\d+)\.[^/]*$"


def src_5_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of labelled folders, as rows."""
    root, number = _files(spark, sf_dir)
    return labelled.labelled(spark, root).select(F.regexp_extract("path", number, 1).cast("long").alias("page_id"), "label", "length", F.sha2("content", 256).alias("sha256"))


def src_6_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five files; the number is the feature."""
    root, number = _files(spark, sf_dir)
    return labelled.labelled(spark, root, newest=5).select(F.regexp_extract("path", number, 1).cast("long").alias("page_id"), F.sha2("content", 256).alias("sha256"))


def src_4_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures written as JPEG and PNG files' contents, read again: size and light pixels."""
    pages = drawn(spark, sf_dir)
    both = images.encoded(images.encoded(pages, "jpg", kind="jpeg"), "png")
    rows = both.select("s_suppkey", F.posexplode(F.array("jpg", "png")).alias("kind", "content"))
    out = images.background(images.decoded(rows))
    return out.select("s_suppkey", "kind", F.col("image.h").cast("long").alias("h"), F.col("image.w").cast("long").alias("w"), "background.light")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"), F.concat(F.lit("class "), F.col("label").cast("string")).alias("label"))


def src_7_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that was saved and loaded predicts as before; one that is not there is none."""
    rows = _vectors(spark, sf_dir).withColumn("y", F.substring("label", 7, 9).cast("double"))
    model = classify.train(rows, label="y", trees=10, depth=5)
    path = new_path(spark, "model")
    saved = classify.save(model, path) and not classify.save(None, path) and classify.load(f"{path}-not") is None
    before = classify.predict(model, rows).select("vec_id", F.col("pred").alias("p"))
    saved = saved and before.select("p").distinct().count() > 1  # a model of one answer is none
    after = classify.predict(classify.load(path), rows).select("vec_id", "pred")
    return after.join(before, "vec_id").select("vec_id", ((F.col("p") == F.col("pred")) & F.lit(saved)).alias("same"))


def cls_10_trained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results by class on the fifth of the vectors that the forest was not fitted on."""
    *_, by_class = classify.train_and_evaluate(_vectors(spark, sf_dir), "vec_id")
    return by_class.select("true", "total", "correct", F.round("accuracy", 6).alias("accuracy"))


#: What the forest must get right of the held-out fifth of the shapes, as a share.
HELD_OUT = 0.95


def _shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes from the events' keys, with the rules' type as the label to be learnt."""
    from pyspark.ml.functions import array_to_vector

    aspect, edges = F.col("event_id") % 300 / 100.0, F.col("event_id") % 40 / 100.0
    noise = F.pmod(F.xxhash64("event_id"), F.lit(1000)) / 1000.0
    return table(spark, sf_dir, "events").select("event_id", array_to_vector(F.array(aspect, edges, noise).cast("array<double>")).alias("features"), classify.rule_type(aspect, edges).alias("label"))


def cls_2_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forest of the operator's size on rows that it was not fitted on: how many there are, of how many classes, and
    whether it gets HELD_OUT of them right, each with a confidence between 0 and 1."""
    _, classes, _, test, _ = classify.train_and_evaluate(_shapes(spark, sf_dir), "event_id")
    sure = F.min((F.col("confidence").between(0, 1) & F.col("confidence").isNotNull()).cast("int")) == 1
    told = test.agg(F.count("*").alias("n"), (F.avg((F.col("true") == F.col("pred")).cast("double")) >= HELD_OUT).alias("accurate"), sure.alias("sure"))
    return told.withColumn("classes", F.lit(len(classes)).cast("long"))


def cls_7_without_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model or rules: no model at that path, and a model whose classes have no names, so that the rules speak for every row."""
    from pyspark.ml.functions import array_to_vector

    shape = F.array(F.col("event_id") % 300 / 100.0, F.col("event_id") % 40 / 100.0)
    rows = table(spark, sf_dir, "events").select("event_id", array_to_vector(shape.cast("array<double>")).alias("features"), (F.col("event_id") % 3).cast("double").alias("label"))
    missing = classify.predict_or_rules(classify.load(new_path(spark, "no-model")), rows, [])
    path = new_path(spark, "model")
    classify.save(classify.train(rows, trees=3, depth=3), path)
    unnamed = classify.predict_or_rules(classify.load(path), rows, [])
    parts = [r.select("event_id", F.lit(case).alias("case"), "doc_type", "confidence") for case, r in (("missing", missing), ("unnamed", unnamed))]
    return parts[0].union(parts[1])


def cls_9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of rows with repeated and null keys."""
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 3 > 0, F.col("user_id") % 10).alias("k"), "event_id")
    return classify.exact_split(rows, "k").groupBy("is_test").agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("rows"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(key.alias("doc_id"), (key % 5 > 0).alias("found"), F.when(key % 2 == 0, F.concat(F.lit("  raw \n\n "), "role")).alias("raw"), "text")


def txt_18_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of the texts that three settings give."""
    docs = _documents(spark, sf_dir)
    tried = ocr.settings(F.array(F.lit("gray"), F.lit("bw")), (1.0, 1.5), (6,))
    said = docs.where("doc_id % 3 > 0").select("doc_id", "text", F.posexplode(tried).alias("ord", "s"))
    texts = said.select("doc_id", "ord", F.concat(F.substring("text", 1, 20), F.repeat(F.lit("."), (F.col("s.scale") * 2).cast("int")), "s.variant").alias("text"))
    return ocr.best_candidate(docs, texts)


def txt_19_advanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    said = docs.where("doc_id % 3 > 0").select("doc_id", F.posexplode(F.array(F.concat(F.lit(" a \n\n b"), F.repeat(F.lit(" "), F.lit(30))), F.concat(F.lit("abc\n "), F.substring("text", 1, 5)), F.lit(" \n"))).alias("ord", "text"))
    return ocr.best_candidate(docs, said, advanced=True)


def txt_15_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", ocr.empty_info().alias("info"))
    return docs.select("doc_id", ocr.n_items(F.col("info")).alias("n_items"), F.to_json("info").alias("json"))


def txt_12_full_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.lit(3).alias("psm"), F.posexplode(F.split(F.concat(F.lit(" "), "text"), " ", -1)).alias("pos", "text"))
    return ocr.full_text(words).select("doc_id", "text")


def flt_1_blank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The error of blank texts: every third text is blank, every fifth null."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    docs = table(spark, sf_dir, "conversations").select(key.alias("doc_id"), F.when(key % 3 == 0, F.lit(" \t\n")).when(key % 5 > 0, F.col("text")).alias("text"))
    return docs.select("doc_id", tx.analyze(F.col("text"))["error"].alias("error"))


_S = "select s_suppkey, strftime(make_timestamp(1700000000000000 + s_suppkey * 1000000), '%Y%m%d_%H%M%S') as stamp, case when s_suppkey % 3 > 0 then concat('Paid $', s_suppkey) when s_suppkey % 2 = 0 then 'note' else '  ' end as text from supplier"
_JSON = """concat('{{"type":"form","n":', s_suppkey % 7, ',"title":null,"list":[{0}],"parts":["{{\\\\"a\\\\":', s_suppkey, ',\\\\"b\\\\":\\\\"x\\\\"}}"],"map":{{"k":"', s_suppkey, '"}}}}')""".replace("\\\\", "\\")
_DOCS = "select conv_id * 1000 + turn as doc_id, role, text from conversations"
SQL = {
    "str_2_queue": "select event_id, event_type from events qualify row_number() over (partition by event_type, date_trunc('hour', ts) order by ts, event_id) <= 2",
    "str_3_stream": TABLE_SQL["str_3_throttle"],
    "str_6_worker": """select event_id, user_id, case when event_id % 300 / 100.0 < 0.8 then 'receipt' when event_id % 300 / 100.0 <= 1.2 then if(event_id % 40 / 100.0 < 0.1, 'id_card', 'business_card')
      else if(event_id % 40 / 100.0 > 0.15, 'form', 'text_document') end as kind from events qualify row_number() over (partition by user_id, date_trunc('day', ts) order by ts desc, event_id desc) = 1""",
    "str_4_stream": TABLE_SQL["str_4_debounce"],
    "str_7_stream": TABLE_SQL["str_7_last_value"],
    "str_6_recognised": "select event_id, case when event_id % 3 > 0 and event_id % 200 <= 120 then concat('text ', event_id) else 'No text detected' end as text from events",
    "str_7_asof": """with f as (select event_id, user_id, date_trunc('hour', ts) as t from events where event_type = 'view'),
      d as (select user_id, date_trunc('hour', ts) as t, max(event_id) as det_id from events where event_type = 'click' group by 1, 2)
      select event_id, det_id, cast(epoch(d.t) as bigint) as found_s from f asof left join d on f.user_id = d.user_id and f.t >= d.t""",
    "str_8_capture": "select event_id, user_id from events where value > 50 and event_type <> 'view'",
    "snk_1_saved": f"select concat('scan_', stamp, '.jpg') as name, 'FFD8' as begins, 'text' as mode from ({_S})",
    "snk_2_documents": f"""with s as ({_S}) select concat('doc_', stamp, '.txt') as name, text as value from s where trim(text) <> ''
      union all select concat('doc_', stamp, '.json'), concat('$', s_suppkey) from s where s_suppkey % 3 > 0 union all select concat('doc_', stamp, '.png'), '504E47' from s""",
    "snk_3_scans": f"""select concat('scan_', stamp, '_analysis.json') as name, {_JSON.format("\"', s_suppkey, '\",\"', s_suppkey + 1, '\"")} as json from ({_S}) where s_suppkey % 5 > 0""",
    "snk_3b_texts": f"select concat('scan_', stamp, '.txt') as name, text from ({_S})",
    "snk_5_lists": f"""select s_suppkey, case when s_suppkey % 5 > 0 then {_JSON.format("', s_suppkey, ',', s_suppkey + 1, '")} end as json from supplier""",
    "snk_4_demo": f"""with r as (select page_id, strftime(make_timestamp(1700000000000000 + page_id * 1000000), '%Y%m%d_%H%M%S') as stamp, coalesce(url, '') as url, coalesce(html, '') as html, html[1:40] as text from pages)
      select 'document' as part, concat('demo_document_', stamp, '.jpg') as name, sha256(url) as sha256 from r
      union all select 'enhanced', concat('demo_enhanced_', stamp, '.jpg'), sha256(html) from r where page_id % 2 = 0
      union all select 'text', concat('demo_text_', stamp, '.txt'), sha256(text) from r where page_id % 3 > 0 and text <> ''
      union all select 'analysis', concat('demo_analysis_', stamp, '.json'), sha256(concat('{{"type":"form","size":', length(url), ',"title":null,"list":["', page_id, '","', page_id + 1, '"]}}')) from r where page_id % 5 > 0""",
    "src_5_labelled": "select page_id, case when page_id % 7 = 0 then 'text_document' else concat('class', page_id % 3) end as label, strlen(coalesce(html, '')) as length, sha256(coalesce(html, '')) as sha256 from pages where page_id % 4 < 3",
    "src_6_newest": "select page_id, sha256(coalesce(html, '')) as sha256 from pages where page_id % 4 < 3 order by page_id desc limit 5",
    "src_4_files": f"select s_suppkey, cast(k as int) as kind, cast(h as bigint) as h, cast(w as bigint) as w, cast(sheet as bigint) as light from {_C}, range(2) t(k)",
    "src_7_model": "select vec_id, true as same from embeddings",
    "cls_2_held_out": "select cast(floor(count(*) * 0.2) as bigint) as n, true as accurate, true as sure, cast(5 as bigint) as classes from events",
    "cls_7_without_model": """select event_id, k as case, case when aspect < 0.8 then 'receipt' when aspect <= 1.2 then if(edges < 0.1, 'id_card', 'business_card') else if(edges > 0.15, 'form', 'text_document') end as doc_type, c as confidence
      from (select event_id, event_id % 300 / 100.0 as aspect, event_id % 40 / 100.0 as edges from events), (values ('missing', 0.6::double), ('unnamed', 0.5::double)) v(k, c)""",
    "cls_9_repeats": "select t as is_test, case when t then cast(floor(n * 0.2) as bigint) else n - cast(floor(n * 0.2) as bigint) end as n, case when t then cast(floor(n * 0.2) as bigint) else n - cast(floor(n * 0.2) as bigint) end as rows from (select count(*) as n from events), (values (true), (false)) v(t)",
    "txt_18_fast": f"select doc_id, case when doc_id % 5 = 0 then 'No document detected' when doc_id % 3 = 0 then 'No text detected' else concat(text[1:20], '...gray') end as text from ({_DOCS})",
    "txt_19_advanced": f"""select doc_id, case when doc_id % 5 = 0 then 'No document detected' when doc_id % 3 > 0 then concat('abc', case when trim(text[1:5]) <> '' then concat(chr(10), trim(text[1:5])) else '' end)
      when doc_id % 2 = 0 then concat('raw', chr(10), role) else 'No text detected' end as text from ({_DOCS})""",
    "txt_15_empty": f"""select doc_id, cast(0 as bigint) as n_items, '{{"dates":[],"emails":[],"phones":[],"addresses":[],"amounts":[]}}' as json from ({_DOCS})""",
    "txt_12_full_text": f"select doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: trim(x) <> ''), ' ') as text from ({_DOCS})",
    "flt_1_blank": f"select doc_id, case when doc_id % 3 = 0 or doc_id % 5 = 0 or trim(text) = '' then 'Empty text' end as error from ({_DOCS})",
}
QUERIES = {f.__name__: f for f in (
    str_2_queue, str_3_stream, str_4_stream, str_6_worker, str_6_recognised, str_7_stream, str_7_asof, str_8_capture, snk_1_saved, snk_2_documents, snk_3_scans, snk_3b_texts, snk_5_lists, snk_4_demo, src_4_files, src_5_labelled, src_6_newest, src_7_model, cls_2_held_out, cls_7_without_model, cls_10_trained, cls_9_repeats,
    txt_18_fast, txt_19_advanced, txt_15_empty, txt_12_full_text, flt_1_blank,
)}
