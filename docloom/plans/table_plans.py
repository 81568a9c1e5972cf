"""Queries of the OCR-table, classification, geometry and event-stream operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.functions import rx
from docloom.operators import classify, geometry, keywords, ocr, text as tx
from docloom.streaming import throttle

from .text_plans import table

HOUR = 3600.0
CONF = "cast((pos * 7 + doc_id * 3) % 101 - 1 as double)"
TOP = "cast(floor(pos / 9) * 12 + pos % 3 * 2 as int)"


def word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OCR word table made from all documents: nine words a line, confidences from keys."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ", -1)).alias("pos", "text"))
    return words.select("doc_id", F.lit(3).alias("psm"), "pos", "text", F.expr(CONF).alias("conf"), F.expr(TOP).alias("top"))


def agg_1_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.confidence(word_table(spark, sf_dir)).select("doc_id", F.round("confidence", 6).alias("confidence"))


def win_1_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.blocks(word_table(spark, sf_dir)).select("doc_id", F.col("block").cast("long").alias("block"), "text")


def win_3_best_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.posexplode(F.split("text", " ", -1)).alias("pos", "text"))
    modes = turns.select("doc_id", "pos", "text", F.explode(F.array(F.lit(3), F.lit(6), F.lit(4))).alias("psm"))
    words = modes.withColumns({"conf": F.expr("cast((doc_id + pos * (psm % 4)) % 7 as double)"), "top": F.lit(0)})
    return ocr.best_mode(words).select("doc_id", "psm", F.round("confidence", 6).alias("confidence"), "text")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "text")
    forms = F.array(F.concat("text", F.lit("!")), F.col("text"), F.concat(F.col("text"), F.lit("   ")), F.lit("  "))
    return t.select("doc_id", F.posexplode(forms).alias("ord", "text"))


def srt_5_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.longest(_candidates(spark, sf_dir), F.length("text"))


def srt_6_most_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.longest(_candidates(spark, sf_dir), tx.ink(F.col("text")))


SHAPE = "event_id % 300 / 100.0D as aspect, event_id % 40 / 100.0D as edges, event_id % 37 / 100.0D as ink"


def cls_5_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").selectExpr("event_id", *SHAPE.split(", "))
    both = classify.rule_type_with_confidence(F.col("aspect"), F.col("ink"), F.col("edges"))
    return e.select("event_id", classify.rule_type(F.col("aspect"), F.col("edges")).alias("rule_1"), both["type"].alias("rule_2"), both["confidence"].alias("confidence"))


def agg_5_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").selectExpr("toxic as true", "1 - quality as pred")
    return classify.evaluate(rows, [0, 1]).select(F.col("true").cast("long").alias("label"), "total", "correct", F.round("accuracy", 6).alias("accuracy"))


def jn_1_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, la = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return d.join(la, "doc_id").groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").cast("long").alias("good"), F.sum("n_chars").alias("chars"))


def cls_9_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.exact_split(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    return out.groupBy("is_test").agg(F.count("*").alias("n"))


def cls_4_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    rows = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector("embedding").alias("features"), F.col("label").cast("double").alias("label"))
    return classify.predict(classify.train(rows), rows).select("vec_id", "pred", "confidence")


X, Y = "cast(l_orderkey % 500 as double)", "cast(l_partkey % 300 as double)"


def geo_1_quads(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = "array(struct({0} + 200 as x, {1} + 100 as y), struct({0} as x, {1} as y), struct({0} as x, {1} + 100 as y), struct({0} + 200 as x, {1} as y))".format(X, Y)
    q = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", geometry.ordered(F.expr(p)).alias("q"))
    q = q.select("*", geometry.size(F.col("q")).alias("s"))
    return q.select("l_orderkey", "l_linenumber", F.col("q")[0]["x"].alias("tl_x"), F.col("q")[2]["y"].alias("br_y"), "s.width", "s.height", geometry.aspect(F.col("s.width"), F.col("s.height")).alias("aspect"))


def agg_8_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.rate(table(spark, sf_dir, "events"), every="1 hour").select(F.unix_timestamp("start").alias("start_s"), "n")


def str_1_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.latest_sample(table(spark, sf_dir, "events"), "user_id").select("user_id", "event_id", "value")


def str_3_throttle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.throttled(table(spark, sf_dir, "events"), "user_id", HOUR, order="event_id").select("event_id", "user_id")


def str_4_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throttle.debounced(table(spark, sf_dir, "events"), "user_id", HOUR, order="event_id").select("event_id", "user_id")


def str_7_last_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("seen", F.when(F.col("event_type") == "click", F.col("event_id")))
    return throttle.last_value(e, "user_id", "seen", ["ts", "event_id"]).select("event_id", "held")


def agg_9_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.running_count(table(spark, sf_dir, "events"), "user_id", "event_id").select("event_id", F.col("n"))


def win_4_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.modes_in_turn(table(spark, sf_dir, "events").select("event_id"), F.col("event_id"), ("text", "bw", "color"))


def jn_3_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by the five lists, as a table of keywords."""
    found = keywords.scores(table(spark, sf_dir, "documents"), keywords.table_of(spark, rx.KEYWORDS))
    return found.select(F.col("id").alias("doc_id"), "kind", "score")


def jn_4_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a dictionary that grows with the tables: every word of three letters and more that conversations use, by its first letter."""
    said = table(spark, sf_dir, "conversations").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("keyword")).where("length(keyword) >= 3").distinct()
    known = said.select(F.substring("keyword", 1, 1).alias("kind"), "keyword", F.lit(0).alias("rank"))
    return keywords.scores(table(spark, sf_dir, "documents"), known).select(F.col("id").alias("doc_id"), "kind", "score")


_LISTS = ", ".join(f"('{k}', '{w}')" for k, words in rx.KEYWORDS.items() for w in words)
_RUNS = r"select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{Nd}_]+|[^\p{L}\p{M}\p{Nd}_]+') as r, row_number() over () as rid from documents"
_GRAMS = f"""with d as ({_RUNS}), t as (select doc_id, rid, r, unnest(range(1, len(r) + 1)) as i from d),
  g as (select doc_id, rid, r[i] as g from t union all select doc_id, rid, r[i] || r[i + 1] || r[i + 2] from t where r[i + 1] = ' ')"""
_WORDS = f"select doc_id, pos, word as text, {CONF} as conf, {TOP} as top from (select doc_id, unnest(string_split(text, ' ')) as word, unnest(range(len(string_split(text, ' ')))) as pos from documents)"
_TURNS = "select conv_id * 1000 + turn as doc_id, text from conversations"
_WALK = """with recursive e as (select event_id, user_id, epoch(ts) as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
  w as (select event_id, user_id, rn, t as last, true as keep from e where rn = 1
        union all select e.event_id, e.user_id, e.rn, case when e.t - w.last {0} 3600 then e.t else w.last end, e.t - w.last {0} 3600 from w join e on e.user_id = w.user_id and e.rn = w.rn + 1)
  select event_id, user_id from w where keep"""
_BEST = """with c as ({0}), k as (select doc_id, unnest([concat(text, '!'), text, concat(text, '   '), '  ']) as t, unnest([0, 1, 2, 3]) as o from c)
  select doc_id, coalesce(first(t order by {1} desc, o) filter (where trim(t) <> ''), 'No text detected') as text from k group by 1"""
SQL = {
    "agg_1_confidence": f"select doc_id, round(coalesce(avg(conf) filter (where conf > 0), 0.0), 6) as confidence from ({_WORDS}) group by 1",
    "win_1_blocks": f"""with k as (select * from ({_WORDS}) where conf >= 0 and trim(text) <> ''),
      j as (select *, case when abs(top - lag(top) over (partition by doc_id order by pos)) > 5 then 1 else 0 end as jump from k),
      b as (select *, sum(jump) over (partition by doc_id order by pos) as block from j)
      select doc_id, cast(block as bigint) as block, string_agg(text, ' ' order by pos) as text from b group by 1, 2""",
    "win_3_best_mode": f"""with t as ({_TURNS}), w as (select doc_id, unnest(string_split(text, ' ')) as text, unnest(range(len(string_split(text, ' ')))) as pos from t),
      m as (select w.*, psm, o from w, (values (3, 0), (6, 1), (4, 2)) v(psm, o)),
      s as (select doc_id, psm, o, coalesce(avg(c) filter (where c > 0), 0) as confidence, count(*) filter (where trim(text) <> '') as n, string_agg(text, ' ' order by pos) filter (where trim(text) <> '') as text
            from (select *, cast((doc_id + pos * (psm % 4)) % 7 as double) as c from m) group by 1, 2, 3)
      select doc_id, psm, round(confidence, 6) as confidence, text from s where confidence > 0 and n > 0 qualify row_number() over (partition by doc_id order by confidence desc, o) = 1""",
    "srt_5_longest": _BEST.format(_TURNS, "length(t)"),
    "srt_6_most_ink": _BEST.format(_TURNS, "length(replace(replace(t, ' ', ''), chr(10), ''))"),
    "cls_5_rules": """with e as (select event_id, event_id % 300 / 100.0::double as aspect, event_id % 40 / 100.0::double as edges, event_id % 37 / 100.0::double as ink from events)
      select event_id, case when aspect < 0.8 then 'receipt' when aspect <= 1.2 then if(edges < 0.1, 'id_card', 'business_card') else if(edges > 0.15, 'form', 'text_document') end as rule_1,
      case when aspect > 1.4 then if(ink > 0.15, 'letter', 'receipt') when edges > 0.1 then if(ink > 0.2, 'form', 'id_card') else 'photo' end as rule_2,
      cast(case when aspect > 1.4 then if(ink > 0.15, 0.8, 0.7) when edges > 0.1 then if(ink > 0.2, 0.75, 0.85) else 0.9 end as double) as confidence from e""",
    "agg_5_evaluate": "select cast(toxic as bigint) as label, count(*) as total, count(*) filter (where toxic = 1 - quality) as correct, round(avg(case when toxic = 1 - quality then 1.0 else 0.0 end), 6) as accuracy from labels group by 1",
    "jn_1_labelled": "select lang, count(*) as n, cast(sum(quality) as bigint) as good, cast(sum(n_chars) as bigint) as chars from documents join labels using (doc_id) group by 1",
    "cls_9_split": "select t as is_test, case when t then cast(floor(n * 0.2) as bigint) else n - cast(floor(n * 0.2) as bigint) end as n from (select count(*) as n from labels), (values (true), (false)) v(t)",
    "jn_3_keywords": f"{_GRAMS} select doc_id, kind, count(*) as score from g join (values {_LISTS}) k(kind, word) on g = word group by rid, doc_id, kind",
    "jn_4_dictionary": f"""{_GRAMS}, k as (select distinct unnest(regexp_extract_all(lower(text), '[a-z]+')) as word from conversations)
      select doc_id, word[1:1] as kind, count(*) as score from g join k on g = word where length(word) >= 3 group by rid, doc_id, kind""",
    "geo_1_quads": f"select l_orderkey, l_linenumber, {X} as tl_x, {Y} + 100 as br_y, 200 as width, 100 as height, 2.0::double as aspect from lineitem",
    "agg_8_rate": "select cast(epoch(date_trunc('hour', ts)) as bigint) as start_s, count(*) as n from events group by 1",
    "str_1_latest": "select user_id, event_id, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "str_3_throttle": _WALK.format(">"),
    "str_4_debounce": _WALK.format(">="),
    "str_7_last_value": "select event_id, last_value(case when event_type = 'click' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as held from events",
    "agg_9_counter": "select event_id, count(*) over (partition by user_id order by event_id rows between unbounded preceding and current row) as n from events",
    "win_4_cycle": "select event_id, case event_id % 3 when 0 then 'text' when 1 then 'bw' else 'color' end as mode from events",
}
QUERIES = {f.__name__: f for f in (
    agg_1_confidence, win_1_blocks, win_3_best_mode, srt_5_longest, srt_6_most_ink, cls_5_rules, agg_5_evaluate, jn_1_labelled, cls_9_split, cls_4_forest, geo_1_quads,
    jn_3_keywords, jn_4_dictionary, agg_8_rate, str_1_latest, str_3_throttle, str_4_debounce, str_7_last_value, agg_9_counter, win_4_cycle,
)}
