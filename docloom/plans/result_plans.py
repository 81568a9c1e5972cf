"""Queries over results: counts and averages by type, stage times, angles, modes and candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from docloom.operators import classify

from .text_plans import table

TIMED = ("event_id", "event_type as doc_type", "event_id % 97 / 100.0D as confidence",
         "case when event_id % 3 <> 0 then cast(event_id % 50 as double) end as ocr_s", "case when event_id % 4 <> 0 then cast(event_id % 20 as double) end as analysis_s")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr(*TIMED)


def agg_4_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify.accuracy(table(spark, sf_dir, "labels").selectExpr("toxic as true", "1 - quality as pred"))
    return out.select(F.round("accuracy", 6).alias("accuracy"))


def agg_6_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.averages_by(_results(spark, sf_dir), "doc_type", "confidence").withColumn("confidence", F.round("confidence", 6))


def agg_7_stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each average is over the rows that have the stage."""
    times = classify.stage_times(_results(spark, sf_dir), ["ocr_s", "analysis_s"])
    return times.select(F.round("ocr_s", 6).alias("ocr_s"), F.round("analysis_s", 6).alias("analysis_s"))


def agg_10_median_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angles from 45 to 135 count from upright; the exact median of each page's lines."""
    e = table(spark, sf_dir, "events").selectExpr("user_id", "cast(event_id * 7 % 180 as double) as angle")
    return classify.median_angle(e, "user_id", "angle")


def agg_13_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select("doc_type").distinct()


def cls_7_model_or_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's type where there is one, else the rules' with 0.6."""
    e = table(spark, sf_dir, "events").selectExpr(
        "event_id", "case when event_id % 5 <> 0 then event_type end as model_type", "event_id % 97 / 100.0D as model_confidence",
        "event_id % 300 / 100.0D as aspect", "event_id % 40 / 100.0D as edges")
    rules = classify.rule_type(F.col("aspect"), F.col("edges"))
    known = F.col("model_type").isNotNull()
    return e.select("event_id", F.coalesce("model_type", rules).alias("doc_type"), F.when(known, F.col("model_confidence")).otherwise(0.6).alias("confidence"))


def jn_2_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation turn with the 12 settings of a fixed list: made from literals, no join."""
    scale, psm = F.array(*[F.lit(x) for x in (1.0, 1.5, 2.0)]), F.array(*[F.lit(x) for x in (6, 4, 11, 3)])
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(scale).alias("scale"))
    return t.select("conv_id", "turn", "scale", F.explode(psm.cast("array<bigint>")).alias("psm"))


def srt_7_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest five; the number is the feature."""
    return classify.newest(table(spark, sf_dir, "events"), ["ts", "event_id"], 5).select("event_id", "user_id")


_E = """(select event_id, event_type as doc_type, event_id % 97 / 100.0::double as confidence,
  case when event_id % 3 <> 0 then cast(event_id % 50 as double) end as ocr_s, case when event_id % 4 <> 0 then cast(event_id % 20 as double) end as analysis_s from events)"""
SQL = {
    "agg_4_accuracy": "select round(avg(case when toxic = 1 - quality then 1.0 else 0.0 end), 6) as accuracy from labels",
    "agg_6_by_type": f"select doc_type, count(*) as n, round(avg(confidence), 6) as confidence from {_E} group by 1",
    "agg_7_stage_times": f"select round(avg(ocr_s), 6) as ocr_s, round(avg(analysis_s), 6) as analysis_s from {_E}",
    "agg_10_median_angle": """with a as (select user_id, cast(event_id * 7 % 180 as double) as angle from events)
      select user_id, median(angle) as raw, median(case when angle between 45 and 135 then angle - 90 else angle end) as angle from a group by 1""",
    "agg_13_types": "select distinct event_type as doc_type from events",
    "cls_7_model_or_rules": """with e as (select event_id, case when event_id % 5 <> 0 then event_type end as m, event_id % 97 / 100.0::double as c,
        event_id % 300 / 100.0::double as aspect, event_id % 40 / 100.0::double as edges from events)
      select event_id, coalesce(m, case when aspect < 0.8 then 'receipt' when aspect <= 1.2 then if(edges < 0.1, 'id_card', 'business_card') else if(edges > 0.15, 'form', 'text_document') end) as doc_type,
        cast(case when m is not null then c else 0.6 end as double) as confidence from e""",
    "jn_2_settings": "select conv_id, turn, cast(scale as double) as scale, cast(psm as bigint) as psm from conversations, (values (1.0), (1.5), (2.0)) s(scale), (values (6), (4), (11), (3)) p(psm)",
    "srt_7_newest": "select event_id, user_id from events order by ts desc, event_id desc limit 5",
}
QUERIES = {f.__name__: f for f in (agg_4_accuracy, agg_6_by_type, agg_7_stage_times, agg_10_median_angle, agg_13_types, cls_7_model_or_rules, jn_2_settings, srt_7_newest)}
