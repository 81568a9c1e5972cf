"""The queries opN_<name> over whole tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ball_kmeans, dartminhash, decontaminate, exact_dedup, fill_middle, hilbert_shards, html_extract, license_scan, ngram_score, oracles, packing, suffix_dedup, toxicity, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated", "n_near",
    )


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dartminhash.near_groups(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path()).withColumnRenamed("id", "doc_id")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.round("score", 6).alias("score"),
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.hilbert_shards(table(spark, sf_dir, "documents"), 40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_passages(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256", (F.col("n_removed") > 0).alias("repeats")
    )


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    target = table(spark, sf_dir, "labels").where("quality = 1")
    out = ngram_score.ngram_scores(docs, target)
    return out.select(F.col("id").alias("doc_id"), "n_tokens", *[F.round(c, 6).alias(c) for c in ("loss_target", "loss_background", "ce_diff")])


def op11_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.main_text(table(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op12_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ball_kmeans.clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return made.select(F.col("id").alias("doc_id"), "n", "form", "prefix_chars", "middle_chars", "output_sha256", F.sha2(back, 256).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_toxicity, op3_decontaminate, op4_near_dedup, op5_packing,
        op6_license_scan, op7_warc, op8_sharding, op9_suffix_dedup, op10_lm_score,
        op11_html_extract, op12_ball_kmeans, op13_fill_middle,
    )}


_EXACT = r"""
with d as (
  select doc_id, length(coalesce(text, '')) as n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) as text_sha256
  from documents)
select doc_id, first_value(doc_id) over g as keep_id, count(*) over (partition by text_sha256) as group_size,
       row_number() over g = 1 as kept, text_sha256
from d window g as (partition by text_sha256 order by n desc, doc_id)
"""

_DECONTAMINATE = r"""
with dw as (
  select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents),
bw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null),
b as (select item_id, w, least(len(w), 10) as n, unnest(range(0, greatest(len(w) - 10, 0) + 1)) as s from bw where len(w) > 0),
win as (select distinct item_id, n, array_to_string(w[s + 1 : s + n], ' ') as k from b),
sizes as (select distinct n from win),
dwin as (
  select doc_id, n, p, array_to_string(w[p + 1 : p + n], ' ') as k
  from (select doc_id, w, n, unnest(range(0, len(w) - n + 1)) as p from dw, sizes where len(w) >= n)),
hit as (select d.doc_id, d.p, d.n, win.item_id from dwin d join win using (n, k)),
pos as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from hit) group by 1),
it as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as items
       from (select distinct doc_id, cast(item_id as varchar) as i from hit) group by 1),
dpos as (select doc_id, unnest(w) as term, unnest(range(len(w))) as p from dw),
freq as (select term, count(*) as n from dpos group by 1),
term as (select item_id, s, term, min(a) as a from (select item_id, s, unnest(w[s + 1 : s + n]) as term, unnest(range(n)) as a from b) group by 1, 2, 3),
rare as (select item_id, s, term, a, row_number() over (partition by item_id, s order by coalesce(n, 0), a) as k from term left join freq using (term) qualify k <= 2),
spot as (select doc_id, item_id, s, k, p - s - a as shift from rare join dpos using (term)),
near as (select x.doc_id, count(distinct x.item_id) as n_near from spot x join spot y on x.doc_id = y.doc_id and x.item_id = y.item_id and x.s = y.s and x.k = 1 and y.k = 2
         and abs(x.shift - y.shift) <= 3 group by 1)
select dw.doc_id, coalesce(len(w), 0) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
from dw left join pos using (doc_id) left join it using (doc_id) left join near using (doc_id)
"""

_WARC = """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
d as (select page_id, octet_length(b) as payload_bytes, sha1(b) as payload_digest from p),
w as (select payload_digest, max(page_id) as winner from d where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, d.payload_digest as payload_digest,
       case when winner is null or winner = page_id then 'response' else 'revisit' end as record_type,
       case when winner <> page_id then winner end as refers_to
from d left join w on d.payload_digest = w.payload_digest and payload_bytes >= 1000
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": _EXACT, "op3_decontaminate": _DECONTAMINATE, "op4_near_dedup": oracles.NEAR, "op6_license_scan": oracles.licences(),
        "op7_warc": _WARC, "op9_suffix_dedup": oracles.REPEATS, "op10_lm_score": oracles.LOSSES,
        "op11_html_extract": oracles.ARTICLES, "op12_ball_kmeans": oracles.balls(), "op13_fill_middle": oracles.MIDDLES,
    }
