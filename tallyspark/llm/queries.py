"""The operators over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversation_repair, decontaminate, hard_negatives, html_extract, language_id, license_scan, lm_score, media_container, sentencepiece_codec, simhash, token_counts, toxicity, url_filter
from .common import table

#: Tokens above which a document is over the limit.
TOKEN_LIMIT = 1024


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_digests(table(spark, sf_dir, "documents"))


def sentencepiece_digests(documents: DataFrame) -> DataFrame:
    path = tokenizer("piece_bpe_32k.model")
    coded = sentencepiece_codec.encode_texts(documents, path, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("payload"))
    read = media_container.describe_media(media_container.store_media(texts))
    frames = F.col("info.keyframes")
    span = lambda f: F.concat(f["start"].cast("string"), F.lit("-"), f["end"].cast("string"))
    return read.select(
        "doc_id",
        F.length("payload").cast("long").alias("n_bytes"),
        F.length("info.payload").cast("long").alias("payload_bytes"),
        F.sha2("info.payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("info.payload"), -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(
            ";",
            F.concat(F.lit("brand="), "info.brand"),
            F.concat(F.lit("codec="), F.trim("info.codec")),
            F.concat(F.lit("duration="), F.col("info.duration").cast("string"), F.lit("/"), F.col("info.timescale").cast("string")),
            F.concat(F.lit("samples="), F.col("info.samples").cast("string")),
            F.concat(F.lit("keyframes="), F.size(frames).cast("string")),
            F.concat(F.lit("ranges="), F.array_join(F.transform(frames, span), ",")),
        ).alias("feature"),
    )


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    starts = F.transform("base", lambda b: b["start"])
    base = F.transform("base", lambda b: b["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.concat(base, F.transform("detections", lambda d: d["label"]))).alias("labels"),
        "score",
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hard_negatives.integer_vectors(table(spark, sf_dir, "embeddings"), repeated=True)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(table(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_language_id, op3_sentencepiece, op4_simhash, op5_html_text, op6_toxicity, op7_media, op8_licenses, op9_token_counts, op10_decontamination, op11_hard_negatives, op12_lm_score, op13_conversation_repair, pipeline)}

ORACLE_SQL = {
    "op1_url_filter": r"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
                  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as rn from pages),
     r(rh, rp, act) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
     m as (select p.rn, rh || rp as rule, act, row_number() over (partition by p.rn order by length(rh || rp) desc, length(rh) desc, rh || rp desc) as k
           from p join r on (p.host = rh or ends_with(p.host, '.' || rh)) and starts_with(p.path, rp))
select p.page_id, p.host, p.path, m.rule as rule, coalesce(m.act, 'allow') as verdict from p left join m on m.rn = p.rn and m.k = 1
""",
    "op10_decontamination": r"""
with w as (select row_number() over () as rn, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from documents),
     b as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as ws from benchmark),
     g as (select distinct item_id, least(10, len(ws)) as n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') as gram
           from (select item_id, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as i from b where len(ws) > 0)),
     sizes as (select distinct n from g),
     d as (select rn, n, i, array_to_string(ws[i : i + n - 1], ' ') as gram from (select rn, ws, n, unnest(range(1, len(ws) - n + 2)) as i from w cross join sizes where len(ws) >= n)),
     h as (select d.rn, d.i, d.n, g.item_id from d join g on d.gram = g.gram and d.n = g.n),
     c as (select rn, count(distinct k) as n_hit from (select rn, unnest(range(i, i + n)) as k from h) group by rn),
     t as (select rn, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct rn, cast(item_id as varchar) as item from h) group by rn)
select w.doc_id, cast(len(w.ws) as bigint) as n_words, cast(coalesce(c.n_hit, 0) as bigint) as n_hit, cast(coalesce(t.n_items, 0) as bigint) as n_items,
       sha256(coalesce(t.items, '')) as items_sha256, coalesce(c.n_hit, 0) > 0 as contaminated
from w left join c using (rn) left join t using (rn)
""",
    "op11_hard_negatives": r"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
           from embeddings where label is not null and embedding is not null and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda x: not isfinite(x))) = 0),
     s as (select a.vec_id as a, b.vec_id as b, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
     p as (select a, b, score from s where same qualify row_number() over (partition by a order by score desc, b) <= 5),
     n as (select p.a, p.b, p.score as ps, s.b as n, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as k
           from p join s on s.a = p.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select a as anchor_id, b as positive_id, cast(k as integer) as rank, n as negative_id, ps as positive_score, ns as negative_score from n where k <= 3
""",
}
