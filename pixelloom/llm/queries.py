"""The registered queries of this subpackage, with production parameters over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, licenses, neardup, pieces, pii, quality, tokencount, toxicity
from .common import bucket_of, read_table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(read_table(spark, sf_dir, "documents"), tokencount.default_tokenizer())


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes its ids again; round_trip: that gives the text, its piece spaces as spaces."""
    docs = read_table(spark, sf_dir, "documents")
    given = F.sha2(F.replace(F.coalesce("text", F.lit("")), F.lit(pieces.SPACE), F.lit(" ")), 256)
    encoded = pieces.encode(docs.withColumn("given", given), keep=("doc_id", "given"))
    back = pieces.decode(encoded, keep=("doc_id", "given", "ids")).withColumn("decoded_sha256", F.sha2("text", 256))
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded_sha256", (F.col("decoded_sha256") == F.col("given")).alias("round_trip"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations")
    held_out = bucket_of("conv_id", 3) == 1
    model = chat.fit(turns, use=~held_out)
    out = chat.recover_roles(turns, model, role_col="role")
    return out.select("conv_id", "turn", held_out.alias("held_out"), "given", "role", "rendered")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def _judged(scored: DataFrame, held_out) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = read_table(spark, sf_dir, "documents"), bucket_of("doc_id", 3)
    model = quality.QualityModel.fit(docs, read_table(spark, sf_dir, "labels"), use=fold != 1)
    return _judged(quality.score(docs, model), fold == 1)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.filter(F.transform("matches", lambda m: m["item"]), lambda i: i.isNotNull())))
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, fold = read_table(spark, sf_dir, "documents"), bucket_of("doc_id", 5)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"), use=fold != 0)
    return _judged(toxicity.score(docs, model), fold == 0)


def op8_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """found: the spans as JSON, with the scores that checksums and context give them."""
    return pii.scan(read_table(spark, sf_dir, "documents")).withColumn("found", F.to_json("found"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_sentencepiece, op3_chat_format, op4_quality_classifier, op5_license_scan, op6_decontamination, op7_toxicity, op8_simhash_neardup, op9_pii, op10_ann)}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

SQL = {
    "op5_license_scan": licenses.oracle_sql(),
    "op6_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
g AS (SELECT item, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p, w FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(w[p : p + n - 1], ' ') AS gram FROM g),
sizes AS (SELECT DISTINCT n FROM win),
dg AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS gram FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, p, n, item FROM dg JOIN win USING (n, gram)),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM hits)) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hits WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
""",
}
