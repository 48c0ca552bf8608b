"""The registered queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, conversations, decontaminate, html, language, licenses, lm, quality, secrets, simhash, topk, urls, whitening
from .common import read


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "license", F.size("notices").cast("long").alias("n_notices"),
        F.concat_ws(",", F.array_sort(F.array_distinct(F.col("notices.license")))).alias("notices"),
    )


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of(F.col("bits")).alias("fingerprint"), "component_id")


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [rule.kind for rule in secrets.BASE_RULES]
    spans = F.col("spans")
    return secrets.find_secrets(read(spark, sf_dir, "documents")).select(
        "doc_id",
        *(F.size(secrets.of_kinds(spans, kind)).cast("long").alias(f"n_{kind}") for kind in base),
        F.sha2(secrets.listed(secrets.of_kinds(spans, *base)), 256).alias("base_sha256"),
        secrets.listed(spans).alias("spans"),
    )


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    profiles = language.learn(documents.where(~held_out), F.col("text"), F.col("lang"))
    return language.identify(documents, profiles).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return lm.score_corpus(read(spark, sf_dir, "documents"), held_out)


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return bpe.round_trip(read(spark, sf_dir, "documents"), path, pattern).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents")
    return quality.grade_texts(documents, quality.learn(documents, read(spark, sf_dir, "labels")))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(
        [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block")],
        "host string, path string, verdict string",
    )
    return urls.judge(read(spark, sf_dir, "pages"), urls.build_index(rules))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_conversations(read(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_license_scans": op1_license_scans,
    "op2_html_extraction": op2_html_extraction,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_secret_scans": op4_secret_scans,
    "op5_language_id": op5_language_id,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_exact_top_k": op10_exact_top_k,
    "op11_url_filters": op11_url_filters,
    "op12_embedding_whitening": op12_embedding_whitening,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op1_license_scans": licenses.oracle(),
    "op7_benchmark_decontamination": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
            FROM documents
        ), i AS (
            SELECT item_id, w, least(10, len(w)) AS l
            FROM (SELECT item_id, coalesce(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark)
            WHERE len(w) > 0
        ), iw AS (
            SELECT DISTINCT item_id, l, array_to_string(w[s : s + l - 1], ' ') AS g
            FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM i)
        ), dw AS (
            SELECT r, l, s, array_to_string(w[s : s + l - 1], ' ') AS g
            FROM (SELECT r, w, l, unnest(range(1, len(w) - l + 2)) AS s FROM d, (SELECT DISTINCT l FROM i))
        ), m AS (
            SELECT DISTINCT r, l, s, item_id FROM dw JOIN iw USING (l, g)
        ), hit AS (
            SELECT r, count(DISTINCT p) AS n_hit
            FROM (SELECT r, unnest(range(s, s + l)) AS p FROM (SELECT DISTINCT r, s, l FROM m)) GROUP BY r
        ), item AS (
            SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS x FROM m WHERE item_id IS NOT NULL) GROUP BY r
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)""",
    "op10_exact_top_k": """
        WITH usable AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
            FROM (SELECT * FROM usable WHERE vec_id % 50 = 0) q JOIN usable c ON q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                   vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op11_url_filters": r"""
        WITH p AS (
            SELECT row_number() OVER () AS r, page_id,
                   translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
            FROM pages
        ), rules (rule_host, rule_path, verdict) AS (
            VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                   ('net', '/es/', 'block'), ('net', '/fr/', 'block')
        ), best AS (
            SELECT r, arg_max(rule_host || rule_path, len(rule_host || rule_path)) AS rule,
                   arg_max(verdict, len(rule_host || rule_path)) AS verdict
            FROM p JOIN rules ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY r
        )
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN best USING (r)""",
    "op13_conversation_repair": conversations.ORACLE,
}
