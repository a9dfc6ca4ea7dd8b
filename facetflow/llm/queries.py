"""The queries of this subpackage for ``__spark_entry__`` and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, html_extract, image_match, minhash, online_packing, packing, resample, secrets, token_count, token_store, toxicity, vector_search, whitening
from .common import read_table, scratch_path


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op2_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents"), repository=["source", "lang"], owner=["source"]))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_site_template_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_extract.extract(read_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_vantage_point_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_edited_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds media, so every vector is drawn; an edited copy of each one whose id is divisible by 20 is searched among all. A row for each picture with its class."""
    vectors = read_table(spark, sf_dir, "embeddings")
    asked = image_match.drawn(vectors.filter(F.col("vec_id") % 20 == 0), "vec_id", "embedding", edited=True)
    return image_match.copies(asked, image_match.drawn(vectors, "vec_id", "embedding"))


def op7_string_kernel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.train(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_count.token_counts(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "store")
    token_store.write_store(read_table(spark, sf_dir, "documents"), path, tokenizer("word_bpe_49k.json"))
    return token_store.read_digests(spark, path)


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return online_packing.pack_online(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_secret_ownership": op2_secret_ownership,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_site_template_text": op4_site_template_text,
    "op5_vantage_point_search": op5_vantage_point_search,
    "op6_edited_pictures": op6_edited_pictures,
    "op7_string_kernel_toxicity": op7_string_kernel_toxicity,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_token_store": op10_token_store,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_importance_resampling": op12_importance_resampling,
    "op13_online_packing": op13_online_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op5_vantage_point_search": """
        WITH sound AS (
            SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                   sqrt(list_sum(list_transform(list_zip(q.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS score
            FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
        FROM pairs QUALIFY rank <= 10""",
    "op12_importance_resampling": r"""
        WITH RECURSIVE steps AS (
            SELECT range AS b, range AS c, 0 AS k FROM range(256)
            UNION ALL
            SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
        ), crc AS (
            SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8
        ), words AS (
            SELECT 0 AS target, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
            UNION ALL
            SELECT 1, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark
        ), times AS (
            SELECT target, id, word, count(*) AS n FROM (SELECT target, id, unnest(w) AS word FROM words) GROUP BY ALL
        ), vocabulary AS (
            SELECT word, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(octet_length(encode(word))), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))),
                       lambda c, x: xor(c // 256, t[xor(c % 256, x) + 1]))) % 10000 AS bucket
            FROM (SELECT DISTINCT word FROM times), crc
        ), totals AS (
            SELECT bucket, sum(CASE WHEN target = 0 THEN n ELSE 0 END) AS s, sum(CASE WHEN target = 1 THEN n ELSE 0 END) AS t FROM times JOIN vocabulary USING (word) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sum(s) OVER () + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(sum(t) OVER () + 10000 AS DOUBLE)))) AS gain FROM totals
        ), weights AS (
            SELECT id, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight FROM times JOIN vocabulary USING (word) JOIN gains USING (bucket) WHERE target = 0 GROUP BY id
        ), scored AS (
            SELECT doc_id, len(w) AS n_features, coalesce(weight, 0) AS weight,
                   coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
            FROM (SELECT id AS doc_id, w FROM words WHERE target = 0) LEFT JOIN weights ON id = doc_id
        ), ranked AS (
            SELECT *, row_number() OVER (ORDER BY n_features < 20, score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS fit FROM scored
        )
        SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN place <= 10 * fit // 100 THEN place END AS BIGINT) AS rank FROM ranked""",
}
