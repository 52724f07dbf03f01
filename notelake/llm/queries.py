"""The operators' queries over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, read


def tokenizer_file(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), 512)


def op2_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .piece_codec import piece_digests

    return piece_digests(read(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import fit_quality, score_quality

    docs = read(spark, sf_dir, "documents")
    model = fit_quality(docs, read(spark, sf_dir, "labels"), 5, 0)
    return score_quality(docs, model, 0.3).select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted")


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import score_lm

    return score_lm(read(spark, sf_dir, "documents"), 7, 2)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex64, simhash_duplicates

    found = simhash_duplicates(read(spark, sf_dir, "documents"), size=4, radius=4, similarity=None)
    return found.select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding_dedup import cosine_duplicates

    return cosine_duplicates(read(spark, sf_dir, "embeddings"), 0.98)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, contaminated, n_items, item_ids, least_distance (of its matches, null without)."""
    from .decontamination import contamination

    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    m = F.col("matches")
    return found.select("doc_id", m).select("doc_id", (F.size(m) > 0).alias("contaminated"), F.size(m).alias("n_items"), F.array_sort(m["item_id"]).alias("item_ids"), F.array_min(m["distance"]).alias("least_distance"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_bundles, write_bundles

    return read_bundles(write_bundles(read(spark, sf_dir, "pages")))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = read(spark, sf_dir, "documents")
    model = fit_toxicity(docs, read(spark, sf_dir, "labels"), 4, 2)
    return score_toxicity(docs, model, 0.3).select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", "predicted")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import cut_digests

    return cut_digests(read(spark, sf_dir, "documents"), 400)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_piece_codec, op3_quality, op4_lm_scoring, op5_simhash, op6_embedding_dedup, op7_decontamination, op8_warc, op9_toxicity, op10_suffix_dedup)}

ORACLE_SQL = {
    "op6_embedding_dedup": """
        WITH RECURSIVE v AS (
            SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
        ), n AS (
            SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
        ), link AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
            WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.98
        ), reach AS (
            SELECT a, b FROM link
            UNION
            SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
        ), root AS (
            SELECT a, min(b) AS b FROM reach GROUP BY a
        ), cnt AS (
            SELECT a, count(*) AS n FROM link GROUP BY a
        )
        SELECT e.vec_id, coalesce(cnt.n, 0)::BIGINT AS n_links, least(e.vec_id, coalesce(root.b, e.vec_id)) AS component_id,
               e.vec_id = least(e.vec_id, coalesce(root.b, e.vec_id)) AS kept
        FROM embeddings e LEFT JOIN root ON e.vec_id = root.a LEFT JOIN cnt ON e.vec_id = cnt.a
    """,
}
