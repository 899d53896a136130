"""The thin queries of the numbered operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm import exact_dedup, fill_middle, hard_negatives, html_extract, language_id, media, mixing, near_dedup, packing, pieces, secrets, token_counts, url_rules
from palimpsest.llm.common import read

#: Vocabulary files; their folder is a parameter of the environment and never copied here.
BPE_FILE, PIECES_FILE, WORDS_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json"
URL_RULES = [
    url_rules.Rule("net", "/", "block"), url_rules.Rule("example.net", "/en/", "allow"),
    url_rules.Rule("example.com", "/de/", "block"), url_rules.Rule("org", "/fr/", "allow"),
]
TOKEN_LIMIT, SEED = 1024, 20240


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(read(spark, sf_dir, "pages"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", F.array("source").alias("sources"))
    return mixing.mixed(docs).select("doc_id", "size", "source_size", "target", "taken")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judged(read(spark, sf_dir, "pages"), read(spark, sf_dir, "labels"), URL_RULES)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(BPE_FILE), TOKEN_LIMIT)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(read(spark, sf_dir, "documents"), width=2)


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(read(spark, sf_dir, "documents"), keep_codes=True)


def op7_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.sampled_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES_FILE), seed=SEED)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(read(spark, sf_dir, "documents"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(read(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.identified(docs, language_id.fit(docs))
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS_FILE), window=4096, end_id=2).drop("ids")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, relabel=moved)


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.transformed(read(spark, sf_dir, "documents"), seed=42, rate=50, spm_rate=80)
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_html_extraction, op2_source_mixing, op3_url_filters, op4_token_counts, op5_minhash_near_dedup, op6_media_columns, op7_sentencepiece_sampling, op8_exact_dedup, op9_secret_scans, op10_language_id, op11_packing, op12_hard_negatives, op13_fill_middle)}


def oracle_sql() -> dict[str, str]:
    """The operators that SQL can express; the others are tested against brute force."""
    return {
        "op8_exact_dedup": """
            WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
            SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, coalesce(doc_id = max(doc_id) OVER g, false) AS kept, text_sha256
            FROM t WINDOW g AS (PARTITION BY text_sha256)
        """,
        "op12_hard_negatives": """
            WITH rows_ AS (
                SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
                WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
            scores AS (SELECT a.id AS anchor_id, c.id, a.label = c.label AS same, list_dot_product(a.q, c.q)::BIGINT AS score FROM rows_ a, rows_ c WHERE a.id % 100 = 0 AND a.id <> c.id),
            positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
            SELECT anchor_id, positive_id, (row_number() OVER w)::INT AS rank, id AS negative_id, positive_score, score AS negative_score
            FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
            WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 5
        """,
        "op13_fill_middle": r"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
            u AS (SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units FROM t),
            d AS (SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM u),
            f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
            p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM f)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
                sha256(CASE form WHEN 'plain' THEN text WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256,
                sha256(text) AS restored_sha256
            FROM p
        """.replace("\\\\", "\\"),
    }
