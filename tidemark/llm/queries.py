"""The queries of the text operators, with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold
    from .toxicity import fit_toxicity, score_toxicity

    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return score_toxicity(docs, model).withColumn("held_out", fold("doc_id", 5) == 0).select("doc_id", "held_out", "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import fit_quality, score_quality

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, fit_quality(docs)).select("doc_id", "quality_score", "accepted")


OP3_SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n FROM pages
), d AS (
    SELECT page_id, n, sha256(body) AS digest,
           CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY sha256(body)) END AS first
    FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN first IS NULL OR first IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d
"""


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    kept = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = kept.withColumn("clean_sha256", F.sha2("clean_text", 256))
    return kept.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "clean_words", "clean_sha256", "kept")


def quality_rules_sql(source: str, key: str) -> str:
    """The rules' results for each row of ``source`` (a table with text), with the columns ``key`` before them."""
    from . import quality_rules as r

    white = r" || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    split = r"list_filter(regexp_split_to_array({}, '[ \t-\r]+'), lambda w: w <> '')"
    return f"""
WITH rows_ AS (
    SELECT row_number() OVER () AS rid, {key}, coalesce(text, '') AS body FROM {source}
), words_ AS (
    SELECT *, {split.format("body")} AS words,
           list_filter(string_split(body, chr(10)), lambda x: length(translate(x, ' '{white}, '')) > 0) AS lines
    FROM rows_
), windows_ AS (
    SELECT rid, i, array_to_string(words[i : i + {r.WINDOW - 1}], ' ') AS g
    FROM (SELECT rid, words, unnest(range(1, len(words) - {r.WINDOW - 2})) AS i FROM words_)
), twice_ AS (
    SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM windows_) WHERE n > 1
), covered_ AS (
    SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {r.WINDOW})) AS p FROM twice_) GROUP BY rid
), passing_ AS (
    SELECT *, list_filter(lines, lambda x: NOT (regexp_matches(lower(x), '{r.PHRASE}') AND len({split.format("x")}) <= {r.BOILERPLATE_WORDS})
        AND len(list_filter({split.format("x")}, lambda v: regexp_matches(v, '{r.NOISY_WORD}'))) <= {r.PUNCTUATION_SHARE} * len({split.format("x")})
        AND len(list_filter({split.format("x")}, lambda v: regexp_matches(v, '{r.SEPARATOR}'))) <= {r.NAVIGATION_SHARE} * len({split.format("x")})) AS good
    FROM words_
), measured_ AS (
    SELECT p.*, CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(translate(body, ' '{white}, '')) AS BIGINT) AS word_chars,
           CAST(length(body) - length(translate(body, '{r.SYMBOLS}', '')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
           CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
           CAST(len({split.format("array_to_string(good, chr(10))")}) AS BIGINT) AS clean_words, sha256(array_to_string(good, chr(10))) AS clean_sha256
    FROM passing_ p LEFT JOIN covered_ c USING (rid)
), judged_ AS (
    SELECT *, n_words < {r.LEAST_WORDS} OR 100 * n_repeat_words > {r.REPEAT_PERCENT} * n_words AS base_failed FROM measured_
)
SELECT {key}, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, clean_words, clean_sha256,
       NOT base_failed AND clean_words >= {r.KEPT_SHARE} * n_words AS kept
FROM judged_"""


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .byte_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .common import fold
    from .language_id import fit_languages, identify

    docs = table(spark, sf_dir, "documents")
    model = fit_languages(docs, fold("doc_id", 3) != 1)
    return identify(docs, model).withColumn("held_out", fold("doc_id", 3) == 1).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_duplicates import near_duplicate_classes

    return near_duplicate_classes(table(spark, sf_dir, "documents"))


def op5_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vector_search import nearest_neighbours

    return nearest_neighbours(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_token_counts": op4_token_counts,
    "op5_vector_search": op5_vector_search,
    "op6_quality_rules": op6_quality_rules,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_near_duplicates": op10_near_duplicates,
}

ORACLES: dict[str, str] = {
    "op3_warc": OP3_SQL,
    "op6_quality_rules": quality_rules_sql("documents", "doc_id"),
}
