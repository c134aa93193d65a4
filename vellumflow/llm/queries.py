"""The registered queries of this package: operators with production parameters over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import class_lm, compaction, decontam, huffman_ids, lang_id, onebit_ann, packing, pii, simhash, token_prefix
from .common import fold, shared_dir, table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = lang_id.fit(lang_id.learnable(docs.select("doc_id", "text", "lang"), fold(F.col("doc_id"), 4) != 2))
    found = lang_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op2_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = class_lm.fit_and_score(docs, fold(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", (fold(F.col("doc_id"), 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op4_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit_ann.nearest(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), every=20, k=20)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman_ids.huffman_round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compaction.arrive_and_compact(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/vellumflow-store-{uuid.uuid4().hex}", arrivals=8, key="doc_id")
    return rows.select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_prefix.count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_class_lm": op2_class_lm,
    "op3_decontam": op3_decontam,
    "op4_onebit_ann": op4_onebit_ann,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_huffman_ids": op8_huffman_ids,
    "op9_compaction": op9_compaction,
    "op10_token_counts": op10_token_counts,
}

_WORDS = "list_filter(regexp_split_to_array(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

ORACLE_SQL: dict[str, str] = {
    "op3_decontam": f"""
WITH items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(text="text")} AS w FROM benchmark),
sized AS (SELECT item, w, least(len(w), 13) AS k FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS gram FROM (SELECT item, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM sized)),
docs AS (SELECT doc_id, {_WORDS.format(text="text")} AS w FROM documents),
spots AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM windows)),
grams AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram FROM spots),
hits AS (SELECT doc_id, i, g.k, item FROM grams g JOIN windows v ON g.k = v.k AND g.gram = v.gram),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op4_onebit_ann": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op9_compaction": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
}
