"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plait.llm import ann, bpe, html_text, line_dedup, maxscore, packing, pii, quality, simhash, toxicity
from plait.runtime import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op2_prefix_forest_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=20, k=20)


def op3_maxscore_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), every=100, k=10, scale=1024)


def op4_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


def op5_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return quality.judge(docs, table(spark, sf_dir, "labels"), with_text=False)


def op7_line_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=4, radius=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_best_fit_packing, op2_prefix_forest_ann, op3_maxscore_top_k, op4_pii_anchor_expansion, op5_word_bpe,
        op6_kneser_ney_quality, op7_line_window_dedup, op8_toxic_lexicon, op9_html_templates, op10_simhash_near_dedup,
    )
    return {f.__name__: f for f in found}


_USABLE = """select vec_id, embedding from embeddings where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"""


def oracle_sql() -> dict[str, str]:
    return {
        "op7_line_window_dedup": line_dedup.SQL,
        "op3_maxscore_top_k": f"""
with rows as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as w from ({_USABLE})),
scored as (
  select q.vec_id as query_id, r.vec_id,
         list_sum(list_transform(range(1, len(q.w) + 1), lambda i: q.w[i] * r.w[i]))::bigint as score
  from rows q join rows r on q.vec_id % 100 = 0 and r.vec_id <> q.vec_id),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10"""
    }
