"""Queries of the training-data operators over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from . import bpe, langid, linededup, lm, media, nndescent, omh, packing, pages, resampling, suffixdedup, toxicity, whitening


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return omh.classes(C.table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdedup.dedup(C.table(spark, sf_dir, "documents"), digest=True)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    out = toxicity.classify(docs, C.table(spark, sf_dir, "labels"))
    return out.select("doc_id", (C.crc_mod("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "evidence", "n_words")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identify(C.table(spark, sf_dir, "documents"))
    return out.select("doc_id", (C.crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(C.table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(C.table(spark, sf_dir, "documents"), digest=True)


def op3_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.features(C.table(spark, sf_dir, "documents"))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.link(C.table(spark, sf_dir, "embeddings"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(C.table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes removed as n_removed; removed places as "start-stop start-stop ...", in characters of the original text. Every line that is not blank counts."""
    out = linededup.dedup(C.table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("-", s["start"], s["stop"])), " ")
    kept = F.when(F.col("n_units_removed") < F.col("n_units"), F.sha2("text", 256))
    return out.select("doc_id", "n_units", "n_units_removed", "n_bytes", "n_removed", kept.alias("kept_sha256"), spans.alias("removed"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.by_component(whitening.whitened(C.table(spark, sf_dir, "embeddings")))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resampling.resample(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(C.table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_bpe, op3_media_webp, op4_embedding_near_dedup, op5_packing, op6_minhash_near_dedup, op7_suffix_dedup, op8_toxicity, op9_language_id, op10_line_dedup, op11_whitening, op12_importance_resampling, op13_html_main_text)}


def oracle_sql() -> dict[str, str]:
    return {"op10_line_dedup": linededup.SQL}
