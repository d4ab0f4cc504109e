"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import scratch
from . import decontaminate, fingerprint, html_extract, jaccard_join, language_id, license_scan, packing, pii, quality, sharding


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    scratch.prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op10_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op7_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language_id.fit(docs.where(~language_id.held_out()))
    return language_id.predict(docs, model).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score", "languages")


def op8_quality_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = language_id.held_out()
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held_out)
    return quality.classify(_table(spark, sf_dir, "documents"), labels).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_html_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op6_scaled_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


def op4_feistel_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(_table(spark, sf_dir, "documents").select("doc_id", "text"), count_col="n_replaced")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_html_consensus": op3_html_consensus,
    "op4_feistel_pii": op4_feistel_pii,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_scaled_fingerprint": op6_scaled_fingerprint,
    "op7_language_mixture": op7_language_mixture,
    "op8_quality_trees": op8_quality_trees,
    "op9_decontaminate": op9_decontaminate,
    "op10_kd_sharding": op10_kd_sharding,
}
ORACLES: dict[str, str] = {
    "op9_decontaminate": decontaminate.ORACLE,
}
