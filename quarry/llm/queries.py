"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), Fraction(85, 100))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.exact_dedup import exact_duplicates

    return exact_duplicates(table(spark, sf_dir, "documents"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.token_orc import token_output
    from quarry.llm.tokens import public_path

    return token_output(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), end_id=0)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.suffix_dedup import removal_report

    return removal_report(table(spark, sf_dir, "documents"))


def op5_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.bpe import round_trip
    from quarry.llm.tokens import public_path

    return round_trip(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.warc import report

    return report(table(spark, sf_dir, "pages"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.url_filter import filter_urls

    return filter_urls(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).drop("cleaned")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.packing import pack_documents
    from quarry.llm.tokens import public_path

    return pack_documents(table(spark, sf_dir, "documents"), public_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.language import identify

    return identify(table(spark, sf_dir, "documents"))


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.pii import report

    return report(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.fill_middle import digests

    return digests(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarry.llm.divergence import audit

    return audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_token_orc": op3_token_orc,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_bpe_round_trip": op5_bpe_round_trip,
    "op6_warc_derivatives": op6_warc_derivatives,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_language_id": op10_language_id,
    "op11_pii": op11_pii,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_divergence": op13_source_divergence,
}


def _url_sql() -> str:
    from quarry.llm.url_filter import oracle

    return oracle()


ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": sql.OP1,
    "op2_exact_dedup": sql.OP2,
    "op4_suffix_dedup": sql.OP4,
    "op7_url_filter": _url_sql(),
    "op8_quality_rules": sql.op8(),
    "op12_fill_in_middle": sql.OP12,
    "op13_source_divergence": sql.OP13,
}
