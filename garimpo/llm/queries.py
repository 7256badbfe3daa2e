"""Queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.llm import consensus, encode, leak, level, linked_split, lookalike, overlap, pii, proportions
from garimpo.session import table


def _notes(spark: SparkSession, d: str) -> DataFrame:
    """Texts of both note tables as (id, text)."""
    a = table(spark, d, "prescricoes").select(F.col("nr_registro").alias("id"), F.col("ds_evolucao").alias("text"))
    return a.unionByName(table(spark, d, "pareceres").select(F.col("nr_registro").alias("id"), F.col("ds_parecer").alias("text")))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_report(spark, d).where("not atendido").select("plano_id", "doc_type").distinct()


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return proportions.plan_report(table(spark, d, "sentenca"), table(spark, d, "plano_amostra"))


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportions.sample_by_plan(table(spark, d, "sentenca"), table(spark, d, "plano_amostra"), "sentenca_id")


def _consensus(spark: SparkSession, d: str):
    return consensus.consensus(table(spark, d, "anotacao_token"), table(spark, d, "sentenca"), table(spark, d, "adjudicacao_token"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[0].where("differ").select("sentenca_id", F.col("posicao").cast("int").alias("posicao"), "label")


def p2_labels(spark: SparkSession, d: str) -> DataFrame:
    """The final label of every voted position."""
    return _consensus(spark, d)[0].select("sentenca_id", F.col("posicao").cast("int").alias("posicao"), "label", "origem")


def p2_reliability(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[1].withColumn("peso", F.round("peso", 6))


def p2_agreement(spark: SparkSession, d: str) -> DataFrame:
    return _consensus(spark, d)[2].where("a < b").withColumns({c: F.round(c, 6) for c in ("acaso", "acordo")})


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = lookalike.same_look_pairs(_notes(spark, d))
    return pairs.select(F.col("a").alias("nr_registro_a"), F.col("b").alias("nr_registro_b"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.consistent_forms(_notes(spark, d)).select(F.col("id").alias("nr_registro"), "form")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return linked_split.tied_patients(table(spark, d, "sentenca"))


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    return linked_split.linked_split(table(spark, d, "sentenca"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(table(spark, d, "sentenca"), table(spark, d, "divisao"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "sentenca"), table(spark, d, "divisao"))


def _pii_model(spark: SparkSession, d: str) -> pii.PiiModel:
    return pii.train(table(spark, d, "sentenca"), table(spark, d, "anotacao_token"), table(spark, d, "adjudicacao_token"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_pii(_notes(spark, d), _pii_model(spark, d)).select(F.col("id").alias("nr_registro"), "tipo", "ordem")


def p6_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact_pii(_notes(spark, d), _pii_model(spark, d)).select(F.col("id").alias("nr_registro"), F.col("text").alias("texto"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_passages(spark, d).select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, d: str) -> DataFrame:
    return leak.phrase_matches(table(spark, d, "documents"), table(spark, d, "itens_avaliacao"))


def p9_proximity(spark: SparkSession, d: str) -> DataFrame:
    return leak.proximity_matches(table(spark, d, "documents"), table(spark, d, "itens_avaliacao"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_levels(spark, d).where("nivel in (1, 4)").select("doc_id", "nivel").distinct()


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    return level.reading_levels(table(spark, d, "documents"), table(spark, d, "rotulos_leitura"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p1_sample, p2_found, p2_labels, p2_reliability, p2_agreement, p3_found, p3_forms, p4_found, p4_split, p5_found, p5_report,
        p6_found, p6_redacted, p8_ids, p9_found, p9_passages, p9_proximity, p10_found, p10_levels,
    )
}
