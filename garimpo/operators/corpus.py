"""From notes to sentences and tokens: the preprocessing pipeline as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions.text import normalize, sentences, word_tokens


def note_sentences(notes: DataFrame, least: int = 3) -> DataFrame:
    """(nr_registro, doc_type, ordem, sentenca): normalised, masked and segmented notes."""
    clean = notes.select("nr_registro", "doc_type", normalize(F.col("texto")).alias("_t"))
    return clean.select("nr_registro", "doc_type", F.posexplode(sentences(F.col("_t"), least)).alias("ordem", "sentenca"))


def note_tokens(notes: DataFrame) -> DataFrame:
    """note_sentences with tokens; sentences without tokens are left out."""
    return note_sentences(notes).withColumn("tokens", word_tokens(F.col("sentenca"))).where(F.size("tokens") > 0)


def corpus_totals(tokens: DataFrame) -> DataFrame:
    """Documents, sentences and tokens per doc_type."""
    return tokens.groupBy("doc_type").agg(F.countDistinct("nr_registro").alias("documentos"), F.count(F.lit(1)).alias("sentencas"), F.sum(F.size("tokens")).alias("tokens"))
