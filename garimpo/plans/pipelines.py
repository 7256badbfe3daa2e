"""Whole steps of the workflow, composed of the operators."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import patterns as P
from garimpo.operators import anonymize, audit, corpus, crf, labels, metrics, profile, results, sampling, spans
from garimpo.shared import materialize
from garimpo.sources import files


def preprocess(prescricoes: DataFrame, pareceres: DataFrame, folder: str, per_type: int | None = None, sample_to: int | None = None) -> DataFrame:
    """Notes to a corpus: optional sample per type, normalise, segment, tokenise; writes CoNLL and JSON Lines, returns totals.

    The corpus is written once and read back for the second sink, the quota sample and
    the totals, so no text is processed twice.
    """
    notes = profile.notes(prescricoes, pareceres)
    if per_type:
        notes = sampling.sample_per_type(notes, "doc_type", "nr_registro", per_type)
    tokens = corpus.note_tokens(notes)
    tokens.select("nr_registro", "doc_type", "ordem", "tokens").write.mode("overwrite").parquet(f"{folder}/corpus.parquet")
    done = notes.sparkSession.read.parquet(f"{folder}/corpus.parquet").withColumnRenamed("nr_registro", "doc_id")
    files.write_sentences(done, f"{folder}/corpus.jsonl")
    files.write_conll(done.select("tokens"), f"{folder}/corpus.conll")
    if sample_to:
        numbered = done.withColumn("sentenca_id", F.xxhash64("doc_id", "ordem"))
        chosen = sampling.quota_sample(numbered, total=sample_to)
        files.write_sentences(numbered.join(chosen, "sentenca_id", "left_semi"), f"{folder}/amostra.jsonl")
    return corpus.corpus_totals(done.withColumnRenamed("doc_id", "nr_registro"))


def explore(prescricoes: DataFrame, pareceres: DataFrame) -> dict[str, DataFrame]:
    """The tables of the exploration page. Texts are read once: their counts are written to the shared folder, and all tables come from these."""
    n = materialize(profile.measured(profile.notes(prescricoes, pareceres)), "profile")
    by = ["doc_type"]
    return {
        "registros": profile.record_counts(n),
        "pacientes": profile.distinct_patients(n),
        "periodo": profile.period(n),
        "hospitais": profile.hospitals(n),
        "especialidades": profile.top_values(n, "especialidade"),
        "tokens": profile.distribution(n, F.col("tok"), by),
        "caracteres": profile.distribution(n, F.col("car"), by),
        "sentencas": profile.distribution(n, F.col("sen"), by),
        "tipos": profile.type_shares(n, by),
        "histograma": profile.histogram(n, F.col("tok")),
        "tabela1": profile.table_one(n),
    }


def results_page(anonymisations: DataFrame, trainings: DataFrame, evaluations: DataFrame, path: str | None = None) -> DataFrame:
    """The results view under template names; written as a report with 4 places if a path is given."""
    view = results.for_templates(results.results_table(anonymisations, trainings, evaluations))
    if path:
        files.small_csv(files.consolidated(view.orderBy("lugar"), "Modelo"), path)
    return view


def reevaluate(predictions: dict[str, DataFrame], folder: str, report: str) -> DataFrame:
    """Grids (sentenca_id, posicao, token, a1 = truth, a2 = prediction) of several models to one metrics file each, read back and consolidated.

    Returns one row per model with coverage, precision and F1 over the contextual types,
    rebuilt from the files; report gets them as text with 4 places.
    """
    spark = next(iter(predictions.values())).sparkSession
    for name, grid in predictions.items():
        both = metrics.compared_spans(grid, "seqeval")
        micro = metrics.entity_scores(*both).select(F.lit(name).alias("modelo"), F.col("f1").alias("f1_micro"))
        files.write_metrics(metrics.entity_scores(*both, by_type=True).crossJoin(F.broadcast(micro)), f"{folder}/{name}")  # one row
    out = None
    for name in predictions:
        one = metrics.micro_from_report(files.read_metrics(spark, f"{folder}/{name}", multiline=False), P.CONTEXT_TYPES).select(F.lit(name).alias("modelo"), "*")
        out = one if out is None else out.unionByName(one)
    files.small_csv(files.consolidated(out.orderBy(F.desc_nulls_last("f1")), "modelo"), report)
    return out


def annotation_sample(corpus_path: str, to: str, spark: SparkSession, n: int) -> DataFrame:
    """Of a corpus in JSON Lines an equal number of sentences per doc_type, written for the annotation tool as JSON Lines of text and an empty label list."""
    numbered = files.read_sentences(spark, corpus_path).withColumn("_key", F.xxhash64("doc_id", F.array_join("tokens", " ")))
    drawn = sampling.equal_allocation(numbered, "doc_type", "_key", n)
    texts = drawn.select(F.array_join("tokens", " ").alias("text"), F.array().cast("array<array<string>>").alias("label"))
    texts.write.mode("overwrite").json(to)
    return drawn.groupBy("doc_type").agg(F.count(F.lit(1)).alias("sentencas"))


def imported_annotations(export_path: str, to: str, spark: SparkSession) -> DataFrame:
    """An annotation tool's export to CoNLL; returns entity tokens per type."""
    done = files.import_spans(spark.read.schema("text string, label array<array<string>>").json(export_path))
    files.write_conll(done, to)
    each = done.select(F.explode("labels").alias("label"))
    return audit.labels_of_entities(each)


def sanity_counts(spark: SparkSession, path: str) -> DataFrame:
    """(sentencas, tokens, entidades) of a CoNLL file, read back after it was written."""
    s = files.read_conll(spark, path)
    return s.select(F.size("tokens").alias("n"), F.size(F.filter("labels", lambda x: x.startswith("B-"))).alias("b")).agg(
        F.count(F.lit(1)).alias("sentencas"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("b"), F.lit(0)).alias("entidades")
    )


def gold_sentences(sentences: DataFrame, annotations: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(sentenca_id, tokens, labels, tipos) of the annotated sentences after adjudication."""
    g = labels.gold(labels.token_grid(sentences, annotations), labels.adjudications(adjudications))
    x = g.groupBy("sentenca_id").agg(F.array_sort(F.collect_list(F.struct("posicao", "token", "label"))).alias("x"))
    types = F.array_sort(F.array_distinct(F.transform(F.filter("x", lambda c: c["label"] != "O"), lambda c: F.substring(c["label"], 3, 100))))
    return x.select("sentenca_id", F.transform("x", lambda c: c["token"]).alias("tokens"), F.transform("x", lambda c: c["label"]).alias("labels"), types.alias("tipos"))


def split(gold: DataFrame, folder: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sentences with particao, check per type); writes the three CoNLL files if a folder is given."""
    parts = sampling.reserved_split(gold, seed=seed)
    joined = gold.join(parts, "sentenca_id")
    if folder:
        files.write_splits(joined, folder)
    return joined, sampling.split_check(gold, parts)


def train_and_evaluate(parts: DataFrame, most: int = crf.SENTENCES, epochs: int = 12) -> tuple[crf.Crf, dict, dict[str, DataFrame]]:
    """A CRF fitted on treino and its scores on teste: entity micro, entity per type, token, privacy."""
    began = time.time()
    model = crf.fit_crf(crf.training_sample(parts.where("particao = 'treino'"), most), epochs=epochs)
    facts = model.convergence() | {"segundos": round(time.time() - began, 1), "classes": model.labels}
    tagged = parts.where("particao = 'teste'").withColumn("pred", anonymize.tagger_column(model.tag)("tokens"))
    cells = tagged.select("sentenca_id", F.explode(F.transform("tokens", lambda t, i: F.struct(i.alias("posicao"), t.alias("token"), F.col("labels")[i].alias("a1"), F.col("pred")[i].alias("a2")))).alias("c"))
    grid = cells.select("sentenca_id", "c.*")
    both = metrics.compared_spans(grid, "seqeval")
    strict = metrics.compared_spans(grid, "strict")
    return model, facts, {
        "entidades": metrics.entity_scores(*both),
        "por_tipo": metrics.entity_scores(*both, by_type=True),
        "tokens": metrics.token_scores(grid),
        "privacidade": metrics.privacy_scores(*strict, P.CONTEXT_TYPES),
    }


def anonymise_corpus(texts: DataFrame, path: str, tagger: str | None = None) -> DataFrame:
    """Texts to anonymised JSON Lines; returns the markers and how often they occur."""
    done = anonymize.anonymise(texts, tagger=tagger).withColumnRenamed("texto", "texto_original")
    files.write_anonymised(done, path)
    return anonymize.marker_counts(texts.sparkSession.read.schema("texto_anonimizado string").json(path))


def audit_all(gold: DataFrame, sentences: DataFrame) -> dict[str, DataFrame]:
    """Every audit of a gold label table (sentenca_id, posicao, token, label)."""
    s = spans.bio_spans(gold)
    return {
        "proibidos": audit.forbidden_labels(gold, P.REGEX_TYPES), "orfaos": audit.orphan_inside(gold), "conflitos": audit.type_conflicts(s), "nomes": audit.missed_names(gold),
        "titulos": audit.titles_before_names(gold), "bordas": audit.border_words(s), "parentesco": audit.kinship_in_names(s), "curtos": audit.tiny_spans(s),
        "longos": audit.longest_spans(s), "municipios": audit.isolated_towns(s, sentences), "colados": audit.glued_tokens(gold), "contagens": audit.audit_counters(gold, s),
    }
