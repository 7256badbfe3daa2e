"""Views over experiments: their last runs side by side, and what each holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.operators.labels import latest_rows

#: Names that templates can use for the measures of the results table.
TEMPLATE_NAMES = {"F1 NER": "F1_NER", "F1 Original": "F1_Original", "F1 Anonimizado": "F1_Anonimizado", "ΔF1": "DeltaF1"}


def _last(df: DataFrame, key: str) -> DataFrame:
    return latest_rows(df, [key], ["criado_em", "id"])


def results_table(anonymisations: DataFrame, trainings: DataFrame, evaluations: DataFrame) -> DataFrame:
    """One row per anonymisation with the last training of its experiment and that training's evaluation.

    anonymisations: id, experimento_id, modelo, f1_original, f1_anonimizado, coverage,
    precision_anon; trainings: id, experimento_id, criado_em, modelo; evaluations:
    treinamento_id, f1_micro. Experiments without a training give no row; one without an
    evaluation has null measures. ΔF1 is null where a part is missing. Best F1 NER first is
    the caller's order; lugar holds it, ties by id.
    """
    from pyspark.sql import Window

    last = _last(trainings, "experimento_id").select("experimento_id", F.col("id").alias("_t"), F.col("modelo").alias("Modelo NER"))
    f1 = evaluations.select(F.col("treinamento_id").alias("_t"), F.round("f1_micro", 4).alias("F1 NER"))
    joined = anonymisations.join(last, "experimento_id").join(f1, "_t", "left")
    table = joined.select(
        "id", F.col("modelo").alias("Modelo"), "Modelo NER", "F1 NER", F.col("coverage").alias("Coverage"), F.col("precision_anon").alias("Precision"),
        F.col("f1_original").alias("F1 Original"), F.col("f1_anonimizado").alias("F1 Anonimizado"), F.round(F.col("f1_anonimizado") - F.col("f1_original"), 4).alias("ΔF1"),
    )
    # A table of one row per execution: some hundreds, ranked in one task.
    return table.withColumn("lugar", F.row_number().over(Window.orderBy(F.desc_nulls_last("F1 NER"), "id")))


def for_templates(table: DataFrame) -> DataFrame:
    """The table under names without blanks and signs."""
    return table.withColumnsRenamed(TEMPLATE_NAMES)


def dashboard(experiments: DataFrame, trainings: DataFrame, evaluations: DataFrame, anonymisations: DataFrame, sessions: DataFrame, splits: DataFrame) -> DataFrame:
    """Every training with its experiment, its evaluation, and the experiment's last anonymisation, annotation session and split; null where there is none."""
    anon = _last(anonymisations, "experimento_id").select("experimento_id", F.col("id").alias("anonimizacao_id"), "coverage")
    notes = _last(sessions, "experimento_id").select("experimento_id", F.col("id").alias("anotacao_id"))
    parts = _last(splits, "experimento_id").select("experimento_id", F.col("id").alias("divisao_id"))
    runs = trainings.select("experimento_id", F.col("id").alias("treinamento_id"), "modelo")
    out = experiments.select(F.col("id").alias("experimento_id"), "nome").join(runs, "experimento_id")
    out = out.join(evaluations.select("treinamento_id", "f1_micro"), "treinamento_id", "left")
    for side in (anon, notes, parts):
        out = out.join(side, "experimento_id", "left")
    return out


def experiment_detail(experiments: DataFrame, one_to_one: dict[str, DataFrame], one_to_many: dict[str, DataFrame]) -> DataFrame:
    """Every experiment with the last row of each 1:1 relation as a struct (null if none) and all rows of each 1:n relation as an array, the newest first."""
    out = experiments
    for name, df in one_to_one.items():
        cols = [c for c in df.columns if c != "experimento_id"]
        side = _last(df, "experimento_id").select(F.col("experimento_id").alias("_e"), F.struct(*cols).alias(name))
        out = out.join(side, out["id"] == side["_e"], "left").drop("_e")
    for name, df in one_to_many.items():
        cols = [c for c in df.columns if c not in ("experimento_id", "criado_em", "id")]
        rows = df.groupBy(F.col("experimento_id").alias("_e")).agg(F.sort_array(F.collect_list(F.struct("criado_em", "id", *cols)), asc=False).alias(name))  # the runs of one experiment
        out = out.join(rows, out["id"] == rows["_e"], "left").drop("_e")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(dict(out.dtypes)[name])))
    return out


def active(df: DataFrame, experiment: int | None) -> DataFrame:
    """The rows of the active experiment, or all if there is none; the newest first is the order of the lists built on it."""
    return df if experiment is None else df.where(F.col("experimento_id") == experiment)
