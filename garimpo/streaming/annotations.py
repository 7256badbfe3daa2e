"""Annotation saves as a stream: a current-label table kept by micro-batches.

An extra: the workflow itself saves annotations one request at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from garimpo.operators.labels import latest_rows

KEYS = ["sentenca_id", "anotador_id", "posicao"]


def current_labels(stream: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append each micro-batch's latest rows under folder/batch=<id>; read_current() resolves them.

    Writing a batch again after a failure replaces the same folder, so every save counts once.
    """

    def save(batch: DataFrame, number: int) -> None:
        latest_rows(batch, KEYS, ["atualizado_em", "criado_em"]).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_current(spark, folder: str) -> DataFrame:
    """The latest row of each key over all micro-batches."""
    return latest_rows(spark.read.parquet(folder).drop("batch"), KEYS, ["atualizado_em", "criado_em"])


def progress_by_window(stream: DataFrame, every: str = "1 day", late: str = "7 days") -> DataFrame:
    """Saves per annotator and window of time, with a bound on lateness."""
    from pyspark.sql import functions as F

    return stream.withWatermark("atualizado_em", late).groupBy(F.window("atualizado_em", every), "anotador_id").agg(F.count(F.lit(1)).alias("linhas"))
