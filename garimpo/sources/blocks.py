"""Records of delimited files, found block by block.

Method: structural indexing. Files are read by their physical lines, in as many blocks as
Spark cuts them into; the quotes before a block decide, by their parity, whether it begins
inside a quoted field, and the parity at each line end decides whether a record ends there.
So no file has to be read by one task, whatever line ends its fields hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from garimpo.sources.rawload import QUOTE, split_fields

#: What a row of _cut is: a whole record, or the end, beginning or middle of one that lies in several blocks.
WHOLE, END, BEGINNING, MIDDLE = range(4)
_CUT = "arquivo string, bloco bigint, ordem bigint, tipo int, linha string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(linha, arquivo, bloco): physical lines in the order of the file within each block (the place of its first byte)."""
    rows = spark.read.text(path, lineSep="\n")
    return rows.select(F.col("value").alias("linha"), F.col("_metadata.file_path").alias("arquivo"), F.col("_metadata.file_block_start").alias("bloco"))


def _quotes(lines: pa.Array) -> np.ndarray:
    """Quotes in each line."""
    bounds = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    data = lines.buffers()[2]
    before = np.concatenate([[0], np.cumsum(np.frombuffer(data, np.uint8)[: bounds[-1]] == QUOTE)]) if data is not None else np.zeros(1, np.int64)
    return before[bounds[1:]] - before[bounds[:-1]]


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(arquivo, bloco, ordem, linha): every record of the files at path, quotes included; ordem counts within a block from 0.

    A record ends at a line end before which the file has an even number of quotes; a
    carriage return before it is no part of the record. The quotes of each block are
    counted first: one row per block (128 MB or so of a file) reaches the driver and goes
    to every task. Whole records are never shuffled; only the pieces of those that lie in
    several blocks, at most two a block, meet. An empty line is a record of one empty
    field, an empty file has none. Quoting left open swallows the lines up to the next
    quote; such a record fails when its fields are told apart (split_fields).
    """
    lines = _lines(spark, path)
    quotes = F.length("linha") - F.length(F.translate("linha", '"', ""))
    blocks = lines.groupBy("arquivo", "bloco").agg(F.sum(quotes).alias("aspas"))
    before = F.sum("aspas").over(Window.partitionBy("arquivo").orderBy("bloco").rowsBetween(Window.unboundedPreceding, -1))
    inside = {(r["arquivo"], r["bloco"]): int(r["dentro"]) for r in blocks.select("arquivo", "bloco", F.pmod(F.coalesce(before, F.lit(0)), F.lit(2)).alias("dentro")).collect()}
    inside = spark.sparkContext.broadcast(inside)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, odd, started, open_lines, n = None, 0, False, [], 0

        def rest() -> list[tuple]:
            """What is left of a block when it ends."""
            return [(*at, n, BEGINNING if started else MIDDLE, "\n".join(open_lines))] if open_lines else []

        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[tuple] = []
            files, starts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            texts, quotes = batch.column(0).to_pylist(), _quotes(batch.column(0)).tolist()
            for file, start, text, k in zip(files, starts, texts, quotes):
                if (file, start) != at:
                    out += rest()
                    at, n, open_lines = (file, start), 0, []
                    odd = inside.value[at]
                    started = not odd
                open_lines.append(text)
                odd = (odd + k) & 1
                if not odd:
                    record = "\n".join(open_lines)
                    out.append((*at, n, WHOLE if started else END, record.removesuffix("\r")))
                    n, open_lines, started = n + 1, [], True
            if out:
                yield _batch(out)
        if at is not None and (out := rest()):
            yield _batch(out)

    pieces = lines.mapInArrow(cut, _CUT)
    parts = pieces.where(F.col("tipo") != WHOLE)
    begun = F.sum((F.col("tipo") == BEGINNING).cast("int")).over(Window.partitionBy("arquivo").orderBy("bloco", "ordem"))
    joined = (
        parts.withColumn("_g", begun)
        .groupBy("arquivo", "_g")
        .agg(F.sort_array(F.collect_list(F.struct("bloco", "ordem", "linha"))).alias("_p"))
        .select("arquivo", F.col("_p")[0]["bloco"].alias("bloco"), F.col("_p")[0]["ordem"].alias("ordem"), F.array_join(F.transform("_p", lambda x: x["linha"]), "\n").alias("linha"))
    )
    return pieces.where(F.col("tipo") == WHOLE).select("arquivo", "bloco", "ordem", "linha").unionByName(joined)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    file, block, order, kind, line = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(file), pa.array(block, pa.int64()), pa.array(order, pa.int64()), pa.array(kind, pa.int32()), pa.array(line, pa.string())], names=["arquivo", "bloco", "ordem", "tipo", "linha"]
    )


def read_fields(spark: SparkSession, path: str, columns: list[str], header: bool = True) -> DataFrame:
    """Fields of the records as text columns, with campos, their number (-1: broken quoting); a header record is left out.

    Fields that a record lacks are null.
    """
    records = read_records(spark, path)
    if header:
        records = records.where("bloco > 0 or ordem > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, fields = split_fields(batch.column(0), len(columns))
            yield pa.RecordBatch.from_arrays([pa.array(count, pa.int64()), *fields], names=["campos", *columns])

    return records.select("linha").mapInArrow(run, "campos bigint, " + ", ".join(f"`{c}` string" for c in columns))
