"""Loading of raw delimited records with a reason for every record that fails.

Method: structural indexing. numpy masks of quotes and delimiters over the bytes of a
whole batch, the parity of quote runs and binary searches locate the fields of all its
records at once; counts and types are then checked in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fields of a record, in order; the third one's name depends on the file.
FIELDS = ["cd_paciente", "dt_atendimento", "ds_texto", "ds_especialid_atendimento", "ds_multi_empresa"]
# Accepted forms of dt_atendimento and what each must look like.
DATE_FORMS = {
    "dd/MM/yyyy": r"^\d{2}/\d{2}/\d{4}$",
    "dd/MM/yyyy HH:mm": r"^\d{2}/\d{2}/\d{4} \d{2}:\d{2}$",
    "yyyy-MM-dd HH:mm:ss": r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$",
}
YEARS = (2010, 2025)

QUOTE, DELIMITER = 0x22, 0x3B


def index_records(data: np.ndarray, start: np.ndarray, end: np.ndarray, fields: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Structure of records data[start:end] (bytes): (fields of each or -1 for broken quoting, field starts, field ends).

    Starts and ends are given for the first `fields` fields, quotes included. A field is
    quoted if its first byte is a quote. It closes with the first later run of quotes of
    odd length (the opening quote not counted), since pairs are doubled quotes; elsewhere
    quotes are ordinary. All records advance together, one field at a time; beyond
    `fields` they jump from one quoted field to the next.
    """
    n = len(start)
    quote = data == QUOTE
    delims = np.flatnonzero(data == DELIMITER)
    opens = np.flatnonzero(quote & ~np.concatenate([[False], quote[:-1]])) if len(data) else np.empty(0, int)  # run starts
    closes = np.flatnonzero(quote & ~np.concatenate([quote[1:], [False]])) if len(data) else np.empty(0, int)  # run ends
    # Runs cannot cross records: a separator byte stands between them.
    odd = (closes - opens) % 2 == 0
    odd_open, odd_close = opens[odd], closes[odd]
    jump = delims[quote[np.minimum(delims + 1, len(data) - 1)] & (delims + 1 < len(data))] if len(delims) else delims
    count = np.ones(n, dtype=np.int64)
    broken = np.zeros(n, dtype=bool)
    begins, finishes = np.zeros((fields, n), dtype=np.int64), np.zeros((fields, n), dtype=np.int64)
    live, at = np.arange(n), start.copy()
    step = 0

    def first(positions: np.ndarray, least: np.ndarray, limit: np.ndarray) -> np.ndarray:
        k = np.searchsorted(positions, least)
        got = np.where(k < len(positions), positions[np.minimum(k, len(positions) - 1)] if len(positions) else -1, -1)
        return np.where((got >= 0) & (got < limit), got, -1)

    while len(live):
        pos, stop = at[live], end[live]
        quoted = (pos < stop) & (data[np.minimum(pos, max(len(data) - 1, 0))] == QUOTE) if len(data) else np.zeros(len(live), bool)
        close = np.full(len(live), -1, dtype=np.int64)
        if quoted.any():
            p, s = pos[quoted], stop[quoted]
            run = np.searchsorted(opens, p, side="right") - 1  # the run that starts with the opening quote
            inner = closes[run] - p  # its quotes after the opening one
            k = np.searchsorted(odd_open, closes[run] + 1)
            later = np.where(k < len(odd_open), odd_close[np.minimum(k, len(odd_close) - 1)] if len(odd_close) else -1, -1)
            c = np.where(inner % 2 == 1, closes[run], np.where((later >= 0) & (later < s), later, -1))
            follow = np.where((c >= 0) & (c + 1 < s), data[np.minimum(c + 1, len(data) - 1)], DELIMITER)
            bad = (c < 0) | (follow != DELIMITER)
            broken[live[quoted][bad]] = True
            close[quoted] = np.where(bad, s, c + 1)
        if step < fields:
            tail = np.where(quoted, close, first(delims, pos, stop))
            last = np.where(quoted, tail >= stop, tail < 0)
            finish = np.where(last, stop, tail)
            begins[step, live], finishes[step, live] = pos, finish
            more = ~last
        else:
            skip = np.where(quoted, close, pos)
            nxt = np.where(quoted & (close < stop), close, first(jump, skip, stop))
            whole = (nxt < 0) | (quoted & (close >= stop))
            here = np.searchsorted(delims, np.where(whole, stop, nxt)) - np.searchsorted(delims, skip)
            count[live] += np.where(quoted & (close >= stop), 0, here)
            more, finish = ~whole, nxt
        more &= ~broken[live]
        live = live[more]
        at[live] = finish[more] + 1
        count[live] += 1
        step += 1
    return np.where(broken, -1, count), begins, finishes


def split_fields(lines: pa.Array, fields: int) -> tuple[np.ndarray, list[pa.Array]]:
    """(fields of each record or -1 for broken quoting, columns): the first `fields` fields of all records, unquoted.

    A field that a record lacks is null; of a record with broken quoting all are. Bytes are
    gathered by position; of doubled quotes the second is left out. Null lines count as empty.
    """
    lines = lines.fill_null("")
    n = len(lines)
    bounds = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    sizes = np.diff(bounds)
    data = np.zeros(int(sizes.sum()) + n, np.uint8)  # a zero byte ends every record
    if sizes.sum():
        data[np.arange(sizes.sum()) + np.repeat(np.arange(n), sizes)] = np.frombuffer(lines.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    start = np.cumsum(sizes + 1) - sizes - 1
    count, begins, finishes = index_records(data, start, start + sizes, fields)
    columns = []
    for k in range(fields):
        held = np.flatnonzero(count > k)
        first, last = begins[k][held], finishes[k][held]
        quoted = (last > first) & (data[np.minimum(first, max(len(data) - 1, 0))] == QUOTE) if len(held) else np.zeros(0, bool)
        first, long = first + quoted, last - first - 2 * quoted
        upto = np.cumsum(long)
        row = np.repeat(np.arange(len(held)), long)
        piece = data[np.arange(len(row)) - np.repeat(upto - long, long) + first[row]] if len(row) else np.empty(0, np.uint8)
        marks = (piece == QUOTE) & quoted[row]
        if marks.any():
            rank = np.cumsum(marks)
            rank -= np.concatenate([[0], rank])[(upto - long)[row]]  # quotes of the same field so far
            kept = ~(marks & (rank % 2 == 0))
            piece, long = piece[kept], np.bincount(row[kept], minlength=len(held))
        offsets = np.concatenate([[0], np.cumsum(long)]).astype(np.int32)
        texts = pa.StringArray.from_buffers(len(held), pa.py_buffer(offsets.tobytes()), pa.py_buffer(piece.tobytes()))
        at = np.zeros(n, np.int64)
        at[held] = np.arange(len(held))
        columns.append(texts.take(pa.array(at, mask=count <= k)))
    return count, columns


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        count, columns = split_fields(batch.column(2), len(FIELDS))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64()), *columns], names=["linha_id", "arquivo", "campos", *FIELDS])


def attendance_time(c: Column) -> Column:
    """Timestamp of a strict attendance date within YEARS; null for any other text."""
    parsed = [F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(form))) for form, shape in DATE_FORMS.items()]
    at = F.coalesce(*parsed)
    return F.when(F.year(at).between(*YEARS), at)


def parse_records(raw: DataFrame) -> DataFrame:
    """Every record of raw (linha_id, arquivo, linha) with its fields or the first reason why it fails.

    Columns: linha_id, arquivo, motivo (null for a valid record) and FIELDS (null for
    records without five fields). Reasons, in order: 'aspas' broken quoting, 'colunas' not
    five fields (an empty or null line has one), 'valor' cd_paciente is not 1 to 12 digits
    above 0 or dt_atendimento no existing date or time of YEARS. Repeated records stay;
    lines of any length and line ends inside quotes are read whole; further columns of raw
    are ignored; an empty table gives an empty result.
    """
    rows = raw.select(F.col("linha_id").cast("bigint").alias("linha_id"), F.col("arquivo").cast("string").alias("arquivo"), F.col("linha").cast("string").alias("linha"))
    named = rows.mapInArrow(_split, "linha_id bigint, arquivo string, campos bigint, " + ", ".join(f"{f} string" for f in FIELDS))
    number = F.col("cd_paciente").rlike(r"^[0-9]{1,12}$") & ~F.col("cd_paciente").rlike(r"^0+$")
    value = number & attendance_time(F.col("dt_atendimento")).isNotNull()
    reason = F.when(F.col("campos") < 0, "aspas").when(F.col("campos") != len(FIELDS), "colunas").when(~value, "valor")
    whole = [F.when(F.col("campos") == len(FIELDS), F.col(f)).alias(f) for f in FIELDS]
    return named.select("linha_id", "arquivo", reason.alias("motivo"), *whole)


# Texts that stand for a missing value in delimited files.
MISSING = ["", "NA", "N/A", "NULL", "null", "NaN", "nan", "None", "n/a", "<NA>", "#N/A", "-nan", "-NaN"]


def valid_records(raw: DataFrame, file: str) -> DataFrame:
    """The valid records of one file as rows of its table: the text column is ds_evolucao or ds_parecer."""
    text = "ds_parecer" if file.startswith("parecer") else "ds_evolucao"
    good = parse_records(raw).where((F.col("arquivo") == file) & F.col("motivo").isNull())
    plain = {f: F.when(~F.col(f).isin(MISSING), F.col(f)) for f in FIELDS}
    return good.select("linha_id", *[plain[f].alias(text if f == "ds_texto" else f) for f in FIELDS])


def rejected_records(raw: DataFrame) -> DataFrame:
    """(linha_id, motivo) of the records that fail."""
    return parse_records(raw).where(F.col("motivo").isNotNull()).select("linha_id", "motivo")
