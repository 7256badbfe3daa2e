"""One consistent form of texts that look the same.

Method: script-aware repair. Widths, blanks, joined letters, accents and invisible
characters have fixed plain forms; look-alike letters are replaced only in tokens whose
scripts are mixed (or foreign within a Latin text) and only when the result is a word of
the corpus vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm import glyphs
from garimpo.shared import materialize

#: Tasks over which the members of one class are spread when pairs are formed.
SALTS = 16


#: Words that a task remembers before it sends them on.
MEMORY = 1 << 20

#: Bytes of UTF-8 in lower case, all ASCII but letters as blanks; other bytes stay and are looked at when words are told apart.
_LOWER = bytes(b if b >= 128 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))
#: Bytes that only an odd text has: control characters but line ends, and first bytes of characters beyond Latin-1.
_ODD_BYTE = np.array([b < 32 and b not in (10, 13) or b == 127 or b >= 0xC4 for b in range(256)])
_TOKENS = "array<struct<token:string,form:string>>"
_SCANNED = f"kind string, id bigint, r1 bigint, r2 bigint, text string, tokens {_TOKENS}, word string"


def _views(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and bounds of a string column without nulls."""
    bounds = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), bounds


def odd_rows(column: pa.Array) -> np.ndarray:
    """Which texts hold a character that may need folding (glyphs.ODD), told from their bytes."""
    data, bounds = _views(column)
    if not len(column):
        return np.empty(0, bool)
    data = data[: bounds[-1]]
    odd = _ODD_BYTE[data]
    at = np.flatnonzero(data[:-1] == 0xC2) if len(data) else np.empty(0, np.int64)
    after = data[at + 1]
    odd[at] |= (after <= 0xA0) | (after == 0xAD)
    before = np.concatenate([[0], np.cumsum(odd)])
    return before[bounds[1:]] > before[bounds[:-1]]


def _words(seen: set[bytes]) -> set[str]:
    """Words, as runs of letters with their accents, of lower-case pieces of texts."""
    out: set[str] = set()
    for piece in seen:
        if piece.isascii():
            out.add(piece.decode())
        else:
            out.update(glyphs.WORD.findall(piece.decode().lower()))
    return out


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One reading of all texts: their hashes, the odd ones with their suspect tokens, and the words of all."""
    schema = pa.schema(
        [("kind", pa.string()), *[(c, pa.int64()) for c in ("id", "r1", "r2")], ("text", pa.string()), ("tokens", pa.list_(pa.struct([("token", pa.string()), ("form", pa.string())]))), ("word", pa.string())]
    )

    def out(kind: str, n: int, **columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([kind] * n)] + [pa.array(columns.get(f.name, [None] * n), f.type) for f in list(schema)[1:]], schema=schema)

    seen: set[bytes] = set()
    for batch in batches:
        if not batch.num_rows:
            continue
        data, bounds = _views(batch.column(1))
        data = data.tobytes()
        odd = odd_rows(batch.column(1))
        digests = []
        for a, b, is_odd in zip(bounds[:-1].tolist(), bounds[1:].tolist(), odd.tolist()):
            piece = data[a:b]
            digests.append(xxhash.xxh3_128_digest(piece))
            if not is_odd:
                seen.update(piece.translate(_LOWER).split())
        twins = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        ids = batch.column(0).to_pylist()
        plain = np.flatnonzero(~odd)
        if len(plain):
            yield out("plain", len(plain), id=[ids[i] for i in plain], r1=twins[plain, 0], r2=twins[plain, 1])
        strange = np.flatnonzero(odd)
        if len(strange):
            texts = [glyphs.compat(batch.column(1)[int(i)].as_py()) for i in strange]
            for t in texts:
                seen.update(t.encode().translate(_LOWER).split())
            tokens = [[{"token": k, "form": v} for k, v in glyphs.suspects(t).items()] for t in texts]
            yield out("odd", len(strange), id=[ids[i] for i in strange], r1=twins[strange, 0], r2=twins[strange, 1], text=texts, tokens=tokens)
        if len(seen) > MEMORY:
            yield out("word", len(w := sorted(_words(seen))), word=w)
            seen = set()
    if words := sorted(_words(seen)):
        yield out("word", len(words), word=words)


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        forms = [t if r is None or len(r) == 0 else glyphs.repair(t, {x["token"]: x["form"] for x in r}) for t, r in zip(pdf["text"], pdf["repairs"])]
        twins = [(int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)) for d in (xxhash.xxh3_128_digest(f.encode()) for f in forms)]
        yield pdf[["id", "r1", "r2"]].assign(form=forms, k1=np.array([k for k, _ in twins], np.int64), k2=np.array([k for _, k in twins], np.int64))


def _scanned(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(plain, odd): hashes (id, r1, r2) of the texts that are their own form; the others (id, r1, r2, form, k1, k2), one row each, k1 and k2 being the hash of the form."""
    rows = texts.select(F.col("id").cast("bigint").alias("id"), "text").where("text is not null")
    all_rows = materialize(rows.mapInArrow(_scan, _SCANNED).withColumn("row", F.monotonically_increasing_id()), "scanned")
    odd = all_rows.where("kind = 'odd'")
    tokens = odd.select("row", "id", F.explode("tokens").alias("t")).select("row", "id", F.col("t.token").alias("token"), F.col("t.form").alias("form"), F.lower("t.form").alias("word"))
    wanted = tokens.groupBy("word").agg(F.min("id").alias("_a"), F.max("id").alias("_b"))
    vocabulary = all_rows.where("kind = 'word'").select("word")
    known = wanted.where("_a <> _b").select("word").unionByName(wanted.select("word").join(vocabulary, "word", "left_semi")).distinct()
    accepted = (
        tokens.join(known, "word", "left_semi").groupBy("row").agg(F.collect_set(F.struct("token", "form")).alias("repairs"))
    )  # the suspects of one text
    done = odd.select("row", "id", "r1", "r2", "text").join(accepted, "row", "left").mapInPandas(_apply, "id bigint, r1 bigint, r2 bigint, form string, k1 bigint, k2 bigint")
    return all_rows.where("kind = 'plain'").select("id", "r1", "r2"), done


def consistent_forms(texts: DataFrame) -> DataFrame:
    """(id, form, odd) for every row of texts (id BIGINT, text STRING) with a non-null text.

    odd marks texts that hold a character outside plain ASCII and Latin-1; all others are
    their own form. The vocabulary is every word of the corpus without foreign letters; a
    suspect token's Latin form is accepted if it is in the vocabulary (without regard to
    case) or if tokens of two records lead to it. Cases: null texts give no row; empty
    texts stay empty; repeated rows stay; very long texts are one row; extra columns are
    ignored.
    """

    def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(~odd_rows(batch.column(1))))

    rows = texts.select(F.col("id").cast("bigint").alias("id"), F.col("text").alias("form")).where("form is not null")
    _, odd = _scanned(texts)
    return rows.mapInArrow(plain, "id bigint, form string").withColumn("odd", F.lit(False)).unionByName(odd.select("id", "form", F.lit(True).alias("odd")))


def same_look_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): ids a < b whose texts differ as strings but have one consistent form.

    Only classes with an odd text can hold such a pair, and every pair has an odd side:
    the odd members of a class meet all its members, spread over SALTS tasks. Texts are
    compared by 128-bit hashes, read once, and none but odd ones is shuffled.
    """

    plain, odd = _scanned(texts)
    odd = materialize(odd.select(F.lit(True).alias("odd"), "id", "k1", "k2", "r1", "r2").distinct(), "oddkeys")
    plain = plain.select(F.lit(False).alias("odd"), "id", F.col("r1").alias("k1"), F.col("r2").alias("k2"), "r1", "r2")
    classes = odd.select("k1", "k2").distinct()
    members = odd.unionByName(plain.join(classes, ["k1", "k2"], "left_semi")).withColumn("s", F.pmod(F.col("id"), F.lit(SALTS)).cast("int"))
    left = odd.select("k1", "k2", F.col("id").alias("_id"), F.col("r1").alias("_r1"), F.col("r2").alias("_r2"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s"))
    met = left.join(members, ["k1", "k2", "s"]).where("(_r1 <> r1 or _r2 <> r2) and (not odd or _id < id)")
    return met.select(F.least("_id", "id").alias("a"), F.greatest("_id", "id").alias("b"))
