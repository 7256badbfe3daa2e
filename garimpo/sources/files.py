"""File formats of the workflow: delimited notes, JSON Lines, CoNLL, annotation-tool exports, reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from garimpo.functions import patterns as P
from garimpo.functions.text import token_offsets, word_tokens
from garimpo.sources.blocks import read_fields
from garimpo.sources.rawload import MISSING

SENTENCE = "doc_id bigint, doc_type string, tokens array<string>, labels array<string>"


def read_notes(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """Delimited notes: ';', quotes, line ends inside quotes; all columns text, names lower-case.

    header: the columns of the file. Short rows are filled with null, rows with more fields
    or broken quoting are left out, and the usual marks of a missing value become null.
    Records are found by structural indexing (blocks.py), so large files are split.
    """
    names = [h.strip().lower() for h in header]
    good = read_fields(spark, path, names).where(F.col("campos").between(1, len(names)))
    return good.select(*[F.when(~F.col(n).isin(MISSING), F.col(n)).alias(n) for n in names])


def write_notes(df: DataFrame, path: str) -> None:
    """Delimited notes as read_notes() reads them: ';', every field quoted, quotes doubled."""
    df.write.mode("overwrite").csv(path, sep=";", header=True, quoteAll=True, escape='"', emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """Labelled sentences, one JSON object a line."""
    return spark.read.schema(SENTENCE).json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts to anonymise: field texto, else the tokens joined; lines that are no JSON are left out."""
    df = spark.read.schema("texto string, tokens array<string>").option("mode", "DROPMALFORMED").json(path)
    return df.select(F.coalesce("texto", F.array_join("tokens", " "), F.lit("")).alias("texto"))


def read_conll(spark: SparkSession, path: str, lenient: bool = False) -> DataFrame:
    """(tokens, labels) per sentence of a CoNLL file: token, tab, label; an empty line ends a sentence.

    Without lenient a line without tab fails; with it such lines are ignored, and a line
    of blanks ends a sentence like an empty one. Splitting at double line ends keeps the
    file splittable.
    """
    text = spark.read.text(path, lineSep="\n\n")
    blocks = F.split("value", r"\n[ \t\r]*\n") if lenient else F.array("value")
    lines = text.select(F.explode(blocks).alias("b")).select(F.filter(F.split("b", "\n"), lambda x: x != "").alias("lines"))
    if lenient:
        lines = lines.select(F.filter("lines", lambda x: F.contains(x, F.lit("\t"))).alias("lines"))
    pairs = lines.where(F.size("lines") > 0).select(F.transform("lines", lambda x: F.split(x, "\t")).alias("p"))
    label = (lambda x: F.trim(F.get(x, F.lit(1)))) if lenient else (lambda x: F.when(F.size(x) > 1, x[1]).otherwise(F.raise_error(F.lit("line without tab"))))
    return pairs.select(F.transform("p", lambda x: x[0]).alias("tokens"), F.transform("p", label).alias("labels"))


def conll_lines(df: DataFrame) -> DataFrame:
    """One text per sentence of (tokens, labels); a missing labels column means outside."""
    labels = F.col("labels") if "labels" in df.columns else F.transform("tokens", lambda _: F.lit("O"))
    return df.select(F.array_join(F.zip_with("tokens", labels, lambda t, x: F.concat(t, F.lit("\t"), x)), "\n").alias("value"))


def write_conll(df: DataFrame, path: str) -> None:
    conll_lines(df).write.mode("overwrite").text(path, lineSep="\n\n")


def write_sentences(df: DataFrame, path: str) -> None:
    """JSON Lines of doc_id, doc_type, tokens and labels; labels are outside where missing."""
    labels = F.col("labels") if "labels" in df.columns else F.transform("tokens", lambda _: F.lit("O"))
    df.select("doc_id", "doc_type", "tokens", labels.alias("labels")).write.mode("overwrite").json(path)


def write_splits(df: DataFrame, folder: str) -> None:
    """train, dev and test in CoNLL, from a column particao."""
    for name, split in (("train", "treino"), ("dev", "dev"), ("test", "teste")):
        write_conll(df.where(F.col("particao") == split), f"{folder}/{name}.conll")


def write_anonymised(df: DataFrame, path: str) -> None:
    df.select("texto_original", "texto_anonimizado", "n_phi_regex", "n_phi_ner").write.mode("overwrite").json(path)


def write_metrics(per_type: DataFrame, folder: str) -> None:
    """One JSON object per model: modelo, f1_micro, per_entity by type, from rows (modelo, f1_micro, tipo, precision, recall, f1, support)."""
    entity = F.map_from_entries(F.sort_array(F.collect_list(F.struct("tipo", F.struct("precision", "recall", "f1", "support")))))  # at most one entry per type
    per_type.groupBy("modelo", "f1_micro").agg(entity.alias("per_entity")).write.mode("overwrite").json(folder)


def read_metrics(spark: SparkSession, glob: str, multiline: bool = True) -> DataFrame:
    """(modelo, f1_micro, tipo, precision, recall, f1, support) of metric files, one object a file or (multiline=False) a line."""
    schema = "modelo string, f1_micro double, per_entity map<string,struct<precision:double,recall:double,f1:double,support:bigint>>"
    df = spark.read.schema(schema).json(glob, multiLine=multiline)
    return df.select("modelo", "f1_micro", F.explode("per_entity").alias("tipo", "m")).select("modelo", "f1_micro", "tipo", "m.*")


def consolidated(metrics: DataFrame, key: str) -> DataFrame:
    """A table of measures as texts with 4 places, the best F1 first; missing values as '-'."""
    numbers = [c for c, t in metrics.dtypes if t == "double"]
    return metrics.select(key, *[F.coalesce(F.format_string("%.4f", c), F.lit("-")).alias(c) for c in numbers])


def small_csv(df: DataFrame, path: str, most: int = 100_000) -> None:
    """A report table as one ';' file with byte order mark, written by the driver; refuses more than `most` rows."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: write it with Spark")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    rows.to_csv(path, sep=";", index=False, encoding="utf-8-sig")


def list_files(spark: SparkSession, folders: list[str], suffix: str) -> list[str]:
    """Sorted paths with a suffix; missing folders are skipped."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        fs = path.getFileSystem(conf)
        if fs.exists(path):
            found += [s.getPath().toString() for s in fs.listStatus(path) if s.isFile() and s.getPath().getName().endswith(suffix)]
    return sorted(found)


def import_spans(df: DataFrame) -> DataFrame:
    """(tokens, labels) from an annotation tool's (text, label: [[start, end, type], ...]) rows.

    Tokens that lie fully inside a span are labelled, the first B-, others I-; later spans
    win where they overlap. A containment join inside each row, without exploding it.
    """
    tokens = word_tokens(F.col("text"), P.TOKEN_IMPORT)
    spans = F.transform("label", lambda s: F.struct(s[0].try_cast("int").alias("ini"), s[1].try_cast("int").alias("fim"), s[2].alias("ent")))
    base = df.select("text", tokens.alias("tokens"), F.coalesce(spans, F.array().cast("array<struct<ini:int,fim:int,ent:string>>")).alias("spans"))
    placed = base.withColumn("offs", token_offsets(F.col("text"), F.col("tokens")))

    def label(o, i):
        hit = F.element_at(F.filter("spans", lambda s: (o["ini"] >= s["ini"]) & (o["fim"] <= s["fim"])), -1)
        before = F.get(F.col("offs"), i - 1)
        inside = (i > 0) & (before["ini"] >= hit["ini"])
        return F.when(hit.isNull(), "O").otherwise(F.concat(F.when(inside, "I-").otherwise("B-"), hit["ent"]))

    with_hit = placed.withColumn("labels", F.transform("offs", lambda o, i: F.when(F.size(F.filter("spans", lambda s: (o["ini"] >= s["ini"]) & (o["fim"] <= s["fim"]))) == 0, F.lit("O")).otherwise(label(o, i))))
    return with_hit.select("tokens", "labels")
