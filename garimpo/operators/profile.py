"""Profile of note corpora: counts, periods, length distributions, text kinds, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.functions.text import blank_tokens, text_type

#: Accepted forms of dt_atendimento, most specific first.
DATE_FORMS = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm", "dd/MM/yyyy"]


def notes(prescricoes: DataFrame, pareceres: DataFrame) -> DataFrame:
    """UNION ALL of both tables in one shape: nr_registro, cd_paciente, dt_atendimento, texto, especialidade, hospital, doc_type."""

    def one(df: DataFrame, text: str, kind: str) -> DataFrame:
        hospital = next((c for c in ("ds_multi_empresa", "cd_multi_empresa") if c in df.columns), None)
        special = "ds_especialid_atendimento" if "ds_especialid_atendimento" in df.columns else None
        return df.select(
            "nr_registro", "cd_paciente", "dt_atendimento", F.col(text).alias("texto"),
            (F.col(special) if special else F.lit(None).cast("string")).alias("especialidade"),
            (F.col(hospital) if hospital else F.lit(None).cast("string")).alias("hospital"), F.lit(kind).alias("doc_type"),
        )

    return one(prescricoes, "ds_evolucao", "prescricao").unionByName(one(pareceres, "ds_parecer", "parecer"))


def lenient_time(c: Column) -> Column:
    """Timestamp in any accepted form; null for any other text."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMS])


def record_counts(df: DataFrame) -> DataFrame:
    """Records per doc_type and in all ('total')."""
    counted = df.rollup("doc_type").agg(F.count(F.lit(1)).alias("registros"))
    return counted.select(F.coalesce("doc_type", F.lit("total")).alias("doc_type"), "registros")


def distinct_patients(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("cd_paciente").alias("pacientes"))


def period(df: DataFrame) -> DataFrame:
    at = lenient_time(F.col("dt_atendimento"))
    return df.agg(F.min(at).alias("inicio"), F.max(at).alias("fim"))


def top_values(df: DataFrame, column: str, n: int = 10) -> DataFrame:
    """Most frequent values, ties by name; nulls do not count."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("valor")).agg(F.count(F.lit(1)).alias("registros"))
    return counted.orderBy(F.desc("registros"), "valor").limit(n)


def hospitals(df: DataFrame) -> DataFrame:
    return df.agg(F.countDistinct("hospital").alias("hospitais"))


def token_count(c: Column) -> Column:
    return F.size(blank_tokens(c))


def char_count(c: Column) -> Column:
    return F.coalesce(F.length(c), F.lit(0))


def stop_count(c: Column) -> Column:
    """Full stops + 1; 0 for null."""
    return F.coalesce(F.length(c) - F.length(F.translate(c, ".", "")) + 1, F.lit(0))


def measured(df: DataFrame) -> DataFrame:
    """Notes with their counts (tok, car, sen) and kind (k) instead of their texts: what all tables of the profile are made of, from one reading."""
    t = F.col("texto")
    return df.select("doc_type", "cd_paciente", "hospital", "especialidade", "dt_atendimento", token_count(t).alias("tok"), char_count(t).alias("car"), stop_count(t).alias("sen"), text_type(t).alias("k"))


def distribution(df: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """min, media (1 place), mediana, max, p25, p75 per group; exact quantiles, cut to whole numbers."""
    q = F.percentile("_v", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]))
    out = df.select(*by, value.alias("_v")).groupBy(*by).agg(F.min("_v").alias("min"), F.round(F.avg("_v"), 1).alias("media"), F.max("_v").alias("max"), q.alias("_q"))
    return out.select(*by, "min", "media", "max", *[F.col("_q")[k].cast("int").alias(name) for k, name in enumerate(("p25", "mediana", "p75"))])


def type_shares(df: DataFrame, by: list[str]) -> DataFrame:
    """Texts per kind and shares of both known kinds in per cent (1 place, of all texts)."""
    kind = df.select(*by, (F.col("k") if "k" in df.columns else text_type(F.col("texto"))).alias("_k"))
    n = F.count(F.lit(1))

    def count(k: str) -> Column:
        return F.count_if(F.col("_k") == k)

    return kind.groupBy(*by).agg(
        n.alias("textos"), count("template_estruturado").alias("templates"), count("texto_livre").alias("livres"), count("desconhecido").alias("desconhecidos"),
        F.round(100 * count("template_estruturado") / n, 1).alias("pct_template"), F.round(100 * count("texto_livre") / n, 1).alias("pct_livre"),
    )


def histogram(df: DataFrame, value: Column, bins: int = 10) -> DataFrame:
    """(faixa, de, ate, textos) of equal-width, right-closed bins over the range of value; empty bins too.

    One pass finds the range (one row), a second counts; the first bin holds the minimum.
    """
    v = df.select(value.cast("double").alias("_v")).where("_v is not null")
    ends = v.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    width = F.greatest((F.col("_hi") - F.col("_lo")) / bins, F.lit(1e-9))
    place = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.ceil((F.col("_v") - F.col("_lo")) / width).cast("int") - 1))
    counted = v.crossJoin(F.broadcast(ends)).groupBy(place.alias("faixa")).agg(F.count(F.lit(1)).alias("_n"))  # one row
    all_bins = ends.select("_lo", width.alias("_w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("faixa"))
    joined = all_bins.join(counted, "faixa", "left")
    edge = F.col("_lo") + F.col("faixa") * F.col("_w")
    return joined.select("faixa", F.round(edge, 3).alias("de"), F.round(edge + F.col("_w"), 3).alias("ate"), F.coalesce("_n", F.lit(0)).alias("textos"))


def table_one(df: DataFrame) -> DataFrame:
    """(caracteristica, prescricao, parecer): the comparison table of both corpora, one single-pass aggregate per corpus."""
    base = df if "k" in df.columns else measured(df)
    aggs = [F.count(F.lit(1)).cast("double").alias("registros"), F.countDistinct("cd_paciente").cast("double").alias("pacientes"), F.countDistinct("hospital").cast("double").alias("hospitais")]
    for c in ("tok", "car", "sen"):
        aggs += [F.round(F.avg(c), 1).alias(f"{c}_media"), F.percentile(c, F.lit(0.5)).alias(f"{c}_mediana"), F.min(c).cast("double").alias(f"{c}_min"), F.max(c).cast("double").alias(f"{c}_max")]
    aggs += [F.count_if(F.col("k") == k).cast("double").alias(k) for k in ("template_estruturado", "texto_livre", "desconhecido")]
    wide = base.groupBy("doc_type").agg(*aggs)
    names = [c for c in wide.columns if c != "doc_type"]
    long = wide.unpivot("doc_type", names, "caracteristica", "valor")
    return long.groupBy("caracteristica").pivot("doc_type", ["prescricao", "parecer"]).agg(F.first("valor"))
