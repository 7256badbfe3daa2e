"""Hybrid anonymisation: masks, tokens, an optional tagger, markers."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from garimpo.functions import patterns as P
from garimpo.functions.text import normalize, word_tokens
from garimpo.operators.spans import placeholders_to_markers

_TAGGERS: dict[str, Callable[[list[str]], list[str]]] = {}


def register_tagger(name: str, tag: Callable[[list[str]], list[str]]) -> None:
    """Make a function from the tokens to the labels of a sentence known by a name."""
    _TAGGERS[name] = tag


def tagger_column(tag: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    """An Arrow-batched column function of a tagger."""

    @F.pandas_udf(ArrayType(StringType()))
    def run(tokens: pd.Series) -> pd.Series:
        return tokens.map(lambda t: list(tag(list(t))))

    return run


def _spans(labels: Column) -> Column:
    """Strict spans (inicio, fim, tipo) of a label array, without leaving the row."""
    start = F.array().cast("array<struct<inicio:int,fim:int,tipo:string>>")
    pos = F.transform(labels, lambda x, i: F.struct(x.alias("l"), i.alias("i")))

    def step(acc: Column, x: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        kind = F.substring(x["l"], 3, 100)
        grows = x["l"].startswith("I-") & (last["fim"] == x["i"]) & (last["tipo"] == kind)
        one = F.array(F.struct(x["i"].alias("inicio"), (x["i"] + 1).alias("fim"), kind.alias("tipo")))
        longer = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["inicio"].alias("inicio"), (x["i"] + 1).alias("fim"), kind.alias("tipo"))))
        return F.when(x["l"].startswith("B-"), F.concat(acc, one)).when(F.coalesce(grows, F.lit(False)), longer).otherwise(acc)

    return F.aggregate(pos, start, step)


def anonymise(df: DataFrame, text: str = "texto", tagger: str | None = None) -> DataFrame:
    """df with texto_anonimizado, n_phi_regex, n_phi_ner and n_phi_total.

    Text is normalised and masked, cut into tokens, tagged (None: masks only); spans of
    types that masks handle are dropped, the others replaced by markers, then placeholders
    by theirs. The whole chain is one projection; only the tagger leaves the JVM.
    """
    base = df.withColumn("_tok", word_tokens(normalize(F.col(text))))
    holders = F.array(*[F.lit(p) for p in P.PLACEHOLDERS])
    n_regex = F.size(F.filter("_tok", lambda t: F.array_contains(holders, t)))
    if tagger is None:
        base = base.withColumn("_spans", F.array().cast("array<struct<inicio:int,fim:int,tipo:string>>"))
    else:
        base = base.withColumn("_lab", tagger_column(_TAGGERS[tagger])("_tok"))
        base = base.withColumn("_spans", F.filter(_spans(F.col("_lab")), lambda s: ~s["tipo"].isin(P.REGEX_TYPES)))
    markers = F.create_map(*[F.lit(x) for kv in P.MARKERS.items() for x in kv])

    def shown(t: Column, i: Column) -> Column:
        hit = F.filter("_spans", lambda s: (s["inicio"] <= i) & (i < s["fim"]))
        first = F.get(hit, F.lit(0))
        return F.when(F.size(hit) == 0, t).when(first["inicio"] == i, F.coalesce(F.try_element_at(markers, first["tipo"]), F.concat(F.lit("["), first["tipo"], F.lit("]"))))

    kept = F.filter(F.transform("_tok", shown), lambda x: x.isNotNull())
    out = base.withColumns({"texto_anonimizado": F.array_join(placeholders_to_markers(kept), " "), "n_phi_regex": n_regex, "n_phi_ner": F.size("_spans")})
    return out.withColumn("n_phi_total", F.col("n_phi_regex") + F.col("n_phi_ner")).drop("_tok", "_spans", "_lab")


def marker_counts(df: DataFrame) -> DataFrame:
    """(marcador, vezes): markers in the anonymised texts."""
    found = F.regexp_extract_all("texto_anonimizado", F.lit(r"\[(?:CONTATO|DOCUMENTO|ENDEREÇO|DATA|HORA|PESSOA|INSTITUIÇÃO)\]"), F.lit(0))
    return df.select(F.explode(found).alias("marcador")).groupBy("marcador").agg(F.count(F.lit(1)).alias("vezes"))
