"""Entity spans from BIO labels, in four readings, and what is done with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import patterns as P

MODES = ("strict", "seqeval", "run", "typed-run")


def bio_spans(labels: DataFrame, mode: str = "strict", tipo: str | None = None, sent: str = "sentenca_id") -> DataFrame:
    """(sent, inicio, fim, tipo, texto) of a table (sent, posicao, token, label); fim is exclusive.

    strict: only B-X opens, I-X of the same type at the next position extends, others end.
    seqeval: I-X also opens after O, a gap or another type.
    run: a maximal run of labels other than O; only B- splits it; the last type names it.
    typed-run: as run, for the labels of `tipo` alone.
    Labels of unknown form count as O.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    w = Window.partitionBy(sent).orderBy("posicao")
    prefix, kind = F.substring("label", 1, 2), F.substring("label", 3, 100)
    live = prefix.isin("B-", "I-") & (kind == F.lit(tipo) if mode == "typed-run" else F.lit(True))
    t = labels.select(sent, "posicao", "token", F.when(live, F.substring("label", 1, 1)).alias("_p"), F.when(live, kind).alias("_k"))
    t = t.withColumns({"_pp": F.lag("_p").over(w), "_pk": F.lag("_k").over(w), "_near": F.lag("posicao").over(w) == F.col("posicao") - 1})
    follows = F.coalesce(F.col("_near"), F.lit(False)) & F.col("_pp").isNotNull()
    same = follows & (F.col("_pk") == F.col("_k"))
    if mode in ("run", "typed-run"):
        opens = (F.col("_p") == "B") | ~follows
    else:
        opens = (F.col("_p") == "B") | ~same
    t = t.where("_p is not null").withColumn("_o", opens)
    t = t.withColumn("_run", F.sum(F.col("_o").cast("int")).over(w))
    grouped = t.groupBy(sent, "_run").agg(
        F.min("posicao").alias("inicio"),
        (F.max("posicao") + 1).alias("fim"),
        F.min_by("_p", "posicao").alias("_first"),
        F.max_by("_k", "posicao").alias("tipo"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("posicao", "token"))), lambda x: x["token"]), " ").alias("texto"),
    )
    if mode == "strict":
        grouped = grouped.where("_first = 'B'")
    return grouped.select(sent, "inicio", "fim", "tipo", "texto")


def span_match(gold: DataFrame, found: DataFrame, sent: str = "sentenca_id") -> DataFrame:
    """Full outer match of spans on place and type: (sent, inicio, fim, tipo, in_gold, in_found)."""
    keys = [sent, "inicio", "fim", "tipo"]
    g = gold.select(*keys, F.lit(1).alias("g"), F.lit(0).alias("f"))
    f = found.select(*keys, F.lit(0).alias("g"), F.lit(1).alias("f"))
    both = g.unionByName(f).groupBy(*keys).agg(F.max("g").alias("_g"), F.max("f").alias("_f"))
    return both.select(*keys, (F.col("_g") == 1).alias("in_gold"), (F.col("_f") == 1).alias("in_found"))


def numbered(spans: DataFrame, sent: str = "sentenca_id", forward: bool = False) -> DataFrame:
    """Spans with their marker [TIPO_n]: n counts new texts of a type from the end of the sentence (or from its start)."""
    edge = F.min("inicio") if forward else F.max("inicio")
    first = spans.groupBy(sent, "texto").agg(edge.alias("_at"), (F.min_by if forward else F.max_by)("tipo", "inicio").alias("_tipo"))
    order = F.col("_at") if forward else F.col("_at").desc()
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy(sent, "_tipo").orderBy(order)))
    marked = ranked.select(sent, "texto", F.concat(F.lit("["), "_tipo", F.lit("_"), F.col("_n").cast("string"), F.lit("]")).alias("marcador"))
    return spans.join(marked, [sent, "texto"])


def replace_spans(tokens: DataFrame, spans: DataFrame, sent: str = "sentenca_id") -> DataFrame:
    """(sent, texto): the tokens of each sentence with every span (inicio, fim, marcador) replaced by its marker.

    Per sentence without a join of tokens and spans: spans are a small array beside the tokens.
    """
    by = spans.groupBy(sent).agg(F.collect_list(F.struct("inicio", "fim", "marcador")).alias("_spans"))

    def shown(t: Column, i: Column) -> Column:
        hit = F.filter(F.col("_spans"), lambda s: (s["inicio"] <= i) & (i < s["fim"]))
        return F.when(F.coalesce(F.size(hit), F.lit(0)) <= 0, t).when(F.get(hit, F.lit(0))["inicio"] == i, F.get(hit, F.lit(0))["marcador"])

    joined = tokens.select(sent, "tokens").join(by, sent, "left")
    return joined.select(sent, F.array_join(F.filter(F.transform("tokens", shown), lambda x: x.isNotNull()), " ").alias("texto"))


def simple_marker(tipo: Column) -> Column:
    """Marker of an entity type, with or without accents."""
    plain = F.translate(F.upper(tipo), "ÇÃ", "CA")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in P.MARKERS.items() for x in kv]), plain), F.concat(F.lit("["), tipo, F.lit("]")))


def placeholders_to_markers(tokens: Column) -> Column:
    """Tokens with placeholders replaced by the markers of their kind."""
    table = F.create_map(*[F.lit(x) for kv in P.PLACEHOLDERS.items() for x in kv])
    return F.transform(tokens, lambda t: F.coalesce(F.try_element_at(table, t), t))


def context_window(tokens: Column, at: Column, width: int) -> Column:
    """Text of the tokens from width before to width after a position."""
    start = F.greatest(at - F.lit(width), F.lit(0))
    return F.array_join(F.slice(tokens, start + 1, at - start + F.lit(width + 1)), " ")
