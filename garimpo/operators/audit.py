"""Audits of gold labels (sentenca_id, posicao, token, label) and their spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import vocab as V
from garimpo.functions.text import strip_outer_signs
from garimpo.operators.spans import context_window


def _order():
    return Window.partitionBy("sentenca_id").orderBy("posicao")


def forbidden_labels(gold: DataFrame, types: list[str]) -> DataFrame:
    return gold.where(F.substring("label", 3, 100).isin(types)).select("sentenca_id", "posicao", "token", "label")


def orphan_inside(gold: DataFrame) -> DataFrame:
    """I-X whose label before is outside, of another type or missing."""
    prev = F.coalesce(F.lag("label").over(_order()), F.lit("O"))
    return gold.withColumn("anterior", prev).where(F.col("label").startswith("I-") & (F.substring("anterior", 3, 100) != F.substring("label", 3, 100))).select("sentenca_id", "posicao", "token", "label", "anterior")


def type_conflicts(spans: DataFrame) -> DataFrame:
    """Texts annotated with more than one type, with distinct sentences per type."""
    per = spans.groupBy(F.upper(F.trim("texto")).alias("texto"), "tipo").agg(F.countDistinct("sentenca_id").alias("sentencas"))
    return per.withColumn("_t", F.count(F.lit(1)).over(Window.partitionBy("texto"))).where("_t > 1").drop("_t")


def missed_names(gold: DataFrame) -> DataFrame:
    """Title followed by a capitalised word of more than 2 letters, both outside."""
    w = _order()
    t = gold.withColumns({"seguinte": F.lead("token").over(w), "_l": F.lead("label").over(w)})
    title = F.lower(F.translate("token", ".", "")).isin(V.TITLES)
    return t.where(title & (F.col("label") == "O") & (F.col("_l") == "O") & F.col("seguinte").rlike(r"^\p{Lu}\p{L}{2,}$")).select("sentenca_id", "posicao", "token", "seguinte")


def titles_before_names(gold: DataFrame) -> DataFrame:
    """Titles that are no part of the person that follows."""
    t = gold.withColumns({"seguinte": F.lead("token").over(_order()), "_l": F.lead("label").over(_order())})
    return t.where(F.lower(F.translate("token", ".", "")).isin(V.TITLES) & ~F.col("label").endswith("PESSOA") & F.col("_l").endswith("PESSOA")).select("sentenca_id", "posicao", "token", "seguinte")


def all_titles(gold: DataFrame) -> DataFrame:
    """Every title with its label and the next one's."""
    t = gold.withColumns({"seguinte": F.lead("token").over(_order()), "label_seguinte": F.lead("label").over(_order())})
    return t.where(F.lower(F.translate("token", ".", "")).isin(V.TITLES)).select("sentenca_id", "posicao", "token", "label", "seguinte", "label_seguinte")


def border_words(spans: DataFrame) -> DataFrame:
    """Spans that begin or end with a stop word."""
    words = F.split("texto", " ")
    first, last = strip_outer_signs(words[0]), strip_outer_signs(F.element_at(words, -1))
    return spans.where(first.isin(V.BORDER_WORDS) | last.isin(V.BORDER_WORDS)).select("sentenca_id", "inicio", "fim", "tipo", "texto")


def kinship_in_names(spans: DataFrame) -> DataFrame:
    words = F.transform(F.split("texto", " "), strip_outer_signs)
    return spans.where((F.col("tipo") == "PESSOA") & F.arrays_overlap(words, F.array(*[F.lit(w) for w in V.KINSHIP]))).select("sentenca_id", "inicio", "fim", "texto")


def tiny_spans(spans: DataFrame) -> DataFrame:
    """One-token spans of at most 2 characters or without a letter."""
    return spans.where((F.col("fim") - F.col("inicio") == 1) & ((F.length("texto") <= 2) | ~F.col("texto").rlike(r"\p{L}"))).select("sentenca_id", "inicio", "tipo", "texto")


def longest_spans(spans: DataFrame, n: int = 3) -> DataFrame:
    """The n longest spans of each type; the rank filter becomes a window group limit, so each task passes on at most n rows a type."""
    size = (F.col("fim") - F.col("inicio")).alias("tamanho")
    w = Window.partitionBy("tipo").orderBy(F.desc("tamanho"), "sentenca_id", "inicio")
    return spans.select("tipo", size, "sentenca_id", "inicio", "texto").withColumn("lugar", F.row_number().over(w)).where(F.col("lugar") <= n)


def span_lengths(spans: DataFrame, tipo: str) -> DataFrame:
    return spans.where(F.col("tipo") == tipo).groupBy((F.col("fim") - F.col("inicio")).alias("tamanho")).agg(F.count(F.lit(1)).alias("spans"))


def audit_counters(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """(medida, valor): tokens per label, spans and mean length per type, annotated sentences, tokens."""
    labels = gold.groupBy(F.concat(F.lit("tokens:"), "label").alias("medida")).agg(F.count(F.lit(1)).cast("double").alias("valor"))
    n = spans.groupBy(F.concat(F.lit("spans:"), "tipo").alias("medida")).agg(F.count(F.lit(1)).cast("double").alias("valor"))
    mean = spans.groupBy(F.concat(F.lit("tamanho:"), "tipo").alias("medida")).agg(F.round(F.avg(F.col("fim") - F.col("inicio")), 2).alias("valor"))
    total = gold.agg(F.countDistinct("sentenca_id").cast("double").alias("sentencas"), F.count(F.lit(1)).cast("double").alias("tokens")).unpivot([], ["sentencas", "tokens"], "medida", "valor")
    return labels.unionByName(n).unionByName(mean).unionByName(total)


def acronym_labels(gold: DataFrame, acronyms: list[str]) -> DataFrame:
    """(sigla, label, tokens) of the tokens that are one of the acronyms."""
    form = strip_outer_signs(F.col("token"))
    return gold.where(form.isin(acronyms)).groupBy(form.alias("sigla"), "label").agg(F.count(F.lit(1)).alias("tokens"))


def acronyms_outside(gold: DataFrame, sentences: DataFrame, acronyms: list[str], width: int = 5) -> DataFrame:
    """Acronyms labelled outside, with their context."""
    hit = gold.where(strip_outer_signs(F.col("token")).isin(acronyms) & (F.col("label") == "O")).select("sentenca_id", "posicao", "token")
    return hit.join(sentences.select("sentenca_id", "tokens"), "sentenca_id").select("sentenca_id", "posicao", "token", context_window(F.col("tokens"), F.col("posicao"), width).alias("contexto"))


def isolated_towns(spans: DataFrame, sentences: DataFrame) -> DataFrame:
    """Addresses of at most 3 tokens after a town word in a sentence without a street mark."""
    s = spans.where((F.col("tipo") == "ENDERECO") & (F.col("fim") - F.col("inicio") <= 3)).join(sentences.select("sentenca_id", "tokens"), "sentenca_id")
    before = F.slice("tokens", F.greatest(F.col("inicio") - 3, F.lit(0)) + 1, F.least(F.col("inicio"), F.lit(3)))
    trigger = F.exists(before, lambda t: strip_outer_signs(t).isin(V.TOWN_TRIGGERS))
    street = F.exists("tokens", lambda t: F.upper(t).isin(V.STREET_MARKS))
    return s.where(trigger & ~street).select("sentenca_id", "inicio", "fim", "texto")


def addresses(spans: DataFrame) -> DataFrame:
    """All addresses, those without a street mark first, short ones first."""
    marked = F.exists(F.split("texto", " "), lambda t: F.upper(t).isin(V.STREET_MARKS))
    return spans.where("tipo = 'ENDERECO'").select("sentenca_id", "inicio", "texto", marked.alias("marcado"), F.length("texto").alias("tamanho")).orderBy("marcado", "tamanho", "sentenca_id", "inicio")


#: Two words that a full stop holds together, the second with a capital.
GLUED_PARTS = r"^(\p{L}{2,})\.(\p{Lu}\p{Ll}+)$"


def glued_tokens(gold: DataFrame) -> DataFrame:
    """Labelled tokens of the form Word.Word with both halves."""
    t = gold.where((F.col("label") != "O") & F.col("token").rlike(GLUED_PARTS))
    return t.select("sentenca_id", "posicao", "token", "label", F.substring_index("token", ".", 1).alias("prefixo"), F.substring_index("token", ".", -1).alias("sufixo"))


def long_spans(spans: DataFrame, tipo: str, least: int = 5, most: int = 20) -> DataFrame:
    """The first `most` spans of a type with at least `least` tokens, for reading."""
    long = spans.where((F.col("tipo") == tipo) & (F.col("fim") - F.col("inicio") >= least))
    return long.select("sentenca_id", "inicio", (F.col("fim") - F.col("inicio")).alias("tamanho"), "texto").orderBy("sentenca_id", "inicio").limit(most)


def marked_context(gold: DataFrame, places: DataFrame, width: int = 4) -> DataFrame:
    """Text around given places (sentenca_id, posicao) with [token/label] where a label is not outside."""
    shown = F.when(F.col("label") == "O", F.col("token")).otherwise(F.concat(F.lit("["), "token", F.lit("/"), "label", F.lit("]")))
    near = places.select("sentenca_id", F.col("posicao").alias("_at")).join(gold.select("sentenca_id", "posicao", shown.alias("_t")), "sentenca_id").where(F.abs(F.col("posicao") - F.col("_at")) <= width)
    return near.groupBy("sentenca_id", F.col("_at").alias("posicao")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("posicao", "_t"))), lambda x: x["_t"]), " ").alias("contexto"))


def labels_of_entities(gold: DataFrame) -> DataFrame:
    """Tokens per entity type (not spans)."""
    return gold.where("label <> 'O'").groupBy(F.substring("label", 3, 100).alias("tipo")).agg(F.count(F.lit(1)).alias("tokens"))
