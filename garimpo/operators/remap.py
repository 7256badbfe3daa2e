"""Labels carried over when sentences are tokenised anew, and guarded corrections."""

from __future__ import annotations

import difflib
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from garimpo.functions import patterns as P
from garimpo.functions.text import mask_all, split_glued, word_tokens

_PLAN = StructType([StructField("ok", BooleanType()), StructField("motivo", StringType()), StructField("labels", ArrayType(StringType()))])


def reprocess(tokens: Column) -> Column:
    """Tokens of the text that the tokens spell, after glue rules and masks."""
    return word_tokens(mask_all(split_glued(F.array_join(tokens, " "))))


def plan_labels(old: list[str], new: list[str], labels: list[str], precedents: dict[tuple, list[str]] | None = None) -> tuple[bool, str, list[str] | None]:
    """Labels of the new tokens, or the reason why a person must decide.

    Equal stretches keep their labels. A changed stretch is decided by a precedent of the
    same old and new tokens, or becomes outside if all its labels were outside, or if it
    gained a placeholder and held only labels of masked types or only tokens that are
    plainly dates, times or taxpayer numbers.
    """
    out: list[str] = []
    for op, a, b, c, d in difflib.SequenceMatcher(None, old, new, autojunk=False).get_opcodes():
        was = labels[a:b]
        if op == "equal":
            out += was
            continue
        known = (precedents or {}).get((tuple(old[a:b]), tuple(new[c:d])))
        masked = any(p in t for t in new[c:d] for p in P.PLACEHOLDERS)
        kinds = {x[2:] for x in was if x != "O"}
        if known is not None and len(known) == d - c:
            out += known
        elif not kinds or (masked and (kinds <= set(P.REGEX_TYPES) or all(_plain(t) for t in old[a:b]))):
            out += ["O"] * (d - c)
        else:
            return False, f"{op}: {' '.join(old[a:b])} -> {' '.join(new[c:d])}", None
    return True, "", out


def _plain(token: str) -> bool:
    """A token that is a date, a time or a taxpayer number and nothing else."""
    digits = "".join("9" if ch.isdigit() else ch for ch in token)
    return digits in ("9999-99-99", "99:99", "9:99", "99:9", "9:9", "999.999.999-99")


def planner(precedents: dict[tuple, list[str]] | None = None) -> Callable[[Column, Column, Column], Column]:
    """plan_labels() of columns (old tokens, new tokens, labels)."""

    @F.pandas_udf(_PLAN)
    def plan(old: pd.Series, new: pd.Series, labels: pd.Series) -> pd.DataFrame:
        done = [plan_labels(list(o), list(n), list(x), precedents) if len(o) == len(x) else (False, "rotulos nao cobrem os tokens", None) for o, n, x in zip(old, new, labels)]
        return pd.DataFrame(done, columns=["ok", "motivo", "labels"])

    return plan


def remap_plan(labelled: DataFrame) -> DataFrame:
    """(sentenca_id, tokens, novos, ok, motivo, labels_novos) for sentences whose tokens change."""
    anew = labelled.withColumn("novos", reprocess(F.col("tokens"))).where(~F.col("novos").eqNullSafe(F.col("tokens")))
    planned = anew.withColumn("_p", planner()("tokens", "novos", "labels"))
    return planned.select("sentenca_id", "tokens", "novos", F.col("_p.ok").alias("ok"), F.col("_p.motivo").alias("motivo"), F.col("_p.labels").alias("labels_novos"))


@dataclass
class Remapped:
    """Snapshots that replace the tables, and what was done."""

    sentences: DataFrame
    annotations: DataFrame
    counters: DataFrame


def changed_sentences(sentences: DataFrame) -> DataFrame:
    """(sentenca_id, tokens, novos) of the sentences whose tokens change when processed anew."""
    return sentences.where("tokens is not null").select("sentenca_id", "tokens", reprocess(F.col("tokens")).alias("novos")).where(~F.col("novos").eqNullSafe(F.col("tokens")))


def _given(changed: DataFrame, annotations: DataFrame) -> DataFrame:
    """changed with each of its annotators and their labels by position; cobre: they cover exactly the tokens."""
    by = annotations.groupBy("sentenca_id", "anotador_id").agg(F.sort_array(F.collect_list(F.struct("posicao", "label"))).alias("_l"))
    places = F.transform("_l", lambda x: x["posicao"].cast("int"))
    cover = places.eqNullSafe(F.sequence(F.lit(0), F.size("tokens") - 1))
    return changed.join(by, "sentenca_id").withColumn("cobre", F.when(F.size("tokens") > 0, cover).otherwise(F.size("_l") == 0))


def plan_coverage(sentences: DataFrame, annotations: DataFrame) -> DataFrame:
    """(sentenca_id, anotador_id, cobre) of every annotator of a changed sentence: whether the labels cover its tokens, each once and no other."""
    return _given(changed_sentences(sentences), annotations).select("sentenca_id", "anotador_id", "cobre")


def remap_annotations(sentences: DataFrame, annotations: DataFrame, overrides: DataFrame | None = None, precedents: dict[tuple, list[str]] | None = None) -> Remapped:
    """Sentences processed anew with the labels of every annotator carried over.

    annotations: latest rows (sentenca_id, anotador_id, posicao, label). overrides
    (sentenca_id, labels) decide whole sentences for all their annotators if they have a
    label for each new token. A sentence changes only if every one of its annotators has a
    plan: where one fails or labels do not cover the tokens, the sentence and all its
    annotations stay as they are. Both tables come out as whole snapshots, so whoever
    writes them replaces all or nothing. counters: (situacao, sentencas) with situacao
    igual (tokens unchanged), transferida, revisar (a plan failed) or erro (not covered).
    """
    changed = changed_sentences(sentences)
    plans = _given(changed, annotations).withColumn("_old", F.transform("_l", lambda x: x["label"])).withColumn("_p", planner(precedents)("tokens", "novos", "_old"))
    if overrides is not None:
        whole = overrides.select("sentenca_id", F.col("labels").alias("_whole"))
        plans = plans.join(whole, "sentenca_id", "left")
    else:
        plans = plans.withColumn("_whole", F.lit(None).cast("array<string>"))
    fits = F.coalesce(F.size("_whole") == F.size("novos"), F.lit(False))
    plans = plans.select(
        "sentenca_id", "anotador_id", "novos", "cobre", (fits | F.col("_p.ok")).alias("_ok"), F.when(fits, F.col("_whole")).otherwise(F.col("_p.labels")).alias("_new")
    )
    judged = plans.groupBy("sentenca_id").agg(F.bool_and("cobre").alias("_cobre"), F.bool_and("_ok").alias("_ok"))
    state = changed.select("sentenca_id", "novos").join(judged, "sentenca_id", "left")
    state = state.withColumn("situacao", F.when(~F.coalesce("_cobre", F.lit(True)), "erro").when(~F.coalesce("_ok", F.lit(True)), "revisar").otherwise("transferida"))
    done = state.where("situacao = 'transferida'").select("sentenca_id", "novos")
    fresh = plans.drop("novos").join(done, "sentenca_id").select("sentenca_id", "anotador_id", F.posexplode("_new").alias("posicao", "label"))
    kept = annotations.select("sentenca_id", "anotador_id", "posicao", "label").join(done, "sentenca_id", "left_anti")
    others = [c for c in sentences.columns if c not in ("sentenca_id", "tokens")]
    rebuilt = sentences.join(done, "sentenca_id", "left").select("sentenca_id", *others, F.coalesce("novos", "tokens").alias("tokens")).select(*sentences.columns)
    counted = sentences.select("sentenca_id").join(state.select("sentenca_id", "situacao"), "sentenca_id", "left").groupBy(F.coalesce("situacao", F.lit("igual")).alias("situacao"))
    return Remapped(rebuilt, kept.unionByName(fresh), counted.agg(F.count(F.lit(1)).alias("sentencas")))


def review_report(labelled: DataFrame, width: int = 3, precedents: dict[tuple, list[str]] | None = None) -> DataFrame:
    """(sentenca_id, ordem, trecho_antigo, trecho_novo, labels_envolvidos): the changed stretches that a person must decide, with width tokens around."""
    kind = "array<struct<ordem:int,trecho_antigo:array<string>,trecho_novo:array<string>,labels_envolvidos:array<string>>>"

    @F.pandas_udf(kind)
    def stretches(old: pd.Series, new: pd.Series, labels: pd.Series) -> pd.Series:
        out = []
        for o, n, x in zip(old, new, labels):
            o, n, x = list(o), list(n), list(x)
            found = []
            for op, a, b, c, d in difflib.SequenceMatcher(None, o, n, autojunk=False).get_opcodes():
                if op != "equal" and not plan_labels(o[a:b], n[c:d], x[a:b], precedents)[0]:
                    around = lambda t, i, j: t[max(0, i - width) : j + width]
                    found.append({"ordem": len(found), "trecho_antigo": around(o, a, b), "trecho_novo": around(n, c, d), "labels_envolvidos": sorted({v for v in x[a:b] if v != "O"})})
            out.append(found)
        return pd.Series(out)

    anew = labelled.withColumn("novos", reprocess(F.col("tokens"))).where(~F.col("novos").eqNullSafe(F.col("tokens")) & (F.size("tokens") == F.size("labels")))
    return anew.select("sentenca_id", F.explode(stretches("tokens", "novos", "labels")).alias("_s")).select("sentenca_id", "_s.*")


def relabel_continuing(gold: DataFrame, corrections: DataFrame) -> DataFrame:
    """gold with corrections (sentenca_id, posicao, token, label_antigo, tipo_novo) where token and old label are as expected.

    The new label is I- if the token before it is of the new type already, else B-.
    """
    from pyspark.sql import Window

    before = F.lag("label").over(Window.partitionBy("sentenca_id").orderBy("posicao"))
    fix = corrections.select("sentenca_id", "posicao", "token", F.col("label_antigo").alias("label"), F.col("tipo_novo").alias("_k"))
    t = gold.withColumn("_b", before).join(fix, ["sentenca_id", "posicao", "token", "label"], "left")
    goes_on = F.substring(F.coalesce("_b", F.lit("O")), 3, 100) == F.col("_k")
    new = F.when(F.col("_k").isNull(), F.col("label")).otherwise(F.concat(F.when(goes_on, "I-").otherwise("B-"), "_k"))
    return t.select(*[c for c in gold.columns if c != "label"], new.alias("label"))


def length_changes(sentences: DataFrame) -> DataFrame:
    """(delta, sentencas): by how many tokens sentences grow or shrink when processed anew; unchanged ones as null."""
    new = reprocess(F.col("tokens"))
    delta = sentences.select(F.when(~new.eqNullSafe(F.col("tokens")), F.size(new) - F.size("tokens")).alias("delta"))
    return delta.groupBy("delta").agg(F.count(F.lit(1)).alias("sentencas"))


def relabel(gold: DataFrame, corrections: DataFrame) -> DataFrame:
    """gold with corrections (sentenca_id, token, label_antigo, label_novo) where both token and old label are as expected."""
    fix = corrections.select("sentenca_id", "token", F.col("label_antigo").alias("label"), F.col("label_novo").alias("_new"))
    return gold.join(fix, ["sentenca_id", "token", "label"], "left").select(*[c for c in gold.columns if c != "label"], F.coalesce("_new", "label").alias("label"))


def not_applied(gold: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrections that match no token."""
    return corrections.join(gold.select("sentenca_id", "token", F.col("label").alias("label_antigo")), ["sentenca_id", "token", "label_antigo"], "left_anti")


def erase_spans(gold: DataFrame, spans: DataFrame) -> DataFrame:
    """gold with the labels of given spans (sentenca_id, inicio, fim) set to outside."""
    each = spans.select("sentenca_id", F.explode(F.sequence("inicio", F.col("fim") - 1)).alias("posicao"), F.lit("O").alias("_o")).distinct()
    return gold.join(each, ["sentenca_id", "posicao"], "left").select(*[c for c in gold.columns if c != "label"], F.coalesce("_o", "label").alias("label"))


def split_tokens(gold: DataFrame, splits: DataFrame) -> DataFrame:
    """gold with tokens cut in two: splits (sentenca_id, posicao, token, prefixo, sufixo, label1, label2); later positions move up.

    A split whose token is not the expected one is left out.
    """
    s = splits.withColumnsRenamed({"label1": "_l1", "label2": "_l2"})
    t = gold.join(s, ["sentenca_id", "posicao", "token"], "left")
    parts = F.when(F.col("prefixo").isNull(), F.array(F.struct("token", "label"))).otherwise(
        F.array(F.struct(F.col("prefixo").alias("token"), F.col("_l1").alias("label")), F.struct(F.col("sufixo").alias("token"), F.col("_l2").alias("label")))
    )
    whole = t.groupBy("sentenca_id").agg(F.array_sort(F.collect_list(F.struct("posicao", parts.alias("parts")))).alias("_a"))
    flat = whole.select("sentenca_id", F.posexplode(F.flatten(F.transform("_a", lambda x: x["parts"]))).alias("posicao", "_t"))
    return flat.select("sentenca_id", "posicao", F.col("_t.token").alias("token"), F.col("_t.label").alias("label"))
