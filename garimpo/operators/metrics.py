"""Quality, privacy and utility measures from spans and token labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from garimpo.operators.spans import bio_spans, span_match


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def entity_scores(gold: DataFrame, found: DataFrame, by_type: bool = False) -> DataFrame:
    """Micro precision, recall and F1 over exact spans (4 places), in all or per type."""
    m = span_match(gold, found)
    g = m.groupBy("tipo") if by_type else m.groupBy()
    counts = g.agg(F.count_if(F.expr("in_gold and in_found")).alias("tp"), F.count_if(F.expr("in_found and not in_gold")).alias("fp"), F.count_if(F.expr("in_gold and not in_found")).alias("fn"))
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    lead = ["tipo"] if by_type else []
    return counts.select(*lead, F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(_f1(p, r), 4).alias("f1"), (F.col("tp") + F.col("fn")).alias("support"))


def privacy_scores(gold: DataFrame, found: DataFrame, types: list[str]) -> DataFrame:
    """Coverage, precision and F1 of anonymisation over the contextual types; F1 from the rounded values."""
    m = span_match(gold.where(F.col("tipo").isin(types)), found.where(F.col("tipo").isin(types)))
    counts = m.agg(F.count_if(F.expr("in_gold and in_found")).alias("tp"), F.count_if(F.expr("in_found and not in_gold")).alias("fp"), F.count_if(F.expr("in_gold and not in_found")).alias("fn"))
    rounded = counts.select("tp", "fp", "fn", F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fn")), 4).alias("coverage"), F.round(_ratio(F.col("tp"), F.col("tp") + F.col("fp")), 4).alias("precision_anon"))
    return rounded.withColumn("f1_anon", F.round(_f1(F.col("precision_anon"), F.col("coverage")), 4))


def token_scores(labels: DataFrame) -> DataFrame:
    """Macro and weighted F1 over all labels of (a1 = truth, a2 = prediction), outside included."""
    n = labels.groupBy("a1", "a2").agg(F.count(F.lit(1)).alias("n"))
    per = (
        n.select(F.explode(F.array_distinct(F.array("a1", "a2"))).alias("label"), "a1", "a2", "n")
        .groupBy("label")
        .agg(
            F.sum(F.when((F.col("a1") == F.col("label")) & (F.col("a2") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
            F.sum(F.when(F.col("a1") == F.col("label"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(F.col("a2") == F.col("label"), F.col("n")).otherwise(0)).alias("pred"),
        )
    )
    f1 = _ratio(2.0 * F.col("tp"), F.col("support") + F.col("pred"))
    return per.agg(F.round(F.avg(f1), 4).alias("f1_macro"), F.round(F.sum(f1 * F.col("support")) / F.sum("support"), 4).alias("f1_weighted"), F.sum("support").alias("tokens"))


def delta_f1(before: DataFrame, after: DataFrame) -> DataFrame:
    """Difference of F1 per type over the union of types (missing = 0) and its mean as '_geral'; null without types."""
    b, a = before.select("tipo", F.col("f1").alias("_b")), after.select("tipo", F.col("f1").alias("_a"))
    d = b.join(a, "tipo", "full").select("tipo", F.round(F.coalesce("_a", F.lit(0.0)) - F.coalesce("_b", F.lit(0.0)), 4).alias("delta"))
    return d.unionByName(d.agg(F.lit("_geral").alias("tipo"), F.round(F.avg("delta"), 4).alias("delta")).select("tipo", "delta"))


def micro_from_report(per_type: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Coverage, precision and F1 rebuilt from per-type precision, recall and support."""
    t = per_type.where(F.col("tipo").isin(types)) if types else per_type
    tp = F.col("recall") * F.col("support")
    fp = F.when(F.col("precision") > 0, tp * (1 / F.col("precision") - 1)).otherwise(0.0)
    s = t.agg(F.sum(tp).alias("_tp"), F.sum(F.col("support") - tp).alias("_fn"), F.sum(fp).alias("_fp"))
    r, p = _ratio(F.col("_tp"), F.col("_tp") + F.col("_fn")), _ratio(F.col("_tp"), F.col("_tp") + F.col("_fp"))
    return s.select(F.round(r, 4).alias("coverage"), F.round(p, 4).alias("precision"), F.round(_f1(p, r), 4).alias("f1"))


def parse_report(lines: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of the rows of a text report (value); other lines are ignored."""
    parts = F.split(F.trim("value"), r"\s+")
    n = F.size(parts)
    nums = [F.get(parts, n - k).try_cast("double") for k in (4, 3, 2, 1)]
    rows = lines.select(F.array_join(F.slice(parts, 1, F.greatest(n - 4, F.lit(0))), " ").alias("label"), *[x.alias(c) for x, c in zip(nums, ("precision", "recall", "f1", "support"))])
    return rows.where("label <> '' and precision is not null and recall is not null and f1 is not null and support is not null")


@F.pandas_udf(DoubleType())
def indel_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 - indel similarity (insertions and deletions only), 4 places; 0 for two empty texts, null for a null."""

    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        if not x and not y:
            return 0.0
        at: dict[str, int] = {}
        for i, c in enumerate(x):
            at[c] = at.get(c, 0) | 1 << i
        full = (1 << len(x)) - 1
        row = full
        for c in y:
            m = row & at.get(c, 0)
            row = ((row + m) | (row - m)) & full
        common = len(x) - row.bit_count()
        return round((len(x) + len(y) - 2 * common) / (len(x) + len(y)), 4)

    return pd.Series([one(x, y) for x, y in zip(a, b)])


def compared_spans(grid: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """Spans of both label columns of a grid."""
    return tuple(bio_spans(grid.select("sentenca_id", "posicao", "token", F.col(c).alias("label")), mode) for c in ("a1", "a2"))
