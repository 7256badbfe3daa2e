"""Samples whose category shares match a plan.

Method: hierarchical top-down allocation over a category tree. The quota of a plan goes
down from the root; what a category cannot give is asked first of its siblings (same
parent), then of its cousins (other parents), and the leaves are drawn by permuted dense
rank, so that every plan takes a prefix of one fixed random order of its category.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions.fold import fold_code
from garimpo.ranking import permuted_rank

#: Parent of each leaf; categories that are not listed share the parent OTHER.
CLINICAL_TREE = {
    "prescricao": "acompanhamento",
    "evolucao": "acompanhamento",
    "triagem": "acompanhamento",
    "parecer": "conclusao",
    "laudo": "conclusao",
    "interconsulta": "conclusao",
    "alta": "encerramento",
    "obito": "encerramento",
}
OTHER = "outros"

_REPORT = (
    "plano_id int, doc_type string, categoria string, pai string, desejado double, minimo int, existentes bigint, "
    "alocados bigint, de_irmaos bigint, de_primos bigint, tamanho bigint, atendido boolean"
)


def _whole(wants: dict[str, float], total: int) -> dict[str, int]:
    """Largest remainders: whole numbers nearest to wants whose sum is min(total, round(sum(wants)))."""
    down = {k: int(math.floor(v)) for k, v in wants.items()}
    left = min(total, int(round(sum(wants.values())))) - sum(down.values())
    for k in sorted(wants, key=lambda k: (down[k] - wants[k], k))[: max(0, left)]:
        down[k] += 1
    return down


def _spread(need: int, spare: dict[str, int], weight: dict[str, float]) -> dict[str, int]:
    """Hand out need over what is spare in proportion to weight, never above spare."""
    out = dict.fromkeys(spare, 0)
    while need > 0 and (open_ := [k for k in sorted(spare) if spare[k] > out[k]]):
        total = sum(weight.get(k, 0.0) for k in open_)
        share = {k: need * (weight.get(k, 0.0) / total if total > 0 else 1 / len(open_)) for k in open_}
        given = {k: min(spare[k] - out[k], n) for k, n in _whole(share, need).items()}
        if not any(given.values()):
            given = {next(iter(open_)): 1}
        for k, n in given.items():
            out[k] += n
        need -= sum(given.values())
    return out


def allocate(categories: list[tuple[str, str, float, int, int]], n: int) -> dict[str, tuple[int, int, int]]:
    """Quotas of one plan: {category: (rows, of these in place of siblings, of these in place of cousins)}.

    categories: (category, parent, share, minimum, rows that exist). Minima come first,
    then shares of n; a category's unmet quota goes to spare rows of its siblings in
    proportion to their shares, the rest of a parent's to its cousins.
    """
    have = {c: h for c, _, _, _, h in categories}
    parent = {c: p for c, p, _, _, _ in categories}
    share = {c: s for c, _, s, _, _ in categories}
    want = _whole({c: s * n for c, _, s, _, _ in categories}, n)
    want = {c: max(want[c], m) for c, _, _, m, _ in categories}
    own = {c: min(want[c], have[c]) for c in want}
    if sum(own.values()) > n:  # minima beyond the shares: what exceeds n is taken back above the minima
        floor = {c: min(m, have[c]) for c, _, _, m, _ in categories}
        back = _spread(sum(own.values()) - n, {c: own[c] - floor[c] for c in own}, share)
        own = {c: own[c] - back[c] for c in own}
    sibling, cousin, unmet = dict.fromkeys(own, 0), dict.fromkeys(own, 0), 0
    room = max(0, n - sum(own.values()))
    for p in sorted(set(parent.values())):
        kin = [c for c in own if parent[c] == p]
        need = min(room, sum(max(0, want[c] - have[c]) for c in kin))
        got = _spread(need, {c: have[c] - own[c] for c in kin}, share)
        for c, k in got.items():
            sibling[c] += k
        room -= sum(got.values())
        unmet += need - sum(got.values())
    got = _spread(min(room, unmet), {c: have[c] - own[c] - sibling[c] for c in own}, share)
    for c, k in got.items():
        cousin[c] += k
    return {c: (own[c] + sibling[c] + cousin[c], sibling[c], cousin[c]) for c in own}


def plan_report(rows: DataFrame, plans: DataFrame, tree: dict[str, str] | None = None) -> DataFrame:
    """One row per row of plans: what was wanted, what exists and what is allocated.

    rows: any table with doc_type. plans: plano_id, fracao, doc_type, proporcao, minimo.
    doc_types are compared without case, accents and outer blanks. Cases: a null doc_type
    of rows belongs to no category; a null doc_type of a plan has no rows; null proporcao,
    minimo or fracao count as 0; repeated plan rows of one category are each judged, their
    shares and minima add up to one quota; empty rows give plans of size 0 (met only if
    they want nothing); further columns of both tables are ignored. The counts are a
    partial aggregate, so only (plan, category) pairs reach a task together.
    """
    tree = CLINICAL_TREE if tree is None else tree
    counted = rows.select(fold_code(F.col("doc_type")).alias("categoria")).groupBy("categoria").agg(F.count(F.lit(1)).alias("_have"))
    total = counted.agg(F.coalesce(F.sum("_have"), F.lit(0)).alias("_total"))
    wanted = plans.select(
        F.col("plano_id").cast("int").alias("plano_id"),
        "doc_type",
        fold_code(F.col("doc_type")).alias("categoria"),
        F.coalesce(F.col("fracao").cast("double"), F.lit(0.0)).alias("_fracao"),
        F.coalesce(F.col("proporcao").cast("double"), F.lit(0.0)).alias("proporcao"),
        F.coalesce(F.col("minimo").cast("int"), F.lit(0)).alias("minimo"),
    )
    known = wanted.join(counted.where(F.col("categoria").isNotNull()), "categoria", "left").join(F.broadcast(total))  # one row
    sized = known.withColumn("_n", F.floor(F.col("_fracao") * F.col("_total")).cast("bigint")).fillna(0, ["_have"])

    def one_plan(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_n"].max())
        key = pdf["categoria"].where(pdf["categoria"].notna(), "")
        by = pdf.assign(k=key).groupby("k", sort=True).agg(s=("proporcao", "sum"), m=("minimo", "sum"), h=("_have", "max"))
        got = allocate([(k, tree.get(k, OTHER), float(r.s), int(r.m), int(r.h)) for k, r in by.iterrows()], n)
        wish = pdf["proporcao"] * pdf["_n"]
        return pd.DataFrame(
            {
                "plano_id": pdf["plano_id"],
                "doc_type": pdf["doc_type"],
                "categoria": pdf["categoria"],
                "pai": [tree.get(k, OTHER) for k in key],
                "desejado": wish,
                "minimo": pdf["minimo"],
                "existentes": pdf["_have"],
                "alocados": [got[k][0] for k in key],
                "de_irmaos": [got[k][1] for k in key],
                "de_primos": [got[k][2] for k in key],
                "tamanho": pdf["_n"],
                "atendido": ~((pdf["_have"] < wish) | (pdf["_have"] < pdf["minimo"])),
            }
        )

    return sized.groupBy("plano_id").applyInPandas(one_plan, _REPORT)


def sample_by_plan(rows: DataFrame, plans: DataFrame, key: str, seed: int = 42, tree: dict[str, str] | None = None) -> DataFrame:
    """The drawn rows: plano_id, the key and the category, one row per plan and drawn row.

    The leaves are drawn by permuted dense rank (ranking.permuted_rank), so a category
    that holds most rows is ranked in many tasks. Of the plans only the quotas are
    joined, one small row per plan and category. Repeated rows of one key are rows of
    their own. Cases as in plan_report; a null key is ranked like any other.
    """
    quota = (
        plan_report(rows, plans, tree)
        .where(F.col("categoria").isNotNull() & (F.col("alocados") > 0))
        .groupBy("plano_id", "categoria")
        .agg(F.max("alocados").alias("_quota"))
        .groupBy("categoria")
        .agg(F.collect_list(F.struct("plano_id", "_quota")).alias("_quotas"))
    )
    leaves = rows.select(F.col(key).alias("_key"), fold_code(F.col("doc_type")).alias("categoria")).where(F.col("categoria").isNotNull())
    ranked = permuted_rank(leaves, ["categoria"], F.xxhash64(F.lit(seed), "_key"), "_rank")
    drawn = ranked.join(quota, "categoria").select("_key", "categoria", F.explode(F.filter("_quotas", lambda q: q["_quota"] >= F.col("_rank"))).alias("_q"))
    return drawn.select(F.col("_q.plano_id").alias("plano_id"), F.col("_key").alias(key), "categoria")
