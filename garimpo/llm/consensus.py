"""Consensus labels of several annotators, their agreement and their reliability.

Method: spectral reliability. The agreement of each pair of annotators, less what their
label frequencies give by chance and shrunk where they share few items, is a sparse
matrix whose leading eigenvector, found by power iteration with sparse joins, weights the
votes. The weighted consensus then calibrates what each label of each annotator is worth,
so that an annotator who errs in a regular way still carries information.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions.fold import fold_code
from garimpo.shared import materialize

BACKGROUND = "O"
# The entity types; with B- and I- and the background they make the 15 labels.
TYPES = ["PESSOA", "DATA", "ENDERECO", "CONTATO", "DOCUMENTO", "HORA", "INSTITUICAO"]
LABELS = [BACKGROUND, *[f"{p}-{t}" for t in TYPES for p in ("B", "I")]]

#: Items by which a pair's agreement is shrunk towards chance.
SHRINK = 20
#: Power iteration: steps between two lineage cuts, the most such blocks, and the change of the greatest entry's share at which it has settled.
STEPS, BLOCKS, SETTLED = 4, 16, 1e-9
#: Sparse matrices up to so many entries are kept in one partition, so their joins need no exchange.
ONE_TASK = 200_000


def label_code(c: Column) -> Column:
    """Place of a label among LABELS from 1, told without case, accents and outer blanks; 0 where it is none of them, null for null.

    Labels spelled as in LABELS, nearly all, are found without folding.
    """
    domain = F.array(*[F.lit(x) for x in LABELS])
    return F.when(F.array_position(domain, c) > 0, F.array_position(domain, c)).otherwise(F.array_position(domain, F.upper(fold_code(c)))).cast("int")


def label_of(code: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in LABELS]), code)


def current_votes(annotations: DataFrame, sentences: DataFrame) -> DataFrame:
    """(sentenca_id, posicao, anotador_id, code): of each key the row with the latest atualizado_em; code is label_code.

    Ties of atualizado_em go to a row with a label, then to the later label of LABELS, so
    that re-sent rows count once; a null time is earliest. The latest row is chosen first:
    if its label is null or none of LABELS, or its position lies outside the tokens of its
    sentence, the key has no vote. Rows with a null key or without sentence do not count.
    Time and label are packed into one number whose maximum is a hash aggregate, so
    superseded rows go before the shuffle and nothing is sorted.
    """
    code = F.coalesce(label_code(F.col("label")) + 1, F.lit(0))
    time = F.coalesce(F.unix_micros("atualizado_em"), F.lit(-(1 << 57)))
    latest = (
        annotations.where("sentenca_id is not null and anotador_id is not null and posicao >= 0")
        .select("sentenca_id", "anotador_id", "posicao", (time * 32 + code).alias("_packed"))
        .groupBy("sentenca_id", "anotador_id", "posicao")
        .agg(F.max("_packed").alias("_last"))
        .select("sentenca_id", "posicao", "anotador_id", (F.pmod("_last", F.lit(32)).cast("int") - 1).alias("code"))
        .where("code >= 1")
    )
    lengths = sentences.select(F.col("sentenca_id").alias("_sid"), F.size("tokens").alias("_len")).where("_len > 0")
    return latest.join(lengths, (F.col("sentenca_id") == F.col("_sid")) & (F.col("posicao") < F.col("_len"))).select(
        "sentenca_id", "posicao", "anotador_id", "code"
    )


def vote_items(votes: DataFrame) -> DataFrame:
    """One row per voted (sentenca_id, posicao): its sorted votes, whether they differ and whether all say background (fundo).

    The votes of one token are as many as its annotators, a handful by design.
    """
    grouped = votes.groupBy("sentenca_id", "posicao").agg(
        F.sort_array(F.collect_list(F.struct("anotador_id", "code"))).alias("votes"), F.min("code").alias("_lo"), F.max("code").alias("_hi")
    )
    background = (F.col("_lo") == 1) & (F.col("_hi") == 1)  # the background is the first of LABELS
    return grouped.select("sentenca_id", "posicao", "votes", (F.col("_lo") != F.col("_hi")).alias("differ"), background.alias("fundo"))


def agreement_pairs(items: DataFrame) -> DataFrame:
    """(a, b, itens, iguais, acaso, acordo) for annotators a != b with common items, both orders.

    Items are first counted by their signature (the sorted votes), so that pairs are
    formed once per distinct signature, not once per item; the many items on which all say
    background have one signature per group of annotators. acordo is the agreement less
    chance, (observed - chance) / (1 - chance), times itens / (itens + SHRINK).
    """
    signatures = items.groupBy("votes").agg(F.count(F.lit(1)).alias("n"))
    sides = signatures.select("n", "votes", F.explode("votes").alias("x")).select("n", "x", F.explode("votes").alias("y"))
    pairs = (
        sides.where("x.anotador_id <> y.anotador_id")
        .groupBy(F.col("x.anotador_id").alias("a"), F.col("y.anotador_id").alias("b"))
        .agg(F.sum("n").alias("itens"), F.sum(F.when(F.col("x.code") == F.col("y.code"), F.col("n")).otherwise(0)).alias("iguais"))
    )
    share = (
        signatures.select("n", F.explode("votes").alias("x"))
        .groupBy(F.col("x.anotador_id").alias("_who"), F.col("x.code").alias("_code"))
        .agg(F.sum("n").alias("_k"))
        .withColumn("_p", F.col("_k") / F.sum("_k").over(Window.partitionBy("_who")))
        .groupBy("_who")
        .agg(F.map_from_entries(F.collect_list(F.struct("_code", "_p"))).alias("_dist"))  # at most 15 labels
    )
    joined = pairs.join(share.select(F.col("_who").alias("a"), F.col("_dist").alias("_da")), "a").join(
        share.select(F.col("_who").alias("b"), F.col("_dist").alias("_db")), "b"
    )
    chance = F.aggregate(
        F.map_keys("_da"), F.lit(0.0), lambda acc, k: acc + F.col("_da")[k] * F.coalesce(F.try_element_at("_db", k), F.lit(0.0))
    )
    measured = joined.withColumn("acaso", chance)
    centred = (F.col("iguais") / F.col("itens") - F.col("acaso")) / F.greatest(F.lit(1e-6), 1 - F.col("acaso"))
    return measured.select("a", "b", "itens", "iguais", "acaso", (centred * F.col("itens") / (F.col("itens") + F.lit(SHRINK))).alias("acordo"))


def reliabilities(pairs: DataFrame) -> DataFrame:
    """(anotador_id, peso): leading eigenvector of the agreement matrix, scaled to a greatest entry of 1.

    Power iteration from equal weights until the vector has settled: each step joins the
    sparse matrix with the vector and sums by row. An annotator without common items with anyone gets no row.
    """
    matrix = materialize(pairs.select("a", "b", "acordo"), "matrix")
    one = matrix.count() <= ONE_TASK
    if one:
        matrix = matrix.coalesce(1)
    vector = matrix.select(F.col("b").alias("who")).distinct().withColumn("x", F.lit(1.0))
    for block in range(BLOCKS):
        before = vector.select("who", F.col("x").alias("_before"))
        for _ in range(STEPS):
            product = matrix.join(vector, F.col("b") == F.col("who")).groupBy("a").agg(F.sum(F.col("acordo") * F.col("x")).alias("x"))
            vector = product.select(F.col("a").alias("who"), "x")
        top = vector.agg(F.max(F.abs("x")).alias("_top"))
        scaled = vector.crossJoin(F.broadcast(top)).select("who", (F.col("x") / F.greatest(F.col("_top"), F.lit(1e-12))).alias("x"))  # one row
        vector = materialize(scaled.join(before, "who"), f"eigen{block}")
        moved = vector.agg(F.max(F.abs(F.col("x") - F.col("_before")))).first()[0]
        vector = vector.select("who", "x")
        if one:
            vector = vector.coalesce(1)
        if moved is None or moved < SETTLED:
            break
    return vector.select(F.col("who").alias("anotador_id"), F.greatest(F.lit(0.001), "x").alias("peso"))


def _first_consensus(items: DataFrame, weights: DataFrame) -> DataFrame:
    """(sentenca_id, posicao, anotador_id, code, consenso1): the votes and their weighted consensus."""
    votes = items.select("sentenca_id", "posicao", F.explode("votes").alias("v")).select("sentenca_id", "posicao", "v.*")
    weighed = votes.join(weights, "anotador_id", "left").withColumn("peso", F.coalesce("peso", F.lit(0.001)))
    sums = weighed.groupBy("sentenca_id", "posicao", "code").agg(F.sum("peso").alias("_w"))
    best = sums.groupBy("sentenca_id", "posicao").agg(F.max(F.struct("_w", "code"))["code"].alias("consenso1"))
    return votes.join(best, ["sentenca_id", "posicao"])


def calibrated_consensus(items: DataFrame, weights: DataFrame, known: DataFrame) -> DataFrame:
    """(sentenca_id, posicao, code, margem): consensus by calibrated votes.

    The spectral consensus, or the decision where known (sentenca_id, posicao, _right) has
    one, gives for each annotator how often each label was said where another was right (a table of annotators x 15 x 15 counts); the votes are then added
    as logarithms of these shares. margem is the lead over the second label.
    """
    first = _first_consensus(items, weights).join(known, ["sentenca_id", "posicao"], "left")
    votes = materialize(first.select("sentenca_id", "posicao", "anotador_id", "code", F.coalesce("_right", "consenso1").alias("consenso1")), "votes")
    counts = votes.groupBy("anotador_id", "code", "consenso1").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy("anotador_id", "consenso1").agg(F.sum("_n").alias("_t"))
    by_truth = totals.groupBy("anotador_id").agg(F.map_from_entries(F.collect_list(F.struct("consenso1", "_t"))).alias("_totals"))
    by_label = counts.groupBy("anotador_id", "code").agg(F.map_from_entries(F.collect_list(F.struct("consenso1", "_n"))).alias("_counts"))
    table = by_label.join(by_truth, "anotador_id")

    def evidence(truth: int) -> Column:
        said = F.coalesce(F.try_element_at("_counts", F.lit(truth)), F.lit(0)) + F.when(F.col("code") == truth, 0.52).otherwise(0.02)
        of = F.coalesce(F.try_element_at("_totals", F.lit(truth)), F.lit(0)) + F.lit(0.5 + 0.02 * len(LABELS))
        return F.log(said / of)

    codes = range(1, len(LABELS) + 1)
    worth = table.select("anotador_id", "code", *[evidence(k).alias(f"e{k}") for k in codes])
    prior = votes.select("sentenca_id", "posicao", "consenso1").distinct().groupBy("consenso1").agg(F.count(F.lit(1)).alias("_n"))
    prior = prior.agg(F.map_from_entries(F.collect_list(F.struct("consenso1", "_n"))).alias("_prior"), F.sum("_n").alias("_all"))
    summed = votes.join(worth, ["anotador_id", "code"]).groupBy("sentenca_id", "posicao").agg(*[F.sum(f"e{k}").alias(f"e{k}") for k in codes])
    scored = summed.crossJoin(F.broadcast(prior)).select(  # one row
        "sentenca_id",
        "posicao",
        F.sort_array(
            F.array(
                *[
                    F.struct(
                        (F.col(f"e{k}") + F.log((F.coalesce(F.try_element_at("_prior", F.lit(k)), F.lit(0)) + 1) / (F.col("_all") + len(LABELS)))).alias("s"),
                        F.lit(k).alias("code"),
                    )
                    for k in codes
                ]
            ),
            asc=False,
        ).alias("_order"),
    )
    return scored.select("sentenca_id", "posicao", F.col("_order")[0]["code"].alias("code"), (F.col("_order")[0]["s"] - F.col("_order")[1]["s"]).alias("margem"))


def decided(adjudications: DataFrame) -> DataFrame:
    """(sentenca_id, posicao, _right): codes of the non-null labels of the adjudication; of repeated keys the latest."""
    return (
        adjudications.select("sentenca_id", "posicao", label_code(F.col("label")).alias("code"), "criado_em")
        .where("code >= 1")
        .groupBy("sentenca_id", "posicao")
        .agg(F.max(F.struct("criado_em", "code"))["code"].alias("_right"))
    )


def consensus(annotations: DataFrame, sentences: DataFrame, adjudications: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Labels, reliabilities and pair agreements.

    labels: (sentenca_id, posicao, label, origem, differ) for every voted position. origem is
    'adjudicacao' where the adjudication decides, else 'consenso'. Agreements, their chance
    and the reliabilities count all voted positions; the votes are calibrated on those on
    which not all annotators say background, elsewhere the consensus is the background.
    Cases: see current_votes; ties of the calibrated votes go to the later of LABELS; a single
    annotator's votes stand; empty tables give empty results; extra columns are ignored.
    """
    voted = materialize(vote_items(current_votes(annotations, sentences)), "items")
    items = voted.where("not fundo")
    pairs = agreement_pairs(voted)
    weights = reliabilities(pairs)
    right = decided(adjudications)
    found = calibrated_consensus(items, weights, right)
    labels = (
        voted.select("sentenca_id", "posicao", "differ")
        .join(found, ["sentenca_id", "posicao"], "left")
        .join(right, ["sentenca_id", "posicao"], "left")
        .select(
            "sentenca_id",
            "posicao",
            label_of(F.coalesce("_right", "code", F.lit(1))).alias("label"),
            F.when(F.col("_right").isNotNull(), "adjudicacao").otherwise("consenso").alias("origem"),
            "differ",
        )
    )
    return labels, weights, pairs
