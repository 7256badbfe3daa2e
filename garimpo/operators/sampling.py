"""Samples and splits of sentences: quotas per detected type, equal allocation, reserved splits, learning curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import patterns as P
from garimpo.functions.text import detected_types
from garimpo.ranking import permuted_rank
from garimpo.shared import materialize


def shuffled(key: Column, seed: int = 42) -> Column:
    """A fixed random order that any engine reproduces: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))


def _hash_order(key: Column, seed: int) -> Column:
    """The first 15 hex digits of shuffled() as a number centred on 0, for range-bucketed ranks."""
    return (F.conv(F.substring(shuffled(key, seed), 1, 15), 16, 10).cast("bigint") - F.lit(1 << 59)) * F.lit(16)


def first_of_content(df: DataFrame, content: Column, order: str) -> DataFrame:
    """One row per content, the first by order; a partial aggregate instead of a window over each content."""
    cols = df.columns
    best = df.groupBy(content.alias("_content")).agg(F.min(F.struct(order, *[c for c in cols if c != order])).alias("_r"))
    return best.select(*[F.col(f"_r.{c}").alias(c) for c in cols])


def with_types(sentences: DataFrame) -> DataFrame:
    return sentences.withColumn("tipos", detected_types(F.array_join("tokens", " ")))


def _ranked_types(unique: DataFrame, seed: int) -> DataFrame:
    """(sentenca_id, tipo, rank): rank of each sentence within each of its types in the fixed random order.

    Ranks come from range-bucketed counts, so a type that most sentences have is not one task.
    """
    each = unique.select("sentenca_id", F.explode("tipos").alias("tipo"))
    return permuted_rank(each, ["tipo"], _hash_order(F.col("sentenca_id"), seed), "rank")


def quota_sample(sentences: DataFrame, quotas: dict[str, int] | None = None, total: int | None = None, seed: int = 42) -> DataFrame:
    """(sentenca_id, motivo): per type the first quota sentences in a fixed random order, united, topped up to total.

    Equal texts count once (the smallest sentenca_id). motivo is 'cota' or 'complemento'.
    """
    quotas = quotas or {k: q for k, (_, q) in P.DETECTORS.items()}
    unique = with_types(first_of_content(sentences.select("sentenca_id", "tokens"), F.md5(F.array_join("tokens", " ")), "sentenca_id"))
    limits = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    chosen = _ranked_types(unique, seed).where(F.col("rank") <= F.coalesce(F.try_element_at(limits, F.col("tipo")), F.lit(0))).select("sentenca_id").distinct()
    out = chosen.select("sentenca_id", F.lit("cota").alias("motivo"))
    if total is None:
        return out
    spare = unique.join(chosen, "sentenca_id", "left_anti").select("sentenca_id", F.lit(0).alias("g"))
    ranked = permuted_rank(spare, ["g"], _hash_order(F.col("sentenca_id"), seed), "rank")
    have = chosen.agg(F.count(F.lit(1)).alias("_have"))
    more = ranked.crossJoin(F.broadcast(have)).where(F.col("rank") <= F.lit(total) - F.col("_have"))  # one row
    return out.unionByName(more.select("sentenca_id", F.lit("complemento").alias("motivo")))


def quota_report(sentences: DataFrame, quotas: dict[str, int] | None = None, seed: int = 42) -> DataFrame:
    """Per type: candidates among distinct texts, quota, selected for it, whether reached, whether masks handle it."""
    quotas = quotas or {k: q for k, (_, q) in P.DETECTORS.items()}
    unique = with_types(first_of_content(sentences.select("sentenca_id", "tokens"), F.md5(F.array_join("tokens", " ")), "sentenca_id"))
    n = unique.select(F.explode("tipos").alias("tipo")).groupBy("tipo").agg(F.count(F.lit(1)).alias("_n"))
    wanted = sentences.sparkSession.createDataFrame(list(quotas.items()), "tipo string, cota bigint")
    c = F.coalesce("_n", F.lit(0))
    return wanted.join(n, "tipo", "left").select(
        "tipo", c.alias("candidatos"), "cota", F.least(c, F.col("cota")).alias("selecionadas"), (c >= F.col("cota")).alias("cota_atingida"), F.col("tipo").isin(P.REGEX_TYPES).alias("regex_tratado")
    )


def selected_distribution(sentences: DataFrame, selected: DataFrame) -> DataFrame:
    """Per type the selected sentences whose text its detector matches."""
    some = with_types(sentences.select("sentenca_id", "tokens").join(selected.select("sentenca_id"), "sentenca_id", "left_semi"))
    return some.select(F.explode("tipos").alias("tipo")).groupBy("tipo").agg(F.count(F.lit(1)).alias("sentencas"))


def equal_allocation(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42, remainder: bool = False) -> DataFrame:
    """n // k rows of each of the k strata in a fixed random order, all of a smaller one; with remainder the first n % k strata give one more."""
    strata = df.select(stratum).distinct().where(F.col(stratum).isNotNull())
    k = strata.agg(F.count(F.lit(1)).alias("_k"))
    order = strata.withColumn("_i", F.row_number().over(Window.orderBy(stratum)))  # one row per stratum
    ranked = permuted_rank(df.where(F.col(stratum).isNotNull()), [stratum], _hash_order(F.col(key), seed), "_rank")
    joined = ranked.join(order, stratum).crossJoin(F.broadcast(k))  # one row
    extra = F.when(F.col("_i") <= F.lit(n) % F.greatest(F.col("_k"), F.lit(1)), 1).otherwise(0) if remainder else F.lit(0)
    return joined.where(F.col("_rank") <= F.floor(F.lit(n) / F.col("_k")) + extra).drop("_rank", "_i", "_k")


def session_order(df: DataFrame, session: str, key: str, seed: int = 42) -> DataFrame:
    """df with ordem: the place of each row in the random order of its session, from 0."""
    return permuted_rank(df, [session], _hash_order(F.col(key), seed), "_r").withColumn("ordem", (F.col("_r") - 1).cast("int")).drop("_r")


def sample_per_type(df: DataFrame, kind: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each kind in a fixed random order."""
    return permuted_rank(df.where(F.col(kind).isNotNull()), [kind], _hash_order(F.col(key), seed), "_r").where(F.col("_r") <= n).drop("_r")


def learning_curve(df: DataFrame, key: str, sizes: list[int], seed: int = 42) -> DataFrame:
    """(tamanho, key): nested prefixes of one fixed random order."""
    ranked = permuted_rank(df.select(key, F.lit(0).alias("_g")), ["_g"], _hash_order(F.col(key), seed), "_r")
    return ranked.select(key, "_r", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("tamanho")).where("_r <= tamanho").select("tamanho", key)


def reserved_split(labelled: DataFrame, types: list[str] | None = None, least: int = 1, share: float = 0.15, seed: int = 42) -> DataFrame:
    """(sentenca_id, particao) of labelled (sentenca_id, tipos array): dev and test reserve `least` sentences of each type.

    In the fixed random order, type by type, the first free sentences that hold the type go
    to dev, the next to test (at most types x least rows each, decided on the driver);
    of the free rest dev and test get share of it less what they reserved, train all else.
    labelled is computed once and written to the shared folder.
    """
    types = types or P.ENTITY_TYPES
    known = materialize(labelled.select("sentenca_id", "tipos"), "split")
    need = 2 * least * len(types)  # enough candidates of each type even if all others took theirs
    each = known.select("sentenca_id", F.explode(F.array_intersect("tipos", F.array(*[F.lit(t) for t in types]))).alias("tipo"))
    order = Window.partitionBy("tipo").orderBy(shuffled(F.col("sentenca_id"), seed), "sentenca_id")  # Spark keeps `need` rows of each type before it exchanges them
    pools: dict[str, list] = {t: [] for t in types}
    for r in each.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= need).orderBy("tipo", "_n").collect():
        pools[r["tipo"]].append(r["sentenca_id"])
    taken: dict[int, str] = {}
    for t in types:
        free = [i for i in pools[t] if i not in taken]
        for k, i in enumerate(free[: 2 * least]):
            taken[i] = "dev" if k < least else "teste"
    spark = labelled.sparkSession
    reserved = spark.createDataFrame(list(taken.items()) or [(None, None)], "sentenca_id bigint, particao string").where("sentenca_id is not null")
    free = known.join(reserved, "sentenca_id", "left_anti").select("sentenca_id", F.lit(0).alias("_g"))
    ranked = permuted_rank(free, ["_g"], _hash_order(F.col("sentenca_id"), seed), "_r")
    n = free.agg(F.count(F.lit(1)).alias("_n"))
    held = {p: sum(v == p for v in taken.values()) for p in ("dev", "teste")}
    d, t = (F.greatest(F.lit(0), F.round(share * F.col("_n")) - held[p]) for p in ("dev", "teste"))
    rest = ranked.crossJoin(F.broadcast(n)).select("sentenca_id", F.when(F.col("_r") <= d, "dev").when(F.col("_r") <= d + t, "teste").otherwise("treino").alias("particao"))  # one row
    return reserved.unionByName(rest)


def split_check(labelled: DataFrame, split: DataFrame) -> DataFrame:
    """Per type: sentences in treino, dev, teste, and whether a split lacks what another has."""
    each = labelled.select("sentenca_id", F.explode("tipos").alias("tipo")).join(split, "sentenca_id")
    wide = each.groupBy("tipo").pivot("particao", ["treino", "dev", "teste"]).agg(F.count(F.lit(1))).fillna(0, ["treino", "dev", "teste"])
    return wide.withColumn("ok", (F.col("treino") > 0) & (F.col("dev") > 0) & (F.col("teste") > 0))


def split_token_check(gold: DataFrame, split: DataFrame) -> DataFrame:
    """Per type: entity tokens of gold (sentenca_id, label) in treino, dev and teste; ok unless train has the type and dev or test lacks it."""
    each = gold.where("label <> 'O'").select("sentenca_id", F.substring("label", 3, 100).alias("tipo")).join(split, "sentenca_id").where(F.col("particao").isin("treino", "dev", "teste"))
    wide = each.groupBy("tipo").pivot("particao", ["treino", "dev", "teste"]).agg(F.count(F.lit(1))).fillna(0, ["treino", "dev", "teste"])
    return wide.withColumn("ok", (F.col("treino") == 0) | ((F.col("dev") > 0) & (F.col("teste") > 0)))
