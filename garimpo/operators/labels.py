"""Annotations: latest rows, label grids, agreement, disagreement, adjudication, queues and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from garimpo.functions import patterns as P
from garimpo.functions.fold import strip_accents

OUTSIDE = "O"
#: The closed set of labels in alphabetical order.
LABELS = sorted([OUTSIDE, *[f"{p}-{t}" for t in P.ENTITY_TYPES for p in ("B", "I")]])
KAPPA_GOAL = 0.80


def canonical_label(c: Column) -> Column:
    """Upper case without accents and outer blanks."""
    return F.upper(strip_accents(F.trim(c)))


def latest_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert view of an append table: of each key the row that is last by order (nulls first); a partial aggregate, no window."""
    rest = [c for c in df.columns if c not in keys]
    rank = F.struct(*order, *[c for c in rest if c not in order])
    return df.groupBy(*keys).agg(F.max(rank).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _packed(annotations: DataFrame) -> DataFrame:
    """(sentenca_id, anotador_id, posicao, _p): time and label of each annotation in one number, label null or unknown as 0."""
    names = F.array(*[F.lit(x) for x in LABELS])
    plain = F.array_position(names, F.col("label"))  # nearly all are spelled so and need no folding
    code = F.coalesce(F.when(plain > 0, plain).otherwise(F.array_position(names, canonical_label(F.col("label")))), F.lit(0))
    packed = F.coalesce(F.unix_micros("atualizado_em"), F.lit(-(1 << 57))) * 32 + code
    return annotations.select("sentenca_id", "anotador_id", "posicao", packed.alias("_p"))


def _latest(packed: DataFrame, in_order: bool = False) -> DataFrame:
    """in_order: by a sort that can spill and one row at a time (as Spark takes the maximum of a struct), not by hash maps of all keys of a task."""
    names = F.array(*[F.lit(x) for x in LABELS])
    top = F.max(F.struct("_p"))["_p"] if in_order else F.max("_p")
    last = packed.groupBy("sentenca_id", "anotador_id", "posicao").agg(top.alias("_p"))
    coded = last.select("sentenca_id", "anotador_id", "posicao", F.pmod("_p", F.lit(32)).cast("int").alias("_c")).where("_c > 0")
    return coded.select("sentenca_id", "anotador_id", "posicao", F.element_at(names, F.col("_c")).alias("label"))


def latest_annotations(annotations: DataFrame) -> DataFrame:
    """One row per (sentenca_id, anotador_id, posicao) with its canonical label.

    The row with the latest atualizado_em counts (null is earliest, ties go to the later
    label of LABELS); keys whose last label is null or none of LABELS are left out. Time and
    label are packed into one number, so the maximum is a hash aggregate with a map side.
    """
    return _latest(_packed(annotations))


def token_grid(sentences: DataFrame, annotations: DataFrame) -> DataFrame:
    """Every token of every annotated sentence with the labels of its first two annotators by id; missing labels are outside.

    The labels of a sentence (its tokens times its annotators) are gathered once and laid
    beside its tokens, so annotations are read once and joined by sentence, not by token.
    """
    given = latest_annotations(annotations).groupBy("sentenca_id").agg(F.collect_list(F.struct("anotador_id", "posicao", "label")).alias("_v"))
    who = F.array_sort(F.array_distinct(F.transform("_v", lambda x: x["anotador_id"])))
    named = given.withColumn("_w", who)

    def labels_of(k: int) -> Column:
        mine = F.filter("_v", lambda x: x["anotador_id"] == F.get(F.col("_w"), F.lit(k)))
        return F.map_from_entries(F.transform(mine, lambda x: F.struct(x["posicao"], x["label"])))

    maps = named.select(F.col("sentenca_id").alias("_s"), labels_of(0).alias("_m1"), labels_of(1).alias("_m2"))
    joined = sentences.select("sentenca_id", "sessao_id", "tokens").join(maps, F.col("sentenca_id") == F.col("_s"))

    def cell(t: Column, i: Column) -> Column:
        a1, a2 = (F.coalesce(F.try_element_at(m, i), F.lit(OUTSIDE)) for m in ("_m1", "_m2"))
        return F.struct(i.alias("posicao"), t.alias("token"), a1.alias("a1"), a2.alias("a2"))

    cells = joined.select("sentenca_id", "sessao_id", F.explode(F.transform("tokens", cell)).alias("_c"))
    return cells.select("sentenca_id", "sessao_id", "_c.posicao", "_c.token", "_c.a1", "_c.a2")


def kappa(grid: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cohen's kappa of a1 and a2 from one confusion count: tokens, concordancias, po, pe, kappa, meta_atingida.

    kappa is 1 if chance alone explains everything, null without tokens; the goal is
    judged before rounding to 4 places. The confusion matrix of a group has at most as
    many cells as pairs of labels and is gathered into one row.
    """
    by = by or []
    counts = grid.groupBy(*by, "a1", "a2").agg(F.count(F.lit(1)).cast("double").alias("n"))
    cells = counts.groupBy(*by).agg(F.collect_list(F.struct("a1", "a2", "n")).alias("_m"), F.sum("n").alias("_n")).where("_n > 0")

    def total(condition) -> Column:
        return F.aggregate(F.filter("_m", condition), F.lit(0.0), lambda s, x: s + x["n"])

    met = F.aggregate("_m", F.lit(0.0), lambda s, x: s + x["n"] * total(lambda y: y["a2"] == x["a1"]))
    shares = cells.select(*by, "_n", total(lambda x: x["a1"] == x["a2"]).alias("_c"), met.alias("_e"))
    po, pe = F.col("_c") / F.col("_n"), F.col("_e") / (F.col("_n") * F.col("_n"))
    value = F.when(pe >= 1, F.lit(1.0)).otherwise((po - pe) / (1 - pe))
    return shares.select(
        *by, F.col("_n").cast("bigint").alias("tokens"), F.col("_c").cast("bigint").alias("concordancias"), F.round(po, 4).alias("po"), F.round(pe, 4).alias("pe"),
        F.round(value, 4).alias("kappa"), (value >= KAPPA_GOAL).alias("meta_atingida"),
    )


def kappa_band(k: Column) -> Column:
    """Landis-Koch band of a kappa."""
    return (
        F.when(k < 0, "sem concordancia").when(k < 0.2, "minima").when(k < 0.4, "razoavel").when(k < 0.6, "moderada").when(k < 0.8, "substancial").when(k.isNotNull(), "quase perfeita")
    )


def disagreements(grid: DataFrame) -> DataFrame:
    """Per sentence the positions on which a1 and a2 differ, in order."""
    different = grid.where("a1 <> a2")
    return different.groupBy("sentenca_id").agg(
        F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("posicao", "token", "a1", "a2"))).alias("posicoes")
    )


def adjudications(df: DataFrame) -> DataFrame:
    """Current decisions: latest non-null label per (sentenca_id, posicao)."""
    given = df.where("label is not null").select("sentenca_id", "posicao", "criado_em", canonical_label(F.col("label")).alias("label"))
    return latest_rows(given, ["sentenca_id", "posicao"], ["criado_em"])


def gold(grid: DataFrame, decisions: DataFrame) -> DataFrame:
    """Final label of every token: decision, else first annotator, else outside."""
    final = decisions.select("sentenca_id", "posicao", F.col("label").alias("_decided"))
    return grid.join(final, ["sentenca_id", "posicao"], "left").select("sentenca_id", "sessao_id", "posicao", "token", F.coalesce("_decided", "a1", F.lit(OUTSIDE)).alias("label"))


def gold_types(sentences: DataFrame, annotations: DataFrame, decisions: DataFrame) -> DataFrame:
    """(sentenca_id, tipos): of each annotated sentence the types of its gold() labels, each once and in order.

    As gold() of token_grid() grouped by sentence, but of a sentence only its number of
    tokens is needed, and the annotations are exchanged once, by sentence: few of them are
    older rows of their key, so a map side would exchange nearly all of them and once more.
    Most cells are outside; one of them stands for all of its annotator before the lists are
    gathered, so that a task holds little besides its sort.
    """
    cells = _latest(_packed(annotations).repartition("sentenca_id"), in_order=True)
    named = F.col("label") != OUTSIDE
    few = cells.select("sentenca_id", "anotador_id", F.when(named, F.col("posicao")).alias("posicao"), "label", named.alias("_e")).distinct()
    entity = F.when(F.col("_e"), F.struct("anotador_id", "posicao", "label"))
    given = few.groupBy("sentenca_id").agg(F.min("anotador_id").alias("_first"), F.collect_list(entity).alias("_v"))
    decided = decisions.where("posicao is not null and label is not null").groupBy("sentenca_id").agg(F.collect_list(F.struct("posicao", "label")).alias("_d"))
    lengths = sentences.select("sentenca_id", F.size("tokens").alias("_n")).where("_n > 0").groupBy("sentenca_id").agg(F.max("_n").alias("_n"))
    joined = lengths.join(given, "sentenca_id").join(decided, "sentenca_id", "left")
    ours = F.coalesce("_d", F.array())
    settled = F.transform(ours, lambda x: x["posicao"])

    def inside(x: Column) -> Column:
        return (x["posicao"] >= 0) & (x["posicao"] < F.col("_n"))

    first = F.filter("_v", lambda x: (x["anotador_id"] == F.col("_first")) & inside(x) & ~F.array_contains(settled, x["posicao"]))
    final = F.concat(F.transform(first, lambda x: x["label"]), F.transform(F.filter(ours, inside), lambda x: x["label"]))
    types = F.transform(F.filter(final, lambda x: x != OUTSIDE), lambda x: F.substring(x, 3, 100))
    return joined.select("sentenca_id", F.array_sort(F.array_distinct(types)).alias("tipos"))


def pending(sentences: DataFrame, annotations: DataFrame, annotator: int) -> DataFrame:
    """Sentences that the annotator has not touched."""
    done = annotations.where(F.col("anotador_id") == annotator).select("sentenca_id")
    return sentences.join(done, "sentenca_id", "left_anti")


def next_sentence(sentences: DataFrame, annotations: DataFrame, annotator: int) -> DataFrame:
    """First pending sentence of each session by ordem."""
    return pending(sentences, annotations, annotator).groupBy("sessao_id").agg(F.min(F.struct("ordem", "sentenca_id")).alias("_f")).select("sessao_id", F.col("_f.ordem").alias("ordem"), F.col("_f.sentenca_id").alias("sentenca_id"))


def progress(sentences: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per session and annotator: total, anotadas, pendentes, pct (1 place)."""
    total = sentences.groupBy("sessao_id").agg(F.count(F.lit(1)).alias("total"))
    touched = annotations.select("sentenca_id", "anotador_id").distinct().join(sentences.select("sentenca_id", "sessao_id"), "sentenca_id")
    done = touched.groupBy("sessao_id", "anotador_id").agg(F.count(F.lit(1)).alias("anotadas"))
    return done.join(total, "sessao_id").select(
        "sessao_id", "anotador_id", "total", "anotadas", (F.col("total") - F.col("anotadas")).alias("pendentes"), F.round(100 * F.col("anotadas") / F.col("total"), 1).alias("pct")
    )


def completion(sentences: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per session: annotators, and whether at least two took part and each covered every sentence."""
    p = progress(sentences, annotations)
    return p.groupBy("sessao_id").agg(F.count(F.lit(1)).alias("anotadores"), ((F.count(F.lit(1)) >= 2) & F.min(F.col("pendentes") == 0)).alias("concluida"))


def previous_sentence(sentences: DataFrame, width: int = 4096) -> DataFrame:
    """(sessao_id, sentenca_id, anterior): the sentence before each in its session by ordem, then sentenca_id; null for the first.

    Sessions are cut into stretches of width places, so no task sorts a whole one; the last
    row of the stretch before stands in front of each (a table of one row per stretch).
    """
    place = F.floor(F.coalesce(F.col("ordem"), F.lit(-1)) / width)
    cut = sentences.select("sessao_id", "sentenca_id", "ordem", place.alias("_k"))
    ends = cut.groupBy("sessao_id", "_k").agg(F.max(F.struct("ordem", "sentenca_id"))["sentenca_id"].alias("_last"))
    before = F.lag("_last").over(Window.partitionBy("sessao_id").orderBy("_k"))
    ends = ends.select(F.col("sessao_id").alias("_s"), F.col("_k").alias("_kk"), before.alias("_border"))
    own = F.lag("sentenca_id").over(Window.partitionBy("sessao_id", "_k").orderBy("ordem", "sentenca_id"))
    met = cut.withColumn("_own", own).join(ends, F.col("sessao_id").eqNullSafe(F.col("_s")) & (F.col("_k") == F.col("_kk")), "left")
    return met.select("sessao_id", "sentenca_id", F.coalesce("_own", "_border").alias("anterior"))


def saved_labels(latest: DataFrame, annotator: int) -> DataFrame:
    """What an annotator saved for each sentence: map of position to label."""
    mine = latest.where(F.col("anotador_id") == annotator)
    return mine.groupBy("sentenca_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("posicao", "label")))).alias("labels"))


def integrity(sentences: DataFrame, annotations: DataFrame) -> DataFrame:
    """Per sentence and annotator: rows, repeated, missing and extra positions, and whether all is well."""
    rows = annotations.groupBy("sentenca_id", "anotador_id").agg(F.count(F.lit(1)).alias("linhas"), F.array_sort(F.collect_set("posicao")).alias("_p"))
    sized = rows.join(sentences.select("sentenca_id", F.size("tokens").alias("tokens")), "sentenca_id")
    wanted = F.when(F.col("tokens") > 0, F.sequence(F.lit(0), F.col("tokens") - 1)).otherwise(F.array().cast("array<int>"))
    checked = sized.select(
        "sentenca_id", "anotador_id", "tokens", "linhas", (F.col("linhas") - F.size("_p")).alias("repetidas"),
        F.size(F.array_except(wanted, "_p")).alias("faltantes"), F.size(F.array_except("_p", wanted)).alias("extras"),
    )
    return checked.withColumn("ok", (F.col("repetidas") == 0) & (F.col("faltantes") == 0) & (F.col("extras") == 0))


def without_session(df: DataFrame, sentences: DataFrame, session: int) -> DataFrame:
    """df (by sentenca_id) without the rows that hang on a deleted session."""
    return df.join(sentences.where(F.col("sessao_id") == session).select("sentenca_id"), "sentenca_id", "left_anti")


def session_listing(sessions: DataFrame, sentences: DataFrame) -> DataFrame:
    """Sessions with their number of sentences."""
    n = sentences.groupBy("sessao_id").agg(F.count(F.lit(1)).alias("sentencas"))
    return sessions.join(n, "sessao_id", "left").select("sessao_id", "nome", "experimento_id", F.coalesce("sentencas", F.lit(0)).alias("sentencas"))
