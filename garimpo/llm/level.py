"""Reading level of documents.

Method: a Rasch-style latent model that links document levels with word difficulties. A
word occurs where the level of the document is neither too low nor too high for it: the
chance of an occurrence is proportional to s(x) * s(-x) with the logistic s and
x = (level of document - difficulty of word) / spread of word, the unfolding form of the
Rasch model. Levels and difficulties are estimated in turn, each by a pass over the
corpus whose sums are reduced by word; rated documents fix the scale.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions.fold import fold_code
from garimpo.llm.words import WordNumbers
from garimpo.shared import materialize

#: Up to so many words the parameters are handed to every task (24 bytes a word); beyond, they are joined.
WORDS_BOUND = 2_000_000
#: Alternations of levels and difficulties, steps within one, and the weight of a rating in word occurrences.
ALTERNATIONS, STEPS, RATING_WEIGHT = 4, 8, 25.0
#: Documents that a word must occur in to link levels: a word of one document says nothing about others.
MIN_DOCS = 2

# Languages that the corpus labels tell apart, by the first letters of the folded label.
LANGUAGES = ("pt", "es", "en")

_BAG = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("words", pa.list_(pa.int64())), ("counts", pa.list_(pa.int32()))])


def word_number(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def bags(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, words, counts): distinct words of each text with letters; other texts have no level and no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = WordNumbers(word_number, letters_only=True)
        for batch in batches:
            ids, langs, lists, counts, sizes = [], [], [], [], []
            for doc, lang, text in zip(*[c.to_pylist() for c in batch.columns]):
                seen = np.frombuffer(number(text), dtype=np.int64) if text else ()
                if len(seen):
                    w, n = np.unique(seen, return_counts=True)
                    ids.append(doc)
                    langs.append(lang)
                    lists.append(w)
                    counts.append(n.astype(np.int32))
                    sizes.append(len(w))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            flat = np.concatenate(lists) if lists else np.empty(0, np.int64)
            times = np.concatenate(counts) if counts else np.empty(0, np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(langs, pa.string()), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.ListArray.from_arrays(offsets, pa.array(times))],
                schema=_BAG,
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.substring(fold_code(F.col("lang")), 1, 2).alias("lang"), "text").where("text is not null")
    return rows.mapInArrow(run, "doc_id bigint, lang string, words array<bigint>, counts array<int>")


def _spread(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, their counts and the row of each, of a batch with list columns words and counts."""
    w, n = batch.column(batch.schema.get_field_index("words")), batch.column(batch.schema.get_field_index("counts"))
    sizes = np.diff(w.offsets.to_numpy())
    return w.flatten().to_numpy(), n.flatten().to_numpy().astype(float), np.repeat(np.arange(batch.num_rows), sizes)


def _sums(words: np.ndarray, columns: dict[str, np.ndarray]) -> pd.DataFrame:
    distinct, at = np.unique(words, return_inverse=True)
    return pd.DataFrame({"word": distinct} | {k: np.bincount(at, v, len(distinct)) for k, v in columns.items()})


class _Partial:
    """Sums by word of a partition, kept small by folding whenever they grow."""

    def __init__(self):
        self._parts: list[pd.DataFrame] = []
        self._rows = 0

    def add(self, part: pd.DataFrame) -> None:
        self._parts.append(part)
        self._rows += len(part)
        if self._rows > 400_000:
            folded = self.total()
            self._parts, self._rows = [folded], 0

    def total(self) -> pd.DataFrame:
        return pd.concat(self._parts).groupby("word", as_index=False).sum() if self._parts else pd.DataFrame()


def _reduce(df: DataFrame, per_batch, columns: list[str]) -> DataFrame:
    """Sums of columns by word over all batches; each task sends one row a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partial = _Partial()
        for batch in batches:
            if batch.num_rows and len(part := per_batch(batch)):
                partial.add(part)
        if len(total := partial.total()):
            yield pa.RecordBatch.from_pandas(total[["word", *columns]], preserve_index=False)

    schema = "word bigint, " + ", ".join(f"{c} double" for c in columns)
    return df.mapInArrow(run, schema).groupBy("word").agg(*[F.sum(c).alias(c) for c in columns])


class WordTable:
    """Parameters of words, looked up by binary search."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values("word")
        self.words = pdf["word"].to_numpy(np.int64)
        self.values = {c: pdf[c].to_numpy(float) for c in pdf.columns if c != "word"}

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.words):
            return np.zeros(len(words), bool), np.zeros(len(words), int)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return self.words[at] == words, at


def solve_levels(rows: int, row: np.ndarray, beta: np.ndarray, spread: np.ndarray, weight: np.ndarray, prior: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Levels of documents from the difficulties of their words (nan without known words).

    Maximises the likelihood by iteratively reweighted means: the score of an occurrence
    is tanh(x / 2), so words far from the level lose influence, and a stray sentence of
    another kind does not move it. prior: ratings, nan where there is none.
    """
    base = weight / spread**2
    rated = ~np.isnan(prior)
    pull = np.where(rated, RATING_WEIGHT, 0.0) / 0.25
    known = np.where(rated, prior, 0.0)

    def mean(w: np.ndarray) -> np.ndarray:
        top, below = np.bincount(row, w * beta, rows) + pull * known, np.bincount(row, w, rows) + pull
        with np.errstate(invalid="ignore"):
            return top / below

    level = mean(base)
    for _ in range(steps):
        x = np.abs(np.nan_to_num(level)[row] - beta) / spread
        level = mean(base * np.where(x > 1e-6, np.tanh(x / 2) / np.maximum(x / 2, 1e-9), 1.0))
    return level


def _parameters(batch: pa.RecordBatch, table: WordTable | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which words of a batch are known, and beta and spread of these; without a table they are in the batch, null where unknown."""
    if table is None:
        beta, spread = (batch.column(batch.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).astype(float) for c in ("betas", "spreads"))
        ok = ~np.isnan(beta)
        return ok, beta[ok], spread[ok]
    ok, at = table.find(_spread(batch)[0])
    return ok, table.values["beta"][at[ok]], table.values["spread"][at[ok]]


def _lookup(batch: pa.RecordBatch, table: WordTable | None):
    """Known words of a batch: words, rows, counts, beta, spread."""
    words, counts, row = _spread(batch)
    ok, beta, spread = _parameters(batch, table)
    return words[ok], row[ok], counts[ok], beta, spread


def _joined(docs: DataFrame, table: DataFrame) -> DataFrame:
    """docs with the parameters of their words joined instead of handed to every task; unknown words keep their place."""
    long = docs.withColumn("_row", F.monotonically_increasing_id()).select("_row", "doc_id", "nivel", F.explode(F.arrays_zip("words", "counts")).alias("x"))
    met = long.select("_row", "doc_id", "nivel", F.col("x.words").alias("word"), F.col("x.counts").alias("n")).join(table, "word", "left")
    gathered = met.groupBy("_row", "doc_id", "nivel").agg(F.collect_list(F.struct("word", "n", "beta", "spread")).alias("x"))
    return gathered.select("doc_id", "nivel", F.col("x.word").alias("words"), F.col("x.n").alias("counts"), F.col("x.beta").alias("betas"), F.col("x.spread").alias("spreads"))


def _word_parameters(sums: DataFrame) -> DataFrame:
    """Difficulty and spread of each word from its weighted sums; shrunk to the middle of the scale where words are rare."""
    prior, mid = 0.5, 2.5
    mean = (F.col("s1") + prior * mid) / (F.col("s0") + prior)
    var = (F.col("s2") - 2 * mean * F.col("s1") + mean * mean * F.col("s0") + prior * 1.0) / (F.col("s0") + prior)
    return sums.where(F.col("d") >= MIN_DOCS).select("word", mean.alias("beta"), F.sqrt(F.greatest(F.lit(0.04), var)).alias("spread"))


def portuguese(bag: DataFrame, bound: int = WORDS_BOUND) -> DataFrame:
    """The rows of bag whose words are more Portuguese than Spanish or English, whatever their label says.

    How often each word occurs under each language label is counted over the whole
    corpus; a text is Portuguese if its occurrences are likeliest under that label, so
    missing, odd and single wrong labels do no harm. Words are weighed by documents.
    """

    def per_batch(batch: pa.RecordBatch) -> pd.DataFrame:
        words, counts, row = _spread(batch)
        langs = np.array([x or "" for x in batch.column(1).to_pylist()])[row]
        return _sums(words, {lang: (langs == lang).astype(float) for lang in LANGUAGES})

    sums = materialize(_reduce(bag, per_batch, list(LANGUAGES)), "langs")
    totals = sums.agg(*[(F.sum(c) + F.lit(1.0)).alias(f"t_{c}") for c in LANGUAGES])
    rates = sums.crossJoin(F.broadcast(totals)).select("word", *[F.log((F.col(c) + 0.1) / F.col(f"t_{c}")).alias(c) for c in LANGUAGES])  # one row of totals
    worth = rates.select("word", *[(F.col("pt") - F.col(c)).alias(c) for c in LANGUAGES[1:]])
    if worth.count() > bound:
        long = materialize(bag.select("doc_id", "lang", "words", "counts", F.monotonically_increasing_id().alias("_row")), "numbered")
        scored = long.select("_row", F.explode("words").alias("word")).join(worth, "word").groupBy("_row").agg(*[F.sum(c).alias(c) for c in LANGUAGES[1:]])
        return long.join(scored.where("es > 0 and en > 0"), "_row", "left_semi").drop("_row")
    table = WordTable(worth.toPandas())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, _, row = _spread(batch)
            ok, at = table.find(words)
            scores = [np.bincount(row[ok], table.values[c][at[ok]], batch.num_rows) for c in LANGUAGES[1:]]
            yield batch.filter(pa.array((scores[0] > 0) & (scores[1] > 0)))

    return bag.mapInArrow(keep, bag.schema)


def reading_levels(docs: DataFrame, ratings: DataFrame, bound: int = WORDS_BOUND) -> DataFrame:
    """(doc_id, theta, nivel) of every Portuguese document of docs (doc_id, text, lang).

    ratings: doc_id, nivel (1 easiest to 4 hardest), one row per rater; several are
    averaged. theta lies on that scale; nivel is the level between whose cuts (level_cuts) it lies. Cases: null,
    empty and blank texts and texts without letters give no row; null ratings and ratings
    of unknown documents do not count; without any rating every theta and nivel is null; repeated
    documents keep their rows; extra columns are ignored.
    """
    rated = ratings.where("nivel is not null and doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("_rated")).agg(F.avg("nivel").cast("double").alias("nivel"))
    bag = materialize(bags(docs), "bags")
    known = materialize(portuguese(bag, bound).join(rated, F.col("doc_id") == F.col("_rated"), "left").select("doc_id", "nivel", "words", "counts"), "known")

    def from_ratings(batch: pa.RecordBatch) -> pd.DataFrame:
        words, counts, row = _spread(batch)
        level = np.array([np.nan if x is None else x for x in batch.column(1).to_pylist()])[row]
        ok = ~np.isnan(level)
        w, y = np.sqrt(counts[ok]), level[ok]
        return _sums(words[ok], {"d": np.ones(ok.sum()), "s0": w, "s1": w * y, "s2": w * y * y})

    def alternate(table: WordTable | None):
        def per_batch(batch: pa.RecordBatch) -> pd.DataFrame:
            words, row, counts, beta, spread = _lookup(batch, table)
            prior = np.array([np.nan if x is None else x for x in batch.column(1).to_pylist()], dtype=float)
            w = np.sqrt(counts)
            level = solve_levels(batch.num_rows, row, beta, spread, w, prior)[row]
            x = np.abs(level - beta) / spread
            w = w * np.where(x > 1e-6, np.tanh(x / 2) / np.maximum(x / 2, 1e-9), 1.0)
            return _sums(words, {"d": np.ones(len(w)), "s0": w, "s1": w * level, "s2": w * level * level})

        return per_batch

    sums = ["d", "s0", "s1", "s2"]
    table = materialize(_word_parameters(_reduce(known.where("nivel is not null"), from_ratings, sums)), "words0")
    # Words that no rated document holds enter with the levels of the documents that hold them.
    links = _reduce(known, lambda b: _sums(_spread(b)[0], {"d": np.ones(len(_spread(b)[0]))}), ["d"]).where(F.col("d") >= MIN_DOCS)
    many = links.count() > bound
    for k in range(ALTERNATIONS):
        held = None if many else WordTable(table.toPandas())
        reduced = _reduce(_joined(known, table) if many else known, _with_new_words(held, alternate), sums)
        table = materialize(_word_parameters(reduced), f"words{k + 1}")
    final = None if many else WordTable(table.toPandas())

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, row, counts, beta, spread = _lookup(batch, final)
            level = solve_levels(batch.num_rows, row, beta, spread, np.sqrt(counts), np.full(batch.num_rows, np.nan))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(level, from_pandas=True), batch.column(1)], names=["doc_id", "theta", "rated"])

    placed = materialize((_joined(known, table) if many else known.select("doc_id", "nivel", "words", "counts")).mapInArrow(estimate, "doc_id bigint, theta double, rated double"), "theta")
    nivel = F.when(F.col("theta").isNotNull(), 1)
    for low, cut in enumerate(level_cuts(placed), start=1):
        nivel = F.when(F.col("theta") >= cut, low + 1).otherwise(nivel)
    return placed.select("doc_id", "theta", nivel.cast("int").alias("nivel"))


def level_cuts(placed: DataFrame, levels: int = 4, bins: int = 400) -> list[float]:
    """The levels - 1 values of theta that part the rated levels with fewest errors.

    Estimates lean to the middle of the scale, so its whole numbers are no good borders.
    Only a histogram of theta by rated level (at most bins x levels counts) reaches the
    driver; where several cuts are equally good the middle of their widest stretch is taken.
    """
    width = (levels - 1) / bins
    hist = placed.where("rated is not null and theta is not null").groupBy(F.floor((F.col("theta") - 1) / width).alias("b"), F.round("rated").cast("int").alias("l"))
    counts = np.zeros((bins + 1, levels + 1))
    for r in hist.agg(F.count(F.lit(1)).alias("n")).collect():
        counts[min(max(int(r["b"]), 0), bins), min(max(int(r["l"]), 1), levels)] += r["n"]
    cuts = []
    for k in range(1, levels):
        low, high = counts[:, 1 : k + 1].sum(axis=1), counts[:, k + 1 :].sum(axis=1)
        # A cut before bin b errs on the low levels at or after it and on the high levels before it.
        errors = np.concatenate([[0], np.cumsum(high)]) + np.concatenate([np.cumsum(low[::-1])[::-1], [0]])
        best = np.flatnonzero(errors == errors.min())
        runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
        run = max(runs, key=len)
        cuts.append(k + 0.5 if len(best) > bins else 1 + width * (run[0] + run[-1]) / 2)
    return np.maximum.accumulate(cuts).tolist()


def _with_new_words(table: WordTable | None, alternate):
    """alternate() over known words; unknown ones get the level of their documents without taking part in it."""
    known = alternate(table)

    def per_batch(batch: pa.RecordBatch) -> pd.DataFrame:
        part = known(batch)
        words, counts, row = _spread(batch)
        ok, beta, spread = _parameters(batch, table)
        if ok.all():
            return part
        prior = np.array([np.nan if x is None else x for x in batch.column(1).to_pylist()], dtype=float)
        level = solve_levels(batch.num_rows, row[ok], beta, spread, np.sqrt(counts[ok]), prior)[row[~ok]]
        fine = ~np.isnan(level)
        w, y = np.sqrt(counts[~ok])[fine], level[fine]
        return pd.concat([part, _sums(words[~ok][fine], {"d": np.ones(len(w)), "s0": w, "s1": w * y, "s2": w * y * y})]) if len(w) else part

    return per_batch
