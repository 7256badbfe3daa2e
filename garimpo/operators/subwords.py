"""Labels, windows and truncation of sentences in subwords, as column expressions.

The tokenizer is the caller's: it gives for each word how many subwords it has, from a
built-in expression or a pandas UDF around any tokenizer.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label of subwords that no loss and no measure counts.
IGNORED = -100

Counts = Callable[[Column], Column]


def fixed_pieces(size: int = 4) -> Counts:
    """Counts of a stand-in tokenizer that cuts words into pieces of size characters; an empty word is one piece."""
    return lambda tokens: F.transform(tokens, lambda t: F.greatest(F.lit(1), F.ceil(F.length(t) / size)).cast("int"))


def aligned_labels(labels: Column, counts: Column) -> Column:
    """Label ids of all subwords: the first of a word has its label, the others IGNORED."""
    each = F.zip_with(labels, counts, lambda x, n: F.concat(F.array(x), F.array_repeat(F.lit(IGNORED), n - 1)))
    return F.flatten(each)


def windows(n: Column, size: int, stride: int) -> Column:
    """Overlapping windows (inicio, fim) over n subwords: each starts stride before the end of the one before; one if all fit."""
    if stride >= size:
        raise ValueError("stride must be smaller than size")
    step = size - stride
    last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * step).alias("inicio"), F.least(n, k * step + size).alias("fim")))


def kept_words(counts: Column, limit: int, step: int = 20) -> Column:
    """How many words stay if trailing ones are dropped step by step until the rest has at most limit subwords; never fewer than one step's."""
    n = F.size(counts)
    tries = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil((n - step) / step)).cast("int")), lambda k: n - k * step)
    fits = F.filter(tries, lambda m: (m <= step) | (F.aggregate(F.slice(counts, 1, m), F.lit(0), lambda a, x: a + x) <= limit))
    return F.coalesce(F.get(fits, F.lit(0)), n)


def training_windows(sentences: DataFrame, ids: dict[str, int], counts: Counts, size: int = 512, stride: int = 64) -> DataFrame:
    """(sentenca_id, janela, rotulos): the label ids of every window of every sentence (tokens, labels)."""
    known = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    numbers = F.transform("labels", lambda x: F.try_element_at(known, x))
    flat = sentences.select("sentenca_id", aligned_labels(numbers, counts(F.col("tokens"))).alias("_l"))
    each = flat.select("sentenca_id", "_l", F.posexplode(windows(F.size("_l"), size, stride)).alias("janela", "_w"))
    return each.select("sentenca_id", "janela", F.slice("_l", F.col("_w.inicio") + 1, F.col("_w.fim") - F.col("_w.inicio")).alias("rotulos"))


def word_labels(predicted: Column, counts: Column, words: Column) -> Column:
    """Labels of words from those of subwords: a word has the label of its first subword; words past the end of predicted stay outside."""
    starts = F.transform(counts, lambda n, i: F.aggregate(F.slice(counts, 1, i), F.lit(0), lambda a, x: a + x))
    return F.transform(words, lambda _, i: F.coalesce(F.get(predicted, F.get(starts, i)), F.lit("O")))


def predict_within(sentences: DataFrame, predict: Callable[[Column], Column], counts: Counts, limit: int = 512, step: int = 20) -> DataFrame:
    """sentences (tokens) with labels: predict sees the words kept_words() leaves and gives one label each; dropped words stay outside."""
    kept = sentences.withColumn("_n", kept_words(counts(F.col("tokens")), limit, step)).withColumn("_seen", F.slice("tokens", 1, F.col("_n")))
    tagged = kept.withColumn("_l", predict(F.col("_seen")))
    return tagged.withColumn("labels", F.concat("_l", F.array_repeat(F.lit("O"), F.size("tokens") - F.col("_n")))).drop("_n", "_seen", "_l")
