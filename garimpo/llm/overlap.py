"""Records of evaluation splits that also occur, exactly or almost, in the training split.

Method: Aho-Corasick automata over sharded normalised evaluation passages scan the
training texts; the matched intervals are merged into coverage per evaluation record, and
an exact check of the longest common subsequence follows.

Shards: a common sentence of clinical text shares short passages with nearly every other
one, so one automaton over everything would match all against all. Each record is
therefore sent only to the shards of its rarest word combinations. A pair above the
similarity always has such a combination in common (see combinations), so no pair is lost.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from garimpo.llm.words import MEMORY, fold
from garimpo.shared import materialize

#: Words of a passage. Two texts of n words with 85 % in common, in order, always share one of three words.
PASSAGE = 3
#: Most words of records that share a combination of three or two of their rarest words; longer ones share single rare words.
TRIPLES, DOUBLES = 56, 160
#: Counters of the frequency sketch and bits of the filter of keys: sizes of what every task is given, whatever the input.
COUNTERS, FILTER_BITS = 1 << 20, 1 << 26

_SEED = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit numbers scattered over all of their range."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class TokenNumbers(dict):
    """Token -> 64-bit number of the word without case and accents; 0 for tokens without a letter or digit and for nulls."""

    def __missing__(self, token: str | None) -> int:
        number = 0
        if token is not None and any(c.isalnum() for c in token):
            number = xxhash.xxh64_intdigest(fold(token)) or 1
        if len(self) >= MEMORY:
            self.clear()
        self[token] = number
        return number


def numbered(lists: pa.ListArray, known: TokenNumbers) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the words of a batch of token lists, one after the other, and how many each list has."""
    coded = lists.flatten().dictionary_encode()
    numbers = np.array([*(known[t] for t in coded.dictionary.to_pylist()), 0], dtype=np.uint64)
    words = numbers[coded.indices.fill_null(len(numbers) - 1).to_numpy(zero_copy_only=False)]
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(lists)), sizes)
    held = words != 0
    return words[held], np.bincount(row[held], minlength=len(lists))


def occurrences(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, row) of each word occurrence: the k-th copy of a word in a row is a word of its own, so multisets become sets."""
    order = np.lexsort((words, row))
    words, row = words[order], row[order]
    at = np.arange(len(words))
    new = np.ones(len(words), bool)
    new[1:] = (words[1:] != words[:-1]) | (row[1:] != row[:-1])
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    with np.errstate(over="ignore"):
        return mix(words + copy.astype(np.uint64) * _SEED), row


def counter_of(occurrence: np.ndarray) -> np.ndarray:
    """Which counter of the frequency sketch counts an occurrence."""
    return (occurrence >> np.uint64(64 - (COUNTERS.bit_length() - 1))).astype(np.int64)


@functools.cache
def _places(prefix: int, l: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(prefix), l)), dtype=np.int64).reshape(-1, l)


def kind(n: int) -> int:
    """How many rare words a key of records of up to n words combines."""
    return 3 if n <= TRIPLES else 2 if n <= DOUBLES else 1


def combinations(ranked: np.ndarray, sizes: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of all records, from their word occurrences, rarest first in one global order.

    Two texts above the similarity share all but spare_bound() of the word occurrences of
    either. Of the first spare_bound() + l occurrences of each, in one common order, at
    least l are then common to both, so all combinations of l among them are keys that
    the pair must share one of. l is the kind() of the longer text; records whose partner
    may be of another kind have the keys of both. Since the order is common, a combination
    is numbered as it stands.
    """
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    keys, rows = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for n in np.unique(sizes):
        mine = np.flatnonzero(sizes == n)
        if not n:
            continue
        for l in range(kind(math.floor(n / share + 1e-9)), kind(n) + 1):
            prefix = min(n, spare_bound(int(n), share) + l)
            places = _places(prefix, l)
            # As many records at once as keep the keys of a step in some megabytes.
            for part in np.array_split(mine, max(1, len(mine) * len(places) >> 20)):
                first = ranked[starts[part][:, None] + np.arange(prefix)]
                key = np.full((len(part), len(places)), l, dtype=np.uint64)
                for k in range(l):
                    key = mix(key * _SEED ^ first[:, places[:, k]])
                keys.append(key.ravel())
                rows.append(np.repeat(part, len(places)))
    return np.concatenate(keys), np.concatenate(rows)


def sketches(occurrence: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """128-bit sketches (n x 2) of the occurrences: bits that one text has and another lacks are a lower bound of what it lacks."""
    bit = (occurrence & np.uint64(127)).astype(np.int64)
    cells = np.unique(row * 128 + bit)
    out = np.zeros((n, 2), np.uint64)
    np.bitwise_or.at(out, (cells >> 7, cells >> 6 & 1), np.left_shift(np.uint64(1), (cells & 63).astype(np.uint64)))
    return out


def spare_bound(n: int, share: float) -> int:
    """Most words of a text of n that a partner may lack: at least share * n are common, more if the partner is longer."""
    return n - math.ceil(share * n - 1e-9)


def common_in_order(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    at: dict[int, int] = defaultdict(int)
    for i, w in enumerate(a):
        at[w] |= 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = row & at.get(w, 0)
        row = ((row + m) | (row - m)) & full
    return len(a) - row.bit_count()


def scan_pairs(pairs: list[tuple[int, int]], evals: dict[int, list[int]], trains: dict[int, list[int]], share: float) -> list[tuple[int, int, float]]:
    """(train, eval, coverage) of the candidate pairs (train, eval) whose similarity is at least share.

    The passages of all evaluation texts form one automaton; every training text is read
    once; the matched intervals of each of its candidates are merged into the part of the
    evaluation text that is covered. Only pairs with a covered passage reach the check.
    """
    letters = _Letters()
    passages: dict[str, list[tuple[int, int]]] = defaultdict(list)
    for e, words in evals.items():
        spelled = letters.spell(words)
        for i in range(len(words) - PASSAGE + 1):
            passages[spelled[i : i + PASSAGE]].append((e, i))
    machine = ahocorasick.Automaton()
    for p, where in passages.items():
        machine.add_word(p, where)
    machine.make_automaton()
    wanted: dict[int, set[int]] = defaultdict(set)
    for t, e in pairs:
        wanted[t].add(e)
    out = []
    for t, candidates in wanted.items():
        words = trains[t]
        covered: dict[int, int] = defaultdict(int)
        for _, where in machine.iter(letters.spell(words)) if len(machine) else ():
            for e, i in where:
                if e in candidates:
                    covered[e] |= ((1 << PASSAGE) - 1) << i
        for e, mask in covered.items():
            target = evals[e]
            longer = max(len(words), len(target))
            least = math.ceil(share * longer - 1e-9)
            # Each of the at most len + len - 2 * least breaks leaves a stretch; stretches shorter than a passage are not covered.
            if mask.bit_count() < least - (PASSAGE - 1) * (len(words) + len(target) - 2 * least):
                continue
            if common_in_order(words, target) >= share * longer - 1e-9:
                out.append((t, e, mask.bit_count() / len(target)))
    return out


class _Letters(dict):
    """Words as single characters of the automaton, so that matches begin and end at words."""

    FIRST, LAST = 0x10000, 0x10FFFF

    def __missing__(self, word: int) -> str:
        if self.FIRST + len(self) > self.LAST:
            raise OverflowError("more distinct words than characters in one batch")
        self[word] = c = chr(self.FIRST + len(self))
        return c

    def spell(self, words: list[int]) -> str:
        return "".join([self[w] for w in words])


def _words_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and sizes of a batch with a column words of packed numbers."""
    packed = batch.column(batch.schema.get_field_index("words"))
    bounds = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset : packed.offset + len(packed) + 1]
    flat = np.frombuffer(packed.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if len(packed) else np.empty(0, np.uint8)
    return flat.view(np.uint64) if len(flat) else np.empty(0, np.uint64), np.diff(bounds) // 8


def prepared(rows: DataFrame, min_words: int) -> DataFrame:
    """(id, is_eval, text, twin, words) of rows (id, is_eval, tokens) with at least min_words words; text and twin identify the sequence of words, packed in words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = TokenNumbers()
        for batch in batches:
            words, sizes = numbered(batch.column(2), known)
            ends = np.cumsum(sizes)
            kept = np.flatnonzero(sizes >= min_words)
            packed = [words[ends[i] - sizes[i] : ends[i]].tobytes() for i in kept]
            twins = np.frombuffer(b"".join(xxhash.xxh3_128_digest(p) for p in packed), np.int64).reshape(-1, 2)
            at = pa.array(kept)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(np.ascontiguousarray(twins[:, 0])), pa.array(np.ascontiguousarray(twins[:, 1])), pa.array(packed, pa.binary())],
                names=["id", "is_eval", "text", "twin", "words"],
            )

    return rows.select("id", "is_eval", "tokens").mapInArrow(run, "id bigint, is_eval boolean, text bigint, twin bigint, words binary")


def _summed(df: DataFrame, columns: list[str], how: Callable, per_batch: Callable, size: int) -> list[np.ndarray]:
    """Arrays of `size` numbers, from per_batch(batch) -> arrays, joined by `how` (a ufunc) over all batches.

    Each task keeps one array per column and sends what is not zero of it; equal places
    meet in a groupBy, so the driver gets at most `size` rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                total = [np.zeros(size, np.int64) for _ in columns] if total is None else total
                per_batch(batch, total)
        if total is not None:
            at = np.flatnonzero(functools.reduce(np.logical_or, [t != 0 for t in total]))
            for part in np.array_split(at, max(1, len(at) >> 16)):
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *[pa.array(t[part]) for t in total]], names=["at", *columns])

    sent = df.mapInArrow(run, "at int, " + ", ".join(f"{c} bigint" for c in columns))
    met = sent.groupBy("at").agg(*[how(c).alias(c) for c in columns]).toArrow()
    at = met.column("at").to_numpy()
    out = [np.zeros(size, np.int64) for _ in columns]
    for o, c in zip(out, columns):
        o[at] = met.column(c).to_numpy()
    return out


def near_pairs(rows: DataFrame, share: float = 0.85, min_words: int = 24) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (id, is_eval, text, twin) and links (train, eval, coverage) between texts.

    rows: id, is_eval, tokens (array of strings). Texts are the distinct word sequences of
    at least min_words words, told apart by 128 bits, so copies are compared once; train
    and eval are numbers (rep) that members have too. Equal sequences are linked too. Null
    token lists and shorter ones have no text; ids may repeat.

    Every task gets two tables of fixed size: a sketch of word frequencies, which only
    sets the order of rarity (any common order is right), and a filter of keys, which only
    keeps keys from the shuffle that no text of the other side has.
    """
    spark = rows.sparkSession
    own = materialize(prepared(rows, min_words).withColumn("uid", F.monotonically_increasing_id()), "rows")
    reps = own.groupBy("text", "twin").agg(F.min("uid").alias("rep"), F.bool_or("is_eval").alias("in_eval"), F.bool_and("is_eval").alias("only_eval"))
    reps = materialize(reps, "reps")
    members = own.select("id", "is_eval", "text", "twin").distinct().join(reps.select("text", "twin", "rep"), ["text", "twin"]).select("id", "is_eval", "rep")
    texts = materialize(own.select("uid", "words").join(reps.select(F.col("rep").alias("uid"), "in_eval", "only_eval"), "uid"), "texts")

    def count(batch: pa.RecordBatch, total: list[np.ndarray]) -> None:
        words, sizes = _words_of(batch)
        found, _ = occurrences(words, np.repeat(np.arange(len(sizes)), sizes))
        total[0] += np.bincount(counter_of(found), minlength=COUNTERS)

    (frequency,) = _summed(texts.select("words"), ["n"], F.sum, count, COUNTERS)
    frequency = spark.sparkContext.broadcast(frequency)

    def keys_of(batch: pa.RecordBatch) -> tuple:
        words, sizes = _words_of(batch)
        found, row = occurrences(words, np.repeat(np.arange(len(sizes)), sizes))
        order = np.lexsort((found, frequency.value[counter_of(found)], row))
        keys, of = combinations(found[order], sizes, share)
        return keys, of, sketches(found, row, len(sizes)), sizes

    def sides(batch: pa.RecordBatch) -> list[np.ndarray]:
        in_eval, only = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("in_eval", "only_eval"))
        return [~only, in_eval]

    def bits(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = (keys % np.uint64(FILTER_BITS)).astype(np.int64)
        return at >> 6, np.left_shift(np.int64(1), at & 63)

    def note(batch: pa.RecordBatch, total: list[np.ndarray]) -> None:
        keys, of, _, _ = keys_of(batch)
        word, bit = bits(keys)
        for t, here in zip(total, sides(batch)):
            np.bitwise_or.at(t, word[here[of]], bit[here[of]])

    filters = spark.sparkContext.broadcast(_summed(texts, ["train", "eval"], F.bit_or, note, FILTER_BITS // 64))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, of, marks, sizes = keys_of(batch)
            word, bit = bits(keys)
            uid = batch.column(batch.schema.get_field_index("uid")).to_numpy()
            here = sides(batch)
            for is_eval in (False, True):
                met = np.flatnonzero(here[is_eval][of] & ((filters.value[not is_eval][word] & bit) != 0))
                if len(met):
                    r = of[met]
                    columns = [keys[met].view(np.int64), uid[r], marks[r, 0].view(np.int64), marks[r, 1].view(np.int64), sizes[r].astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(met), is_eval)), *map(pa.array, columns)], names=["is_eval", "key", "uid", "low", "high", "n"])

    keyed = materialize(texts.mapInArrow(emit, "is_eval boolean, key bigint, uid bigint, low bigint, high bigint, n int"), "keys")

    def side(is_eval: bool, name: str, s: str) -> DataFrame:
        own = keyed.where("is_eval" if is_eval else "not is_eval")
        return own.select("key", F.col("uid").alias(name), *[F.col(c).alias(f"{c}{s}") for c in ("low", "high", "n")])

    # What the sketches and lengths show to be too far apart goes within the join.
    left, right = side(True, "eval", "_e"), side(False, "train", "_t")
    need = share * F.greatest("n_e", "n_t") - 1e-9

    def most(x: str, y: str) -> Column:
        lacks = [F.bit_count(F.col(f"{c}{x}").bitwiseAND(F.bitwise_not(F.col(f"{c}{y}")))) for c in ("low", "high")]
        return F.col(f"n{x}") - lacks[0] - lacks[1]

    close = (F.least("n_e", "n_t") >= need) & (most("_e", "_t") >= need) & (most("_t", "_e") >= need)
    near = right.join(left, "key").where((F.col("train") != F.col("eval")) & close).select("train", "eval").distinct()
    # A shard holds whole evaluation texts with the training texts that may match them.
    bodies = near.join(texts.select(F.col("uid").alias("train"), F.col("words").alias("train_words")), "train")
    bodies = bodies.join(texts.select(F.col("uid").alias("eval"), F.col("words").alias("eval_words")), "eval")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            evals, trains = ({}, {})
            pairs = list(zip(batch.column(1).to_pylist(), batch.column(0).to_pylist()))
            for (t, e), tw, ew in zip(pairs, batch.column(2), batch.column(3)):
                if t not in trains:
                    trains[t] = np.frombuffer(tw.as_buffer(), np.int64).tolist()
                if e not in evals:
                    evals[e] = np.frombuffer(ew.as_buffer(), np.int64).tolist()
            if found := scan_pairs(pairs, evals, trains, share):
                t, e, c = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(e, pa.int64()), pa.array(c, pa.float64())], names=["train", "eval", "coverage"])

    found = bodies.select("eval", "train", "train_words", "eval_words").mapInArrow(scan, "train bigint, eval bigint, coverage double")
    both = reps.where("in_eval and not only_eval").select(F.col("rep").alias("train"), F.col("rep").alias("eval"), F.lit(1.0).alias("coverage"))
    return members, materialize(found.unionByName(both), "links")


def cross_split_rows(sentences: DataFrame, splits: DataFrame) -> DataFrame:
    """(id, is_eval, tokens) of sentences in treino (false), dev or teste (true); others take no part."""
    part = splits.select(F.col("sentenca_id").alias("id"), F.lower(F.trim("particao")).alias("_p")).where(F.col("_p").isin("treino", "dev", "teste"))
    part = part.select("id", (F.col("_p") != "treino").alias("is_eval")).distinct()
    return sentences.where("tokens is not null").select(F.col("sentenca_id").alias("id"), "tokens").join(part, "id").select("id", "is_eval", "tokens")


def overlaps(sentences: DataFrame, splits: DataFrame, share: float = 0.85, min_words: int = 24) -> DataFrame:
    """(sentenca_id_a, sentenca_id_b, coverage): a in treino, b in dev or teste, almost or exactly the same words.

    Both have at least min_words words and their longest common subsequence is at least
    share of the longer one's words. Cases: null particao and unknown sentences take no
    part; null tokens are no words; repeated rows of a sentence count once; extra columns
    are ignored. Copies are expanded only here, as many tasks as SALT share a hot text.
    """
    members, links = near_pairs(cross_split_rows(sentences, splits), share, min_words)
    salt = 16
    trains = members.where("not is_eval").select(F.col("rep").alias("train"), F.col("id").alias("sentenca_id_a"), F.pmod(F.col("id"), F.lit(salt)).cast("int").alias("s"))
    evals = members.where("is_eval").select(F.col("rep").alias("eval"), F.col("id").alias("sentenca_id_b"))
    spread = links.join(evals, "eval").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return spread.join(trains, ["train", "s"]).select("sentenca_id_a", "sentenca_id_b", "coverage")


def overlap_pairs(sentences: DataFrame, splits: DataFrame, share: float = 0.85, min_words: int = 24) -> DataFrame:
    """(sentenca_id_a, sentenca_id_b): the pairs of overlaps, each once, the smaller id first, whichever side is in treino.

    A sentence that divisao puts in treino and in dev or teste at once forms no pair with itself.
    """
    ids = [F.col("sentenca_id_a"), F.col("sentenca_id_b")]
    pairs = overlaps(sentences, splits, share, min_words).where(ids[0] != ids[1])
    return pairs.select(F.least(*ids).alias("sentenca_id_a"), F.greatest(*ids).alias("sentenca_id_b")).distinct()


def overlap_report(sentences: DataFrame, splits: DataFrame, share: float = 0.85, min_words: int = 24) -> DataFrame:
    """(particao, origem, sentencas, sobrepostas, pares): evaluation sentences and their overlaps per split and source.

    sentencas: of the split and source; sobrepostas: those with an overlap in treino;
    pares: all their pairs. A null origem is a source of its own.
    """
    pairs = overlaps(sentences, splits, share, min_words).groupBy("sentenca_id_b").agg(F.count(F.lit(1)).alias("_n"))
    evals = splits.select("sentenca_id", F.lower(F.trim("particao")).alias("particao"), "origem").where(F.col("particao").isin("dev", "teste")).distinct()
    met = evals.join(pairs, F.col("sentenca_id") == F.col("sentenca_id_b"), "left")
    return met.groupBy("particao", "origem").agg(
        F.count(F.lit(1)).alias("sentencas"), F.count("_n").alias("sobrepostas"), F.coalesce(F.sum("_n"), F.lit(0)).alias("pares")
    )
