"""Passages of held-out items inside a corpus.

Method: distributed positional inverted index. The postings (term, run, position) of the
corpus are stored once, without those that cannot take part in a match; a query starts
from the rarest term of each window of an item and intersects the offset-adjusted lists
of its other terms.
"""

from __future__ import annotations

import array
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from garimpo.llm.words import WordNumbers, words
from garimpo.shared import materialize

#: Items up to so many distinct terms prune the index by their vocabulary; beyond, all terms are stored.
VOCABULARY_BOUND = 1_000_000
#: Lists intersected after the rarest one before whole items are compared; windows have at least so many pairs more.
FILTERS = 3
#: Item words handed to every task of a search for near matches at once, and starts of such matches tried at once.
ITEM_WORDS, STARTS = 1_000_000, 1 << 14

_POSTINGS = pa.schema([("run", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32()), ("term", pa.int64()), ("pair", pa.int64())])
_INDEX = "run bigint, doc_id bigint, pos int, term bigint, pair bigint"


def term_number(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


def pair_numbers(terms: np.ndarray) -> np.ndarray:
    """Numbers of the pairs of neighbouring terms (one fewer than terms)."""
    with np.errstate(over="ignore"):
        return (terms[:-1] * np.int64(-7046029254386353131)) ^ terms[1:]


def _item_postings(items: DataFrame) -> DataFrame:
    """(item_id, ipos, term, pair, n): every word of every item; null texts have none, the last word has no pair."""

    def run(batches):
        for pdf in batches:
            lists = [[term_number(w) for w in words(t)] if isinstance(t, str) else [] for t in pdf["texto"]]
            yield pdf[["item_id"]].assign(terms=lists, pairs=[pair_numbers(np.array(x, dtype=np.int64)) for x in lists])

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "texto").distinct()
    listed = rows.mapInPandas(run, "item_id bigint, terms array<bigint>, pairs array<bigint>")
    return listed.select("item_id", F.posexplode("terms").alias("ipos", "term"), F.size("terms").alias("n"), "pairs").select(
        "item_id", "ipos", "term", F.get("pairs", F.col("ipos")).alias("pair"), "n"
    )


def build_index(docs: DataFrame, vocabulary: np.ndarray | None, min_words: int) -> DataFrame:
    """Stored postings (run, doc_id, pos, term, pair) of docs (doc_id, text).

    vocabulary: sorted numbers of the terms that queries use, or None for all. A run is a
    stretch of one text in which terms of the vocabulary follow each other directly; only
    runs of min_words terms and more can hold a match of min_words terms, all others are
    left out. Positions count all words of the text; pair
    is null where the next word is none of the vocabulary.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 36
        known = None if vocabulary is None else set(vocabulary.tolist())
        number = WordNumbers(term_number if known is None else lambda w: n if (n := term_number(w)) in known else _OUT)
        gap = array.array("q", [_OUT])
        for batch in batches:
            ids = np.array(batch.column(0).fill_null(0).to_pylist(), dtype=np.int64)
            flat, starts = array.array("q"), np.zeros(batch.num_rows, dtype=np.int64)
            for k, text in enumerate(batch.column(1).to_pylist()):
                starts[k] = len(flat)
                if text:
                    flat.extend(number(text))
                flat.extend(gap)
            terms = np.frombuffer(flat, dtype=np.int64)
            at = np.flatnonzero(terms != _OUT)
            if not len(at):
                continue
            name = np.cumsum(np.concatenate([[0], np.diff(at) > 1]))
            at = at[np.bincount(name)[name] >= min_words]
            if not len(at):
                continue
            name = np.cumsum(np.concatenate([[0], np.diff(at) > 1]))
            row = np.searchsorted(starts, at, side="right") - 1
            pairs = np.concatenate([pair_numbers(terms[at]), [0]])
            alone = np.concatenate([np.diff(at) > 1, [True]])
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + name), pa.array(ids[row]), pa.array((at - starts[row]).astype(np.int32)), pa.array(terms[at]), pa.array(pairs, mask=alone)], schema=_POSTINGS
            )
            first += int(name[-1]) + 1

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return materialize(rows.mapInArrow(run, _INDEX), "postings")


_OUT = (1 << 63) - 1


def _vocabulary(item_terms: DataFrame) -> np.ndarray | None:
    distinct = item_terms.select("term").distinct()
    if distinct.count() > VOCABULARY_BOUND:
        return None
    return np.sort(np.array([r["term"] for r in distinct.collect()], dtype=np.int64))


def _anchors(item_terms: DataFrame, index: DataFrame, min_words: int) -> DataFrame:
    """(item_id, pair, apos, next): for every window of min_words terms of an item its rarest pair and its place.

    next holds the pairs and places of the FILTERS next rarest ones. Windows with a pair that the index lacks
    can match nothing and are left out.
    """
    freq = index.where("pair is not null").groupBy("pair").agg(F.count(F.lit(1)).alias("_freq"))
    window = Window.partitionBy("item_id").orderBy("ipos").rowsBetween(0, min_words - 2)
    rated = item_terms.where("pair is not null").join(freq, "pair", "left").withColumn("_freq", F.coalesce("_freq", F.lit(0)))
    ranked = rated.select("item_id", "ipos", "n", F.sort_array(F.collect_list(F.struct("_freq", "pair", "ipos", "term")).over(window)).alias("_w"))
    full = ranked.where((F.col("ipos") + F.lit(min_words) <= F.col("n")) & (F.col("_w")[0]["_freq"] > 0))
    rest = F.transform(F.slice("_w", 2, FILTERS), lambda x: F.struct(x["pair"].alias("pair"), x["ipos"].alias("ipos")))
    return full.select("item_id", F.col("_w")[0]["pair"].alias("pair"), F.col("_w")[0]["ipos"].alias("apos"), rest.alias("next")).distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, min_words: int = 12) -> DataFrame:
    """(doc_id, item_id, doc_from, item_from, words): maximal common passages of at least min_words words.

    docs: doc_id, text. items: item_id, texto. Words are unbroken runs of letters and
    digits without case and accents; what stands between them is ignored. Cases: null or
    empty texts and null doc_ids match nothing, items shorter than min_words neither;
    repeated rows repeat their matches; texts of any length are searched whole; extra
    columns are ignored.
    """
    if min_words < FILTERS + 2:
        raise ValueError(f"min_words must be at least {FILTERS + 2}")
    item_terms = materialize(_item_postings(items), "items")
    index = build_index(docs, _vocabulary(item_terms), min_words)
    anchors = _anchors(item_terms, index, min_words)
    starts = index.join(anchors, "pair").select("run", "doc_id", "item_id", (F.col("pos") - F.col("apos")).alias("shift"), "next").distinct()
    # The lists of the next rarest pairs thin the candidates before all terms are asked for.
    for k in range(FILTERS):
        there = F.get("next", F.lit(k))
        asked = starts.withColumns({"pair": there["pair"], "pos": F.col("shift") + there["ipos"]})
        starts = asked.join(index.select("run", "pos", "pair"), ["run", "pos", "pair"], "left_semi").select("run", "doc_id", "item_id", "shift", "next")
    starts = starts.select("run", "doc_id", "item_id", "shift").distinct()
    wanted = starts.join(item_terms, "item_id").select("run", "doc_id", "item_id", "shift", "ipos", "term", (F.col("shift") + F.col("ipos")).alias("pos"))
    met = wanted.join(index.select("run", "pos", "term"), ["run", "pos", "term"]).select("run", "doc_id", "item_id", "shift", "ipos").distinct()
    order = Window.partitionBy("run", "doc_id", "item_id", "shift").orderBy("ipos")
    islands = met.withColumn("_island", F.col("ipos") - F.row_number().over(order))
    found = islands.groupBy("run", "doc_id", "item_id", "shift", "_island").agg(F.min("ipos").alias("item_from"), F.count(F.lit(1)).cast("int").alias("words"))
    return found.where(F.col("words") >= min_words).select("doc_id", "item_id", (F.col("shift") + F.col("item_from")).alias("doc_from"), "item_from", "words")


def _numbered(docs: DataFrame, vocabulary: np.ndarray | None) -> DataFrame:
    """(doc_id, terms): the number of every word of docs (doc_id, text), _OUT for words outside vocabulary; texts without any word of it are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if vocabulary is None else set(vocabulary.tolist())
        number = WordNumbers(term_number if known is None else lambda w: n if (n := term_number(w)) in known else _OUT)
        for batch in batches:
            ids, lists = [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = np.frombuffer(number(text), dtype=np.int64) if text else ()
                if len(terms) and (terms != _OUT).any():
                    ids.append(doc)
                    lists.append(terms)
            if ids:
                ends = pa.array(np.cumsum([0, *map(len, lists)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(lists)))], names=["doc_id", "terms"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return materialize(rows.mapInArrow(run, "doc_id bigint, terms array<bigint>"), "numbered")


def _term_counts(numbered: DataFrame) -> DataFrame:
    """(term, n): how often each known term occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = batch.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["term", "n"])

    each = numbered.select("terms").mapInArrow(run, "term bigint, n bigint")
    return each.where(F.col("term") != F.lit(_OUT)).groupBy("term").agg(F.sum("n").alias("n"))


class _Near:
    """Items of one block as arrays, and the search for windows of them nearly in place.

    Of a window of m terms at most m - min_words may be missing, so of any m - min_words + 1
    of its terms one is in place: the rarest ones are the anchors. Where an anchor stands in
    a text, the shift of the window is known up to slop, and each such shift is tried.
    """

    def __init__(self, items: dict[int, list[int]], counts: dict[int, int], min_words: int, slop: int):
        self.min_words, self.slop, self.reach = min_words, slop, min_words + slop
        self.vocabulary = np.unique(np.array([t for ts in items.values() for t in ts], dtype=np.int64))
        rare = np.array([counts.get(t, 0) for t in self.vocabulary.tolist()], dtype=np.int64)
        gap = np.full(self.reach, -2, dtype=np.int32)
        parts, anchors, at = [gap], set(), len(gap)
        owner = [np.full(len(gap), -1, dtype=np.int64)]
        for item, terms in items.items():
            ids = np.searchsorted(self.vocabulary, np.array(terms, dtype=np.int64)).astype(np.int32)
            size = min(self.reach, len(ids))
            if size < min_words:
                continue
            order = rare[ids]
            for k in range(len(ids) - size + 1):
                anchors.update((at + k + np.argsort(order[k : k + size], kind="stable")[: size - min_words + 1]).tolist())
            parts += [ids, gap]
            owner += [np.full(len(ids), item, dtype=np.int64), np.full(len(gap), -1, dtype=np.int64)]
            at += len(ids) + len(gap)
        self.flat, self.owner = np.concatenate(parts), np.concatenate(owner)
        places = np.array(sorted(anchors), dtype=np.int64)
        terms = self.flat[places] if len(places) else np.empty(0, np.int32)
        self.places = places[np.argsort(terms, kind="stable")]
        self.many = np.bincount(terms, minlength=len(self.vocabulary))
        self.first = np.cumsum(self.many) - self.many

    def search(self, terms: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, item and terms in place of every match in texts whose numbered words lie one after the other in terms."""
        side = self.reach - 1 + 2 * self.slop
        at = np.minimum(np.searchsorted(self.vocabulary, terms), len(self.vocabulary) - 1)
        ids = np.where(self.vocabulary[at] == terms, at, -1).astype(np.int32)
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        place = np.arange(len(terms)) + side * (row + 1)
        flat = np.full(len(terms) + side * len(ends), -1, dtype=np.int32)
        flat[place] = ids
        hit = np.flatnonzero((ids >= 0) & (self.many[ids] > 0))
        found: list[tuple] = [(np.empty(0, np.int64),) * 3]
        # Parts of bounded size, though a frequent term may be an anchor of many items.
        total = np.cumsum(self.many[ids[hit]])
        for low in range(0, int(total[-1]) if len(total) else 0, STARTS):
            k = np.arange(low, min(low + STARTS, int(total[-1])))
            h = np.searchsorted(total, k, side="right")
            w = hit[h]
            anchor = self.places[self.first[ids[w]] + k - (total[h] - self.many[ids[w]])]
            ok, best = self._verify(flat, place[w], anchor)
            found.append((row[w[ok]], self.owner[anchor[ok]], best))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _verify(self, flat: np.ndarray, pos: np.ndarray, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which starts (place in the text, place of the anchor) belong to a match, and its greatest number of terms in place."""
        r, s = self.reach, self.slop
        wanted = self.flat[anchor[:, None] + np.arange(1 - r, r)]
        there = flat[pos[:, None] + np.arange(1 - r - 2 * s, r + 2 * s)]
        met = np.stack([wanted == there[:, e : e + 2 * r - 1] for e in range(4 * s + 1)])
        ok = np.flatnonzero(met.any(axis=0).sum(axis=1) >= self.min_words)
        met, best = met[:, ok], np.zeros(len(ok), dtype=np.int64)

        def windowed(x: np.ndarray) -> np.ndarray:
            sums = np.concatenate([np.zeros((len(x), 1), np.int64), np.cumsum(x, axis=1)], axis=1)
            return sums[:, r:] - sums[:, :-r]

        for shift in range(s, 3 * s + 1):
            inside = windowed(met[shift - s : shift + s + 1].any(axis=0))
            best = np.maximum(best, np.where(windowed(met[shift]) > 0, inside, 0).max(axis=1))
        fine = best >= self.min_words
        return ok[fine], best[fine]


def proximity_matches(docs: DataFrame, items: DataFrame, min_words: int = 12, slop: int = 2, block: int = ITEM_WORDS) -> DataFrame:
    """(doc_id, item_id, termos): documents that hold at least min_words terms of one window of an item nearly in place.

    A window is min_words + slop terms of the item, or all of a shorter one; a term is in
    place if its distance from some term of the window that the document holds differs by at
    most slop from that in the item; termos is the greatest number in place. The words of
    all documents are numbered and stored once; the items are handed to every task in
    blocks of about so many words, each with one pass over the stored numbers. Cases as in
    phrase_matches, whose documents are all among these.
    """
    item_terms = materialize(_item_postings(items), "items")
    numbered = _numbered(docs, _vocabulary(item_terms))
    counts = materialize(_term_counts(numbered), "counts")
    blocks = -(-max(1, item_terms.count()) // block)
    found = []
    for k in range(blocks):
        mine = item_terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        listed = mine.groupBy("item_id", "ipos", "term").count().groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("ipos", "term")))["term"].alias("terms"))
        often = counts.join(mine.select("term").distinct(), "term", "left_semi")
        near = _Near({r["item_id"]: r["terms"] for r in listed.collect()}, dict(map(tuple, often.collect())), min_words, slop)

        def run(batches: Iterator[pa.RecordBatch], near: _Near = near) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                terms = batch.column(1)
                ids = batch.column(0).to_numpy()
                if len(near.places) and batch.num_rows:
                    row, item, best = near.search(terms.flatten().to_numpy(), terms.offsets.to_numpy() - terms.offsets[0].as_py())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(item), pa.array(best.astype(np.int32))], names=["doc_id", "item_id", "termos"])

        found.append(numbered.mapInArrow(run, "doc_id bigint, item_id bigint, termos int"))
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.max("termos").alias("termos"))
