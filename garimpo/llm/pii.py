"""Personal information in free text, found and replaced by typed placeholders.

Method: candidate gradient boosting. High-recall generators (pii_spans.py) propose
overlapping spans, boosted trees judge them by format and context, and thresholds
calibrated on held-out sentences select the redactions. The trees learn from annotated
sentences, whose labels come from the consensus of the annotators.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.llm import pii_spans
from garimpo.llm.boosting import BoostedTrees
from garimpo.llm.consensus import consensus
from garimpo.shared import materialize

#: Most annotated sentences that the classifier is fitted on (drawn by a hash of their id).
SENTENCES = 8_000
#: Share of them kept for calibration, and decisions remembered by a worker.
HELD_OUT, MEMORY = 0.25, 1 << 18
#: Parts of the training rows of which each is encoded by the others.
FOLDS = 5

# Label type of the annotators for each type of finding.
LABEL_OF = {"PESSOA": "PESSOA", "TELEFONE": "CONTATO", "EMAIL": "CONTATO", "DOCUMENTO": "DOCUMENTO", "ENDERECO": "ENDERECO"}
#: Types that one kind of candidate may turn out to be.
MAY_BE = {"NUMERO": ("TELEFONE", "DOCUMENTO"), "PESSOA": ("PESSOA",), "EMAIL": ("EMAIL",), "ENDERECO": ("ENDERECO",)}
#: Slots of a candidate's key whose combinations are features of their own.
_CROSS = {"PESSOA": ((1, 2), (2, 3), (1, 4)), "NUMERO": ((1, 7), (2, 7), (4, 5)), "ENDERECO": ((1, 3), (1, 5)), "EMAIL": ((1, 5),)}


def _flat(key: tuple) -> list:
    out: list = []
    for v in key:
        out.extend(v) if isinstance(v, tuple) else out.append(v)
    return out


@dataclass
class _Encoder:
    """Numbers from the slots of candidate keys; words become the smoothed log-odds of their cases."""

    kind: str
    prior: float = 0.0
    odds: dict[int, dict] = field(default_factory=dict)
    crossed: dict[tuple, dict] = field(default_factory=dict)

    def fit(self, keys: list[tuple], y: np.ndarray) -> _Encoder:
        rows = [_flat(k) for k in keys]
        rate = (y.sum() + 1) / (len(y) + 2)
        self.prior = float(np.log(rate / (1 - rate)))

        def table(values: list) -> dict:
            pos, n = Counter(), Counter()
            for v, t in zip(values, y):
                n[v] += 1
                pos[v] += int(t)
            return {v: float(np.log((pos[v] + 4 * rate) / (n[v] - pos[v] + 4 * (1 - rate)))) for v in n}

        for i in range(1, len(rows[0]) if rows else 0):
            if isinstance(rows[0][i], str):
                self.odds[i] = table([r[i] for r in rows])
        for pair in _CROSS.get(self.kind, ()):
            self.crossed[pair] = table([(r[pair[0]], r[pair[1]]) for r in rows]) if rows else {}
        return self

    def vector(self, key: tuple) -> list[float]:
        row = _flat(key)
        out = [self.odds[i].get(v, self.prior) if i in self.odds else float(v) if not isinstance(v, str) else self.prior for i, v in enumerate(row) if i]
        out.extend(t.get((row[a], row[b]), self.prior) for (a, b), t in self.crossed.items())
        return out


@dataclass
class PiiModel:
    """Known name words, words that are none, and, per type, an encoder and its trees."""

    names: frozenset[str]
    common: frozenset[str]
    judges: dict[str, tuple[_Encoder, BoostedTrees]]

    def __post_init__(self):
        self._known: dict[tuple, tuple[str, float]] = {}
        self._machine = None

    def __getstate__(self):
        return {"names": self.names, "common": self.common, "judges": self.judges}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def candidates(self, folded: str) -> list[pii_spans.Candidate]:
        if self._machine is None:
            self._machine = pii_spans.build_machine(self.names)
        return pii_spans.candidates(folded, self._machine, self.names, self.common)

    def decide(self, keys: list[tuple]) -> list[tuple[str, float]]:
        """(type or '', chance) of each candidate key; equal keys are judged once."""
        fresh = list({k for k in keys if k not in self._known})
        if fresh:
            if len(self._known) + len(fresh) > MEMORY:
                self._known.clear()
                fresh = list(set(keys))
            by = defaultdict(list)
            for k in fresh:
                by[k[0]].append(k)
            for kind, ks in by.items():
                best = [("", 0.0)] * len(ks)
                for tipo in MAY_BE[kind]:
                    coder, trees = self.judges[tipo]
                    chance = trees.chance(np.array([coder.vector(k) for k in ks]))
                    best = [(tipo, float(c)) if c >= trees.threshold and c > b[1] else b for b, c in zip(best, chance)]
                self._known.update(zip(ks, best))
        return [self._known[k] for k in keys]

    def find(self, folded: list[str]) -> list[list[tuple[int, int, str]]]:
        """Accepted spans (start, end, type) of each folded text, in order and without overlaps."""
        spans = [self.candidates(t) for t in folded]
        decided = iter(self.decide([c.key for cs in spans for c in cs]))
        out = []
        for cs in spans:
            chosen = [(c.start, c.end, tipo, chance) for c, (tipo, chance) in zip(cs, decided) if tipo]
            out.append(select(chosen))
        return out


#: Which of two overlapping findings stays: a whole address or e-mail before what lies in it, then the likelier, then the longer.
_RANK = {"EMAIL": 0, "ENDERECO": 1, "DOCUMENTO": 2, "TELEFONE": 2, "PESSOA": 3}


def select(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str]]:
    kept: list[tuple[int, int, str]] = []
    for a, b, tipo, _ in sorted(found, key=lambda x: (_RANK[x[2]], -x[3], x[0] - x[1], x[0])):
        if all(b <= c or a >= d for c, d, _ in kept):
            kept.append((a, b, tipo))
    return sorted(kept)


def annotated_sentences(sentences: DataFrame, annotations: DataFrame, adjudications: DataFrame) -> DataFrame:
    """(sentenca_id, tokens, marks) of every annotated sentence with tokens; marks: the labels but O of its tokens by consensus of all annotations."""
    annotated = annotations.select("sentenca_id").distinct()
    chosen = sentences.where("size(tokens) > 0").select("sentenca_id", "tokens").join(annotated, "sentenca_id", "left_semi")
    labels, _, _ = consensus(annotations, sentences, adjudications)
    marks = labels.where("label <> 'O'").groupBy("sentenca_id").agg(F.collect_list(F.struct("posicao", "label")).alias("marks"))
    return materialize(chosen.join(marks, "sentenca_id", "left"), "annotated")


def word_counts(annotated: DataFrame) -> pd.DataFrame:
    """(word, total, named): how often each word of annotated_sentences occurs, and how often as part of a person's name."""
    persons = F.transform(F.filter(F.coalesce("marks", F.array()), lambda m: F.substring(m["label"], 3, 100) == "PESSOA"), lambda m: m["posicao"].cast("int"))
    each = annotated.select(persons.alias("_p"), F.posexplode("tokens").alias("_i", "token"))
    tokens = each.groupBy("token").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.array_contains("_p", F.col("_i"))).alias("named"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(word=[_name_word(t) for t in pdf["token"]])[["word", "total", "named"]]

    folded = tokens.where("token is not null").mapInPandas(run, "word string, total bigint, named bigint").where("word is not null")
    return folded.groupBy("word").agg(F.sum("total").alias("total"), F.sum("named").alias("named")).where("total >= 2").toPandas()


def _sample(annotated: DataFrame, most: int, seed: int) -> pd.DataFrame:
    """The first `most` sentences in the order of a hash.

    The count of sentences gives the part of the hash's range that holds a few more than
    that, so the tasks together, not each of them, send about `most` rows.
    """
    enough = (most + 6 * most**0.5 + 20) / max(1, annotated.count())
    order = F.xxhash64(F.lit(seed), "sentenca_id")
    some = annotated.where(order <= F.lit(int(-(1 << 63) + min(1.0, enough) * ((1 << 64) - 1)))) if enough < 1 else annotated
    return some.orderBy(order, "sentenca_id").limit(most).toPandas()


def training_sentences(sentences: DataFrame, annotations: DataFrame, adjudications: DataFrame, most: int = SENTENCES, seed: int = 42) -> pd.DataFrame:
    """At most `most` annotated sentences (sentenca_id, tokens, marks) with the types of their tokens by consensus."""
    return _sample(annotated_sentences(sentences, annotations, adjudications), most, seed)


def train(sentences: DataFrame, annotations: DataFrame, adjudications: DataFrame, most: int = SENTENCES, seed: int = 42) -> PiiModel:
    """Names and common words from all annotated sentences; encoders, trees and thresholds from at most `most` of them."""
    annotated = annotated_sentences(sentences, annotations, adjudications)
    return fit(_sample(annotated, most, seed), words=word_counts(annotated))


def _name_word(token: str | None) -> str | None:
    """The folded token if it may be a word of a name."""
    w = pii_spans.fold_text(token or "")[0]
    return w if len(w) > 2 and w.isalpha() and w not in pii_spans.LINKS else None


def fit(training: pd.DataFrame, tau: float = 0.2, words: pd.DataFrame | None = None) -> PiiModel:
    """Fit names, encoders and trees on sentences with marks.

    words: word_counts of all annotated sentences; without it those of training are counted.
    A word is a known name word if at least two of its occurrences and a share tau of
    them are marked as a person's. A candidate is a case of a type if most of its tokens
    are marked so; for an address its first token decides.
    """
    texts, spans, total, named = [], [], Counter(), Counter()
    for tokens, marks in zip(training["tokens"], training["marks"]):
        marked = {int(m["posicao"]): m["label"][2:] for m in marks} if isinstance(marks, (list, np.ndarray)) else {}
        at, places = 0, []
        for i, t in enumerate(tokens):
            t = t or ""
            places.append((at, at + len(t), marked.get(i, "")))
            if words is None and (w := _name_word(t)):
                total[w] += 1
                named[w] += marked.get(i) == "PESSOA"
            at += len(t) + 1
        texts.append(" ".join(t or "" for t in tokens))
        spans.append(places)
    if words is not None:
        total = Counter(dict(zip(words["word"], words["total"].tolist())))
        named = Counter(dict(zip(words["word"], words["named"].tolist())))
    never = {*pii_spans.KIN, *pii_spans.TITLES, *pii_spans.STREETS, *pii_spans.PLACES}
    names = frozenset(w for w, n in named.items() if n >= 2 and n >= tau * total[w] and w not in never)
    common = frozenset(w for w, n in total.items() if n >= 2 and not named[w])
    model = PiiModel(names, common, {})
    keys, truth, fold = defaultdict(list), defaultdict(list), defaultdict(list)
    for sid, text, places in zip(training["sentenca_id"], texts, spans):
        held = xxhash.xxh32_intdigest(str(sid)) % 100 < 100 * HELD_OUT
        folded, where = pii_spans.fold_text(text)
        for c in model.candidates(folded):
            a, b = (c.start, c.end) if where is None else (where[c.start], where[c.end - 1] + 1)
            inside = [t for s, e, t in places if s < b and e > a and e > s]
            if c.tipo == "ENDERECO":
                inside = inside[:1]
            for tipo in MAY_BE[c.tipo]:
                hit = sum(t == LABEL_OF[tipo] for t in inside)
                keys[tipo].append(c.key)
                truth[tipo].append(int(2 * hit > len(inside)) if len(inside) else 0)
                fold[tipo].append(held)
    for tipo in pii_spans.TYPES:
        y, held = np.array(truth[tipo], dtype=int), np.array(fold[tipo], dtype=bool)
        kind = "NUMERO" if tipo in MAY_BE["NUMERO"] else tipo
        train = [k for k, h in zip(keys[tipo], held) if not h]
        coder = _Encoder(kind).fit(train, y[~held]) if train else _Encoder(kind)
        x = np.array([coder.vector(k) for k in keys[tipo]]) if keys[tipo] else np.empty((0, 1))
        # Training rows are encoded by the cases of other rows, as any row will be that the model has not seen.
        at = np.flatnonzero(~held)
        for part in range(FOLDS):
            mine = np.arange(len(at)) % FOLDS == part
            others = _Encoder(kind).fit([k for k, m in zip(train, mine) if not m], y[at[~mine]]) if (~mine).any() else coder
            for i in at[mine]:
                x[i] = others.vector(keys[tipo][i])
        model.judges[tipo] = (coder, BoostedTrees().fit(x, y, held))
    return model


def find_pii(notes: DataFrame, model: PiiModel) -> DataFrame:
    """(id, tipo, ordem): one row per finding in notes (id, text); ordem counts the findings of a type in the note from 1.

    Null, empty and blank texts have no findings; repeated rows repeat theirs; whole texts
    are read, however long; extra columns are ignored. No shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = model.find([pii_spans.fold_text(t)[0] for t in pdf["text"]])
            ids, types, order = [], [], []
            for i, spans in zip(pdf["id"].tolist(), found):
                seen = Counter()
                for _, _, tipo in spans:
                    seen[tipo] += 1
                    ids.append(i)
                    types.append(tipo)
                    order.append(seen[tipo])
            if ids:
                yield pd.DataFrame({"id": ids, "tipo": types, "ordem": np.array(order, dtype=np.int32)})

    rows = notes.select(F.col("id").cast("bigint").alias("id"), "text").where("text is not null and id is not null")
    return rows.mapInPandas(run, "id bigint, tipo string, ordem int")


def redact_pii(notes: DataFrame, model: PiiModel) -> DataFrame:
    """(id, text): the notes with [PESSOA], [TELEFONE], [EMAIL], [DOCUMENTO] or [ENDERECO] in place of findings.

    All other text stays as it is, character by character; null texts stay null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["text"]]
            folds = [pii_spans.fold_text(t or "") for t in texts]
            done = []
            for t, (_, where), spans in zip(texts, folds, model.find([f for f, _ in folds])):
                if t is not None:
                    parts, at = [], 0
                    for a, b, tipo in spans:
                        a, b = (a, b) if where is None else (where[a], where[b - 1] + 1)
                        parts += [t[at:a], f"[{tipo}]"]
                        at = b
                    t = "".join(parts) + t[at:]
                done.append(t)
            yield pd.DataFrame({"id": pdf["id"], "text": done})

    return notes.select(F.col("id").cast("bigint").alias("id"), "text").mapInPandas(run, "id bigint, text string")
