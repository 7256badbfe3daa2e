"""Linear-chain CRF tagger in numpy: fitted on a bounded sample, applied in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from garimpo.functions import patterns as P
from garimpo.operators.sampling import shuffled
from garimpo.shared import materialize

#: Most sentences that a model is fitted on.
SENTENCES = 5_000


def features(tokens: list[str]) -> list[list[str]]:
    """Names of the active features of each token: form, affixes, shape, and the same of its neighbours."""

    def own(t: str, at: str) -> list[str]:
        low = t.lower()
        flags = (t.isupper(), t.istitle(), t.isdigit(), t.rstrip(".") in P.ABBREVIATIONS, t.startswith("__") and t.endswith("__"))
        return [f"{at}={low}", f"{at}^{low[:3]}", f"{at}${low[-3:]}", f"{at}?{''.join('01'[f] for f in flags)}"]

    out = []
    for i, t in enumerate(tokens):
        row = ["bias", *own(t, "0")]
        for k in (-2, -1, 1, 2):
            row += own(tokens[i + k], str(k)) if abs(k) == 1 and 0 <= i + k < len(tokens) else [f"{k}={tokens[i + k].lower()}"] if 0 <= i + k < len(tokens) else [f"{k}=none"]
        out.append(row)
    return out


@dataclass
class Crf:
    """Weights of a fitted chain: index of features, labels, state weights and transitions."""

    index: dict[str, int]
    labels: list[str]
    state: np.ndarray
    move: np.ndarray
    losses: list[float]

    def _scores(self, tokens: list[str]) -> np.ndarray:
        out = np.zeros((len(tokens), len(self.labels)))
        for i, row in enumerate(features(tokens)):
            at = [self.index[f] for f in row if f in self.index]
            if at:
                out[i] = self.state[at].sum(axis=0)
        return out

    def tag(self, tokens: list[str]) -> list[str]:
        """Best label sequence (Viterbi)."""
        if not tokens:
            return []
        s = self._scores([t or "" for t in tokens])
        back = np.zeros(s.shape, dtype=int)
        best = s[0]
        for i in range(1, len(s)):
            both = best[:, None] + self.move
            back[i] = both.argmax(axis=0)
            best = both.max(axis=0) + s[i]
        at = int(best.argmax())
        path = [at]
        for i in range(len(s) - 1, 0, -1):
            at = int(back[i, at])
            path.append(at)
        return [self.labels[k] for k in reversed(path)]

    def top_features(self, n: int = 5) -> pd.DataFrame:
        names = np.array(list(self.index))
        rows = [(lab, names[i], float(self.state[i, k])) for k, lab in enumerate(self.labels) for i in np.argsort(-self.state[:, k], kind="stable")[:n]]
        return pd.DataFrame(rows, columns=["label", "atributo", "peso"])

    def top_moves(self, n: int = 10) -> pd.DataFrame:
        rows = [(a, b, float(self.move[i, j])) for i, a in enumerate(self.labels) for j, b in enumerate(self.labels)]
        return pd.DataFrame(rows, columns=["de", "para", "peso"]).sort_values(["peso", "de", "para"], ascending=[False, True, True]).head(n)

    def convergence(self, tolerance: float = 1e-3) -> dict:
        done = len(self.losses)
        last = abs(self.losses[-1] - self.losses[-2]) / max(abs(self.losses[-2]), 1e-9) if done > 1 else float("inf")
        return {"iteracoes": done, "convergiu": last < tolerance, "perda": self.losses[-1] if done else None, "ultima_mudanca": last}


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit_crf(sentences: list[tuple[list[str], list[str]]], epochs: int = 12, rate: float = 0.2, ridge: float = 1e-4, least: int = 1, seed: int = 42) -> Crf:
    """Maximum likelihood by AdaGrad with a ridge penalty over (tokens, labels); features seen fewer than `least` times are left out."""
    seen: dict[str, int] = {}
    rows = []
    for tokens, _ in sentences:
        rows.append(features([t or "" for t in tokens]))
        for row in rows[-1]:
            for f in row:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(f for f, n in seen.items() if n >= least)}
    names = sorted({x for _, ls in sentences for x in ls} | {"O"})
    at = {x: i for i, x in enumerate(names)}
    data = [([[index[f] for f in row if f in index] for row in r], [at[x] for x in ls]) for r, (_, ls) in zip(rows, sentences) if ls]
    state, move = np.zeros((len(index), len(names))), np.zeros((len(names), len(names)))
    gs, gm = np.full_like(state, 1e-2), np.full_like(move, 1e-2)
    rng = np.random.default_rng(seed)
    losses: list[float] = []
    for _ in range(epochs):
        total = 0.0
        for k in rng.permutation(len(data)):
            feats, y = data[k]
            n = len(y)
            s = np.stack([state[f].sum(axis=0) for f in feats])
            fwd, bwd = np.zeros_like(s), np.zeros_like(s)
            fwd[0] = s[0]
            for i in range(1, n):
                fwd[i] = s[i] + _logsum(fwd[i - 1][:, None] + move, 0)
            for i in range(n - 2, -1, -1):
                bwd[i] = _logsum(move + (s[i + 1] + bwd[i + 1])[None, :], 1)
            z = float(_logsum(fwd[-1][None, :], 1)[0])
            total += z - s[np.arange(n), y].sum() - sum(move[a, b] for a, b in zip(y, y[1:]))
            p = np.exp(fwd + bwd - z)
            p[np.arange(n), y] -= 1
            pair = ridge * move
            for i in range(1, n):
                pair = pair + np.exp(fwd[i - 1][:, None] + move + (s[i] + bwd[i])[None, :] - z)
                pair[y[i - 1], y[i]] -= 1
            gm += pair**2
            move -= rate * pair / np.sqrt(gm)
            for f, g in zip(feats, p):
                d = g + ridge * state[f]
                gs[f] += d**2
                state[f] -= rate * d / np.sqrt(gs[f])
        losses.append(total / max(1, len(data)))
        if len(losses) > 1 and abs(losses[-2] - losses[-1]) < 1e-3 * abs(losses[-2]):
            break
    return Crf(index, names, state, move, losses)


def training_sample(labelled: DataFrame, most: int = SENTENCES, seed: int = 42) -> list[tuple[list[str], list[str]]]:
    """At most `most` sentences (tokens, labels), the first in a fixed random order.

    The count of sentences gives the part of the hash's range that holds a few more than
    that, so all tasks together, not each of them, send about `most` rows.
    """
    order = shuffled(F.col("sentenca_id"), seed)
    rows = materialize(labelled.select("sentenca_id", "tokens", "labels"), "labelled")
    enough = (most + 6 * most**0.5 + 20) / max(1, rows.count())
    if enough < 1:
        rows = rows.where(F.substring(order, 1, 8) <= F.lit(f"{int(enough * 0xFFFFFFFF):08x}"))
    return [(list(r["tokens"]), list(r["labels"])) for r in rows.orderBy(order, "sentenca_id").limit(most).collect()]


def align_labels(word_ids: list[int | None], labels: list[int], ignore: int = -100) -> list[int]:
    """Labels of subwords: the first subword of a word has its label, all others are ignored."""
    out, last = [], None
    for w in word_ids:
        out.append(ignore if w is None or w == last else labels[w])
        last = w
    return out


def windows(n: int, size: int = 512, stride: int = 64) -> list[tuple[int, int]]:
    """Overlapping windows over n subwords: each starts `stride` before the end of the one before."""
    if stride >= size:
        raise ValueError("stride must be smaller than size")
    spans, at = [], 0
    while True:
        spans.append((at, min(n, at + size)))
        if at + size >= n:
            return spans
        at += size - stride


def fits(count: Callable[[list[str]], int], words: list[str], limit: int, step: int = 20) -> list[str]:
    """words without as many trailing steps as it takes to stay within limit subwords."""
    while len(words) > step and count(words) > limit:
        words = words[:-step]
    return words


def save(model: Crf, spark, path: str) -> None:
    """Weights as a Parquet table: (atributo, label, peso) for states, ('>' label, label, peso) for transitions."""
    rows = [(f, x, float(model.state[i, k])) for f, i in model.index.items() for k, x in enumerate(model.labels)]
    rows += [(f">{a}", b, float(model.move[i, j])) for i, a in enumerate(model.labels) for j, b in enumerate(model.labels)]
    spark.createDataFrame(pd.DataFrame(rows, columns=["atributo", "label", "peso"])).write.mode("overwrite").parquet(path)


def load(spark, path: str) -> Crf:
    table = spark.read.parquet(path).toPandas()
    labels = sorted(table["label"].unique())
    at = {x: k for k, x in enumerate(labels)}
    moves = table[table["atributo"].isin({f">{x}" for x in labels})]
    states = table[~table["atributo"].isin({f">{x}" for x in labels})]
    index = {f: i for i, f in enumerate(dict.fromkeys(states["atributo"]))}
    state, move = np.zeros((len(index), len(labels))), np.zeros((len(labels), len(labels)))
    for f, x, w in states.itertuples(index=False):
        state[index[f], at[x]] = w
    for f, x, w in moves.itertuples(index=False):
        move[at[f[1:]], at[x]] = w
    return Crf(index, labels, state, move, [])
