"""Toxicity by a linear-chain conditional random field over the words of a text.

Labels are given for documents, so words are labelled first: strings (words and word beginnings) that stand in
far more toxic than clean labelled documents, by the likelihood ratio, are the lexicon; a word of a toxic
document is toxic if it has a string of the lexicon, and no word of a clean document is. A two-state chain
with a weight for each string of the lexicon and for each step from state to state is fitted to these words.
Forward and backward recursions give the probability of each word being toxic; their sum, largest value and
density give the document's score by logistic regression on the labelled documents.

With two states the recursions are kept as odds, one number for each text, and texts are worked on side by
side, one word of each at a step.

Defined results: null and empty texts get the score of a text without a toxic word; repeated rows get the
same result each; an empty table gives an empty result; without a labelled text of both kinds all scores are
0; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.langid import held_out
from textmill.llm.tokens import Words, in_pieces, words_of

#: Lengths of word beginnings; labelled documents, and characters of them, that the model is fitted on at most (about).
BEGINNINGS, TRAIN_DOCS, TRAIN_CHARS = (4, 5, 6, 7, 8), 12000, 1 << 26
#: Least likelihood ratio (G squared), least documents and least ratio of shares for a string of the lexicon.
LEAST_G, LEAST_DOCS, LEAST_RATIO = 28.0, 4, 3.0
TOXIC_FROM = 0.3


def string_hashes(w: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes) of the whole words and of their beginnings, told apart by length."""
    all_words = np.arange(len(w.start))
    out = [(all_words, w.hashes(w.start, w.stop) ^ np.uint64(1))]
    for n in BEGINNINGS:
        at = np.flatnonzero(w.stop - w.start > n)
        out.append((at, w.hashes(w.start[at], w.start[at] + n) * np.uint64(2 * n + 1)))
    return out


class Lexicon:
    def __init__(self, strings: np.ndarray):
        self.strings = np.sort(strings)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.strings >> np.uint64(44)).astype(np.int64)] = True

    def find(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(words, places in the lexicon) of all its strings in w."""
        words, places = [], []
        if len(self.strings):
            for at, h in string_hashes(w):
                hit = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
                k = np.minimum(np.searchsorted(self.strings, h[hit]), len(self.strings) - 1)
                same = self.strings[k] == h[hit]
                words.append(at[hit[same]])
                places.append(k[same])
        return (np.concatenate(words), np.concatenate(places)) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def document_counts(texts: list[str], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Strings of the texts and the number of texts that have each; only: no others than these (sorted)."""
    found = []
    for piece in in_pieces(texts):
        w = words_of(piece)
        doc = np.repeat(np.arange(len(piece)), np.diff(w.first))
        for at, h in string_hashes(w):
            if only is not None:
                keep = only[np.minimum(np.searchsorted(only, h), len(only) - 1)] == h
                at, h = at[keep], h[keep]
            d = doc[at]
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            found.append(h[np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])] if len(h) else h)
    return np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def learn_lexicon(toxic: list[str], clean: list[str]) -> np.ndarray:
    strings, pos = document_counts(toxic)
    strings, pos = strings[pos >= LEAST_DOCS], pos[pos >= LEAST_DOCS]
    if not len(strings):
        return strings
    seen, n = document_counts(clean, strings)
    neg = np.zeros(len(strings))
    neg[np.searchsorted(strings, seen)] = n
    a, b = len(toxic), len(clean)
    share = (pos + neg) / (a + b)

    def part(x, all_):
        e = share * all_
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(x > 0, x * np.log(x / e), 0) + np.where(all_ - x > 0, (all_ - x) * np.log((all_ - x) / (all_ - e)), 0)

    g = 2 * (part(pos, a) + part(neg, b))
    keep = np.flatnonzero((g >= LEAST_G) & (pos / a >= LEAST_RATIO * (neg + 0.5) / (b + 1)))
    return strings[keep]


class Chain:
    """bias and weight: log odds of the toxic state by word; steps[i, j]: weight of going from state i to j (1: toxic)."""

    def __init__(self, size: int):
        self.weight, self.bias, self.steps = np.zeros(size), -2.0, np.zeros((2, 2))

    def emissions(self, n: int, words: np.ndarray, places: np.ndarray) -> np.ndarray:
        return np.clip(self.bias + np.bincount(words, weights=self.weight[places], minlength=n)[:n], -30, 30)

    def marginals(self, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word the probability of the toxic state, and the odds that come in from the left and the right."""
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        start, n = first[:-1][order], n[order]
        steps = int(n.max(initial=0))
        odds, (oo, ot, to, tt) = np.exp(emission), np.exp(self.steps).ravel()
        left, right = np.ones(len(emission)), np.ones(len(emission))
        active = np.searchsorted(-n, -np.arange(steps), side="left")
        r = np.ones(0)
        for t in range(steps):
            at = start[: active[t]] + t
            if t:
                r = r[: len(at)]
                r = (tt * r + ot) / (to * r + oo)
            else:
                r = np.ones(len(at))
            left[at] = r
            r = r * odds[at]
        r = np.ones(0)
        for t in range(steps - 1, -1, -1):
            at = start[: active[t]] + t
            if len(at) > len(r):
                r = np.concatenate([r, np.full(len(at) - len(r), -1.0)])
            had = r >= 0
            r = np.where(had, (tt * np.abs(r) + to) / (ot * np.abs(r) + oo), 1.0)
            right[at] = r
            r = r * odds[at]
        all_ = left * odds * right
        return all_ / (1 + all_), left, right

    def fit(self, n: int, words: np.ndarray, places: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: int = 120, rate: float = 0.15) -> None:
        """Adam on the log likelihood with a small penalty on squared weights."""
        if not n:
            return
        inner = np.ones(n, bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        at = np.flatnonzero(inner)  # words with a word before them
        seen = np.bincount(label[at - 1] * 2 + label[at], minlength=4) / n
        size = len(self.weight) + 5
        m, v = np.zeros(size), np.zeros(size)
        for k in range(1, rounds + 1):
            e = self.emissions(n, words, places)
            p, left, right = self.marginals(e, first)
            before, after = left[at - 1] * np.exp(e[at - 1]), right[at] * np.exp(e[at])
            joint = np.stack([np.ones(len(at)), after, before, before * after], 1) * np.exp(self.steps).ravel()
            joint = (joint / joint.sum(1, keepdims=True)).sum(0) / n
            grad = np.concatenate([np.bincount(places, weights=(p - label)[words], minlength=len(self.weight)) / n + 1e-5 * self.weight, [(p - label).mean()], joint - seen + 1e-4 * self.steps.ravel()])
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            step = rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
            self.weight -= step[:-5]
            self.bias -= step[-5]
            self.steps = np.clip(self.steps - step[-4:].reshape(2, 2), -6, 6)


class Model:
    def __init__(self, lexicon: Lexicon, chain: Chain):
        self.lexicon, self.chain, self.final = lexicon, chain, np.zeros(4)
        #: The marginal of a word far from any string of the lexicon.
        self.quiet = float(chain.marginals(np.full(257, np.clip(chain.bias, -30, 30)), np.array([0, 257]))[0][128])

    def word_marginals(self, texts: list[str]) -> tuple[Words, np.ndarray]:
        w = words_of(texts)
        words, places = self.lexicon.find(w)
        return w, self.chain.marginals(self.chain.emissions(len(w.start), words, places), w.first)[0]

    def signals_of(self, w: Words, p: np.ndarray) -> np.ndarray:
        """Texts x (1, log of the sum, largest, log of the density) of the marginals over what a word far from hits has."""
        texts = len(w.first) - 1
        over = np.maximum(p - self.quiet, 0)
        doc, n = np.repeat(np.arange(texts), np.diff(w.first)), np.maximum(np.diff(w.first), 1)
        total, most = np.bincount(doc, weights=over, minlength=texts), np.zeros(texts)
        np.maximum.at(most, doc, over)
        return np.stack([np.ones(texts), np.log1p(total), most, np.log1p(1000 * total / n)], 1)

    def signals(self, texts: list[str]) -> np.ndarray:
        out = [self.signals_of(*self.word_marginals(piece)) for piece in in_pieces(texts)]
        return np.concatenate(out) if out else np.zeros((0, 4))

    def scores(self, texts: list[str]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.signals(texts) @ self.final, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.5) -> np.ndarray:
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.diag([0.01] + [1.0] * (x.shape[1] - 1))
        step = np.linalg.solve(h, x.T @ (p - y) + penalty * np.array([0.01] + [1.0] * (x.shape[1] - 1)) * b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(texts: list[str], label: np.ndarray) -> Model | None:
    toxic, clean = [t for t, y in zip(texts, label, strict=True) if y], [t for t, y in zip(texts, label, strict=True) if not y]
    if not toxic or not clean:
        return None
    lexicon = Lexicon(learn_lexicon(toxic, clean))
    chain = Chain(len(lexicon.strings))
    # Segments: words with a string of the lexicon and two words on either side.
    seg_words, seg_places, seg_first, seg_label, n, done = [], [], [0], [], 0, 0
    for piece in in_pieces(texts):
        w = words_of(piece)
        words, places = lexicon.find(w)
        doc = np.repeat(np.arange(len(piece)), np.diff(w.first))
        near = np.zeros(len(w.start) + 4, bool)
        for k in range(5):
            near[words + k] = True
        at = np.flatnonzero(near[2:-2])
        hit = np.zeros(len(w.start), bool)
        hit[words] = True
        new = np.concatenate([[True], (np.diff(at) > 1) | (np.diff(doc[at]) > 0)]) if len(at) else np.zeros(0, bool)
        place = np.cumsum(near[2:-2]) - 1
        seg_words.append(place[words] + n)
        seg_places.append(places)
        seg_first += (np.flatnonzero(new) + n).tolist()[(1 if n == 0 else 0) :]
        seg_label.append((hit[at] & (label[done : done + len(piece)][doc[at]] == 1)).astype(int))
        n += len(at)
        done += len(piece)
    first = np.array([*seg_first, n])
    chain.fit(n, np.concatenate(seg_words), np.concatenate(seg_places), first, np.concatenate(seg_label))
    model = Model(lexicon, chain)
    model.final = logistic(model.signals(texts), label.astype(float))
    return model


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_chars: int = TRAIN_CHARS, seed: int = 9) -> Model | None:
    """The model from docs(text, toxic 0 or 1, and maybe text_length), on about train_docs of them, and train_chars of their texts, taken by a hash of doc_id and text (of the text alone, copies would come all or none); fitted in one task, as the sample is bounded."""
    key = [c for c in ("doc_id", "text") if c in docs.columns]
    # Lengths that come with the rows spare the texts the way to where docs are joined to their labels.
    length = F.col("text_length") if "text_length" in docs.columns else F.length("text")
    d = docs.where("toxic IS NOT NULL")
    total, chars = d.agg(F.count("*"), F.coalesce(F.sum(length), F.lit(0))).first()
    d = d.withColumns({"text": F.coalesce("text", F.lit("")), "toxic": F.col("toxic").cast("int")}).select("toxic", *key)
    if not total:
        return None
    share = min(1.0, train_docs / total, train_chars / max(1, chars))
    d = d.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if held:
            rows = pd.concat(held).sort_values(["text", "toxic"], ignore_index=True)
            yield pd.DataFrame({"model": [pickle.dumps(learn(rows["text"].tolist(), rows["toxic"].to_numpy()))]})

    made = d.select("text", "toxic").repartition(1).mapInPandas(run, "model binary").collect()
    return pickle.loads(made[0][0]) if made else None


def score_toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and spans (offsets in the text of runs of words that are toxic with 0.5 and more), one row per row of docs."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if model is None:
        return d.select("doc_id", F.lit(0.0).alias("score"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))
    held = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon's bound, whatever the input

    def run(series: pd.Series) -> pd.DataFrame:
        model, scores, spans = held.value, [], []
        for texts in in_pieces(series):
            w, p = model.word_marginals(texts)
            doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
            scores.append(1 / (1 + np.exp(-np.clip(model.signals_of(w, p) @ model.final, -30, 30))))
            own: list[list[dict]] = [[] for _ in texts]
            at = np.flatnonzero(p >= 0.5)
            for k in np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(doc[at]) > 0)) + 1) if len(at) else []:
                i = doc[k[0]]
                own[i].append({"start": int(w.start[k[0]] - w.base[i]), "stop": int(w.stop[k[-1]] - w.base[i])})
            spans += own
        return pd.DataFrame({"score": np.concatenate(scores) if scores else [], "spans": spans})

    found = F.pandas_udf(run, "score double, spans array<struct<start:int,stop:int>>")
    return d.select("doc_id", found("text").alias("f")).select("doc_id", "f.score", "f.spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    train = docs.select("doc_id", "text", F.length("text").alias("text_length")).where(~held_out(F.col("doc_id"), 4, 2)).join(labels, "doc_id")
    out = score_toxicity(docs, fit(train))
    return out.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "spans")
