"""Language identification: scripts narrow the candidates, Viterbi labels the words, spans make the document's language.

A word's score for a language is the sum of log probabilities of its character pairs and triples (with word
ends) and of the word itself, all hashed to fixed tables. The script of a word, found from code point ranges,
leaves only the languages in which the training texts show that script; a script that no language shows
leaves them all. Viterbi picks the labelling of a text's words with the best sum of scores less PENALTY for
each change of language, so texts of several languages fall into spans.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to the language first
in order; repeated rows get the same result each; an empty table, or one without a training text, gives `und`
for all; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.tokens import Words, in_pieces, words_of

#: First code points of script ranges, with names; a range ends where the next begins. Fixed values.
RANGES = [
    (0x0000, "other"), (0x0041, "latin"), (0x02B0, "other"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"),
    (0x0600, "arabic"), (0x0780, "other"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "other"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "other"), (0x0E00, "thai"),
    (0x0E80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1E00, "latin"), (0x1F00, "greek"),
    (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x32000, "other"),
]
SCRIPTS = sorted({name for _, name in RANGES})
SCRIPT_FROM = np.array([a for a, _ in RANGES])
SCRIPT_OF = np.array([SCRIPTS.index(name) for _, name in RANGES])
#: Slots of each of the three hashed tables; cost of a change of language; texts that the model is fitted on at most (about).
SLOTS, PENALTY, TRAIN_DOCS = 1 << 15, 6.0, 8000
UND = "und"


def features(w: Words) -> list[np.ndarray]:
    """Slots of the pair and triple that end with each letter's right neighbour, and of each word."""
    c = w.codes.astype(np.uint64)
    left, right = np.concatenate([[np.uint64(32)], c[:-1]]), np.concatenate([c[1:], [np.uint64(32)]])

    def slot(h: np.ndarray) -> np.ndarray:
        h = h * np.uint64(0x9E3779B97F4A7C15)
        return (h >> np.uint64(49)).astype(np.int32)

    two, three = slot(c * np.uint64(2097169) + right), slot((left * np.uint64(2097169) + c) * np.uint64(2097169) + right)
    return [two, three, (w.hashes(w.start, w.stop) >> np.uint64(49)).astype(np.int32)]


def scripts_of(w: Words) -> np.ndarray:
    return SCRIPT_OF[np.searchsorted(SCRIPT_FROM, w.codes[w.start], side="right") - 1]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of a partition by language: slots of the three tables one after the other, then scripts (in letters)."""
    size = 3 * SLOTS + len(SCRIPTS)
    counts: dict[str, np.ndarray] = {}
    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            into = counts.setdefault(lang, np.zeros(size, np.int64))
            for texts in in_pieces(group["text"]):
                w = words_of(texts)
                two, three, whole = features(w)
                letters = w.codes != 32
                for k, s in enumerate((two[letters], three[letters], whole)):
                    into[k * SLOTS : (k + 1) * SLOTS] += np.bincount(s, minlength=SLOTS)
                into[3 * SLOTS :] += np.bincount(scripts_of(w), weights=w.stop - w.start, minlength=len(SCRIPTS)).astype(np.int64)
    for lang, into in counts.items():
        at = np.flatnonzero(into)
        yield pd.DataFrame({"lang": lang, "slot": at, "n": into[at]})


class Model:
    """Log probabilities (table slots x languages) and the languages that each script leaves."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        self.tables = []
        for k in range(3):
            c = counts[k * SLOTS : (k + 1) * SLOTS].astype(np.float64) + 0.5
            logs = np.log(c / c.sum(0))
            self.tables.append((logs - logs.mean(1, keepdims=True)).astype(np.float32))
        shown = counts[3 * SLOTS :] >= np.maximum(1, 0.001 * counts[3 * SLOTS :].sum(0))
        self.open = np.where(shown | ~shown.any(1, keepdims=True), np.float32(0), np.float32(-1e4))

    def word_scores(self, w: Words) -> np.ndarray:
        """Words x languages."""
        if not len(w.start):
            return np.zeros((0, len(self.langs)), np.float32)
        two, three, whole = features(w)
        sums = np.add.reduceat(self.tables[0][two] + self.tables[1][three], np.stack([w.start, w.stop], 1).ravel(), axis=0)[::2]
        return sums + self.tables[2][whole] + self.open[scripts_of(w)]


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The label of each word. Texts are worked on side by side, the longest first, one word of each at a step."""
    n, out = np.diff(first), np.zeros(len(scores), np.int16)
    order = np.argsort(-n, kind="stable")
    start, n = first[:-1][order], n[order]
    steps = int(n.max(initial=0))
    if not steps:
        return out
    active = np.searchsorted(-n, -np.arange(steps), side="left")  # texts with more than t words
    moved, best = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    v = scores[start[: active[0]]].copy()
    last = np.zeros(len(n), np.int16)
    for t in range(1, steps + 1):
        k, was = (active[t] if t < steps else 0), len(v)
        if k < was:
            last[k:was] = v[k:was].argmax(1)
            v = v[:k]
        if not k:
            break
        at = start[:k] + t
        top = v.argmax(1)
        jump = v[np.arange(k), top][:, None] - penalty
        moved[at], best[at] = jump > v, top
        v = np.maximum(v, jump) + scores[at]
    label = last
    for t in range(steps - 1, -1, -1):
        k = active[t]
        at = start[:k] + t
        out[at] = label[:k]
        if t:
            label[:k] = np.where(moved[at, label[:k]], best[at], label[:k])
    return out


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, seed: int = 5) -> Model | None:
    """The model from docs(text, lang), on about train_docs of them, taken by a hash of doc_id and text (of the text alone, copies would come all or none). What comes to the driver is one number for each slot and language."""
    key = [c for c in ("doc_id", "text") if c in docs.columns]
    d = docs.where("text IS NOT NULL AND lang IS NOT NULL").select("lang", *key)
    total = d.count()
    if not total:
        return None
    share = min(1.0, train_docs / total)
    d = d.where(F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    counts = d.select("text", "lang").mapInPandas(_count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(counts["lang"]))
    if not langs:
        return None
    table = np.zeros((3 * SLOTS + len(SCRIPTS), len(langs)), np.int64)
    table[counts["slot"], counts["lang"].map(langs.index)] = counts["n"]
    return Model(langs, table)


def label_texts(model: Model, texts: list[str]) -> tuple[Words, np.ndarray]:
    w = words_of(texts)
    return w, viterbi(model.word_scores(w), w.first)


def spans_of(model: Model, text: str) -> list[tuple[int, int, str]]:
    """The spans of a text: first and last character (not included) and language."""
    w, labels = label_texts(model, [text])
    cut = np.flatnonzero(np.concatenate([[True], labels[1:] != labels[:-1]])) if len(labels) else np.zeros(0, int)
    ends = np.concatenate([cut[1:], [len(labels)]]).astype(int)
    return [(int(w.start[a]), int(w.stop[b - 1]), model.langs[labels[a]]) for a, b in zip(cut, ends, strict=False)]


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred and score (share of the letters that stand in spans of that language)."""
    at = [f.name for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in at])
    if model is None:
        return docs.withColumns({"lang_pred": F.lit(UND), "score": F.lit(0.0)})
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x 3 x SLOTS numbers, whatever the input

    def predict(series: pd.Series) -> pd.DataFrame:
        model, langs, scores = held.value, [], []
        for texts in in_pieces(series):
            w, labels = label_texts(model, texts)
            doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
            letters = np.bincount(doc * len(model.langs) + labels, weights=w.stop - w.start, minlength=len(texts) * len(model.langs)).reshape(len(texts), -1)
            best, total = letters.argmax(1), letters.sum(1)
            langs += [model.langs[b] if t else UND for b, t in zip(best, total, strict=True)]
            scores.append(letters.max(1) / np.maximum(total, 1))
        return pd.DataFrame({"lang_pred": langs, "score": np.concatenate(scores) if scores else []})

    found = F.pandas_udf(predict, "lang_pred string, score double")
    return docs.select("*", found(F.coalesce("text", F.lit(""))).alias("_found")).select(*[F.col(f"`{c}`") for c in at], "_found.lang_pred", "_found.score")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out(F.col("doc_id"), 5, 0)))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", "score")


#: Least share of letters in the main language for a document to be kept.
LEAST_SHARE = 0.4


def keep_identified(docs: DataFrame, model: Model | None, least: float = LEAST_SHARE) -> DataFrame:
    """The rows of docs whose language is found; those that are `und` or have no main language are rejected."""
    out = identify(docs, model)
    return out.where((F.col("lang_pred") != UND) & (F.col("score") >= least)).drop("lang_pred", "score")
