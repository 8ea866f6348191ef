"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage with block-max WAND.

Impacts are BM25 term weights divided by the score that the item gets from itself, so one threshold holds for
all items and 1 is a passage with all of an item's terms. Each text is cut into passages that overlap by half
and are at least twice as long as the longest item, so each copy of an item stands whole in some passage. An
item's score is at most its impacts on the passage's rare terms (those of a tenth of the items at most) plus
the sum of all its impacts on other terms; passages for which no item's bound reaches the threshold can't have
a match and are left at once, for all passages of many texts in one step. All others are run through block-max
WAND, which gives all items above the threshold. A match counts if five-word shingles of the item's question
(its first two thirds) and of its answer (the rest) both overlap with the passage.

Items are indexed in blocks of ITEMS (and ITEM_CHARS), which bounds what is broadcast and what the driver holds;
texts are read once for each block, and what a block finds is written before the next one's index is made.

Defined results: null and empty texts and items match nothing; an item of fewer than five words in a part is
compared by all the words of that part; repeated rows of documents give repeated rows; each distinct
(item_id, text) is an item, so all texts of an id are looked for, and so is a text without an id (if a row with
an id has the same text, it is that item); a row whose doc_id is null is matched like any other, and each row
is kept or dropped by its own text; an empty table on either side gives an empty result (no document is
dropped); other columns are ignored or, by the filter, kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import drop_staged, stage_table
from textmill.llm.tokens import in_pieces, powers

K1, B = 1.2, 0.75
#: Least score (1: the item's own), least share of shingles in question and answer, words of a shingle.
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.5, 5
#: Largest share of the items for a rare term.
RARE = 0.1
#: Least words of a passage, postings of a block, items of an index and characters of their texts.
PASSAGE, BLOCK, ITEMS, ITEM_CHARS = 128, 32, 50_000, 1 << 25

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[128:] = True
for _c in range(128):
    WORD_BYTE[_c] = chr(_c).isalnum()


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts (runs of ASCII letters and digits and of anything beyond ASCII, in lower case), and where each text's begin."""
    raw = [t.lower().encode("utf-8", "surrogatepass") + b" " for t in texts]
    codes = np.frombuffer(b"".join(raw), np.uint8)
    base = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    word = np.concatenate([[False], WORD_BYTE[codes], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    start, stop = edge[::2], edge[1::2]
    up, down = powers(1 << max(21, int(len(codes)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[1 : len(codes) + 1])])
    h = (sums[stop] - sums[start]) * down[start]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29)), np.searchsorted(start, base)


def shingles(words: np.ndarray, n: int = SHINGLE) -> np.ndarray:
    """Hashes of runs of n words (of all words if there are fewer), without repeats."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ words[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return np.unique(h)


class Index:
    """Posting lists by term: items in order, impacts, and the largest impact of each block of BLOCK postings."""

    def __init__(self, items: list[tuple[int | None, str]], frequency: dict[int, int], total: int, mean_length: float):
        self.ids = [i for i, _ in items]
        words, first = hashed_words([t for _, t in items])
        each = [words[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.passage = max(PASSAGE, 2 * max((len(w) for w in each), default=0))
        postings = []
        self.question, self.answer = [], []
        for k, w in enumerate(each):
            terms, n = np.unique(w, return_counts=True)
            df = np.array([frequency[t] for t in terms.tolist()], float)
            impact = np.log(1 + (total - df + 0.5) / (df + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean_length))
            postings.append((terms, np.full(len(terms), k), impact / impact.sum()))
            cut = max(1, 2 * len(w) // 3) if len(w) > 1 else len(w)
            self.question.append(shingles(w[:cut]))
            self.answer.append(shingles(w[cut:]))
        term, item, impact = (np.concatenate(x) for x in zip(*postings, strict=True))
        order = np.argsort(term, kind="stable")
        self.terms, first = np.unique(term[order], return_index=True)
        self.items, self.impacts = np.split(item[order], first[1:]), np.split(impact[order], first[1:])
        self.most = np.array([x.max() for x in self.impacts])
        self.block_most = [np.maximum.reduceat(x, np.arange(0, len(x), BLOCK)) for x in self.impacts]
        counts = np.array([len(x) for x in self.items], np.int64)
        rare = counts <= max(1, RARE * len(items))
        #: Postings of rare terms in one array each, and for each item the sum of its impacts on other terms.
        self.rare_from = np.concatenate([[0], np.cumsum(np.where(rare, counts, 0))])
        self.rare_items = np.concatenate([x for x, r in zip(self.items, rare, strict=True) if r] or [np.zeros(0, np.int64)])
        self.rare_impacts = np.concatenate([x for x, r in zip(self.impacts, rare, strict=True) if r] or [np.zeros(0)])
        self.common = np.zeros(len(items))
        for x, y, r in zip(self.items, self.impacts, rare, strict=True):
            if not r:
                np.add.at(self.common, x, y)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.terms >> np.uint64(44)).astype(np.int64)] = True

    def find(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, terms) of the words that are terms of the index."""
        hit = np.flatnonzero(self.maybe[(words >> np.uint64(44)).astype(np.int64)])
        if not len(self.terms):
            return hit[:0], hit[:0]
        k = np.minimum(np.searchsorted(self.terms, words[hit]), len(self.terms) - 1)
        same = self.terms[k] == words[hit]
        return hit[same], k[same]

    def worthwhile(self, passage: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Passages of the (passage, term) pairs with an item whose score can reach the threshold."""
        bar = THRESHOLD - 1e-9
        n = self.rare_from[of + 1] - self.rare_from[of]
        total = int(n.sum())
        posting = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.rare_from[of], n)
        key = np.repeat(passage, n) * len(self.ids) + self.rare_items[posting]
        cells, at = np.unique(key, return_inverse=True)
        found = np.bincount(at, weights=self.rare_impacts[posting], minlength=len(cells)) + self.common[cells % len(self.ids)] >= bar
        easy = passage if (self.common >= bar).any() else passage[:0]  # common terms alone may do for some item
        return np.unique(np.concatenate([cells[found] // len(self.ids), easy]))

    def wand(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All items whose impacts of these (different) terms sum to the threshold or more."""
        cursors = [[self.items[t][0], 0, t] for t in terms]  # item, posting, term
        out, bar = [], threshold - 1e-9
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.most[c[2]]
                if bound >= bar:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            ahead, blocks, until = cursors[: pivot + 1], 0.0, None
            for c in ahead:  # largest impacts of the blocks that would hold the pivot, and where the first of them ends
                own = self.items[c[2]]
                p = int(np.searchsorted(own, item)) if c[0] < item else c[1]
                if p < len(own):
                    b = p // BLOCK
                    blocks += self.block_most[c[2]][b]
                    end = own[min(len(own), (b + 1) * BLOCK) - 1] + 1
                    until = end if until is None else min(until, end)
            if blocks < bar:  # no item up to the first block's end or the next list's can reach it
                target = until if until is not None else item + 1
                if pivot + 1 < len(cursors):
                    target = min(target, cursors[pivot + 1][0])
                target = max(target, item + 1)
            else:
                score, target = 0.0, item
                for c in ahead:
                    own = self.items[c[2]]
                    p = c[1] if c[0] == item else int(np.searchsorted(own, item))
                    if p < len(own) and own[p] == item:
                        score += self.impacts[c[2]][p]
                if score >= bar:
                    out.append((int(item), score))
                target = item + 1
            kept = []
            for c in ahead:
                if c[0] < target:
                    c[1] = int(np.searchsorted(self.items[c[2]], target))
                    if c[1] >= len(self.items[c[2]]):
                        continue
                    c[0] = self.items[c[2]][c[1]]
                kept.append(c)
            cursors = kept + cursors[pivot + 1 :]
        return out

    def matches(self, texts: list[str]) -> list[tuple[int, int, float, float, float]]:
        """(text, item, score, question overlap, answer overlap) of verified matches, the best passage of each pair."""
        words, first = hashed_words(texts)
        half = self.passage // 2
        at, term = self.find(words)
        doc = np.searchsorted(first, at, side="right") - 1
        # Half passages of all texts in a row, with one left over before each text, so passages never cross texts.
        halves = np.concatenate([[0], np.cumsum(-(-np.diff(first) // half) + 1)])
        place = halves[doc] + 1 + (at - first[doc]) // half
        n = max(1, len(self.terms))
        key = np.unique(np.concatenate([place * n + term, (place - 1) * n + term]))
        passage, of = key // n, key % n
        left = self.worthwhile(passage, of)
        starts, stops = np.searchsorted(passage, left), np.searchsorted(passage, left, side="right")
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for p, lo, hi in zip(left.tolist(), starts, stops, strict=True):
            found = self.wand(of[lo:hi].tolist())
            if not found:
                continue
            d = int(np.searchsorted(halves, p, side="right")) - 1
            lo = first[d] + (p - halves[d] - 1) * half
            own = shingles_at(words, max(first[d], lo), min(first[d + 1], lo + self.passage))
            for k, score in found:
                q, a = overlap(self.question[k], own), overlap(self.answer[k], own)
                if q >= OVERLAP and a >= OVERLAP and best.get((d, k), (-1,))[0] < score:
                    best[d, k] = (score, q, a)
        return [(d, k, *x) for (d, k), x in sorted(best.items())]


def overlap(part: np.ndarray, passage: np.ndarray) -> float:
    """Share of an item part's shingles that the passage has; a part without words asks for nothing."""
    return float(np.isin(part, passage).mean()) if len(part) else 1.0


def shingles_at(words: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Shingles of a passage, of five words and of fewer, for parts of items that are shorter."""
    return np.unique(np.concatenate([runs(words[lo:hi], n) for n in range(1, SHINGLE + 1)]))


def runs(words: np.ndarray, n: int) -> np.ndarray:
    return shingles(words, n) if len(words) >= n else words[:0]


def indexes(items: DataFrame, per_block: int = ITEMS, block_chars: int = ITEM_CHARS) -> Iterator[Index]:
    """Indexes of at most about per_block items, and block_chars of their texts, each; statistics are over all items.

    An item is a distinct (item_id, text); a row without an id is one if no row with an id has its text. Only
    one block's items, and the frequencies of its terms, are with the driver at a time.
    """
    named = items.where("text IS NOT NULL").select("item_id", "text").distinct()
    d = named.groupBy("text").agg(F.collect_set("item_id").alias("ids")).select(F.explode_outer("ids").alias("item_id"), "text")
    total, chars = d.agg(F.count("*"), F.sum(F.length("text"))).first()
    if not total:
        return
    parts = max(math.ceil(total / per_block), math.ceil(chars / block_chars))
    d = stage_table(d.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each item's different terms, and with term null its number of words."""
        for b in batches:
            words, first = hashed_words(b.column(0).to_pylist())
            each = [np.unique(words[lo:hi]) for lo, hi in zip(first[:-1], first[1:], strict=True)]
            own = np.concatenate([b.column(1).to_numpy().repeat([len(x) for x in each]), b.column(1).to_numpy()])
            found = pa.array(np.concatenate([np.concatenate(each).view(np.int64), np.zeros(len(each), np.int64)]), mask=np.arange(len(own)) >= len(own) - len(each))
            yield pa.RecordBatch.from_arrays([pa.array(own), found, pa.array(np.concatenate([np.ones(len(own) - len(each)), np.diff(first)]).astype(np.int64))], names=["part", "term", "n"])

    t = stage_table(d.select("text", "part").mapInArrow(terms, "part long, term long, n long").groupBy("part", "term").agg(F.sum("n").alias("n")), "terms")
    length = t.where("term IS NULL").agg(F.sum("n")).first()[0]
    frequency = t.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n"))
    for p in range(parts):
        rows = d.where(F.col("part") == p).select("item_id", "text").orderBy("item_id", "text").collect()
        if rows:
            own = t.where((F.col("part") == p) & F.col("term").isNotNull()).select("term")
            of = frequency.join(own, "term", "left_semi").collect()
            yield Index([tuple(r) for r in rows], {r[0] & (1 << 64) - 1: r[1] for r in of}, total, max(1.0, length / total))
    drop_staged(t)
    drop_staged(d)


def _each_index(items: DataFrame, per_block: int, use: Callable) -> Iterator[DataFrame]:
    """use(broadcast index) for each block of items in turn; written, and its broadcast dropped, before the next block's unless it is the only one."""
    spark = items.sparkSession
    found, held = None, None
    for index in indexes(items, per_block):
        if found is not None:
            yield _settled(found, held)
        held = spark.sparkContext.broadcast(index)  # at most per_block items
        found = use(held)
    if found is not None:
        yield found


def _settled(found: DataFrame, held) -> DataFrame:
    out = stage_table(found, "decontaminate")
    held.destroy()
    return out


def contaminated(docs: DataFrame, items: DataFrame, per_block: int = ITEMS) -> DataFrame:
    """One row per row of docs and item that it holds: doc_id, item_id, score, question_overlap, answer_overlap."""
    shape = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]

    def use(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                done = 0
                ids = b.column(0).to_pylist()
                for texts in in_pieces(b.column(1).to_pylist(), 1 << 19):
                    found = index.matches(texts)
                    if found:
                        columns = zip(*[(ids[done + d], index.ids[k], s, q, a) for d, k, s, q, a in found], strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, [pa.int64()] * 2 + [pa.float64()] * 3, strict=True)], names=names)
                    done += len(texts)

        return docs.select("doc_id", "text").mapInArrow(run, shape)

    out = docs.sparkSession.createDataFrame([], shape)
    for found in _each_index(items, per_block, use):
        out = out.union(found)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, per_block: int = ITEMS) -> DataFrame:
    """The rows of docs that hold no test item, decided for each row by its own text."""
    at, kept = docs.columns.index("text"), docs

    def use(held) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = held.value
            for b in batches:
                clean, done = np.ones(b.num_rows, bool), 0
                for texts in in_pieces(b.column(at).to_pylist(), 1 << 19):
                    clean[[done + d for d, *_ in index.matches(texts)]] = False
                    done += len(texts)
                yield b.filter(pa.array(clean))

        return kept.mapInArrow(run, docs.schema)

    for found in _each_index(items, per_block, use):
        kept = found
    return kept


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
