"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints of 64 bits are taken as 8 positional bytes. Two of them that differ in 3 bits or fewer share at
least 5 positional bytes (the guaranteed minimum). Postings are kept for groups of 4 byte positions, chosen
so that any 5 of the 8 positions contain a group (each half's own group, and three of one half with one of
the other, thinned to a covering); a pair that shares 5 positional bytes meets in at least one of them. For
pairs that meet, the shared positional bytes are tallied, pairs below the minimum are left, and the rest are
verified bit by bit.

Equal fingerprints are one entry of the index, so copies cost nothing. A posting list is cut into tiles of
TILE entries and each pair of tiles is a task's group of its own, so no list is met whole in one place. Within
a group only a spanning forest of its links is given out, which links the same fingerprints with at most as
many rows as entries.

Defined results: a null text is empty; a text without words has fingerprint 0 and is linked like any other;
a null doc_id is kept with a component of the smallest id reachable (null if there is none); repeated rows
are kept each; an empty table gives an empty result; other columns are kept by near_deduplicate and ignored
by the query.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.common import components, stage_table

SHINGLE, SEED, BITS_APART = 3, 42, 3
#: Positional bytes that two fingerprints share at least: each differing bit spoils one byte at most.
LEAST_BYTES = 8 - BITS_APART
#: Entries of a posting list that are compared with each other at once.
TILE = 2048


def covering(n: int = 8, k: int = LEAST_BYTES, size: int = 4) -> list[tuple[int, ...]]:
    """Groups of positions such that any k of n positions contain one; greedy, each step the group in most open sets."""
    left, out = {frozenset(c) for c in combinations(range(n), k)}, []
    while left:
        best = max(combinations(range(n), size), key=lambda g: sum(s.issuperset(g) for s in left))
        out.append(best)
        left = {s for s in left if not s.issuperset(best)}
    return out


GROUPS = covering()


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of lower-cased UTF-8 text: bit i is set if it is set in over half of the shingle hashes."""
    words = text.lower().split(None)
    if not words:
        return 0
    n, digest = len(words) - shingle + 1, xxhash.xxh64_intdigest
    if n < 1:
        hashes = np.array([digest(b" ".join(words), SEED)], "<u8")
    else:
        hashes = np.fromiter((digest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), "<u8", n)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        prints = np.fromiter((fingerprint(t or b"") for t in b.column(1).to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def _keyed_fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        (found,) = _fingerprints([b])
        yield pa.RecordBatch.from_arrays([*found.columns, b.column(2)], names=["doc_id", "fp", "th"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit number."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprints, "doc_id long, fp long")


def postings(prints: DataFrame) -> DataFrame:
    """(g, bytes, fp): the fingerprint under each group of positional bytes."""
    masks = [sum(255 << 8 * p for p in g) for g in GROUPS]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("g"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)]))
    return prints.select("fp", each.alias("k")).select("k.g", "k.bytes", "fp")


def tiles(index: DataFrame, tile: int = TILE) -> DataFrame:
    """Posting lists of two and more entries, dealt out as pairs of tiles: (g, bytes, i, j, side, fp) with i <= j.

    A list of n entries has m = ceil(n / tile) tiles; an entry goes to the m groups that its tile is in.
    """
    sizes = index.groupBy("g", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    d = index.join(sizes, ["g", "bytes"]).withColumn("m", F.ceil(F.col("n") / tile).cast("int"))
    d = d.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("m")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, m - 1)")))
    return d.select("g", "bytes", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")


def near_pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes (x, y) of a and b whose fingerprints share LEAST_BYTES positional bytes (tallied first, for all) and differ in BITS_APART bits at most (verified then), some rows of a at a time."""
    for lo in range(0, len(a), 256):
        diff = a[lo : lo + 256, None] ^ b[None, :]
        tally = np.zeros(diff.shape, np.uint8)
        for position in range(8):
            tally += diff >> np.uint64(8 * position) & np.uint64(255) == 0
        x, y = np.nonzero(tally >= LEAST_BYTES)
        keep = np.bitwise_count(diff[x, y]) <= BITS_APART
        yield x[keep] + lo, y[keep]


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of the near pairs. Pairs within one tree are left as they come, so what is held grows with the entries, not the pairs."""
    entries = np.unique(np.concatenate([a, b]))
    at, bt = np.searchsorted(entries, a), np.searchsorted(entries, b)
    tree, out = np.arange(len(entries)), []
    for x, y in near_pairs(a, b):
        p, q = at[x], bt[y]
        while len(p := p[open_ := tree[p] != tree[q]]):
            q = q[open_]
            # One link for each pair of trees, then of these the first for each tree, so that no two make a ring.
            _, first = np.unique(np.maximum(tree[p], tree[q]), return_index=True)
            for i, j in zip(p[first].tolist(), q[first].tolist(), strict=True):
                r, s = tree[i], tree[j]
                if r != s:
                    out.append((int(entries[i]), int(entries[j])))
                    tree[tree == max(r, s)] = min(r, s)
    return out


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Groups arrive whole and in order: rows are sorted by (g, bytes, i, j) within a partition."""
    held: list[pd.DataFrame] = []

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        key = rows[["g", "bytes", "i", "j"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
        fp, own, i, j, out = rows["fp"].to_numpy().view(np.uint64), rows["own"].to_numpy(), rows["i"].to_numpy(), rows["j"].to_numpy(), []
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            if hi - lo < 2:
                continue
            v, o = fp[lo:hi], own[lo:hi]
            a, b = (v, v) if i[lo] == j[lo] else (v[o == i[lo]], v[o == j[lo]])
            if len(a) and len(b):
                out += _forest(a, b)
        pairs = np.array(out, np.uint64).reshape(-1, 2).view(np.int64)
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        rows = pd.concat(held) if len(held) > 1 else pdf
        last = rows[["g", "bytes", "i", "j"]].to_numpy()
        cut = int(np.flatnonzero((last != last[-1]).any(1)).max(initial=-1)) + 1
        if cut:
            yield solve(rows.iloc[:cut])
        held = [rows.iloc[cut:]]
    if held:
        yield solve(pd.concat(held))


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) between different fingerprints: a spanning forest of each group, so components are kept."""
    t = tiles(postings(distinct))
    t = t.repartition(F.col("g"), F.col("bytes"), F.col("i"), F.col("j")).sortWithinPartitions("g", "bytes", "i", "j")
    return t.mapInPandas(_links, "a long, b long").where("a <> b").distinct()


def fingerprint_components(prints: DataFrame) -> DataFrame:
    """fp and component_id, the smallest doc_id among all fingerprints reachable from it."""
    own = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_links(own.select("fp")))
    roots = roots.withColumnRenamed("node", "fp")
    named = own.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id"))
    linked = roots.join(named, "root").select("fp", "component_id")
    return own.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its class)."""
    prints = stage_table(fingerprints(docs), "simhash")
    # Both sides are scans, so that a partition of many copies can be split by adaptive execution.
    classes = stage_table(fingerprint_components(prints), "classes")
    out = prints.join(classes, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each class, that of the smallest doc_id (null last), then of the least hash of its text.

    Repeated rows are one document and stay once.
    """
    keyed = docs.withColumns({"_did": F.coalesce("doc_id", F.lit((1 << 63) - 1)), "_th": F.xxhash64("text")})
    text = keyed.select(F.col("_did").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), "_th")
    prints = stage_table(text.mapInArrow(_keyed_fingerprints, "doc_id long, fp long, th long"), "simhash")
    least = prints.groupBy("fp").agg(F.min(F.struct("doc_id", "th")).alias("least"))
    roots = components(near_links(least.select("fp"))).withColumnRenamed("node", "fp")
    kept = least.join(roots, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("least").alias("least"))
    kept = kept.select(F.col("least.doc_id").alias("_did"), F.col("least.th").alias("_th"))
    return keyed.join(kept.hint("merge"), ["_did", "_th"], "left_semi").dropDuplicates(["_did", "_th"]).drop("_did", "_th")


def op1_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
