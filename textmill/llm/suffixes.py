"""Removal of repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a LENGTH-byte string that covers it also starts earlier (smaller doc_id, or earlier in the same
document). Suffixes of all texts at once are more than a cluster can hold at a few times the input, so texts
are first reduced to where such strings can be, without losing one:

1. Of each LENGTH-byte string the GRAM-byte part with the least hash is its anchor. Equal strings have equal
   anchors at equal places, so only strings around an anchor that stands in more places can repeat. Anchors
   whose surroundings (all LENGTH-byte strings around them) are equal, by 64 bits of the anchor's hash and 64 of a
   BLAKE2 digest of all these bytes, are settled by their order alone.
2. Where surroundings of an anchor differ, a string that repeats holds half of what surrounds the anchor on
   the left or on the right. Each half that an anchor has in common with another gives a string of a shard.
   A key (anchor and half) of more than KEY strings is split by where the repeat can start: each half of the
   starts has more bytes in common, which make two finer keys, and so on down to one start.
3. Shards are suffix-sorted each by itself into Burrows-Wheeler transforms (over pairs of bytes) and merged in
   rounds, two by two, by refining their interleave: reading both transforms in the order that holds for k
   symbols and dealing the reads stably by symbol gives the order for k + 1. After half of LENGTH steps,
   neighbours in the merged order show their common prefixes, and runs of neighbours that share LENGTH bytes are
   the repeated intervals; all but the earliest start of an interval are repeats.

Defined results: a null text is empty; null doc_ids (and ones from NULLS, which no table should have) count as the
largest, in order of a hash of their text; rows with equal doc_id are taken in order of a hash of their text, and
rows equal in both are one document, reported for each row; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.llm.common import stage_table
from textmill.llm.tokens import powers

LENGTH, GRAM = 100, 32
#: Window of grams in a string, bytes around a gram that its strings can reach, half of them.
WINDOW = LENGTH - GRAM + 1
REACH = LENGTH - GRAM
HALF = REACH // 2
#: Bytes worked on at once; symbols of a shard, and of shards that are merged; strings that a key may have.
PIECE, SHARD, SYMBOLS, KEY = 1 << 20, 1 << 14, 1 << 16, 512
#: Where doc_ids of documents without one begin; the rest of them is 56 bits of a hash.
NULLS = (1 << 63) - (1 << 56)
#: Keys up to which their table is broadcast.
FEW_KEYS = 1 << 16
PLACE = np.uint64((1 << 24) - 1)
#: Times that the symbols of a merge are made twice as long: 4, then 8 bytes a round.
DOUBLED = 2


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


BYTE = [bytes([k]) for k in range(256)]


class Text:
    """Bytes of some documents in a row, with hashes of any part."""

    def __init__(self, parts: list[bytes]):
        self.raw = b"".join(parts)
        self.codes = np.frombuffer(self.raw, np.uint8)
        self.base = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64)
        up, self.down = powers(1 << max(21, len(self.codes).bit_length()))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.codes * up[1 : len(self.codes) + 1])])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo])

    def digests(self, at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """64 bits of a digest of the bytes from lo to hi and of where in them at is."""
        raw, digest = self.raw, hashlib.blake2b
        found = b"".join([digest(raw[b:c] + BYTE[a - b], digest_size=8).digest() for a, b, c in zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)])
        return np.frombuffer(found, np.int64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the anchors of all LENGTH-byte strings that lie in one document, and how far before an anchor the first and the last string begin whose anchor it is."""
        n = len(self.codes)
        if n < LENGTH:
            return (np.zeros(0, np.int64),) * 3
        grams = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.down[: n - GRAM + 1])
        key = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        pad = np.concatenate([key, np.full(-len(key) % WINDOW, ~np.uint64(0))]).reshape(-1, WINDOW)
        before = np.minimum.accumulate(pad, 1).ravel()
        after = np.minimum.accumulate(pad[:, ::-1], 1)[:, ::-1].ravel()
        least = np.minimum(after[: n - LENGTH + 1], before[WINDOW - 1 : n - GRAM + 1])
        doc = np.repeat(np.arange(len(self.base) - 1), np.diff(self.base))
        whole = doc[: n - LENGTH + 1] == doc[LENGTH - 1 :]
        starts = np.flatnonzero(whole)
        place = (least[starts] & PLACE).astype(np.int64)  # never falls from one start to the next
        at = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        last = np.concatenate([at[1:], [len(place)]]) - 1
        return place[at], place[at] - starts[at], (place - starts)[last] if len(at) else at


def byte_pieces(texts: list[bytes], piece: int = PIECE) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (number of the text, where the part begins in it, part); long texts are cut with an overlap of LENGTH - 1 and GRAM more."""
    held, size, overlap = [], 0, 2 * LENGTH
    for k, t in enumerate(texts):
        for lo in range(0, max(1, len(t) - overlap), 4 * piece):
            part = t[lo : lo + 4 * piece + overlap] if len(t) > 4 * piece else t
            if held and size + len(part) > piece:
                yield held
                held, size = [], 0
            held.append((k, lo, part))
            size += len(part)
    if held:
        yield held


def merged_runs(owner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the intervals of each owner; owners are small numbers."""
    if not len(owner):
        return owner, start, stop
    order = np.lexsort((start, owner))
    owner, start, stop = owner[order], start[order], stop[order]
    top = int(stop.max()) + 1
    reach = np.maximum.accumulate(owner * top + stop) - owner * top  # never below 0 within an owner
    new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (start[1:] > reach[:-1])])
    at = np.flatnonzero(new)
    last = np.concatenate([at[1:], [len(owner)]]) - 1
    return owner[at], start[at], reach[last]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


#: first and last: how far before the anchor its own strings begin, in one number (first * 128 + last).
ANCHORS = "h long, c long, did long, th long, pos int, stop int, own short"


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch: the earliest place of each anchor with equal surroundings (stop is 0), and runs that later places cover (pos to stop)."""
    for b in batches:
        dids, ths = b.column(0).to_numpy(), b.column(1).to_numpy()
        texts = b.column(2).to_pylist()
        cols = []
        for parts in byte_pieces(texts):
            t = Text([p for _, _, p in parts])
            a, far, near = t.anchors()
            d = np.searchsorted(t.base, a, side="right") - 1
            lo, hi = np.maximum(t.base[d], a - REACH), np.minimum(t.base[d + 1], a + LENGTH)
            doc, shift = np.array([k for k, _, _ in parts])[d], np.array([s for _, s, _ in parts])[d]
            cols.append((t.hash(a, a + GRAM), t.digests(a, lo, hi), doc, a - t.base[d] + shift, hi - a, far * 128 + near))
        if not sum(len(x[0]) for x in cols):
            continue
        h, c, doc, pos, right, own = (np.concatenate(x) for x in zip(*cols, strict=True))
        did, th = dids[doc], ths[doc]
        order = np.lexsort((pos, th, did, c, h))
        h, c, doc, pos, right, own, did, th = (x[order] for x in (h, c, doc, pos, right, own, did, th))
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (c[1:] == c[:-1])])
        group = np.flatnonzero(~same)[np.cumsum(~same) - 1] if len(h) else np.zeros(0, np.int64)
        later = same & ((did != did[group]) | (th != th[group]) | (pos != pos[group]))
        owner, start, stop = merged_runs(doc[later], np.maximum(0, pos[later] - REACH), pos[later] + right[later])
        first = np.flatnonzero(~same)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([_signed(h[first]), dids[owner]])), pa.array(np.concatenate([c[first], np.zeros(len(owner), np.int64)])),
                pa.array(np.concatenate([did[first], dids[owner]])), pa.array(np.concatenate([th[first], ths[owner]])),
                pa.array(np.concatenate([pos[first], start]).astype(np.int32)), pa.array(np.concatenate([np.zeros(len(first)), stop]).astype(np.int32)),
                pa.array(np.concatenate([own[first], np.zeros(len(owner))]).astype(np.int16)),
            ],
            names=["h", "c", "did", "th", "pos", "stop", "own"],
        )


def whole_groups(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """The rows in frames that no group of equal keys is cut by; rows come sorted by key."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k = pdf[key].to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut or (held and held[-1][key].iat[-1] != k[0]):
            yield pd.concat([*held, pdf.iloc[:cut]]) if held else pdf.iloc[:cut]
            held = []
        held.append(pdf.iloc[cut:])
    if held:
        yield pd.concat(held)


SETTLED = "did long, th long, pos int, stop int, h long, own short"


def _settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """stop > 0: a run that is covered; 0: an anchor whose surroundings stand earlier; -1: the earliest place of surroundings, of an anchor that has others.

    Rows come in order of h, c and place. Of all before a batch only the earliest place of the last surroundings
    is held, and whether its anchor has others, so an anchor may have any number of rows.
    """
    names = ["h", "c", "did", "th", "pos", "own"]
    held: list[np.ndarray] = []
    several = False  # whether the held row's anchor has other surroundings before, so that the row has been given out
    for pdf in batches:
        run = pdf["stop"].to_numpy() > 0
        if run.any():
            yield pdf.loc[run, ["did", "th", "pos", "stop", "h", "own"]]
            pdf = pdf[~run]
        if not len(pdf):
            continue
        h, c, did, th, pos, own = cols = [np.concatenate([held[k], pdf[x].to_numpy()]) if held else pdf[x].to_numpy() for k, x in enumerate(names)]
        new_h = np.concatenate([[True], h[1:] != h[:-1]])
        new_c = new_h | np.concatenate([[True], c[1:] != c[:-1]])
        head = np.flatnonzero(new_c)[np.cumsum(new_c) - 1]
        later = ~new_c & ((did != did[head]) | (th != th[head]) | (pos != pos[head]))
        kinds = np.add.reduceat(new_c.astype(np.int64), np.flatnonzero(new_h))
        kinds[0] += several
        ask = new_c & (kinds[np.cumsum(new_h) - 1] > 1)
        if several:
            ask[0] = False
        at = np.flatnonzero(later | ask)
        if len(at):
            yield pd.DataFrame({"did": did[at], "th": th[at], "pos": pos[at], "stop": np.where(ask[at], -1, 0).astype(np.int32), "h": h[at], "own": own[at]})
        held, several = [x[head[-1] : head[-1] + 1] for x in cols], bool(kinds[-1] > 1)


#: off: where the text begins, seen from the anchor; lo, hi: the starts, seen from there, that the key stands for.
STRINGS = "k long, did long, th long, pos int, off short, lo short, hi short, text binary"


def _key(common: bytes, of: int, part: int) -> int:
    return int.from_bytes(hashlib.blake2b(common, digest_size=8, key=(of & (1 << 64) - 1).to_bytes(8, "little") + bytes([part])).digest(), "little", signed=True)


def _parts(k: int, did: int, th: int, pos: int, off: int, text: bytes, ranges: tuple) -> Iterator[tuple]:
    """The string's part for each of two ranges of starts, under a key of what all strings with such a start have in common."""
    for part, (lo, hi) in enumerate(ranges, 1):
        first, last = max(lo, off), min(hi, off + len(text) - LENGTH)
        if first <= last:
            yield _key(text[hi - off : lo + LENGTH - off], k, part), did, th, pos + first - off, first, lo, hi, text[first - off : last + LENGTH - off]


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each asked anchor the string of its left and of its right half, under a key of the anchor and the bytes of that half."""
    for pdf in batches:
        out: list[tuple] = []
        for did, th, packed, places, anchors, owns in zip(pdf["did"], pdf["th"], pdf["packed"], pdf["places"], pdf["anchors"], pdf["owns"], strict=True):
            text = zstandard.ZstdDecompressor().decompress(packed)
            for pos, h, own in zip(places.tolist(), anchors.tolist(), owns.tolist(), strict=True):
                far, near = divmod(own, 128)
                out += _parts(h, did, th, pos - far, -far, text[pos - far : pos - near + LENGTH], ((-REACH, -HALF), (-HALF, 0)))
        yield pd.DataFrame(out, columns=["k", "did", "th", "pos", "off", "lo", "hi", "text"])


def _finer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings of keys that have too many, under keys for either half of the starts."""
    for pdf in batches:
        out: list[tuple] = []
        for k, did, th, pos, off, lo, hi, text in pdf[["k", "did", "th", "pos", "off", "lo", "hi", "text"]].itertuples(index=False):
            middle = (lo + hi) // 2
            out += _parts(k, did, th, pos, off, text, ((lo, middle), (middle + 1, hi)))
        yield pd.DataFrame(out, columns=["k", "did", "th", "pos", "off", "lo", "hi", "text"])


def split_keys(strings: DataFrame, most: int = KEY) -> tuple[DataFrame, DataFrame]:
    """Strings under keys that have most of them at most, and runs that are covered already.

    Keys with more are made finer until they stand for one start: all their strings are equal then, and all but
    the earliest are covered, which is an aggregation, whatever their number.
    """
    small, covered = [], []
    while True:
        strings = stage_table(strings, "strings")
        large = stage_table(strings.groupBy("k").count().where(F.col("count") > most).select("k"), "keys")
        n = large.count()
        if not n:
            break
        large = F.broadcast(large) if n <= FEW_KEYS else large
        small.append(strings.join(large, "k", "left_anti"))
        rest = strings.join(large, "k", "left_semi")
        one = rest.where("lo = hi")
        first = one.groupBy("text").agg(F.min(F.struct("did", "th", "pos")).alias("first"))
        again = one.join(first, "text").where(F.struct("did", "th", "pos") != F.col("first"))
        covered.append(again.select("did", "th", "pos", (F.col("pos") + LENGTH).cast("int").alias("stop")))
        strings = rest.where("lo < hi").mapInPandas(_finer, STRINGS)
    empty = strings.sparkSession.createDataFrame([], COVERED)
    return functools.reduce(DataFrame.union, [*small, strings]), functools.reduce(DataFrame.union, [*covered, empty])


def suffix_order(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places of all suffixes of the strings codes[first[i]:first[i + 1]] in order, by prefix doubling; codes end each string with two zeros. Equal suffixes are in order of their strings."""
    n = len(codes)
    wide = np.concatenate([codes.astype(np.uint64), np.zeros(8, np.uint64)])
    left = np.repeat(first[1:], np.diff(first)) - np.arange(n)  # codes up to the string's end
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | np.where(left > k, wide[k : n + k], 0)
    size, string = 8, np.repeat(np.arange(len(first) - 1), np.diff(first))
    while True:
        order = np.argsort(key)
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], (k[1:] != k[:-1]).astype(np.int64)]))
        if rank[order[-1]] == n - 1:
            return order
        if size >= int(np.diff(first).max()):
            return np.argsort(rank * len(first) + string)
        after = np.minimum(np.arange(n) + size, n - 1)
        key = rank * (n + 1) + np.where(left > size, rank[after] + 1, 0)
        size *= 2


class Transform:
    """The Burrows-Wheeler transform of a shard over pairs of codes.

    order: suffix places in order; symbol: the pair of codes before each (0 at a string's start); back: where in
    the order the suffix stands that is longer by that pair. Suffixes of no byte come first, two for each string;
    a string's start leads back to one of them.
    """

    def __init__(self, strings: list[bytes]):
        # Bytes of UTF-8 are below 245, so a pair of them, moved up by one to leave 0 as the end, fits 16 bits.
        lens = np.fromiter(map(len, strings), np.int64, len(strings))
        joined = np.frombuffer(b"\xff\xff".join([*strings, b""]), np.uint8)
        self.codes = joined + np.uint8(1)
        self.first = np.concatenate([[0], np.cumsum(lens + 2)])
        self.order = at = suffix_order(self.codes, self.first)
        self.string = np.repeat(np.arange(len(strings)), lens + 2)
        begins = (np.arange(len(self.codes)) - self.first[self.string] < 2)[at]
        two = self.codes[np.maximum(at - 2, 0)].astype(np.uint16) * np.uint16(246) + self.codes[np.maximum(at - 1, 0)]
        self.symbol = np.where(begins, np.uint16(0), two)
        rank = np.empty(len(at), np.int64)
        rank[at] = np.arange(len(at))
        self.back = rank[np.maximum(at - 2, 0)]
        self.back[begins] = np.arange(2 * len(strings))


def interleave(a: Transform, b: Transform, rounds: int = LENGTH // 2) -> np.ndarray:
    """The merged order for rounds pairs: numbers below len(a.order) are places of a's order, others of b's.

    A round reads the symbols of both in the order so far and deals them stably by symbol; each read leads back
    to the suffix that it makes longer. Within a and b the order never changes, only how they interleave. Two
    rounds are one by the rank of two symbols in a row, if that fits 16 bits; a round that changes nothing is
    followed by none that would.
    """
    n = len(a.order)
    symbol, back = np.concatenate([a.symbol, b.symbol]), np.concatenate([a.back, b.back + n])
    merged = np.arange(len(symbol))
    for _ in range(DOUBLED):
        two, rank = np.unique(symbol[back].astype(np.uint32) << np.uint32(16) | symbol, return_inverse=True)
        if len(two) > 1 << 16:
            break
        if rounds % 2:
            merged = back[merged[np.argsort(symbol[merged], kind="stable")]]
        symbol, back, rounds = rank.astype(np.uint16), back[back], rounds // 2
    for _ in range(rounds):
        last, merged = merged, back[merged[np.argsort(symbol[merged], kind="stable")]]
        if np.array_equal(last, merged):
            break
    return merged


def merged(a: Transform, b: Transform) -> Transform:
    """The transform of both shards, from theirs alone: no suffix is sorted again."""
    order = interleave(a, b)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    out = Transform.__new__(Transform)
    out.codes = np.concatenate([a.codes, b.codes])
    out.first = np.concatenate([a.first[:-1], b.first + len(a.codes)])
    out.string = np.concatenate([a.string, b.string + len(a.first) - 1])
    out.order = np.concatenate([a.order, b.order + len(a.codes)])[order]
    out.symbol = np.concatenate([a.symbol, b.symbol])[order]
    out.back = place[np.concatenate([a.back, b.back + len(a.order)])[order]]
    return out


def repeated_intervals(strings: list[bytes], shard: int = SHARD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(interval, string, place) of all LENGTH-byte starts that stand in more than one place of the strings, from shards of about shard symbols (two at least), merged two by two in rounds."""
    if len(strings) < 2:
        return (np.zeros(0, np.int64),) * 3
    sizes = np.cumsum([len(x) for x in strings])
    of = np.minimum(sizes // max(1, min(shard, int(sizes[-1]) // 2)), len(strings) - 1)
    cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(strings)]
    shards = [Transform(strings[lo:hi]) for lo, hi in zip(cuts[:-1], cuts[1:], strict=True)]
    while len(shards) > 1:
        shards = [merged(*shards[k : k + 2]) if k + 1 < len(shards) else shards[k] for k in range(0, len(shards), 2)]
    (all_,) = shards
    codes, string, first, order = all_.codes, all_.string, all_.first, all_.order
    string_at = string[order]
    full = first[string_at + 1] - 2 - order >= LENGTH
    order, string_at = order[full], string_at[full]
    if len(order) < 2:
        return (np.zeros(0, np.int64),) * 3
    # Common prefixes of neighbours, eight codes at a time.
    words = np.lib.stride_tricks.sliding_window_view(codes, 8)
    packed = words[:, 0].astype(np.uint64)
    for k in range(1, 8):
        packed = (packed << np.uint64(8)) | words[:, k]
    same, live = np.ones(len(order) - 1, bool), np.arange(len(order) - 1)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        equal = packed[order[live] + k] == packed[order[live + 1] + k]
        same[live[~equal]] = False
        live = live[equal]
    interval = np.cumsum(np.concatenate([[True], ~same])) - 1
    in_run = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return interval[in_run], string_at[in_run], (order - first[string_at])[in_run]


COVERED = "did long, th long, pos int, stop int"


def covered_by(did: np.ndarray, th: np.ndarray, pos: np.ndarray, texts: np.ndarray) -> pd.DataFrame:
    """Runs of the rows' strings that stand earlier in another; pos is where a string begins in its document."""
    interval, string, place = repeated_intervals(texts.tolist())
    if not len(interval):
        return pd.DataFrame({"did": did[:0], "th": th[:0], "pos": pos[:0], "stop": pos[:0]})
    at = pos[string].astype(np.int64) + place
    order = np.lexsort((at, th[string], did[string], interval))
    interval, string, at = interval[order], string[order], at[order]
    new = np.concatenate([[True], interval[1:] != interval[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (did[string] != did[string[head]]) | (th[string] != th[string[head]]) | (at != at[head])
    owner, start, stop = merged_runs(string[later], at[later], at[later] + LENGTH)
    return pd.DataFrame({"did": did[owner], "th": th[owner], "pos": start.astype(np.int32), "stop": stop.astype(np.int32)})


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Strings of one key come together; those of several keys are merged at once, up to SYMBOLS."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        return covered_by(rows["did"].to_numpy(), rows["th"].to_numpy(), rows["pos"].to_numpy(), rows["text"].to_numpy())

    held, size = [], 0
    for pdf in whole_groups(batches, "k"):
        pdf = pdf.sort_values(["k", "did", "th", "pos"], kind="stable")
        # Equal strings of a key: all but the earliest are covered whole and needn't be merged.
        again = pdf.duplicated(["k", "text"])
        if again.any():
            head = pdf.groupby(["k", "text"], sort=False)[["did", "th", "pos"]].transform("first")
            later = again & ((head["did"] != pdf["did"]) | (head["th"] != pdf["th"]) | (head["pos"] != pdf["pos"]))
            twice = pdf.loc[later, ["did", "th", "pos", "text"]]
            yield pd.DataFrame({"did": twice["did"], "th": twice["th"], "pos": twice["pos"], "stop": twice["pos"] + twice["text"].map(len).astype(np.int32)})
            pdf = pdf[~again]
        pdf = pdf[pdf.duplicated("k", keep=False)]
        if not len(pdf):
            continue
        lens = pdf["text"].map(len).to_numpy()
        # Cut between keys.
        ends = np.flatnonzero(np.concatenate([pdf["k"].to_numpy()[1:] != pdf["k"].to_numpy()[:-1], [True]])) + 1
        lo, total = 0, np.concatenate([[0], np.cumsum(lens)])
        for e in ends:
            if size + total[e] - total[lo] >= SYMBOLS:
                held.append(pdf.iloc[lo:e])
                yield solve(pd.concat(held))
                held, size, lo = [], 0, e
        if lo < len(pdf):
            held.append(pdf.iloc[lo:])
            size += total[-1] - total[lo]
    if held:
        yield solve(pd.concat(held))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for doc_id, packed, starts, stops in zip(pdf["doc_id"], pdf["packed"], pdf["starts"], pdf["stops"], strict=True):
            text = zstandard.ZstdDecompressor().decompress(packed)
            n = len(text)
            kept, removed, spans, at = [], 0, 0, 0
            if starts is not None and len(starts):
                start, stop = starts.astype(np.int64), stops.astype(np.int64)
                whole = stop == 0  # all that the strings of an anchor reach
                start, stop = np.where(whole, np.maximum(0, start - REACH), start), np.where(whole, np.minimum(n, start + LENGTH), stop)
                _, start, stop = merged_runs(np.zeros(len(start), np.int64), start, stop)
                for a, b in zip(start.tolist(), stop.tolist(), strict=True):
                    kept.append(text[at:a])
                    removed += b - a
                    at = b
                spans = len(start)
            kept.append(text[at:])
            rows.append((doc_id, n, removed, spans, b"".join(kept)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]).astype({"doc_id": "Int64"})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    nameless = F.lit(NULLS) + F.shiftrightunsigned(F.xxhash64(F.lit(1), text), 8)
    d = docs.select("doc_id", F.coalesce("doc_id", nameless).alias("did"), F.xxhash64(text).alias("th"), text.cast("binary").alias("text"))
    found = d.select("did", "th", "text").mapInArrow(_anchors, ANCHORS)
    settled = stage_table(found.repartition(parts, "h").sortWithinPartitions("h", "c", "did", "th", "pos").mapInPandas(_settle, SETTLED), "repeats")

    def pack(s: pd.Series) -> pd.Series:
        z = zstandard.ZstdCompressor(level=3)
        return s.map(z.compress)

    packed = d.select("doc_id", "did", "th", F.pandas_udf(pack, "binary")("text").alias("packed"))
    asked = settled.where("stop = -1").groupBy("did", "th").agg(F.collect_set(F.struct("pos", "h", "own")).alias("asked"))
    strings = packed.select("did", "th", "packed").join(asked.hint("merge"), ["did", "th"]).select("did", "th", "packed", F.col("asked.pos").alias("places"), F.col("asked.h").alias("anchors"), F.col("asked.own").alias("owns")).mapInPandas(_strings, STRINGS)
    strings, equal = split_keys(strings)
    covered = strings.select("k", "did", "th", "pos", "text").repartition(parts, "k").sortWithinPartitions("k").mapInPandas(_merge, COVERED)
    runs = settled.where("stop >= 0").select("did", "th", "pos", "stop").union(covered).union(equal)
    runs = runs.groupBy("did", "th").agg(F.collect_set(F.struct("pos", "stop")).alias("runs"))
    return packed.join(runs.hint("merge"), ["did", "th"], "left").select("doc_id", "packed", F.col("runs.pos").alias("starts"), F.col("runs.stop").alias("stops")).mapInPandas(_remove, RESULT)


def op3_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: SQL for the rows of op3_repeats: every string of 100 bytes, its first start, and the runs that later starts cover. For small tables.
ORACLE = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
q AS (SELECT doc_id, n, unnest(range(0, n, 512)) AS o, h FROM d WHERE n >= 100),
s AS (SELECT doc_id, o, least(512, n - 99 - o) AS m, substr(h, 2 * o + 1, 1222) AS t FROM q WHERE o < n - 99),
w AS (SELECT doc_id, o, unnest(range(m)) AS i, t FROM s),
f AS (SELECT doc_id, o + i AS p, row_number() OVER (PARTITION BY substr(t, 2 * i + 1, 200) ORDER BY doc_id, o + i) AS r FROM w),
c AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM f WHERE r > 1),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM c),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM g GROUP BY doc_id, k),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM runs),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS x, sum(b - a) AS removed, count(*) AS spans FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT d.doc_id, n AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(x, h))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""
