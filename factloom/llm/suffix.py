"""Suffix-array removal of repeated strings of at least ``width`` symbols, within and across documents.

A symbol is a byte or, in ``WORDS``, a whole word between ASCII white space. Two strings are compared by suffix
order. To make one suffix array per block suffice, every window of ``width`` symbols is first given to an anchor:
its leftmost smallest hashed gram. The anchor follows from the window's own symbols, so equal windows have equal
anchors, at the same place. Successive windows with one anchor form a run; the symbols of a run are its context.

1. Runs are counted by anchor; those whose anchor occurs once hold no repeated window and go.
2. Equal contexts collapse: all their windows repeat.
3. Where one anchor has several contexts, one copy of each goes to a block. In the block's suffix order (prefix
   doubling, up to ``width`` symbols) the previous and next smaller positions of a window give its longest previous
   factor: it reaches ``width`` when an earlier window is equal. The same with greater positions tells of later ones.
4. An anchor with more than ``MOST_CONTEXTS`` contexts doesn't fit a block. Its contexts are split by longer common
   parts, and where these agree and the contexts still differ, windows are counted one by one; this is the exact way
   for the rest.

A window's copy counts whether it is in another document or elsewhere in the same one. ``all`` removes
every byte of every repeated window, ``later`` keeps the first copy in the order of (doc_id, position).

Defined cases: null text: empty; texts shorter than ``width`` lose nothing; repeated rows are copies of each
other (rows equal in doc_id and text count as one place that repeats); an empty table gives an empty
result; extra columns are ignored. Null doc_ids count as -1 in the order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bloom import id_filter, mix
from .common import keep_only, materialize, own_names, small_batches

WIDTH = 400  # bytes
PASSAGE = 51  # words
BLOCK_SYMBOLS = 1 << 19
MOST_CONTEXTS = 2048
PIECE = 16
PART = 1 << 20
BASE = 0x9E3779B97F4A7C15
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


# ---------------------------------------------------------------- symbols


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2, ... modulo 2 ** 64, kept up to some parts' length."""
    if len(_POWERS.get(base, ())) < n:
        found = np.full(max(n, PART + 4096), base, np.uint64)
        found[0] = 1
        found = np.multiply.accumulate(found)
        if n > 2 * PART:
            return found
        _POWERS[base] = found
    return _POWERS[base][:n]


def range_hashes(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Polynomial hashes of ``data[low:high]``, the same wherever the range stands."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=sums[1:])
    return mix((sums[high] - sums[low]) * powers(pow(BASE, -1, 1 << 64), len(data) + 1)[low])


def word_bounds(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~BLANK[np.frombuffer(raw, np.uint8)]
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_symbols(raw: bytes) -> np.ndarray:
    """A 64-bit hash of every word, made a part of the words at a time."""
    starts, ends = word_bounds(raw)
    data, out, low = np.frombuffer(raw, np.uint8), [], 0
    while low < len(starts):
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + PART)))
        first = starts[low]
        out.append(range_hashes(data[first : ends[high - 1]], starts[low:high] - first, ends[low:high] - first))
        low = high
    return np.concatenate(out) if out else np.empty(0, np.uint64)


class Unit(NamedTuple):
    """What a symbol is: the array of a text's symbols, their type, and symbols in a gram."""

    symbols: Callable[[bytes], np.ndarray]
    kind: type
    gram: int


BYTES = Unit(lambda raw: np.frombuffer(raw, np.uint8), np.uint8, 32)
WORDS = Unit(word_symbols, np.uint64, 8)


# ---------------------------------------------------------------- suffix arrays


def _dense(pairs: np.ndarray) -> np.ndarray:
    """Dense ranks from 1. Where a pair and its place fit one number, a plain sort of numbers will do."""
    n, bits = len(pairs), len(pairs).bit_length()
    if n and int(pairs.max()) >> (64 - bits):
        return np.unique(pairs, return_inverse=True)[1] + 1
    key = (pairs.astype(np.uint64) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    key.sort()
    place = (key & np.uint64((1 << bits) - 1)).astype(np.int64)
    key >>= np.uint64(bits)
    new = np.ones(n, np.int64)
    new[1:] = key[1:] != key[:-1]
    ranks = np.empty(n, np.int64)
    ranks[place] = np.cumsum(new)
    return ranks


def ranks_by_depth(data: np.ndarray, depth: int) -> list[tuple[int, np.ndarray]]:
    """(depth, ranks of all suffixes by their first so many symbols), by prefix doubling up to ``depth``; past the end counts as smallest."""

    def at(values: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(values)
        out[: max(0, len(values) - by)] = values[by:]
        return out

    if data.dtype == np.uint8:
        first = data.astype(np.int64) + 1
        four = (first << 27) | (at(first, 1) << 18) | (at(first, 2) << 9) | at(first, 3)
        levels = [(4, _dense(four))] if depth >= 4 else [(1, _dense(first))]
    else:
        levels = [(1, _dense(data))]
    while levels[-1][0] < depth:
        have, ranks = levels[-1]
        step = min(have, depth - have)
        levels.append((have + step, _dense(ranks * (len(data) + 1) + at(ranks, step))))
    return levels


def suffix_order(ranks: np.ndarray) -> np.ndarray:
    """Places in order of their ranks, ties by place."""
    n, bits = len(ranks), len(ranks).bit_length()
    if n and int(ranks.max()) >> (64 - bits):
        return np.argsort(ranks, kind="stable")
    key = (ranks.astype(np.uint64) << np.uint64(bits)) | np.arange(n, dtype=np.uint64)
    key.sort()
    return (key & np.uint64((1 << bits) - 1)).astype(np.int64)


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each entry the index of the nearest earlier entry that is smaller, or -1. Pointers jump over pointers, all at once."""
    found = np.arange(-1, len(values) - 1)
    open_ = np.flatnonzero((found >= 0) & (values[np.maximum(found, 0)] >= values))
    while len(open_):
        found[open_] = found[found[open_]]
        open_ = open_[(found[open_] >= 0) & (values[found[open_]] >= values[open_])]
    return found


def common_prefix(levels: list[tuple[int, np.ndarray]], data: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Lengths, cut at the deepest level, of the common prefixes of suffixes a and b; those below ``least`` count as 0.

    A length at or above a level is seen by equal ranks; what is left of it, by the levels below.
    """
    deepest, ranks = levels[-1]
    out = np.where(ranks[a] == ranks[b], deepest, 0)
    if least >= deepest:
        return out
    left = np.flatnonzero(out == 0)
    a, b, length = a[left], b[left], np.zeros(len(left), np.int64)
    n = len(data)
    for depth, r in [*levels[-2::-1], *([(1, data)] * (levels[0][0] - 1))]:
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        length += depth * ((r[x] == r[y]) & (np.maximum(a, b) + length + depth <= n))
    out[left] = np.where(length >= least, length, 0)
    return out


def longest_previous_factor(levels: list[tuple[int, np.ndarray]], data: np.ndarray, starts: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """For each of the ascending ``starts`` the longest match with an earlier one, and the index of that one (-1: none), from the
    previous and next smaller starts in suffix order; lengths are cut at the deepest level, and 0 below ``least``."""
    order = suffix_order(levels[-1][1][starts])
    before = previous_smaller(order)
    after = len(order) - 1 - previous_smaller(order[::-1])[::-1]  # len(order) where there is none
    length, source = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
    for near in (before, after):
        have = np.flatnonzero((near >= 0) & (near < len(order)))
        own, other = order[have], order[near[have]]
        found = common_prefix(levels, data, starts[own], starts[other], least)
        better = found > length[own]
        length[own[better]], source[own[better]] = found[better], other[better]
    return length, source


def repeated_starts(data: np.ndarray, starts: np.ndarray, width: int, later_only: bool) -> np.ndarray:
    """For each of the ascending ``starts``: does the window there have an earlier copy (or else, unless ``later_only``, a later one).

    Equal windows follow each other in suffix order by place, so each but the last is the source of the next one's factor.
    """
    length, source = longest_previous_factor(ranks_by_depth(data, width), data, starts, width)
    found = length >= width
    if not later_only:
        found[source[found]] = True
    return found


# ---------------------------------------------------------------- anchors


def anchor_runs(symbols: np.ndarray, width: int = WIDTH, gram: int = BYTES.gram) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, window count, anchor hash) of each run of windows of ``symbols`` with one anchor."""
    lows, anchors, hashes = [], [], []
    windows = len(symbols) - width + 1
    span = width - gram + 1  # grams in a window
    for base in range(0, max(0, windows), PART):
        count = min(PART, windows - base)
        data = symbols[base : base + count + width - 1]
        at = np.arange(len(data) - gram + 1)
        full = range_hashes(data, at, at + gram)
        key = (full & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)
        padded = np.full(-(-len(key) // span) * span, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[: len(key)] = key
        table = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(table, axis=1).ravel()
        behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(behind[:count], ahead[span - 1 : span - 1 + count]) & np.uint64(0xFFFFFF)).astype(np.int64)
        low = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
        lows.append(low + base)
        anchors.append(least[low] + base)
        hashes.append(full[least[low]])
    if not lows:
        none = np.empty(0, np.int64)
        return none, none, none
    low, anchor, hashed = np.concatenate(lows), np.concatenate(anchors), np.concatenate(hashes)
    new = np.concatenate([[True], anchor[1:] != anchor[:-1]])  # a run may go on in the next part
    low, hashed = low[new], hashed[new]
    return low, np.diff(np.append(low, windows)), hashed.view(np.int64)


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (null: -1), a hash of the text that tells rows of one doc_id apart, and the text. The hash is odd where doc_id is null, so
    that a null is no other document's -1."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)).alias("doc"), marked_hash(F.col(id_col), text).alias("h"), text.alias("text"))


def marked_hash(doc: Column, text: Column) -> Column:
    return F.xxhash64(text).bitwiseAND(F.lit(-2)).bitwiseOR(doc.isNull().cast("long"))


def runs(rows: DataFrame, width: int, unit: Unit = BYTES) -> DataFrame:
    """One row per document and distinct context: doc, h, anchor, k1, k2 (128-bit context hash), lows, windows."""
    size = np.dtype(unit.kind).itemsize

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            out: list[tuple] = []
            lows: list[list[int]] = []
            for doc, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                raw = text.as_py().encode()
                if len(raw) < width:
                    continue
                symbols = unit.symbols(raw)
                if len(symbols) < width:
                    continue
                body = memoryview(symbols).cast("B")
                seen: dict[bytes, int] = {}
                for low, count, anchor in zip(*(x.tolist() for x in anchor_runs(symbols, width, unit.gram)), strict=True):
                    key = xxhash.xxh3_128_digest(body[size * low : size * (low + count + width - 1)])
                    if key in seen:
                        lows[seen[key]].append(low)
                    else:
                        seen[key] = len(out)
                        out.append((doc, h, anchor, int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), count))
                        lows.append([low])
                if len(out) > 50_000:
                    yield batch_of(out, lows)
                    out, lows = [], []
            if out:
                yield batch_of(out, lows)

    def batch_of(out: list[tuple], lows: list[list[int]]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.int32()), pa.array(lows, pa.list_(pa.int64()))],
            ["doc", "h", "anchor", "k1", "k2", "windows", "lows"],
        )

    return rows.mapInArrow(find, "doc long, h long, anchor long, k1 long, k2 long, windows int, lows array<long>")


# ---------------------------------------------------------------- spans


SPAN = "doc long, h long, low long, high long"


def _spans(doc: int, h: int, base: int, flags: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    for low, high in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
        yield doc, h, base + low, base + high - 1


def _span_batch(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc", "h", "low", "high"])


def repeated_windows(rows: DataFrame, width: int = WIDTH, later_only: bool = False, unit: Unit = BYTES) -> DataFrame:
    """(doc, h, spans): spans (low, high) of starts of repeated windows; with ``later_only`` of those with an earlier copy. A document that
    repeats one context many times is one row for it."""
    found = materialize(runs(rows, width, unit), "runs")
    shared = found.groupBy("anchor").agg(F.sum(F.size("lows")).alias("n")).where("n > 1").select("anchor")
    found = materialize(found.join(shared, "anchor", "left_semi"), "runs")
    contexts = materialize(
        found.groupBy("anchor", "k1", "k2").agg(
            F.sum(F.size("lows")).alias("copies"), F.min(F.struct("doc", "h", F.get("lows", F.lit(0)).alias("low"))).alias("first"), F.first("windows").alias("windows")
        ),
        "contexts",
    )
    # equal contexts
    places = found.join(contexts.where("copies > 1").select("anchor", "k1", "k2", "first"), ["anchor", "k1", "k2"])
    lows = F.col("lows")
    if later_only:
        own = (F.col("doc") == F.col("first.doc")) & (F.col("h") == F.col("first.h"))
        lows = F.filter("lows", lambda low: ~(own & (low == F.col("first.low"))))
    spans = places.select("doc", "h", F.transform(lows, lambda low: F.struct(low.alias("low"), (low + F.col("windows") - 1).alias("high"))).alias("spans")).where(F.size("spans") > 0)

    # one anchor, several contexts
    several = contexts.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds"), F.min("copies").alias("least")).where("kinds > 1")
    if not later_only:
        several = several.where("least = 1")
    wanted = materialize(
        contexts.join(several, "anchor").select("anchor", "kinds", "windows", "first.doc", "first.h", "first.low"), "wanted"
    )
    bytes_of = materialize(context_bytes(rows, wanted, width, unit), "bytes")
    small = bytes_of.where(F.col("kinds") <= MOST_CONTEXTS).repartition("anchor").sortWithinPartitions("anchor", "doc", "h", "low")
    large = bytes_of.where(F.col("kinds") > MOST_CONTEXTS)
    rest = small.mapInArrow(_blocks(width, later_only, unit), SPAN).unionByName(_refined(large, width, later_only, unit))
    return spans.unionByName(rest.select("doc", "h", F.array(F.struct("low", "high")).alias("spans")))


def context_bytes(rows: DataFrame, wanted: DataFrame, width: int, unit: Unit = BYTES) -> DataFrame:
    """anchor, kinds, doc, h, low and the symbols, as bytes, of each wanted context."""
    each = np.dtype(unit.kind).itemsize
    possible = id_filter(wanted.select("doc").distinct())

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            kept = batch.filter(pa.array(possible(batch.column(0).to_numpy())))
            if kept.num_rows:
                yield kept

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        names = ["anchor", "kinds", "doc", "h", "low", "bytes"]
        for batch in batches:
            out, size = [], 0
            for doc, h, text, asked in zip(*(batch.column(i) for i in range(4)), strict=True):
                body, doc, h = unit.symbols(text.as_py().encode()).tobytes(), doc.as_py(), h.as_py()
                for x in asked.as_py():
                    out.append((x["anchor"], x["kinds"], doc, h, x["low"], body[each * x["low"] : each * (x["low"] + x["windows"] + width - 1)]))
                    size += each * (x["windows"] + width)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 5 else pa.int64()) for k, c in enumerate(zip(*out, strict=True))], names)

    asked = wanted.groupBy("doc", "h").agg(F.collect_list(F.struct("anchor", "kinds", "low", "windows")).alias("asked"))  # at most one a window run of the text
    held = rows.mapInArrow(sieve, "doc long, h long, text string").dropDuplicates(["doc", "h"])
    return held.join(asked, ["doc", "h"]).select("doc", "h", "text", "asked").mapInArrow(cut, "anchor long, kinds long, doc long, h long, low long, bytes binary")


def _blocks(width: int, later_only: bool, unit: Unit = BYTES):
    """Suffix arrays over blocks of whole anchors; input is sorted by anchor, then place."""

    def solve(block: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, int]]:
        block.sort(key=lambda x: x[:3])  # positions in the block follow the order of places
        data = np.frombuffer(b"".join(x[3] for x in block), unit.kind)
        sizes = np.array([len(x[3]) for x in block]) // data.itemsize
        bases = np.concatenate([[0], np.cumsum(sizes)])
        starts = np.concatenate([np.arange(b, b + s - width + 1) for b, s in zip(bases[:-1], sizes, strict=True)])
        flags = repeated_starts(data, starts, width, later_only)
        ends = np.cumsum(sizes - width + 1)[:-1]
        return [span for x, f in zip(block, np.split(flags, ends), strict=True) if f.any() for span in _spans(x[0], x[1], x[2], f)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        block: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for anchor, _, doc, h, low, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if anchor != last and size >= BLOCK_SYMBOLS:
                    if spans := solve(block):
                        yield _span_batch(spans)
                    block, size = [], 0
                block.append((doc, h, low, body))
                size, last = size + len(body) // np.dtype(unit.kind).itemsize, anchor
        if block and (spans := solve(block)):
            yield _span_batch(spans)

    return run


def pieces_of(symbols: np.ndarray, width: int, gram: int) -> list[tuple[int, int, int, int]]:
    """(number, first window, last window, start of the core) of the pieces of a context.

    Windows of a piece start at most ``PIECE`` symbols apart, in steps counted from the anchor; its core is what a piece's
    windows have in common wherever they all exist, so equal windows are in pieces of one number and with equal cores.
    """
    at = np.arange(width - gram + 1)
    full = range_hashes(symbols[:width], at, at + gram)
    anchor = int(np.argmin((full & ~np.uint64(0xFFFFFF)) | at.astype(np.uint64)))
    last = len(symbols) - width
    numbers = range((anchor - last) // PIECE, anchor // PIECE + 1)
    return [(j, max(0, anchor - PIECE * j - PIECE + 1), min(last, anchor - PIECE * j), anchor - PIECE * j) for j in numbers]


def _long(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _refined(contexts: DataFrame, width: int, later_only: bool, unit: Unit = BYTES) -> DataFrame:
    """The same spans for anchors of very many contexts: by pieces with a longer common core, then by the single windows
    of those pieces whose core is shared but which differ."""
    each = np.dtype(unit.kind).itemsize
    place = ["anchor", "doc", "h", "low"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        names = [*place, "piece", "first", "last", "k1", "k2", "p1", "p2"]
        for batch in batches:
            out = []
            for anchor, _, doc, h, low, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for j, first, last, core in pieces_of(np.frombuffer(body, unit.kind), width, unit.gram):
                    key = xxhash.xxh3_128_digest(body[each * core : each * (core + width - PIECE + 1)], seed=j)
                    whole = xxhash.xxh3_128_digest(body[each * first : each * (last + width)], seed=j)
                    out.append((anchor, doc, h, low, j, low + first, low + last, *_long(key), *_long(whole)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names)

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            out = []
            for doc, h, low, body, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for j, first, last, _ in pieces_of(np.frombuffer(body, unit.kind), width, unit.gram):
                    if j in wanted:
                        out += [(*_long(xxhash.xxh3_128_digest(body[each * i : each * (i + width)])), doc, h, low + i) for i in range(first, last + 1)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["k1", "k2", "doc", "h", "low"])

    pieces = materialize(contexts.mapInArrow(cut, "anchor long, doc long, h long, low long, piece long, first long, last long, k1 long, k2 long, p1 long, p2 long"), "pieces")
    kinds = materialize(
        pieces.groupBy("k1", "k2", "p1", "p2").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc", "h", "first", "anchor", "low", "piece")).alias("one")), "kinds"
    )
    equal = pieces.join(kinds.where("copies > 1").select("k1", "k2", "p1", "p2", "one"), ["k1", "k2", "p1", "p2"])
    if later_only:
        equal = equal.where(F.struct("doc", "h", "first") != F.struct("one.doc", "one.h", "one.first"))
    several = kinds.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("copies").alias("least")).where("n > 1" if later_only else "n > 1 and least = 1")
    wanted = kinds.join(several, ["k1", "k2"]).groupBy(*[F.col(f"one.{c}").alias(c) for c in place]).agg(F.collect_set("one.piece").alias("wanted"))  # a context has few pieces
    single = contexts.join(wanted, place).select("doc", "h", "low", "bytes", "wanted").mapInArrow(hashes, "k1 long, k2 long, doc long, h long, low long")
    single = materialize(single, "windows")
    counts = single.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "h", "low")).alias("one")).where("n > 1")
    hit = single.join(counts, ["k1", "k2"])
    if later_only:
        hit = hit.where(F.struct("doc", "h", "low") != F.col("one"))
    return equal.select("doc", "h", F.col("first").alias("low"), F.col("last").alias("high")).unionByName(hit.select("doc", "h", "low", F.col("low").alias("high")))


# ---------------------------------------------------------------- removal


def covered(spans: list[tuple[int, int]], width: int) -> list[tuple[int, int]]:
    """Maximal runs of symbols covered by the windows that start in ``spans``."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high + width))
        else:
            out.append((low, high + width))
    return out


def byte_cuts(raw: bytes, spans: list[tuple[int, int]], width: int, words: bool) -> list[tuple[int, int]]:
    """What to cut from ``raw``; a run of words goes with the white space after it."""
    cuts = covered(spans, width)
    if not words or not cuts:
        return cuts
    starts = np.append(word_bounds(raw)[0], len(raw)).tolist()
    return [(starts[a], starts[b]) for a, b in cuts]


def without(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for cut in cuts for x in cut), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if cuts else raw


def with_spans(rows: DataFrame, spans: DataFrame, possible: Callable[[np.ndarray], np.ndarray], how: str) -> DataFrame:
    """doc, h, text and spans of the ``rows`` that ``possible`` lets through; few more than have spans.

    A merge join: behind a broadcast one the sieve and the caller's function would stand in one task, with a Python worker
    each, and executors keep every worker they have once started.
    """

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            yield batch.filter(pa.array(possible(batch.column(0).to_numpy())))

    listed = spans.groupBy("doc", "h").agg(F.flatten(F.collect_list("spans")).alias("spans"))  # bounded by the text's length
    return rows.mapInArrow(sieve, "doc long, h long, text string").join(listed.hint("merge"), ["doc", "h"], how).select("doc", "h", "text", "spans")


def remove_repeats(docs: DataFrame, width: int = WIDTH, later_only: bool = False, keep_text: bool = False, words: bool = False, passage: int = 0) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passages, and with ``keep_text`` h and kept (bytes) of every row.

    Removed are repeated strings of ``width`` bytes, or with ``words`` of ``width`` words. With ``passage``, n_passages
    is the number of maximal runs of words of the row covered by strings of so many words that also stand elsewhere;
    it removes nothing. Only rows with something repeated are shuffled; the others are described where they are read.
    """
    rows = keyed(docs)
    marked = lambda found, cut: found.select("doc", "h", F.transform("spans", lambda s: F.struct(F.lit(cut).alias("cut"), s["low"].alias("low"), s["high"].alias("high"))).alias("spans"))
    spans = marked(repeated_windows(rows, width, later_only, WORDS if words else BYTES), True)
    if passage:
        spans = spans.unionByName(marked(repeated_windows(rows, passage, unit=WORDS), False))
    spans = materialize(spans, "spans")
    possible = id_filter(spans.select("doc").distinct())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages", *(["h", "kept"] if keep_text else [])]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.int64()] + [pa.int64(), pa.binary()] * keep_text
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long" + ", h long, kept binary" * keep_text

    def describe(items: Iterator[tuple[int, int, str, list[dict]]]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for doc, h, text, found in items:
            raw = text.encode()
            cuts = byte_cuts(raw, [(x["low"], x["high"]) for x in found if x["cut"]], width, words)
            kept = without(raw, cuts)
            runs_ = len(covered([(x["low"], x["high"]) for x in found if not x["cut"]], passage))
            out.append((None if h & 1 else doc, len(raw), len(raw) - len(kept), len(cuts), hashlib.sha256(kept).hexdigest(), runs_, *((h, kept) if keep_text else ())))
            size += len(kept) * keep_text + 200
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            part = batch.filter(pa.array(~possible(batch.column(0).to_numpy())))
            yield from describe((d.as_py(), h.as_py(), t.as_py(), []) for d, h, t in zip(*part.columns, strict=True))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            yield from describe((d.as_py(), h.as_py(), t.as_py(), s.as_py() or []) for d, h, t, s in zip(*batch.columns, strict=True))

    return rows.mapInArrow(untouched, schema).unionByName(with_spans(rows, spans, possible, "left").mapInArrow(touched, schema))


def drop_later_copies(docs: DataFrame, width: int = PASSAGE, words: bool = True) -> DataFrame:
    """``docs`` whose texts have lost each copy of a string of ``width`` words (or else bytes) but the first; texts that lose all of it go.

    ``n_chars`` follows the text where there is such a column. A character that a cut splits goes with it. Extra columns may have any name.
    """
    id_, th, doc, h, kept = own_names(docs, "id", "th", "doc", "h", "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = keyed(docs)
    spans = materialize(repeated_windows(rows, width, True, WORDS if words else BYTES), "spans")
    changed = with_spans(rows, spans, id_filter(spans.select("doc").distinct()), "inner")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            left = []
            for t, found in zip(batch.column(2), batch.column(3), strict=True):
                raw = t.as_py().encode()
                left.append(without(raw, byte_cuts(raw, [(x["low"], x["high"]) for x in found.as_py()], width, words)).decode(errors="ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(left, pa.string())], ["doc", "h", "kept"])

    whole = changed.mapInArrow(cut, "doc long, h long, kept string").dropDuplicates(["doc", "h"]).toDF(doc, h, kept)
    joined = docs.withColumn(id_, F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))).withColumn(th, marked_hash(F.col("doc_id"), text)).join(
        whole, (F.col(id_) == F.col(doc)) & (F.col(th) == F.col(h)), "left"
    )
    new = joined.withColumn("text", F.coalesce(kept, "text"))
    if "n_chars" in docs.columns:
        new = new.withColumn("n_chars", F.when(F.col(kept).isNotNull(), F.length(kept).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return new.where(F.col(kept).isNull() | (F.col(kept) != "")).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_repeats_sql(width: int = WIDTH, passage: int = PASSAGE, part: int = 1000) -> str:
    """The result of ``remove_repeats`` with passages, in SQL by counting every window; texts are cut into parts only to reach their places fast."""

    def islands(found: str, size: int) -> str:
        return f"""SELECT k, p, CASE WHEN p - lag(p) OVER each > {size} THEN 1 WHEN lag(p) OVER each IS NULL THEN 1 ELSE 0 END AS new,
      least({size}, coalesce(lead(p) OVER each - p, {size})) AS own FROM {found} WINDOW each AS (PARTITION BY k ORDER BY p)"""

    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS x FROM documents),
  parts AS (SELECT k, c, substr(x, {2 * part} * c + 1, {2 * (part + width - 1)}) AS y FROM (SELECT k, x, unnest(range(0, greatest(0, len(x) // 2 - {width - 1}) // {part} + 1)) AS c FROM d)),
  windows AS (SELECT k, {part} * c + i AS p, md5(substr(y, 2 * i + 1, {2 * width})) AS m FROM (SELECT k, c, y, unnest(range(0, least({part}, len(y) // 2 - {width - 1}))) AS i FROM parts)),
  again AS (SELECT m FROM windows GROUP BY m HAVING count(*) > 1),
  starts AS (SELECT k, p FROM windows SEMI JOIN again USING (m)),
  numbered AS (SELECT k, p, own, sum(new) OVER (PARTITION BY k ORDER BY p) AS island FROM ({islands("starts", width)})),
  spans AS (SELECT k, island, min(p) AS low, max(p) + {width} AS high FROM numbered GROUP BY k, island),
  before AS (SELECT k, low, high, coalesce(lag(high) OVER (PARTITION BY k ORDER BY low), 0) AS since FROM spans),
  cut AS (SELECT k, sum(high - low) AS removed, count(*) AS n, max(high) AS last, string_agg(substr(x, 2 * since + 1, 2 * (low - since)), '' ORDER BY low) AS kept FROM before JOIN d USING (k) GROUP BY k),
  words AS (SELECT k, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
  runs AS (SELECT k, i - 1 AS p, md5(array_to_string(ws[i : i + {passage - 1}], ' ')) AS m FROM (SELECT k, ws, unnest(range(1, len(ws) - {passage - 2})) AS i FROM words)),
  runs_again AS (SELECT m FROM runs GROUP BY m HAVING count(*) > 1),
  run_starts AS (SELECT k, p FROM runs SEMI JOIN runs_again USING (m)),
  passages AS (SELECT k, sum(new) AS n FROM ({islands("run_starts", passage)}) GROUP BY k)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(cut.n, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN cut.k IS NULL THEN x ELSE kept || substr(x, 2 * last + 1) END)) AS kept_sha256, coalesce(passages.n, 0)::BIGINT AS n_passages
FROM d LEFT JOIN cut USING (k) LEFT JOIN passages USING (k)"""
