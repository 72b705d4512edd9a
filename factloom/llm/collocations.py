"""Phrase collocations by hashed level-wise mining (PCY with direct hashing and pruning).

One pass over the texts for each phrase length k. A pass counts exactly those k-grams that may be frequent, and at the
same time counts the (k+1)-grams into ``BUCKETS`` hash buckets. A k-gram may be frequent where its bucket of the pass before
reached the support, and where both its (k-1)-grams are frequent (Apriori). Both are looked up in bit tables of ``BUCKETS``
bits, all that is ever broadcast, whatever the corpus; a wrong hit costs a count, never a result. From the second pass on
only (k+1)-grams of two surviving k-grams enter the buckets.

Counts are exact: within a task phrases are told apart by dictionary codes of their words, between tasks by their text.
Buckets travel as sorted numbers with counts cut at the support (their sum still says whether the support is reached), and
are added up on executors; one bit a bucket reaches the driver. Texts are cut at piece ends into parts of ``PART_BYTES``, so a
very long text costs no more memory; no phrase crosses a piece end.

Defined cases: a null text counts as empty; a null language is ``und``, the same as a language of that name; repeated rows
count each; empty texts and empty tables give no phrases; ties of a score are ordered by count, then by the phrase's
bytes; extra columns are ignored. Counts and their product with 1000 must stay below 10^38 (decimals), scores below 2^63.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bloom import mix
from .common import keep_only, materialize, small_batches

SUPPORT, LONGEST, TOP, PERCENT = 100, 5, 2000, 100
SLOTS, LOW_BITS, COUNT_BITS = 1024, 17, 15  # BUCKETS = SLOTS << LOW_BITS
BUCKETS = SLOTS << LOW_BITS  # 2^27: 16 MiB of bits
PARTS = 64
PART_BYTES = 4 << 20
ENTRIES = 1 << 21  # bucket counts that a task holds before it hands them on
SALTS = 64

_PIECE_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
_KIND = np.zeros(256, np.uint8)  # 0 a byte of a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[list(b".,;:!?\x0a\x0b\x0c\x0d")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
LEVEL = "lang string, phrase string, n long, slot int, counts binary"


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` of the words' hashes."""
    n = len(words) - k + 1
    total = np.full(max(n, 0), k, np.uint64)
    for j in range(k if n > 0 else 0):
        total += words[j : n + j] * _FACTORS[j]
    return mix(total)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 27)).astype(np.int64)


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[str, bytes]]]:
    """(language, text) in lists of about ``PART_BYTES``; longer texts are cut at piece ends."""
    held, size = [], 0
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            raw, name, low = text.as_py().encode(), lang.as_py(), 0
            while low < len(raw):
                end = _PIECE_END.search(raw, low + PART_BYTES - size) if len(raw) - low > PART_BYTES - size else None
                high = end.end() if end else len(raw)
                held.append((name, raw[low:high]))
                size += high - low
                low = high
                if size >= PART_BYTES:
                    yield held
                    held, size = [], 0
    if held:
        yield held


class Tokens:
    """The words of a list of texts: dictionary codes, hashes, pieces and languages."""

    def __init__(self, texts: list[tuple[str, bytes]]):
        self.langs = sorted({lang for lang, _ in texts})
        code_of = {lang: k for k, lang in enumerate(self.langs)}
        raw = np.frombuffer(b"\n".join([b"", *(t for _, t in texts), b""]), np.uint8)
        kind = _KIND[raw]
        inside = kind == 0
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1  # the text begins and ends between words
        starts, ends = edges[::2], edges[1::2]
        self.piece = np.cumsum(kind == 2, dtype=np.int32)[starts]
        begins = np.cumsum([1, *(len(t) + 1 for _, t in texts)])
        self.lang = np.array([code_of[lang] for lang, _ in texts], np.int64)[np.searchsorted(begins, starts, "right") - 1]
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[inside]])).dictionary_encode()
        self.words, codes = words.dictionary, words.indices.to_numpy().astype(np.int64)
        self.size = max(len(self.words), 1)
        self.code = self.lang * self.size + codes
        own = hashes_of([w.encode() for w in self.words.to_pylist()])
        self.hash = mix(own[codes] + hashes_of([lang.encode() for lang in self.langs])[self.lang] * np.uint64(0x9E3779B97F4A7C15))

    def runs(self, k: int) -> np.ndarray:
        """Where do ``k`` words of one piece begin?"""
        n = len(self.piece) - k + 1
        return self.piece[:n] == self.piece[k - 1 :] if n > 0 else np.zeros(0, bool)

    def counted(self, at: np.ndarray, k: int) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Language, text and count of the distinct phrases of ``k`` words that begin at ``at``."""
        key = self.code[at]
        for j in range(1, k):
            _, key = np.unique(key, return_inverse=True)
            key = key * (len(self.langs) * self.size) + self.code[at + j]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        words = [self.words.take(pa.array(self.code[first + j] % self.size)) for j in range(k)]
        text = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if k > 1 else words[0]
        return pa.array(self.langs, pa.string()).take(pa.array(self.lang[first])), text.cast(pa.string()), n


class BucketCounts:
    """Sorted buckets with counts; handed on once there are ``ENTRIES`` different ones."""

    def __init__(self, most: int):
        self.most, self.held, self.size = most, [], 0

    def add(self, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        keys, n = np.unique(at, return_counts=True)
        self.held.append((keys.astype(np.uint32), np.minimum(n, self.most).astype(np.uint32)))
        self.size += len(keys)
        if self.size > 2 * ENTRIES:
            self._merge()
            if self.size > ENTRIES:
                yield from self.rows()

    def _merge(self) -> None:
        keys, where = np.unique(np.concatenate([k for k, _ in self.held]), return_inverse=True)
        n = np.minimum(np.bincount(where, np.concatenate([n for _, n in self.held]), len(keys)), self.most)
        self.held, self.size = [(keys, n.astype(np.uint32))], len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """A row a slot: the low bits of its buckets with their counts."""
        if self.size:
            self._merge()
            keys, n = self.held[0]
            cuts = np.searchsorted(keys >> LOW_BITS, np.arange(SLOTS + 1))
            packed = ((keys & ((1 << LOW_BITS) - 1)) << COUNT_BITS | n).astype("<u4")
            used = np.flatnonzero(np.diff(cuts))
            yield level_rows(slot=used.astype(np.int32), counts=[packed[cuts[s] : cuts[s + 1]].tobytes() for s in used.tolist()])
            self.held, self.size = [], 0


def level_rows(**columns) -> pa.RecordBatch:
    kinds = {"lang": pa.string(), "phrase": pa.string(), "n": pa.int64(), "slot": pa.int32(), "counts": pa.binary()}
    size = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in kinds.items()], list(kinds))


def bit_table(rows: DataFrame, support: int) -> np.ndarray:
    """One bit for each bucket whose counts in ``rows`` (slot, counts) reach ``support``; added up on executors."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = np.frombuffer(counts.as_py(), "<u4")
                totals.setdefault(slot, np.zeros(1 << LOW_BITS, np.uint32))[packed >> COUNT_BITS] += packed & ((1 << COUNT_BITS) - 1)  # buckets of a row differ
        for slot, n in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([np.packbits(n >= support).tobytes()], pa.binary())], ["slot", "bits"])

    table = np.zeros(BUCKETS // 8, np.uint8)
    width = (1 << LOW_BITS) // 8
    merged = rows.where("slot is not null").select("slot", "counts").repartition(PARTS, "slot").mapInArrow(merge, "slot int, bits binary")
    for slot, bits in merged.collect():  # SLOTS rows of BUCKETS / SLOTS bits
        table[slot * width : (slot + 1) * width] = np.frombuffer(bits, np.uint8)
    return table


def frequent_bits(frequent: DataFrame, support: int) -> np.ndarray:
    """The bit table of exactly frequent phrases (lang, phrase)."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        counts = BucketCounts(support)
        for batch in batches:
            found = []
            for lang, phrase in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = mix(hashes_of(phrase.encode().split(b" ")) + hashes_of([lang.encode()]) * np.uint64(0x9E3779B97F4A7C15))
                found.append(gram_hash(words, len(words))[0])
            if found:
                yield from counts.add(bucket(np.array(found, np.uint64)))
        yield from counts.rows()

    return bit_table(frequent.select("lang", "phrase").mapInArrow(mark, LEVEL), 1)


def has_bit(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).astype(bool)


def level(texts: DataFrame, k: int, support: int, longest: int, tables=None) -> DataFrame:
    """One pass: rows of exact counts (lang, phrase, n), of the counts of all words (phrase ``''``, first pass only) and of bucket counts of
    the next length (slot, counts). ``tables``: broadcast bits of this length's buckets and of frequent shorter phrases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        following = BucketCounts(support)
        for texts_held in parts(batches):
            t = Tokens(texts_held)
            alive = t.runs(k)
            if tables is not None:
                buckets, shorter = tables.value
                at = np.flatnonzero(alive)
                before = has_bit(shorter, bucket(gram_hash(t.hash, k - 1)))
                at = at[before[at] & before[at + 1]]
                at = at[has_bit(buckets, bucket(gram_hash(t.hash, k)[at]))]
                alive = np.zeros(len(alive), bool)
                alive[at] = True
            else:
                at = np.flatnonzero(alive)
                n = np.bincount(t.lang, minlength=len(t.langs))
                yield level_rows(lang=t.langs, phrase=[""] * len(t.langs), n=n)
            if len(at):
                lang, phrase, n = t.counted(at, k)
                yield level_rows(lang=lang, phrase=phrase, n=n)
            if k < longest and len(alive) > 1:
                longer = t.runs(k + 1) & alive[:-1] & alive[1:]
                if longer.any():
                    yield from following.add(bucket(gram_hash(t.hash, k + 1)[longer]))
        yield from following.rows()

    return materialize(texts.mapInArrow(run, LEVEL), f"phrases-{k}")


def frequent_phrases(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(lang, k, phrase, f) of all phrases of 1 to ``longest`` words with at least ``support`` occurrences, and (lang, n)."""
    if not 1 <= support < 1 << COUNT_BITS or not 1 <= longest <= len(_FACTORS):
        raise ValueError(f"support is 1 to {(1 << COUNT_BITS) - 1}, the longest phrase 1 to {len(_FACTORS)} words")
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    found, totals, tables = None, None, None
    for k in range(1, longest + 1):
        rows = level(texts, k, support, longest, tables)
        counts = rows.where("phrase is not null").groupBy("lang", "phrase").agg(F.sum("n").alias("f"))
        if k == 1:
            both = materialize(counts.where(f"f >= {support} or phrase = ''"), "frequent-1")
            frequent, totals = both.where("phrase <> ''"), both.where("phrase = ''").select("lang", F.col("f").alias("n"))
        else:
            tables.destroy()
            frequent = materialize(counts.where(f"f >= {support}"), f"frequent-{k}")
        own = frequent.select("lang", F.lit(k).alias("k"), "phrase", "f")
        found = own if found is None else found.unionByName(own)
        if k == longest or frequent.isEmpty():
            break
        tables = spark.sparkContext.broadcast((bit_table(rows, support), frequent_bits(frequent, support)))  # BUCKETS / 4 bytes
    return found, totals


def _words(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def collocations(docs: DataFrame, support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of 2 words and more, by the score of their weakest cut.

    A phrase goes where a longer candidate holds it and occurs at least ``percent`` / 100 as often.
    """
    frequent, totals = frequent_phrases(docs, support, longest, lang_col, text_col)
    candidates = frequent.where("k >= 2").withColumn("words", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "words", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", _words(F.lit(1), F.col("cut")).alias("left"), _words(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    part = lambda side: frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(side[0]))
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.join(part("left"), ["lang", "left"]).join(part("right"), ["lang", "right"]).join(totals, "lang")
    cuts = cuts.withColumns({"over": F.lit(1000).cast("decimal(4,0)") * whole("a") * whole("n"), "under": whole("l") * whole("r")}).withColumn("score", F.expr("over div under"))
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("c"))
    longer = candidates.where("k >= 3").select("lang", "f", "words", "k", F.explode(F.sequence(F.lit(2), F.col("k") - 1)).alias("size"))
    longer = longer.select("lang", "f", "words", "size", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)).alias("first"))
    longer = longer.groupBy("lang", _words(F.col("first"), F.col("size")).alias("phrase")).agg(F.max("f").alias("over"))
    covered = (F.col("over").cast("decimal(19,0)") * 100 >= whole("a") * percent)
    kept = weakest.join(longer, ["lang", "phrase"], "left").where(F.col("over").isNull() | ~covered)
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("_salt"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    few = kept.withColumn("rank", rank("lang", "_salt")).where(F.col("rank") <= top)  # a language is ranked in SALTS places first
    return few.withColumn("rank", rank("lang")).where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations_sql(support: int = SUPPORT, longest: int = LONGEST, top: int = TOP, percent: int = PERCENT) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {k} AS k, array_to_string(w[i:i + {k - 1}], ' ') AS phrase, count(*) AS f FROM (SELECT lang, w, unnest(range(1, len(w) - {k} + 2)) AS i FROM words WHERE len(w) >= {k}) GROUP BY ALL HAVING count(*) >= {support}"
        for k in range(1, longest + 1)
    )
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w))::bigint AS n FROM words GROUP BY lang),
grams AS ({grams}),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM candidates),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, p.f AS l, q.f AS r, t.n, ((1000::hugeint * c.a * t.n) // (p.f::hugeint * q.f))::bigint AS score FROM cuts c
  JOIN grams p ON p.lang = c.lang AND p.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN grams q ON q.lang = c.lang AND q.phrase = array_to_string(c.w[c.cut + 1:], ' ') JOIN totals t ON t.lang = c.lang
), weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
inner_parts AS (SELECT lang, a, w, k, unnest(range(2, k)) AS size FROM candidates), starts AS (SELECT *, unnest(range(1, k - size + 2)) AS i FROM inner_parts),
longer AS (SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, max(a) AS over FROM starts GROUP BY ALL)
SELECT w.lang, row_number() OVER (PARTITION BY w.lang ORDER BY w.score DESC, w.a DESC, w.phrase) AS rank, w.phrase, w.a, w.l, w.r, w.n, w.score
FROM weakest w LEFT JOIN longer o ON o.lang = w.lang AND o.phrase = w.phrase WHERE o.over IS NULL OR 100 * o.over < {percent} * w.a QUALIFY rank <= {top}"""
