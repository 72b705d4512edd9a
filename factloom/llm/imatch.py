"""I-Match document fingerprints over randomised lexicons.

Terms are runs of ASCII letters and digits or bytes beyond ASCII, A-Z lower-cased. The lexicon keeps the terms
whose share of documents lies in a band, that is an inverse document frequency between ``ln(1 / MAX_SHARE)``
and ``ln(1 / MIN_SHARE)``. A fingerprint is the hash of a text's sorted distinct lexicon terms, followed by
one hash for each of ``SUBSETS`` randomised sub-lexicons. Sub-lexicons come in levels that keep one half, one
quarter, ... of the lexicon, so that some stay unchanged under small edits and some even under large ones.

The lexicon's size is bounded: with on average t distinct terms a document at most ``t / MIN_SHARE`` terms
can be that frequent, however many documents there are.

Defined cases: null text: empty; a text without lexicon terms is fingerprinted over all its terms; without any
term all hashes are those of nothing; equal texts have equal fingerprints; repeated doc_ids are ordered
by a hash of the text; a null doc_id comes last in the order; a single document's next document is itself; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import mix
from .common import texts

MIN_SHARE, MAX_SHARE = 0.001, 0.1
SUBSETS, LEVELS = 48, 8
HELD_TERMS, TERMS_AT_ONCE = 500_000, 20_000
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PLACES = np.uint64(1) << np.arange(SUBSETS, dtype=np.uint64)
KEPT = np.uint64(1 << 32) >> (np.arange(SUBSETS, dtype=np.uint64) % np.uint64(LEVELS) + np.uint64(1))


def terms(raw: bytes) -> set[bytes]:
    return set(raw.translate(TABLE).split())


def hashes(found: set[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))


def memberships(h: np.ndarray) -> np.ndarray:
    """One row per term: in which sub-lexicons it is."""
    return (mix(h[:, None] ^ SEEDS[None, :]) >> np.uint64(32)) < KEPT[None, :]


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term (64-bit hash) and n, over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(hashes(held).view(np.int64)), pa.array(list(held.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for text in batch.column(0):
                held.update(terms(text.as_py().encode()))
                if len(held) > HELD_TERMS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return docs.select("text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> np.ndarray:
    """Sorted term hashes of the band."""
    n = docs.count()
    band = document_frequencies(docs).where((F.col("n") >= min_share * n) & (F.col("n") <= max_share * n))
    return np.sort(band.select("term").toPandas()["term"].to_numpy(np.int64).view(np.uint64))


class Fingerprinter:
    """The lexicon costs 16 bytes a term: its hash, and one bit for each sub-lexicon."""

    def __init__(self, words: np.ndarray):
        self.words = words
        parts = [words[i : i + TERMS_AT_ONCE] for i in range(0, len(words), TERMS_AT_ONCE)]
        self.bits = np.concatenate([*((memberships(p) * PLACES).sum(1, dtype=np.uint64) for p in parts), np.empty(0, np.uint64)])

    def signatures(self, text: str) -> np.ndarray:
        """The full hash and ``SUBSETS`` hashes, 0 where a sub-lexicon has none of the terms."""
        h = hashes(terms(text.encode()))
        at = np.minimum(np.searchsorted(self.words, h), max(0, len(self.words) - 1))
        at = at[self.words[at] == h] if len(self.words) else at[:0]
        if len(at):
            at.sort()
            h, member = self.words[at], (self.bits[at, None] & PLACES) != 0
        else:
            h = np.sort(h)
            member = memberships(h) if len(h) else np.zeros((0, SUBSETS), bool)
        out = np.empty(SUBSETS + 1, np.uint64)
        out[0] = xxhash.xxh3_64_intdigest(h.tobytes())
        out[1:] = mix((mix(h)[:, None] * member).sum(0, dtype=np.uint64)) >> np.uint64(40)
        out[1:][~member.any(0)] = 0
        return out


def fingerprint(signatures: np.ndarray) -> str:
    return f"{int(signatures[0]):016x}" + "".join(f"{x:06x}" for x in signatures[1:].tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal term sets, else the share of equal hashes among the sub-lexicons that either text meets."""
    if a[0] == b[0]:
        return 1.0
    met = (a[1:] != 0) | (b[1:] != 0)
    return float((a[1:] == b[1:])[met].mean()) if met.any() else 0.0


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) dealt into ranges of doc_id, plus ``part`` and ``ghost``: sorted within partitions by
    (part, ghost, descending doc_id), each row's next row in its part is the next document of the whole table.

    Each part ends with a copy, the ghost, of the first row of the part that follows; the last part's is the
    very first row. Only range bounds and one doc_id for each range come to the driver.
    """
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * partitions
    bounds = sorted(set(docs.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    part = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: F.col("doc_id") > b)) if bounds else F.lit(0)
    ranged = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part))
    firsts = sorted(((r[0], r[1]) for r in ranged.groupBy("part").agg(F.max("doc_id")).collect()), reverse=True)  # one a range
    if not firsts:
        return ranged.withColumn("ghost", F.lit(False))
    before = [*[firsts[k - 1][0] for k in range(1, len(firsts))]]
    sent = [(firsts[0][1], firsts[0][0], firsts[-1][0])] + [(i, p, q) for (p, i), q in zip(firsts[1:], before, strict=True)]
    ghosts = spark.createDataFrame(sent, "first long, own int, part int")
    copies = (
        ranged.withColumnRenamed("part", "_own")
        .join(F.broadcast(ghosts), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("_own") == F.col("own")))
        .select("doc_id", "text", "part", F.lit(True).alias("ghost"))
    )
    return (
        ranged.select("doc_id", "text", "part", F.lit(False).alias("ghost"))
        .unionByName(copies)
        .repartition(partitions, "part")
        .sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    )


def fingerprint_documents(docs: DataFrame, min_share: float = MIN_SHARE, max_share: float = MAX_SHARE) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness to each other and to the next document's."""
    docs = texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon(docs, min_share, max_share))  # bounded, see above
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Fingerprinter(shared.value)
        last: tuple | None = None  # doc_id, text, part, signatures
        rows: list[tuple] = []
        done = None  # the part whose ghost has been used
        for batch in batches:
            for doc, text, part, ghost in zip(batch.column(0).to_pylist(), batch.column(1), *(batch.column(i).to_pylist() for i in (2, 3)), strict=True):
                if ghost and part == done:
                    continue
                text = text.as_py()
                signed = make.signatures(text)
                if last is not None:
                    own = last[1]
                    half = len(own) // 2
                    edited = own[: len(own) - half] + text[:half]
                    changed = make.signatures(edited)
                    rows.append(
                        (last[0], len(own), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(last[3]), fingerprint(changed), likeness(last[3], changed), likeness(last[3], signed))
                    )
                last, done = (None, part) if ghost else ((doc, text, part, signed), done)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []

    return with_next(docs).mapInArrow(run, schema)
