"""Grouped prefix join for n-gram Jaccard similarity.

A document's set holds its distinct word n-grams. All sets are sorted by one global order, rare n-grams
first; two sets of the wanted similarity then share an n-gram in their prefixes. Documents with the same
prefix and size form a group, and only groups enter the inverted index. Group pairs pass a length and a
positional filter; their members are then compared exactly on whole sets.

Only components are wanted, so no group is expanded into all its pairs:

1. Equal sets collapse into their smallest doc_id. Each group member meets its group's first document, and
   each group meets the one leading group with which it shares most prefix n-grams.
2. Verified links give components. An index entry whose documents are all in one component is finished.
   In the others, every pair from *different* components that passes the filters and was not met before is
   compared. A link inside a component changes nothing, so the result is exact. Members of one group share
   their whole prefix, so the group's first n-gram stays in the index for them even when no other group has it.

Before texts are fetched, pairs pass a small parity table of each set, which bounds the overlap from above.

The order uses n-gram counts over all documents in a counting table of fixed size (``BUCKETS``); any fixed
order gives the same result, counts only make prefixes selective. N-grams and words are 64-bit hashes.

Defined cases: null, empty and blank texts have an empty set and link with nothing; texts shorter than the
n-gram have one element, the whole sequence; repeated rows are copies of each other; rows that share a
doc_id share their links; a null doc_id gets a null component; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom import id_filter, mix
from .common import keep_only, materialize, own_names, texts
from .components import connected_components

N = 5
PERCENT = 75
BUCKETS = 1 << 24
PARITY_BITS = 1 << 16
SLOTS, SLOTS_AT_ONCE = 2048, 64  # what crosses to Python at once stays small, however many partitions meet in a slot
PARTS = 32
INNER = 1 << 31  # marks, beside the position, the first n-gram of a group with several members
LARGEST_COUNT = 40_000  # of one partition and bucket; leaves room for a batch more

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def ngram_set(raw: bytes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of UTF-8 ``raw``; words are split at ASCII white space and A-Z lower-cased."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(words))
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _FACTORS[i % len(_FACTORS)] * np.uint64(2 * (i // len(_FACTORS)) + 1)
    return np.unique(mix(total))


def prefix_size(size: int, percent: int = PERCENT) -> int:
    return size + (-percent * size) // 100 + 1


def count_classes(docs: DataFrame, n: int = N) -> np.ndarray:
    """For each of ``BUCKETS`` buckets of n-grams the class of its count: 0 up to one, then by powers of two.

    Executors count and classify; one byte a bucket comes to the driver, whatever the input.
    """
    width = BUCKETS // SLOTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        total = np.zeros(BUCKETS, np.uint16)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, (ngram_set(text.as_py().encode(), n) & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
            np.minimum(total, LARGEST_COUNT, out=total)
        rows = total.reshape(SLOTS, width)
        for low in range(0, SLOTS, SLOTS_AT_ONCE):
            part = rows[low : low + SLOTS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array(range(low, low + len(part)), pa.int32()), pa.array([r.astype("<u2").tobytes() for r in part], pa.binary())], ["slot", "counts"])

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for slot, counts in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sums.setdefault(slot, np.zeros(width, np.uint32))[:] += np.frombuffer(counts.as_py(), "<u2")
        for slot, v in sums.items():
            classes = np.ceil(np.log2(np.maximum(v, 1))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([classes.tobytes()], pa.binary())], ["slot", "classes"])

    parts = docs.select("text").mapInArrow(count, "slot int, counts binary").repartition(PARTS, "slot").mapInArrow(classify, "slot int, classes binary")
    out = np.zeros(BUCKETS, np.uint8)
    for slot, classes in parts.toLocalIterator():  # SLOTS rows of BUCKETS / SLOTS bytes
        out[slot * width : (slot + 1) * width] = np.frombuffer(classes, np.uint8)
    return out


def signatures(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, size, set_hash, group_hash, parity table and prefix of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(count_classes(docs, n))  # BUCKETS bytes

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        classes = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = ngram_set(text.as_py().encode(), n)
                if not len(s):
                    rows.append((doc, 0, b"", 0, np.empty(0, np.int64), b""))
                    continue
                kept = prefix_size(len(s), percent)
                key = (classes[(s & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)) | (s >> np.uint64(6))
                prefix = np.sort(key)[:kept] if kept >= len(key) else np.sort(np.partition(key, kept - 1)[:kept])
                group = xxhash.xxh3_64_intdigest(prefix.tobytes(), seed=len(s)) >> 1
                rows.append((doc, len(s), xxhash.xxh3_128_digest(s.tobytes()), group, prefix.view(np.int64), parity_table(s)))
            if not rows:
                continue
            columns = list(zip(*rows, strict=True))
            ends = np.cumsum([0, *map(len, columns[4])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(columns[4]), pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64()), prefix, pa.array(columns[5], pa.binary())],
                ["doc_id", "size", "set_hash", "group_hash", "prefix", "parity"],
            )

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, size long, set_hash binary, group_hash long, prefix array<long>, parity binary")


def _fits(size_a: Column, pos_a: Column, size_b: Column, pos_b: Column, percent: int) -> Column:
    """Length filter, and positional filter as it holds at a pair's first shared n-gram.

    At the first shared n-gram nothing before it is shared, so the overlap is at most 1 + what is left. A
    pair that is similar enough passes there; whether it passes at later n-grams does not matter.
    """
    least = F.lit(percent) * (size_a + size_b)  # overlap * (100 + percent) must reach this
    return (F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * percent) & (
        (1 + F.least(size_a - pos_a - 1, size_b - pos_b - 1)) * (100 + percent) >= least
    )


def parity_table(grams: np.ndarray) -> bytes:
    """One bit per hash bucket: whether an odd number of n-grams falls there; about four buckets an n-gram."""
    bits = min(PARITY_BITS, max(512, 1 << (4 * len(grams) - 1).bit_length()))
    return np.packbits(np.bincount((grams >> np.uint64(40) & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1).tobytes()


def largest_overlap(size_a: int, a: bytes, size_b: int, b: bytes) -> float:
    """An upper bound of two sets' overlap: every bucket of unlike parity holds an n-gram that only one set has.

    The larger table folds onto the smaller one.
    """
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(t.reshape(-1, width), axis=0) for t in (x, y))
    return (size_a + size_b - int(np.bitwise_count(x ^ y).sum())) / 2


def prune(signed: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Pairs whose parity tables leave the similarity possible."""

    def possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in (2, 4)]
            kept = [
                i
                for i, (n_a, n_b, x, y) in enumerate(zip(*columns, batch.column(3), batch.column(5), strict=True))
                if largest_overlap(n_a, x.as_py(), n_b, y.as_py()) * (100 + percent) >= percent * (n_a + n_b)
            ]
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    side = lambda c: signed.where("size > 0").select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{c}"), F.col("parity").alias(f"parity_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "size_a", "parity_a", "size_b", "parity_b")
    return both.mapInArrow(possible, "a long, b long").distinct()


def verify(docs: DataFrame, pairs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of doc_ids whose whole sets meet the similarity.

    Texts travel to their pairs, not sets: they are smaller and compress. A bit table, of bounded size, lets the
    scan leave out nearly all documents that no pair names; false hits only cost work.
    """
    possible = id_filter(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        for batch in batches:
            yield batch.filter(pa.array(possible(batch.column(0).to_numpy())))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only()
        lead, left = None, np.empty(0, np.uint64)
        for batch in batches:
            kept = []
            for i, (a, x, y) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True)):
                if lead is None or lead != (a, x):
                    lead, left = (a, x), ngram_set(x.as_py().encode(), n)
                right = ngram_set(y.as_py().encode(), n)
                both = len(left) + len(right) - len(np.union1d(left, right))
                if 100 * both >= percent * (len(left) + len(right) - both):
                    kept.append(i)
            yield batch.select([0, 1]).take(pa.array(kept, pa.int64()))

    named = docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(sieve, "id long, text string")
    # merge joins: behind a broadcast one sieve and compare would stand in one task, with a Python worker each
    with_b = pairs.join(named.select(F.col("id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    with_both = with_b.join(named.select(F.col("id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    return with_both.select("a", "b", "text_a", "text_b").mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    docs = texts(docs)
    signed = materialize(signatures(docs, n, percent), "signatures")
    slim = signed.select("doc_id", "size", "set_hash", "group_hash")
    copies = slim.where("size > 0 and doc_id is not null").groupBy("set_hash").agg(F.min("doc_id").alias("rep"), F.first("group_hash").alias("group_hash"))
    copies = materialize(copies, "copies")
    groups = copies.groupBy("group_hash").agg(F.min("rep").alias("gid"))
    members = materialize(copies.join(groups, "group_hash").select("rep", "gid"), "members")

    leads = members.groupBy(F.col("gid").alias("doc_id")).agg(F.max(F.col("rep") != F.col("gid")).alias("many"))
    entries = (
        signed.where("size > 0")
        .join(leads, "doc_id")
        .dropDuplicates(["doc_id", "group_hash"])
        .select(F.col("doc_id").alias("gid"), "size", "many", F.posexplode("prefix").alias("pos", "gram"))
        .select("gram", "gid", (F.shiftleft("size", 32) + F.col("pos") + F.when(F.col("many") & (F.col("pos") == 0), INNER).otherwise(0)).alias("size_pos"))
    )
    pos_of = lambda c: F.col(c).bitwiseAND(INNER - 1)
    same = Window.partitionBy("gram")
    entries = materialize(
        entries.withColumn("lead", F.min(F.struct("gid", "size_pos")).over(same))
        .withColumn("shared", F.count(F.lit(1)).over(same))
        .where((F.col("shared") > 1) | (F.col("size_pos").bitwiseAND(INNER) != 0))
        .select(
            "gram", "gid", F.shiftright("size_pos", 32).alias("size"), pos_of("size_pos").alias("pos"),
            F.col("lead.gid").alias("lead"), F.shiftright("lead.size_pos", 32).alias("lead_size"), pos_of("lead.size_pos").alias("lead_pos"),
        ),
        "entries",
    )
    led = (
        entries.where((F.col("gid") != F.col("lead")) & _fits(F.col("size"), F.col("pos"), F.col("lead_size"), F.col("lead_pos"), percent))
        .groupBy("gid", "lead")
        .agg(F.count(F.lit(1)).alias("c"))
        .groupBy("gid")
        .agg(F.max(F.struct("c", (-F.col("lead")).alias("l"))).alias("best"))
        .select((-F.col("best.l")).alias("a"), F.col("gid").alias("b"))
    )
    first = materialize(led.unionByName(members.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))), "pairs")
    first = materialize(prune(signed, first, percent), "pairs")
    links = materialize(verify(docs, first, n, percent), "links")
    found = connected_components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    # entries between components
    label = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "gid", F.coalesce("component", "rep").alias("comp"))
    wide = entries.select("gram", "gid", "size", "pos").join(label, "gid")
    votes = wide.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("c"))
    open_grams = votes.groupBy("gram").agg(F.count(F.lit(1)).alias("comps"), F.max(F.struct("c", "comp")).alias("m")).where("comps > 1").select("gram", F.col("m.comp").alias("major"))
    wide = materialize(wide.join(open_grams, "gram").select("gram", "rep", "size", "pos", "comp", "major"), "open")
    x, y = wide.where("comp <> major").alias("x"), wide.alias("y")
    rest = (
        x.join(y, F.col("x.gram") == F.col("y.gram"))
        .where((F.col("x.comp") != F.col("y.comp")) & ((F.col("y.comp") == F.col("y.major")) | (F.col("x.rep") < F.col("y.rep"))))
        .where(_fits(F.col("x.size"), F.col("x.pos"), F.col("y.size"), F.col("y.pos"), percent))
        .select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        .distinct()
        .join(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    rest = materialize(prune(signed, materialize(rest, "pairs"), percent), "pairs")
    more = materialize(verify(docs, rest, n, percent), "links")
    if not more.isEmpty():
        edges = found.select(F.col("node").alias("u"), F.col("component").alias("v")).unionByName(more.select(F.col("a").alias("u"), F.col("b").alias("v")))
        found = connected_components(edges)
    return (
        slim.join(copies.select("set_hash", "rep"), "set_hash", "left")
        .join(found, F.col("rep") == F.col("node"), "left")
        .select("doc_id", F.col("size").alias("n_shingles"), F.when(F.col("size") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id")).alias("component_id"))
    )


def keep_first(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component: the one with the smallest doc_id, and of rows that share it the first by content.

    Rows without doc_id stay. Extra columns may have any name.
    """
    kept, row = own_names(docs, "kept", "row")
    found = near_duplicates(docs, n, percent).where("doc_id is not null and doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    plain = [c.name for c in docs.schema if c.name != "doc_id" and not isinstance(c.dataType, (T.MapType, T.VariantType))]
    once = Window.partitionBy("doc_id").orderBy(*[F.col(f"`{c}`") for c in plain])
    first = docs.join(found, F.col("doc_id").cast("long") == F.col(kept), "left_semi").withColumn(row, F.row_number().over(once)).where(F.col(row) == 1).drop(row)
    return first.unionByName(docs.where("doc_id is null"))


def near_duplicates_sql(n: int = N, percent: int = PERCENT) -> str:
    """The same result in SQL by comparing all pairs that share an n-gram; for unique doc_ids."""
    upper, lower = string.ascii_uppercase, string.ascii_lowercase
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
  s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + {n - 1}], ' ') AS gram
    FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - {n - 2}))) AS i FROM d WHERE len(ws) > 0)),
  sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
  links AS (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
  steps AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
  reached AS (SELECT doc_id AS node, doc_id AS seen FROM d UNION SELECT b, seen FROM reached JOIN steps ON a = node)
SELECT doc_id, coalesce(any_value(sizes.n), 0)::BIGINT AS n_shingles, min(seen)::BIGINT AS component_id
FROM d JOIN reached ON doc_id = node LEFT JOIN sizes USING (doc_id) GROUP BY doc_id"""
