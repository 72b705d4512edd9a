"""Exact deduplication of texts (DataFrame functions only).

Texts are grouped by a 128-bit hash of their bytes. Every group also carries its smallest and largest text: where the
two are the same bytes, the whole group is one text; where they differ, two texts share a hash, and the rows of such
hashes are grouped once more by their very bytes. Of each group the row with the smallest id stays (or the largest).

Groups are reduced before their shuffle, so a text that fills a third of the table is one row a task. Rows then fetch
their group's decision by hash. Hashes that hold over one in ``HEAVY`` rows, at most ``HEAVY`` of them, are dealt to
``SALTS`` places; rows that stand alone are not fetched at all.

Defined cases: a null text counts as empty; a null id is smaller than any other when the largest stays and larger when
the smallest stays, so it is kept only where a group has no other, and ``keep_id`` is null then; of rows that are
equal in id and text one stays; texts of any length are compared whole; an empty table gives an empty result; other
columns are ignored by ``decisions`` and carried, whatever their names and types, by ``drop_exact_copies``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, own_names

HEAVY, SALTS = 1000, 64


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text.cast("binary")))


def _pick(keep: str) -> Callable[[Column], Column]:
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep is {keep!r}, not 'smallest' or 'largest'")
    return F.min if keep == "smallest" else F.max


def hash_groups(rows: DataFrame, keep: str = "smallest") -> DataFrame:
    """One row per hash of ``rows`` (id, text, h): size ``n``, ``keep_id``, ``sha`` of the text, and whether ``mixed``:
    do several texts share the hash?"""
    return (
        rows.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), _pick(keep)("id").alias("keep_id"), F.min("text").alias("_low"), F.max("text").alias("_high"))
        .select("h", "n", "keep_id", F.unhex(F.sha2("_low", 256)).alias("sha"), (F.col("_low") != F.col("_high")).alias("mixed"))
    )


def _members(rows: DataFrame, groups: DataFrame, key: list[str], total: int) -> DataFrame:
    """Every row of ``rows`` (id and ``key``) with its group's decision; heavy groups are dealt to ``SALTS`` places."""
    heavy = groups.where(F.col("n") > max(1, math.ceil(total / HEAVY))).select(*key, F.lit(SALTS).alias("_salts"))  # at most HEAVY rows
    dealt = lambda df: df.join(F.broadcast(heavy), key, "left").withColumn("_salts", F.coalesce("_salts", F.lit(1)))
    left = dealt(rows).select("id", *key, F.pmod(F.xxhash64("id"), F.col("_salts")).cast("int").alias("_salt"))
    right = dealt(groups).select(*dict.fromkeys([*key, "n", "keep_id", "sha"]), F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"))
    at = [*key, "_salt"]
    decided = [F.first(c).alias(c) for c in ("n", "keep_id", "sha") if c not in key]
    found = left.join(right, at).groupBy(*at, "id").agg(F.count(F.lit(1)).alias("_copies"), *decided)
    return found.select("id", "n", "keep_id", "sha", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).select(
        "id", "keep_id", "n", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "sha"
    )


def decisions(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None, hash_of: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """id, keep_id, n (rows of that text), kept and sha (SHA-256 of the text) for every row of ``docs``.

    ``normalise`` is applied to texts before they are compared; ``hash_of`` may be any hash, a weak one costs time only.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), (normalise(text) if normalise else text).alias("text")).withColumn("h", hash_of(F.col("text")))
    groups = materialize(hash_groups(rows, keep), "hash-groups")
    total, mixed = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if("mixed")).first()
    pure = groups.where("not mixed")
    alone = pure.where("n = 1").select(F.col("keep_id").alias("id"), "keep_id", "n", F.lit(True).alias("kept"), "sha")
    found = alone.unionByName(_members(rows.select("id", "h"), pure.where("n > 1"), ["h"], total))
    if mixed:  # several texts with one hash: their rows go by bytes
        shared = rows.join(groups.where("mixed").select("h"), "h", "left_semi").withColumn("sha", F.unhex(F.sha2("text", 256)))
        by_bytes = materialize(shared.groupBy("h", "sha", "text").agg(F.count(F.lit(1)).alias("n"), _pick(keep)("id").alias("keep_id")).drop("text"), "byte-groups")
        found = found.unionByName(_members(shared.select("id", "h", "sha"), by_bytes, ["h", "sha"], total))
    return found


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise: Callable[[Column], Column] | None = None) -> DataFrame:
    """Whole rows of ``docs``, one of each text: hash and bytes are the group's key, and its record with the smallest (or
    largest) id is found before the shuffle. Among rows of one id any one stays."""
    _pick(keep)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    h, t, order, record = own_names(docs, "h", "t", "order", "record")
    best = F.min_by if keep == "smallest" else F.max_by
    first = F.struct(F.col(f"`{id_col}`").isNull(), F.col(f"`{id_col}`")) if keep == "smallest" else F.struct(F.col(f"`{id_col}`").isNotNull(), F.col(f"`{id_col}`"))
    whole = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)])
    keyed = docs.select((normalise(text) if normalise else text).alias(t), first.alias(order), whole.alias(record)).withColumn(h, content_hash(F.col(t)))
    kept = keyed.groupBy(h, t).agg(best(record, order).alias(record))
    return kept.select(*[F.col(f"{record}.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """The contract's digest: of equal texts the row with the largest doc_id stays."""
    found = decisions(docs, keep="largest")
    return found.select(
        F.col("id").cast("long").alias("doc_id"), F.col("keep_id").cast("long").alias("keep_id"), F.col("n").alias("group_size"), "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


EXACT_SQL = """SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""

