"""Two-pass external shuffle into shards (DataFrame functions only).

Pass 1 scatters records uniformly into memory-sized buckets by a seeded hash of their id and content. Pass 2
orders each bucket canonically, Fisher-Yates shuffles it (Spark's built-in ``shuffle``) and deals the
concatenation of all buckets round robin to the shards, so shard sizes differ by one record at most.

Defined cases: null ids form a key like any other; repeated rows each get a slot of their own; an empty
table gives an empty result; columns of any name may ride along (``columns``); the ones added are
``shard`` and ``slot``, and columns that already have these names ride along with an underscore before them. Columns that Spark can't hash or
order (maps, variants, whatever holds them) ride along and don't decide a record's place. Records are never dropped. Bucket contents follow from the data, the seed and the
bucket count, and each bucket is sorted before it is shuffled, so a re-run task makes the same output.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SHUFFLE_CLEANUP, fresh_path

BUCKET_BYTES = 32 << 20


def record_bytes(df: DataFrame, columns: list[str]) -> Column:
    """About the size of a record: its strings and binaries, and a word for every column."""
    long = [c for c in columns if isinstance(df.schema[c].dataType, (T.StringType, T.BinaryType))]
    return sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in long), F.lit(16 * len(columns)).cast("long"))


def decides(kind: T.DataType) -> bool:
    """Can values of this type be hashed and ordered?"""
    if isinstance(kind, T.ArrayType):
        return decides(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(decides(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType, T.UserDefinedType))


def carried(columns: list[str]) -> list[str]:
    """Names under which ``columns`` ride along."""
    taken, out = {c.lower() for c in columns} | {"shard", "slot"}, []
    for name in columns:
        if name.lower() in ("shard", "slot"):
            while (name := f"_{name}").lower() in taken:
                pass
            taken.add(name.lower())
        out.append(name)
    return out


def two_pass_shuffle(
    df: DataFrame, id_col: str, shards: int, seed: int = 17, bucket_rows: int = 20_000, columns: list[str] | None = None
) -> DataFrame:
    """``columns`` of ``df`` plus ``shard`` int and ``slot`` long (gapless from 0 within a shard).

    A bucket, what one task holds in memory at once, has about ``bucket_rows`` rows and ``BUCKET_BYTES`` bytes at most.
    """
    columns = columns or df.columns
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(record_bytes(df, columns)), F.lit(0))).first()
    buckets = max(1, math.ceil(n / bucket_rows), math.ceil(size / BUCKET_BYTES))
    fixed = [F.col(f"`{c}`") for c in columns if decides(df.schema[c].dataType)]
    own = F.xxhash64(F.lit(seed + 1), F.col(f"`{id_col}`"))
    record = F.struct(own.alias("_k"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    scattered = df.select(
        F.pmod(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), *fixed), F.lit(buckets)).alias("_bucket"), record.alias("_record"), F.struct(own.alias("k"), F.xxhash64(*fixed).alias("h")).alias("_place")
    )
    if len(fixed) == len(columns):
        gathered, shuffled = [F.sort_array(F.collect_list("_record")).alias("_records")], F.shuffle("_records", seed)
    else:  # some columns have no order: records follow the order of their places
        gathered = [F.collect_list("_record").alias("_records"), F.sort_array(F.transform(F.collect_list("_place"), lambda p, i: F.struct(p.alias("p"), i.alias("i")))).alias("_places")]
        shuffled = F.transform(F.shuffle("_places", seed), lambda p: F.get("_records", p["i"]))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (  # one row per bucket
        scattered.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(F.col("_bucket").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    )
    dealt = (
        scattered.repartition(buckets, "_bucket")
        .groupBy("_bucket")
        .agg(*gathered)
        .sortWithinPartitions("_bucket")
        .select("_bucket", shuffled.alias("_records"))
        .select("_bucket", F.posexplode("_records").alias("_pos", "_r"))
    )
    rank = F.col("_offset") + F.col("_pos")
    return dealt.join(F.broadcast(offsets), F.col("_bucket") == F.col("_of")).select(
        *[F.col(f"_r._c{i}").alias(c) for i, c in enumerate(carried(columns))],
        (rank % shards).cast("int").alias("shard"),
        F.floor(rank / shards).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, id_col: str, path: str, shards: int, seed: int = 17, bucket_rows: int = 20_000) -> None:
    """Write whole records, one folder per shard, in slot order within each file. Pass 2 writes its buckets straight to the shards."""
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLE_CLEANUP, "false")
    conf.set(SHUFFLE_CLEANUP, "true")  # the scattered records are of no use afterwards
    try:
        out = two_pass_shuffle(df, id_col, shards, seed, bucket_rows)
        out.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
    finally:
        conf.set(SHUFFLE_CLEANUP, before)


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """The digest of the written shards: law ``rows``, counts at most one apart. Whole records go through both
    passes; size, checksum, shard and slot are taken from the shards read back."""
    spark = docs.sparkSession
    path = fresh_path(spark, "shards")
    write_shards(docs, "doc_id", path, shards)
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(carried(docs.columns), docs.schema, strict=True)), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path).select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
