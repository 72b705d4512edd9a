"""Shared helpers of the training-data operators.

Intermediate tables are written below the folder named by ``spark.checkpoint.dir`` so that a lost
executor never takes the only copy with it.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_SIZE, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
BATCH_LIMIT, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="factloom-")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, else a warehouse on a shared file system; a folder of our own only on a local master that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        return _own_folder()
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if re.match(r"(file:|/)", warehouse):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return warehouse


def fresh_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/factloom/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Write ``df`` once to the shared folder and return it reread: cuts lineage and recomputation."""
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")  # the shuffle files of this write are of no use afterwards
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Whole texts cross to Python in batches of at most ``BATCH_ROWS`` rows and ``BATCH_BYTES`` bytes unless the session asks for
    other numbers: a batch of 10,000 long texts is too much memory for a task."""
    if spark.conf.get(BATCH_SIZE) == "10000":
        spark.conf.set(BATCH_SIZE, str(BATCH_ROWS))
    if spark.conf.get(BATCH_LIMIT) in ("67108864b", "67108864", "64MB"):
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Two columns, ``doc_id`` and ``text`` (null text: empty); whatever else ``docs`` holds is left out."""
    small_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )


def label_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int, max_bytes: int) -> DataFrame:
    """A bounded training sample: at most ``max_rows`` labelled documents of at most ``max_bytes`` bytes each.

    Rows whose ``crc32(doc_id as text) mod modulus`` is ``held_out`` never enter. The sample is the
    ``max_rows`` smallest seeded hashes of doc_id, so it is the same on every run.
    """
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(F.crc32(F.col("doc_id").cast("string")) % modulus != held_out)
        .orderBy(F.xxhash64("doc_id", F.lit(20)), "doc_id")
        .limit(max_rows)
    )
    return texts(docs).where(F.octet_length("text") <= max_bytes).join(F.broadcast(picked), "doc_id")


def own_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while (name := f"_{name}").lower() in taken:
            pass
        taken.add(name.lower())
        out.append(name)
    return out


_KEPT: dict[str, tuple[str, object]] = {}


def kept(kind: str, key: str, make):
    """An object that a worker process keeps from task to task, one of each kind."""
    if _KEPT.get(kind, ("",))[0] != key:
        _KEPT[kind] = (key, make())
    return _KEPT[kind][1]


def keep_only(*kinds: str) -> None:
    """Drop what earlier stages left in this worker; caches of different stages need not fit together."""
    if left := [k for k in _KEPT if k not in kinds]:
        for kind in left:
            del _KEPT[kind]
        release_memory()


def release_memory() -> None:
    """Give what this process has freed back to the machine; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library can
        ctypes.CDLL(None).malloc_trim(0)
