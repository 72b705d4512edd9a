"""Parquet tables whose rows are dealt to buckets by a key, with one small manifest for each version.

A manifest names, for every bucket, the commits that hold its rows. A change writes the buckets it touches anew and a manifest
that names them; all other folders stay as they are and are named again. So a reader of an older version is never
disturbed, an upsert reads and writes only the buckets of its keys, and a tag on a version costs no data. Two writers of
one version collide on the manifest's name, and the later one fails.

Rows of a bucket are written by as many tasks as their size asks for (``rebalance``), so a hot key is no single task's work. A
change of columns shows in the manifest's schema: rows of older commits read as null in columns they did not have.
"""

from __future__ import annotations

import json
import uuid
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET, COMMIT = "_bucket", "_commit"
BUCKETS = 16


class Files:
    """What a folder of manifests needs from a Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @cached_property
    def _at(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path

    @cached_property
    def fs(self):
        return self._at(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self._at(f"{self.path}/{folder}")
        return sorted(x.getPath().getName() for x in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def write(self, name: str, content: dict) -> None:
        """A new file; one of that name must not exist."""
        out = self.fs.create(self._at(f"{self.path}/{name}"), False)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()

    def read(self, name: str) -> dict:
        source = self.fs.open(self._at(f"{self.path}/{name}"))
        try:
            return json.loads(bytes(source.readAllBytes()))
        finally:
            source.close()

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self._at(f"{self.path}/{folder}")).getLength()

    def exists(self, name: str) -> bool:
        return self.fs.exists(self._at(f"{self.path}/{name}"))

    def delete(self) -> None:
        self.fs.delete(self._at(self.path), True)


class KeyedTable:
    """``key``: the columns that decide a row's bucket; rows that carry a ``_bucket`` of their own keep it."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.files = Files(spark, self.path)

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.files.names("manifests")]

    def latest(self) -> int | None:
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        version = self.latest() if version is None else version
        return self.files.read(f"manifests/{version:020d}.json") if version is not None else {"version": 0, "schema": None, "live": {}}

    def _commit(self, before: dict, schema: T.StructType, live: dict[str, list[str]]) -> int:
        fields = {f.name: f for f in (T.StructType.fromJson(json.loads(before["schema"])).fields if before["schema"] else [])}
        fields |= {f.name: T.StructField(f.name, f.dataType) for f in schema.fields if f.name != BUCKET}
        version = before["version"] + 1
        whole = T.StructType(list(fields.values()))
        self.files.write(f"manifests/{version:020d}.json", {"version": version, "schema": whole.json(), "live": {b: c for b, c in live.items() if c}})
        return version

    # ------------------------------------------------------------ reading

    def folders(self, version: int | None = None, buckets: list[int] | None = None, since: int | None = None) -> list[str]:
        live, known = self.manifest(version)["live"], self.manifest(since)["live"] if since is not None else {}
        return [f"data/{COMMIT}={c}/{BUCKET}={b}" for b, commits in live.items() if buckets is None or int(b) in buckets for c in commits if c not in known.get(b, [])]

    def touched(self, since: int | None) -> list[int]:
        """Buckets that were written after version ``since`` (all)."""
        return sorted({int(f.rsplit("=", 1)[1]) for f in self.folders(since=since)})

    def size(self, version: int | None = None, buckets: list[int] | None = None) -> int:
        """Bytes that a read of these buckets may take at most."""
        return sum(self.files.size(f) for f in self.folders(version, buckets))

    def read(self, version: int | None = None, buckets: list[int] | None = None, with_bucket: bool = False, since: int | None = None) -> DataFrame:
        """The rows of a version (the latest), of some buckets or all; with ``since`` those of commits that this earlier version doesn't name."""
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError(f"{self.path} holds nothing yet")
        schema = T.StructType.fromJson(json.loads(m["schema"]))
        whole = T.StructType([*schema.fields, T.StructField(COMMIT, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        paths = [f"{self.path}/{f}" for f in self.folders(version, buckets, since)]
        rows = self.spark.read.schema(whole).option("basePath", f"{self.path}/data").parquet(*paths) if paths else self.spark.createDataFrame([], whole)
        return rows.drop(*([COMMIT] if with_bucket else [COMMIT, BUCKET]))

    def bucket_of(self, *key: Column) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def bucketed(self, rows: DataFrame) -> DataFrame:
        return rows if BUCKET in rows.columns else rows.withColumn(BUCKET, self.bucket_of(*[F.col(f"`{c}`") for c in self.key]))

    # ------------------------------------------------------------ writing

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Write rows as one commit; its name and the buckets in it."""
        name = uuid.uuid4().hex
        self.bucketed(rows).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{COMMIT}={name}")
        return name, [n.split("=")[1] for n in self.files.names(f"data/{COMMIT}={name}") if n.startswith(f"{BUCKET}=")]

    def append(self, rows: DataFrame) -> int:
        """Add rows; nothing written before is read."""
        before = self.manifest()
        name, found = self._write(rows)
        return self._commit(before, rows.schema, before["live"] | {b: [*before["live"].get(b, []), name] for b in found})

    def replace_buckets(self, rows: DataFrame, buckets: list[int] | None = None) -> int:
        """``rows`` become the whole content of ``buckets`` (all)."""
        before = self.manifest()
        name, found = self._write(rows)
        live = {b: c for b, c in before["live"].items() if buckets is not None and int(b) not in buckets}
        if stray := [b for b in found if buckets is not None and int(b) not in buckets]:
            raise ValueError(f"rows for other buckets than said: {stray}")
        return self._commit(before, rows.schema, live | {b: [name] for b in found})

    def replace_keys(self, rows: DataFrame, removed: DataFrame | None = None) -> int:
        """All rows of the keys in ``rows`` are replaced by those given, rows of the keys in ``removed`` go; nulls are keys like others."""
        before = self.manifest()
        name, found = self._write(rows)
        key = [F.col(f"`{c}`") for c in self.key]
        written = self.spark.read.schema(T.StructType([rows.schema[c] for c in self.key])).parquet(f"{self.path}/data/{COMMIT}={name}/{BUCKET}=*") if found else None
        touched = {int(b) for b in found}
        keys = [k.select(*key) for k in (written, removed) if k is not None]
        if removed is not None:
            touched |= {r[0] for r in removed.select(self.bucket_of(*key)).distinct().collect()}  # at most one row a bucket
        touched = sorted(b for b in touched if str(b) in before["live"])
        live = dict(before["live"])
        if touched:
            gone = keys[0].unionByName(keys[1]) if len(keys) > 1 else keys[0]
            gone = gone.distinct().select(*[k.alias(f"_gone{i}") for i, k in enumerate(key)])
            same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_gone{i}")) for i, c in enumerate(self.key)]
            kept, left = self._write(self.read(before["version"], touched, with_bucket=True).join(gone, same, "left_anti"))
            live |= {str(b): [kept] if str(b) in left else [] for b in touched}
        return self._commit(before, rows.schema, live | {b: [*live.get(b, []), name] for b in found})

    def upsert(self, rows: DataFrame, order: Column | None = None) -> int:
        """One row a key: the one of ``rows`` that is last by ``order``, in place of any row stored."""
        whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
        last = rows.groupBy(*[F.col(f"`{c}`").alias(f"_k{i}") for i, c in enumerate(self.key)]).agg(F.max_by(whole, order if order is not None else F.lit(0)).alias("_row"))
        return self.replace_keys(last.select("_row.*"))
