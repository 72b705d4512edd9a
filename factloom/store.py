"""A fact layer in one folder: raw claims as they came, and the tables derived from them."""

from __future__ import annotations

import re
import tempfile
import time
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import normalize_token
from factloom.operators import facts as facts_ops
from factloom.operators import lookup, relations, vectors
from factloom.tables import BUCKET, BUCKETS, Files, KeyedTable

RAW_SCHEMA = T.StructType(
    [T.StructField("ingest_ord", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("entity", "attribute", "value", "unit", "period")], T.StructField("confidence", T.DoubleType()),
     T.StructField("source_document", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("evidence_text", T.StringType()), T.StructField("evidence_type", T.StringType())]
)
#: What rows of a table are found by. The first five lie in the bucket of their claims' attribute and value, so a claim touches one bucket of each.
KEYS = {
    "claims": ["eq_attribute", "eq_value"], "facts": ["eq_attribute", "eq_value"], "evidence": ["fact_id"], "features": ["eq_attribute", "eq_value"], "clusters": ["canonical_attribute", "eq_value"],
    "embeddings": ["fact_id", "model"], "edges": ["id"], "candidates": ["source_fact_id", "target_fact_id"],
}
DERIVED = list(KEYS)
BY_CLAIM = DERIVED[:5]
#: The table that each follows from; facts come with their evidence.
FOLLOWS = {"claims": None, "facts": "claims", "evidence": "facts", "features": "evidence", "clusters": "evidence", "edges": "features", "candidates": "features", "embeddings": "facts"}


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns in its order; missing ones are typed nulls."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def work_folder(spark: SparkSession) -> str:
    """A folder that all executors share: the checkpoint folder, else a warehouse on a shared file system; on a local master any."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and re.match(r"local(\[|$)", spark.sparkContext.master):  # local-cluster's executors may share no folder
        named = "file://" + tempfile.gettempdir()
    named = named or spark.conf.get("spark.sql.warehouse.dir")
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.master.startswith("local") and re.match(r"(file:|/)", named):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{named.rstrip('/')}/factloom-store"


class Timings:
    """Wall clock of named stages."""

    def __init__(self):
        self.stages: dict[str, float] = {}

    @contextmanager
    def stage(self, name: str):
        began = time.perf_counter()
        yield
        self.stages[name] = self.stages.get(name, 0.0) + time.perf_counter() - began

    def render(self) -> str:
        return "\n".join(f"{name:<14}{seconds:>10.3f} s" for name, seconds in self.stages.items())


class FactStore:
    """Raw claims in buckets by document, derived tables in buckets by key, and a manifest of table versions for each store version.

    ``rebuild`` derives everything; ``add`` canonicalises only what is new, merges it inside the buckets it touches and links
    only what changed. Readers see a store version as a whole: its manifest is written last. Versions stay until the
    folder is cleared; a snapshot is a name for one and costs no data.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets, self.timings, self.on_demand = spark, path.rstrip("/"), buckets, Timings(), False
        self.files = Files(spark, self.path)
        self.raw_table = KeyedTable(spark, f"{self.path}/raw", ["source_document"], buckets)
        self.tables = {name: KeyedTable(spark, f"{self.path}/{name}", key, buckets) for name, key in KEYS.items()}
        self.version: int | None = max(self.versions(), default=None)

    # ------------------------------------------------------------ versions

    def versions(self) -> list[int]:
        return [int(n.split(".")[0]) for n in self.files.names("versions")]

    def manifest(self, version: int | None = None) -> dict:
        version = self.version if version is None else version
        return self.files.read(f"versions/{version:020d}.json") if version is not None else {"tables": {}, "batches": {}}

    def _publish(self, tables: dict[str, int], batches: dict[str, int] | None = None) -> FactStore:
        before = self.manifest()
        version = max(self.versions(), default=0) + 1
        self.files.write(f"versions/{version:020d}.json", {"tables": before["tables"] | tables, "batches": before["batches"] | (batches or {})})
        self.version = version
        return self

    def snapshot(self, name: str) -> str:
        """Name the current version; nothing is copied."""
        self.manifest_must_exist()
        self.files.write(f"snapshots/{name}.json", {"version": self.version})
        return name

    def at(self, snapshot: str) -> FactStore:
        """The store as it was when it was named."""
        other = FactStore(self.spark, self.path, self.buckets)
        other.version = self.files.read(f"snapshots/{snapshot}.json")["version"]
        return other

    def manifest_must_exist(self) -> None:
        if self.version is None or not self.manifest()["tables"].get("facts"):
            raise ValueError("nothing is built yet: call rebuild()")

    # ------------------------------------------------------------ raw claims

    def raw(self) -> DataFrame:
        version = self.manifest()["tables"].get("raw")
        return conform(self.raw_table.read(version), RAW_SCHEMA) if version else self.spark.createDataFrame([], RAW_SCHEMA)

    def append(self, raw: DataFrame) -> None:
        """Keep raw claims; derived tables follow with ``rebuild`` or ``add``."""
        self._publish({"raw": self.raw_table.append(conform(raw, RAW_SCHEMA))})

    def replace_document(self, raw: DataFrame, document: str) -> None:
        """A document that comes again replaces its earlier claims, also where none are left."""
        gone = self.spark.createDataFrame([(document,)], "source_document string")
        self._publish({"raw": self.raw_table.replace_keys(conform(raw, RAW_SCHEMA), gone)})

    def append_batch(self, raw: DataFrame, stream: str, batch: int, replace_documents: bool = False) -> bool:
        """Keep a micro-batch once: a batch that the manifest of the store names already is left out. With ``replace_documents`` the documents
        of the batch lose their earlier claims. Claims and batch number become visible together."""
        if self.manifest()["batches"].get(stream, -1) >= batch:
            return False
        rows = conform(raw, RAW_SCHEMA)
        self._publish({"raw": self.raw_table.replace_keys(rows) if replace_documents else self.raw_table.append(rows)}, {stream: batch})
        return True

    # ------------------------------------------------------------ derived tables

    def _timed(self, name: str, write) -> int:
        with self.timings.stage(name):
            return write()

    def _scratch(self, name: str, df: DataFrame) -> DataFrame:
        """Write something that later steps read several times."""
        path = f"{self.path}/scratch/{name}-{uuid.uuid4().hex}"
        self._timed(name, lambda: df.write.parquet(path))
        return self.spark.read.schema(df.schema).parquet(path)

    def _derive(self, claims: DataFrame | None, touched: list[int] | None, versions: dict[str, int], names: list[str] = BY_CLAIM) -> None:
        """Claims of ``touched`` buckets (all), where they are not written yet, and those of ``names`` that follow from them: facts and evidence,
        features, clusters."""
        t = self.tables
        put = lambda name, rows: versions.update({name: self._timed(name, lambda: t[name].replace_buckets(rows, touched))})
        got = lambda name: t[name].read(versions[name], touched, with_bucket=True)
        if claims is not None:
            put("claims", t["claims"].bucketed(claims))
        if "facts" in names:
            facts, evidence = facts_ops.merge_claims(got("claims"), carry=[BUCKET])
            put("facts", facts)
            put("evidence", evidence)
        if "features" in names:
            put("features", relations.features(got("facts"), got("evidence")))
        if "clusters" in names:
            clusters = facts_ops.clusters(got("facts"), got("evidence"))
            put("clusters", clusters.withColumn(BUCKET, t["clusters"].bucket_of(normalize_token(F.col("canonical_attribute")), F.col("eq_value"))))

    def rebuild(self, link: bool = True) -> FactStore:
        """Canonicalise, merge, link, cluster and embed all raw claims. Each table is written once and read from there."""
        versions: dict[str, int] = {}
        stored = self.table("embeddings") if self.has("embeddings") else None
        self._derive(facts_ops.claims(self.raw()), None, versions)
        if link:
            self._relink(versions)
        self._embed(versions, stored)
        return self._publish(versions)

    def complete(self, *names: str) -> FactStore:
        """Those of the named tables (all) that this version lacks, and what they follow from; together they are what ``rebuild`` makes."""
        lacking, todo = set(), list(names or DERIVED)
        while todo:
            name = todo.pop()
            if not self.has(name):
                lacking.add(name)
                todo += [FOLLOWS[name]] if FOLLOWS[name] else []
        if not lacking:
            return self
        versions = dict(self.manifest()["tables"])
        self._derive(facts_ops.claims(self.raw()) if "claims" in lacking else None, None, versions, [n for n in BY_CLAIM if n in lacking])
        if lacking & {"edges", "candidates"}:
            self._relink(versions, lacking)
        if "embeddings" in lacking:
            self._embed(versions)
        return self._publish(versions)

    def _embed(self, versions: dict[str, int], stored: DataFrame | None = None) -> None:
        embedded = vectors.embed_facts(self.tables["facts"].read(versions["facts"]), stored)
        versions["embeddings"] = self._timed("embeddings", lambda: self.tables["embeddings"].replace_buckets(embedded))

    def _relink(self, versions: dict[str, int], names=("edges", "candidates")) -> None:
        features = self.tables["features"].read(versions["features"])
        near = self._scratch("near_pairs", relations.near_ids(features))
        if "edges" in names:
            edges = relations.valid(self._scratch("proposed", relations.proposed(features, near=near)), features)
            versions["edges"] = self._timed("edges", lambda: self.tables["edges"].replace_buckets(edges))
        if "candidates" in names:
            versions["candidates"] = self._timed("candidates", lambda: self.tables["candidates"].replace_buckets(relations.candidate_log(features, near=near)))

    def relink(self) -> FactStore:
        """All relationships anew, from the facts as they are."""
        self.manifest_must_exist()
        versions = dict(self.manifest()["tables"])
        self._relink(versions)
        return self._publish(versions)

    def add(self, raw: DataFrame, replace_documents: bool = False) -> FactStore:
        """Append claims, or replace those of the documents they come from, and bring all derived tables up to date.

        Only the new claims are canonicalised. Claims, facts, evidence, features and clusters are read and written in the
        touched buckets; vectors of changed facts are upserted; edges and candidates are made anew for changed facts and for
        facts whose disagreement a changed transition explains. The result equals a rebuild.
        """
        self.manifest_must_exist()
        if self.on_demand:
            self.complete()
        t, old = self.tables, self.manifest()["tables"]
        rows = conform(raw, RAW_SCHEMA)
        versions = {"raw": self._timed("raw", lambda: self.raw_table.replace_keys(rows) if replace_documents else self.raw_table.append(rows))}
        delta = self._scratch("delta", t["claims"].bucketed(facts_ops.canonical(rows)))
        touched = {r[0] for r in delta.select(BUCKET).distinct().collect()}  # at most one row a bucket
        documents = rows.select("source_document").distinct()
        if replace_documents:
            touched |= {r[0] for r in t["claims"].read(old["claims"], with_bucket=True).join(documents, "source_document", "left_semi").select(BUCKET).distinct().collect()}
        buckets = sorted(touched)
        before = t["claims"].read(old["claims"], buckets, with_bucket=True)
        if replace_documents:
            before = before.join(documents, "source_document", "left_anti")
        self._derive(facts_ops.identified(before.select(*delta.columns).unionByName(delta)), buckets, versions)

        own = lambda name, version: t[name].read(version, buckets)
        had, has = (own("evidence", v).select("fact_id", "evidence_id", "confidence", "evidence_type") for v in (old["evidence"], versions["evidence"]))
        differing = has.exceptAll(had).select("fact_id").unionByName(had.exceptAll(has).select("fact_id"))
        told = lambda v: own("facts", v).select("id", "period", "value", "canonical_value", "raw_attribute", "entity", "ingest_ord")
        differing = differing.unionByName(told(versions["facts"]).exceptAll(told(old["facts"])).select(F.col("id").alias("fact_id")))
        changed = self._scratch("changed", differing.distinct())

        facts = own("facts", versions["facts"])
        stored = t["embeddings"].read(old["embeddings"])
        gone = own("facts", old["facts"]).select("id").join(facts.select("id"), "id", "left_anti").select(F.col("id").alias("fact_id"))
        gone = stored.join(gone, "fact_id", "left_semi").select("fact_id", "model")
        fresh = vectors.changed_embeddings(facts, stored)
        versions["embeddings"] = self._timed("embeddings", lambda: t["embeddings"].replace_keys(fresh, gone))

        if old.get("edges"):
            features, edges = t["features"].read(versions["features"]), t["edges"].read(old["edges"])
            moved = own("features", old["features"]).unionByName(own("features", versions["features"])).join(changed.withColumnRenamed("fact_id", "id"), "id", "left_semi")
            moved = self._scratch("moved", moved)
            again = relations.explained_by(edges, features, moved).unionByName(relations.summed_with(features, moved, changed, write=self._scratch)).unionByName(changed)
            again = self._scratch("again", again.distinct())
            near = self._scratch("near", relations.touched_by(features, again))
            pairs = self._scratch("near_pairs", relations.near_ids(near))
            made = relations.at_facts(relations.valid(self._scratch("proposed", relations.proposed(near, support=features, near=pairs)), features), again)
            versions["edges"] = self._timed("edges", lambda: t["edges"].replace_keys(made, relations.at_facts(edges, again).select("id")))
            log = relations.at_facts(relations.candidate_log(near, near=pairs), again)
            stale = relations.at_facts(t["candidates"].read(old["candidates"]), again).select("source_fact_id", "target_fact_id")
            versions["candidates"] = self._timed("candidates", lambda: t["candidates"].replace_keys(log, stale))
        return self._publish(versions)

    def embed(self, model: str = vectors.MODEL, embed=vectors.hash_embed, fact_ids: DataFrame | None = None) -> FactStore:
        """Vectors of ``model`` for all facts, or those of ``fact_ids`` (fact_id), beside the vectors of other models; facts whose text has not
        changed since are left out."""
        facts = self.table("facts")
        if fact_ids is not None:
            facts = facts.join(fact_ids.select(F.col("fact_id").alias("id")), "id", "left_semi")
        fresh = vectors.changed_embeddings(facts, self.table("embeddings"), model, embed)
        return self._publish({"embeddings": self._timed("embeddings", lambda: self.tables["embeddings"].replace_keys(fresh))})

    # ------------------------------------------------------------ reads

    def table(self, name: str) -> DataFrame:
        """A derived table; a store ``on_demand`` builds it where no query has asked for it yet."""
        if self.on_demand:
            self.complete(name)
        else:
            self.manifest_must_exist()
        return self.tables[name].read(self.manifest()["tables"][name])

    def has(self, name: str) -> bool:
        return self.version is not None and name in self.manifest()["tables"]

    def search(self, query: str = "", document: str | None = None) -> DataFrame:
        return facts_ops.search(self.table("facts"), self.table("evidence"), self.table("edges"), query, document)

    def fact(self, fact_id: str) -> DataFrame:
        return facts_ops.fact_detail(self.table("facts"), self.table("evidence"), self.table("edges"), fact_id)

    def similar(self, fact_id: str, k: int = 5, model: str = vectors.MODEL) -> DataFrame:
        return lookup.similar_facts(self.table("facts"), self.table("embeddings").where(F.col("model") == model), fact_id, k)

    def relationships(self, fact_id: str) -> DataFrame:
        return lookup.relationships_of(self.table("edges"), self.table("facts"), fact_id)

    def delete_relationships(self, ids: DataFrame | None = None) -> int:
        """Delete edges by id, or all of them, in a new version; gives how many went."""
        edges = self.table("edges")
        if ids is None:
            gone, version = edges.count(), self.tables["edges"].replace_buckets(edges.limit(0))
        else:
            named = ids.select(F.col("id").cast("string").alias("id"))
            gone = edges.join(named, "id", "left_semi").count()
            version = self.tables["edges"].replace_keys(edges.limit(0), named)
        self._publish({"edges": version})
        return gone

    def clear(self) -> None:
        self.files.delete()
        self.version = None
