"""Reads of single facts and edges, similar facts, and id lists as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.text import first_match, statement, strip, text
from factloom.operators import facts as facts_ops
from factloom.operators import relations, vectors


SCALAR = r'^(-?\d+(\.\d+)?([eE][+-]?\d+)?|true|false|null|"([^"\\]|\\.)*")$'


def parse_id_list(c: Column) -> Column:
    """Ids of a JSON list; of text that is no JSON, its parts between commas; blanks left out. Null and other JSON: none."""
    body = strip(c)
    json, none = F.try_parse_json(body).isNotNull(), F.array().cast("array<string>")
    items = first_match(
        [
            (json & F.startswith(body, F.lit("[")), F.from_json(body, "array<string>")),
            ((json & F.startswith(body, F.lit("{"))) | body.rlike(SCALAR), none),
        ],
        F.transform(F.split(body, ","), strip),
    )
    return F.filter(F.coalesce(items, none), lambda x: strip(x) != "")


def dump_id_list(ids: Column) -> Column:
    return F.to_json(F.coalesce(ids, F.array().cast("array<string>")))


def relationships_of(edges: DataFrame, facts: DataFrame, fact_id: str) -> DataFrame:
    """Edges at a fact with both statements, its direction in each and the other fact; by type, then confidence."""
    own = edges.where((F.col("source_fact_id") == fact_id) | (F.col("target_fact_id") == fact_id))
    out = F.col("source_fact_id") == fact_id
    view = relations.edge_view(own, facts).withColumn("direction", F.when(out, "outgoing").otherwise("incoming"))
    pick = lambda name: F.when(out, F.col(f"target_{name}")).otherwise(F.col(f"source_{name}"))
    return view.withColumns({"related_fact_id": pick("fact_id"), "related_statement": pick("statement")}).orderBy("relationship_type", F.desc("confidence"), "id")


def relationship(edges: DataFrame, facts: DataFrame, edge_id: str) -> DataFrame:
    """One edge as it is listed; the id is looked up before anything is joined."""
    return relations.edge_view(edges.where(F.col("id") == edge_id), facts)


def without_relationships(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``edges`` without those of ``ids`` (column ``id``), or none at all."""
    return edges.limit(0) if ids is None else edges.join(ids.select(F.col("id").cast("string")), "id", "left_anti")


def fact_embedding(embeddings: DataFrame, fact_id: str) -> DataFrame:
    return embeddings.where(F.col("fact_id") == fact_id)


def similar_facts(facts: DataFrame, embeddings: DataFrame, fact_id: str, k: int = 5) -> DataFrame:
    """The ``k`` facts nearest to one by cosine, with their columns, embedding text, similarity and rank."""
    near = vectors.nearest(embeddings, embeddings.where(F.col("fact_id") == fact_id), "fact_id", k)
    return near.select("id", "similarity", "rank").join(facts, "id").withColumn("embedding_text", vectors.embedding_text()).orderBy("rank")


def debug_rows(facts: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Every fact's statement with its evidence and edges nested, and their counts."""
    ends = edges.select(F.explode(F.array_distinct(F.array("source_fact_id", "target_fact_id"))).alias("id"), F.struct("relationship_type", "source_fact_id", "target_fact_id", "confidence", "reasoning").alias("r"))
    linked = ends.groupBy("id").agg(F.array_sort(F.collect_list("r")).alias("relationship_records"))
    own = facts_ops.evidence_list(evidence).withColumnRenamed("fact_id", "id").withColumnRenamed("evidence", "evidence_records")
    said = statement(F.coalesce(F.nullif(F.col("canonical_attribute"), F.lit("")), "attribute"), F.col("value"), F.col("unit"))
    size = lambda c: F.greatest(F.size(c), F.lit(0)).cast("long")
    return facts.join(own, "id", "left").join(linked, "id", "left").select(
        "id", said.alias("fact"), size("evidence_records").alias("evidence_count"), size("relationship_records").alias("relationship_count"), "evidence_records", "relationship_records"
    )


def brief(facts: DataFrame) -> Column:
    """A fact as JSON for a model's prompt."""
    names = ["id", "entity", "attribute", "raw_attribute", "canonical_attribute", "value", "unit", "period"]
    said = statement(F.coalesce(F.nullif(F.col("canonical_attribute"), F.lit("")), "attribute"), F.col("value"), F.col("unit"))
    return F.to_json(F.struct(*[F.col(c) for c in names if c in facts.columns], said.alias("statement")))


def only_direct_evidence(facts: DataFrame, evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Without evidence of other types; confidences follow."""
    direct = evidence.where(F.coalesce(F.upper(F.col("evidence_type")), F.lit("DIRECT")) == "DIRECT")
    return facts_ops.refresh_confidence(facts, direct), direct


def legacy_claims(rows: DataFrame) -> DataFrame:
    """A table of facts that each carry their one piece of evidence, as raw claims: numbered in the order of id, all direct."""
    known = {c.lower(): c for c in rows.columns}
    take = lambda name, kind: (F.col(known[name]) if name in known else F.lit(None)).cast(kind).alias(name)
    order = F.col(known["id"]) if "id" in known else F.xxhash64(*[text(F.col(c)) for c in rows.columns])
    columns = [take(c, "string") for c in ("entity", "attribute", "value", "unit", "period", "source_document", "evidence_text")]
    return rows.select(order.cast("long").alias("ingest_ord"), *columns, take("confidence", "double"), take("page_number", "int"), F.lit("DIRECT").alias("evidence_type"))
