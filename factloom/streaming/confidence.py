"""Confidences of facts kept up to date as evidence streams in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.facts import noisy_or
from factloom.tables import Files, KeyedTable

EVIDENCE = ["fact_id", "evidence_id", "ingest_ord", "confidence"]
#: A bucket of the state that lies in more commits than this is written anew as one.
COMMITS = 16


def evidence_of(claims: DataFrame) -> DataFrame:
    """Claims with their fact's id as (fact_id, evidence_id, ingest_ord, confidence)."""
    place = ["source_document", "page_number", "evidence_text", "evidence_type"]
    return claims.select(F.col("id").alias("fact_id"), F.sha2(F.concat_ws("|", "id", *place), 256).alias("evidence_id"), "ingest_ord", "confidence")


def first_claims(evidence: DataFrame) -> DataFrame:
    """Each piece of evidence once, with the confidence of its first claim."""
    return evidence.groupBy("fact_id", "evidence_id").agg(F.min("ingest_ord").alias("ingest_ord"), F.min_by("confidence", "ingest_ord").alias("confidence"))


def confidences(evidence: DataFrame) -> DataFrame:
    """Facts of the evidence, with confidence and number of pieces of evidence."""
    return first_claims(evidence).groupBy("fact_id").agg(noisy_or(F.col("confidence")).alias("confidence"), F.count(F.lit(1)).alias("evidence_count"))


def of_facts(evidence: DataFrame, facts: DataFrame) -> DataFrame:
    """The evidence of ``facts`` (fact_id), dealt out by piece and not by fact, as a fact may have any number of pieces."""
    named = facts.select(F.col("fact_id").alias("_fact")).distinct()
    return evidence.join(named, F.col("fact_id").eqNullSafe(F.col("_fact")), "left_semi").repartition("fact_id", "evidence_id")


def keep_confidences(spark: SparkSession, evidence: DataFrame, table: KeyedTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Upsert the facts that a batch changes into a table keyed by fact_id.

    The state is a keyed table of evidence beside the stream's progress: a batch appends what it brings, and its facts are computed from
    all that the buckets it touches hold of them. Evidence that stands there twice counts once, so a replayed batch upserts the same rows again.
    """
    seen = KeyedTable(spark, f"{checkpoint.rstrip('/')}/evidence", ["fact_id"], table.buckets)
    if seen.latest() is None and Files(spark, checkpoint).names("commits"):
        raise ValueError(f"{checkpoint} has finished batches without their evidence: stream into a new checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        if full := [int(b) for b, commits in seen.manifest()["live"].items() if len(commits) > COMMITS]:
            seen.replace_buckets(first_claims(seen.read(buckets=full)), full)
        before = seen.latest()
        seen.append(batch.select(*EVIDENCE))
        changed = confidences(of_facts(seen.read(buckets=seen.touched(before)), seen.read(since=before)))
        table.replace_keys(changed.withColumn("batch_ord", F.lit(number).cast("long")))

    return evidence.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
