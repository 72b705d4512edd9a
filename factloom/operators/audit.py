"""Audits of a fact layer: corpus metrics, integrity, structure, fingerprint."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.canonical import CHILD_REVENUE, LEVEL_ATTRIBUTES, NO_HEADCOUNT, canonicalize, dimensions_compatible, value_dimension
from factloom.functions.text import spread, squash, text, word_in
from factloom.operators.relations import type_counts

# Fixed values.
NO_HEADCOUNT_UNITS = ["million", "billion", "crore", "lakh", "%", "inr", "usd", "eur", "gbp", "shares", "equity shares", "options"]
TWO_CURRENCIES = r"(?U)\b(INR|USD|EUR|GBP)\b.*(\b(INR|USD|EUR|GBP)\b|[₹$€£])"
RATIO = r"(?iU)%|\b(percent|pct)\b"


def _dims(facts: DataFrame) -> DataFrame:
    return facts.select("id", "canonical_attribute", "canonical_value", "unit", value_dimension(F.col("canonical_value"), F.col("unit")).alias("dim"))


def audit(facts: DataFrame, evidence: DataFrame, edges: DataFrame, clusters: DataFrame, embeddings: DataFrame) -> DataFrame:
    """(metric, value): one conditional aggregate per table, anti-joins for what is missing. Edges of each type and attributes of mixed
    dimensions follow as metrics of their own (``relationships_by_type.X``, ``mixed_dimension_attribute.X``)."""
    d = facts.withColumn("dim", value_dimension(F.col("canonical_value"), F.col("unit")))
    head, level = F.col("canonical_attribute") == "employee_count", F.col("canonical_attribute").isin(LEVEL_ATTRIBUTES)
    bad_head = word_in(text(F.col("raw_attribute")), NO_HEADCOUNT) | F.lower(F.trim(text(F.col("unit")))).isin(NO_HEADCOUNT_UNITS) | text(F.col("canonical_value")).rlike(RATIO)
    of_facts = d.agg(
        F.count(F.lit(1)).alias("facts"),
        F.count_if(head).alias("employee_count_facts"),
        F.count_if(head & bad_head).alias("employee_count_invalid"),
        F.count_if(level).alias("revenue_facts"),
        F.count_if(level & (F.col("dim") == "ratio")).alias("revenue_facts_with_ratio_value"),
        F.count_if(text(F.col("canonical_value")).rlike(TWO_CURRENCIES)).alias("currency_anomalies"),
        F.countDistinct("canonical_attribute").alias("distinct_canonical_attributes"),
    )
    s, t = (_dims(facts).select(F.col("id").alias(f"{x}_id"), F.col("dim").alias(f"{x}_dim")) for x in "st")
    compared = F.col("relationship_type").isin("CONTRADICTS", "CORROBORATES")
    of_edges = (
        edges.join(s, F.col("source_fact_id") == F.col("s_id")).join(t, F.col("target_fact_id") == F.col("t_id"))
        .agg(
            F.count(F.lit(1)).alias("relationships"),
            F.count_if(F.col("relationship_type") == "CONTRADICTS").alias("contradictions"),
            F.count_if(compared & ~dimensions_compatible(F.col("s_dim"), F.col("t_dim"))).alias("dimensional_mismatch_relationships"),
            F.count_if(compared & (F.col("s_dim") != F.col("t_dim"))).alias("dim_strictly_different_relationships"),
        )
    )
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    frames = [
        of_facts, of_edges, count(evidence, "evidence"), count(clusters, "clusters"), count(embeddings, "embeddings"), count(mixed_dimensions(facts), "mixed_dimension_attributes"),
        count(missing(facts, evidence), "facts_missing_evidence"), count(missing(facts, embeddings), "facts_missing_embedding"),
    ]
    rows = [f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in f.columns])).alias("m")).select("m.*") for f in frames]
    named = [
        type_counts(edges).select(F.concat(F.lit("relationships_by_type."), "relationship_type").alias("metric"), F.col("n").alias("value")),
        mixed_dimensions(facts).select(F.concat(F.lit("mixed_dimension_attribute."), "canonical_attribute").alias("metric"), F.lit(1).cast("long").alias("value")),
    ]
    return reduce(DataFrame.unionByName, [*rows, *named])


def missing(facts: DataFrame, other: DataFrame) -> DataFrame:
    """Facts that no row of ``other`` belongs to."""
    return facts.join(other.select(F.col("fact_id").alias("id")), "id", "left_anti")


def mixed_dimensions(facts: DataFrame) -> DataFrame:
    """Attributes that hold ratios and amounts."""
    g = _dims(facts).groupBy("canonical_attribute").agg(F.array_sort(F.collect_set("dim")).alias("dims"))
    return g.where("array_contains(dims, 'ratio') and (array_contains(dims, 'money') or array_contains(dims, 'scaled'))")


def integrity(facts: DataFrame) -> DataFrame:
    """Stored value and attribute against what the originals give now, and children that repeat a total's value."""
    originals = facts.select("id", F.col("canonical_attribute").alias("stored_attribute"), F.col("value").alias("stored_value"), *[F.col(f"original_{c}") for c in ("entity", "attribute", "value", "period")])
    again = canonicalize(spread(originals).withColumns({"entity": F.col("original_entity"), "attribute": F.col("original_attribute"), "value": F.col("original_value"), "period": F.col("original_period"), "unit": F.lit(None).cast("string")}))
    norm = lambda c: F.lower(squash(F.col(c)))
    totals = facts.where("canonical_attribute = 'total_revenue'").select(F.lower(squash(F.col("value"))).alias("_total")).distinct()
    checked = again.join(totals, norm("stored_value") == F.col("_total"), "left")
    reasons = F.array_compact(
        F.array(
            F.when(norm("stored_value") != norm("value"), "Value changed after extraction."),
            F.when(F.col("stored_attribute") != F.col("canonical_attribute"), F.concat(F.lit("Attribute changed unexpectedly ('"), "original_attribute", F.lit("' -> '"), "stored_attribute", F.lit("')."))),
            F.when(F.col("stored_attribute").isin(CHILD_REVENUE) & F.col("_total").isNotNull(), "Synthetic child fact: child value matches a total_revenue value."),
        )
    )
    return checked.select("id", F.col("stored_attribute").alias("canonical_attribute"), F.when(F.size(reasons) == 0, "PASS").otherwise("FAIL").alias("integrity_status"), F.when(F.size(reasons) == 0, "Stored fact matches original extraction.").otherwise(F.array_join(reasons, " ")).alias("reason"))


def self_links(edges: DataFrame) -> DataFrame:
    return edges.where("source_fact_id = target_fact_id")


def duplicate_edges(edges: DataFrame) -> DataFrame:
    return edges.groupBy("relationship_type", "pair_low", "pair_high").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")).where("n > 1")


def provenance_counts(facts: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """Facts whose stored evidence count is not what the evidence table says, and their number of edges."""
    n = evidence.groupBy(F.col("fact_id").alias("id")).agg(F.count(F.lit(1)).alias("evidence_found"))
    e = edges.select(F.explode(F.array_distinct(F.array("source_fact_id", "target_fact_id"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("edges_found"))
    return facts.join(n, "id", "left").join(e, "id", "left").select("id", "evidence_count", F.coalesce("evidence_found", F.lit(0)).alias("evidence_found"), F.coalesce("edges_found", F.lit(0)).alias("edges_found")).where("evidence_count <> evidence_found")


def sound(facts: DataFrame, evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: numbers of self links, of edges of one key and of facts with a wrong count, and ``ok`` where there are none."""
    counts = [self_links(edges), duplicate_edges(edges), provenance_counts(facts, evidence, edges)]
    names = ["self_links", "duplicates", "count_mismatches"]
    rows = reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in zip(names, counts, strict=True)])
    return rows.agg(*[F.sum(F.when(F.col("what") == name, F.col("n"))).alias(name) for name in names], (F.sum("n") == 0).alias("ok"))


def _digest(rows: DataFrame, column: str) -> DataFrame:
    """Order-free digest of a column of strings: how many, and the sums of two parts of their hashes."""
    h = F.sha2(F.col(column), 256)
    part = lambda k: F.sum(F.conv(F.substring(h, k, 8), 16, 10).cast("long"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(part(1), F.lit(0)).alias("a"), F.coalesce(part(9), F.lit(0)).alias("b"))


def fingerprint(facts: DataFrame, edges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(part, n, a, b) for edge identities, edge meanings and clusters; equal layers have equal rows."""
    view = facts.select("id", F.concat_ws("|", text(F.col("canonical_attribute")), text(F.col("canonical_value")), text(F.col("period"))).alias("m"))
    s, t = view.toDF("s_id", "s_m"), view.toDF("t_id", "t_m")
    meaning = edges.join(s, F.col("source_fact_id") == F.col("s_id")).join(t, F.col("target_fact_id") == F.col("t_id")).select(F.concat_ws("|", "relationship_type", "s_m", "t_m").alias("c"))
    parts = {
        "edges": edges.select(F.concat_ws("|", "relationship_type", "pair_low", "pair_high").alias("c")),
        "meanings": meaning,
        "clusters": clusters.select(F.concat_ws("|", "canonical_attribute", "canonical_value", text(F.col("period")), F.col("document_count").cast("string")).alias("c")),
    }
    return reduce(DataFrame.unionByName, [_digest(df, "c").select(F.lit(name).alias("part"), "*") for name, df in parts.items()])


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Metrics of two audits side by side."""
    return before.withColumnRenamed("value", "before").join(after.withColumnRenamed("value", "after"), "metric", "full").withColumn("delta", F.coalesce("after", F.lit(0)) - F.coalesce("before", F.lit(0)))


