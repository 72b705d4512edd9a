"""Facts and evidence: identity, merging, confidence, deduplication, deletion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.canonical import canonicalize, normalized_value_key
from factloom.functions.text import blank_to_null, clamp_confidence, normalize_token, optional, spread, strip, text

EVIDENCE_TYPES = ["DIRECT", "SUPPORTING"]


def evidence_type(c: Column) -> Column:
    name = F.replace(F.upper(strip(c)), F.lit(" "), F.lit("_"))
    return F.when(name.isin(EVIDENCE_TYPES), name).otherwise(F.lit("DIRECT"))


def value_key(facts: DataFrame) -> Column:
    return normalized_value_key(F.coalesce(blank_to_null(F.col("canonical_value")), F.col("value")), F.col("unit"))


def clean_raw(raw: DataFrame) -> DataFrame:
    """Rows with entity, attribute, value and evidence; blanks to null; confidences in [0, 1], 0 counting as absent."""
    usable = " and ".join(f"trim(coalesce({c}, '')) <> ''" for c in ("entity", "attribute", "value", "evidence_text", "source_document"))
    base = F.nullif(clamp_confidence(F.col("confidence").cast("string")), F.lit(0.0))
    typed = raw if "evidence_type" in raw.columns else raw.withColumn("evidence_type", F.lit("DIRECT"))
    return (
        typed.where(f"{usable} and page_number is not null")
        .withColumns({c: strip(F.col(c)) for c in ("entity", "attribute", "value")})
        .withColumns({"unit": optional(F.col("unit")), "period": optional(F.col("period")), "confidence": F.coalesce(base, F.lit(0.5)), "evidence_type": evidence_type(F.col("evidence_type"))})
    )


def canonical(raw: DataFrame) -> DataFrame:
    """Canonical rows with the equivalence columns eq_entity, eq_attribute, eq_value; each row by itself."""
    c = canonicalize(clean_raw(spread(raw)))
    return c.withColumns({"eq_entity": normalize_token(F.col("canonical_entity")), "eq_attribute": normalize_token(F.col("canonical_attribute")), "eq_value": value_key(c)})


def keyed(c: DataFrame) -> DataFrame:
    """Canonical rows with the fact's period.

    Merging in ingest order has a closed form: within an equivalence key an undated row takes the first
    non-blank period of the key, and every other period makes a fact of its own.
    """
    same = Window.partitionBy("eq_entity", "eq_attribute", "eq_value").orderBy("ingest_ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return c.withColumn("fact_period", F.coalesce("period", F.first("period", ignorenulls=True).over(same)))


def identity_key(facts: DataFrame) -> Column:
    return F.concat_ws("|", "eq_entity", "eq_attribute", "eq_value", normalize_token(F.col("fact_period")))


def noisy_or(confidence: Column) -> Column:
    return 1 - F.product(1 - F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))


FACT_COLUMNS = [
    "entity", "attribute", "raw_attribute", "canonical_attribute", "canonical_entity", "canonical_value", "currency", "original_entity", "original_attribute",
    "original_value", "original_period", "value", "unit",
]


def identified(c: DataFrame) -> DataFrame:
    """Canonical rows with the id of the fact that each merges into; whole equivalence keys are needed, nothing beyond."""
    rows = keyed(c)
    return rows.withColumn("id", F.sha2(identity_key(rows), 256))


def claims(raw: DataFrame) -> DataFrame:
    """Canonical rows, one for each usable raw claim, with the id of the fact that each merges into."""
    return identified(canonical(raw))


def merge_facts(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    return merge_claims(claims(raw))


def merge_claims(rows: DataFrame, carry: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(facts, evidence). The first row of a fact gives its texts; evidence rows are distinct; confidence is their noisy-or.
    ``carry``: columns that are equal in all rows of a fact and go along with both."""
    along = [F.first(c).alias(c) for c in carry or []]
    place = ["source_document", "page_number", "evidence_text", "evidence_type"]
    evidence = (
        rows.groupBy(F.col("id").alias("fact_id"), *place)
        .agg(F.min_by("confidence", "ingest_ord").alias("confidence"), F.min("ingest_ord").alias("ingest_ord"), *along)
        .withColumn("evidence_id", F.sha2(F.concat_ws("|", "fact_id", *place), 256))
    )
    strength = evidence.groupBy("fact_id").agg(
        noisy_or(F.col("confidence")).alias("confidence"), F.count(F.lit(1)).alias("evidence_count"), F.countDistinct("source_document").alias("document_count")
    )
    facts = (
        rows.groupBy("id")
        .agg(F.min_by(F.struct(*FACT_COLUMNS, F.col("fact_period").alias("period"), "eq_entity", "eq_attribute", "eq_value"), "ingest_ord").alias("f"), F.min("ingest_ord").alias("ingest_ord"), *along)
        .select("id", "f.*", "ingest_ord", *(carry or []))
        .join(strength.withColumnRenamed("fact_id", "id"), "id")
    )
    return facts, evidence


def refresh_confidence(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Confidence from evidence; facts without any keep theirs."""
    new = evidence.groupBy(F.col("fact_id").alias("id")).agg(noisy_or(F.col("confidence")).alias("_new"))
    return facts.join(new, "id", "left").withColumn("confidence", F.coalesce("_new", "confidence")).drop("_new")


def dedup_stored(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(old_id, keeper_id) for stored facts that merge.

    Within an equivalence key with more than one period only equal periods merge and undated facts stay; with one
    period or none all merge. The keeper has a period, then most evidence, then the lowest ingest order, then id.
    """
    counts = evidence.groupBy(F.col("fact_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    key = ["eq_entity", "eq_attribute", "eq_value"]
    dated = normalize_token(F.col("period"))
    f = facts.join(counts, "id", "left").withColumns({"_p": dated, "_n": F.coalesce("_n", F.lit(0))})
    f = f.withColumn("_periods", F.size(F.collect_set(F.nullif("_p", F.lit(""))).over(Window.partitionBy(*key))))
    group = F.when(F.col("_periods") <= 1, F.lit("")).when(F.col("_p") != "", F.col("_p")).otherwise(F.concat(F.lit("#"), F.col("id")))
    rank = Window.partitionBy(*key, "_group").orderBy((F.col("_p") == "").cast("int"), F.desc("_n"), "ingest_ord", "id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return f.withColumn("_group", group).select(F.col("id").alias("old_id"), F.first("id").over(rank).alias("keeper_id"))


def apply_merge(facts: DataFrame, evidence: DataFrame, edges: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repoint evidence and edges to the keepers, drop repeats and self links, refresh confidences."""
    to = mapping.where("old_id <> keeper_id")
    place = ["source_document", "page_number", "evidence_text", "evidence_type"]
    moved = evidence.join(to, evidence.fact_id == to.old_id, "left").withColumn("fact_id", F.coalesce("keeper_id", "fact_id")).drop("old_id", "keeper_id")
    moved = moved.groupBy("fact_id", *place).agg(F.max("confidence").alias("confidence"), F.min("ingest_ord").alias("ingest_ord"))
    ends = edges
    for end in ("source_fact_id", "target_fact_id"):
        ends = ends.join(to, F.col(end) == F.col("old_id"), "left").withColumn(end, F.coalesce("keeper_id", F.col(end))).drop("old_id", "keeper_id")
    periods = facts.join(mapping, facts.id == mapping.old_id).groupBy(F.col("keeper_id").alias("id")).agg(F.max("period").alias("_period"))
    kept = facts.join(to, facts.id == to.old_id, "left_anti").join(periods, "id", "left").withColumn("period", F.coalesce("period", "_period")).drop("_period")
    return refresh_confidence(kept, moved), moved, ends.where("source_fact_id <> target_fact_id")


def delete_document(facts: DataFrame, evidence: DataFrame, edges: DataFrame, document: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without a document's evidence; facts left with none go, with their edges; others get new confidences."""
    left = evidence.where(F.col("source_document") != document)
    ids = left.select(F.col("fact_id").alias("id")).distinct()
    had = evidence.select(F.col("fact_id").alias("id")).distinct()
    gone = had.join(ids, "id", "left_anti")
    kept = refresh_confidence(facts.join(gone, "id", "left_anti"), left)
    ends = edges
    for end in ("source_fact_id", "target_fact_id"):
        ends = ends.join(gone.withColumnRenamed("id", end), end, "left_anti")
    return kept, left, ends


def clusters(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts of one attribute, value and period, whatever their entity, with documents and evidence counts."""
    docs = evidence.groupBy(F.col("fact_id").alias("id")).agg(F.collect_set("source_document").alias("_docs"), F.count(F.lit(1)).alias("_n"))
    key = ["canonical_attribute", "eq_value", "period"]
    return (
        facts.withColumn("period", text(F.col("period")))
        .join(docs, "id", "left")
        .groupBy(*key)
        .agg(
            F.min_by("canonical_value", F.struct("entity", "attribute", "value", "id")).alias("canonical_value"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("_docs")))).alias("supporting_documents"),
            F.array_sort(F.collect_set("id")).alias("supporting_fact_ids"),
            F.sum("_n").alias("evidence_count"),
        )
        .withColumns({"document_count": F.size("supporting_documents").cast("long"), "id": F.sha2(F.concat_ws("|", *key), 256), "period": F.nullif("period", F.lit(""))})
    )


def search(facts: DataFrame, evidence: DataFrame, edges: DataFrame, query: str = "", document: str | None = None) -> DataFrame:
    """Facts whose columns or evidence hold the query, with counts and their first evidence, in listing order.

    Existence tests are semi-joins, counts and the first evidence come from one aggregate each; no correlated
    sub-query is left.
    """
    from factloom.functions.text import like_contains

    columns = ["entity", "attribute", "raw_attribute", "canonical_attribute", "canonical_entity", "canonical_value", "value", "unit", "period"]
    found = facts
    if query:
        in_evidence = evidence.where(like_contains(F.col("source_document"), query) | like_contains(F.col("evidence_text"), query)).select(F.col("fact_id").alias("id")).distinct()
        hit = in_evidence.withColumn("_hit", F.lit(True))
        own = F.lit(False)
        for c in columns:
            own = own | like_contains(F.col(c), query)
        found = found.join(hit, "id", "left").where(own | F.col("_hit").isNotNull()).drop("_hit")
    if document is not None:
        found = found.join(evidence.where(F.col("source_document") == document).select(F.col("fact_id").alias("id")), "id", "left_semi")
    first = F.min_by(F.struct("source_document", "page_number", "evidence_text"), F.struct("ingest_ord", "evidence_id"))
    summary = evidence.groupBy(F.col("fact_id").alias("id")).agg(F.array_sort(F.collect_set("source_document")).alias("supporting_documents"), first.alias("_first"))
    links = edges.select(F.explode(F.array_distinct(F.array("source_fact_id", "target_fact_id"))).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("relationship_count"))
    return (
        found.join(summary, "id", "left")
        .join(links, "id", "left")
        .select(
            "id", *columns, "confidence", "evidence_count", "document_count", "supporting_documents", F.col("_first.source_document").alias("source_document"),
            F.col("_first.page_number").alias("page_number"), F.col("_first.evidence_text").alias("evidence_text"), F.coalesce("relationship_count", F.lit(0)).alias("relationship_count"),
        )
        .orderBy("entity", "attribute", "value", "id")
    )


def type_rank(c: Column) -> Column:
    return F.when(c == "DIRECT", 0).when(c == "SUPPORTING", 1).otherwise(4)


def evidence_list(evidence: DataFrame) -> DataFrame:
    """Each fact's evidence in detail order."""
    item = F.struct(type_rank(F.col("evidence_type")).alias("r"), "page_number", (-F.col("confidence")).alias("c"), "evidence_id", "source_document", "evidence_text", "evidence_type", "confidence")
    return evidence.groupBy("fact_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda e: F.struct(e["source_document"].alias("source_document"), e["page_number"].alias("page_number"), e["evidence_text"].alias("evidence_text"), e["evidence_type"].alias("evidence_type"), e["confidence"].alias("confidence"))).alias("evidence"))


def fact_detail(facts: DataFrame, evidence: DataFrame, edges: DataFrame, fact_id: str) -> DataFrame:
    """One fact with its evidence list and relationships."""
    links = (
        edges.where((F.col("source_fact_id") == fact_id) | (F.col("target_fact_id") == fact_id))
        .withColumn("direction", F.when(F.col("source_fact_id") == fact_id, "outgoing").otherwise("incoming"))
        .agg(F.array_sort(F.collect_list(F.struct("relationship_type", "direction", "source_fact_id", "target_fact_id", "confidence", "reasoning"))).alias("relationships"))
    )
    own = evidence_list(evidence.where(F.col("fact_id") == fact_id)).withColumnRenamed("fact_id", "id")
    return facts.where(F.col("id") == fact_id).join(own, "id", "left").join(links)


def representative_evidence(facts: DataFrame, evidence: DataFrame, document: str | None = None) -> DataFrame:
    """Each fact with its best evidence: direct first, then page, then id; of one document where it is given."""
    of = evidence if document is None else evidence.where(F.col("source_document") == document)
    best = of.groupBy(F.col("fact_id").alias("id")).agg(F.min_by(F.struct("source_document", "page_number", "evidence_text"), F.struct(F.when(F.col("evidence_type") == "DIRECT", 0).otherwise(1), "page_number", "evidence_id")).alias("b"))
    return facts.join(best, "id", "inner" if document is not None else "left").select("id", "entity", "attribute", "value", "unit", "period", "b.*")


def list_documents(evidence: DataFrame) -> DataFrame:
    return evidence.select("source_document").distinct().orderBy("source_document")
