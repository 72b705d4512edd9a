"""Queries over the driver's tables, one for each operator, with equivalent SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import canonical as C
from factloom.functions.text import fmt_g, merge_reasons
from factloom.operators import audit as A
from factloom.operators import facts as O
from factloom.operators import ids as I
from factloom.operators import links as N
from factloom.operators import lookup as L
from factloom.operators import relations as R
from factloom.operators import vectors as V
from factloom.sources import chunks, extract
from factloom.sources.raw_facts import RAW_FACTS_SQL, raw_facts
from factloom.store import FactStore, work_folder
from factloom.streaming.confidence import evidence_of, keep_confidences
from factloom.streaming.ingest import ingest, raw_stream
from factloom.tables import KeyedTable

_STORES: dict[tuple[str, str], FactStore] = {}


def store(spark: SparkSession, sf_dir: str) -> FactStore:
    """The fact layer of a data folder. Each of its tables is built once per application, when a query first reads it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        s = FactStore(spark, f"{work_folder(spark)}/{uuid.uuid4().hex}")
        s.append(raw_facts(spark, sf_dir))
        s.on_demand = True
        _STORES[key] = s
    return _STORES[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL building blocks (DuckDB)

_CANON = (
    "WITH raw AS ("
    + RAW_FACTS_SQL
    + r"""), c0 AS (
  SELECT *, CASE WHEN attribute IN ('total_revenue', 'Revenue', 'consolidated revenue') THEN 'total_revenue' WHEN attribute IN ('headcount', 'number of employees') THEN 'employee_count'
                 WHEN attribute IN ('CEO', 'chief executive') THEN 'holder' WHEN attribute LIKE 'account%' THEN 'account_balance' WHEN attribute LIKE 'operating%' THEN 'operating_margin' ELSE attribute END AS ca,
         CASE WHEN period IS NOT NULL THEN 'FY' || regexp_extract(period, '\d{4}') END AS cp,
         CASE WHEN contains(value, '%') THEN '%' WHEN contains(coalesce(unit, '') || ' ' || value, 'million') THEN 'million' END AS cu,
         CASE WHEN regexp_matches(value, '₹|INR') THEN 'INR' WHEN regexp_matches(lower(value), 'usd|\$') THEN 'USD' END AS cc,
         try_cast(nullif(regexp_extract(value, '\d+'), '') AS double) AS num FROM raw
), c1 AS (
  SELECT *, CASE ca WHEN 'holder' THEN 'CEO' WHEN 'employee_count' THEN 'Employees' ELSE entity END AS ce,
         CASE WHEN num IS NOT NULL AND (cc IS NOT NULL OR cu IS NOT NULL) THEN concat_ws(' ', format('{:g}', num), cc, cu) ELSE value END AS cv,
         CASE WHEN num IS NOT NULL THEN format('{:g}', num) || '|' || coalesce(cu, '') ELSE lower(value) END AS vk FROM c0
), c2 AS (
  SELECT *, lower(replace(replace(ce, '_', ' '), '-', ' ')) AS ee, replace(ca, '_', ' ') AS ea FROM c1
), keyed AS (
  SELECT *, coalesce(cp, first_value(cp IGNORE NULLS) OVER (PARTITION BY ee, ea, vk ORDER BY ingest_ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS fp FROM c2
), ided AS (
  SELECT *, sha256(concat_ws('|', ee, ea, vk, coalesce(lower(fp), ''))) AS id FROM keyed
), evidence AS (
  SELECT id AS fact_id, source_document, page_number, evidence_text, 'DIRECT' AS evidence_type, arg_min(confidence, ingest_ord) AS confidence, min(ingest_ord) AS ingest_ord,
         sha256(concat_ws('|', id, source_document, page_number, evidence_text, 'DIRECT')) AS evidence_id
  FROM ided GROUP BY id, source_document, page_number, evidence_text
), firsts AS (
  SELECT id, arg_min(entity, ingest_ord) AS entity, arg_min(ca, ingest_ord) AS attribute, arg_min(ca, ingest_ord) AS ca, arg_min(ce, ingest_ord) AS ce, arg_min(cv, ingest_ord) AS cv,
         arg_min(value, ingest_ord) AS value, arg_min(struct_pack(u := cu), ingest_ord).u AS unit, arg_min(attribute, ingest_ord) AS raw_attribute, max(fp) AS period, any_value(vk) AS vk, any_value(ee) AS ee, any_value(ea) AS ea,
         min(ingest_ord) AS ingest_ord FROM ided GROUP BY id
), strength AS (
  SELECT fact_id, 1 - product(1 - confidence) AS confidence, count(*) AS evidence_count, count(DISTINCT source_document) AS document_count FROM evidence GROUP BY fact_id
), facts AS (
  SELECT firsts.*, s.confidence, s.evidence_count, s.document_count,
         CASE WHEN contains(cv, '%') THEN 'ratio' WHEN regexp_matches(cv, 'INR|USD') THEN 'money' WHEN contains(cv, 'million') THEN 'scaled' ELSE 'plain' END AS dim,
         try_cast(split_part(vk, '|', 1) AS double) AS amount, CASE WHEN contains(vk, '|') THEN split_part(vk, '|', 2) ELSE '' END AS aunit
  FROM firsts JOIN strength s ON firsts.id = s.fact_id
), blobs AS (
  SELECT f.id, lower(concat_ws(' ', f.value, f.cv, f.entity, string_agg(e.evidence_text || ' ' || e.source_document, ' '))) AS blob FROM facts f JOIN evidence e ON e.fact_id = f.id GROUP BY f.id, f.value, f.cv, f.entity
), pairs AS (
  SELECT l.id AS lid, r.id AS rid, l.ca, l.vk = r.vk AS same_value, l.period = r.period AS same_period, lower(l.value) AS lv, lower(r.value) AS rv,
         coalesce(abs(l.amount - r.amount) / greatest(abs(l.amount), abs(r.amount), 1e-9) <= 0.05 AND (l.aunit = '' OR r.aunit = '' OR l.aunit = r.aunit), false) AS near
  FROM facts l JOIN facts r ON l.ca = r.ca AND lower(replace(l.entity, '_', ' ')) = lower(replace(r.entity, '_', ' ')) AND l.id < r.id
  WHERE (l.dim = 'ratio') = (r.dim = 'ratio')
), crossed AS (
  SELECT *, CASE WHEN same_value OR near THEN 'CORROBORATES' WHEN same_period THEN 'CONTRADICTS'
                 WHEN EXISTS (SELECT 1 FROM blobs b WHERE regexp_matches(b.blob, '\b(resign(ed|ation)?|appoint(ed|ment)?|succeeded|replaced|took over|outgoing|incoming|formerly)\b') AND (contains(b.blob, pairs.lv) OR contains(b.blob, pairs.rv))) THEN 'RECONCILES'
                 WHEN ca = 'holder' THEN 'POTENTIAL_CONTRADICTION' ELSE 'UNRESOLVED_DIFFERENCE' END AS kind FROM pairs
), places AS (
  SELECT DISTINCT fact_id, source_document, page_number FROM evidence
), parts AS (
  SELECT DISTINCT c.id AS lid, p.id AS rid FROM facts c JOIN places cp ON cp.fact_id = c.id JOIN places pp ON pp.source_document = cp.source_document AND abs(pp.page_number - cp.page_number) <= 5
  JOIN facts p ON p.id = pp.fact_id WHERE c.ca IN ('product_revenue', 'services_revenue') AND p.ca = 'total_revenue'
), sums AS (
  SELECT t.id AS lid, least_child AS rid FROM (
    SELECT t.id, arg_min(a.id, (a.ca, a.cv, coalesce(lower(a.period), ''), a.id)) AS least_child FROM facts t JOIN facts a ON a.ca = 'product_revenue' AND a.ee = t.ee AND coalesce(a.period, '') = coalesce(t.period, '')
    JOIN facts b ON b.ca = 'services_revenue' AND b.ee = t.ee AND coalesce(b.period, '') = coalesce(t.period, '')
    WHERE t.ca = 'total_revenue' AND abs(a.amount + b.amount - t.amount) <= greatest(0.51, 0.02 * greatest(abs(a.amount + b.amount), abs(t.amount))) GROUP BY t.id) t
), edges AS (
  SELECT lid, rid, kind, CASE WHEN kind = 'CORROBORATES' AND NOT same_value THEN 0.84 WHEN kind IN ('CORROBORATES', 'CONTRADICTS') THEN 0.9 WHEN kind = 'RECONCILES' THEN 0.86 ELSE 0.7 END AS confidence FROM crossed
  UNION ALL SELECT lid, rid, 'COMPUTED_SUPPORT', 0.95 FROM sums
)
"""
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- facts


@query(_CANON + "SELECT id, period, evidence_count, document_count, round(confidence, 6) AS confidence FROM facts")
def fact_merge_confidence(spark, sf):
    return store(spark, sf).table("facts").select("id", "period", "evidence_count", "document_count", F.round("confidence", 6).alias("confidence"))


@query(_CANON + "SELECT ingest_ord, ca AS canonical_attribute, ce AS canonical_entity, cv AS canonical_value, cu AS unit, cp AS period, cc AS currency FROM c2")
def canonical_facts(spark, sf):
    return store(spark, sf).table("claims").select("ingest_ord", "canonical_attribute", "canonical_entity", "canonical_value", "unit", "period", "currency")


@query(_CANON + "SELECT ingest_ord, vk AS value_key FROM c2")
def normalized_value_key(spark, sf):
    return store(spark, sf).table("claims").select("ingest_ord", F.col("eq_value").alias("value_key"))


@query("SELECT o_orderkey, format('{:g}', o_totalprice) AS shown FROM orders")
def six_digit_amounts(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", fmt_g(F.col("o_totalprice")).alias("shown"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def canonical_date(spark, sf):
    forms = F.element_at(F.array(F.date_format("o_orderdate", "d MMMM yyyy"), F.date_format("o_orderdate", "MMM d, yyyy"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.date_format("o_orderdate", "yyyy-M-d")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", C.canonicalize_date(F.concat(F.lit("signed on "), forms)).alias("day"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'FY' WHEN 1 THEN 'CY' WHEN 2 THEN 'FY' ELSE 'AY' END || CASE o_orderkey % 4 WHEN 9 THEN '' ELSE year(o_orderdate)::varchar END AS period FROM orders")
def canonical_period(spark, sf):
    y = F.year("o_orderdate").cast("string")
    forms = F.element_at(F.array(F.concat(F.lit("fy "), y, F.lit("-25")), F.concat(F.lit("CY "), y), y, F.concat(F.lit("ay"), y)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", C.canonicalize_period(forms, F.lit("revenue"), F.lit("Acme")).alias("period"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'crore' WHEN 1 THEN 'lakh' WHEN 2 THEN 'million' WHEN 3 THEN '%' ELSE '' END AS unit, CASE p_partkey % 5 WHEN 0 THEN 'scaled' WHEN 1 THEN 'scaled' WHEN 2 THEN 'scaled' WHEN 3 THEN 'ratio' ELSE 'money' END AS dimension FROM part")
def canonical_unit_and_dimension(spark, sf):
    value = F.col("p_size").cast("string")
    unit = F.element_at(F.array(F.lit("cr"), F.lit("Lacs"), F.lit("mn"), F.lit("pct"), F.lit("INR")), (F.col("p_partkey") % 5 + 1).cast("int"))
    canonical = C.canonicalize_unit(unit, value)
    shown = C.canonicalize_value(value, F.when(unit == "INR", unit).otherwise(canonical), F.lit("size"))
    return table(spark, sf, "part").select("p_partkey", canonical.alias("unit"), C.value_dimension(shown, canonical).alias("dimension"))


@query("SELECT p_partkey, p_size::varchar || ' market street, block ' || p_size::varchar AS address FROM part")
def canonical_address(spark, sf):
    raw = F.concat(F.col("p_size").cast("string"), F.lit("  Market St. ,Block "), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", C.canonicalize_value(raw, F.lit(None).cast("string"), F.lit("registered address")).alias("address"))


@query(_CANON + "SELECT ca AS canonical_attribute, vk AS value_key, period, sum(evidence_count)::bigint AS evidence_count, count(*) AS fact_count FROM facts GROUP BY ca, vk, period")
def fact_clusters(spark, sf):
    return store(spark, sf).table("clusters").select("canonical_attribute", F.col("eq_value").alias("value_key"), "period", "evidence_count", F.size("supporting_fact_ids").cast("long").alias("fact_count"))


@query(_CANON + "SELECT f.id, f.evidence_count, f.document_count, string_agg(DISTINCT e.source_document, ',' ORDER BY e.source_document) AS documents FROM facts f JOIN evidence e ON e.fact_id = f.id WHERE f.id IN (SELECT fact_id FROM evidence WHERE evidence_text ILIKE '%revenue of nation%' OR source_document ILIKE '%revenue of nation%') OR f.value ILIKE '%revenue of nation%' GROUP BY f.id, f.evidence_count, f.document_count")
def search_facts(spark, sf):
    return store(spark, sf).search("Revenue OF nation").select("id", "evidence_count", "document_count", F.array_join("supporting_documents", ",").alias("documents"))


@query(_CANON + "SELECT f.id, f.ca AS attribute, f.value, f.period FROM facts f WHERE f.id IN (SELECT fact_id FROM evidence WHERE source_document = 'orders_1998.pdf')")
def search_by_document(spark, sf):
    return store(spark, sf).search("", "orders_1998.pdf").select("id", "attribute", "value", "period")


@query(_CANON + "SELECT DISTINCT source_document FROM evidence")
def list_documents(spark, sf):
    return O.list_documents(store(spark, sf).table("evidence"))


@query(_CANON + "SELECT fact_id AS id, arg_min(source_document, (page_number, evidence_id)) AS source_document, min(page_number) AS page_number FROM evidence GROUP BY fact_id")
def representative_evidence(spark, sf):
    s = store(spark, sf)
    return O.representative_evidence(s.table("facts"), s.table("evidence")).select("id", "source_document", "page_number")


@query(_CANON + "SELECT fact_id, string_agg(source_document || ':' || page_number, ',' ORDER BY page_number, confidence DESC, evidence_id) AS places FROM evidence GROUP BY fact_id")
def evidence_listing(spark, sf):
    lists = O.evidence_list(store(spark, sf).table("evidence"))
    return lists.select("fact_id", F.array_join(F.transform("evidence", lambda e: F.concat(e["source_document"], F.lit(":"), e["page_number"].cast("string"))), ",").alias("places"))


@query(_CANON + ", g AS (SELECT id, ee, ea, vk, coalesce(lower(period), '') AS p, evidence_count AS n, ingest_ord, count(DISTINCT nullif(coalesce(lower(period), ''), '')) OVER (PARTITION BY ee, ea, vk) AS k FROM facts) SELECT id AS old_id, first_value(id) OVER (PARTITION BY ee, ea, vk, CASE WHEN k <= 1 THEN '' WHEN p <> '' THEN p ELSE '#' || id END ORDER BY (p = '')::int, n DESC, ingest_ord, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keeper_id FROM g")
def dedup_keepers(spark, sf):
    s = store(spark, sf)
    return O.dedup_stored(s.table("facts"), s.table("evidence"))


@query(_CANON + ", l AS (SELECT fact_id, 1 - product(1 - confidence) AS c, count(*) AS n FROM evidence WHERE source_document <> 'notes.pdf' GROUP BY fact_id) SELECT fact_id AS id, round(c, 6) AS confidence FROM l")
def delete_document_cascade(spark, sf):
    s = store(spark, sf)
    return O.delete_document(s.table("facts"), s.table("evidence"), s.table("edges"), "notes.pdf")[0].select("id", F.round("confidence", 6).alias("confidence"))


# ---------------------------------------------------------------- relationships


@query(_CANON + "SELECT kind AS relationship_type, lid AS low, rid AS high, confidence FROM edges WHERE kind NOT IN ('PART_OF', 'COMPUTED_SUPPORT')")
def relationship_pairs(spark, sf):
    e = store(spark, sf).table("edges").where(F.col("relationship_type").isin(R.UNDIRECTED))
    return e.select("relationship_type", F.col("pair_low").alias("low"), F.col("pair_high").alias("high"), "confidence")


def _typed(name: str, kind: str):
    def f(spark, sf):
        return store(spark, sf).table("edges").where(F.col("relationship_type") == kind).select("source_fact_id", "target_fact_id", "confidence")

    f.__name__ = name
    query(_CANON + f"SELECT lid AS source_fact_id, rid AS target_fact_id, confidence FROM edges WHERE kind = '{kind}'")(f)


for _name, _kind in (("corroborations", "CORROBORATES"), ("contradictions", "CONTRADICTS"), ("transition_reconcile", "RECONCILES"), ("unresolved_differences", "UNRESOLVED_DIFFERENCE"), ("potential_contradictions", "POTENTIAL_CONTRADICTION"), ("computed_support", "COMPUTED_SUPPORT")):
    _typed(_name, _kind)


@query(_CANON + "SELECT lid AS source_fact_id, rid AS target_fact_id FROM parts")
def part_of_edges(spark, sf):
    return store(spark, sf).table("edges").where("relationship_type = 'PART_OF'").select("source_fact_id", "target_fact_id")


@query(_CANON + "SELECT t AS relationship_type, coalesce(n, 0) AS n FROM (VALUES ('SUPPORTS'), ('CORROBORATES'), ('CONTRADICTS'), ('RECONCILES'), ('TEMPORAL_SUCCESSOR'), ('PART_OF'), ('COMPUTED_SUPPORT'), ('UNRESOLVED_DIFFERENCE'), ('POTENTIAL_CONTRADICTION')) x(t) LEFT JOIN (SELECT kind, count(*) AS n FROM (SELECT kind FROM edges UNION ALL SELECT 'PART_OF' FROM parts) GROUP BY kind) ON kind = t")
def relation_type_counts(spark, sf):
    return R.type_counts(store(spark, sf).table("edges"))


EVERY = ", every AS (SELECT lid, rid, kind FROM edges UNION ALL SELECT lid, rid, 'PART_OF' FROM parts)"


@query(_CANON + EVERY + " SELECT kind AS relationship_type, lid AS low, 2::bigint AS n FROM every WHERE kind = 'CONTRADICTS'")
def duplicate_edges(spark, sf):
    """The layer's edges with every contradiction once more, under an id of its own."""
    e = store(spark, sf).table("edges")
    again = e.where("relationship_type = 'CONTRADICTS'").withColumn("id", F.concat(F.lit("again-"), "id"))
    return A.duplicate_edges(e.unionByName(again)).select("relationship_type", F.col("pair_low").alias("low"), "n")


@query(_CANON + " SELECT 'self-' || id AS id FROM facts WHERE ca = 'holder'")
def self_links(spark, sf):
    """The layer's edges, and a link of every holder to itself."""
    s = store(spark, sf)
    holders = s.table("facts").where("canonical_attribute = 'holder'").select(F.concat(F.lit("self-"), "id").alias("id"), F.col("id").alias("source_fact_id"), F.col("id").alias("target_fact_id"))
    return A.self_links(s.table("edges").select("id", "source_fact_id", "target_fact_id").unionByName(holders)).select("id")


_KIDS = "('product_revenue', 'services_revenue')"
_TYPE_LIST = "('SUPPORTS'), ('CORROBORATES'), ('CONTRADICTS'), ('RECONCILES'), ('TEMPORAL_SUCCESSOR'), ('PART_OF'), ('COMPUTED_SUPPORT'), ('UNRESOLVED_DIFFERENCE'), ('POTENTIAL_CONTRADICTION'), ('BOGUS')"


@query(
    _CANON
    + EVERY
    + rf""", ends AS (
  SELECT lid, rid FROM crossed UNION SELECT lid, rid FROM parts UNION SELECT rid, lid FROM parts UNION SELECT id, id FROM facts WHERE ca = 'holder' UNION SELECT id, 'none' FROM facts WHERE ca = 'holder'
  UNION SELECT a.id, b.id FROM facts a JOIN facts b ON a.entity = b.entity AND a.ca = 'operating_margin' AND b.ca IN ('employee_count', 'total_revenue')
  UNION SELECT a.id, b.id FROM facts a JOIN facts b ON a.entity = b.entity AND a.ca = 'product_revenue' AND b.ca = 'services_revenue'
), v AS (
  SELECT ends.*, l.ca AS lca, r.ca AS rca, l.id IS NULL OR r.id IS NULL AS lost, (l.dim = 'ratio') = (r.dim = 'ratio') AS comparable, coalesce(l.period = r.period, false) AS same_period,
         l.vk = r.vk OR coalesce(abs(l.amount - r.amount) / greatest(abs(l.amount), abs(r.amount), 1e-9) <= 0.05 AND (l.aunit = '' OR r.aunit = '' OR l.aunit = r.aunit), false) AS agree,
         EXISTS (SELECT 1 FROM blobs b WHERE regexp_matches(b.blob, '\b(resign(ed|ation)?|appoint(ed|ment)?|succeeded|replaced|took over|outgoing|incoming|formerly)\b') AND (contains(b.blob, lower(l.value)) OR contains(b.blob, lower(r.value)))) AS named
  FROM ends LEFT JOIN facts l ON l.id = lid LEFT JOIN facts r ON r.id = rid
), w AS (
  SELECT *, named AND NOT agree AND NOT same_period AND comparable AS supported, lca IN {_KIDS} AND rca IN {_KIDS} AND lca <> rca AS sib, lca IN {_KIDS} AND rca = 'total_revenue' AS child FROM v
), j AS (
  SELECT t AS relationship_type, CASE WHEN lost THEN 'Missing source or target fact.' WHEN lid = rid THEN 'Self-links are not allowed.'
    WHEN t IN ('CONTRADICTS', 'CORROBORATES') AND NOT comparable THEN 'Incomparable value dimensions'
    WHEN t = 'CONTRADICTS' AND lca <> rca THEN 'Different attributes cannot contradict.' WHEN t = 'CONTRADICTS' AND NOT same_period THEN 'Contradiction requires the same period.'
    WHEN t = 'CONTRADICTS' AND agree THEN 'Contradiction requires different values.'
    WHEN t IN ('CORROBORATES', 'RECONCILES', 'UNRESOLVED_DIFFERENCE', 'POTENTIAL_CONTRADICTION') AND lca <> rca THEN 'Same canonical attribute required.'
    WHEN t = 'CORROBORATES' AND NOT agree THEN 'Corroboration requires equivalent values.' WHEN t = 'RECONCILES' AND agree THEN 'Reconciliation applies to different values.'
    WHEN t = 'RECONCILES' AND same_period THEN 'Same-period disagreements are contradictions, not reconciliations.' WHEN t = 'RECONCILES' AND NOT supported THEN 'Reconciliation requires extracted transition evidence.'
    WHEN t IN ('UNRESOLVED_DIFFERENCE', 'POTENTIAL_CONTRADICTION') AND agree THEN 'Approximate equivalents corroborate instead.'
    WHEN t IN ('UNRESOLVED_DIFFERENCE', 'POTENTIAL_CONTRADICTION') AND supported THEN 'Transition evidence should reconcile this pair.'
    WHEN t = 'COMPUTED_SUPPORT' AND lca <> 'total_revenue' THEN 'COMPUTED_SUPPORT must point at a total.' WHEN t = 'PART_OF' AND sib THEN 'Sibling facts cannot be PART_OF each other.'
    WHEN t = 'PART_OF' AND lca = rca THEN 'A fact cannot be PART_OF itself or the same canonical attribute.' WHEN t = 'PART_OF' AND rca IN {_KIDS} THEN 'Children may never become parents.'
    WHEN t = 'PART_OF' AND NOT child THEN 'PART_OF requires a parent-child hierarchy' WHEN t IN ('SUPPORTS', 'TEMPORAL_SUCCESSOR') THEN 'Candidate pair is not eligible for this relationship type.'
    WHEN t = 'BOGUS' THEN 'Unknown relationship type BOGUS.' ELSE 'passed' END AS reason FROM w, (VALUES {_TYPE_LIST}) x(t)
) SELECT relationship_type, reason, count(*) AS n FROM j GROUP BY ALL"""
)
def edge_validation(spark, sf):
    """Every pair the layer knows, parents before children, siblings, attributes of unlike kinds, self links and lost facts, each under every type and an unknown one."""
    s = store(spark, sf)
    f, e = s.table("facts"), s.table("edges").select(F.col("source_fact_id").alias("l"), F.col("target_fact_id").alias("r"), "relationship_type")
    of = lambda *names: f.where(F.col("canonical_attribute").isin(*names)).select("id", "entity")
    beside = lambda a, b: of(*a).toDF("l", "entity").join(of(*b).toDF("r", "entity"), "entity").select("l", "r")
    pairs, parts, holders = e.where(F.col("relationship_type").isin(R.UNDIRECTED)).select("l", "r"), e.where("relationship_type = 'PART_OF'").select("l", "r"), of("holder").select(F.col("id").alias("l"))
    ends = reduce(DataFrame.unionByName, [
        pairs, parts, parts.select(F.col("r").alias("l"), F.col("l").alias("r")), holders.withColumn("r", F.col("l")), holders.withColumn("r", F.lit("none")),
        beside(["operating_margin"], ["employee_count", "total_revenue"]), beside(["product_revenue"], ["services_revenue"]),
    ]).distinct()
    planted = ends.select(F.col("l").alias("source_fact_id"), F.col("r").alias("target_fact_id"), F.explode(F.array(*map(F.lit, [*R.TYPES, "BOGUS"]))).alias("relationship_type"), F.lit("passed").alias("reasoning"))
    checked = R.validate(planted, s.table("features"))
    return checked.groupBy("relationship_type", F.split("check_reason", r" \(")[0].alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    _CANON
    + rf""", near AS (SELECT DISTINCT a.fact_id AS lid, b.fact_id AS rid FROM places a JOIN places b ON a.source_document = b.source_document AND abs(a.page_number - b.page_number) <= 5 AND a.fact_id <> b.fact_id)
SELECT lid AS source_fact_id, rid AS target_fact_id, l.ca || ' = ' || l.value AS source_fact, r.ca || ' = ' || r.value AS target_fact, 'PART_OF' AS proposed_relationship, false AS accepted,
  CASE WHEN l.ca = 'total_revenue' THEN 'Parent cannot be PART_OF its child.' ELSE 'Sibling facts cannot be PART_OF each other.' END AS reason
FROM near JOIN facts l ON l.id = lid JOIN facts r ON r.id = rid WHERE r.ca IN {_KIDS} AND (l.ca = 'total_revenue' OR l.ca IN {_KIDS} AND l.ca <> r.ca)"""
)
def candidate_log(spark, sf):
    return store(spark, sf).table("candidates")


_STATEMENT = "trim({0}.ca || ' = ' || {0}.value || CASE WHEN {0}.unit IS NOT NULL AND NOT contains(lower({0}.value), lower({0}.unit)) THEN ' ' || {0}.unit ELSE '' END)"
_FIRST = "(SELECT arg_min(id, ingest_ord) FROM facts WHERE ca = 'total_revenue')"


def first_total(spark, sf) -> str:
    return store(spark, sf).table("facts").where("canonical_attribute = 'total_revenue'").agg(F.min_by("id", "ingest_ord")).first()[0]


@query(
    _CANON
    + EVERY
    + f", ours AS (SELECT * FROM every WHERE {_FIRST} IN (lid, rid)) SELECT kind AS relationship_type, CASE WHEN lid = {_FIRST} THEN 'outgoing' ELSE 'incoming' END AS direction, CASE WHEN lid = {_FIRST} THEN rid ELSE lid END AS related_fact_id, "
    + f"CASE WHEN lid = {_FIRST} THEN {_STATEMENT.format('r')} ELSE {_STATEMENT.format('l')} END AS related_statement, {_STATEMENT.format('l')} || ' -> ' || {_STATEMENT.format('r')} AS arrow, "
    + "CASE kind WHEN 'PART_OF' THEN 'Child -> Parent' WHEN 'COMPUTED_SUPPORT' THEN 'Components -> Total' ELSE 'Source -> Target' END AS direction_label FROM ours JOIN facts l ON l.id = lid JOIN facts r ON r.id = rid"
)
def fact_relationships(spark, sf):
    """The edges at one fact, as its detail page lists them."""
    return store(spark, sf).relationships(first_total(spark, sf)).select("relationship_type", "direction", "related_fact_id", "related_statement", "arrow", "direction_label")


@query(_CANON + EVERY + ", asked AS (SELECT rid AS a, lid AS b, kind FROM every WHERE kind <> 'COMPUTED_SUPPORT') SELECT kind AS relationship_type, kind <> 'PART_OF' AS found, count(*) AS n FROM asked GROUP BY ALL")
def relationship_exists(spark, sf):
    """Every edge asked for the other way round: undirected ones exist, directed ones do not."""
    e = store(spark, sf).table("edges")
    asked = e.where("relationship_type <> 'COMPUTED_SUPPORT'").select(F.col("target_fact_id").alias("source_fact_id"), F.col("source_fact_id").alias("target_fact_id"), F.lower("relationship_type").alias("relationship_type"))
    return R.exists(e, asked).groupBy("relationship_type", "found").agg(F.count(F.lit(1)).alias("n"))


@query(_CANON + EVERY + " SELECT kind AS relationship_type, count(*) AS n FROM every WHERE kind <> 'CONTRADICTS' GROUP BY kind")
def delete_relationships(spark, sf):
    e = store(spark, sf).table("edges")
    return L.without_relationships(e, e.where("relationship_type = 'CONTRADICTS'").select("id")).groupBy("relationship_type").agg(F.count(F.lit(1)).alias("n"))


@query(_CANON + EVERY + " SELECT (SELECT count(*) FROM facts WHERE ca = 'holder') AS self_links, (SELECT count(*) FROM every WHERE kind = 'CONTRADICTS') AS duplicates, (SELECT count(*) FROM facts WHERE id IN (SELECT fact_id FROM evidence WHERE source_document = 'notes.pdf')) AS count_mismatches, false AS ok")
def layer_soundness(spark, sf):
    """The layer with links of holders to themselves, every contradiction twice, and without the evidence of the notes."""
    s = store(spark, sf)
    e, f = s.table("edges"), s.table("facts")
    loops = f.where("canonical_attribute = 'holder'").select(F.concat(F.lit("self-"), "id").alias("id"), F.lit("SUPPORTS").alias("relationship_type"), *[F.col("id").alias(c) for c in ("pair_low", "pair_high", "source_fact_id", "target_fact_id")])
    planted = e.select(*loops.columns).unionByName(e.where("relationship_type = 'CONTRADICTS'").withColumn("id", F.concat(F.lit("again-"), "id")).select(*loops.columns)).unionByName(loops)
    return A.sound(f, s.table("evidence").where("source_document <> 'notes.pdf'"), planted)


@query(_CANON + EVERY + f", ends AS (SELECT lid AS id FROM every UNION ALL SELECT rid FROM every WHERE lid <> rid), n AS (SELECT id, count(*) AS n FROM ends GROUP BY id) SELECT f.id, {_STATEMENT.format('f')} AS fact, f.evidence_count, coalesce(n, 0) AS relationship_count FROM facts f LEFT JOIN n USING (id)")
def debug_rows(spark, sf):
    s = store(spark, sf)
    return L.debug_rows(s.table("facts"), s.table("evidence"), s.table("edges")).select("id", "fact", "evidence_count", "relationship_count")


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '[\"' || c_custkey || '\",\"x\"]' WHEN 1 THEN '[\"' || c_custkey || '\",\"y z\"]' ELSE '[]' END AS ids FROM customer")
def id_lists(spark, sf):
    """Ids as a JSON list, as comma-separated text, as other JSON and as blanks."""
    k = F.col("c_custkey").cast("string")
    forms = F.element_at(F.array(F.concat(F.lit('["'), k, F.lit('", " ", "x"]')), F.concat(k, F.lit(" ,, y z,")), F.lit('{"a": 1}'), F.lit("  ")), (F.col("c_custkey") % 4 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", L.dump_id_list(L.parse_id_list(forms)).alias("ids"))


@query("WITH e AS (SELECT l_orderkey AS o, l_partkey % 50 AS a, l_suppkey % 50 AS b, l_quantity / 100 AS c FROM lineitem) SELECT least(a, b)::varchar AS low, greatest(a, b)::varchar AS high, max(c) AS confidence FROM e WHERE a <> b GROUP BY 1, 2")
def pair_key_dedup(spark, sf):
    ids = F.array().cast("array<string>")
    e = table(spark, sf, "lineitem").select(
        (F.col("l_partkey") % 50).cast("string").alias("source_fact_id"), (F.col("l_suppkey") % 50).cast("string").alias("target_fact_id"), F.lit("CORROBORATES").alias("relationship_type"),
        (F.col("l_quantity") / 100).alias("confidence"), F.lit("r").alias("reasoning"), ids.alias("supporting_fact_ids"), ids.alias("supporting_evidence_ids"),
    )
    numeric = R.dedupe(e).select(F.least(F.col("pair_low").cast("long"), F.col("pair_high").cast("long")).cast("string").alias("low"), F.greatest(F.col("pair_low").cast("long"), F.col("pair_high").cast("long")).cast("string").alias("high"), "confidence")
    return numeric


# ---------------------------------------------------------------- vectors, text, audits


@query("WITH n AS (SELECT vec_id, list_transform(embedding, lambda x: x::double / sqrt(list_dot_product(embedding::double[], embedding::double[]))) AS e FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_dot_product(q.e, v.e) AS d FROM n q JOIN n v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0) SELECT query_id, rank, round(d, 6) AS similarity FROM (SELECT query_id, d, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9) DESC, id) AS rank FROM s) WHERE rank <= 5")
def knn_batch(spark, sf):
    v = table(spark, sf, "embeddings")
    return V.nearest(v, v.where("vec_id % 20 = 0")).select("query_id", "rank", F.round("similarity", 6).alias("similarity"))


@query("WITH t AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS token FROM part), h AS (SELECT token, md5(token) AS d FROM t WHERE token <> '') SELECT token, (('0x' || d[7:8] || d[5:6] || d[3:4] || d[1:2])::bigint % 384)::int AS slot_a, (('0x' || d[15:16] || d[13:14] || d[11:12] || d[9:10])::bigint % 384)::int AS slot_b FROM h")
def hash_embedding_slots(spark, sf):
    return V.slots(table(spark, sf, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("token")).where("token <> ''").distinct())


@query(_CANON + "SELECT id AS fact_id, sha256('hash-384' || chr(10) || concat_ws(' ', ce, ca, cv, period)) AS text_hash FROM facts")
def embedding_text_hash(spark, sf):
    return store(spark, sf).table("embeddings").select("fact_id", "text_hash")


@query(
    _CANON
    + f""", words AS (SELECT id, unnest(regexp_split_to_array(lower(concat_ws(' ', ce, ca, cv, period)), '\\s+')) AS t FROM facts), h AS (SELECT id, md5(t) AS d FROM words WHERE t <> ''),
slots AS (SELECT id, ('0x' || d[7:8] || d[5:6] || d[3:4] || d[1:2])::bigint % 384 AS s, 1.0 AS w FROM h UNION ALL SELECT id, ('0x' || d[15:16] || d[13:14] || d[11:12] || d[9:10])::bigint % 384, 0.5 FROM h),
v AS (SELECT id, s, sum(w)::double AS w FROM slots GROUP BY ALL), n AS (SELECT id, sqrt(sum(w * w)) AS n FROM v GROUP BY id),
d AS (SELECT b.id, sum(a.w * b.w) / any_value(m.n * k.n) AS d FROM v a JOIN v b ON a.s = b.s JOIN n m ON m.id = a.id JOIN n k ON k.id = b.id WHERE a.id = {_FIRST} AND b.id <> a.id GROUP BY b.id)
SELECT (row_number() OVER (ORDER BY round(d, 4) DESC))::int AS rank, round(d, 4) AS similarity FROM d ORDER BY rank LIMIT 10"""
)
def similar_facts(spark, sf):
    """The ten facts nearest to one; equal similarities make their order free, so the facts' own columns are left out here."""
    return store(spark, sf).similar(first_total(spark, sf), 10).select("rank", F.round("similarity", 4).alias("similarity"))


_SPACE = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_LINES = r"\r\n|[\n\r\x0B\f\x1C-\x1E\x{85}\x{2028}\x{2029}]"


def _stripped(c: str) -> str:
    return f"regexp_replace({c}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _window_end(start: str) -> str:
    """Where the window at ``start`` of text t ends: its last strong break in the later part, else its whole length."""
    w = f"substr(t, {start} + 1, 1800)"
    last = lambda b: f"(1801 - strpos(reverse({w}), reverse({b})))"  # noqa: E731  one behind the break
    cases = " ".join(f"WHEN strpos(reverse({w}), reverse({b})) > 0 AND {last(b)} - length({b}) >= 1080 THEN {start} + {last(b)}" for b in ("chr(10) || chr(10)", "chr(10)", "'. '", "'; '"))
    return f"(CASE WHEN {start} + 1800 >= length(t) THEN length(t) {cases} ELSE {start} + 1800 END)::bigint"


_PIECES = f"""WITH RECURSIVE pages AS (
  SELECT 'doc_' || doc_id AS d, p::int AS page_number, substr(text, (p - 1) * 4000 + 1, 4000) AS raw FROM (SELECT doc_id, text, unnest(range(1, greatest(ceil(length(text) / 4000.0), 1)::bigint + 1)) AS p FROM documents)
), clean AS (
  SELECT d, page_number, {_stripped(f"regexp_replace(array_to_string(list_transform(regexp_split_to_array(raw, '{_LINES}'), lambda x: {_stripped('x')}), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS t FROM pages
), steps(d, page_number, t, k, start, stop) AS (
  SELECT d, page_number, t, 0, 0::bigint, {_window_end("0")} FROM clean WHERE t <> ''
  UNION ALL SELECT d, page_number, t, k + 1, start, {_window_end("start")} FROM (SELECT d, page_number, t, k, greatest(stop - 200, start + 1) AS start FROM steps WHERE stop < length(t))
), pieces AS (SELECT d AS source_document, page_number, k, {_stripped("substr(t, start + 1, stop - start)")} AS text FROM steps)
"""


@query(_PIECES + "SELECT source_document, page_number, text, (row_number() OVER (PARTITION BY source_document ORDER BY page_number, k) - 1)::int AS chunk_index FROM pieces WHERE text <> ''")
def chunk_documents(spark, sf):
    return chunks.chunk_pages(chunks.text_pages(table(spark, sf, "documents")))


@query(_PIECES + "SELECT source_document, page_number, text, (row_number() OVER (PARTITION BY source_document, page_number ORDER BY k) - 1)::int AS chunk_index FROM pieces WHERE text <> ''")
def split_text_lateral(spark, sf):
    """The splitter as a table function in SQL, page by page."""
    chunks.register_split_text(spark)
    return spark.sql("SELECT p.source_document, p.page_number, c.text, c.chunk_index FROM {pages} p, LATERAL split_text(p.text, 1800, 200) c", pages=chunks.text_pages(table(spark, sf, "documents")))


@query(f"SELECT doc_id, nullif(regexp_replace(substr(text, 11, 60), '^{_SPACE}+|{_SPACE}+$', '', 'g'), '') AS aligned FROM documents")
def evidence_alignment(spark, sf):
    return table(spark, sf, "documents").select("doc_id", extract.align(F.substring("text", 11, 60), F.col("text")).alias("aligned"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS value FROM events""")
def json_fact_parse(spark, sf):
    k = F.get_json_object("props", "$.k")
    answer = F.concat(F.lit('```json\n{"facts": [{"entity": "e", "attribute": "k", "value": "'), k, F.lit('", "evidence_snippets": []}]}\n``` done'))
    return extract.parse_answers(table(spark, sf, "events").select("event_id", answer.alias("answer"))).select("event_id", F.col("item.value").alias("value"))


@query(_CANON + ", x AS (SELECT count(*) AS facts, count(*) FILTER (WHERE ca = 'employee_count') AS employee_count_facts, count(*) FILTER (WHERE ca IN ('total_revenue', 'product_revenue', 'services_revenue')) AS revenue_facts, count(DISTINCT ca) AS distinct_canonical_attributes FROM facts), y AS (SELECT count(*) AS relationships, count(*) FILTER (WHERE kind = 'CONTRADICTS') AS contradictions FROM (SELECT kind FROM edges UNION ALL SELECT 'PART_OF' FROM parts)), z AS (SELECT count(*) AS evidence FROM evidence) SELECT metric, value FROM (SELECT * FROM x, y, z) UNPIVOT (value FOR metric IN (facts, employee_count_facts, revenue_facts, distinct_canonical_attributes, relationships, contradictions, evidence))")
def audit_metrics(spark, sf):
    s = store(spark, sf)
    shown = ["facts", "employee_count_facts", "revenue_facts", "distinct_canonical_attributes", "relationships", "contradictions", "evidence"]
    return A.audit(*[s.table(t) for t in ("facts", "evidence", "edges", "clusters", "embeddings")]).where(F.col("metric").isin(shown))


@query(
    _CANON
    + f", x AS (SELECT id, ca, ca IN {_KIDS} AND lower(value) IN (SELECT lower(value) FROM facts WHERE ca = 'total_revenue') AS bad FROM facts) SELECT id, ca AS canonical_attribute, CASE WHEN bad THEN 'FAIL' ELSE 'PASS' END AS integrity_status, "
    + "CASE WHEN bad THEN 'Synthetic child fact: child value matches a total_revenue value.' ELSE 'Stored fact matches original extraction.' END AS reason FROM x"
)
def integrity_status(spark, sf):
    return A.integrity(store(spark, sf).table("facts"))


@query(_CANON + "SELECT id FROM facts WHERE id NOT IN (SELECT fact_id FROM evidence WHERE source_document NOT LIKE 'orders%')")
def missing_evidence(spark, sf):
    """Facts that would be left without evidence if the documents of orders went."""
    s = store(spark, sf)
    return A.missing(s.table("facts"), s.table("evidence").where("source_document not like 'orders%'")).select("id")


@query(_CANON + "SELECT DISTINCT ca AS canonical_attribute FROM facts WHERE dim IN ('money', 'scaled')")
def mixed_dimension_attributes(spark, sf):
    """The layer's facts, and each with a ratio for its value as well."""
    f = store(spark, sf).table("facts")
    return A.mixed_dimensions(f.unionByName(f.withColumn("canonical_value", F.lit("7%")))).select("canonical_attribute")


_PART = "('0x' || substr(sha256(c), {0}, 8))::bigint"


@query(
    _CANON
    + EVERY
    + r""", told AS (SELECT id, concat_ws('|', ca, cv, coalesce(period, '')) AS m FROM facts),
keys AS (
  SELECT kind || '|' || lid || '|' || rid AS c FROM every WHERE kind <> 'COMPUTED_SUPPORT'
  UNION ALL SELECT 'COMPUTED_SUPPORT|' || t.id || '|' || array_to_string(list_sort([a.id, b.id]), '|') FROM sums s JOIN facts t ON t.id = s.lid JOIN facts a ON a.id = s.rid
    JOIN facts b ON b.ca = 'services_revenue' AND b.ee = t.ee AND coalesce(b.period, '') = coalesce(t.period, '')
), meanings AS (SELECT concat_ws('|', kind, l.m, r.m) AS c FROM every JOIN told l ON l.id = lid JOIN told r ON r.id = rid),
groups AS (SELECT ca, vk, coalesce(period, '') AS p, arg_min(cv, (entity, ca, value, id)) AS cv, list(id) AS ids FROM facts GROUP BY ALL),
kinds AS (SELECT concat_ws('|', g.ca, g.cv, g.p, count(DISTINCT e.source_document)::varchar) AS c FROM groups g JOIN evidence e ON list_contains(g.ids, e.fact_id) GROUP BY g.ca, g.vk, g.cv, g.p)
"""
    + " UNION ALL ".join(f"SELECT '{name}' AS part, count(*) AS n, sum({_PART.format(1)})::bigint AS a, sum({_PART.format(9)})::bigint AS b FROM {t}" for name, t in (("edges", "keys"), ("meanings", "meanings"), ("clusters", "kinds")))
)
def fingerprint(spark, sf):
    s = store(spark, sf)
    return A.fingerprint(s.table("facts"), s.table("edges"), s.table("clusters"))


@query(_CANON + "SELECT id, evidence_count FROM facts")
def stream_ingest(spark, sf):
    """Raw facts streamed file by file into a store of their own; the merged facts equal those of a batch load."""
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    s = FactStore(spark, f"{folder}/store")
    store(spark, sf).raw().repartition(3).write.parquet(f"{folder}/in")
    ingest(raw_stream(spark, f"{folder}/in", 1), s, f"{folder}/progress").awaitTermination()
    return s.complete("facts").table("facts").select("id", "evidence_count")


# ---------------------------------------------------------------- stores that grow


def _own_store(spark, sf, raw) -> FactStore:
    s = FactStore(spark, f"{work_folder(spark)}/{uuid.uuid4().hex}")
    s.append(raw)
    return s


@query(_CANON + EVERY + " SELECT 'fact' AS what, id, evidence_count AS n, round(confidence, 6) AS confidence FROM facts UNION ALL SELECT kind, lid || '|' || rid, 0, 0.0 FROM every WHERE kind <> 'COMPUTED_SUPPORT'")
def incremental_add(spark, sf):
    """A layer without the documents on people and boards, to which these are then added; facts and edges equal those of one load."""
    raw = store(spark, sf).raw()
    late = F.col("source_document").isin("people.pdf", "board.pdf", "notes.pdf")
    s = _own_store(spark, sf, raw.where(~late)).rebuild().add(raw.where(late))
    undirected = F.col("relationship_type").isin(R.UNDIRECTED)
    pair = F.concat_ws("|", F.when(undirected, F.col("pair_low")).otherwise(F.col("source_fact_id")), F.when(undirected, F.col("pair_high")).otherwise(F.col("target_fact_id")))
    edges = s.table("edges").where("relationship_type <> 'COMPUTED_SUPPORT'").select(F.col("relationship_type").alias("what"), pair.alias("id"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("confidence"))
    return s.table("facts").select(F.lit("fact").alias("what"), "id", F.col("evidence_count").alias("n"), F.round("confidence", 6).alias("confidence")).unionByName(edges)


@query(_CANON + "SELECT id, evidence_count FROM facts")
def stream_replay(spark, sf):
    """Every document comes twice, first with other values, and the second half of the stream is replayed under a new checkpoint; the facts equal
    those of one load."""
    raw, folder = store(spark, sf).raw(), f"{work_folder(spark)}/{uuid.uuid4().hex}"
    s = FactStore(spark, f"{folder}/store")
    by_document = lambda df: df.repartition(3, "source_document")  # noqa: E731  a document is in one file
    by_document(raw.withColumns({"value": F.concat(F.lit("9"), "value"), "page_number": F.col("page_number") + 1})).write.parquet(f"{folder}/in/round=1")
    run = lambda n, k: ingest(raw_stream(spark, f"{folder}/in/round={n}", 1), s, f"{folder}/progress-{k}", name=f"round {n}", replace_documents=True).awaitTermination()
    run(1, "a")
    by_document(raw).write.parquet(f"{folder}/in/round=2")
    run(2, "b")
    run(1, "c")  # a lost checkpoint: every batch comes again, with numbers that the store knows
    return s.complete("facts").table("facts").select("id", "evidence_count")


@query(_CANON + "SELECT fact_id, round(confidence, 6) AS confidence, evidence_count FROM strength")
def stream_confidence(spark, sf):
    """Claims streamed file by file through a state of evidence into a keyed table of facts; its last rows are the batch result."""
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    claims = evidence_of(store(spark, sf).table("claims"))
    claims.repartition(3).write.parquet(f"{folder}/in")
    found = KeyedTable(spark, f"{folder}/confidence", ["fact_id"])
    keep_confidences(spark, spark.readStream.schema(claims.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), found, f"{folder}/progress").awaitTermination()
    return found.read().select("fact_id", F.round("confidence", 6).alias("confidence"), "evidence_count")


@query("SELECT c_custkey, arg_max(o_totalprice, o_orderkey) AS last_price, max(o_orderkey) AS last_order FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 7 <> 3 OR o_orderkey % 2 = 1 GROUP BY c_custkey")
def keyed_upsert(spark, sf):
    """Orders upserted by customer in three steps; each customer's last order stays."""
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey")).where("o_orderkey % 7 <> 3 or o_orderkey % 2 = 1")
    rows = orders.select("c_custkey", F.col("o_totalprice").alias("last_price"), F.col("o_orderkey").alias("last_order"))
    t = KeyedTable(spark, f"{work_folder(spark)}/{uuid.uuid4().hex}", ["c_custkey"])
    low, high = rows.approxQuantile("last_order", [0.4, 0.8], 0.05)
    for step in (rows.where(F.col("last_order") <= low), rows.where((F.col("last_order") > low) & (F.col("last_order") <= high)), rows.where(F.col("last_order") > high)):
        t.upsert(step, F.col("last_order"))
    return t.read()


@query(_CANON + "SELECT id, CASE WHEN ca = 'account_balance' THEN row_number() OVER (PARTITION BY ca = 'account_balance' ORDER BY id) ELSE row_number() OVER (PARTITION BY ca = 'account_balance' ORDER BY id) + count(*) FILTER (WHERE ca = 'account_balance') OVER () END AS number FROM facts")
def gapless_ids(spark, sf):
    """Balances are numbered first; all other facts follow the largest stored number."""
    f, folder = store(spark, sf).table("facts").select("id", "canonical_attribute"), f"{work_folder(spark)}/{uuid.uuid4().hex}"
    stored = I.gapless(f.where("canonical_attribute = 'account_balance'"), ["id"], folder)
    rest = I.gapless(f.where("canonical_attribute <> 'account_balance'"), ["id"], folder, I.next_number(stored, "number"))
    return stored.unionByName(rest).select("id", "number")


@query("SELECT o_orderkey AS k, o_orderstatus AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS price, CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS seen FROM orders")
def table_versions(spark, sf):
    """A table that gains a column in its second version: rows of the first read as null there; the first version is read as it was."""
    o = table(spark, sf, "orders")
    t = KeyedTable(spark, f"{work_folder(spark)}/{uuid.uuid4().hex}", ["k"])
    first = t.append(o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status")))
    t.append(o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price")))
    old = t.read(first).select("k", F.lit(1).alias("_old"))
    return t.read().join(old, "k", "left").select("k", "status", "price", F.coalesce("_old", F.lit(2)).alias("seen"))


# ---------------------------------------------------------------- merges, answers, proposals, audits


_BALANCE = "CASE WHEN ca = 'account_balance' THEN min(id) OVER (PARTITION BY entity, ca) ELSE id END"


@query(
    _CANON
    + f", m AS (SELECT id AS old_id, {_BALANCE} AS keeper_id FROM facts), moved AS (SELECT keeper_id AS id, source_document, page_number, evidence_text, max(confidence) AS c FROM evidence JOIN m ON old_id = fact_id GROUP BY ALL) "
    + "SELECT id, round(1 - product(1 - c), 6) AS confidence, count(*) AS evidence_count FROM moved GROUP BY id"
)
def merge_by_mapping(spark, sf):
    """The balances of a customer become one fact, whatever their values; evidence moves along."""
    s = store(spark, sf)
    f, first = s.table("facts"), s.table("facts").where("canonical_attribute = 'account_balance'").groupBy("entity").agg(F.min("id").alias("_first"))
    keeper = F.when(F.col("canonical_attribute") == "account_balance", F.col("_first")).otherwise(F.col("id"))
    mapping = f.join(first, "entity", "left").select(F.col("id").alias("old_id"), keeper.alias("keeper_id"))
    facts, evidence, _ = O.apply_merge(f, s.table("evidence"), s.table("edges"), mapping)
    n = evidence.groupBy(F.col("fact_id").alias("id")).agg(F.count(F.lit(1)).alias("evidence_count"))
    return facts.drop("evidence_count").join(n, "id").select("id", F.round("confidence", 6).alias("confidence"), "evidence_count")


@query(_CANON + "SELECT fact_id AS id, round(1 - product(1 - confidence), 6) AS confidence FROM evidence GROUP BY fact_id HAVING count(*) FILTER (WHERE source_document <> 'notes.pdf') = 0 UNION ALL SELECT fact_id, round(1 - product(1 - confidence), 6) FROM evidence WHERE source_document <> 'notes.pdf' GROUP BY fact_id")
def direct_evidence_only(spark, sf):
    """Notes count as supporting evidence and go; facts with nothing else keep their confidence."""
    s = store(spark, sf)
    marked = s.table("evidence").withColumn("evidence_type", F.when(F.col("source_document") == "notes.pdf", "supporting").otherwise(F.col("evidence_type")))
    return L.only_direct_evidence(s.table("facts"), marked)[0].select("id", F.round("confidence", 6).alias("confidence"))


@query(_CANON + EVERY + ", ends AS (SELECT lid AS id FROM every UNION ALL SELECT rid FROM every), n AS (SELECT id, count(*) AS edges_found FROM ends GROUP BY id), e AS (SELECT fact_id AS id, count(*) AS evidence_found FROM evidence WHERE source_document <> 'notes.pdf' GROUP BY fact_id) SELECT f.id, f.evidence_count, coalesce(e.evidence_found, 0) AS evidence_found, coalesce(n.edges_found, 0) AS edges_found FROM facts f LEFT JOIN e USING (id) LEFT JOIN n USING (id) WHERE f.evidence_count <> coalesce(e.evidence_found, 0)")
def provenance_gaps(spark, sf):
    """Facts whose stored count is not what is left of the evidence without the notes."""
    s = store(spark, sf)
    return A.provenance_counts(s.table("facts"), s.table("evidence").where("source_document <> 'notes.pdf'"), s.table("edges"))


@query(
    _CANON
    + ", near AS (SELECT DISTINCT a.fact_id AS lid, b.fact_id AS rid FROM places a JOIN places b ON a.source_document = b.source_document AND abs(a.page_number - b.page_number) <= 5 AND a.fact_id <> b.fact_id) "
    + "SELECT n.lid AS l_id, n.rid AS r_id, CASE WHEN p.lid IS NOT NULL THEN 'PART_OF' ELSE c.kind END AS allowed FROM near n LEFT JOIN parts p ON p.lid = n.lid AND p.rid = n.rid LEFT JOIN crossed c ON c.lid = least(n.lid, n.rid) AND c.rid = greatest(n.lid, n.rid) WHERE p.lid IS NOT NULL OR c.kind IS NOT NULL"
)
def allowed_link_types(spark, sf):
    return N.allowed_types(store(spark, sf).table("features")).select("l_id", "r_id", F.array_join("allowed", ",").alias("allowed"))


@query(_CANON + "SELECT id, evidence_count FROM facts")
def legacy_load(spark, sf):
    """The raw claims as a table of the oldest form, one piece of evidence in each row, give the same facts."""
    old = store(spark, sf).raw().withColumnRenamed("ingest_ord", "ID").drop("evidence_type")
    return _own_store(spark, sf, L.legacy_claims(old)).complete("facts").table("facts").select("id", "evidence_count")


@query("WITH v AS (SELECT vec_id, list_transform(embedding[1:8], lambda x: x::double) AS e FROM embeddings) SELECT vec_id, 256 AS bytes, round(e[1] / sqrt(list_dot_product(e, e)), 4) AS first_entry, round(e[8] / sqrt(list_dot_product(e, e)), 4) AS last_entry FROM v")
def vector_blobs(spark, sf):
    """Vectors as blobs, and the first eight entries of the blobs as unit vectors."""
    v = table(spark, sf, "embeddings").select("vec_id", V.as_blob(F.col("embedding")).alias("blob"))
    head = v.select("vec_id", F.octet_length("blob").alias("bytes"), V.from_blob(F.col("blob"), 8).cast("array<double>").alias("head"))
    return head.select("vec_id", "bytes", F.round(F.get("head", F.lit(0)), 4).alias("first_entry"), F.round(F.get("head", F.lit(7)), 4).alias("last_entry"))


@query("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'seen; kept' WHEN 1 THEN c_mktsegment || '; seen' ELSE '' END AS reasons FROM customer")
def merged_reasons(spark, sf):
    """Reasons in order, without repeats, blanks and nulls."""
    none, segment = F.lit(None).cast("string"), F.col("c_mktsegment")
    forms = F.element_at(F.array(F.array(F.lit("seen"), F.lit(" "), F.lit("kept"), F.lit("seen")), F.array(segment, none, F.lit("seen"), segment), F.array(none, F.lit(""))), (F.col("c_custkey") % 3 + 1).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", merge_reasons(forms).alias("reasons"))


@query(
    _CANON
    + EVERY
    + f""", near AS (SELECT DISTINCT a.fact_id AS lid, b.fact_id AS rid FROM places a JOIN places b ON a.source_document = b.source_document AND abs(a.page_number - b.page_number) <= 5 AND a.fact_id <> b.fact_id)
SELECT lid AS source_fact_id, rid AS target_fact_id, l.ca || ' = ' || l.value AS source_fact, 'PART_OF' AS proposed_relationship, false AS accepted
FROM near JOIN facts l ON l.id = lid JOIN facts r ON r.id = rid WHERE r.ca IN {_KIDS} AND (l.ca = 'total_revenue' OR l.ca IN {_KIDS} AND l.ca <> r.ca)
UNION ALL SELECT lid, rid, {_STATEMENT.format('l')}, kind, true FROM every JOIN facts l ON l.id = lid"""
)
def proposal_log(spark, sf):
    """Rejected and accepted proposals."""
    s = store(spark, sf)
    return R.proposal_log(s.table("candidates"), s.table("edges"), s.table("facts")).select("source_fact_id", "target_fact_id", "source_fact", "proposed_relationship", "accepted")


_COMPARABLE = "CASE {0}.dim WHEN 'ratio' THEN {1}.dim = 'ratio' ELSE {1}.dim <> 'ratio' END"


@query(_CANON + f"SELECT l.dim AS l, r.dim AS r, {_COMPARABLE.format('l', 'r')} AS compatible, count(*) AS n FROM facts l JOIN facts r ON l.entity = r.entity AND l.id < r.id GROUP BY ALL")
def value_dimension_matrix(spark, sf):
    """Dimensions of the pairs of facts of one entity, and whether they can be compared."""
    f = store(spark, sf).table("facts").select("entity", "id", C.value_dimension(F.col("canonical_value"), F.col("unit")).alias("dim"))
    both = f.toDF("entity", "l_id", "l").join(f.toDF("entity", "r_id", "r"), "entity").where("l_id < r_id")
    return both.groupBy("l", "r", C.dimensions_compatible(F.col("l"), F.col("r")).alias("compatible")).agg(F.count(F.lit(1)).alias("n"))


_LEVEL = "ca IN ('total_revenue', 'product_revenue', 'services_revenue')"


@query(
    _CANON
    + EVERY
    + f""", f AS (
  SELECT count(*) AS facts, count(*) FILTER (WHERE ca = 'employee_count') AS employee_count_facts, count(*) FILTER (WHERE ca = 'employee_count' AND (contains(cv, '%') OR lower(coalesce(unit, '')) IN ('million', '%'))) AS employee_count_invalid,
    count(*) FILTER (WHERE {_LEVEL}) AS revenue_facts, count(*) FILTER (WHERE {_LEVEL} AND dim = 'ratio') AS revenue_facts_with_ratio_value, count(*) FILTER (WHERE regexp_matches(cv, '\b(INR|USD|EUR|GBP)\b.*(\b(INR|USD|EUR|GBP)\b|[₹$€£])')) AS currency_anomalies,
    count(DISTINCT ca) AS distinct_canonical_attributes, count(DISTINCT (ca, vk, coalesce(period, ''))) AS clusters, count(*) AS embeddings, 0::bigint AS facts_missing_evidence, 0::bigint AS facts_missing_embedding FROM facts
), e AS (
  SELECT count(*) AS relationships, count(*) FILTER (WHERE kind = 'CONTRADICTS') AS contradictions, count(*) FILTER (WHERE kind IN ('CONTRADICTS', 'CORROBORATES') AND (l.dim = 'ratio') <> (r.dim = 'ratio')) AS dimensional_mismatch_relationships,
    count(*) FILTER (WHERE kind IN ('CONTRADICTS', 'CORROBORATES') AND l.dim <> r.dim) AS dim_strictly_different_relationships FROM every JOIN facts l ON l.id = lid JOIN facts r ON r.id = rid
), v AS (SELECT count(*) AS evidence FROM evidence), mixed AS (SELECT ca FROM facts GROUP BY ca HAVING bool_or(dim = 'ratio') AND bool_or(dim IN ('money', 'scaled'))), m AS (SELECT count(*) AS mixed_dimension_attributes FROM mixed)
SELECT metric, value FROM (SELECT * FROM f, e, v, m) UNPIVOT (value FOR metric IN (facts, employee_count_facts, employee_count_invalid, revenue_facts, revenue_facts_with_ratio_value, currency_anomalies, distinct_canonical_attributes, clusters, embeddings,
  facts_missing_evidence, facts_missing_embedding, relationships, contradictions, dimensional_mismatch_relationships, dim_strictly_different_relationships, evidence, mixed_dimension_attributes))
UNION ALL SELECT 'mixed_dimension_attribute.' || ca, 1::bigint FROM mixed
UNION ALL SELECT 'relationships_by_type.' || t, (SELECT count(*) FROM every WHERE kind = t) FROM (VALUES ('SUPPORTS'), ('CORROBORATES'), ('CONTRADICTS'), ('RECONCILES'), ('TEMPORAL_SUCCESSOR'), ('PART_OF'), ('COMPUTED_SUPPORT'), ('UNRESOLVED_DIFFERENCE'), ('POTENTIAL_CONTRADICTION')) x(t)"""
)
def audit_all(spark, sf):
    s = store(spark, sf)
    return A.audit(*[s.table(t) for t in ("facts", "evidence", "edges", "clusters", "embeddings")])


def _flat(c: str) -> str:
    return f"lower(trim(regexp_replace({c}, '{_SPACE}+', ' ', 'g')))"


@query(
    f"""WITH s AS (
  SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN substr(text, 11, 60) WHEN 1 THEN substr(text, 1, 100) || ' @@ made up @@' WHEN 2 THEN '@@ nothing like this stands there @@' ELSE 'zz@' END AS raw FROM documents
), t AS (SELECT doc_id, {_flat('text')} AS body, {_stripped('raw')} AS s FROM s), a AS (
  SELECT doc_id, CASE WHEN s = '' THEN NULL WHEN contains(body, {_flat('s')}) THEN s WHEN length(s) < 12 THEN NULL WHEN contains(body, {_flat('substr(s, 1, 180)')}) THEN trim(substr(s, 1, 180))
    WHEN contains(body, {_flat('substr(s, 1, 80)')}) THEN trim(substr(s, 1, 80)) END AS evidence_text FROM t
) SELECT 'doc_' || doc_id AS source_document, evidence_text FROM a WHERE evidence_text IS NOT NULL"""
)
def answered_facts(spark, sf):
    """Facts of answers that quote a text as it is, with an invented ending, not at all, or too shortly."""
    quotes = F.element_at(F.array(F.substring("text", 11, 60), F.concat(F.substring("text", 1, 100), F.lit(" @@ made up @@")), F.lit("@@ nothing like this stands there @@"), F.lit("zz@")), (F.col("doc_id") % 4 + 1).cast("int"))
    item = F.struct(F.lit("Acme").alias("entity"), F.lit("revenue").alias("attribute"), F.lit("5").alias("value"), F.array(quotes).alias("evidence_snippets"))
    answer = F.concat(F.lit("Here: "), F.to_json(F.struct(F.array(item).alias("facts"))))
    rows = table(spark, sf, "documents").select(F.concat(F.lit("doc_"), "doc_id").alias("source_document"), F.lit(1).alias("page_number"), "text", answer.alias("answer"))
    return extract.facts_from_answers(rows).select("source_document", "evidence_text")
