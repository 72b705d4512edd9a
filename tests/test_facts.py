import itertools

import pytest
from pyspark.sql import functions as F

from factloom.operators import facts as O
from factloom.store import RAW_SCHEMA, FactStore


def raw(spark, rows):
    """rows: entity, attribute, value, period, confidence, document, page"""
    full = [(i, e, a, v, None, p, float(c), d, g, f"{e} {v} {d} {g}", "DIRECT") for i, (e, a, v, p, c, d, g) in enumerate(rows)]
    return spark.createDataFrame(full, RAW_SCHEMA)


def test_two_surfaces_one_fact(spark):
    facts, evidence = O.merge_facts(raw(spark, [("Revenue", "total_revenue", "₹120 crore", "FY2024", 0.9, "A", 1), ("Annual Revenue", "Annual Revenue", "INR 120 crore", "FY2024", 0.8, "B", 3)]))
    f = facts.collect()
    assert len(f) == 1 and evidence.count() == 2 and f[0].evidence_count == 2 and abs(f[0].confidence - 0.98) < 1e-12
    assert f[0].original_entity == "Revenue"


def fold(periods):
    """The merging rules applied one row at a time."""
    facts: list[str | None] = []
    for p in periods:
        same = next((i for i, q in enumerate(facts) if q == p), None)
        if same is None:
            open_ = next((i for i, q in enumerate(facts) if p is None or q is None or q == p), None)
            if open_ is None:
                facts.append(p)
            else:
                facts[open_] = facts[open_] or p
    return sorted(x or "" for x in facts)


@pytest.mark.parametrize("length", [2, 3, 4])
def test_merge_order_closed_form(spark, length):
    sequences = list(itertools.product([None, "FY2024", "FY2025"], repeat=length))
    rows = [(f"E{k}", "balance", "120", p, 0.5, f"d{i}", 1) for k, s in enumerate(sequences) for i, p in enumerate(s)]
    facts, _ = O.merge_facts(raw(spark, rows))
    got = {r.entity: sorted(x or "" for x in r.p) for r in facts.groupBy("entity").agg(F.collect_list(F.coalesce("period", F.lit(""))).alias("p")).collect()}
    assert got == {f"E{k}": fold(s) for k, s in enumerate(sequences)}


def test_repeated_evidence_counts_once_and_zero_confidence_is_absent(spark):
    _, evidence = O.merge_facts(raw(spark, [("A", "balance", "5", None, 0.0, "d", 1), ("A", "balance", "5", None, 0.9, "d", 1)]))
    assert [r.confidence for r in evidence.collect()] == [0.5]


def stored(spark, periods):
    ids = [f"f{i}" for i in range(len(periods))]
    facts = spark.createDataFrame([(i, "e", "a", "v", p, k, 0.5) for k, (i, p) in enumerate(zip(ids, periods, strict=True))], "id string, eq_entity string, eq_attribute string, eq_value string, period string, ingest_ord long, confidence double")
    evidence = spark.createDataFrame([(i, f"d{k}", 1, "t", "DIRECT", 0.5, k) for k, i in enumerate(ids)], "fact_id string, source_document string, page_number int, evidence_text string, evidence_type string, confidence double, ingest_ord long")
    return facts, evidence


def test_stored_facts_of_several_periods_keep_the_undated_apart(spark):
    facts, evidence = stored(spark, [None, "FY2024", "FY2025", "FY2024"])
    assert {tuple(r) for r in O.dedup_stored(facts, evidence).collect()} == {("f0", "f0"), ("f1", "f1"), ("f2", "f2"), ("f3", "f1")}


def test_stored_facts_of_one_period_merge_into_the_dated(spark):
    facts, evidence = stored(spark, [None, "FY2024"])
    mapping = O.dedup_stored(facts, evidence)
    assert {r.keeper_id for r in mapping.collect()} == {"f1"}
    edges = spark.createDataFrame([("f0", "f1"), ("f0", "x")], "source_fact_id string, target_fact_id string")
    f, e, d = O.apply_merge(facts, evidence, edges, mapping)
    assert [r.id for r in f.collect()] == ["f1"] and e.count() == 2 and [tuple(r) for r in d.collect()] == [("f1", "x")]
    assert abs(f.collect()[0].confidence - 0.75) < 1e-12


def test_store_search_detail_replace_and_delete(spark, tmp_path):
    rows = [("Revenue", "total_revenue", "INR 120 crore", "FY2024", 0.9, "A", 1), ("Revenue", "total_revenue", "INR 150 crore", "FY2024", 0.8, "B", 1), ("Acme", "balance", "5", None, 0.5, "A", 2)]
    store = FactStore(spark, f"file://{tmp_path}/s")
    with pytest.raises(ValueError):
        store.table("facts")
    store.append(raw(spark, rows))
    store.rebuild()
    assert store.search("crore").count() == 2 and store.search("", "B").count() == 1 and store.search("CR_RE").count() == 2
    edge = store.table("edges").collect()
    assert [(e.relationship_type, e.confidence) for e in edge] == [("CONTRADICTS", 0.9)]
    detail = store.fact(edge[0].source_fact_id).collect()[0]
    assert len(detail.evidence) == 1 and len(detail.relationships) == 1
    f, e, d = O.delete_document(store.table("facts"), store.table("evidence"), store.table("edges"), "B")
    assert f.count() == 2 and e.count() == 2 and d.count() == 0
    store.replace_document(raw(spark, [("Revenue", "total_revenue", "INR 120 crore", "FY2024", 0.5, "B", 9)]), "B")
    store.rebuild()
    assert store.table("facts").where("evidence_count = 2").count() == 1
    assert set(store.timings.stages) >= {"facts", "evidence", "edges", "clusters"} and "facts" in store.timings.render()
    store.snapshot("named")
    assert store.at("named").table("facts").count() == store.table("facts").count()
    store.clear()
    assert store.raw().count() == 0
