import tempfile

from pyspark.sql import functions as F

from factloom.operators import audit as A
from factloom.operators import facts as O
from factloom.operators import relations as R
from factloom.store import RAW_SCHEMA


def layer(spark, rows):
    """rows: entity, attribute, value, period, document, page, evidence"""
    full = [(i, e, a, v, None, p, 0.7, d, g, t, "DIRECT") for i, (e, a, v, p, d, g, t) in enumerate(rows)]
    facts, evidence = O.merge_facts(spark.createDataFrame(full, RAW_SCHEMA))
    folder = f"file://{tempfile.mkdtemp()}"  # written, as a store does: later plans start at the tables
    for name, df in (("facts", facts), ("evidence", evidence)):
        df.write.parquet(f"{folder}/{name}")
    return tuple(spark.read.parquet(f"{folder}/{name}") for name in ("facts", "evidence"))


def kinds(spark, rows):
    return sorted((e.relationship_type, e.confidence) for e in R.link(*layer(spark, rows)).collect())


def revenue(value, period, entity="Revenue"):
    return (entity, "total_revenue", f"INR {value} crore", period, "d", 1, f"{entity} {value} {period}")


def case(name):
    """Rows of one entity of its own, so that all cases share one linking run."""
    r = lambda value, period: (name, "total_revenue", f"INR {value} crore", period, f"doc {name}", 1, f"{name} {value} {period}")
    said = lambda attribute, value, text, page: (name, attribute, value, None, f"doc {name}", page, text)
    return {
        "Near Co": [r(120, "FY2024"), r(123, "FY2024")],
        "Far Co": [r(120, "FY2024"), r(150, "FY2024")],
        "Later Co": [r(120, "FY2024"), r(150, "FY2025")],
        "Same Co": [r(120, "FY2024"), r(120, "FY2025")],
        "Ratio Co": [said("operating_margin", "15%", "a", 1), said("operating_margin", "18%", "b", 2)],
        "Mixed Co": [said("margin level", "INR 120 crore", "a", 1), said("margin level", "15%", "b", 2)],
        "Board Co": [said("CEO", "Rohit Sharma", "leads", 1), said("CEO", "Priya Mehta", "leads too", 2)],
        "Moved Co": [said("CEO", "Anil Kapoor", "Anil Kapoor resigned", 1), said("CEO", "Meera Nair", "leads", 2)],
    }[name]


EXPECTED = {
    "Near Co": [("CORROBORATES", 0.84)],
    "Far Co": [("CONTRADICTS", 0.9)],
    "Later Co": [("UNRESOLVED_DIFFERENCE", 0.7)],
    "Same Co": [("CORROBORATES", 0.9)],
    "Ratio Co": [("UNRESOLVED_DIFFERENCE", 0.7)],
    "Mixed Co": [],
    "Board Co": [("POTENTIAL_CONTRADICTION", 0.7)],
    "Moved Co": [("RECONCILES", 0.86)],
}


def test_pairs(spark):
    rows = [x for name in EXPECTED for x in case(name)]
    # person names as entities would be read as values, so holders' companies carry a digit
    rows = [(e.replace(" Co", " 1") if a == "CEO" else e, a, *rest) for e, a, *rest in rows]
    facts, evidence = layer(spark, rows)
    view = facts.select(F.col("id").alias("source_fact_id"), F.replace(F.col("original_entity"), F.lit(" 1"), F.lit(" Co")).alias("name"))
    got: dict[str, list] = {name: [] for name in EXPECTED}
    for e in R.link(facts, evidence).join(view, "source_fact_id").collect():
        got[e.name].append((e.relationship_type, e.confidence))
    assert got == EXPECTED


def test_qualified_entities_do_not_meet(spark):
    assert kinds(spark, [revenue(120, "FY2024", "Annual Revenue"), revenue(150, "FY2024")]) == []


def components(page=3, entity="Revenue"):
    return [
        (entity, "Product Revenue", "INR 90 crore", "FY2024", "d", 1, "p"),
        (entity, "Services Revenue", "INR 30 crore", "FY2024", "d", 2, "s"),
        ("Revenue", "Total revenue", "INR 120 crore", "FY2024", "d", page, "t"),
    ]


def test_parts_and_sum(spark):
    edges = R.link(*layer(spark, components())).collect()
    assert sorted((e.relationship_type, e.confidence) for e in edges) == [("COMPUTED_SUPPORT", 0.95), ("PART_OF", 0.92), ("PART_OF", 0.92)]
    assert [e.reasoning for e in edges if e.relationship_type == "COMPUTED_SUPPORT"] == ["90 + 30 = 120"]


def test_parts_need_a_near_page(spark):
    assert [k for k, _ in kinds(spark, components(page=8))] == ["COMPUTED_SUPPORT"]


def test_sum_needs_one_entity(spark):
    rows = components()
    rows[0] = ("Software Products", *rows[0][1:])
    rows[1] = ("Consulting", *rows[1][1:])
    assert sorted({k for k, _ in kinds(spark, rows)}) == ["PART_OF"]


def test_subset_search(spark):
    rows = [([90.0, 30.0, 500.0], 120.0), ([1.0, 2.0, 3.0], 6.0), ([5.0], 5.0), ([10.0, 20.0], 100.0), ([1.0] * 17, 2.0)]
    got = spark.createDataFrame(rows, "a array<double>, t double").select(R.summing_subset("a", "t").alias("s")).collect()
    assert [r.s for r in got] == [[0, 1], [0, 1, 2], None, None, None]


def edge(kind, s, t, c, reason):
    return (s, t, kind, c, reason, [s], [], [])


EDGE = "source_fact_id string, target_fact_id string, relationship_type string, confidence double, reasoning string, supporting_fact_ids array<string>, supporting_evidence_ids array<string>, component_ids array<string>"


def test_dedupe_is_undirected_where_it_should_be(spark):
    rows = [edge("CORROBORATES", "a", "b", 0.8, "x"), edge("CORROBORATES", "b", "a", 0.9, "y"), edge("PART_OF", "a", "b", 0.8, "x"), edge("PART_OF", "b", "a", 0.8, "x"), edge("PART_OF", "a", "a", 0.8, "x")]
    got = R.dedupe(spark.createDataFrame(rows, EDGE)).orderBy("relationship_type", "pair_low").collect()
    assert [(r.relationship_type, r.pair_low, r.pair_high, r.confidence, r.reasoning) for r in got] == [("CORROBORATES", "a", "b", 0.9, "y; x"), ("PART_OF", "a", "b", 0.8, "x"), ("PART_OF", "b", "a", 0.8, "x")]
    assert A.duplicate_edges(R.dedupe(spark.createDataFrame(rows, EDGE))).count() == 0


def test_type_names(spark):
    got = spark.createDataFrame([("component",), ("part of",), ("nothing",)], "t string").select(R.relationship_type(F.col("t")).alias("t")).collect()
    assert [r.t for r in got] == ["PART_OF", "PART_OF", None]


def test_validation_rejects(spark):
    facts, evidence = layer(spark, [revenue(120, "FY2024"), revenue(150, "FY2025")])
    a, b = [r.id for r in facts.orderBy("value").collect()]
    rows = [edge("CONTRADICTS", a, b, 0.9, ""), edge("PART_OF", a, b, 0.9, ""), edge("CORROBORATES", a, "gone", 0.9, ""), edge("COMPUTED_SUPPORT", a, b, 0.9, "")]
    got = {r.relationship_type: r.ok for r in R.validate(spark.createDataFrame(rows, EDGE), R.features(facts, evidence)).collect()}
    assert got == {"CONTRADICTS": False, "PART_OF": False, "CORROBORATES": False, "COMPUTED_SUPPORT": True}


def test_every_link_is_valid_and_order_does_not_matter(spark, tmp_path):
    rows = [*components(), revenue(150, "FY2025"), revenue(151, "FY2025")]
    facts, evidence = layer(spark, rows)
    edges = R.link(facts, evidence)
    assert A.self_links(edges).count() == 0
    assert R.validate(edges, R.features(facts, evidence)).where("not ok").count() == 0
    edges.write.parquet(f"file://{tmp_path}/edges")
    edges = spark.read.parquet(f"file://{tmp_path}/edges")
    again = R.link(facts.repartition(3), evidence.repartition(2))
    clusters = O.clusters(facts, evidence)
    assert A.fingerprint(facts, edges, clusters).exceptAll(A.fingerprint(facts, again, clusters)).count() == 0
    assert A.provenance_counts(facts, evidence, edges).count() == 0
    assert {r.integrity_status for r in A.integrity(facts).collect()} == {"PASS"}
    assert R.edge_view(edges, facts).count() == edges.count()
