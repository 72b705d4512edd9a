import json
import random
import tempfile
import urllib.error

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom import __main__ as command
from factloom import report
from factloom.operators import facts as facts_ops
from factloom.operators import links, lookup, relations, vectors
from factloom.sources import clients
from factloom.store import RAW_SCHEMA, FactStore


def claims(spark, rows):
    """rows: order, entity, attribute, value, period, document, page, evidence"""
    return spark.createDataFrame([(i, e, a, v, None, p, 0.7, d, g, t, "DIRECT") for i, e, a, v, p, d, g, t in rows], RAW_SCHEMA)


OLD = [
    (1, "Acme 1", "total_revenue", "INR 100 crore", "FY2024", "a.pdf", 1, "Acme had 100"), (2, "Acme 1", "product_revenue", "INR 60 crore", "FY2024", "a.pdf", 2, "products 60"),
    (3, "Bolt 2", "total_revenue", "INR 70 crore", "FY2024", "b.pdf", 1, "Bolt had 70"), (4, "Acme 1", "CEO", "Anil Kapoor", None, "a.pdf", 3, "Anil Kapoor leads"),
]
NEW = [
    (5, "Acme 1", "services_revenue", "INR 40 crore", "FY2024", "a.pdf", 2, "services 40"), (6, "Acme 1", "total_revenue", "INR 120 crore", "FY2024", "c.pdf", 1, "Acme had 120"),
    (7, "Acme 1", "total_revenue", "INR 100 crore", "FY2024", "c.pdf", 2, "Acme had 100 again"),
]


@pytest.fixture(scope="module")
def built(spark):
    store = FactStore(spark, f"file://{tempfile.mkdtemp()}/s")
    store.append(claims(spark, OLD))
    first = store.rebuild().version
    return store.add(claims(spark, NEW)), first


def test_added_claims_give_the_layer_of_a_rebuild(spark, built):
    store, _ = built
    whole = FactStore(spark, f"file://{tempfile.mkdtemp()}/s")
    whole.append(claims(spark, OLD + NEW))
    whole.rebuild()
    for name, columns in (("facts", ["id", "period", "evidence_count", "confidence"]), ("edges", ["id", "confidence", "reasoning"]), ("clusters", ["id", "evidence_count"]), ("embeddings", ["fact_id", "text_hash"])):
        assert sorted(store.table(name).select(*columns).collect()) == sorted(whole.table(name).select(*columns).collect()), name
    kinds = {r.relationship_type for r in store.table("edges").collect()}
    assert kinds == {"CONTRADICTS", "PART_OF", "COMPUTED_SUPPORT"}


def test_reads_of_one_fact(built):
    store, _ = built
    total = store.table("facts").where("value like '%100%' and canonical_attribute = 'total_revenue'").first()
    found = store.relationships(total.id).collect()
    assert {(r.relationship_type, r.direction) for r in found} == {("CONTRADICTS", "incoming"), ("PART_OF", "incoming"), ("COMPUTED_SUPPORT", "outgoing")} or {r.relationship_type for r in found} == {"CONTRADICTS", "PART_OF", "COMPUTED_SUPPORT"}
    assert all(total.id not in (r.related_fact_id,) and r.arrow == f"{r.source_statement} -> {r.target_statement}" for r in found)
    assert lookup.relationship(store.table("edges"), store.table("facts"), found[0].id).count() == 1
    near = store.similar(total.id, 3).collect()
    assert len(near) == 3 and [r.rank for r in near] == [1, 2, 3] and total.id not in {r.id for r in near} and near[0].embedding_text
    text = report.fact_detail(store.fact(total.id).drop("relationships").first(), found)
    assert "Acme had 100 again" in text and "Page 2" in text and "Components -> Total" in text and report.fact_detail(None) == "No such fact."
    assert report.provenance_graph(store.fact(total.id).first().asDict(True)).count("shape=note") == 2


def test_deleting_relationships_and_documents(spark, built):
    store, first = built
    edges = store.table("edges")
    assert lookup.without_relationships(edges).count() == 0
    one = edges.limit(1).select("id")
    assert lookup.without_relationships(edges, one).count() == edges.count() - 1
    other = FactStore(spark, f"file://{tempfile.mkdtemp()}/s")
    other.append(claims(spark, OLD))
    other.replace_document(claims(spark, [(9, "Bolt 2", "total_revenue", "INR 71 crore", "FY2024", "b.pdf", 1, "Bolt had 71")]), "b.pdf")
    assert sorted(r.value for r in other.raw().where("source_document = 'b.pdf'").collect()) == ["INR 71 crore"] and other.raw().count() == 4


def test_names_are_held_as_by_a_plain_search(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abc ") for _ in range(n)).strip() or "a"
    names, blobs = sorted({word(rng.randint(1, 6)) for _ in range(60)}), {f"f{i}": word(rng.randint(1, 40)) for i in range(30)}
    got = relations.holding(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(list(blobs.items()), "s_id string, s_blob string"))
    assert sorted(map(tuple, got.collect())) == sorted((n, i) for n in names for i, b in blobs.items() if n in b)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString().replace("BroadcastNestedLoopJoin BuildRight, Inner, (length", "")


def test_id_lists(spark):
    forms = {'["a", " ", "b"]': ["a", "b"], "a, b,,": ["a", "b"], "": [], " ": [], '{"a": 1}': [], "12": [], "12,13": ["12", "13"], '"x"': [], "null": [], "[1": ["[1"]}
    rows = spark.createDataFrame([(t,) for t in [*forms, None]], "t string").select("t", lookup.parse_id_list(F.col("t")).alias("ids")).collect()
    assert {r.t: r.ids for r in rows if r.t is not None} == forms and [r.ids for r in rows if r.t is None] == [[]]


def test_vectors_and_blobs(spark):
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, [1.0, 2.0, 2.0])], "i int, v array<float>")
    back = {r.i: r.w for r in rows.select("i", vectors.from_blob(vectors.as_blob(F.col("v")), 3).alias("w")).collect()}
    assert np.allclose(back[1], [0.6, 0.8, 0]) and np.allclose(back[2], 0) and np.allclose(back[3], [1 / 3, 2 / 3, 2 / 3])
    made = vectors.embed_with(spark.createDataFrame([(1, "aa"), (2, None)], "i int, t string"), "i", "t", lambda: lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert {r.i: list(r.embedding) for r in made.collect()} == {1: [2.0, 1.0], 2: [0.0, 1.0]}


def test_model_links_keep_to_allowed_types(built):
    store, _ = built
    f, facts = store.table("features"), store.table("facts")

    class Model:
        def complete(self, system, prompt):
            names = [line.split(":")[0].split()[1] for line in prompt.split("\n") if line.startswith("Candidate")]
            kinds = ["part of", "SUPPORTING", "nonsense"]
            return json.dumps({"links": [{"candidate_id": n, "relationship_type": k, "confidence": "7"} for n in [*names, "unknown"] for k in kinds]})

    found = links.classify_with_model(f, facts, Model).collect()
    allowed = {(r.l_id, r.r_id) for r in links.allowed_types(f).collect() if "PART_OF" in r.allowed}
    assert allowed and {(r.source_fact_id, r.target_fact_id) for r in found} == allowed and {(r.relationship_type, r.confidence) for r in found} == {("PART_OF", 1.0)}


def test_chat_client(monkeypatch):
    asked = []

    def post(self, body):
        asked.append(body)
        if "response_format" in body:
            raise urllib.error.HTTPError(self.url, 400, "bad", {}, __import__("io").BytesIO(b"response_format is unknown"))
        return {"choices": [{"message": {"content": "{}"}}]}

    monkeypatch.setattr(clients.ChatClient, "_post", post)
    for name in clients.KEY_NAMES + clients.MODEL_NAMES + clients.BASE_NAMES:
        monkeypatch.delenv(name, raising=False)
    with pytest.raises(ValueError):
        clients.client_factory()
    client = clients.client_factory(secrets={"LLM_API_KEY": "k", "LLM_MODEL": "m", "LLM_BASE_URL": "http://h/v1/"})()
    assert (client.complete("s", "u"), client.url, client.model, len(asked)) == ("{}", "http://h/v1/chat/completions", "m", 2)


def test_commands(spark, tmp_path, capsys):
    claims(spark, OLD[:2]).write.parquet(f"file://{tmp_path}/raw")
    assert command.main(["determinism", f"file://{tmp_path}/raw", f"file://{tmp_path}/s", "--runs", "2"], spark) == 0
    assert "DETERMINISTIC" in capsys.readouterr().out


def test_legacy_and_direct_only(spark, built):
    old = spark.createDataFrame([(2, "E", "a", "v", "d", 1, "text", 0.5)], "ID int, entity string, attribute string, value string, source_document string, page_number int, evidence_text string, confidence double")
    assert lookup.legacy_claims(old).first().ingest_ord == 2
    store, _ = built
    mixed = store.table("evidence").withColumn("evidence_type", F.when(F.col("page_number") == 1, "SUPPORTING").otherwise("DIRECT"))
    facts, left = lookup.only_direct_evidence(store.table("facts"), mixed)
    assert left.where("page_number = 1").count() == 0 and facts.count() == store.table("facts").count()


def test_tables_come_when_they_are_read(spark, built):
    whole, _ = built
    part = FactStore(spark, f"file://{tempfile.mkdtemp()}/s")
    part.append(whole.raw())
    part.on_demand = True
    assert set(part.manifest()["tables"]) == {"raw"}
    part.table("facts")
    assert set(part.manifest()["tables"]) == {"raw", "claims", "facts", "evidence"}
    part.table("candidates")
    assert not part.has("edges") and not part.has("clusters")
    part.complete()
    for name in ("claims", "facts", "evidence", "features", "clusters", "edges", "candidates", "embeddings"):
        a, b = (x.table(name).select(*sorted(c for c in x.table(name).columns)) for x in (part, whole))
        assert a.count() == b.count(), name
    assert part.table("edges").select("id").exceptAll(whole.table("edges").select("id")).count() == 0


def test_canonical_work_is_spread_whatever_the_files(spark):
    assert facts_ops.canonical(claims(spark, OLD).coalesce(1)).rdd.getNumPartitions() > 4
