"""Keyed tables, incremental merges and replayed batches."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from factloom.operators import audit, lookup
from factloom.store import RAW_SCHEMA, FactStore
from factloom.tables import KeyedTable


def folder():
    return f"file://{tempfile.mkdtemp()}/t"


def test_the_last_upsert_of_a_key_stays(spark):
    t = KeyedTable(spark, folder(), ["k"], 8)
    rows = lambda *r: spark.createDataFrame(list(r), "k string, n int")
    t.append(rows(*[(f"k{i}", i) for i in range(40)], (None, -1)))
    before = set(t.folders())
    t.upsert(rows(("k3", 100), (None, 7)))
    t.upsert(rows(("k3", 101), ("k3", 99), ("new", 1)), order=F.col("n"))
    got = {r.k: r.n for r in t.read().collect()}
    assert t.read().count() == 42 and got["k3"] == 101 and got[None] == 7 and got["new"] == 1 and got["k4"] == 4
    touched = {f"_bucket={r[0]}" for r in rows(("k3", 0), (None, 0), ("new", 0)).select(t.bucket_of(F.col("k"))).collect()}
    after = set(t.folders())
    assert {f for f in before if f.rsplit("/", 1)[1] not in touched} <= after  # untouched folders are the same ones
    assert all(f.rsplit("/", 1)[1] in touched for f in before - after)
    assert t.read(1).count() == 41 and {r.k: r.n for r in t.read(2).collect()}["k3"] == 100


def test_removed_keys_and_empty_buckets(spark):
    t = KeyedTable(spark, folder(), ["k"], 4)
    rows = spark.createDataFrame([(i, "x") for i in range(20)], "k long, v string")
    t.append(rows)
    t.replace_keys(rows.limit(0), rows.select("k"))
    assert t.read().count() == 0 and t.read(1).count() == 20
    t.replace_keys(rows.where("k < 3"))
    assert t.read().count() == 3
    with pytest.raises(ValueError):
        t.replace_buckets(rows, [0])


def test_columns_may_be_added(spark):
    t = KeyedTable(spark, folder(), ["k"], 2)
    t.append(spark.createDataFrame([(1, "a")], "k long, v string"))
    t.append(spark.createDataFrame([(2, "b", 0.5)], "k long, v string, w double"))
    assert sorted(map(tuple, t.read().collect())) == [(1, "a", None), (2, "b", 0.5)]
    assert t.read(1).columns == ["k", "v"]


def test_two_writers_of_one_version_collide(spark):
    path = folder()
    a, b = KeyedTable(spark, path, ["k"], 2), KeyedTable(spark, path, ["k"], 2)
    rows = spark.createDataFrame([(1,)], "k long")
    seen = b.manifest()
    a.append(rows)
    with pytest.raises(Exception, match="exist"):
        b._commit(seen, rows.schema, {})


def claims(spark, rows):
    """rows: order, entity, attribute, value, period, document, page, evidence"""
    return spark.createDataFrame([(i, e, a, v, None, p, 0.7, d, g, t, "DIRECT") for i, e, a, v, p, d, g, t in rows], RAW_SCHEMA)


COLUMNS = {
    "facts": ["id", "period", "evidence_count", "confidence"], "evidence": ["evidence_id", "confidence"], "edges": ["id", "confidence", "reasoning"], "clusters": ["id", "evidence_count"],
    "embeddings": ["fact_id", "text_hash"], "candidates": ["source_fact_id", "target_fact_id", "reason"], "features": ["id", "blob"],
}


def layer(store):
    shown = lambda r: tuple(f"{x:.9f}" if isinstance(x, float) else str(x) for x in r)
    return {name: sorted(map(shown, store.table(name).select(*columns).collect())) for name, columns in COLUMNS.items()}


def rebuilt(spark, rows):
    whole = FactStore(spark, folder())
    whole.append(claims(spark, rows))
    return layer(whole.rebuild())


OLD = [
    (1, "Acme 1", "CEO", "Anil Kapoor", None, "a.pdf", 1, "Anil Kapoor leads"), (2, "Acme 1", "CEO", "Meera Nair", None, "b.pdf", 1, "Meera Nair leads"),
    (3, "Acme 1", "total_revenue", "INR 100 crore", "FY2024", "a.pdf", 1, "had 100"), (4, "Acme 1", "product_revenue", "INR 60 crore", "FY2024", "a.pdf", 2, "products 60"),
    (5, "Acme 1", "services_revenue", "INR 40 crore", "FY2024", "a.pdf", 2, "services 40"), (6, "Bolt 2", "total_revenue", "INR 70 crore", None, "b.pdf", 1, "Bolt had 70"),
]


def test_added_and_replaced_claims_equal_a_rebuild(spark):
    """A new transition explains a disagreement of two old facts, a new period dates an old fact, a component changes a sum; then a
    document comes again without its component, and the sum and its parts go."""
    store = FactStore(spark, folder())
    store.append(claims(spark, OLD))
    store.rebuild()
    store.snapshot("first")
    first = layer(store)
    assert {r.relationship_type for r in store.table("edges").collect()} == {"POTENTIAL_CONTRADICTION", "PART_OF", "COMPUTED_SUPPORT"}
    new = [
        (7, "Acme 1", "board note", "Anil Kapoor stepped aside", None, "c.pdf", 1, "Anil Kapoor resigned from Acme 1"), (8, "Bolt 2", "total_revenue", "INR 70 crore", "FY2025", "c.pdf", 2, "Bolt again 70"),
        (9, "Acme 1", "total_revenue", "INR 100 crore", "FY2024", "d.pdf", 1, "100 again"),
    ]
    store.add(claims(spark, new))
    assert "RECONCILES" in {r.relationship_type for r in store.table("edges").collect()}
    again = [(20, "Acme 1", "total_revenue", "INR 100 crore", "FY2024", "a.pdf", 1, "had 100"), (21, "Acme 1", "product_revenue", "INR 60 crore", "FY2024", "a.pdf", 2, "products 60")]
    store.add(claims(spark, again), replace_documents=True)
    assert layer(store) == rebuilt(spark, [r for r in OLD + new if r[5] != "a.pdf"] + again)
    assert "COMPUTED_SUPPORT" not in {r.relationship_type for r in store.table("edges").collect()}
    assert layer(store.at("first")) == first  # an older version is read as it was


def test_adding_reads_few_bytes(spark):
    """One hundredth of the claims, all on some facts: under a twentieth of the claims' bytes is in buckets that are read."""
    rng = random.Random(4)
    base = [(i, f"Firm {i % 900}", "account balance", f"USD {1000 + i % 900}", None, f"doc{rng.randrange(50)}.pdf", 1, f"balance {i} {rng.random()}") for i in range(9000)]
    store = FactStore(spark, folder(), buckets=400)
    store.append(claims(spark, base))
    store.rebuild(link=False)
    delta = [(9000 + i, f"Firm {i % 9}", "account balance", f"USD {1000 + i % 9}", None, "new.pdf", 1, f"again {i}") for i in range(90)]
    table = store.tables["claims"]
    held, version = table.size(), table.latest()
    store.add(claims(spark, delta))
    added = {f for f in table.folders() if f not in set(table.folders(version))}
    touched = {int(f.rsplit("=", 1)[1]) for f in added}
    assert 1 <= len(touched) <= 9 and table.size(version, sorted(touched)) < 0.05 * held
    assert store.table("evidence").count() == 9090


def test_a_batch_counts_once(spark):
    store = FactStore(spark, folder())
    a, b = claims(spark, OLD[:3]), claims(spark, [(1, *OLD[0][1:5], "a.pdf", 9, "other page")])
    assert store.append_batch(a, "s", 0) and not store.append_batch(a, "s", 0)
    assert store.append_batch(a, "other", 0) and store.raw().count() == 6
    assert store.append_batch(b, "s", 1, replace_documents=True)
    assert sorted((r.source_document, r.page_number) for r in store.raw().collect()) == [("a.pdf", 9), ("b.pdf", 1), ("b.pdf", 1)]
    assert not FactStore(spark, store.path).append_batch(b, "s", 1)  # also after a restart


def test_vectors_of_two_models_lie_side_by_side(spark):
    store = FactStore(spark, folder())
    store.append(claims(spark, OLD))
    store.rebuild(link=False)
    some = store.table("facts").where("canonical_attribute = 'holder'").select(F.col("id").alias("fact_id"))
    plain = lambda df, i, t: df.select(i, F.array(F.length(t).cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    store.embed("lengths", plain, some)
    assert {(r.model, r.dim): r["count"] for r in store.table("embeddings").groupBy("model", "dim").count().collect()} == {("hash-384", 384): 6, ("lengths", 2): 2}
    before = set(store.tables["embeddings"].folders())
    store.embed("lengths", plain, some)  # nothing has changed
    assert set(store.tables["embeddings"].folders()) == before
    one = some.first().fact_id
    assert store.similar(one, 3, "lengths").count() == 1 and store.similar(one, 3).count() == 3
    assert lookup.fact_embedding(store.table("embeddings"), one).count() == 2
    store.rebuild(link=False)
    assert store.table("embeddings").count() == 8  # a rebuild keeps the other model's vectors


def test_audits_side_by_side(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "metric string, value long")
    got = audit.diff(rows(("facts", 3), ("old", 1)), rows(("facts", 5), ("new", 2)))
    assert sorted(tuple(r) for r in got.select("metric", "delta").collect()) == [("facts", 2), ("new", 2), ("old", -1)]
