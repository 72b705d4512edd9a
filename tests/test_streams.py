"""Stateful confidences, the ledger of model calls, gapless numbers, block-wise neighbours and the splitter in SQL."""

import json
import random
import tempfile
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factloom.operators import ids, vectors
from factloom.sources import chunks
from factloom.sources.ledger import Ledger
from factloom.streaming import confidence
from factloom.streaming.confidence import keep_confidences
from factloom.tables import KeyedTable


def folder():
    return f"file://{tempfile.mkdtemp()}"


def test_state_holds_first_claims_of_evidence(spark):
    """Repeated evidence counts once, with the confidence of its lowest order, whenever that comes; a certain piece may lose its certainty."""
    kind = "fact_id string, evidence_id string, ingest_ord long, confidence double"
    steps = [
        [("f", "e1", 5, 1.0), ("f", "e2", 6, 0.5), ("g", "e3", 7, 1.0)],
        [("f", "e1", 2, 0.4), ("f", "e2", 9, 0.99), ("h", "e4", 1, 0.0)],
        [("f", "e5", 3, 0.2), ("g", "e6", 1, 0.3)],
    ]
    at, progress = folder(), folder()
    t = KeyedTable(spark, f"{at}/t", ["fact_id"], 4)
    for k, rows in enumerate(steps):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{at}/in")
        keep_confidences(spark, spark.readStream.schema(kind).parquet(f"{at}/in"), t, progress).awaitTermination()
        if k == 0:
            assert {r.fact_id: (r.confidence, r.evidence_count) for r in t.read().collect()} == {"f": (1.0, 2), "g": (1.0, 1)}
    got = {r.fact_id: (round(r.confidence, 9), r.evidence_count) for r in t.read().collect()}
    assert got == {"f": (round(1 - 0.6 * 0.5 * 0.8, 9), 3), "g": (1.0, 2), "h": (0.0, 1)}


CLAIM = "fact_id string, evidence_id string, ingest_ord long, confidence double"


def test_confidences_need_no_python_in_tasks(spark):
    """A state per fact in Python took 7.5 ms of CPU a claim; the state is files now, and what a batch does to it is all native."""
    plan = confidence.confidences(spark.createDataFrame([("f", "e", 1, 0.5)], CLAIM))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "PySpark", "Pandas", "Arrow"))
    at = folder()
    rows = spark.range(40_000).select(F.concat(F.lit("f"), F.col("id") % 30_000).alias("fact_id"), F.concat(F.lit("e"), "id").alias("evidence_id"), F.col("id").alias("ingest_ord"), F.lit(0.5).alias("confidence"))
    rows.repartition(2).write.parquet(f"{at}/in")
    t = KeyedTable(spark, f"{at}/t", ["fact_id"], 4)
    query = keep_confidences(spark, spark.readStream.schema(CLAIM).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"), t, f"{at}/progress")
    query.awaitTermination()
    assert len(query.recentProgress) == 2 and not any(p["stateOperators"] for p in query.recentProgress)
    assert {tuple(r) for r in t.read().groupBy("confidence", "evidence_count").count().collect()} == {(0.5, 1, 20_000), (0.75, 2, 10_000)}


def test_replayed_batches_and_gathered_commits_change_nothing(spark, monkeypatch):
    """Batch after batch, the last of them twice, with null ids and a fact of many pieces; evidence of few commits."""
    monkeypatch.setattr(confidence, "COMMITS", 1)
    rng, at = random.Random(4), folder()
    rows = [(rng.choice([None, "f", "f", "g", "h"]), f"e{rng.randrange(60)}", k, rng.random()) for k in rng.sample(range(600), 600)]
    t = KeyedTable(spark, f"{at}/t", ["fact_id"], 2)
    run = lambda progress: keep_confidences(spark, spark.readStream.schema(CLAIM).parquet(f"{at}/in"), t, f"{at}/{progress}").awaitTermination()

    def check(upto):
        first, expected = {}, {}
        for f, e, k, c in sorted(rows[:upto], key=lambda r: r[2]):
            first.setdefault((f, e), c)
        for (f, _), c in first.items():
            rest, n = expected.get(f, (1.0, 0))
            expected[f] = (rest * (1 - c), n + 1)
        assert {r.fact_id: (round(r.confidence, 9), r.evidence_count) for r in t.read().collect()} == {f: (round(1 - rest, 9), n) for f, (rest, n) in expected.items()}

    for k in range(4):
        spark.createDataFrame(rows[150 * k : 150 * (k + 1)], CLAIM).coalesce(1).write.mode("append").parquet(f"{at}/in")
        run("progress")
        check(150 * (k + 1))
    seen = KeyedTable(spark, f"{at}/progress/evidence", ["fact_id"], 2)
    assert max(len(c) for c in seen.manifest()["live"].values()) == 2
    done = Path(at.removeprefix("file://")) / "progress/commits"
    for name in ("3", ".3.crc"):  # as after a failure between the batch and its commit
        (done / name).unlink(missing_ok=True)
    run("progress")
    check(600)
    run("elsewhere")  # a lost checkpoint: everything comes again
    check(600)


def test_progress_without_evidence_is_refused(spark):
    at = folder()
    spark.createDataFrame([("f", "e", 1, 0.5)], CLAIM).write.parquet(f"{at}/in")
    stream, t = spark.readStream.schema(CLAIM).parquet(f"{at}/in"), KeyedTable(spark, f"{at}/t", ["fact_id"], 2)
    stream.writeStream.foreachBatch(lambda batch, _: None).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).start().awaitTermination()
    with pytest.raises(ValueError, match="new checkpoint"):
        keep_confidences(spark, stream, t, f"{at}/progress")


class Counting:
    """Notes every call in a shared folder; its fifth call of the first run dies."""

    def __init__(self, notes: str, dies: bool):
        self.notes, self.dies = Path(notes), dies

    def complete(self, system_prompt, prompt):
        if self.dies and len(list(self.notes.iterdir())) >= 4:
            raise ConnectionError("gone")
        (self.notes / f"{random.random()}").write_text(prompt)
        return json.dumps({"said": prompt})


def test_answered_requests_are_not_asked_again(spark, monkeypatch):
    from factloom.sources import ledger as L

    monkeypatch.setattr(L, "FIRST_WAIT", 0.01)
    monkeypatch.setattr(L, "TRIES", 2)
    notes, book = tempfile.mkdtemp(), Ledger(spark, f"{folder()}/l", "m1")
    requests = spark.createDataFrame([(k, f"prompt {k % 9}") for k in range(12)] + [(99, None)], "k long, prompt string").coalesce(1)
    with pytest.raises(Exception, match="gone"):
        book.answer(requests, "prompt", lambda: Counting(notes, True), "s").collect()
    assert len(list(Path(notes).iterdir())) == 4
    got = book.answer(requests, "prompt", lambda: Counting(notes, False), "s")
    assert {r.k: json.loads(r.answer)["said"] for r in got.collect()} == {**{k: f"prompt {k % 9}" for k in range(12)}, 99: ""}
    asked = [p.read_text() for p in Path(notes).iterdir()]
    assert len(asked) == len(set(asked)) == 10  # nothing twice
    more = requests.unionByName(spark.createDataFrame([(100, "new")], "k long, prompt string"))
    assert book.answer(more, "prompt", lambda: Counting(notes, False), "s").count() == 14 and len(list(Path(notes).iterdir())) == 11
    assert Ledger(spark, book.path, "m2").request_id("s", F.lit("x")) is not None and book.known().count() == 11


def test_numbers_are_gapless_and_follow_the_stored(spark):
    rows = spark.range(5000, numPartitions=7).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), F.lit(1).alias("_range"))
    for _ in range(2):
        got = ids.gapless(rows, ["k"], folder(), start=11)
        assert got.columns == ["k", "_range", "number"]
        assert [r.number for r in got.orderBy("k").collect()] == list(range(11, 5011))
    assert ids.next_number(got, "number") == 5011 and ids.next_number(got.limit(0), "number") == 1
    assert ids.gapless(rows.limit(0), ["k"], folder()).count() == 0


@pytest.mark.parametrize("kind", ["long", "string"])
def test_neighbours_by_blocks(spark, kind, monkeypatch):
    """Several blocks of queries and vectors, ties, a repeated vector and a null one: the rows of one whole product."""
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 40)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 64)
    rng = np.random.default_rng(0)
    m = rng.integers(-2, 3, (230, 6)).astype(np.float32)
    m[100:130] = m[3]
    name = (lambda k: int(k)) if kind == "long" else (lambda k: f"id{k}")
    df = spark.createDataFrame([(name(k), [float(c) for c in v]) for k, v in enumerate(m)] + [(name(999), None)], f"vec_id {kind}, embedding array<float>").repartition(5)
    got = {(r.query_id, r["rank"]): (r.id, round(r.similarity, 9)) for r in vectors.nearest(df, df, k=4).collect()}
    unit = m.astype(float) / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-300)
    s = np.round(unit @ unit.T, 9)
    expected = {}
    for q in range(230):
        order = sorted((k for k in range(230) if k != q), key=lambda k: (-s[q, k], name(k)))[:4]
        expected |= {(name(q), n + 1): (name(k), round(s[q, k], 9) + 0.0) for n, k in enumerate(order)}
    assert got == expected
    assert vectors.nearest(df, df.limit(0)).count() == 0


def test_similarities_held_at_once_are_bounded():
    m = np.random.default_rng(1).normal(size=(10_000, 8)).astype(np.float32)

    def block(side, rows):
        same = pa.array(np.zeros(len(rows), np.int32))
        return pa.RecordBatch.from_arrays([same, same, pa.array(np.full(len(rows), side, np.int32)), pa.array(np.arange(len(rows))), pa.array(list(rows), pa.list_(pa.float32()))], ["g", "p", "side", "id", "embedding"])

    cells = [block(0, m[:1024]), block(1, m)]
    tracemalloc.start()
    rows = sum(b.num_rows for b in vectors._best(5)(iter(cells)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 5 * 1024 and most < 60e6  # all similarities of the block alone were 82 MB, held three times


def test_splitter_in_sql(spark):
    chunks.register_split_text(spark)
    rows = [("a", "b" * 4000), ("b", None), ("c", " \n "), ("d", "x" * 1200 + ". " + "y" * 1000)]
    spark.createDataFrame(rows, "d string, t string").createOrReplaceTempView("split_pages")
    got = spark.sql("SELECT d, c.chunk_index, c.text FROM split_pages, LATERAL split_text(t, 1800, 200) c ORDER BY d, chunk_index").collect()
    assert [(r.d, r.chunk_index, r.text) for r in got] == [(d, k, piece) for d, t in rows for k, piece in enumerate(chunks.cut(chunks.normalise_page(t or "")))]
    assert len(got) == 5
    spark.catalog.dropTempView("split_pages")
