import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import vectors as V
from factloom.sources import chunks as K
from factloom.sources import extract as E


def test_cutting():
    assert K.cut("a" * 1800) == ["a" * 1800]
    assert [len(x) for x in K.cut("a" * 4000)] == [1800, 1800, 800]
    assert K.cut("") == [] and K.cut("   ") == []
    text = "x" * 1200 + ". " + "y" * 1000
    assert K.cut(text)[0] == "x" * 1200 + "."


def test_chunk_index_counts_through_the_document(spark):
    pages = spark.createDataFrame([("d", 2, "b" * 2000), ("d", 1, "a"), ("d", 3, " \n "), ("e", 1, None)], "source_document string, page_number int, text string")
    got = K.chunk_pages(pages).orderBy("source_document", "chunk_index").collect()
    assert [(r.page_number, r.chunk_index, len(r.text)) for r in got] == [(1, 0, 1), (2, 1, 1800), (2, 2, 400)]
    with pytest.raises(ValueError):
        K.chunk_pages(pages, 10, 10)


def test_reading_pages(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\n\n\n\n  two \fthree")
    got = K.read_pages(spark, f"file://{tmp_path}", lambda b: b.decode().split("\f")).orderBy("page_number").collect()
    assert [(r.source_document, r.page_number, r.text) for r in got] == [("a.txt", 1, "one\n\ntwo"), ("a.txt", 2, "three")]


@pytest.mark.parametrize("snippet, aligned", [("Total  REVENUE", "Total  REVENUE"), ("nowhere", None), ("", None), ("x" * 180 + "y" * 20, "x" * 180), ("x" * 80 + "z" * 120, "x" * 80), ("entirely missing text", None)])
def test_alignment(spark, snippet, aligned):
    source = "The total\nrevenue rose. " + "x" * 190
    assert spark.createDataFrame([(snippet, source)], "s string, t string").select(E.align(F.col("s"), F.col("t")).alias("a")).collect()[0].a == aligned


class Stub:
    def complete(self, system_prompt, user_prompt):
        item = {"entity": "Acme", "attribute": "revenue", "value": "5", "unit": "n/a", "confidence": 7, "evidence_snippets": ["revenue was 5", "Revenue was 5", "made up by the model"]}
        return "Sure:\n```json\n" + json.dumps({"facts": [item, {"entity": "", "attribute": "x", "value": "1", "evidence_text": "revenue was 5"}]}) + "\n```"


def test_extraction(spark):
    c = spark.createDataFrame([("d", 1, "In 2024 revenue was 5 million.", 0)], "source_document string, page_number int, text string, chunk_index int")
    got = E.facts_from_answers(E.answers(c, Stub)).collect()
    assert [(r.entity, r.value, r.unit, r.confidence) for r in got] == [("Acme", "5", None, 1.0)]
    assert E.merge_extracted(E.facts_from_answers(E.answers(c, Stub))).collect()[0].confidence == 1.0


@pytest.mark.parametrize("raw", ["no json", None, "{broken", '{"facts": []}'])
def test_answers_without_facts(spark, raw):
    assert E.parse_answers(spark.createDataFrame([(1, raw)], "i int, answer string")).count() == 0


def test_embeddings_and_neighbours(spark):
    d = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, "gamma"), (4, "")], "vec_id long, text string")
    v = V.hash_embed(d, "vec_id", "text").cache()
    rows = {r.vec_id: r.embedding for r in v.collect()}
    assert all(len(x) == V.DIM for x in rows.values()) and rows[1] == rows[2] and sum(rows[4]) == 0
    assert abs(sum(x * x for x in rows[1]) - 1) < 1e-5
    best = V.nearest(v, v.where("vec_id = 1"), k=1).collect()[0]
    assert best.id == 2 and abs(best.similarity - 1) < 1e-6


def test_unchanged_embeddings_stay(spark):
    f = spark.createDataFrame([("a", "E", "x", "1", None), ("b", "E", "x", "2", None)], "id string, canonical_entity string, canonical_attribute string, canonical_value string, period string")
    first = V.embed_facts(f).cache()
    changed = f.withColumn("canonical_value", F.when(F.col("id") == "b", "3").otherwise(F.col("canonical_value")))
    second = V.embed_facts(changed, first).cache()
    a, b = ({r.fact_id: r.text_hash for r in x.collect()} for x in (first, second))
    assert a["a"] == b["a"] and a["b"] != b["b"] and len(b) == 2
