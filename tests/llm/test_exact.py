"""Exact deduplication against a plain version: copies, collisions, nulls, repeated rows, hot groups, odd columns."""

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from factloom.llm import exact

from .conftest import DOCS, texts


def plain(rows, keep):
    """(id, text) rows to the sorted decisions."""
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        stays = (max if keep == "largest" else min)(known) if known else None
        seen = False
        for i in ids:
            first = i == stays and not seen
            seen = seen or first
            out.append((i, stays, len(ids), first, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.id, r.keep_id, r.n, r.kept, bytes(r.sha).hex()) for r in df.collect()), key=str)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
@pytest.mark.parametrize("weak", [False, True])
def test_equals_plain(spark, docs, keep, weak):
    """``weak``: a hash of 16 values, so that most hashes hold several texts."""
    hash_of = (lambda t: F.unhex(F.concat(F.lit("0"), F.substring(F.md5(t), 1, 1)))) if weak else exact.content_hash
    assert shown(exact.decisions(docs, keep=keep, hash_of=hash_of)) == plain(texts().items(), keep)


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_null_ids_and_repeated_rows(spark, odd, keep):
    rows = [(r.doc_id, r.text) for r in odd.collect()] + [(None, None), (None, ""), (4, "x"), (4, "x"), (4, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert shown(exact.decisions(df, keep=keep)) == plain(rows, keep)
    kept = exact.drop_exact_copies(df, keep=keep)
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted(((r[0], t) for t, r in {(dict(((hashlib.sha256((x or "").encode()).hexdigest(), x or "") for _, x in rows))[p[4]]): p for p in plain(rows, keep) if p[3]}.items()), key=str)


def test_hot_group_is_spread(spark):
    """A text that fills most of the table: its rows are dealt to many places and each is decided."""
    rows = [(i, "hot") for i in range(5000)] + [(5000 + i, f"t{i % 700}") for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert shown(exact.decisions(df)) == plain(rows, "smallest")
    dealt = df.select(F.pmod(F.xxhash64("doc_id"), F.lit(exact.SALTS)).alias("s")).where("doc_id < 5000").groupBy("s").count().agg(F.max("count")).first()[0]
    assert dealt < 2 * 5000 / exact.SALTS


def test_normalised_texts(spark):
    rows = [(1, "A b"), (2, "a B"), (3, "c")]
    got = exact.decisions(spark.createDataFrame(rows, "doc_id long, text string"), normalise=F.lower)
    assert sorted((r.id, r.keep_id, r.kept) for r in got.collect()) == [(1, 1, True), (2, 1, False), (3, 3, True)]


def test_long_texts_differ_at_the_end(spark):
    long = "word " * 400_000
    rows = [(1, long), (2, long + "x"), (3, long)]
    got = exact.decisions(spark.createDataFrame(rows, "doc_id long, text string"), keep="largest")
    assert sorted((r.id, r.keep_id, r.n) for r in got.collect()) == [(1, 3, 2), (2, 2, 1), (3, 3, 2)]


def test_empty_table_and_columns(spark, empty):
    assert exact.decisions(empty).count() == 0
    assert exact.exact_duplicates(empty).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert exact.drop_exact_copies(empty).schema == empty.schema


def test_whole_records_with_clashing_names_maps_and_variants(spark):
    df = spark.sql(
        "select id as doc_id, if(id % 2 = 0, 'even', concat('odd', id)) as text, map('k', id) as h, parse_json('{}') as n, id as kept, id as _record from range(10)"
    )
    got = exact.drop_exact_copies(df, keep="largest")
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == [1, 3, 5, 7, 8, 9]
    assert got.where("doc_id = 8").select("h").first()[0] == {"k": 8}


def test_unknown_choice():
    with pytest.raises(ValueError):
        exact._pick("any")


def test_digest_of_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a", "en", "s", 1, 0.5, 9), (2, "a", None, None, None, None, None)], DOCS).withColumnRenamed("rate", "h").withColumnRenamed("component", "keep_id")
    got = sorted(tuple(r) for r in exact.exact_duplicates(df).select("doc_id", "keep_id", "group_size", "kept").collect())
    assert got == [(1, 2, 2, False), (2, 2, 2, True)]
