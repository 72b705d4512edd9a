"""The pipeline's stages, each on its predecessor's rows."""

import re

from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import common, components, jaccard, mixing, packing, quality, queries, sharding, suffix

from .test_operators import check_packing, plain_links, plain_words

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    (_, classify), (_, near), (_, repeats), (_, mix), (_, pack) = corpus_pipeline.STAGES
    labels = spark.read.parquet(f"{SF}/labels.parquet")

    kept = common.materialize(classify(spark, docs, SF), "t")
    good = {r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect()}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == good

    unlike = common.materialize(near(spark, kept, SF), "t")
    found = {r.doc_id: r.text for r in kept.collect()}
    assert unlike.columns == columns and sorted(r.doc_id for r in unlike.collect()) == sorted(i for i, (_, c) in plain_links(found).items() if i == c)

    cut = common.materialize(repeats(spark, unlike, SF), "t")
    assert cut.columns == columns and cut.count() <= unlike.count()

    mixed = common.materialize(mix(spark, cut, SF), "t")
    assert mixed.columns == columns and {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in cut.collect()}

    rows = pack(spark, mixed.dropDuplicates(["doc_id"]), SF).collect()
    check_packing(rows, {r.doc_id: r.text for r in mixed.dropDuplicates(["doc_id"]).collect()})
    assert pack(spark, mixed, SF).selectExpr("sum(length)").first()[0] >= sum(r.length for r in rows)


CLASHES = ["_id", "_h", "_kept", "_row", "_copy", "_th", "_doc", "_times", "_bucket", "shard", "slot", "id", "h", "kept", "Label"]


def test_stages_keep_columns_of_any_name(spark, docs):
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 32)], "doc_id long, quality int, toxic int")
    odd = docs.select("*", *[F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES])
    odd = odd.unionByName(odd.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    for stage in (lambda d: quality.drop_rejected(d, labels), jaccard.keep_first, suffix.drop_later_copies, lambda d: mixing.mix(d, labels)):
        out = stage(odd)
        assert out.columns == odd.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in CLASHES if r.doc_id is not None)
    dealt = sharding.two_pass_shuffle(odd, "doc_id", 3)
    assert sorted(set(dealt.columns) - set(odd.columns)) == ["_shard", "_slot"] and dealt.count() == odd.count()
    assert {r.doc_id for r in dealt.where("_shard = concat('shard-', doc_id)").collect()} == {r.doc_id for r in odd.where("doc_id is not null").collect()}


def test_stages_of_empty_tables(spark, empty):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for stage in (lambda d: quality.drop_rejected(d, labels), jaccard.keep_first, suffix.drop_later_copies, lambda d: mixing.mix(d, labels)):
        out = stage(empty)
        assert out.columns == empty.columns and out.count() == 0
    assert packing.pack_documents(empty).count() == 0


def test_later_passages_go_as_in_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: r.text for r in docs.collect()}
    kept = {i: found[i] if t == (found[i] or "").encode() else t.decode() for i, (t, _) in plain_words(found, suffix.PASSAGE, later=True).items()}
    got = {r.doc_id: r.text for r in suffix.drop_later_copies(docs).collect()}
    assert got == {i: t for i, t in kept.items() if t or t == found[i]} and got != found


def test_registered():
    names = set(queries.QUERIES)
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)}


def test_whole_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def functions_in_a_task(df) -> int:
    """The most Python functions that follow each other without an exchange; each takes a worker of its own."""
    most, above = 0, []
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        if not (m := re.match(r"([ :]*(?:\+- |:- )?)(?:\*\(\d+\) )?(\w+)", line)):
            continue
        depth, node = len(m[1]), m[2]
        above = [x for x in above if x[0] < depth]
        count = above[-1][1] if above else 0
        count = 0 if "Exchange" in node else count + (node == "MapInArrow")
        above.append((depth, count))
        most = max(most, count)
    return most


def test_a_task_runs_one_python_function(spark, docs, monkeypatch):
    counts = []

    def noted(df, tag, *more):
        counts.append((tag, functions_in_a_task(df)))
        return common.materialize(df, tag, *more)

    for module in (jaccard, suffix, components, mixing):
        monkeypatch.setattr(module, "materialize", noted)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 32)], "doc_id long, quality int, toxic int")
    stored = common.materialize(docs, "t")
    for name, stage in (
        ("quality", lambda d: quality.drop_rejected(d, labels)), ("near", jaccard.keep_first), ("later", suffix.drop_later_copies),
        ("mix", lambda d: mixing.mix(d, labels)), ("pack", packing.pack_documents), ("op5", lambda d: suffix.remove_repeats(d, passage=suffix.PASSAGE)),
    ):
        counts.append((name, functions_in_a_task(stage(stored))))
    assert {c for _, c in counts} == {0, 1}, [x for x in counts if x[1] > 1]
