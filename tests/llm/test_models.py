"""Learned operators: held-out accuracy on the driver's documents, and their defined cases."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing, quality, toxicity

from .conftest import DOCS, prose, rows, texts

SF = "/root/testdata/sf0.01"
INSULTING = "idiot|clown|pathetic|worthless|stupid|moron|scum|trash|loser|disgusting"  # of the driver's documents


@pytest.fixture(scope="module")
def tables(spark):
    return tuple(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))


def held_out(scored, labels, column):
    joined = scored.join(labels, "doc_id").where("held_out").select("doc_id", "score", "predicted", column).toPandas()
    y = joined[column].to_numpy()
    ranks = joined["score"].rank().to_numpy()
    n1, n0 = y.sum(), len(y) - y.sum()
    return joined, (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def test_quality(tables):
    docs, labels = tables
    joined, auc = held_out(quality.score_quality(docs, labels), labels, "quality")
    assert auc > 0.95 and (joined.quality == joined.predicted).mean() > 0.95


def test_toxicity(tables):
    docs, labels = tables
    joined, auc = held_out(toxicity.score_toxicity(docs, labels), labels, "toxic")
    assert auc > 0.8 and ((joined.toxic == 0) & (joined.predicted == 1)).sum() <= 2
    # many toxic labels are on texts of other languages that hold no insult; of those that hold one, nearly all are caught
    texts_of = {r.doc_id: r.text for r in docs.where(F.col("doc_id").isin(joined.doc_id[joined.toxic == 1].tolist())).collect()}
    insulting = [bool(re.search(INSULTING, re.sub("[^a-z]", "", (texts_of[i] or "").lower()))) if t else False for i, t in zip(joined.doc_id, joined.toxic, strict=True)]
    assert sum(insulting) >= 8 and joined.predicted[insulting].mean() >= 0.9


def test_scores_follow_texts_only(spark, tables):
    docs, labels = tables
    text = "plain words of some document that stands twice"
    mine = spark.createDataFrame(rows({10**9: text, 10**9 + 1: text, 10**9 + 2: None, 10**9 + 3: ""}), DOCS)
    for score in (quality.score_quality, toxicity.score_toxicity):
        got = {r.doc_id - 10**9: r for r in score(docs.select(mine.columns[:5]).unionByName(mine.select(mine.columns[:5])), labels).where("doc_id >= 1000000000").collect()}
        assert got[0].score == got[1].score and got[2].score == got[3].score and 0 <= got[2].score <= 1
        modulus, rest = (5, 0) if score is quality.score_quality else (3, 1)
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == rest) for r in got.values())


@pytest.mark.parametrize("score", [quality.score_quality, toxicity.score_toxicity])
def test_without_rows_or_labels(spark, docs, empty, odd, score):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(5, 1, 0), (11, 1, 0), (None, 1, 1), (12, None, None)], "doc_id long, quality int, toxic int")
    assert score(empty, none).count() == 0
    assert score(docs, none).count() == len(texts()) and score(odd, one).count() == 4
    assert all(0 <= r.score <= 1 for r in score(docs, one).collect())


INSULTS = ["moron", "idiot", "scumbag"]


def synthetic(seed=1, n=240):
    rng = random.Random(seed)
    bags, labels = [], []
    for i in range(n):
        words = prose(rng, 40).split()
        if i % 4 == 0:
            words[7] = rng.choice(INSULTS)
        bags.append(toxicity.chunks_of(" ".join(words)))
        labels.append(int(i % 4 == 0))
    return bags, np.array(labels)


def test_toxic_texts_without_words():
    """All toxic training texts empty, and clean ones empty: no crash, defined scores."""
    for bags, labels in (([set(), {"hello"}], [1, 0]), ([{"hello"}, set()], [1, 0]), ([set(), set()], [1, 0]), ([], [])):
        model = toxicity.fit(bags, np.array(labels, np.int64))
        assert all(np.isfinite(toxicity.ToxicScorer(*model).log_odds(["", "hello world", "x"])))


def test_kernel_tolerates_gaps_and_insertions():
    scorer = toxicity.ToxicScorer(*toxicity.fit(*synthetic()))
    level = lambda t: max(scorer.margins_of([t])[0])
    clean = level("lorem ipsum dolor sit amet")
    for t in ("you moron", "you m.o.r.o.n", "you m o r o n", "mo-ron", "idi_ot", "scuxmbag", "MORON!!!"):
        assert level(t) > clean + 0.5, t
    low, high = scorer.log_odds(["lorem ipsum dolor", "lorem moron dolor"])
    assert low < 0 < high
    assert scorer.margins_of([""]) == [[]]


def test_kernel_values_match_a_plain_kernel():
    words = ["moron", "mo-ron", "abcab", "xyz"]

    def weights(w):
        marked, out = f"\x02{w}\x03", {}
        for i in range(len(marked)):
            for a, b, c in toxicity._GAPS:
                if i + c < len(marked):
                    g = marked[i] + marked[i + a] + marked[i + b] + marked[i + c]
                    out.setdefault(g, []).append(toxicity.DECAY ** (c - 3))
        norm = sum(x * x for v in out.values() for x in v) ** 0.5
        return {g: sum(v) / norm for g, v in out.items()}

    plain = [[sum(x * weights(b).get(g, 0) for g, x in weights(a).items()) for b in words] for a in words]
    grams = toxicity.Subsequences(words)
    assert np.allclose(toxicity.nystroem(grams, grams), plain, atol=1e-5)


def test_word_scores_equal_the_model():
    rng = random.Random(3)
    documents = [quality.as_features(prose(rng, 30) + (" !!! ###" * 5 if i % 2 else "")) for i in range(60)]
    model = quality.Embeddings()
    model.fit(documents, np.arange(60) % 2, epochs=4)
    scorer = quality.WordScorer(model.bucket_scores(), float(model.bias[1] - model.bias[0]))
    text = prose(rng, 50) + " twice twice ###"
    features, shares = quality.as_features(text)
    logits = shares @ model.vectors[features] @ model.layer + model.bias
    assert abs(scorer.log_odds([text])[0] - (logits[1] - logits[0])) < 1e-3
    p = scorer.log_odds(["lorem dolor", "lorem !!! ### !!! ###"])
    assert p[0] < p[1]


# ---------------------------------------------------------------- 8


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 400)
    data = [(int(n), x.tolist()) for n, x in zip(rng.integers(1, 500, 400), p, strict=True)]
    frame = spark.createDataFrame(data, "n_tokens long, p array<double>").cache()
    weights = {"clean": 0.6, "toxic": 0.1, "junk": 0.3}
    found = mixing.fit_rates(frame, weights, None, tolerance=1e-4)
    rates = mixing.rates_of(p, found)
    tokens = np.array([n for n, _ in data])
    totals = (rates * tokens) @ p
    assert (rates >= 0).all() and np.allclose(totals / totals.sum(), [0.6, 0.1, 0.3], atol=0.01) and abs(totals.sum() / tokens.sum() - 1) < 0.01


def test_rates_are_plain_least_squares(spark, monkeypatch):
    """Targets that non-negative rates can't reach, against projected gradient steps in plain numpy; and too few steps raise."""
    rng = np.random.default_rng(6)
    p = np.vstack([rng.dirichlet([8, 1, 1], 60), rng.dirichlet([2, 4, 4], 40)])
    tokens = rng.integers(1, 300, 100).astype(float)
    frame = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(tokens, p, strict=True)], "n_tokens long, p array<double>")

    def sums(rows, multipliers, k):
        return np.concatenate([(mixing.rates_of(p, multipliers) * tokens) @ p, ((p * tokens[:, None]).T @ p).ravel()])

    some = [np.array([-1.0, 0.5, 0.2]), np.array([0.3, -2.0, 0.1])]
    assert np.allclose(mixing.domain_sums(frame, some, 3), sums(frame, some, 3))
    monkeypatch.setattr(mixing, "domain_sums", sums)
    weights = {"clean": 0.02, "toxic": 0.97, "junk": 0.01}
    rates = mixing.rates_of(p, mixing.fit_rates(frame, weights, None, steps=4000, tolerance=2e-4))
    target = np.array([0.02, 0.97, 0.01]) * tokens.sum()
    a, best = p.T * tokens, np.ones(100)
    metric = a @ p
    weigh = np.linalg.inv(metric + mixing.RIDGE * np.trace(metric) * np.eye(3))
    step = 1 / np.linalg.norm(a.T @ weigh @ a, 2)
    for _ in range(50_000):
        best = np.maximum(0, best - step * (a.T @ (weigh @ (a @ best - target))))
    loss = lambda r: float((a @ r - target) @ weigh @ (a @ r - target))
    assert loss(rates) <= 1.03 * loss(best) and loss(best) > 0.01 * loss(np.ones(100))
    with pytest.raises(RuntimeError):
        mixing.fit_rates(frame, weights, None, steps=1, tolerance=1e-3)


def test_mixing(tables, empty, odd, spark):
    docs, labels = tables
    table = mixing.mixing_table(docs, labels).toPandas()
    assert len(table) == docs.count() and (table.rate >= 0).all() and np.allclose(table[["p_clean", "p_toxic", "p_junk"]].sum(1), 1)
    assert ((table.copies - table.rate).abs() < 1).all()
    mixed = mixing.mix(docs, labels)
    assert mixed.columns == docs.columns
    counts = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert counts == {i: c for i, c in zip(table.doc_id, table.copies, strict=True) if c}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.rate for r in mixing.mixing_table(docs, none).collect()} == {1.0} and mixing.mix(docs, none).count() == docs.count()
    assert mixing.mix(empty, none).count() == 0 and mixing.mixing_table(odd, none).count() == 4


def test_long_words_count_whole():
    one, other = ("漢" * 40 + c * 3000 for c in "字語")
    ends = [quality.word_features([w])[1].tolist() for w in (one, other)]
    assert [len(e) for e in ends] == [1 + sum(len(one) + 3 - k for k in (3, 4, 5))] * 2 and len(set(ends[0]) & set(ends[1])) <= 8
    words = ["", "a", "some", one, "words"]
    plain = sorted(zip(*(x.tolist() for x in quality.word_features(words)), strict=True))
    for block in (1, 7, 64):
        assert sorted(p for owner, ids in quality.feature_blocks(words, block) for p in zip(owner.tolist(), ids.tolist(), strict=True)) == plain
    scorer = quality.WordScorer(quality.np.random.default_rng(1).normal(size=quality.BUCKETS).astype(quality.np.float32), 0.0)
    a, b = scorer.log_odds([one, other])
    assert abs(a - b) > 0.1
