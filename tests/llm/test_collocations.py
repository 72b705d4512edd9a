"""Phrase collocations against a plain version: long, null, empty and repeated texts, languages, ties, hot phrases."""

import random
import re
from collections import Counter

import pytest

from factloom.llm import collocations as C

from .conftest import DOCS, texts


@pytest.fixture(autouse=True)
def few_parts(monkeypatch):
    monkeypatch.setattr(C, "PARTS", 4)


def plain(rows, support, longest=5, top=2000, percent=100):
    """(lang, text) rows to the result, by counting every phrase."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= support}
    covered = set()
    for (lang, w), a in candidates.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                part = (lang, w[i : i + size])
                if 100 * a >= percent * f[part]:
                    covered.add(part)
    out = []
    for (lang, w), a in candidates.items():
        if (lang, w) not in covered:
            cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w))]
            score, _, l, r = min(cuts)  # noqa: E741
            out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        mine = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(lang, k + 1, *x[1:]) for k, x in enumerate(mine[:top])]
    return sorted(ranked)


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(k, t, lang, None, None, None, None) for k, (lang, t) in enumerate(rows)], DOCS).repartition(3)
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in C.collocations(docs, **options).collect())


def corpus():
    rng = random.Random(3)
    words = ["ab", "Cd", "é", "漢字", "x", "y", "z", "NEW", "york", "a-b", "'s"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".\n", "!"]) for _ in range(rng.randint(0, 90)))) for _ in range(120)]
    return rows + [("en", "new york city hall is big. " * 40), ("en", None), (None, ""), ("de", " \t\n"), ("de", "..."), ("en", "New york"), ("en", "New york")]


@pytest.mark.parametrize("support", [2, 15])
def test_equals_plain(spark, support):
    got = mined(spark, corpus(), support=support)
    assert got == plain(corpus(), support) and len(got) > 20


def test_other_limits(spark):
    assert mined(spark, corpus(), support=5, longest=3, top=4, percent=60) == plain(corpus(), 5, 3, 4, 60)


def test_odd_texts(spark):
    rows = [("en" if k % 3 else None, t) for k, t in texts().items()]
    assert mined(spark, rows, support=3) == plain(rows, 3)


def test_one_phrase_fills_the_table(spark):
    rows = [("en", "same words again and again")] * 600 + [("en", f"w{k} v{k % 7}") for k in range(100)]
    assert mined(spark, rows, support=10) == plain(rows, 10)


def test_parts_of_long_texts(spark, monkeypatch):
    """Parts are cut at piece ends only, so no phrase is lost between them, and a piece without an end stays whole."""
    rng = random.Random(1)
    long = " ".join(rng.choice("abcde") + rng.choice(["", "", "."]) for _ in range(5000))
    rows = [("en", long), ("en", "q r " * 3000), ("de", long[:100])]
    monkeypatch.setattr(C, "PART_BYTES", 256)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["lang", "text"])
    held = [x for part in C.parts(iter([batch])) for x in part]
    assert b"".join(t for lang, t in held if lang == "en").decode() == long + "q r " * 3000
    assert len(held) > 30 and all(len(t) < 600 or b"q" in t for _, t in held)


def test_very_long_text(spark):
    """Over two parts of whole size."""
    rows = [("en", "alpha beta gamma. x y " * (2 * C.PART_BYTES // 22 + 9))]
    assert mined(spark, rows, longest=3) == plain(rows, 100, 3)


def test_bucket_counts_hold_and_hand_on(monkeypatch):
    import numpy as np

    monkeypatch.setattr(C, "ENTRIES", 50)
    rng = np.random.default_rng(0)
    counts, total, rows = C.BucketCounts(1000), Counter(), []
    for _ in range(40):
        at = rng.integers(0, C.BUCKETS, 30)
        at = np.concatenate([at, at[:3], [5, 5, 131072]])
        total.update(at.tolist())
        rows += list(counts.add(at))
    rows += list(counts.rows())
    got = Counter()
    for batch in rows:
        for slot, raw in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            for e in np.frombuffer(raw, "<u4").tolist():
                got[(slot << C.LOW_BITS) + (e >> C.COUNT_BITS)] += e & ((1 << C.COUNT_BITS) - 1)
    assert got == total and len(rows) > 1


def test_pruning_keeps_exactly_what_counts(spark):
    """Only phrases of frequent parts are counted from the second pass on."""
    docs = spark.createDataFrame([(k, t, lang, None, None, None, None) for k, (lang, t) in enumerate(corpus())], DOCS)
    found, totals = C.frequent_phrases(docs, 15)
    got = {(r.lang, r.phrase) for r in found.collect()}
    assert all((lang, p) in got for lang, phrase in got for p in (phrase.rsplit(" ", 1)[0], phrase.split(" ", 1)[-1]))
    assert {r.lang for r in totals.collect()} == {"en", "de", "und"}


def test_empty_table_and_limits(spark, empty):
    got = C.collocations(empty)
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    with pytest.raises(ValueError):
        C.frequent_phrases(empty, support=1 << 15)


def test_clashing_columns(spark):
    rows = [("en", "a b c " * 5)] * 4
    docs = spark.createDataFrame([(t, lang, "x", 1) for lang, t in rows], "text string, lang string, phrase string, n int")
    assert sorted(tuple(r) for r in C.collocations(docs, support=3).collect()) == plain(rows, 3)
