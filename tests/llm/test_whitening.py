"""Whitening against a plain version in fractions and 50-digit decimals' worth of integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, label int"


def usable(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def plain(rows, components=16):
    """(n, sums, scatter n*XX-SS, {row: deviation}) in Python integers with the contract's offset."""
    x = {k: tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for k, (_, v) in enumerate(rows) if usable(v) and len(v) == len(rows[0][1])}
    fit = sorted(set(x.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(r[j] for r in fit) for j in range(d)]
    scatter = [[n * sum(r[i] * r[j] for r in fit) - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    return n, sums, scatter, {k: sum((n * c - s) ** 2 for c, s in zip(v, sums)) for k, v in x.items()}, x


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(400, 24)) @ np.diag(np.linspace(3, 0.2, 24))
    out = [(k, [float(np.float32(c)) for c in v]) for k, v in enumerate(base)]
    out += [(1000 + k, out[7][1]) for k in range(300)]  # one vector in many rows
    bad = [None, [*out[0][1][:-1], None], [*out[0][1][:-1], float("nan")], [float("inf"), *out[0][1][1:]], [1.0, 2.0], []]
    return out + [(2000 + k, v) for k, v in enumerate(bad)] + [(None, out[3][1]), (5, out[5][1])]


def test_equals_plain(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(5)
    got = W.whitened_embeddings(df).collect()
    n, sums, scatter, deviation, x = plain(rows)
    e, v = np.linalg.eigh(np.array([[c / n**2 for c in r] for r in scatter]))
    e, v = e[::-1][:16], v[:, ::-1][:, :16]
    assert len(got) == 16 * len(x) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 17))
    known = {}
    for k, (i, _) in enumerate(rows):
        if k in x:
            known.setdefault(i, []).append((deviation[k], (np.array([(n * c - s) / n for c, s in zip(x[k], sums)]) @ v) / np.sqrt(e)))
    signs = {}
    for r in got:
        dev, w = known[r.vec_id][0]
        assert r.deviation == dev
        assert abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-9
        if abs(r.whitened) > 1e-6:
            assert signs.setdefault(r.component, np.sign(r.whitened * w[r.component - 1])) == np.sign(r.whitened * w[r.component - 1])
        assert abs(r.explained / (e[r.component - 1] / sum(scatter[j][j] / n**2 for j in range(24))) - 1) < 1e-9
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_rows_without_usable_vectors_go(spark, rows):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    ids = {r.vec_id for r in W.whitened_embeddings(df).select("vec_id").distinct().collect()}
    assert ids == {i for i, v in rows if usable(v) and len(v) == 24}


@pytest.mark.parametrize("largest", [3, 1 << 19, 1 << 25, 1 << 45, 1 << 60])
def test_scatter_is_exact_at_every_size(largest):
    rng = np.random.default_rng(largest % 97)
    rows = rng.integers(-largest, largest, (50, 4), endpoint=True)
    rows[0], rows[1] = largest, -largest
    totals = W.scatter_limbs(iter([rows[:20], rows[20:]]), 4)
    flat = [sum(int(totals[k, c]) << (W.LIMB * k) for k in range(W.LIMBS)) for c in range(totals.shape[1])]
    upper = list(zip(*np.triu_indices(4)))
    assert flat[:10] == [sum(int(r[i]) * int(r[j]) for r in rows) for i, j in upper]
    assert flat[10:14] == [sum(int(r[j]) for r in rows) for j in range(4)] and flat[14] == 50


def test_large_entries(spark):
    """Sums far beyond doubles: the scatter stays exact and deviations beyond 63 bits are null."""
    rows = [(k, [1e15 + 64.0 * k, (-1.0) ** k * 3.0e14, float(k % 3)]) for k in range(40)]
    fit = W.fit_list(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3))
    n, sums, cross = W.exact_scatter(fit, 3)
    x = [[math.floor(64 * c) for c in v] for _, v in rows]
    assert n == 40 and list(sums) == [sum(r[j] for r in x) for j in range(3)]
    assert cross.tolist() == [[sum(r[i] * r[j] for r in x) for j in range(3)] for i in range(3)]
    model = W.decompose(n, sums, cross)
    assert {r.deviation for r in W.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), model).collect()} == {None}


def test_pack_round_trip():
    import pyarrow as pa

    rows = np.array([[0, 1], [32767, -32768], [32768, 0], [-32769, 5], [1 << 31, 0], [-(1 << 31), 7], [-(1 << 60), 1 << 60]])
    raw = W.pack(rows)
    assert [len(r) // 2 for r in raw] == [2, 2, 4, 4, 8, 4, 8]
    assert (W.unpack(pa.array(raw, pa.binary()), 2) == rows).all()


def test_empty_equal_and_clashing(spark):
    assert W.whitened_embeddings(spark.createDataFrame([], SCHEMA)).count() == 0
    assert W.whitened_embeddings(spark.createDataFrame([(k, [1.0, 2.0], 0) for k in range(5)], SCHEMA)).count() == 0  # no direction varies
    df = spark.createDataFrame([(k, [float(k), float(k * k % 7)], 0) for k in range(9)], SCHEMA).withColumn("n", F.lit(1)).withColumn("x", F.lit("y")).withColumn("id", F.lit(0))
    got = W.whitened_embeddings(df)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and got.count() == 18
