"""Soft-membership mixing of documents to target weights.

Domains are the classes of the ``labels`` table: clean (good and not toxic), toxic, junk (of low quality). A
subword-embedding classifier of these classes, trained on a bounded labelled sample, gives a document's domain
posteriors p. Non-negative document rates r are fitted so that the expected domain token totals, the sums of
``r * tokens * p``, come as near as possible to target totals, in the least-squares sense, by projected
gradient steps.

The gradient is scaled by ``1 / tokens`` for each document and by the inverse of the small domain-by-domain
matrix (with ``RIDGE`` added, which keeps a nearly empty domain from driving the rates of all), so documents of equal posteriors have equal rates and few steps are needed. A step has one vector of
domain multipliers; a document's rate follows from its own row and the vectors so far, so rates are never
stored and one row of domain sums is all that comes to the driver in a step.

Misses of totals are weighed by that inverse matrix. Targets: ``weights`` are shares of tokens. The total is chosen so that the ``anchor`` domain keeps its tokens;
with no tokens in it, the total stays. Steps end when every domain is within ``TOLERANCE`` of its own target, or when
a step hardly lowers the sum of squares any more (rates at 0 can keep targets out of reach);
running out of steps raises. Defined cases: null and empty texts have no tokens, the bias's
posterior and the rate that posterior gives; repeated rows get equal rates; an empty table gives an empty
result; extra columns ride along in ``mix`` and are ignored elsewhere; without any labelled row posteriors are equal
and, as nothing tells the domains apart, all rates are 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, kept, materialize, own_names, release_memory, texts
from .quality import AGAIN, TRAIN_BYTES, TRAIN_ROWS, WORDS_AT_ONCE, Embeddings, as_features, feature_blocks, word_counts, word_parts

DOMAINS = ["clean", "toxic", "junk"]
WEIGHTS = {"clean": 0.93, "toxic": 0.06, "junk": 0.01}
ANCHOR = "clean"
STEPS, TOLERANCE, RIDGE = 200, 1e-2, 0.01
HELD_WORDS, TEXTS_AT_ONCE = 60_000, 50  # smaller than the quality classifier's: the pipeline's executors come here with full heaps


def domain_sample(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """doc_id, text and domain index of at most ``max_rows`` labelled documents, chosen by seeded hash."""
    domain = F.when(F.col("quality") == 0, 2).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & (F.col("toxic") == 0), 0)
    picked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), domain.alias("label"))
        .where("label is not null and doc_id is not null")
        .orderBy(F.xxhash64("doc_id", F.lit(8)), "doc_id")
        .limit(max_rows)
    )
    return texts(docs).where(F.octet_length("text") <= max_bytes).join(F.broadcast(picked), "doc_id")


def train(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Each bucket's part of each domain's logit, and the bias; all zeros without a labelled row."""
    documents, labels = [], []
    for row in sample.orderBy("doc_id", "text").toLocalIterator():
        documents.append(as_features(row["text"]))
        labels.append(row["label"])
    model = Embeddings(len(DOMAINS))
    if documents:
        model.fit(documents, np.array(labels))
    else:
        model.layer[:] = 0  # posteriors are equal
    del documents
    release_memory()
    return (model.vectors @ model.layer).astype(np.float32), model.bias.astype(np.float64)


class DomainScorer:
    """Posteriors of texts; a worker process keeps the words it has met."""

    @classmethod
    def of(cls, table: np.ndarray, bias: np.ndarray) -> DomainScorer:
        keep_only("domains")
        return kept("domains", xxhash.xxh3_64_hexdigest(table.tobytes() + bias.tobytes()), lambda: cls(table, bias))

    def __init__(self, table: np.ndarray, bias: np.ndarray):
        self.table, self.bias = table, bias
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((WORDS_AT_ONCE, len(bias) + 1))

    def _learn(self, new: list[str]) -> None:
        for part in word_parts(new):
            first = len(self.cache)
            if first + len(part) > len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            mine = self.rows[first : first + len(part)]
            mine[:] = 0
            for owner, ids in feature_blocks(part):
                for k in range(len(self.bias)):
                    mine[:, k] += np.bincount(owner, self.table[ids, k], len(part))
                mine[:, -1] += np.bincount(owner, minlength=len(part))
            self.cache.update(zip(part, range(first, first + len(part)), strict=True))

    def posteriors(self, texts: list[str]) -> tuple[list[int], list[list[float]]]:
        """Numbers of words, and softmax over domains; new words of all texts are learnt at once."""
        if len(self.cache) > HELD_WORDS:
            self.cache.clear()
        counted = [word_counts(t) for t in texts]
        self._learn(list(set().union(*counted).difference(self.cache)))
        place = self.cache.__getitem__
        logits = np.tile(self.bias, (len(texts), 1))
        for i, counts in enumerate(counted):
            if n := len(counts):
                share = np.fromiter(counts.values(), np.float64, n) @ self.rows[np.fromiter(map(place, counts), np.int64, n)]
                logits[i] += share[:-1] / share[-1]
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return [counts.total() - counts[AGAIN] for counts in counted], (e / e.sum(axis=1, keepdims=True)).tolist()


def posteriors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, h (hash of the text), n_tokens (words) and the posteriors p (array) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(train(domain_sample(docs, labels)))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = DomainScorer.of(*model.value)
        for batch in batches:
            for low in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(low, TEXTS_AT_ONCE)
                tokens, p = scorer.posteriors(part.column(2).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(tokens, pa.int64()), pa.array(p, pa.list_(pa.float64()))], ["doc_id", "h", "n_tokens", "p"])

    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, "doc_id long, h long, n_tokens long, p array<double>")


def rates_of(p: np.ndarray, multipliers: list[np.ndarray]) -> np.ndarray:
    rates = np.ones(len(p))
    for m in multipliers:
        rates = np.maximum(0.0, rates + p @ m)
    return rates


def _matrix(batch: pa.RecordBatch, column: int, k: int) -> np.ndarray:
    return batch.column(column).flatten().to_numpy().reshape(-1, k) if batch.num_rows else np.empty((0, k))


def domain_sums(rows: DataFrame, multipliers: list[np.ndarray], k: int) -> np.ndarray:
    """Sums over all documents of tokens * (r * p, p p'), added up in one small row per partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k)
        for batch in batches:
            tokens, p = batch.column(0).to_numpy().astype(np.float64), _matrix(batch, 1, k)
            total[:k] += (rates_of(p, multipliers) * tokens) @ p
            total[k:] += ((p * tokens[:, None]).T @ p).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total)], ["i", "s"])

    parts = rows.select("n_tokens", "p").mapInArrow(run, "i int, s double").groupBy("i").agg(F.sum("s").alias("s")).collect()  # k + k * k rows
    out = np.zeros(k + k * k)
    for i, s in parts:
        out[i] = s
    return out


def fit_rates(rows: DataFrame, weights: dict[str, float] = WEIGHTS, anchor: str | None = ANCHOR, domains: list[str] = DOMAINS, steps: int = STEPS, tolerance: float = TOLERANCE) -> list[np.ndarray]:
    """The multipliers whose steps lead to the fitted rates. ``rows``: n_tokens and p."""
    k = len(domains)
    share = np.array([weights.get(d, 0.0) for d in domains])
    share = share / share.sum()
    sums = domain_sums(rows, [], k)
    now, metric = sums[:k], sums[k:].reshape(k, k)
    total = now.sum()
    if not total or np.ptp(metric) < 1e-9 * total:
        return []  # no tokens, or all posteriors are 1 / k
    if anchor is not None and now[domains.index(anchor)] > 0 and share[domains.index(anchor)] > 0:
        total = now[domains.index(anchor)] / share[domains.index(anchor)]
    target = share * total
    inverse = np.linalg.inv(metric + RIDGE * np.trace(metric) * np.eye(k))
    multipliers: list[np.ndarray] = []
    least = tolerance * np.maximum(target, tolerance * total)
    for _ in range(steps):
        if (np.abs(now - target) <= least).all():
            return multipliers
        miss = target - now
        multipliers.append(inverse @ miss)
        now = domain_sums(rows, multipliers, k)[:k]
        if (target - now) @ inverse @ (target - now) >= (1 - tolerance / 10) * (miss @ inverse @ miss):
            return multipliers
    raise RuntimeError(f"rates did not settle in {steps} steps: totals {now.tolist()}, targets {target.tolist()}")


def with_rates(rows: DataFrame, multipliers: list[np.ndarray], k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates_of(_matrix(batch, 3, k), multipliers))], [*batch.schema.names, "rate"])

    return rows.mapInArrow(run, "doc_id long, h long, n_tokens long, p array<double>, rate double")


def copies(rate: str = "rate", seed: int = 23):
    """A whole number of copies whose expectation is the rate, fixed by doc_id and text."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "h"), F.lit(1_000_003)) / 1_000_003
    return F.floor(F.col(rate) + draw).cast("int")


def mixing_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, anchor: str | None = ANCHOR) -> DataFrame:
    """doc_id, h, n_tokens, p, rate and copies of every row."""
    rows = materialize(posteriors(docs, labels), "posteriors")
    return with_rates(rows, fit_rates(rows, weights, anchor), len(DOMAINS)).withColumn("copies", copies())


def mixing_table(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, anchor: str | None = ANCHOR) -> DataFrame:
    """doc_id, n_tokens, posteriors, rate and copies of every row of ``docs``."""
    found = mixing_rates(docs, labels, weights, anchor)
    return found.select("doc_id", "n_tokens", *[F.round(F.col("p")[i], 9).alias(f"p_{d}") for i, d in enumerate(DOMAINS)], F.round("rate", 9).alias("rate"), "copies")


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float] = WEIGHTS, anchor: str | None = ANCHOR) -> DataFrame:
    """``docs`` with each row as often as its number of copies says; all columns kept, whatever their names."""
    id_, th, doc, h, times, copy = own_names(docs, "id", "th", "doc", "h", "times", "copy")
    found = mixing_rates(docs, labels, weights, anchor).where("copies <> 1").select("doc_id", "h", "copies").distinct().toDF(doc, h, times)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    joined = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(th, F.xxhash64(text)).join(found, F.col(id_).eqNullSafe(F.col(doc)) & (F.col(th) == F.col(h)), "left")
    often = F.coalesce(F.col(times), F.lit(1))
    return joined.where(often > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), often))).select(*[F.col(f"`{c}`") for c in docs.columns])
