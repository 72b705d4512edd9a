"""Quality classifier: supervised subword embeddings.

A text's features are its words, their character n-grams (3 to 5, with word ends), and a mark for each word that
repeats the one before it. Every feature is hashed to a learned vector; a document is the average of its
feature vectors, a softmax layer gives the class. Vectors and layer are trained together by stochastic
gradient descent in numpy on the driver, over a bounded sample: at most ``TRAIN_ROWS`` labelled documents of at
most ``TRAIN_BYTES`` bytes. Scoring reads whole texts; the model is linear after the average, so a word's
share of the score is computed once and kept.

Defined cases: null and empty texts get the score of the bias alone; repeated rows get equal scores; with no
labelled row of either class every score is 0.5 (or the class's share); an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import mix
from .common import keep_only, kept, label_rows, release_memory, texts

BUCKETS, DIM = 1 << 18, 16
SPREAD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
TRAIN_ROWS, TRAIN_BYTES = 4000, 60_000
HELD_WORDS, WORDS_AT_ONCE = 250_000, 20_000
CHARACTERS_AT_ONCE = 1 << 20
AGAIN = "\0="


def feature_blocks(words: list[str], block: int = CHARACTERS_AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the word, feature) of every feature of ``words``: the word, and the character n-grams of all of it with its ends.

    N-grams come in blocks of ``block`` starting places, so a text without blanks needs no more memory at once.
    """
    yield np.arange(len(words)), np.fromiter((xxhash.xxh3_64_intdigest(w.encode(errors="surrogatepass")) >> 46 for w in words), np.int64, len(words))
    sizes = [len(w) + 2 for w in words]
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words), dtype=np.int32), sizes)
    for low in range(0, len(points), block):
        codes, mine = mix(points[low : low + block + 4].astype(np.uint64)), owner[low : low + block + 4]
        grams = codes
        for k in range(2, 6):
            if len(codes) < k:
                break
            grams = grams[: len(codes) - k + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[k - 1 :]
            if k > 2:
                inside = np.flatnonzero(mine[: len(codes) - k + 1][:block] == mine[k - 1 :][:block])
                yield mine[inside], ((grams[inside] * SPREAD[k - 3]) >> np.uint64(46)).astype(np.int64)  # the top 18 bits


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All of ``feature_blocks`` at once."""
    owners, hashed = zip(*feature_blocks(words), strict=True)
    return np.concatenate(owners), np.concatenate(hashed)


def word_parts(words: list[str]) -> Iterator[list[str]]:
    """``words`` in parts of at most ``WORDS_AT_ONCE`` words and, unless one word is longer, ``CHARACTERS_AT_ONCE`` characters."""
    part, size = [], 0
    for w in words:
        if part and (len(part) == WORDS_AT_ONCE or size + len(w) > CHARACTERS_AT_ONCE):
            yield part
            part, size = [], 0
        part.append(w)
        size += len(w)
    if part:
        yield part


def word_counts(text: str) -> Counter[str]:
    words = text.split()
    counts = Counter(words)
    if again := sum(map(eq, words, islice(words, 1, None))):
        counts[AGAIN] = 3 * again
    return counts


class Embeddings:
    """Feature vectors and softmax layer."""

    def __init__(self, classes: int = 2, buckets: int = BUCKETS, dim: int = DIM, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
        self.layer = rng.normal(0, 0.1, (dim, classes)).astype(np.float32)
        self.bias = np.zeros(classes, np.float32)

    def fit(self, documents: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 0.8, seed: int = 5) -> None:
        """documents: (distinct features, their shares) each."""
        rng = np.random.default_rng(seed)
        steps, done = epochs * len(documents), 0
        for _ in range(epochs):
            for i in rng.permutation(len(documents)):
                features, shares = documents[i]
                now = rate * (1 - done / steps)
                done += 1
                mean = shares @ self.vectors[features] if len(features) else np.zeros(self.vectors.shape[1], np.float32)
                logits = mean @ self.layer + self.bias
                p = np.exp(logits - logits.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.layer @ p
                self.layer -= now * np.outer(mean, p)
                self.bias -= now * p
                if len(features):
                    # a share is small in a long text; its gradient is scaled to that of one feature
                    self.vectors[features] -= np.outer(now * shares / np.sqrt((shares**2).sum()), back)

    def bucket_scores(self) -> np.ndarray:
        """Each bucket's part of the log odds of class 1, before the average."""
        return (self.vectors @ (self.layer[:, 1] - self.layer[:, 0])).astype(np.float32)


def as_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a text and their shares."""
    counts = word_counts(text)
    if not counts:
        return np.empty(0, np.int64), np.empty(0, np.float32)
    owner, ids = word_features(list(counts))
    features, inverse = np.unique(ids, return_inverse=True)
    shares = np.bincount(inverse, np.fromiter(counts.values(), np.float64, len(counts))[owner], len(features))
    return features.astype(np.int32), (shares / shares.sum()).astype(np.float32)


def train(sample: DataFrame, fit: dict | None = None) -> tuple[np.ndarray, float]:
    """``sample``: text and label, bounded by the caller. Bucket scores and the bias."""
    documents, labels = [], []
    for row in sample.select("doc_id", "label", "text").orderBy("doc_id", "text").toLocalIterator():
        documents.append(as_features(row["text"]))
        labels.append(row["label"])
    model = Embeddings()
    if documents:
        model.fit(documents, np.array(labels), **(fit or {}))
    del documents
    release_memory()
    return model.bucket_scores(), float(model.bias[1] - model.bias[0])


class WordScorer:
    """Log odds of texts; a worker process keeps the words it has met."""

    @classmethod
    def of(cls, scores: np.ndarray, bias: float) -> WordScorer:
        keep_only("quality", "toxicity")
        return kept("quality", xxhash.xxh3_64_hexdigest(scores.tobytes() + str(bias).encode()), lambda: cls(scores, bias))

    def __init__(self, scores: np.ndarray, bias: float):
        self.scores, self.bias = scores, bias
        self.cache: dict[str, int] = {}
        self.rows = np.zeros((WORDS_AT_ONCE, 2))

    def _learn(self, new: list[str]) -> None:
        for part in word_parts(new):
            first = len(self.cache)
            if first + len(part) > len(self.rows):
                self.rows = np.vstack([self.rows, np.zeros_like(self.rows)])
            mine = self.rows[first : first + len(part)]
            mine[:] = 0
            for owner, ids in feature_blocks(part):
                mine[:, 0] += np.bincount(owner, self.scores[ids], len(part))
                mine[:, 1] += np.bincount(owner, minlength=len(part))
            self.cache.update(zip(part, range(first, first + len(part)), strict=True))

    def log_odds(self, texts: list[str]) -> list[float]:
        """New words of all texts are learnt at once."""
        if len(self.cache) > HELD_WORDS:
            self.cache.clear()
        counted = [word_counts(t) for t in texts]
        self._learn(list(set().union(*counted).difference(self.cache)))
        place, out = self.cache.__getitem__, []
        for counts in counted:
            n = len(counts)
            total, size = np.fromiter(counts.values(), np.float64, n) @ self.rows[np.fromiter(map(place, counts), np.int64, n)]
            out.append(self.bias + (float(total / size) if size else 0.0))
        return out


LogOdds = Callable[[], Callable[[list[str]], list[float]]]
TEXTS_AT_ONCE = 200


def in_groups(column: pa.Array, log_odds: Callable[[list[str]], list[float]]) -> list[float]:
    """Log odds of a column of texts, null being empty."""
    out: list[float] = []
    for low in range(0, len(column), TEXTS_AT_ONCE):
        out += log_odds([t.as_py() or "" for t in column.slice(low, TEXTS_AT_ONCE)])
    return out


def score_texts(docs: DataFrame, log_odds: LogOdds) -> DataFrame:
    """doc_id and score of each row; ``log_odds()`` gives a worker its scorer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = log_odds()
        for batch in batches:
            odds = np.array(in_groups(batch.column(1), score), np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(odds, -60, 60))))], ["doc_id", "score"])

    return texts(docs).mapInArrow(run, "doc_id long, score double")


def quality_scorer(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> LogOdds:
    """Train on labelled rows whose crc32(doc_id) mod 5 is not 0."""
    model = docs.sparkSession.sparkContext.broadcast(train(label_rows(docs, labels, "quality", 5, 0, max_rows, max_bytes)))
    return lambda: WordScorer.of(*model.value).log_odds


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    scored = score_texts(docs, quality_scorer(docs, labels))
    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_rejected(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``, all columns kept; one pass, no shuffle."""
    make = quality_scorer(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_odds = make()
        least = float(np.log(threshold / (1 - threshold)))
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([x >= least for x in in_groups(column, log_odds)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
