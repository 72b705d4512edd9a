"""Toxicity: a support vector machine over a subsequence string kernel, with Nyström landmarks.

The kernel compares two words by the runs of four characters that both hold as subsequences, also with gaps: one
that spans s characters weighs ``DECAY ** (s - 4)``, up to ``SPAN`` characters; a word's weights are scaled to unit
length over its occurrences. Word ends count as characters.
So an insult stays close to itself when characters are inserted or left out, and to other words of its stem.
Letters set apart by blanks are read as one word.

The labels are of documents; there are no labelled sentences to train on, so the machine picks the instances itself.
Its instance is a word with its inserted signs, the part of a sentence that windows of ``SPAN`` characters see. Training starts from the words whose grams are much more frequent
in toxic documents, fits the machine on the kernel values to a set of landmark words, and then lets the
machine choose: in each round the positive words are those that score highest in each toxic document, the
negative ones a sample and the highest-scoring words of clean documents. A document's margin is that of its
few highest words; a logistic curve fitted to the training documents turns them into a score.

As the kernel is a dot product of gram weights, the sum over landmarks is one weight for each (hashed)
gram; a word costs a few dozen look-ups, and a worker keeps the words it has met.

Training takes at most ``TRAIN_ROWS`` labelled documents of at most ``TRAIN_BYTES`` bytes. Scoring reads
whole texts. Defined cases: null and empty texts have no word and get the score of the lowest margin; without
labelled rows of both classes every score is the class's share (0 without rows); repeated rows get equal
scores; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from heapq import nlargest

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import mix
from .common import keep_only, kept, label_rows, release_memory
from .quality import LogOdds, score_texts

SPAN, DECAY = 6, 0.5
TABLE = 1 << 20
MULTIPLIER, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
LANDMARKS, ROUNDS = 256, 4
TRAIN_ROWS, TRAIN_BYTES = 4000, 60_000
WORDS_AT_ONCE = 10_000
HELD_WORDS = 250_000
LONGEST = 40
TOP = 3
CLEAN_SHARE = 0.9
INSERTED = "-*._xq"
STRIPPED = ".,;:!?\"'()[]{}<>«»“”„…-–—*&#$%|_~"
LOWEST = -2.0
_SPACED = re.compile(r"(?<!\S)(?:\S ){2,}\S(?!\S)")
_GAPS = [(a, b, c) for c in range(3, SPAN) for b in range(2, c) for a in range(1, b)]


def chunks_of(text: str) -> set[str]:
    """Distinct lower-cased blank-separated chunks, and runs of single characters joined."""
    low = text.lower()
    found = set(low.split())
    if spaced := _SPACED.findall(low):
        found.update(s.replace(" ", "") for s in spaced)
    return found


def word_of(chunk: str) -> list[str]:
    """The chunk without outer punctuation, also without inner signs; a very long one in overlapping pieces."""
    word = chunk.strip(STRIPPED)
    if len(word) <= LONGEST:
        return [word] if not word or word.isalnum() else [word, "".join(filter(str.isalnum, word))]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


class Subsequences:
    """Weighted gapped subsequences of many words at once."""

    def __init__(self, words: list[str]):
        marked = [f"\x02{w}\x03" for w in words]
        sizes = np.array([len(m) for m in marked], np.int64)
        codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(words)), sizes)
        ids, owners, weights = [], [], []
        codes = mix(codes)
        for a, b, c in _GAPS:
            if len(codes) <= c:
                continue
            inside = np.flatnonzero(owner[:-c] == owner[c:])
            h = codes[inside]
            for k in (a, b, c):
                h = h * MULTIPLIER + codes[inside + k]
            ids.append(((h * SPREAD) >> np.uint64(44)).astype(np.int64))
            owners.append(owner[inside])
            weights.append(np.full(len(inside), DECAY ** (c - 3)))
        self.gram = np.concatenate(ids) if ids else np.empty(0, np.int64)
        self.owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        value = np.concatenate(weights) if weights else np.empty(0)
        norm = np.sqrt(np.bincount(self.owner, value**2, len(words)))
        self.value = value / np.maximum(norm, 1e-9)[self.owner]
        self.count = len(words)

    def times(self, table: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, self.value * table[self.gram], self.count)


def nystroem(grams: Subsequences, landmarks: Subsequences) -> np.ndarray:
    """Kernel values of all words to all landmarks."""
    known, place = np.unique(landmarks.gram, return_inverse=True)
    table = np.zeros((len(known), landmarks.count), np.float32)
    np.add.at(table, (place, landmarks.owner), landmarks.value)
    at = np.minimum(np.searchsorted(known, grams.gram), len(known) - 1)
    shared = np.flatnonzero(known[at] == grams.gram)
    shared = shared[np.argsort(grams.owner[shared], kind="stable")]
    out = np.zeros((grams.count, landmarks.count), np.float32)
    for low in range(0, len(shared), 50_000):
        part = shared[low : low + 50_000]
        owner = grams.owner[part]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        out[owner[first]] += np.add.reduceat(table[at[part]] * grams.value[part, None].astype(np.float32), first)
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-3, steps: int = 25) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps on the active rows."""
    x1 = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w = np.zeros(x1.shape[1])
    ridge = penalty * np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-9
    for _ in range(steps):
        active = y * (x1 @ w) < 1
        a = x1[active] * weight[active, None]
        new = np.linalg.solve(ridge + a.T @ x1[active], a.T @ y[active])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic curve (last: offset), with smoothed targets so that separable data stay finite."""
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), x.T @ (target - p) - 1e-3 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def summary(margins) -> tuple[float, float]:
    """The highest margin of a document and the mean of its ``TOP`` highest, missing words at ``LOWEST``."""
    top = ([max(m, LOWEST) for m in nlargest(TOP, margins)] + [LOWEST] * TOP)[:TOP]
    return top[0], sum(top) / TOP


Model = tuple[np.ndarray, float, np.ndarray]


def fit(bags: list[set[str]], labels: np.ndarray, seed: int = 11) -> Model:
    """Gram weights, their offset, and the curve from a document's margins to its score."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1 or not any(bag for bag, y in zip(bags, labels, strict=True) if y):
        # one class only, or no toxic text holds a word: there is nothing to learn
        constant = 30.0 if share == 1 else -30.0
        return np.zeros(TABLE, np.float32), LOWEST, np.array([0.0, 0.0, constant])
    rng = np.random.default_rng(seed)
    words = sorted({w for bag in bags for c in bag for w in word_of(c)})
    index = {w: i for i, w in enumerate(words)}
    own = [np.unique([index[w] for c in bag for w in word_of(c)]) if bag else np.empty(0, np.int64) for bag in bags]
    parts = range(0, len(words), WORDS_AT_ONCE)

    def times(*tables: np.ndarray) -> list[np.ndarray]:
        """Each table's value for every word, a part of the words at a time."""
        out = [np.empty(len(words), np.float32) for _ in tables]
        for low in parts:
            grams = Subsequences(words[low : low + WORDS_AT_ONCE])
            for o, t in zip(out, tables, strict=True):
                o[low : low + WORDS_AT_ONCE] = grams.times(t)
        return out

    # grams by how many toxic and clean documents hold them
    seen = np.zeros((2, TABLE), np.float32)
    for ids, y in zip(own, labels, strict=True):
        seen[y, np.unique(Subsequences([words[i] for i in ids]).gram)] += 1
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    # evidence of a gram: its log odds ratio over its standard error, without one toxic document, so that a word
    # that only its own document holds has none
    others = np.maximum(seen[1] - 1, 0)
    odds = np.log((others + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    evidence = odds / np.sqrt(1 / (others + 0.5) + 1 / (seen[0] + 0.5))
    score, size = times(evidence, np.ones(TABLE))
    score /= np.sqrt(np.maximum(1, size))
    proof = score.copy()
    table, offset = np.zeros(TABLE), 0.0
    positive_docs = [ids for ids, y in zip(own, labels, strict=True) if y == 1 and len(ids)]
    negative_docs = [ids for ids, y in zip(own, labels, strict=True) if y == 0 and len(ids)]
    clean_words = np.unique(np.concatenate(negative_docs)) if negative_docs else np.empty(0, np.int64)
    in_clean = np.zeros(len(words), bool)
    in_clean[clean_words] = True
    seen_in = np.bincount(np.concatenate([*positive_docs, np.empty(0, np.int64)]), minlength=len(words))
    # what clean documents reach by chance is no proof
    chance = np.array([proof[ids].max() for ids in negative_docs])
    least = float(np.quantile(chance, CLEAN_SHARE)) if len(chance) else 0.0
    if not any((proof[ids] > least).any() for ids in positive_docs):
        least = min(float(proof[ids].max()) for ids in positive_docs) - 1e-9 if positive_docs else 0.0
    for r in range(ROUNDS):
        proven = [ids[proof[ids] > least] for ids in positive_docs]
        best = {int(ids[np.argmax(score[ids])]) for ids in proven if len(ids)}
        best |= {int(i) for ids in proven for i in (ids[score[ids] > 0.3] if r else ids)}
        positive = np.array(sorted(i for i in best if not in_clean[i]) or sorted(best))
        hardest = np.unique([ids[np.argmax(score[ids])] for ids in negative_docs]) if negative_docs else clean_words
        sampled = rng.choice(clean_words, min(len(clean_words), 4000), replace=False) if len(clean_words) else clean_words
        negative = np.setdiff1d(np.union1d(hardest, sampled), positive)
        half = LANDMARKS // 2
        marks = np.concatenate([rng.permutation(positive)[:half], rng.permutation(negative)[: LANDMARKS - half]])
        weight = np.concatenate([np.sqrt(seen_in[positive]), np.ones(len(negative))])
        y = np.concatenate([np.ones(len(positive)), -np.ones(len(negative))])
        landmarks = Subsequences([words[i] for i in marks])
        k_zz = nystroem(landmarks, landmarks).astype(np.float64)
        values, vectors = np.linalg.eigh(k_zz)
        values = np.maximum(values, 1e-6)
        root = vectors / np.sqrt(values) @ vectors.T
        # positive words once more with a character put in
        changed = []
        for i in positive:
            at, what = int(rng.integers(1, max(2, len(words[i])))), INSERTED[int(rng.integers(len(INSERTED)))]
            changed.append(words[i][:at] + what + words[i][at:])
        x = np.vstack([nystroem(Subsequences([words[i] for i in positive]), landmarks), nystroem(Subsequences([words[i] for i in negative]), landmarks), nystroem(Subsequences(changed), landmarks)]) @ root
        y, weight = np.append(y, np.ones(len(changed))), np.append(weight, 0.5 * weight[: len(changed)])
        w, offset = svm(x, y, 0.5 * weight / np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum()))
        table = np.bincount(landmarks.gram, landmarks.value * (root @ w)[landmarks.owner], TABLE)
        score = times(table)[0] + offset
    curve = logistic(np.array([summary(score[ids]) for ids in own]), labels)
    return table.astype(np.float32), offset, curve


class ToxicScorer:
    """Log odds of texts; a worker process keeps the chunks it has met."""

    @classmethod
    def of(cls, *model) -> ToxicScorer:
        keep_only("quality", "toxicity")
        return kept("toxicity", xxhash.xxh3_64_hexdigest(model[0].tobytes() + str(model[1:]).encode()), lambda: cls(*model))

    def __init__(self, table: np.ndarray, offset: float, curve: np.ndarray):
        self.table, self.offset, self.curve = table, offset, curve
        self.cache: dict[str, float] = {}

    def _learn(self, new: set[str]) -> None:
        cache = self.cache
        pieces = {c: word_of(c) for c in new}
        words = [w for w in {w for p in pieces.values() for w in p} if w not in cache]
        for low in range(0, len(words), WORDS_AT_ONCE):
            part = words[low : low + WORDS_AT_ONCE]
            cache.update(zip(part, (Subsequences(part).times(self.table) + self.offset).tolist(), strict=True))
        for c, p in pieces.items():
            if c not in cache or len(p) > 1:
                cache[c] = max(map(cache.__getitem__, p))

    def margins_of(self, texts: list[str]) -> list[list[float]]:
        """For each text its few highest margins, one for each distinct chunk; new chunks of all texts are learnt at once."""
        if len(self.cache) > HELD_WORDS:
            self.cache.clear()
        found = [chunks_of(t) for t in texts]
        self._learn(set().union(*found).difference(self.cache))
        return [nlargest(TOP, map(self.cache.__getitem__, chunks)) for chunks in found]

    def log_odds(self, texts: list[str]) -> list[float]:
        return [float(np.dot([*summary(m), 1.0], self.curve)) for m in self.margins_of(texts)]


def toxicity_scorer(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> LogOdds:
    """Train on labelled rows whose crc32(doc_id) mod 3 is not 1."""
    bags, marks = [], []
    for row in label_rows(docs, labels, "toxic", 3, 1, max_rows, max_bytes).orderBy("doc_id", "text").toLocalIterator():
        bags.append(chunks_of(row["text"]))
        marks.append(row["label"])
    model = docs.sparkSession.sparkContext.broadcast(fit(bags, np.array(marks, np.int64)))
    bags.clear()
    release_memory()
    return lambda: ToxicScorer.of(*model.value).log_odds


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    return score_texts(docs, toxicity_scorer(docs, labels)).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % 3 == 1).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
