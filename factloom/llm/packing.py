"""Bounded-space online best-fit packing of token sequences.

Documents longer than a sequence are cut into full pieces, which fill sequences of their own; all other
pieces go to open bins. A packer keeps a fixed number of open bins in a bitset keyed by free space: a piece
goes to the open bin with the least sufficient space, a bin without space closes, and when one bin too many
is open the fullest closes first. Each partition packs its own pieces as they arrive, in a pseudo-random
order; it looks ``WINDOW`` pieces ahead and places the longest of them first. So memory is bounded by
``open_bins`` and the window, no partition is sorted by length, and a lost task repeats its work on the same
rows. Pieces are dealt to partitions by their place in the input, not by a key, so no document and no group of
copies is one task's work.

Defined cases: null or empty text is one piece of one token (the end mark); repeated doc_ids are packed as
rows of their own; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_only, kept, texts

CAPACITY = 2048
OPEN_BINS = 1024
WINDOW = 1024
CACHED_WORDS = 400_000


class BestFit:
    """Online packer: ``place(length)`` returns (bin, offset)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS):
        self.capacity, self.open_bins, self.made, self.open = capacity, open_bins, 0, 0
        self.bits = 0  # bit s is set when a bin with s free places is open
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.bits &= ~(1 << space)
        return found

    def place(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            found = self._take(space)
        else:
            space, found = self.capacity, self.made
            self.made += 1
            self.open += 1
        if left := space - length:
            self.bins[left].append(found)
            self.bits |= 1 << left
            if self.open > self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.open -= 1
        else:
            self.open -= 1
        return found, self.capacity - space


class WordTokenizer:
    """Whole-text ids through a cache of chunks between blanks.

    The tokenizer lower-cases, drops white space and never joins text across it, so the ids of a text are
    those of its chunks, one after another; a word and the comma or stop after it are apart as well. Only
    blanks and line ends are cut here; the tokenizer treats any other white space inside a chunk itself. A
    worker keeps its cache from task to task. A full cache, of ``CACHED_WORDS`` chunks, becomes the old one, from which chunks
    that are still met are taken over, so memory is bounded and frequent chunks are never encoded again.
    """

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        keep_only("tokenizer")
        return kept("tokenizer", path, lambda: cls(path))

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.cache: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _learn(self, chunks: set[str]) -> None:
        cache, old = self.cache, self.old
        known = [c for c in chunks if c in old]
        cache.update((c, old[c]) for c in known)
        chunks.difference_update(known)
        stems = {c[:-1] if c[-1:] in (",", ".") and c[:-1].isalpha() else c for c in chunks}
        new = [c for c in stems | {",", "."} if c not in cache]
        for c, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            ids = e.ids
            cache[c] = struct.pack(f"<{len(ids)}I", *ids)
        for c in chunks:
            if c not in cache:
                cache[c] = cache[c[:-1]] + cache[c[-1]]

    def encode_packed(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids. A text that spells out one of the vocabulary's special tokens is encoded whole."""
        if any(t in text for t in self.special):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        chunks = text.encode().lower().decode().replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            pass
        if len(self.cache) > CACHED_WORDS:
            self.cache, self.old = {}, self.cache
        self._learn({c for c in chunks if c not in self.cache})
        return b"".join(map(self.cache.__getitem__, chunks))


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of each document's ids followed by the end mark 0."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTokenizer.of(vocabulary)
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packed = words.encode_packed(text.as_py()) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(packed), 4 * capacity)):
                    piece = packed[at : at + 4 * capacity]
                    out.append((doc, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                ["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return texts(docs).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(items: DataFrame, length_col: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, window: int = WINDOW) -> DataFrame:
    """``items`` plus ``sequence_id`` and ``offset``; lengths must be 1 to ``capacity``. Rows of a partition are placed as they come, ``window``
    at a time, the longest first."""
    schema = items.schema

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        packer = BestFit(capacity, open_bins)
        for batch in batches:
            lengths = batch.column(batch.schema.get_field_index(length_col)).to_pylist()
            places: list[tuple[int, int]] = [(0, 0)] * len(lengths)
            for low in range(0, len(lengths), window):
                for i in sorted(range(low, min(low + window, len(lengths))), key=lengths.__getitem__, reverse=True):
                    places[i] = packer.place(lengths[i])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([base + b for b, _ in places], pa.int64()), pa.array([o for _, o in places], pa.int64())],
                [*batch.schema.names, "sequence_id", "offset"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    return items.mapInArrow(fit, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Tokenize, cut and pack ``docs``; one row per piece."""
    cut = pieces(docs, vocabulary or tokenizer_path(), capacity).withColumn("_at", F.monotonically_increasing_id())
    spread = cut.repartition("_at").sortWithinPartitions(F.xxhash64("_at"))
    return pack(spread, "length", capacity, open_bins).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
