"""Embeddings by feature hashing and exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.functions.text import strip

DIM = 384
MODEL = "hash-384"


def embedding_text() -> Column:
    """Entity, attribute, value and period of a fact, blanks left out."""
    return F.concat_ws(" ", *[F.nullif(strip(F.col(c)), F.lit("")) for c in ("canonical_entity", "canonical_attribute", "canonical_value", "period")])


def text_hash(text: Column, model: str = MODEL) -> Column:
    return F.sha2(F.concat(F.lit(model + "\n"), text), 256)


def _slot(digest: Column, first_byte: int) -> Column:
    """Four little-endian bytes of a hex digest as a slot."""
    byte = lambda k: F.substring(digest, 2 * (first_byte + k) + 1, 2)
    return F.pmod(F.conv(F.concat(byte(3), byte(2), byte(1), byte(0)), 16, 10).cast("long"), F.lit(DIM)).cast("int")


def slots(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Adds slot_a (weight 1) and slot_b (weight 0.5) of each token."""
    digest = F.md5(F.col(token).cast("binary"))
    return tokens.withColumns({"slot_a": _slot(digest, 0), "slot_b": _slot(digest, 4)})


def hash_embed(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, embedding): hashed token counts, normalised. Sums are taken per (id, slot), never over a whole vector in one row."""
    tokens = slots(texts.select(id_col, F.explode(F.split(F.lower(strip(F.col(text_col))), r"(?U)\s+")).alias("token")).where("token <> ''"))
    parts = tokens.select(id_col, F.explode(F.array(F.struct(F.col("slot_a").alias("s"), F.lit(1.0).alias("w")), F.struct(F.col("slot_b").alias("s"), F.lit(0.5).alias("w")))).alias("p"))
    sums = parts.groupBy(id_col, F.col("p.s").alias("s")).agg(F.sum("p.w").alias("w"))
    entries = sums.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("s", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(DIM - 1)), lambda i: (F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.col("norm")).cast("float"))
    return texts.select(id_col).distinct().join(entries, id_col, "left").select(id_col, F.when(F.col("m").isNotNull(), vector).otherwise(F.array_repeat(F.lit(0.0).cast("float"), DIM)).alias("embedding"))


def _texts(facts: DataFrame, model: str) -> DataFrame:
    return facts.select(F.col("id").alias("fact_id"), embedding_text().alias("_text")).withColumn("text_hash", text_hash(F.col("_text"), model))


def changed_embeddings(facts: DataFrame, stored: DataFrame | None = None, model: str = MODEL, embed: Callable[[DataFrame, str, str], DataFrame] = hash_embed) -> DataFrame:
    """fact_id, model, dim, text_hash, embedding of the facts without a stored vector of that model for their present text. ``embed`` takes
    texts, an id and a text column, and gives (id, embedding)."""
    t = _texts(facts, model)
    todo = t if stored is None else t.join(stored.where(F.col("model") == model).select("fact_id", "text_hash"), ["fact_id", "text_hash"], "left_anti")
    return embed(todo, "fact_id", "_text").join(todo, "fact_id").select("fact_id", F.lit(model).alias("model"), F.size("embedding").alias("dim"), "text_hash", "embedding")


def embed_facts(facts: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """fact_id, model, dim, text_hash, embedding; facts whose text is unchanged keep their stored rows, of other models too."""
    new = changed_embeddings(facts, stored)
    if stored is None:
        return new
    return stored.join(new.select("fact_id", "model"), ["fact_id", "model"], "left_anti").join(facts.select(F.col("id").alias("fact_id")), "fact_id", "left_semi").unionByName(new)


def as_blob(c: Column) -> Column:
    """Little-endian 32-bit floats, one after another."""
    return _to_blob(c.cast("array<float>"))


@F.pandas_udf(T.BinaryType())
def _to_blob(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


def from_blob(c: Column, dim: int = DIM) -> Column:
    """The vector of a blob, padded with zeros or cut to ``dim`` and of unit length; a zero vector stays."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def read(blobs: pd.Series) -> pd.Series:
        def one(blob: bytes | None):
            if blob is None:
                return None
            have = np.frombuffer(blob[: len(blob) // 4 * 4], "<f4")[:dim]
            out = np.zeros(dim, np.float32)
            out[: len(have)] = have
            return out / (np.linalg.norm(out) or np.float32(1))

        return blobs.map(one)

    return read(c)


def embed_with(texts: DataFrame, id_col: str, text_col: str, make_model: Callable[[], Callable[[list[str]], np.ndarray]]) -> DataFrame:
    """(id, embedding) by any model: ``make_model()`` runs on the executors and gives a function from texts to a matrix."""
    kind = texts.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        for b in batches:
            yield pd.DataFrame({id_col: b[id_col], "embedding": [np.asarray(v, np.float32) for v in model(b[text_col].fillna("").tolist())]})

    return texts.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, embedding array<float>")


QUERY_BLOCK, VECTOR_BLOCK = 2048, 65_536
VECTORS_AT_ONCE = 1024  # that meet a block of queries, so that similarities held at once are QUERY_BLOCK x VECTORS_AT_ONCE


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", k: int = 5) -> DataFrame:
    """Exact inner-product neighbours of each query, itself left out: (query_id, id, similarity, rank). Similarities are
    rounded to nine places, so that equal vectors tie, and ties go by id. Of rows that share a query id one is asked.

    Both sides are dealt to blocks of about ``QUERY_BLOCK`` queries and ``VECTOR_BLOCK`` vectors, and a task multiplies one block of each: it
    holds the queries, which come first, as a matrix, streams the vectors past them and keeps the ``k`` best. Only those
    are shuffled again. Nothing passes through the driver but two counts; all vectors may be queries, at the cost of
    sending every vector to each block of queries.
    """
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).alias("id"), "embedding").where("id is not null and embedding is not null")
    q = queries.select(F.col(id_col).alias("id"), "embedding").where("id is not null and embedding is not null").dropDuplicates(["id"])
    kind = v.schema["id"].dataType.simpleString()
    schema = f"query_id {kind}, id {kind}, similarity double"
    n_q, n_v = q.count(), v.count()
    wide = max(1, -(-n_q // QUERY_BLOCK))
    deep = max(1, -(-n_v // VECTOR_BLOCK), -(-min(spark.sparkContext.defaultParallelism, n_v // 256) // wide))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(deep)).cast("int")  # by place: many rows of one id are no single task's work
    asked = q.select("id", "embedding", F.lit(0).alias("side"), F.pmod(F.xxhash64("id"), F.lit(wide)).cast("int").alias("g"), F.explode(F.sequence(F.lit(0), F.lit(deep - 1))).alias("p"))
    met = v.select("id", "embedding", F.lit(1).alias("side"), dealt.alias("p")).select("id", "embedding", "side", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))).alias("g"), "p")
    cells = asked.unionByName(met).repartition(wide * deep, "g", "p").sortWithinPartitions("g", "p", "side").select("g", "p", "side", "id", "embedding")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return cells.mapInArrow(_best(k), schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "id", "similarity", "rank")


def _unit(rows: pa.Array) -> np.ndarray:
    m = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    n = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(n > 0, n, 1.0)


def _ids(column: pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), str) if pa.types.is_string(column.type) else column.to_numpy(zero_copy_only=False)


class _Cell:
    """One block of queries, and the best of the vectors that have passed."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.place = {i: n for n, i in enumerate(ids.tolist())}
        self.near: np.ndarray | None = None
        self.similar = np.empty((len(ids), 0))

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        s = np.round(self.queries @ vectors.T, 9)
        own = [(self.place[i], n) for n, i in enumerate(ids.tolist()) if i in self.place]
        if own:
            s[tuple(zip(*own, strict=True))] = -np.inf
        order = np.argsort(ids, kind="stable")  # ties go by id
        top = order[np.argsort(-s[:, order], axis=1, kind="stable")[:, : self.k]]
        near, similar = ids[top], np.take_along_axis(s, top, 1)
        if self.near is not None:
            near, similar = np.concatenate([self.near, near], 1), np.concatenate([self.similar, similar], 1)
        row = np.repeat(np.arange(len(near)), near.shape[1])
        keep = np.lexsort((near.ravel(), -similar.ravel(), row)).reshape(near.shape)[:, : self.k]
        self.near, self.similar = near.ravel()[keep], similar.ravel()[keep]

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.near is not None:
            good = np.isfinite(self.similar).ravel()
            asked = np.repeat(self.ids, self.near.shape[1])[good]
            yield pa.RecordBatch.from_arrays([pa.array(asked.tolist()), pa.array(self.near.ravel()[good].tolist()), pa.array(self.similar.ravel()[good])], ["query_id", "id", "similarity"])


def _best(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell, asked = None, None, []
        for batch in batches:
            g, p, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids = _ids(batch.column(3))
            cuts = [0, *(np.flatnonzero((np.diff(g) != 0) | (np.diff(p) != 0) | (np.diff(side) != 0)) + 1).tolist(), batch.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if low == high:
                    continue
                if at != (g[low], p[low]):
                    if cell:
                        yield from cell.rows()
                    at, cell, asked = (g[low], p[low]), None, []
                for start in range(low, high, VECTORS_AT_ONCE):
                    stop = min(start + VECTORS_AT_ONCE, high)
                    rows = _unit(batch.column(4).slice(start, stop - start))
                    if side[low] == 0:
                        asked.append((ids[start:stop], rows))
                    elif asked:
                        cell = cell or _Cell(np.concatenate([i for i, _ in asked]), np.concatenate([m for _, m in asked]), k)
                        cell.meet(ids[start:stop], rows)
        if cell:
            yield from cell.rows()

    return run
