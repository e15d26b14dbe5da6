"""Exact top-k search by inner product with MaxScore.

A vector's dimensions are the terms of a query; a term's posting holds every vector's component. Components may
be negative, so a term's score is bounded from both sides by the query's component times the shard's least and
largest one. For each query, terms are ordered by how far their bounds lie apart. The first ones are essential:
their postings are traversed for all vectors. The rest, together, move a score by no more than their bounds
allow; they are probed one after the other, and only for vectors that can still reach the k-th best score.
Queries meet the vectors in blocks; every pair of a query block and a shard gives its k best, which are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ensspark.llm.common import landed, prepared, table

# Fixed values of the contract.
K = 10
SCALE = 1024
EVERY = 100

SHARD = 4096  # vectors of a shard
BLOCK = 256  # queries of a block
MOST_TASKS = 2000  # tasks that the shards are dealt to at most
ESSENTIAL = 0.6  # share of the bounds' width that essential terms cover
LIMIT = float(1 << 53)  # integers from here on travel as floating-point components, which are exact there
FITS = 1 << 61  # a bound of scores below this leaves room for the sums of MaxScore in 64 bits


def quantized(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """Ids and integer components of the vectors that take part; ``wide`` instead of ``x`` where a component passes 2^53."""
    x = F.transform(F.col(vector), lambda c: F.floor(c.cast("double") * SCALE))
    finite = F.forall(F.col(vector), lambda c: F.coalesce(~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")), F.lit(False)))
    small = F.forall(F.col(vector), lambda c: F.abs(c.cast("double")) * SCALE < LIMIT)
    wide = F.transform(F.col(vector), lambda c: c.cast("double"))
    kept = rows.where(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite)
    return kept.select(F.col(key).cast("long").alias("id"), F.when(small, x).alias("x"), F.when(~small, wide).alias("wide"))


def _shorts(rows: list) -> np.ndarray:
    """Vectors as the rows of a matrix, shorter ones filled with zeros."""
    width = max(map(len, rows), default=0)
    out = np.zeros((len(rows), width), dtype=np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def maxscore(query: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores of a query in a shard and their ids; ``columns`` has a row for each dimension."""
    width = min(len(query), len(columns))
    a, b = query[:width] * low[:width], query[:width] * high[:width]
    least, most = np.minimum(a, b), np.maximum(a, b)
    order = np.argsort(least - most, kind="stable")
    least, most = least[order], most[order]
    rest_most = np.concatenate((np.cumsum(most[::-1])[::-1], [0]))
    rest_least = np.concatenate((np.cumsum(least[::-1])[::-1], [0]))
    spread = np.cumsum(most - least)
    essential = int(np.searchsorted(spread, ESSENTIAL * spread[-1])) + 1 if width and spread[-1] else width
    alive = np.flatnonzero(ids != own)
    score = query[order[:essential]] @ columns[order[:essential]][:, alive]
    for t in range(essential, width + 1):
        if len(alive) > k:  # the k-th best of what is certain bounds the result from below
            certain = score + rest_least[t]
            edge = np.partition(certain, len(certain) - k)[len(certain) - k]
            keep = score + rest_most[t] >= edge
            alive, score = alive[keep], score[keep]
        if t < width:
            score = score + query[order[t]] * columns[order[t], alive]
    best = np.lexsort((ids[alive], -score))[:k]
    return score[best], ids[alive][best]


def _integer(c: float) -> int:
    """floor(SCALE * c), exact however large."""
    return int(c) * SCALE if abs(c) * SCALE >= LIMIT else math.floor(c * SCALE)


class Wide:
    """Vectors of any magnitude: Python integers, and floating-point approximations below 1 to choose by."""

    def __init__(self, rows: pa.StructArray):
        x, wide = rows.field("x"), rows.field("wide")
        self.integers = [x[i].as_py() if x[i].is_valid else [_integer(c) for c in wide[i].as_py()] for i in range(len(rows))]
        largest = max((abs(c) for r in self.integers for c in r), default=0).bit_length()
        width = max(map(len, self.integers), default=0)
        self.near = np.array([[_ratio(c, largest) for c in r] + [0.0] * (width - len(r)) for r in self.integers], dtype=np.float64).reshape(len(rows), width)


def _ratio(c: int, bits: int) -> float:
    """c / 2^bits, also where c itself is no float."""
    return c / (1 << bits)


def exact(query: list[int], near: np.ndarray, own: int, ids: np.ndarray, shard: Wide, k: int) -> tuple[list[int], np.ndarray]:
    """As ``maxscore``, where scores may pass 64 bits: what can be among the best by its error bound is scored in Python integers."""
    width = min(len(near), shard.near.shape[1])
    alive = np.flatnonzero(ids != own)
    columns = shard.near[alive, :width]
    score = columns @ near[:width]
    error = (width + 4) * 2.0**-51 * (np.abs(columns) @ np.abs(near[:width])) + (width + 1) * 1e-300
    if len(alive) > k:
        certain = score - error
        alive = alive[score + error >= np.partition(certain, len(alive) - k)[len(alive) - k]]
    found = sorted((-sum(a * b for a, b in zip(query, shard.integers[i], strict=False)), int(ids[i])) for i in alive.tolist())[:k]
    return [-s for s, _ in found], np.array([i for _, i in found], dtype=np.int64)


def _beyond(score: int) -> bytes:
    """Orders scores that 64 bits do not hold below or above all others, and among themselves."""
    if -(1 << 63) <= score < 1 << 63:
        return b"\1"
    size = (abs(score).bit_length() + 7) // 8
    data = size.to_bytes(4, "big") + abs(score).to_bytes(size, "big")
    return b"\2" + data if score > 0 else b"\0" + bytes(255 - c for c in data)


def packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors in blocks of about the same number, dealt by hash."""
    n = max(1, -(-rows.count() // size))
    dealt = rows.select("id", "x", "wide", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n)).cast("int").alias(name))
    return dealt.groupBy(name).agg(F.collect_list(F.struct("id", "x", "wide")).alias(f"{name}_rows"))


def _paired(blocks: DataFrame, shards: DataFrame, last: int) -> DataFrame:
    """Every block beside every shard. Dealt by shard and merged: the copies of the blocks grow with blocks times shards, which
    the optimizer's size check does not see, so it would broadcast them. The number of tasks follows the shards, not their bytes."""
    copies = blocks.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(last))))
    tasks = min(4 * (last + 1), MOST_TASKS)  # more than shards, so that few meet by their hash
    return copies.repartition(tasks, "shard").hint("merge").join(shards.repartition(tasks, "shard"), "shard")


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k best vectors, ties to the smaller id.

    Vectors that are null or hold null, NaN or infinite components take no part, neither do rows without an id.
    Ranks are exact for components of any size; a score that 64 bits do not hold is null. Rows with the query's id are no candidates of it; rows that repeat
    another id count each, those that repeat a query's id are one query. Missing dimensions count as zero. A query without candidates has no rows; other
    columns are ignored. A block is bounded, whatever the number of vectors.
    """
    shards = packed(landed(quantized(vectors, key, vector), "topk-vectors"), SHARD, "shard")
    blocks = packed(landed(quantized(queries, key, vector).dropDuplicates(["id"]), "topk-queries"), BLOCK, "block")
    shards = landed(shards, "topk-shards")
    last = shards.agg(F.max("shard")).first()[0]
    pairs = _paired(blocks, shards, last or 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, shard in zip(batch[0], batch[1], strict=True):
                rows, wanted = shard.values, block.values
                ids, owners = rows.field("id").to_numpy(), wanted.field("id").to_numpy()
                large = rows.field("x").null_count or wanted.field("x").null_count
                if not large:
                    columns, asked = np.ascontiguousarray(_matrix(rows.field("x")).T), _matrix(wanted.field("x"))
                    low, high = columns.min(axis=1), columns.max(axis=1)
                    large = min(len(columns), asked.shape[1]) * int(np.abs(columns).max(initial=0)) * int(np.abs(asked).max(initial=0)) >= FITS
                if large:
                    held, asked = Wide(rows), Wide(wanted)
                    found = [exact(q, near, own, ids, held, k) for q, near, own in zip(asked.integers, asked.near, owners, strict=True)]
                else:
                    found = [maxscore(q, own, ids, columns, low, high, k) for q, own in zip(asked, owners, strict=True)]
                count = [len(s) for s, _ in found]
                scores = [int(x) for s, _ in found for x in s]
                beyond = [_beyond(x) for x in scores]
                scores = [x if o == b"\1" else None for x, o in zip(scores, beyond, strict=True)]
                arrays = [np.repeat(owners, count), np.concatenate([i for _, i in found]).astype(np.int64)]
                arrays = [*map(pa.array, arrays), pa.array(scores, pa.int64()), pa.array(beyond, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score", "beyond"])

    best = pairs.select("block_rows", "shard_rows").mapInArrow(run, "query_id long, vec_id long, score long, beyond binary")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("beyond").desc(), F.col("score").desc(), "vec_id"))
    return best.select("query_id", place.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _matrix(x: pa.ListArray) -> np.ndarray:
    offsets = x.offsets.to_numpy()
    width = np.diff(offsets)
    flat = x.values.to_numpy()[offsets[0] : offsets[-1]] if len(x) else np.zeros(0, np.int64)
    if len(x) and (width == width[0]).all():
        return flat.reshape(len(x), width[0])
    return _shorts([v.as_py() for v in x])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best vectors for every query vector (ids divisible by 100)."""
    vectors = table(prepared(spark), sf_dir, "embeddings", "vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % EVERY == 0))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""
