"""Nearest neighbours by inner product with randomly rotated one-bit codes.

A vector, less the mean, is turned by a random rotation; the signs of its parts
are its code, and two numbers (its length, and how well the signs stand for it)
correct the estimate of an inner product. The estimate has a known error bound:
only vectors whose upper bound reaches the k-th lower bound are looked at again,
by the exact inner product of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stopwise.llm.common import pick, stored

BLOCK = 8192  # vectors of a block
QUERY_BLOCK = 1024  # queries of a block
BOUND = 3.0  # standard errors that the bounds allow for
SEED = 11


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, mean: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths and correction factors of ``vectors``."""
    turned = (vectors - mean) @ turn.T
    length = np.linalg.norm(turned, axis=1)
    held = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    factor = np.divide(held, length, out=np.ones_like(length), where=length > 0)
    return np.packbits(turned > 0, axis=1), length, factor


def estimate(codes, length, factor, queries, mean, turn):
    """Estimated inner products (query by vector) and the standard error of each."""
    size = turn.shape[0]
    signs = np.unpackbits(codes, axis=1, count=size).astype(np.float32) * 2 - 1
    turned = (queries @ turn.T).astype(np.float32)
    scale = (length / factor / np.sqrt(size)).astype(np.float32)
    about = (turned @ signs.T) * scale + (queries @ mean)[:, None].astype(np.float32)
    spread = length * np.sqrt(np.maximum(0, 1 - factor**2)) / factor / np.sqrt(max(1, size - 1))
    return about, np.linalg.norm(queries, axis=1)[:, None] * spread[None, :]


def search_block(ids, rows, vectors, codes, length, factor, query_rows, queries, mean, turn, k, bound=BOUND):
    """(query position, vector position, score) of each query's best ``k`` of a block,
    by exact score, then smaller id; a query's own row is left out."""
    about, error = estimate(codes, length, factor, queries, mean, turn)
    own = query_rows[:, None] == rows[None, :]
    low = np.where(own, -np.inf, about - bound * error)
    high = np.where(own, -np.inf, about + bound * error)
    if low.shape[1] > k:
        least = -np.partition(-low, k - 1, axis=1)[:, k - 1]
    else:
        least = np.full(len(queries), -np.inf)
    found = []
    for q in range(len(queries)):
        near = np.flatnonzero((high[q] >= least[q]) & ~own[q])
        scores = vectors[near] @ queries[q]
        best = np.lexsort((ids[near], -scores))[:k]
        found.append((np.full(len(best), q), near[best], scores[best]))
    return tuple(np.concatenate(c) if found else np.zeros(0) for c in zip(*found, strict=True))


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", seed: int = SEED) -> DataFrame:
    """``row, key, vector`` (doubles), ``code`` (packed bits), ``length, factor`` and
    ``mean`` of every usable row, written once.

    Null or zero vectors, and such with null or non-finite components, take no part;
    of several dimensions the most frequent counts, the larger of equal ones. The
    mean is that of all usable rows. Repeated rows and null keys are rows of their own.
    """
    plain = pick(df, key=key, vector=vector).select(
        F.monotonically_increasing_id().alias("row"), F.col("key").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector")
    )
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    fine = plain.filter(F.col("vector").isNotNull() & ~bad & F.exists("vector", lambda x: x != 0))
    sizes = fine.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"))
    most = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    schema = "row long, key long, vector array<double>, code binary, length double, factor double"
    if most is None:
        return df.sparkSession.createDataFrame([], schema + ", mean array<double>")
    size = most["size"]
    fine = fine.filter(F.size("vector") == size)
    means = fine.select(F.posexplode("vector").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    mean = np.array([r["x"] for r in means.orderBy("i").collect()])
    turn = rotation(size, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                vectors = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
                codes, length, factor = encode(vectors, mean, turn)
                packed = pa.array([c.tobytes() for c in codes], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, packed, pa.array(length), pa.array(factor)],
                    names=["row", "key", "vector", "code", "length", "factor"],
                )

    index = fine.mapInArrow(run, schema)
    return stored(index.withColumn("mean", F.array(*[F.lit(float(m)) for m in mean])))


def search(index: DataFrame, queries: DataFrame, k: int = 20, bound: float = BOUND, seed: int = SEED) -> DataFrame:
    """``query_row, query_id, rank, vec_id, score`` of each query's ``k`` nearest rows of
    ``index``, its own row left out; all, if there are fewer. Equal scores go to the
    smaller id, null ids last.

    ``queries`` are rows of ``index``. Both sides are dealt into blocks of bounded
    size by a hash of the row, and every block of queries meets every block of
    vectors in a row of its own, spread over all tasks; a block gives ``k`` rows a
    query at most. The bound misses a neighbour with a chance of about 0.1 % each.
    """
    first = index.select("mean").first()
    if first is None:
        schema = "query_row long, query_id long, rank int, vec_id long, score double"
        return index.sparkSession.createDataFrame([], schema)
    mean = np.array(first["mean"])
    size, turn = len(mean), rotation(len(mean), seed)
    blocks = max(1, -(-index.count() // BLOCK))
    query_blocks = max(1, -(-queries.count() // QUERY_BLOCK))

    def numbered(rows: DataFrame, n: int, name: str) -> DataFrame:
        return rows.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))

    def listed(*columns: str) -> list:
        return [F.collect_list(F.struct(*columns)).alias("held")]

    vectors = (
        numbered(index, blocks, "block")
        .groupBy("block")
        .agg(*listed("row", "key", "vector", "code", "length", "factor"))
        .withColumn("query_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    )
    asked = (
        numbered(queries, query_blocks, "query_block")
        .groupBy("query_block")
        .agg(F.collect_list(F.struct("row", "key", "vector")).alias("asked"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                yield _searched(batch.column(0)[at].values, batch.column(1)[at].values, mean, turn, size, k, bound)

    met = vectors.join(asked, ["block", "query_block"]).select("held", "asked")
    found = met.mapInArrow(run, "query_row long, query_id long, vec_id long, score double")
    line = Window.partitionBy("query_row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    ranked = found.withColumn("rank", F.row_number().over(line)).filter(F.col("rank") <= k)
    return ranked.select("query_row", "query_id", "rank", "vec_id", "score")


def _doubles(struct: pa.StructArray, name: str, size: int) -> np.ndarray:
    return struct.field(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _searched(held, asked, mean, turn, size, k, bound) -> pa.RecordBatch:
    rows = held.field("row").to_numpy(zero_copy_only=False)
    keys = held.field("key")
    # A null id comes after all others.
    ids = keys.fill_null(2**63 - 1).to_numpy(zero_copy_only=False)
    codes = np.frombuffer(b"".join(held.field("code").to_pylist()), np.uint8).reshape(len(rows), -1)
    length, factor = (held.field(n).to_numpy(zero_copy_only=False) for n in ("length", "factor"))
    vectors = _doubles(held, "vector", size)
    query_rows = asked.field("row").to_numpy(zero_copy_only=False)
    queries = _doubles(asked, "vector", size)
    out = [[], [], []]
    for at in range(0, len(queries), 128):
        part = slice(at, at + 128)
        q, v, s = search_block(ids, rows, vectors, codes, length, factor, query_rows[part], queries[part], mean, turn, k, bound)
        for column, values in zip(out, (q + at, v, s), strict=True):
            column.append(values)
    q, v, s = (np.concatenate(c) for c in out)
    q, v = q.astype(np.int64), v.astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(query_rows[q]), asked.field("key").take(pa.array(q)), keys.take(pa.array(v)), pa.array(s.astype(np.float64))],
        names=["query_row", "query_id", "vec_id", "score"],
    )
