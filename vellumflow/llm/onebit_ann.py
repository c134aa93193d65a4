"""Nearest neighbours by inner product from randomly rotated one-bit codes.

The index holds, for every vector, the signs of its rotated residual packed
into bytes and two correction scalars: the residual's length and its inner
product with its own code.  From a query quantised to ``QUERY_BITS`` bit planes,
popcounts estimate every inner product; the scalars give an error bound that
holds with high probability (``EPSILON`` standard deviations).  A query's best
estimates are computed exactly first; every candidate whose estimate plus
bound reaches the k-th exact score is then reranked on the original vectors.

Queries and rows meet block by block (a stated query set against all rows), so
memory is bounded by a block pair and the final merge sees k rows per block.

Defined results: rows with null vec_id, and vectors that are null, zero, or
hold null or non-finite components, take no part; vectors of another length
than the query's are not its candidates; of rows that repeat a vec_id the
smallest vector counts; ties go to the smaller vec_id; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import prepare, staged

EPSILON = 3.0
QUERY_BITS = 6
ROW_BLOCK, QUERY_BLOCK = 16_384, 2_048


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(dim).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(rows: DataFrame) -> DataFrame:
    """Rows that take part: vec_id, dim, vector."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0))
    return kept.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("embedding").alias("vector")).withColumn("dim", F.size("vector"))


def centres(rows: DataFrame) -> dict[int, np.ndarray]:
    """Mean vector of every length; partial sums a task."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for v in b.column("vector").to_pylist():
                v = np.append(np.asarray(v, np.float64), 1.0)
                total[len(v) - 1] = total[len(v) - 1] + v if len(v) - 1 in total else v
        yield pa.RecordBatch.from_pylist([{"dim": d, "at": i, "x": float(x)} for d, v in total.items() for i, x in enumerate(v)], schema=pa.schema([("dim", pa.int32()), ("at", pa.int32()), ("x", pa.float64())]))

    found = rows.select("vector").mapInArrow(run, "dim int, at int, x double").groupBy("dim", "at").agg(F.sum("x").alias("x")).toPandas().sort_values(["dim", "at"])
    return {int(d): g["x"].to_numpy()[:-1] / g["x"].to_numpy()[-1] for d, g in found.groupby("dim")}


def index(rows: DataFrame) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Every usable vector with its packed code and correction scalars, staged; and the centres."""
    prepare(rows.sparkSession, 4096)
    kept = staged(usable(rows), "vectors")
    centre = centres(kept)

    def run(batches):
        for b in batches:
            codes, length, own = [], [], []
            for v in b.column("vector").to_pylist():
                r = np.asarray(v, np.float64) - centre[len(v)]
                size = float(np.linalg.norm(r))
                o = rotation(len(v)) @ (r / size if size else r)
                codes.append(np.packbits(o > 0).tobytes())
                length.append(size)
                own.append(float(np.abs(o).sum() / np.sqrt(len(v))) if size else 1.0)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("dim"), b.column("vector"), pa.array(codes, pa.binary()), pa.array(length), pa.array(own)], ["vec_id", "dim", "vector", "code", "length", "own"])

    vector = kept.schema["vector"].dataType.simpleString()
    return staged(kept.select("vec_id", "dim", "vector").mapInArrow(run, f"vec_id long, dim int, vector {vector}, code binary, length double, own double"), "codes"), centre


def _packed(codes: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of 64-bit words."""
    width = -(-codes.shape[1] // 8) * 8
    return np.ascontiguousarray(np.pad(codes, ((0, 0), (0, width - codes.shape[1])))).view(np.uint64)


def exact_scores(query: np.ndarray, columns: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of a query with some rows of a table that is given by columns, summed component by component in order."""
    total = np.zeros(len(rows))
    for x, column in zip(query.tolist(), columns, strict=True):
        total += x * column[rows]
    return total


def search_block(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, codes: np.ndarray, length: np.ndarray, own: np.ndarray, centre: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of the block for every query: positions of queries and rows, and exact scores.  ``vectors`` has a row for each component."""
    dim = queries.shape[1]
    words = _packed(codes)
    columns = [np.ascontiguousarray(words[:, k]) for k in range(words.shape[1])]
    spread = np.sqrt(np.maximum(1 - own**2, 0)) / own / np.sqrt(max(dim - 1, 1))
    rotated = queries @ rotation(dim).T
    low, high = rotated.min(axis=1), rotated.max(axis=1)
    step = np.maximum(high - low, 1e-30) / (2**QUERY_BITS - 1)
    levels = np.round((rotated - low[:, None]) / step[:, None]).astype(np.uint8)
    rest = np.linalg.norm(rotated - (levels * step[:, None] + low[:, None]), axis=1)
    norms = np.linalg.norm(queries, axis=1)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)
    planes = [_packed(np.packbits((levels >> j) & 1, axis=1)) for j in range(QUERY_BITS)]
    sums = levels.sum(axis=1, dtype=np.int64)
    shift = queries @ centre
    order = np.argsort(ids, kind="stable")
    sorted_ids = ids[order]
    out_q, out_r, out_s = [], [], []
    for i in range(len(queries)):
        dots = np.zeros(len(words), np.int64)
        for j, plane in enumerate(planes):
            for at, word in enumerate(columns):
                dots += np.left_shift(np.bitwise_count(word & plane[i, at]), j, dtype=np.int64)
        # <code, q> with code signs +-1/sqrt(dim) and q = low + step * level
        signed = (step[i] * (2 * dots - sums[i]) + low[i] * (2 * ones - dim)) / np.sqrt(dim)
        estimate = length * (signed / own) + shift[i]
        bound = length * (EPSILON * spread * norms[i] + rest[i] / own)
        p = np.searchsorted(sorted_ids, query_ids[i])
        if p < len(ids) and sorted_ids[p] == query_ids[i]:
            estimate[order[p]] = -np.inf
        if len(estimate) > 2 * k:
            first = np.argpartition(-estimate, 2 * k - 1)[: 2 * k]
            best = exact_scores(queries[i], vectors, first)
            best[estimate[first] == -np.inf] = -np.inf
            floor = np.partition(best, len(best) - k)[len(best) - k]
            rerank = np.flatnonzero(estimate + bound >= floor)
        else:
            rerank = np.flatnonzero(estimate > -np.inf)
        score = exact_scores(queries[i], vectors, rerank)
        top = np.lexsort((ids[rerank], -score))[:k]
        out_q.append(np.full(len(top), i))
        out_r.append(rerank[top])
        out_s.append(score[top])
    return np.concatenate(out_q), np.concatenate(out_r), np.concatenate(out_s)


def nearest(rows: DataFrame, every: int, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for every row whose vec_id is divisible by ``every``."""
    coded, centre = index(rows)
    queries = coded.where(F.col("vec_id") % every == 0).select("vec_id", "dim", "vector")
    row_blocks, query_blocks = max(1, -(-coded.count() // ROW_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    shared = rows.sparkSession.sparkContext.broadcast(centre)
    block = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = coded.withColumn("rb", block(row_blocks, "r")).withColumn("qb", every_block(query_blocks))
    right = queries.withColumn("qb", block(query_blocks, "q")).withColumn("rb", every_block(row_blocks))

    def run(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        dim = int(rows["dim"].iloc[0])
        codes = np.frombuffer(b"".join(rows["code"]), np.uint8).reshape(len(rows), -1)
        vectors = np.ascontiguousarray(np.stack(rows["vector"].to_numpy()).astype(np.float64).T)
        wanted = np.stack(asked["vector"].to_numpy()).astype(np.float64)
        ids, query_ids = rows["vec_id"].to_numpy(np.int64), asked["vec_id"].to_numpy(np.int64)
        q, r, s = search_block(wanted, query_ids, vectors, ids, codes, rows["length"].to_numpy(), rows["own"].to_numpy(), shared.value[dim], k)
        return pd.DataFrame({"query_id": query_ids[q], "vec_id": ids[r], "score": s})

    keys = ["dim", "rb", "qb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(W.Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
