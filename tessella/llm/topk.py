"""Exact top-k search by inner product of quantised vectors, pruned by multi-resolution segment statistics.

A component x becomes floor(256 * x). For vectors cut into segments of length l with means m and deviations s
(roots of mean squared differences from m),

    distance(a, b)^2 >= sum of l * ((m_a - m_b)^2 + (s_a - s_b)^2)  over segments,

and as 2 a.b = |a|^2 + |b|^2 - distance^2, the bound on distances bounds scores from above. Bounds are taken
over few long segments for all pairs of a block, over more and shorter ones for those that can still be among
a query's k best, and the exact score is computed for what survives both. A slack covers rounding, so no
row within the k best is lost. Vectors with a component beyond ``MOST`` are outside the bounds' arithmetic: they meet
all others in whole numbers of any length.

Rows and queries are dealt into blocks of bounded size and every block of queries meets every block of rows
once, in a task of its own; each meeting yields at most k rows a query, and a window per query keeps the k best.

Vectors that are null or hold null or non-finite components take no part, nor do those with a null id. Only vectors of
one length are compared; empty ones have score 0. Scores beyond the range of a long count as its limit. Rows with the query's id are
its own. Ties go to the smaller id; repeated rows each take a rank. An empty table gives no rows. Other columns play no part.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.session import small_batches

ROWS, QUERIES, AT_ONCE = 2048, 8192, 256
LEVELS = (4, 16)
SCALE = 256.0
MOST = 1 << 26
FOUND = pa.schema({"query_id": pa.int64(), "vec_id": pa.int64(), "score": pa.int64()})


def usable(vector: Column) -> Column:
    fits = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    return vector.isNotNull() & F.coalesce(fits, F.lit(False))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Per segment the mean and the deviation, each times the root of the length: products of rows are score bounds."""
    ends = np.unique(np.linspace(0, x.shape[1], min(segments, max(1, x.shape[1])) + 1).astype(int))
    parts = [x[:, a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
    if not parts:
        return np.zeros((len(x), 1))
    root = [math.sqrt(p.shape[1]) for p in parts]
    means = [p.mean(1) for p in parts]
    return np.stack([m * r for m, r in zip(means, root, strict=True)] + [np.sqrt(((p - m[:, None]) ** 2).sum(1)) for p, m in zip(parts, means, strict=True)], 1)


Found = list[tuple[int, np.ndarray, np.ndarray]]


def best(rows: np.ndarray, row_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Found:
    """(query id, ids, scores) of the k best rows for each query; rows and queries hold integers up to MOST, as float64."""
    out = []
    of_rows = [statistics(rows, s) for s in LEVELS]
    size, whole = np.sqrt((rows**2).sum(1)), rows.astype(np.int64)
    for begin in range(0, len(queries), AT_ONCE):
        asked, names = queries[begin : begin + AT_ONCE], query_ids[begin : begin + AT_ONCE]
        coarse, fine = (statistics(asked, s) for s in LEVELS)
        bound = coarse @ of_rows[0].T
        for i, q in enumerate(asked):
            others = row_ids != names[i]
            slack = 0.5 + 1e-9 * size * math.sqrt(float(q @ q))
            upper = np.where(others, bound[i], -np.inf)
            n = min(k, int(others.sum()))
            if not n:
                continue
            exact = q.astype(np.int64)
            first = np.argpartition(-upper, n - 1)[:n]
            least = (whole[first] @ exact).min()  # the k-th best score is no lower
            left = np.flatnonzero(upper + slack >= least)
            left = left[of_rows[1][left] @ fine[i] + slack[left] >= least]
            scores = whole[left] @ exact
            order = np.lexsort((row_ids[left], -scores))[:k]
            out.append((int(names[i]), row_ids[left][order], scores[order]))
    return out


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as Python integers."""
    return np.array([[int(v) * 256 if abs(v) >= 1 << 53 else math.floor(SCALE * v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def best_of_any(rows: np.ndarray, row_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Found:
    """As best(), of vectors as they are, without bounds on components."""
    out = []
    rows, queries = whole_numbers(rows), whole_numbers(queries)
    for q, name in zip(queries, query_ids, strict=True):
        left = np.flatnonzero(row_ids != name)
        if len(left):
            scores = np.array([max(-(1 << 63), min((1 << 63) - 1, int(sum(r * q)))) for r in rows[left]], np.int64)
            order = sorted(range(len(left)), key=lambda j: (-int(scores[j]), row_ids[left[j]]))[:k]
            out.append((int(name), row_ids[left][order], scores[order]))
    return out


def _matrix(vectors: pa.Array, length: int, at: np.ndarray) -> np.ndarray:
    return vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), length)


def _all_best(rows: np.ndarray, row_ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> Found:
    """Up to 2 k rows for each query, among them the k best: those within MOST, and those where either side is beyond."""
    far, far_query = ((np.abs(x) > MOST / SCALE).any(1) for x in (rows, queries))
    near = lambda x: np.floor(SCALE * x)
    found = best(near(rows[~far]), row_ids[~far], near(queries[~far_query]), query_ids[~far_query], k) if not (far.all() or far_query.all()) else []
    if far.any():
        found += best_of_any(rows[far], row_ids[far], queries[~far_query], query_ids[~far_query], k)
    if far_query.any():
        found += best_of_any(rows, row_ids, queries[far_query], query_ids[far_query], k)
    return found


def _meet(rows: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    found = []
    if rows.num_rows and queries.num_rows:
        vectors, asked = (x.column("v").combine_chunks() for x in (rows, queries))
        sizes, wanted = (pa.compute.list_value_length(x).to_numpy(zero_copy_only=False) for x in (vectors, asked))
        ids, query_ids = (x.column("id").to_numpy() for x in (rows, queries))
        for length in np.unique(wanted):
            a, b = np.flatnonzero(sizes == length), np.flatnonzero(wanted == length)
            if len(a):
                found += _all_best(_matrix(vectors, int(length), a), ids[a], _matrix(asked, int(length), b), query_ids[b], k)
    columns = [np.repeat([q for q, _, _ in found], [len(x) for _, x, _ in found]), *(np.concatenate([f[j] for f in found]) for j in (1, 2))] if found else [[], [], []]
    return pa.Table.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row of ``vectors`` (vec_id, embedding) that is a query."""
    small_batches(vectors.sparkSession)
    used = vectors.filter(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    rows = used.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    queries = used.filter(is_query).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("v"))
    count = used.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(is_query, F.lit(False))).alias("q")).head()
    across, down = max(1, math.ceil(count["q"] / QUERIES)), max(1, math.ceil(count["n"] / ROWS))
    hashed = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    rows = rows.withColumn("r", hashed(down)).withColumn("q", each(across))
    queries = queries.withColumn("q", hashed(across)).withColumn("r", each(down))
    key = (F.col("r") * across + F.col("q")).alias("meeting")
    rows, queries = (x.select(key, "id", "v") for x in (rows, queries))
    met = rows.groupBy("meeting").cogroup(queries.groupBy("meeting")).applyInArrow(lambda a, b: _meet(a, b, k), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
