"""Exact top-k inner products over an impact-ordered index, score at a time."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

LEVELS = 256
ROUNDS = 12
_OUT = "query_row long, query_id long, vec_id long, known boolean, row long, score long"


class ImpactIndex:
    """One shard of integer vectors. Each dimension's postings lie in order of a quantised value, of at most LEVELS levels,
    so that the postings of a run of levels are one slice."""

    def __init__(self, x: np.ndarray):
        self.x = x
        n, dims = x.shape
        self.low = x.min(axis=0) if n else np.zeros(dims, x.dtype)
        span = (x.max(axis=0) - self.low) if n else self.low
        self.width = span // LEVELS + 1
        self.level = ((x - self.low) // self.width).astype(np.uint8)
        self.order = np.argsort(self.level, axis=0, kind="stable").astype(np.int32).T.copy()
        held = np.take_along_axis(self.level, self.order.T, axis=0).T
        self.start = np.stack([np.searchsorted(h, np.arange(LEVELS + 1)) for h in held]) if dims else np.zeros((0, LEVELS + 1), np.int64)

    def top(self, q: np.ndarray, k: int) -> np.ndarray:
        """Rows that may be among the k best by inner product with q, none of the k best left out.

        The impact of a segment (dimension, level) is what its postings score at least, above the least that any posting
        of the dimension scores. Segments go by descending impact, in rounds; a row's sum so far is a lower bound of its
        score, and with the highest impact that is left in each dimension where it has not been met, and the width of
        the levels, an upper bound. It ends when the rows whose upper bound reaches the k-th lower bound are few, or when
        no segment is left.
        """
        n, dims = self.x.shape
        if n <= k or not dims:
            return np.arange(n)
        steps = abs(q) * self.width  # impact of one level
        rising = q >= 0
        top_level = self.level.max(axis=0).astype(q.dtype)  # levels of a dimension start at 0
        slack = (abs(q) * (self.width - 1)).sum()
        least = np.where(rising, q * self.low, q * (self.low + (top_level + 1) * self.width - 1)).sum()
        acc = np.full(n, least, dtype=q.dtype)
        done = np.zeros(dims, dtype=np.int64)  # how many of a dimension's levels are done, from its best
        ladder = np.arange(LEVELS)
        highest = (steps * top_level).max()
        for r in range(1, ROUNDS + 1):
            floor = highest * (ROUNDS - r) // ROUNDS + 1  # this round's segments have at least this impact
            want = np.maximum(done, np.where(steps > 0, top_level - (-(-floor // np.where(steps > 0, steps, 1))) + 1, 0).astype(np.int64))
            for d in np.flatnonzero(want > done):
                a, b = int(done[d]), int(want[d])
                t = int(top_level[d])
                if rising[d]:
                    part = slice(self.start[d, t - b + 1], self.start[d, t - a + 1])
                    ids = self.order[d, part]
                    acc[ids] += (ladder.astype(q.dtype) * steps[d])[self.level[ids, d]]
                else:
                    part = slice(self.start[d, a], self.start[d, b])
                    ids = self.order[d, part]
                    acc[ids] += ((t - ladder).astype(q.dtype) * steps[d])[self.level[ids, d]]
            done = want
            left = np.maximum(top_level - done.astype(q.dtype), 0) * steps  # the highest impact left in each dimension
            bar = np.sort(acc)[n - k] if acc.dtype == object else np.partition(acc, n - k)[n - k]
            may = np.flatnonzero(acc + slack + left.sum() >= bar)
            if r == ROUNDS:
                return may
            if len(may) <= n // 2:
                cut = np.where(rising, top_level.astype(np.int64) - done + 1, done - 1)
                met = np.where(rising, self.level[may] >= cut, self.level[may] <= cut)
                may = may[acc[may] + slack + np.where(met, 0, left).sum(axis=1) >= bar]
                if len(may) <= 8 * k:
                    return may
        return may


def integers(vectors: pd.Series, dims: int) -> np.ndarray:
    """floor(1024 * x) of each component as Python-exact integers; shorter vectors are filled with zeros."""
    x = np.zeros((len(vectors), dims), dtype=np.float64)
    for i, v in enumerate(vectors):
        x[i, : len(v)] = v
    with np.errstate(over="ignore"):
        scaled = np.floor(1024.0 * x)
    if np.isfinite(scaled).all() and abs(scaled).max(initial=0) < 2**62:
        return scaled.astype(np.int64)
    return np.array([[1024 * int(c) if abs(c) >= 2**53 else int(np.floor(1024.0 * c)) for c in row] for row in x], dtype=object).reshape(x.shape)


def search_cell(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best rows of one shard for each query of one slice; a query's own row is none of them."""
    columns = [c.split()[0] for c in _OUT.split(", ")]
    if rows.empty or queries.empty:
        return pd.DataFrame(columns=columns)
    dims = int(max(rows["v"].map(len).max(), queries["q"].map(len).max()))
    x, qs = integers(rows["v"], dims), integers(queries["q"], dims)
    bound = 4 * max(1, dims) * int(abs(x).max(initial=0)) * int(abs(qs).max(initial=0))
    if bound >= 2**62 or x.dtype == object or qs.dtype == object:
        x, qs = x.astype(object), qs.astype(object)
    index, row = ImpactIndex(x), rows["row"].to_numpy()
    known, ids = rows["known"].to_numpy(dtype=bool), rows["vec_id"].to_numpy()
    out = []
    for q_row, q_id, q in zip(queries["q_row"].tolist(), queries["q_id"].tolist(), qs, strict=True):
        may = index.top(q, k + 1)
        may = may[row[may] != q_row]
        score = x[may] @ q
        best = sorted(range(len(may)), key=lambda i: (-score[i], not known[may[i]], ids[may[i]], row[may[i]]))[:k] if x.dtype == object else np.lexsort((row[may], ids[may], ~known[may], -score))[:k]
        for i in best:
            if not -(2**63) <= int(score[i]) < 2**63:
                raise OverflowError(f"the score of vectors {q_id} and {ids[may[i]]} is no long")
            out.append((q_row, q_id, int(ids[may[i]]), bool(known[may[i]]), int(row[may[i]]), int(score[i])))
    return pd.DataFrame(out, columns=columns)


def top_k(vectors: DataFrame, k: int = 10, query: Column | None = None, shard_rows: int = 8192, query_rows: int = 2048, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The k rows of the highest integer inner product for each query row: query_id, rank (from 1), vec_id, score.

    Components count as floor(1024 * x). query selects the query rows (by default ids divisible by 100); candidates are all
    rows but the query's own. Ties go to the smaller id. Vectors that are null or hold null or non-finite components take
    no part. A row is told by its place in a staged table: repeated rows are rows of their own, candidates for each other
    and queries each. A null id is never a query and comes last among ties. Vectors of unlike length: what is missing
    counts as 0. A score that is no long fails the job. With fewer other rows there are fewer results; an empty table
    gives none; other columns are left out.

    Rows are dealt evenly to shards of about shard_rows, queries to slices of query_rows; a task indexes one shard and
    searches it for one slice, so each query meets every shard, and a row's k best of each shard are ranked under a
    group limit. Work and shuffle grow with queries times rows, as the exact answer over all rows asks.
    """
    v = F.col(vec_col)
    plain = F.forall(v, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) != float("inf")), F.lit(False)))
    own = F.col(id_col).cast("long")
    wanted = F.coalesce(query if query is not None else F.col(id_col) % 100 == 0, F.lit(False)) & own.isNotNull()
    rows = staged(vectors.where(v.isNotNull() & plain).select(F.monotonically_increasing_id().alias("row"), own.alias("vec_id"), v.alias("v"), wanted.alias("wanted")), "vectors")
    n = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("wanted").cast("long")), F.lit(0))).first()
    shards, slices = max(1, -(-n[0] // shard_rows)), max(1, -(-n[1] // query_rows))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    place = lambda m, salt: F.pmod(F.xxhash64("row", F.lit(salt)), F.lit(m).cast("long"))
    held = rows.select("row", F.coalesce("vec_id", F.lit(0)).alias("vec_id"), F.col("vec_id").isNotNull().alias("known"), "v", place(shards, 1).alias("shard"), every(slices).alias("slice"))
    asked = rows.where("wanted").select(F.col("row").alias("q_row"), F.col("vec_id").alias("q_id"), F.col("v").alias("q"), place(slices, 2).alias("slice"), every(shards).alias("shard"))

    def task(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return search_cell(a, b, k)

    found = held.groupBy("shard", "slice").cogroup(asked.groupBy("shard", "slice")).applyInPandas(task, _OUT).withColumn("vec_id", F.when(F.col("known"), F.col("vec_id")))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
