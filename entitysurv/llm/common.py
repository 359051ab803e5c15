"""Shared helpers: scratch tables, ranks inside possibly huge groups, connected components."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local session may go without: it gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            spark.sparkContext.setCheckpointDir(root)
        return root
    set_already = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-ckpt-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def once_per_worker(key, make):
    """make(), once in a Python worker process and kept for its later tasks. For caches of bounded size only."""
    home = sys.modules.setdefault("_entitysurv_worker", types.ModuleType("_entitysurv_worker"))
    if key not in home.__dict__:
        home.__dict__[key] = make()
    return home.__dict__[key]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, batch_rows: int = 1000, scratch: list[str] | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there and later reads prune columns.

    While it is written, Python workers get at most batch_rows rows at a time: rows here are texts and whole sets, and
    the usual ten thousand of them would fill an executor. The path is added to scratch, for `discard`.
    """
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    path, usual = scratch_path(spark, name), spark.conf.get(key)
    if scratch is not None:
        scratch.append(path)
    spark.conf.set(key, min(batch_rows, int(usual)) if int(usual) > 0 else batch_rows)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, usual)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, scratch: list[str]) -> None:
    """Delete staged tables that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    for path in scratch:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    scratch.clear()


def salted_join(left: DataFrame, right: DataFrame, on: list[str], rows: str, by: list[str], how: str = "inner", share: int = 1000, scratch: list[str] | None = None) -> DataFrame:
    """left joined with right, which has one row per key; its column `rows` says how many rows of left have the key.

    No task gets a whole hot key: one with more than 1/share of all rows (there are fewer than `share` such keys, which
    are broadcast) is cut into cells of that size by a hash of the columns `by` of left, and its row of right is
    repeated for each cell, all in all at most 2 * share times.
    """
    seen = Observation()
    right = staged(right.observe(seen, F.sum(rows).alias("rows")), "salted", scratch=scratch)
    cell = max(1, (seen.get["rows"] or 0) // share)
    cells = F.ceil(F.col(rows) / cell).cast("long")
    heavy = right.where(F.col(rows) > cell).select(*on, cells.alias("_cells"))
    left = left.join(F.broadcast(heavy), on, "left").withColumn("_cell", F.pmod(F.xxhash64(*by), F.coalesce("_cells", F.lit(1)).cast("long"))).drop("_cells")
    right = right.withColumn("_cell", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(cells, F.lit(1)) - 1)))
    return left.join(right, [*on, "_cell"], how).drop("_cell")


def lowest(df: DataFrame, h: Column, most: int, *ties: str) -> DataFrame:
    """At most `most` rows of df: those with the lowest hash h (a long), ties by columns. Rows are counted and only those
    under a threshold for about that number are sorted, so no task gets `most` rows from every partition."""
    share = 1.1 * (most + 100) / max(1, df.count())
    near = df.where(F.shiftrightunsigned(h, 33) < int(share * (1 << 31))) if share < 1 else df
    return near.orderBy(F.shiftrightunsigned(h, 33), h, *ties).limit(most)


def ranked(df: DataFrame, keys: list[str], hash_col: str, ties: list[str], buckets: int = 256, out: str = "rank") -> DataFrame:
    """0-based rank of each row within its keys, by the unsigned order of hash_col, then ties.

    A key may hold a large part of all rows, so no window spans a whole key: rows are numbered inside (keys, leading
    bits of the hash) and the sizes of the earlier cells of the key are added. Keys must not be null.
    """
    bits = max(1, min(16, (buckets - 1).bit_length()))
    cell = df.withColumn("_cell", F.shiftrightunsigned(F.col(hash_col), 64 - bits))
    sizes = cell.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(F.col(hash_col), *ties)
    return (
        cell.withColumn("_at", F.row_number().over(inside) - 1)
        .join(offsets, [*keys, "_cell"])
        .withColumn(out, F.col("_offset") + F.col("_at"))
        .drop("_cell", "_offset", "_at")
    )


def _forest(batches, most: int = 1_000_000):
    """(node, component) of the edges of one partition, by union-find; component = smallest node. After `most` nodes it
    starts anew, so memory is bounded whatever the partition holds."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    def found() -> pd.DataFrame:
        return pd.DataFrame({"node": list(parent), "component": [find(x) for x in parent]}, dtype="int64")

    for pdf in batches:
        for u, v in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
        if len(parent) >= most:
            yield found()
            parent.clear()
    yield found()


def components(edges: DataFrame, rounds: int = 60, part_edges: int = 8192, most_tasks: int = 4096) -> DataFrame:
    """Connected components of edges(a long, b long): one row (node, component) per node, component = smallest node.

    The edges are dealt evenly to tasks of about part_edges, but at most most_tasks of them: then tasks grow with the
    edges, while `_forest` bounds what each holds. A task contracts its own by union-find to pairs
    (node, smallest node); then large-star and small-star steps alternate with such contractions until the edges are
    stars. A hub is never one task's: joins are salted (see salted_join) and minima have map-side combine. Self-loops
    and repeated edges are fine; a null end drops its edge. Raises if the edges are no stars after `rounds`.
    """
    scratch: list[str] = []
    spark = edges.sparkSession
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    for _ in range(rounds):
        e = staged(e, "edges", scratch=scratch)
        contracted = e.repartition(min(most_tasks, max(1, -(-e.count() // part_edges)))).mapInPandas(_forest, "node long, component long")
        e = staged(contracted.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v")), "stars", scratch=scratch)
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("as_u"), F.lit(0).alias("as_v")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("as_u"), F.lit(1).alias("as_v")))
        open_ = ends.groupBy("x").agg(F.sum("as_u").alias("as_u"), F.max("as_v").alias("as_v")).where("as_u > 1 or as_u > 0 and as_v > 0")
        if open_.isEmpty():
            out = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
            scratch.pop()  # the stars are read by the result
            discard(spark, scratch)
            return out
        e = e.distinct()
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = salted_join(both, low, ["u"], "n", ["v"], scratch=scratch).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = staged(large, "large-stars", scratch=scratch)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = salted_join(large, low, ["u"], "n", ["v"], scratch=scratch)
        e = joined.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v")
    raise RuntimeError(f"components did not settle in {rounds} rounds")
