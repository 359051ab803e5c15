"""Scans over series that may be long: numbers, carried values and runs, in ranges of the order instead of one window.

A frame has a series and an idx that is unique in it. Rows are dealt to ranges of (series, order), each range is scanned
by itself, and what crosses a border is carried by a summary with one row per series and range it lies in. So one series
of all rows spreads over all tasks, and the only window over a whole series is the one over its summary.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import staged
from .metrics import total

PIECE = ["series", "_range"]


def ranged(df: DataFrame, *order: str) -> DataFrame:
    """df dealt to ranges of the order, with the number of the range, written so that the numbers stay what they are."""
    return staged(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")


def earlier(*keys: str):
    """All earlier ranges of the keys."""
    return Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """df(series, ...) with idx, the 0-based number of the row within its series by the order; ties get any order. A null
    series is a series of its own."""
    r = ranged(df, "series", *order)
    before = r.groupBy(*PIECE).agg(total().alias("_n")).select("series", "_range", F.coalesce(F.sum("_n").over(earlier("series")), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*PIECE).orderBy(*order)) - 1
    return _with(r.withColumn("_at", at), before).withColumn("idx", F.col("_at") + F.col("_before")).drop("_at", "_before", "_range")


def _with(pieces: DataFrame, summary: DataFrame) -> DataFrame:
    """pieces joined with their row of the summary; the piece of one range is the most that a key holds."""
    s = summary.select(F.col("series").alias("_s"), F.col("_range").alias("_r"), *(c for c in summary.columns if c not in PIECE))
    return pieces.join(s, F.col("series").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r"))).drop("_s", "_r")


def repeat_fill(frames: DataFrame) -> DataFrame:
    """A lost frame takes the last frame that arrived; before the first it is silence. A null value counts as lost."""
    r = ranged(frames, "series", "idx")
    arrived = F.when(~F.col("lost"), F.col("v"))
    last = r.groupBy(*PIECE).agg(F.max_by(arrived, F.when(arrived.isNotNull(), F.col("idx"))).alias("_last"))
    carried = last.select("series", "_range", F.last("_last", ignorenulls=True).over(earlier("series")).alias("_carried"))
    inside = Window.partitionBy(*PIECE).orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    seen = r.withColumn("_seen", F.last(arrived, ignorenulls=True).over(inside))
    return _with(seen, carried).withColumn("filled", F.coalesce("_seen", "_carried", F.lit(0.0))).drop("_seen", "_carried", "_range")


def loss_run_stats(frames: DataFrame, frame_ms: int = 20) -> DataFrame:
    """Per series: runs of lost frames (with following idx), their mean length in ms and the loss rate. A run that crosses
    ranges is one: a range does not count its first run if the last lost frame before it is the one just before."""
    r = ranged(frames.select("series", "idx", "lost"), "series", "idx")
    at = F.when(F.col("lost"), F.col("idx"))
    begins = F.col("lost") & ~F.coalesce(F.lag(at).over(Window.partitionBy(*PIECE).orderBy("idx")) == F.col("idx") - 1, F.lit(False))
    piece = r.withColumn("_begins", begins).groupBy(*PIECE).agg(total().alias("frames"), F.count(at).alias("dropped"), F.count_if("_begins").alias("runs"), F.min(at).alias("first"), F.max(at).alias("last"))
    joins_on = F.coalesce(F.last("last", ignorenulls=True).over(earlier("series")) == F.col("first") - 1, F.lit(False))
    one = piece.withColumn("runs", F.col("runs") - joins_on.cast("int")).groupBy("series").agg(*(F.sum(c).alias(c) for c in ("frames", "dropped", "runs")))
    return one.select("series", "runs", F.round(F.when(F.col("runs") > 0, F.col("dropped") / F.col("runs") * frame_ms), 6).alias("mean_ms"), F.round(F.col("dropped") / F.col("frames"), 6).alias("loss_rate"))
