"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ranked, staged

DIMS = ["bytes", "tokens", "rows"]


def place(items: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Greedy placement. items: (n, d); residual: (shards, d), changed in place.

    Items go largest first, each to the shard where the dot product of the item with the residual capacity is highest;
    the lowest shard number wins ties.
    """
    out = np.empty(len(items), dtype=np.int32)
    for i in np.argsort(-items.max(axis=1, initial=0.0), kind="stable"):
        s = int(np.argmax(residual @ items[i]))
        out[i] = s
        residual[s] -= items[i]
    return out


def _place_bucket(pdf: pd.DataFrame, residual: np.ndarray, totals: np.ndarray) -> pd.DataFrame:
    pdf = pdf.sort_values(["gkey", "piece"], ignore_index=True)
    items = pdf[DIMS].to_numpy(dtype=np.float64) / totals
    left = np.maximum(residual, 0.0)
    share = items.sum(axis=0) / np.maximum(left.sum(axis=0), 1e-300)
    pdf["shard"] = place(items, left * share)
    return pdf[["gkey", "piece", "shard"]]


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, split: int = 4, heavy: int = 256, bucket_items: int = 20_000) -> DataFrame:
    """Put every row of docs into one of n_shards shards of near equal bytes, tokens and rows.

    Equal texts form a group and stay together, unless the group holds more than 1/split of a shard's capacity in some
    dimension; then its rows are dealt by a hash of their id (null: of their place in the input) over pieces of that size. Groups over 1/heavy of a shard
    number at most 3 * heavy * n_shards, whatever the input, and are placed first, on the driver. The others are dealt
    by hash into buckets of about bucket_items groups; each bucket is one task that fills its share of the capacity
    left, largest group first, by the same dot product.

    Returns id, size (UTF-8 bytes plus overhead), tokens (words), text_crc32, shard, slot (0.. without gaps in a shard).
    A null text has no bytes, no tokens and the checksum 0; it is equal to other null texts, not to the empty text.
    Repeated rows each get a slot. A null id is kept. An empty table gives no rows. Other columns are left out.
    """
    spark = docs.sparkSession
    text = F.col(text_col)
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("bytes"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"),
            F.coalesce(F.md5(text), F.lit("null")).alias("gkey"),
            F.when(F.col(id_col).isNull(), F.monotonically_increasing_id()).alias("spread"),  # written below, so drawn once
        ),
        "shard-rows",
    )
    groups = rows.groupBy("gkey").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    t = rows.agg(F.sum("bytes"), F.sum("tokens"), F.count(F.lit(1))).first()
    totals = np.maximum(np.array([float(x or 0) for x in t]), 1.0)
    share = F.greatest(*[F.col(d) * float(n_shards) / float(x) for d, x in zip(DIMS, totals, strict=True)])
    hot = groups.where(share > 1.0 / split).select("gkey", F.ceil(share * split).cast("int").alias("pieces"))  # at most 3 * split * n_shards rows
    dealt = rows.join(F.broadcast(hot), "gkey", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("id", "spread"), F.col("pieces")), F.lit(0)).cast("int")).drop("pieces", "spread")
    items = staged(dealt.groupBy("gkey", "piece").agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")), "shard-items")
    is_heavy = share > 1.0 / heavy
    big = items.where(is_heavy).orderBy("gkey", "piece").toPandas()
    residual = np.full((n_shards, len(DIMS)), 1.0 / n_shards)
    big["shard"] = place(big[DIMS].to_numpy(dtype=np.float64) / totals, residual)
    light = items.where(~is_heavy)
    buckets = max(1, -(-light.count() // bucket_items))
    schema = "gkey string, piece int, shard int"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        return _place_bucket(pdf, residual, totals)

    placed = (
        light.withColumn("bucket", F.pmod(F.xxhash64("gkey", "piece"), F.lit(buckets)))
        .groupBy("bucket")
        .applyInPandas(fill, schema)
        .unionByName(spark.createDataFrame(big[["gkey", "piece", "shard"]].astype({"piece": "int32", "shard": "int32"}), schema))
    )
    out = dealt.join(placed, ["gkey", "piece"]).withColumn("h", F.xxhash64("id", "gkey"))
    cells = max(16, min(4096, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")) // n_shards))
    return ranked(out, ["shard"], "h", ["id"], cells, "slot").select(F.col("id").alias(id_col), F.col("bytes").alias("size"), "tokens", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"))
