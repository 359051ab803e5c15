"""What a condition's chain of steps does, and comparisons between conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import total


def _has(op: str, also=lambda s: F.lit(True)) -> Column:
    return F.exists("chain", lambda s: (s["op"] == op) & also(s))


def _first(op: str, field: str) -> Column:
    return F.get(F.filter("chain", lambda s: s["op"] == op), F.lit(0))[field]


def damage_kind() -> Column:
    """bursty, scattered, noise, codec or clean: loss before noise before codec; a resample counts below 16 kHz."""
    model = _first("packet_loss", "model")
    narrow = _has("resample", lambda s: s["sample_rate"] < 16000)
    return F.when(model == "gilbert", "bursty").when(model.isNotNull(), "scattered").when(_has("noise"), "noise").when(_has("codec") | narrow, "codec").otherwise("clean")


def damage_label() -> Column:
    """8 kHz + G.711 + bursty packet loss; null if nothing is done to the sound."""
    codec = _first("codec", "codec")
    hz = _first("resample", "sample_rate")
    parts = [
        F.when(hz.isNotNull(), F.concat((hz / 1000).cast("int").cast("string"), F.lit(" kHz"))),
        F.when(codec == "g711", "G.711").otherwise(F.upper(codec)),
        F.when(_has("noise"), "background noise"),
        F.when(_first("packet_loss", "model") == "gilbert", "bursty packet loss").when(_has("packet_loss"), "scattered packet loss"),
    ]
    return F.nullif(F.concat_ws(" + ", *parts), F.lit(""))


def held_labels(conditions: DataFrame) -> DataFrame:
    """Distinct label pieces of some conditions: codec, then noise, then loss."""
    piece = conditions.select(F.explode(F.split(damage_label(), r" \+ ")).alias("piece")).distinct()
    return piece.withColumn("rank", F.when(F.col("piece").contains("loss"), 3).when(F.col("piece").contains("noise"), 2).otherwise(1))


def condition_groups(conditions: DataFrame, rows: DataFrame) -> DataFrame:
    """Exercised conditions with their block (bursty or not) and loss rate, for sorting."""
    seen = rows.select(F.col("condition").alias("name")).distinct()
    return conditions.join(seen, "name", "left_semi").select(F.col("name").alias("condition"), (damage_kind() == "bursty").alias("bursty"), F.coalesce(_first("packet_loss", "rate"), F.lit(0.0)).alias("loss"))


def loss_pairs(conditions: DataFrame, ents: DataFrame, rows: DataFrame) -> DataFrame:
    """Scattered and bursty conditions of equal rate and fill, side by side."""
    dim = conditions.select(F.col("name").alias("condition"), _first("packet_loss", "model").alias("loss"), _first("packet_loss", "rate").alias("p"), F.coalesce(_first("packet_loss", "fill"), F.lit("silence")).alias("fill"))
    fact = ents.groupBy("condition").agg(F.sum(F.col("hit").cast("long")).alias("hits"), total().alias("total")).join(rows.groupBy("condition").agg(F.round(F.avg("wer"), 6).alias("wer")), "condition")
    side = lambda kind, tag: dim.where(F.col("loss") == kind).join(fact, "condition", "left").select("p", "fill", *(F.col(c).alias(f"{tag}_{c}") for c in ("condition", "hits", "total", "wer")))
    return side("bernoulli", "scattered").join(side("gilbert", "bursty"), ["p", "fill"])


def degenerate_draws(conditions: DataFrame, rows: DataFrame) -> DataFrame:
    """Loss conditions against the condition with the same chain without the loss: utterances whose audio is the same."""
    bare = F.to_json(F.filter("chain", lambda s: s["op"] != "packet_loss"))
    lossy = conditions.where(_has("packet_loss")).select(F.col("name").alias("condition"), bare.alias("bare"))
    plain = conditions.where(~_has("packet_loss")).select(F.col("name").alias("base"), F.to_json("chain").alias("bare"))
    audio = rows.select("utterance_id", "condition", "audio_sha256").distinct()
    pairs = F.broadcast(lossy.join(plain, "bare"))
    return audio.join(pairs, "condition").join(audio.select("utterance_id", F.col("condition").alias("base"), F.col("audio_sha256").alias("base_audio")), ["utterance_id", "base"]).groupBy("condition", "base").agg(total().alias("utterances"), F.count_if(F.col("audio_sha256") == F.col("base_audio")).alias("same"))
