"""Pairing of the two transcription modes: was a value lost to the sound or to its rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import rounded, total
from .rows import model_of

KEY = ["utterance_id", "condition", "model"]


def mode_classify(ents: DataFrame, rows: DataFrame, tie: str = "event_id") -> DataFrame:
    """Each missed entity of a transcribe row: rendering if its verbatim twin has it, acoustic if that misses it too,
    unpaired if there is no twin row or entity. Of several twins the last wins."""
    twin_rows = rows.where("asr_mode = 'verbatim'").groupBy("utterance_id", "condition", model_of().alias("model")).agg(F.max_by(tie, F.struct("run_id", tie)).alias("twin"))
    twin_ents = ents.where("asr_mode = 'verbatim'").groupBy(F.col(tie).alias("twin"), "type", "expected").agg(F.bool_or("hit").alias("twin_hit"))
    mine = ents.where("asr_mode = 'transcribe'").withColumn("model", model_of())
    kind = F.when(F.col("hit"), "hit").when(F.col("twin_hit").isNull(), "unpaired").when(F.col("twin_hit"), "rendering").otherwise("acoustic")
    return mine.join(twin_rows, KEY, "left").join(twin_ents, ["twin", "type", "expected"], "left").select(*KEY, "type", "expected", kind.alias("kind"))


def _split(df: DataFrame) -> list:
    n = lambda k: F.count_if(F.col("kind") == k).alias(k)
    return [total().alias("scored"), n("hit"), n("acoustic"), n("rendering"), n("unpaired")]


def mode_split(classified: DataFrame) -> DataFrame:
    out = classified.groupBy("condition").agg(*_split(classified))
    lost = F.col("acoustic") + F.col("rendering")
    return out.withColumn("rendering_share", rounded(F.when(lost > 0, F.col("rendering") / lost)))


def mode_split_total(classified: DataFrame) -> DataFrame:
    """mode_split with a line ALL, by rollup."""
    out = classified.rollup("condition").agg(*_split(classified), F.grouping("condition").alias("_all"))
    lost = F.col("acoustic") + F.col("rendering")
    return out.withColumn("condition", F.when(F.col("_all") == 1, "ALL").otherwise(F.col("condition"))).drop("_all").withColumn("rendering_share", rounded(F.when(lost > 0, F.col("rendering") / lost)))
