"""Operators that choose score rows or reshape them: duplicates, modes, grain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["utterance_id", "condition", "model", "mode"]


def model_of() -> Column:
    return F.coalesce("asr_model", F.lit("-"))


def mode_of() -> Column:
    return F.coalesce("asr_mode", F.lit("-"))


def exclude_mock(rows: DataFrame) -> DataFrame:
    """Drops mock rows if any row is not a mock; a run of nothing but mocks stays whole."""
    real = rows.agg(F.coalesce(F.bool_or(F.col("asr_impl") != "mock"), F.lit(False)).alias("_real"))
    return rows.join(F.broadcast(real)).where((F.col("asr_impl") != "mock") | ~F.col("_real")).drop("_real")  # one row


def dedupe_newest(rows: DataFrame, tie: str = "event_id") -> DataFrame:
    """One row per utterance, condition, model and mode: the greatest run_id, then the smallest tie column.

    A max_by aggregate with map-side combine, not a window: a cell with many reruns never meets in one sort.
    """
    newest = F.max_by(F.struct(*rows.columns), F.struct("run_id", -F.col(tie)))
    return rows.groupBy("utterance_id", "condition", model_of().alias("_m"), mode_of().alias("_o")).agg(newest.alias("r")).select("r.*")


def entity_rows(rows: DataFrame) -> DataFrame:
    """The entity grain: one row per gold entity of a score row."""
    return rows.withColumn("e", F.explode("entities")).select("*", "e.*").drop("e", "entities")


def primary_mode_rows(rows: DataFrame) -> DataFrame:
    """Rows of the primary mode: transcribe if there is any, else the alphabetically first mode."""
    primary = rows.agg(F.coalesce(F.max(F.when(mode_of() == "transcribe", "transcribe")), F.min(mode_of())).alias("_primary"))
    return rows.join(F.broadcast(primary)).where(mode_of() == F.col("_primary")).drop("_primary")  # one row


def drop_failed(rows: DataFrame) -> DataFrame:
    return rows.where("error is null and trim(hypothesis) <> ''")


def resolve_first(*sources: DataFrame, key: str = "id") -> DataFrame:
    """Rows of several sources of one schema; for a key the first source that has it wins."""
    every = None
    for i, s in enumerate(sources):
        s = s.withColumn("_priority", F.lit(i))
        every = s if every is None else every.unionByName(s)
    first = Window.partitionBy(key).orderBy("_priority")
    return every.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_priority")


def missing_utterances(corpus: DataFrame, rows: DataFrame, key: str = "utterance_id") -> DataFrame:
    """Utterances of the corpus that no row is about; a null key is missing."""
    return corpus.join(rows.select(key), key, "left_anti")


def scored_types(ents: DataFrame, types: list[str]) -> DataFrame:
    return ents.where(F.col("type").isin(types))


def select_conditions(rows: DataFrame, names: list[str], column: str = "condition") -> DataFrame:
    """Rows of the named conditions, with their place in the order asked for; all if none is named."""
    if not names:
        return rows.withColumn("place", F.lit(0))
    wanted = F.array(*map(F.lit, names))
    return rows.where(F.array_contains(wanted, F.col(column))).withColumn("place", F.array_position(wanted, F.col(column)).cast("int"))
