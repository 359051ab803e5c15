"""Checks inside the plan: the job fails, and names up to three offenders, as soon as a result that rests on them is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import mode_coverage_check, total


def refuse(df: DataFrame, offenders: DataFrame, column: str, complaint: str, known: DataFrame | None = None) -> DataFrame:
    """df as it is if offenders is empty; else its job fails with the complaint and the first three names (of column, in
    their order). known, a dimension with a column name, is listed after them. An empty df may pass unchecked."""
    name = F.coalesce(F.col(column).cast("string"), F.lit("null"))
    some = offenders.select(name.alias("_name")).distinct().orderBy("_name").limit(3).agg(F.array_sort(F.collect_list("_name")).alias("_names"))
    message = F.concat(F.lit(f"{complaint}: "), F.array_join("_names", ", "))
    if known is not None:
        listed = known.agg(F.array_join(F.array_sort(F.collect_set("name")), ", ").alias("_known"))  # a dimension
        some, message = some.crossJoin(listed), F.concat(message, F.lit("; known: "), F.col("_known"))
    fine = some.select(F.when(F.size("_names") > 0, F.raise_error(message).cast("boolean")).otherwise(F.lit(True)).alias("_fine"))
    return df.crossJoin(F.broadcast(fine)).where("_fine").drop("_fine")  # one row


def require_utterances(rows: DataFrame, corpus: DataFrame, key: str = "utterance_id") -> DataFrame:
    """rows, all of whose utterances have a row in the corpus; a null key has none."""
    lost = rows.select(key).join(corpus.select(key), key, "left_anti")
    return refuse(rows, lost, key, "utterances without a corpus row")


def require_modes(rows: DataFrame) -> DataFrame:
    """rows, in which every condition and model carries every mode of the data."""
    partial = mode_coverage_check(rows).where("not complete")
    cell = F.concat(F.col("condition"), F.lit("/"), F.col("model"), F.lit(" has only "), F.col("modes"))
    return refuse(rows, partial.select(cell.alias("cell")), "cell", "incomplete modes")


def unique_conditions(conditions: DataFrame) -> DataFrame:
    twice = conditions.groupBy("name").agg(total().alias("n")).where("n > 1")
    return refuse(conditions, twice, "name", "duplicate condition names")


def require_conditions(rows: DataFrame, conditions: DataFrame, column: str = "condition") -> DataFrame:
    """rows, all of whose conditions are declared; the known ones are listed with an unknown one."""
    strange = rows.select(F.col(column).alias("name")).distinct().join(F.broadcast(conditions.select("name")), "name", "left_anti")  # a dimension
    return refuse(rows, strange, "name", "unknown conditions", conditions)
