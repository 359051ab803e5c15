"""Window-shaped operators: samples, listings, envelopes, cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .metrics import total
from .series import earlier, ranged


def listen_set(rows: DataFrame, n: int) -> DataFrame:
    """n utterances, round-robin over entity types: an utterance's type is the first by name over all its rows (none
    without entities); within a type a miss first, then more entities (of its first row), then id. The limit is the
    operator's own."""
    of_types = F.array_min(F.transform("entities", lambda e: e["type"]))
    per = rows.groupBy("utterance_id").agg(F.coalesce(F.min(of_types), F.lit("none")).alias("type"), F.bool_or(F.exists("entities", lambda e: ~e["hit"])).alias("has_miss"), F.min_by(F.size("entities"), "event_id").alias("n_entities"))
    turn = Window.partitionBy("type").orderBy(F.desc("has_miss"), F.desc("n_entities"), "utterance_id")
    return per.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= n).orderBy("turn", "type").limit(n)


def hero_example(ents: DataFrame, bursty: list[str], longest: int = 40) -> DataFrame:
    """The bursty miss with a wrong value that shows best: equal length first, then the longest expected (capped)."""
    wrong = ents.where(~F.col("hit") & F.col("found").isNotNull() & F.col("condition").isin(bursty))
    equal = (F.length("expected") == F.length("found")).cast("int")
    return wrong.orderBy(equal.desc(), F.least(F.length("expected"), F.lit(longest)).desc(), "event_id", "pos").limit(1).select("event_id", "type", "expected", "found")


def review_sample(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded sample of n rows: up to two thirds with a miss, the rest clean, shuffled by a second hash (place), so that
    a reader cannot tell them by their order; the same for any partitioning."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("event_id").cast("string")))
    again = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit("shuffled"), F.col("event_id").cast("string")))
    tagged = rows.select("event_id", F.exists("entities", lambda e: ~e["hit"]).alias("has_miss"), key.alias("h"))
    missed = tagged.where("has_miss").orderBy("h").limit(2 * n // 3)
    clean = tagged.where("not has_miss").orderBy("h").limit(n)
    both = missed.unionByName(clean).orderBy(F.desc("has_miss"), "h").limit(n)
    return both.withColumn("place", F.row_number().over(Window.orderBy(again)))  # n rows


def budget_cutoff(calls: DataFrame, cap: int, order: str = "event_id") -> DataFrame:
    """Running totals of paid calls in order and whether each still fits the cap; cached calls are free.

    The calls are dealt to ranges of the order, each range is summed, and the running sum inside each stands on the sums
    of the earlier ones: no window spans all calls, and what is broadcast has one row per range.
    """
    dealt = ranged(calls.withColumn("_paid", (~F.col("cached")).cast("long")), order)
    offsets = dealt.groupBy("_range").agg(F.sum("_paid").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(earlier()), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy(order)
    return dealt.join(F.broadcast(offsets), "_range").withColumn("running", F.col("_before") + F.sum("_paid").over(inside)).withColumn("within", F.col("running") <= cap).drop("_before", "_paid", "_range")


def silence_fill(frames: DataFrame) -> DataFrame:
    return frames.withColumn("filled", F.when(F.col("lost"), 0.0).otherwise(F.col("v")))


def peak_envelope(frames: DataFrame, buckets: int = 120) -> DataFrame:
    """Largest absolute sample per bucket of floor(n / buckets) samples, scaled to 0..100; the tail is dropped, short
    series leave zeros."""
    n = frames.groupBy("series").agg(total().alias("n"), F.max(F.abs("v")).alias("top"))
    per = F.greatest(F.lit(1), F.floor(F.col("n") / buckets))
    peaks = frames.join(n, "series").withColumn("bucket", F.floor(F.col("idx") / per).cast("int")).where(F.col("bucket") < buckets).groupBy("series", "bucket").agg(F.max(F.abs("v")).alias("peak"))
    grid = n.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    return grid.join(peaks, ["series", "bucket"], "left").select("series", "bucket", F.round(F.coalesce(F.when(F.col("top") > 0, F.col("peak") / F.col("top") * 100), F.lit(0.0)), 4).alias("peak"))


def pick_exemplar(files: DataFrame) -> DataFrame:
    """Per condition the file whose loss is nearest the lower median of those with a loss, else the smallest id."""
    medians = files.groupBy("condition").agg(F.expr("percentile_disc(0.5) within group (order by loss)").alias("median"))
    far = F.abs(F.col("loss") - F.col("median"))
    return files.join(F.broadcast(medians), "condition").where("loss is not null or median is null").groupBy("condition").agg(F.min_by("file", F.struct(F.coalesce(far, F.lit(0.0)), "file")).alias("file"))


def exemplar_check(files: DataFrame) -> DataFrame:
    """Conditions whose exemplar lost nothing although some file of theirs did."""
    some = files.groupBy("condition").agg(F.max("loss").alias("most")).where("most > 0")
    return pick_exemplar(files).join(files, ["condition", "file"]).join(some, "condition").where("loss = 0").select("condition", "file")


def cached_requests(calls: DataFrame, cache: DataFrame) -> DataFrame:
    return calls.join(cache, "key", "left_semi")


def full_axis(utterances: DataFrame, conditions: DataFrame, models: DataFrame, modes: DataFrame) -> DataFrame:
    """The planned calls: every utterance under each condition, model and mode; the three axes are dimensions."""
    return utterances.join(F.broadcast(conditions)).join(F.broadcast(models)).join(F.broadcast(modes))


def plan_cost(utterances: DataFrame, calls_per_utterance: int, cached_calls: int, cap: int, chars_per_second: float = 14.0, asr_rate: float = 0.00833, tts_rate: float = 3.0) -> DataFrame:
    """One row of what a run would take, before anything runs."""
    s = utterances.agg(total().alias("tts_calls"), F.sum("chars").alias("chars"), F.sum(F.greatest(F.lit(1.0), F.col("chars") / chars_per_second)).alias("s"))
    asr = F.col("tts_calls") * calls_per_utterance - cached_calls
    seconds = F.col("s") * calls_per_utterance
    return s.select("tts_calls", asr.alias("asr_calls"), F.round(seconds, 4).alias("seconds"), F.round(seconds * asr_rate + F.col("chars") / 1000 * tts_rate, 4).alias("cost"), (asr > cap).alias("over_budget"))
