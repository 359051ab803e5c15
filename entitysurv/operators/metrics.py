"""Aggregates over score rows (row grain) and gold entities (entity grain)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import diff_ci, rate, wilson
from ..functions.text import gold_digits, rendering_of
from .rows import mode_of, model_of

LOW_N = 10


def hits() -> Column:
    return F.sum(F.col("hit").cast("long"))


def total() -> Column:
    return F.count(F.lit(1))


def rounded(c: Column) -> Column:
    return F.round(c.cast("double"), 6)


def rates(ents: DataFrame, *keys) -> DataFrame:
    """hits, total and rate per keys; partial sums are combined before the shuffle."""
    g = ents.groupBy(*keys) if keys else ents.groupBy()
    return g.agg(F.coalesce(hits(), F.lit(0)).cast("long").alias("hits"), total().alias("total")).withColumn("rate", rounded(rate(F.col("hits"), F.col("total"))))


def hit_rate(ents: DataFrame) -> DataFrame:
    return rates(ents, "language", "condition", "type", model_of().alias("model"))


def wer_by(rows: DataFrame, *keys) -> DataFrame:
    """Mean of the rows' word error rates (not pooled edits) and their number."""
    return rows.groupBy(*keys).agg(rounded(F.avg("wer")).alias("mean_wer"), total().alias("n"))


def hit_matrix(ents: DataFrame) -> DataFrame:
    return rates(ents, model_of().alias("model"), mode_of().alias("mode"), "condition", "type").withColumn("low_n", F.col("total") < LOW_N)


def matrix_cell_state(ents: DataFrame, conditions: DataFrame) -> DataFrame:
    """Every declared condition for every (model, mode, type) seen: not_run, low_n or rate."""
    matrix = hit_matrix(ents)
    grid = matrix.select("model", "mode", "type").distinct().join(F.broadcast(conditions.select(F.col("name").alias("condition"))))  # dimension rows
    state = F.when(F.col("total").isNull(), "not_run").when(F.col("low_n"), "low_n").otherwise("rate")
    return grid.join(matrix, ["model", "mode", "type", "condition"], "left").select("model", "mode", "type", "condition", state.alias("state"), F.when(state == "rate", F.col("rate")).alias("shown"))


def hit_by_condition_mode(ents: DataFrame, conditions: DataFrame) -> DataFrame:
    per = rates(ents, "condition", mode_of().alias("mode"))
    grid = conditions.select(F.col("name").alias("condition")).join(F.broadcast(per.select("mode").distinct()))
    return grid.join(per, ["condition", "mode"], "left").withColumn("missing", F.col("total").isNull())


def rates_by_condition(ents: DataFrame) -> DataFrame:
    low, high = wilson(F.col("hits"), F.col("total"))
    r = rates(ents, "condition").withColumns({"low": rounded(low), "high": rounded(high)})
    place = F.row_number().over(Window.orderBy(F.col("rate").desc(), "condition"))  # one row per condition
    return r.withColumn("place", place)


def finding(ents: DataFrame) -> DataFrame:
    """Best and worst condition (ties: the smaller name), points lost, interval of the difference, and how many tie with
    the best; no row for fewer than two conditions. Rates are compared as they are, rounded only to be shown."""
    exact = F.col("hits") / F.col("total")
    r = rates(ents, "condition").where("total > 0").withColumn("exact", exact)
    one = F.struct("condition", "hits", "total", "exact")
    row = r.agg(F.min_by(one, F.struct(-F.col("exact"), "condition")).alias("_b"), F.min_by(one, F.struct("exact", "condition")).alias("_w"), total().alias("n"), F.collect_list("exact").alias("all_rates")).where("n >= 2")
    d, low, high = diff_ci(F.col("_b.hits"), F.col("_b.total"), F.col("_w.hits"), F.col("_w.total"))
    return row.select(F.col("_b.condition").alias("best"), F.col("_w.condition").alias("worst"), rounded(d).alias("lost"), rounded(low).alias("low"), rounded(high).alias("high"), F.size(F.filter("all_rates", lambda x: x == F.col("_b.exact"))).alias("tied"))


def model_cells(ents: DataFrame) -> DataFrame:
    """Hits, total and rate of every model under every condition, with Wilson intervals."""
    low, high = wilson(F.col("hits"), F.col("total"))
    return rates(ents.where("asr_model is not null"), "condition", F.col("asr_model").alias("model")).withColumns({"low": rounded(low), "high": rounded(high)})


def model_split(ents: DataFrame, bursty: list[str]) -> DataFrame:
    """Two models pooled over the bursty conditions: rates with Wilson intervals, second minus first with its interval and
    whether it separates them; no row unless there are two."""
    per = rates(ents.where(F.col("asr_model").isNotNull() & F.col("condition").isin(bursty)), F.col("asr_model").alias("model"))
    one = F.struct("model", "hits", "total", "rate")
    both = per.agg(F.min_by(one, "model").alias("a"), F.max_by(one, "model").alias("b"), F.count_distinct("model").alias("n")).where("n = 2")
    d, low, high = diff_ci(F.col("b.hits"), F.col("b.total"), F.col("a.hits"), F.col("a.total"))
    own = {f"{name}_{part}": rounded(c) for x, name in (("a", "first"), ("b", "second")) for part, c in zip(("low", "high"), wilson(F.col(f"{x}.hits"), F.col(f"{x}.total")), strict=True)}
    return both.select(F.col("a.model").alias("first"), F.col("b.model").alias("second"), F.col("a.rate").alias("first_rate"), F.col("b.rate").alias("second_rate"), *(c.alias(n) for n, c in own.items()), rounded(d).alias("delta"), rounded(low).alias("low"), rounded(high).alias("high"), ((low > 0) | (high < 0)).alias("separates"))


def never_worse(ents: DataFrame, a: str, b: str) -> DataFrame:
    """Is model b at least as good as model a in every condition b has; a missing cell of a makes it false. Rates are
    compared by cross products, without rounding."""
    r = rates(ents.where("asr_model is not null"), F.col("asr_model").alias("model"), "condition")
    side = lambda m, p: r.where(F.col("model") == m).select("condition", F.col("hits").cast("decimal(19,0)").alias(f"h{p}"), F.col("total").cast("decimal(19,0)").alias(f"t{p}"))
    better = F.coalesce(F.col("hb") * F.col("ta") >= F.col("ha") * F.col("tb"), F.lit(False))
    return side(b, "b").join(side(a, "a"), "condition", "left").agg(F.coalesce(F.bool_and(better), F.lit(False)).alias("never_worse"))


def shared_cells(rows: DataFrame) -> DataFrame:
    """Cells (utterance, condition, model) that every mode covers."""
    modes = rows.select(mode_of().alias("mode")).distinct().agg(total().alias("_modes"))
    return rows.groupBy("utterance_id", "condition", model_of().alias("model")).agg(F.count_distinct(mode_of()).alias("n")).join(F.broadcast(modes)).where("n = _modes").select("utterance_id", "condition", "model")


def shared_mode_figures(rows: DataFrame, ents: DataFrame) -> DataFrame:
    cells = shared_cells(rows)
    keyed = lambda df: df.withColumn("model", model_of()).join(cells, ["utterance_id", "condition", "model"], "left_semi")
    r = keyed(rows).groupBy(mode_of().alias("mode")).agg(total().alias("rows"), rounded(F.avg("wer")).alias("mean_wer"), F.count_distinct("condition").alias("conditions"))
    e = rates(keyed(ents), mode_of().alias("mode"))
    return r.join(e, "mode", "left")


def headline(rows: DataFrame, ents: DataFrame) -> DataFrame:
    """Hits and rate, the conditions with the least and the most mean WER, the models by mean WER (best first), counts."""
    name = lambda c, sign: F.min_by("condition", F.struct(sign * F.col(c), "condition"))
    cond = rows.groupBy("condition").agg(F.avg("wer").alias("w")).withColumn("w9", F.round("w", 9)).agg(rounded(F.min("w")).alias("least_wer"), rounded(F.max("w")).alias("most_wer"), name("w9", 1).alias("least_condition"), name("w9", -1).alias("most_condition"))
    models = rows.groupBy(model_of().alias("model")).agg(F.avg("wer").alias("w")).agg(F.array_sort(F.collect_list(F.struct(rounded(F.col("w")).alias("w"), "model"))).alias("m"))  # one row per model
    models = models.select(F.element_at("m", 1)["model"].alias("best_model"), F.array_join(F.transform("m", lambda x: F.concat_ws("=", x["model"], F.format_number(x["w"], 4))), ",").alias("models"))
    counts = rows.agg(F.count_distinct("utterance_id").alias("utterances"), F.count_distinct("condition").alias("conditions"))
    return rates(ents).join(cond).join(models).join(counts)


def wer_spread(rows: DataFrame, tie: str = "event_id") -> DataFrame:
    return rows.agg(F.min_by(tie, F.struct("wer", tie)).alias("best_row"), F.min("wer").alias("least"), F.max_by(tie, F.struct(F.col("wer"), -F.col(tie))).alias("worst_row"), F.max("wer").alias("most"))


def summary(primary: DataFrame, ents: DataFrame, every: DataFrame) -> DataFrame:
    return primary.agg(F.count_distinct("utterance_id").alias("utterances"), total().alias("rows")).join(rates(ents).withColumnRenamed("total", "entities")).join(every.agg(total().alias("rows_all_modes")))


def runs(rows: DataFrame) -> DataFrame:
    """One row per run; rows carry source, the file they came from (see results_with_source), and the first by name counts."""
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return rows.groupBy("run_id").agg(
        F.min("source").alias("source"),
        names("asr_impl").alias("impls"), names(model_of()).alias("models"), names(mode_of()).alias("modes"), names("language").alias("languages"), names("condition").alias("conditions"),
        F.count_distinct("utterance_id").alias("utterances"), total().alias("rows"), F.sum(F.size("entities")).alias("entities"), F.count_if(F.col("error").isNotNull()).alias("errors"),
    )


def confusion_counts(ents: DataFrame) -> DataFrame:
    return ents.where("not hit").groupBy("type", "expected", F.col("found").alias("got"), "edit_distance").agg(total().alias("n"))


def corpus_profile(ents: DataFrame, rows: DataFrame) -> DataFrame:
    by_type = ents.groupBy(F.lit("type").alias("kind"), F.col("type").alias("name")).agg(total().alias("n"))
    return by_type.unionByName(rows.groupBy(F.lit("realization").alias("kind"), F.coalesce("realization", F.lit("?")).alias("name")).agg(F.count_distinct("utterance_id").alias("n")))


def rescore_delta(before: DataFrame, after: DataFrame, *keys: str) -> DataFrame:
    """Hits before and after and their difference, for each value of keys; one on one side only stays, with null for the other."""
    b, a = before.groupBy(*keys).agg(hits().alias("before"), total().alias("total")), after.groupBy(*keys).agg(hits().alias("after"))
    return (b.join(a, list(keys), "full") if keys else b.join(a)).withColumn("delta", F.col("after") - F.col("before"))


def with_rendering(ents: DataFrame) -> DataFrame:
    return ents.withColumn("rendering", rendering_of(F.col("expected"), F.col("hypothesis"), F.col("hit")))


def rendering_table(ents: DataFrame) -> DataFrame:
    """Per utterance, mode, condition and value one cell (model, rendering, hit, wer, hypothesis) per model, by model; the
    number of forms and the spread of the error rates."""
    cell = F.struct(model_of().alias("model"), "rendering", "hit", "wer", "hypothesis")
    return with_rendering(ents).groupBy("utterance_id", mode_of().alias("mode"), "condition", "type", "expected").agg(F.array_sort(F.collect_list(cell)).alias("models"), F.count_distinct("rendering").alias("forms"), rounded(F.max("wer") - F.min("wer")).alias("spread"))


def rendering_stats(ents: DataFrame) -> DataFrame:
    table = rendering_table(ents)
    return table.agg(total().alias("pairs"), F.count_if(F.col("forms") > 1).alias("disagreements")).join(
        with_rendering(ents).where("rendering not in ('absent', 'n/a')").groupBy("utterance_id", model_of(), mode_of(), "type", "expected").agg(F.count_distinct("rendering").alias("f")).agg(F.count_if(F.col("f") > 1).alias("changes"))
    ).join(with_rendering(ents).agg(F.count_if((F.col("rendering") != F.col("realization")) & ~F.col("rendering").isin("absent", "n/a")).alias("rewrites")))


def rendering_crosstab(ents: DataFrame) -> DataFrame:
    forms = ["digits", "words", "absent", "n/a"]
    out = with_rendering(ents).groupBy(model_of().alias("model"), "realization").pivot("rendering", forms).count()
    return out.select("model", "realization", *(F.coalesce(F.col(f"`{f}`"), F.lit(0)).alias(f.replace("/", "_")) for f in forms))


def disagreement_topk(ents: DataFrame, k: int = 24) -> DataFrame:
    """The k rows on which models disagree most; all rows where there are no more than k. The report's own limit."""
    table = rendering_table(ents)
    every = table.agg(total().alias("_all"))  # one row
    some = table.join(F.broadcast(every)).where((F.col("forms") > 1) | (F.col("_all") <= k)).drop("_all")
    return some.orderBy(F.desc("spread"), "utterance_id", "mode", "condition", "type", "expected").limit(k)


def mode_coverage_check(rows: DataFrame) -> DataFrame:
    """Does every (condition, model) carry exactly the modes of the data."""
    names = lambda: F.array_join(F.array_sort(F.collect_set(mode_of())), ",")
    every = rows.agg(names().alias("_every"))
    return rows.groupBy("condition", model_of().alias("model")).agg(names().alias("modes")).join(F.broadcast(every)).select("condition", "model", "modes", (F.col("modes") == F.col("_every")).alias("complete"))


def condition_coverage(rows: DataFrame, conditions: DataFrame) -> DataFrame:
    seen = rows.groupBy("condition").agg(total().alias("rows"))
    return conditions.select(F.col("name").alias("condition")).join(seen, "condition", "left").select("condition", F.col("rows").isNotNull().alias("exercised"), F.coalesce("rows", F.lit(0)).alias("rows"))


def usage(rows: DataFrame, chars_per_second: float = 14.0, asr_rate: float = 0.00833, tts_rate: float = 3.0) -> DataFrame:
    """Distinct utterances, their characters, distinct audio, seconds and estimated cost."""
    n = F.length("hypothesis")
    per = rows.groupBy("utterance_id").agg(F.max(n).alias("chars"), total().alias("rows"))
    sums = per.agg(total().alias("utterances"), F.sum("chars").alias("chars"), F.sum(F.greatest(F.lit(1.0), F.col("chars") / chars_per_second) * F.col("rows")).alias("seconds"))
    cost = F.col("seconds") * asr_rate + F.col("chars") / 1000 * tts_rate
    return sums.join(rows.agg(F.count_distinct("audio_sha256").alias("audio"))).select("utterances", "chars", "audio", F.round("seconds", 4).alias("seconds"), F.round(cost, 4).alias("cost"))


def digits_of_gold(ents: DataFrame) -> DataFrame:
    return ents.select("utterance_id", "type", "expected", gold_digits(F.col("expected")).alias("digits")).distinct()
