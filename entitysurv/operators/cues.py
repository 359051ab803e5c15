"""Survival of cue words and orphaned values: a value that came through without the words that say what it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from . import extraction as X
from .metrics import rounded, total


def cue_index(lexicon: DataFrame) -> DataFrame:
    """(canon, cue_types): every canonical cue word with the types that it identifies."""
    return lexicon.where(F.size("cue_types") > 0).select("canon", "cue_types")


def cue_multiset(reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Per row and canonical word of tokens(row_key, canon, cue_types) how often it is in the reference and how many came
    through (bag intersection). Both sides are dealt once, by the row, which serves what joins the rows afterwards too."""
    side = lambda t, n_ref, n_hyp: t.select("row_key", "canon", "cue_types", F.lit(n_ref).alias("r"), F.lit(n_hyp).alias("h"))
    both = side(reference, 1, 0).unionByName(side(hypothesis, 0, 1)).repartition("row_key")
    n = both.groupBy("row_key", "canon").agg(F.first(F.when(F.col("r") == 1, F.col("cue_types")), ignorenulls=True).alias("cue_types"), F.sum("r").alias("n_ref"), F.sum("h").alias("n_hyp"))
    return n.where("n_ref > 0").select("row_key", "canon", "cue_types", "n_ref", F.least("n_ref", "n_hyp").alias("kept"))


def present_values(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Gold values that the hypothesis yields under any type."""
    return gold.join(candidates.select("row_key", F.col("normalized").alias("expected")).distinct(), ["row_key", "expected"], "left_semi")


def orphans(present: DataFrame, reference: DataFrame, hypothesis: DataFrame) -> DataFrame:
    """Present values whose type had a cue in the reference and has none in the hypothesis; cues_expected counts those."""
    cued = lambda t: t.where(F.size("cue_types") > 0).select("row_key", F.explode("cue_types").alias("type"))
    had = cued(reference).groupBy("row_key", "type").agg(total().alias("cues_expected"))
    return present.join(had, ["row_key", "type"]).join(cued(hypothesis).distinct(), ["row_key", "type"], "left_anti")


def read_in_rows(rows: DataFrame, lexicon: DataFrame) -> DataFrame:
    """rows(row_key, condition, reference, hypothesis, gold) of keys that come once: what cue_multiset, present_values and
    orphans make of them, inside the row, which each text needs to be read for once. (row_key, condition, cue_total,
    cue_kept, word_total, word_kept, value_present, orphans array<(type, expected, cues_expected, hit)>)."""
    fold = lambda c: T.folded_text(F.col(c), normalize=False)
    t = X.fenced(rows.select("row_key", "condition", "gold", fold("reference").alias("_said"), fold("hypothesis").alias("_heard")), "_said", "_heard")
    read, bag = L.reader(lexicon, parts=("found",)), L.bags(lexicon)
    t = t.select("row_key", "condition", "gold", read("_heard").alias("_read"), bag("_said", "_heard").alias("_bag"))
    t = X.fenced(t.select("row_key", "condition", "gold", "_bag.*", F.col("_read.found").alias("_found")), "_found", "lost")
    yields = lambda g, same: F.exists("_found", lambda c: (c["normalized"] == g["expected"]) & same(c))
    t = X.fenced(t.withColumn("_present", F.filter("gold", lambda g: yields(g, lambda c: F.lit(True)))), "_present")
    lost = lambda g: F.filter("lost", lambda x: x["type"] == g["type"])
    one = lambda g: F.struct(g["type"].alias("type"), g["expected"].alias("expected"), F.get(lost(g), F.lit(0))["n"].cast("long").alias("cues_expected"), yields(g, lambda c: c["type"] == g["type"]).alias("hit"))
    orphan = F.when(F.size("lost") > 0, F.transform(F.filter("_present", lambda g: F.size(lost(g)) > 0), one))
    return t.select("row_key", "condition", "cue_total", "cue_kept", "word_total", "word_kept", F.size("_present").alias("value_present"), orphan.alias("orphans"))


def summed(rows: DataFrame) -> DataFrame:
    """read_in_rows by condition and kinds of orphans, array<(type, hit)>: all that cue_survival asks of it, in one pass; n
    is the number of rows."""
    kinds = F.transform("orphans", lambda o: F.struct(o["type"].alias("type"), o["hit"].alias("hit"))).alias("orphans")
    figures = ("cue_total", "cue_kept", "word_total", "word_kept", "value_present")
    return rows.select("condition", kinds, *figures).groupBy("condition", "orphans").agg(*(F.sum(c).alias(c) for c in figures), total().alias("n"))


def word_counts(words: DataFrame, rows: DataFrame) -> DataFrame:
    """(condition, cue_total, cue_kept, word_total, word_kept) of each word of a cue_multiset."""
    is_cue = F.coalesce(F.size("cue_types") > 0, F.lit(False))
    count = lambda c, when: F.when(when, F.col(c)).otherwise(0)
    return words.join(rows.select("row_key", "condition"), "row_key").select("condition", count("n_ref", is_cue).alias("cue_total"), count("kept", is_cue).alias("cue_kept"), count("n_ref", ~is_cue).alias("word_total"), count("kept", ~is_cue).alias("word_kept"))


def cue_survival(counts: DataFrame, orphan: DataFrame, present: DataFrame) -> DataFrame:
    """Per condition: cue words and other words and how many survived; values present, orphans, those not recovered, and
    orphans by type. counts(condition, cue_total, cue_kept, word_total, word_kept) and present(condition, value_present) are
    summed, and so is orphan(condition, type, hit, n)."""
    w = counts.where("cue_total + word_total > 0").groupBy("condition").agg(*(F.sum(c).alias(c) for c in ("cue_total", "cue_kept", "word_total", "word_kept")))
    by_type = orphan.groupBy("condition", "type").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit"), 0).otherwise(F.col("n"))).alias("lost"))
    o = by_type.groupBy("condition").agg(F.sum("n").alias("orphans"), F.sum("lost").alias("unrecovered"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("by_type"))  # one entry per type
    p = present.groupBy("condition").agg(F.sum("value_present").alias("value_present"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = w.join(p, "condition", "left").join(o, "condition", "left")
    return out.select("condition", "cue_total", "cue_kept", "word_total", "word_kept", zero("value_present"), zero("orphans"), zero("unrecovered"), F.coalesce("by_type", F.expr("cast(map() as map<string,bigint>)")).alias("by_type"))


def cue_totals(survival: DataFrame, shaped: list[str]) -> DataFrame:
    """One row over all conditions: values present, orphans, those not recovered, and orphans of types with and without a
    length shape."""
    values = lambda keep: F.aggregate(F.filter(F.map_entries("by_type"), lambda e: e["key"].isin(*shaped) == F.lit(keep)), F.lit(0).cast("long"), lambda s, e: s + e["value"])
    sums = {"value_present": F.col("value_present"), "orphans": F.col("orphans"), "unrecovered": F.col("unrecovered"), "shaped": values(True), "unshaped": values(False)}
    return survival.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(n) for n, c in sums.items()))


def cue_figures(survival: DataFrame, rows: int | Column, modes: list[str], shaped: list[str]) -> DataFrame:
    """The figures as one JSON document: modes, rows, all figures of every condition by name, orphans by type, the types
    with a length shape and the totals."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    one = F.struct(
        "condition", F.col("cue_total").alias("cueTotal"), F.col("cue_kept").alias("cueKept"), share("cue_kept", "cue_total").alias("cueSurvival"),
        F.col("word_total").alias("wordTotal"), F.col("word_kept").alias("wordKept"), share("word_kept", "word_total").alias("wordSurvival"),
        F.col("value_present").alias("valuePresent"), "orphans", F.col("unrecovered").alias("orphansUnrecovered"), F.col("by_type").alias("orphansByType"),
    )
    by_name = lambda a, b: F.when(a["condition"] < b["condition"], -1).when(a["condition"] > b["condition"], 1).otherwise(0)
    zero = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    types = survival.select(F.explode("by_type").alias("type", "n")).groupBy("type").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("orphansByType"))  # one entry per type
    all_ = survival.agg(F.array_sort(F.collect_list(one), by_name).alias("conditions"), F.struct(zero("orphans", "orphans"), zero("unrecovered", "orphansUnrecovered"), zero("value_present", "valuePresent")).alias("totals"))  # one struct per condition
    doc = F.struct(F.array(*map(F.lit, modes)).alias("modes"), (rows if isinstance(rows, Column) else F.lit(rows)).cast("long").alias("rows"), "conditions", "orphansByType", F.array(*map(F.lit, sorted(shaped))).alias("shapedTypes"), "totals")
    return all_.crossJoin(types).select(F.to_json(doc).alias("document"))  # one row each


def orphan_rate_rank(survival: DataFrame, bursty: list[str], clean: str) -> DataFrame:
    """Conditions by orphan rate, worst first, with how cue words fared against the clean condition, and whether the
    condition is the bursty one that keeps the fewest cues; bursty_orphans is the sum over all bursty ones."""
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    is_bursty = F.col("condition").isin(*bursty)
    r = survival.select("condition", "orphans", rate("orphans", "value_present").alias("r"), rate("cue_kept", "cue_total").alias("s"), is_bursty.alias("bursty"))
    one = r.agg(F.max(F.when(F.col("condition") == clean, F.col("s"))).alias("clean"), F.coalesce(F.sum(F.when(F.col("bursty"), F.col("orphans"))), F.lit(0)).alias("bursty_orphans"), F.min_by("condition", F.when(F.col("bursty"), F.struct("s", "condition"))).alias("worst"))
    out = r.join(F.broadcast(one))  # one row
    return out.select("condition", "orphans", rounded(F.col("r")).alias("orphan_rate"), rounded(F.col("s")).alias("cue_survival"), rounded(F.col("s") - F.col("clean")).alias("against_clean"), F.coalesce(F.col("condition") == F.col("worst"), F.lit(False)).alias("least_kept"), "bursty_orphans")
