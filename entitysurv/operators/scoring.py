"""Score rows: gold values against what a hypothesis yields, nested again; and the cause of each miss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from . import extraction as X

# The names of buckets, reasons and patterns.
BUCKETS = ["extractor_error", "gold_error", "uncertain", "asr_error"]  #: in the order of a report
DIGIT_TYPES = [t for t, _, _ in X.SHAPES]


def gold_of(rows: DataFrame, types: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(row_key, idx, type, expected, surface) of rows(row_key, gold), with the columns keep of their rows; only wanted
    types are scored."""
    g = rows.select("row_key", *keep, F.posexplode("gold").alias("idx", "g")).select("row_key", *keep, "idx", "g.type", "g.expected", "g.surface")
    return g.where(F.col("type").isin(*types)) if types else g


def score_rows(rows: DataFrame, lexicon: DataFrame, types: list[str] | None = None, ascii_only: bool = True, extracted: bool = False) -> DataFrame:
    """rows(row_key, reference, hypothesis, gold array<type, surface, expected>, ...) with wer, entities and confusions, all
    inside the row.

    entities: type, expected, expected_surface, hit, found, found_surface, edit_distance, candidates (all values of the
    type, in order of extraction). On a hit found is null and the distance 0; on a miss it is the nearest candidate, the
    first extracted on ties. confusions are the misses. A null hypothesis is an empty one; a row without gold has empty
    arrays. With a lexicon by language the column language picks the layer. Column names that begin with _ are taken.
    extracted keeps all candidates of the hypothesis under that name, so that triage need not read it again.
    """
    language = F.col("language") if "language" in lexicon.columns else None
    hypothesis = F.coalesce("hypothesis", F.lit(""))
    found = X.extracted(rows, lexicon, hypothesis, types, ascii_only, language)
    wanted = F.filter("gold", lambda g: g["type"].isin(*types)) if types else F.col("gold")
    kind = "array<struct<type:string,expected:string,expected_surface:string,hit:boolean,found:string,found_surface:string,edit_distance:int,candidates:array<string>>>"
    entities = F.transform(wanted, lambda g: X.scored_entity(g, F.col("_found"), F.col("_folded")))
    scored = X.fenced(found.withColumn("entities", F.coalesce(entities, F.array().cast(kind))), "entities")
    confusion = lambda e: F.struct(e["type"].alias("type"), e["expected"].alias("expected"), e["found"].alias("got"), e["found_surface"].alias("got_surface"), e["edit_distance"].alias("edit_distance"))
    wer = T.wer_in_task(F.col("reference"), hypothesis, not ascii_only)
    out = scored.withColumns({"wer": wer, "confusions": F.transform(F.filter("entities", lambda e: ~e["hit"]), confusion)})
    return out.select(*(c for c in rows.columns if c != "gold"), "entities", "wer", "confusions", *([F.col("_found").alias("extracted")] if extracted else []))


def amounts(nums: Column) -> Column:
    """What the runs of up to nine tokens of an array of number tokens read as, as normal forms of money."""
    runs = F.transform(nums, lambda first, i: F.filter(F.slice(nums, i + 1, F.lit(9)), lambda t: t["pos"] < first["pos"] + 9))
    read = lambda w: F.transform(F.sequence(F.lit(1), F.size(w)), lambda n: T.normalize_currency(N.parse_value(F.slice(w, F.lit(1), n))))
    return F.array_distinct(F.flatten(F.transform(runs, read)))


def value_present(rows: DataFrame, values: Column, text: Column, lexicon: DataFrame, ascii_only: bool = True, language: Column | None = None, found: Column | None = None) -> DataFrame:
    """rows with how, one entry for each of values array<(type, expected, ...)>: null where the value is not in the text at
    all, else the first that holds of typed (found under any type), digits or weak (the digits are in the text's digits; a
    digit type under six of them may be chance), amount (some run of up to nine tokens reads as the amount). found are the
    candidates of the text, if they are known; its numbers are read only where nothing else holds of an amount."""
    x = rows.withColumns({"_values": values, "_text": text})
    x = X.extracted(x, lexicon, F.col("_text"), None, ascii_only, language) if found is None else x.withColumn("_found", found)
    x = X.fenced(x.withColumn("_digits", T.normalize_digits(F.col("_text"))), "_digits")
    money = lambda v: v["type"] == "currency"

    def sure(v):
        wanted = F.when(money(v), F.substring_index(F.substring_index(v["expected"], ":", -1), ".", 1)).when(v["type"].isin(*DIGIT_TYPES), v["expected"])
        inside = F.coalesce((wanted != "") & F.contains(F.col("_digits"), wanted), F.lit(False))
        typed = F.coalesce(F.exists("_found", lambda c: c["normalized"] == v["expected"]), F.lit(False))
        how = F.when(typed, "typed").when(inside & ~money(v) & (F.length(v["expected"]) < 6), "weak").when(inside, "digits")
        return F.struct(how.alias("how"), F.when(money(v) & how.isNull(), v["expected"]).alias("open"))

    x = X.fenced(x.withColumn("_sure", F.transform("_values", sure)), "_sure")
    x = X.marked(x, lexicon, F.when(F.exists("_sure", lambda s: s["open"].isNotNull()), F.col("_text")), ascii_only, language)
    x = X.fenced(x.withColumn("_amounts", amounts(F.filter("_marks", lambda m: m["numberish"]))), "_amounts")
    how = F.transform("_sure", lambda s: F.coalesce(s["how"], F.when(F.array_contains("_amounts", s["open"]), "amount")))
    return X.fenced(x.withColumn("how", how).select(*rows.columns, "how"), "how")


def gold_found(rows: DataFrame, values: Column, text: Column, lexicon: DataFrame, ascii_only: bool = True, language: Column | None = None) -> DataFrame:
    """rows with known, one flag for each of values array<(type, expected, ...)>: whether the text yields it when only its
    type is wanted. The text is read once, and the competition of cues held for each type that has a value."""
    each = F.array_distinct(F.transform("_values", lambda v: v["type"]))
    x = X.extracted(rows.withColumn("_values", values), lexicon, text, None, ascii_only, language, alone=each)
    known = lambda v: F.coalesce(F.exists("_found", lambda c: (c["type"] == v["type"]) & (c["normalized"] == v["expected"])), F.lit(False))
    return X.fenced(x.withColumn("known", F.transform("_values", known)).select(*rows.columns, "known"), "known")


def triage(scored: DataFrame, lexicon: DataFrame, ascii_only: bool = True) -> DataFrame:
    """Every miss of score_rows' result (with error, condition, realization, template_id): bucket, reason, pattern.

    In this order: the call failed (uncertain); the gold value is not in its own reference (gold_error); it is in the
    hypothesis anyhow (extractor_error; uncertain where that may be chance); the hypothesis is blank (uncertain); else
    asr_error, by the distance of what was found instead. Only rows with a miss are read again, each text once, and not the
    hypothesis if score_rows kept what it extracted (all types, that is).
    """
    language = F.col("language") if "language" in lexicon.columns else None
    kept = ["row_key", "condition", "realization", "template_id", "error", "hypothesis", *(["language"] if language is not None else [])]
    missed = F.filter(F.transform("entities", lambda e, i: F.struct(i.alias("idx"), e["type"].alias("type"), e["expected"].alias("expected"), e["found"].alias("found"), e["edit_distance"].alias("edit_distance"), e["hit"].alias("hit"))), lambda e: ~e["hit"])
    held = ["extracted"] if "extracted" in scored.columns else []
    rows = scored.where(F.exists("entities", lambda e: ~e["hit"])).select(*kept, "reference", missed.alias("misses"), *held)
    present = value_present(rows, F.col("misses"), F.coalesce("hypothesis", F.lit("")), lexicon, ascii_only, language, found=F.col("extracted") if held else None).drop("extracted")
    reference = F.when(F.col("error").isNull(), F.coalesce("reference", F.lit("")))  # nothing more is asked of a failed call
    m = gold_found(present, F.col("misses"), reference, lexicon, ascii_only, language).select(*kept, F.explode(F.arrays_zip("misses", "known", "how")).alias("x")).select(*kept, "x.misses.*", "x.known", "x.how")
    failed, wrong, how = F.col("error").isNotNull(), ~F.col("known"), F.col("how")
    blank = F.trim(F.coalesce("hypothesis", F.lit(""))) == ""
    reason = F.when(failed, "call_error").when(wrong, "gold_error").when(how.isNotNull(), how).when(blank, "empty_hypothesis").when(F.col("found").isNull(), "dropped").otherwise("different")
    bucket = F.when(failed, "uncertain").when(wrong, "gold_error").when(how == "weak", "uncertain").when(how.isNotNull(), "extractor_error").when(blank, "uncertain").otherwise("asr_error")
    text = lambda *c: F.concat_ws("::", *(F.coalesce(x, F.lit("None")) for x in c))
    change = F.when(F.col("found").isNull(), "dropped").otherwise(F.concat(F.lit("d"), F.col("edit_distance").cast("string")))
    pattern = F.when(failed, text(F.lit("call_error"), F.col("condition"))).when(wrong, text(F.lit("gold_error"), F.col("type"), F.col("template_id"))).when(how.isNotNull(), text(bucket, F.col("type"), F.col("realization"), F.col("template_id"))).when(blank, text(F.lit("empty_hypothesis"), F.col("condition"))).otherwise(text(F.lit("asr_error"), F.col("type"), change, F.col("condition")))
    return m.select("row_key", "condition", "idx", "type", "expected", "found", "edit_distance", bucket.alias("bucket"), reason.alias("reason"), pattern.alias("pattern"))


def triage_header(scored: DataFrame) -> DataFrame:
    """One row: rows, utterances, conditions, entities, hits, misses and the rate; the names of the runs, implementations,
    models and modes, sorted, each - where it is null. Conditions are few and are collected: a second distinct count would
    copy every row."""
    names = lambda c: F.array_sort(F.collect_set(F.coalesce(c, F.lit("-")))).alias(c)
    hits = F.size(F.filter("entities", lambda e: e["hit"]))
    t = scored.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("row_key").alias("utterances"), F.size(F.collect_set("condition")).cast("long").alias("conditions"), F.coalesce(F.sum(F.size("entities")), F.lit(0)).alias("entities"), F.coalesce(F.sum(hits), F.lit(0)).alias("hits"), *map(names, ("run_id", "asr_impl", "asr_model", "asr_mode")))
    return t.withColumns({"misses": F.col("entities") - F.col("hits"), "rate": F.round(F.when(F.col("entities") > 0, F.col("hits") / F.col("entities")), 6)})
