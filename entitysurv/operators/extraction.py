"""Typed values from text, inside the row: number runs, cues, competition and dates are arrays of the row that holds the
text, so extraction has no shuffle, no join and no table of its own; its relations are these arrays, exploded.

Words are scanned and number runs folded over Arrow batches (`functions/reading.py`); the rest is column expressions. A step
that others read more than once is a column of its own (`annotate`); work and memory of a row grow with its text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import reading
from ..functions import text as T
from ..functions.lexicon import canonicalize, lookup, reader
from ..functions.reading import AHEAD, ALL_TYPES, BEHIND, CANDIDATE, SHAPES
from ..sources.io import staged  # noqa: F401  (callers stage with X.staged)

# The form of a word, and of a date in digits.
_WORDS = "([0-9]+|[₹$]|[^0-9₹$ ]+)"  #: of a text whose separators are all spaces
_DATE = r"\b([0-9]{1,2})\s*[/.\-]\s*([0-9]{1,2})\s*[/.\-]\s*([0-9]{2,4})\b"


_ONE = "struct<type:string,normalized:string,cue:string>"


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _first(xs: Column) -> Column:
    return F.get(xs, F.lit(0))


def fenced(df: DataFrame, *names: str) -> DataFrame:
    """df with the columns of these names behind a generator of one row: the optimizer would copy a later filter on them,
    or on what explodes them, through all the steps that made them, and each step reads the one before more than once."""
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.explode(F.array(F.struct(*names))).alias("_row")).select(*rest, *(F.col("_row")[n].alias(n) for n in names))


def tokenize(texts: DataFrame) -> DataFrame:
    """(row_key, pos, text, start, end): words, digit runs and currency signs with their place in the folded text."""
    return texts.select("row_key", reading.tokens(F.col("folded")).alias("tokens")).select("row_key", F.explode("tokens").alias("t")).select("row_key", "t.*")


def words(texts: DataFrame, fold: Callable[[Column], Column] = lambda words: words) -> DataFrame:
    """(row_key, text): the same words without their places; fold may change the array of a text's words."""
    spaced = F.translate("folded", reading.SEPARATORS, " " * len(reading.SEPARATORS))
    return texts.select("row_key", F.explode(fold(F.regexp_extract_all(spaced, F.lit(_WORDS)))).alias("text"))


def _is_digits(text: Column) -> Column:
    return text.rlike("^[0-9]+$")


def _mark(text: Column, known: Column) -> dict[str, Column]:
    """kind, value, month, cue_types and numberish of a token, from what the lexicon knows of it; digits speak for
    themselves."""
    digits = _is_digits(text)
    kind = F.when(digits, "digits").otherwise(known["kind"])
    value = F.when(digits, text.try_cast("decimal(28,6)")).otherwise(known["value"])
    return {"kind": kind, "value": value, "month": F.when(~digits, known["month"]), "cue_types": F.when(~digits, known["cue_types"]), "numberish": kind.isNotNull()}


def with_lexicon(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds kind, value, month, cue_types and numberish to tokens(row_key, text, ..., and language, if the lexicon has
    one). The lexicon is a constant of the plan, so no token moves."""
    look = lookup(lexicon)
    known = tokens.withColumn("_known", look(canonicalize(F.col("text")), F.col("language") if "language" in tokens.columns else None))
    return known.withColumns(_mark(F.col("text"), F.col("_known"))).drop("_known")


def _read(texts: DataFrame, lexicon: DataFrame, text: Column, ascii_only: bool, language: Column | None, p: str, **asked) -> DataFrame:
    """texts with p + folded and the struct p + read of what is asked of the scan: see reading.reader."""
    wanted = asked.pop("alone", None)
    by_language = "language" in lexicon.columns
    if by_language and language is None:
        raise ValueError("a lexicon by language needs the language of each text")
    read = reader(lexicon, alone=wanted is not None, **asked)
    t = fenced(texts.withColumn(p + "folded", T.folded_text(text, normalize=not ascii_only)), p + "folded")
    return t.withColumn(p + "read", read(F.col(p + "folded"), *([language] if by_language else []), *([wanted] if wanted is not None else [])))


def annotate(texts: DataFrame, lexicon: DataFrame, text: Column, ascii_only: bool = True, language: Column | None = None, p: str = "_", numbers: bool = False) -> DataFrame:
    """texts with the arrays that extraction reads, each name after the prefix p: folded (the text), marks (months, cues
    and, if numbers are asked for, the words of numbers), cues (of these the cues) and runs.

    A run is a maximal run of number tokens: lo, hi, start, end, prev_hi, next_lo (the ends of its neighbours), its
    readings (run_kind, digits, value, lenient), and split: one half of a broken expression, as the next run begins, one
    or two tokens on, with a scale. language picks the layer of a lexicon by language.
    """
    t = _read(texts, lexicon, text, ascii_only, language, p, numbers=numbers)
    t = t.withColumns({p + "marks": F.col(p + "read")["marks"], p + "runs": F.col(p + "read")["runs"]})
    t = t.withColumn(p + "cues", F.filter(p + "marks", lambda m: F.size(m["cue_types"]) > 0))
    return fenced(t.drop(p + "read"), *(p + x for x in ("folded", "marks", "cues", "runs")))


def with_runs(texts: DataFrame, lexicon: DataFrame, text: Column, ascii_only: bool = True, language: Column | None = None, p: str = "_") -> DataFrame:
    """texts with p + runs alone: see annotate."""
    t = _read(texts, lexicon, text, ascii_only, language, p, parts=("runs",))
    return fenced(t.withColumn(p + "runs", F.col(p + "read")["runs"]).drop(p + "read", p + "folded"), p + "runs")


def marked(texts: DataFrame, lexicon: DataFrame, text: Column, ascii_only: bool = True, language: Column | None = None, p: str = "_") -> DataFrame:
    """texts with p + marks alone, the words of numbers among them: see annotate. Null for a null text."""
    t = _read(texts, lexicon, text, ascii_only, language, p, numbers=True, parts=("marks",))
    return fenced(t.withColumn(p + "marks", F.col(p + "read")["marks"]).drop(p + "read", p + "folded"), p + "marks")


def extracted(texts: DataFrame, lexicon: DataFrame, text: Column, types: list[str] | None = None, ascii_only: bool = True, language: Column | None = None, p: str = "_", numbers: bool = False, alone: Column | None = None) -> DataFrame:
    """texts with p + folded, p + found (the candidates of annotate and with_candidates, from the scan itself) and, if
    numbers are asked for, p + marks. alone is an array of types for each text, each of which competes as if only it were
    wanted; a text without any has no candidates."""
    parts = ("found", "marks") if numbers else ("found",)
    t = _read(texts, lexicon, text, ascii_only, language, p, numbers=numbers, types=types, parts=parts, alone=alone)
    return fenced(t.withColumns({p + x: F.col(p + "read")[x] for x in parts}).drop(p + "read"), p + "folded", *(p + x for x in parts))


def cue_hits(types: list[str], p: str = "_") -> Column:
    """For each run and each of types, in this order, the nearest cue (dist, behind, cue): within the window and not beyond
    another number; before wins ties; null if there is none."""
    runs, cues = F.col(p + "runs"), F.col(p + "cues")
    none = F.array(*(F.lit(None).cast("struct<dist:int,behind:boolean,cue:string>") for _ in types))

    def hits(r):
        lowest = F.greatest(r["lo"] - BEHIND, F.coalesce(r["prev_hi"], F.lit(0)))
        highest = F.least(r["hi"] + AHEAD - 1, F.coalesce(r["next_lo"] - 1, F.lit(1 << 30)))
        window = F.struct(r["lo"].alias("lo"), r["hi"].alias("hi"), lowest.alias("lowest"), highest.alias("highest"))

        def place(m, w):
            hit = lambda dist, behind: F.struct(F.struct(dist.alias("dist"), F.lit(behind).alias("behind"), m["text"].alias("cue")).alias("hit"), m["cue_types"].alias("types"))
            return F.when((m["pos"] < w["lo"]) & (m["pos"] >= w["lowest"]), hit(w["lo"] - m["pos"], False)).when((m["pos"] >= w["hi"]) & (m["pos"] <= w["highest"]), hit(m["pos"] - w["hi"] + 1, True))

        nearest = lambda found, t: F.array_min(F.transform(found, lambda m: F.when(F.array_contains(m["types"], t), m["hit"])))
        near = F.transform(F.array(window), lambda w: F.filter(F.transform(cues, lambda m: place(m, w)), lambda m: m.isNotNull()))
        return _first(F.transform(near, lambda found: F.when(F.size(found) > 0, F.array(*(nearest(found, t) for t in types))).otherwise(none)))

    return F.transform(runs, lambda r: F.when(F.size(cues) > 0, hits(r)).otherwise(none))


def run_candidates(types: list[str], p: str = "_") -> Column:
    """Competition of cues, and the length shapes where no cue was used: the candidates of all runs."""
    digit = sorted(t for t, _, _ in SHAPES if t in types)
    shapes = [(t, lo, hi) for t, lo, hi in SHAPES if t in digit]
    wants_money = F.lit("currency" in types)
    one = lambda t, norm, cue: F.struct(t.alias("type"), norm.alias("normalized"), cue.alias("cue"))

    def found(r, h):
        best = F.array_min(F.array(*(h[i]["dist"] for i in range(len(digit))), F.lit(None).cast("int")))
        magnitude = r["run_kind"] == "magnitude"
        amount = F.coalesce(r["value"], F.when(~magnitude, N.amount_from_digits(r["digits"])))
        seen = F.struct(r.alias("r"), h.alias("h"), best.alias("best"), magnitude.alias("magnitude"), amount.alias("amount"))
        return _first(F.transform(F.transform(F.array(seen), judged), candidates))

    def judged(x):
        cur, best = x["h"][len(digit)], x["best"]
        money = F.when(x["magnitude"], x["r"]["value"].isNotNull()).otherwise(cur.isNotNull() & x["amount"].isNotNull() & (best.isNull() | (cur["dist"] <= best)))
        cued = ~x["magnitude"] & best.isNotNull() & (cur.isNull() | (best <= cur["dist"]))
        return F.struct(x["r"].alias("r"), x["h"].alias("h"), x["magnitude"].alias("magnitude"), x["amount"].alias("amount"), money.alias("money"), cued.alias("cued"))

    def candidates(x):
        r, h, money = x["r"], x["h"], x["money"] & wants_money
        cur, others = h[len(digit)], [h[i] for i in range(len(digit))]
        closed = x["magnitude"] | x["cued"] | (money & r["value"].isNotNull())
        some = lambda xs: F.filter(F.array(*xs, F.lit(None).cast(_ONE)), lambda x: x.isNotNull())
        by_cue = some(F.when(x.isNotNull(), one(F.lit(t), r["digits"], x["cue"])) for t, x in zip(digit, others, strict=True))
        by_shape = some(F.when(F.length(r["digits"]).between(lo, hi), one(F.lit(t), r["digits"], F.lit(None).cast("string"))) for t, lo, hi in shapes)
        amounts = F.when(money, F.array(one(F.lit("currency"), T.normalize_currency(x["amount"]), cur["cue"]))).otherwise(_none(_ONE))
        rest = F.when(x["cued"], by_cue).when(~F.coalesce(closed, F.lit(False)), by_shape).otherwise(_none(_ONE))
        return F.transform(F.concat(amounts, rest), lambda x, k: F.struct(x["type"].alias("type"), x["normalized"].alias("normalized"), r["start"].alias("start"), r["end"].alias("end"), F.lit(0).alias("part"), k.alias("k"), x["cue"].alias("cue")))

    return F.flatten(F.zip_with(F.col(p + "runs"), cue_hits([*digit, "currency"], p), lambda r, h: F.when(~r["split"], found(r, h)).otherwise(_none(CANDIDATE))))


def _date(normalized: Column, start: Column, end: Column, part: int, k: Column) -> Column:
    return F.struct(F.lit("date").alias("type"), normalized.alias("normalized"), start.cast("int").alias("start"), end.cast("int").alias("end"), F.lit(part).alias("part"), k.alias("k"), F.lit(None).cast("string").alias("cue"))


def digit_dates(folded: Column) -> Column:
    """The dates of a text that are written in digits, as candidates."""
    found = F.regexp_extract_all(folded, F.lit(_DATE), F.lit(0))
    place = lambda s, x, at: F.struct((at + F.length(x)).alias("at"), F.concat(s["found"], F.array(F.struct(x.alias("m"), (at - 1).alias("start")))).alias("found"))
    step = lambda s, x: _first(F.transform(F.array(F.call_function("locate", x, folded, s["at"])), lambda at: place(s, x, at)))
    placed = F.aggregate(found, F.struct(F.lit(1).alias("at"), _none("struct<m:string,start:int>").alias("found")), step, lambda s: s["found"])

    def date(x, k):
        part = lambda g: F.regexp_extract(x["m"], _DATE, g).cast("int")
        year = F.when(part(3) < 100, part(3) + 2000).otherwise(part(3))
        ok = part(2).between(1, 12) & part(1).between(1, 31)
        return F.when(ok, _date(T.normalize_date(year, part(2), part(1)), x["start"], x["start"] + F.length(x["m"]), 1, k))

    return F.filter(F.transform(placed, date), lambda x: x.isNotNull())


def word_dates(p: str = "_") -> Column:
    """A month word with number runs beside it: the day before or after, a year after or one token further."""
    runs = F.col(p + "runs")
    at = lambda key, pos: F.when(F.size(runs) > 0, _first(F.filter(runs, lambda r: r[key] == pos)))
    months = F.filter(F.col(p + "marks"), lambda m: m["month"].isNotNull())
    beside = F.transform(months, lambda m: F.struct(m.alias("m"), at("hi", m["pos"]).alias("b"), at("lo", m["pos"] + 1).alias("a")))
    beyond = F.transform(beside, lambda x: F.struct(x["m"].alias("m"), x["b"].alias("b"), x["a"].alias("a"), at("lo", x["a"]["hi"] + 1).alias("n")))

    def date(x):
        whole = lambda r: F.floor(r["lenient"]).cast("long")
        b, a, n, m = whole(x["b"]), whole(x["a"]), whole(x["n"]), x["m"]
        day_before, year_next = b.between(1, 31), a >= 1000
        day_after = ~F.coalesce(day_before, F.lit(False)) & a.between(1, 31)
        day = F.when(day_before, b).when(day_after, a)
        year = F.when(year_next, a).when(day.isNotNull() & (a <= 31) & (n >= 1000), n)
        end = F.when(year_next, x["a"]["end"]).when(year.isNotNull(), x["n"]["end"]).when(day_after, x["a"]["end"]).otherwise(m["end"])
        start = F.when(day_before, x["b"]["start"]).otherwise(m["start"])
        return F.when(day.isNotNull(), _date(T.normalize_date(year, m["month"], day), start, end, 2, m["pos"]))

    return F.filter(F.transform(beyond, date), lambda x: x.isNotNull())


def with_candidates(annotated: DataFrame, types: list[str] | None = None, out: str = "_found", p: str = "_", when: Column | None = None) -> DataFrame:
    """annotated with the candidates array<(type, normalized, start, end, part, k, cue)> for one set of types. The set is
    no filter on the result: cues are looked up for these types only, and dates hide what lies inside them only if dates
    are wanted. Rows where `when` is false get an empty array, and no work."""
    types = types or ALL_TYPES
    lazy = lambda x: x if when is None else F.when(when, x).otherwise(_none(CANDIDATE))
    runs = annotated.withColumn(out, lazy(run_candidates(types, p)))
    if "date" not in types:
        return fenced(runs, out)
    dated = runs.withColumn(out + "_dates", lazy(F.concat(digit_dates(F.col(p + "folded")), word_dates(p))))
    dates = F.col(out + "_dates")
    kept = F.filter(out, lambda c: ~F.exists(dates, lambda d: (d["start"] <= c["start"]) & (c["end"] <= d["end"])))
    return fenced(dated.withColumn(out, F.when(F.size(dates) > 0, F.concat(kept, dates)).otherwise(F.col(out))).drop(out + "_dates"), out)


def _texts(texts: DataFrame) -> tuple[DataFrame, Column | None]:
    return texts.select("row_key", "text", *(["language"] if "language" in texts.columns else [])), F.col("language") if "language" in texts.columns else None


def number_runs(texts: DataFrame, lexicon: DataFrame, ascii_only: bool = True) -> DataFrame:
    """The number runs of texts(row_key, text), one row each: see annotate."""
    t, language = _texts(texts)
    return with_runs(t, lexicon, F.col("text"), ascii_only, language).select("row_key", F.explode("_runs").alias("r")).select("row_key", "r.*")


def cue_scan(texts: DataFrame, lexicon: DataFrame, types: list[str], ascii_only: bool = True) -> DataFrame:
    """(row_key, lo, type, dist, behind, cue): the nearest cue of each type for each number run of texts(row_key, text)."""
    t, language = _texts(texts)
    hits = annotate(t, lexicon, F.col("text"), ascii_only, language).withColumn("h", cue_hits(types))
    each = hits.select("row_key", F.explode(F.arrays_zip(F.col("_runs").alias("r"), F.col("h").alias("h"))).alias("x"))
    named = F.array(*(F.struct(F.lit(t).alias("type"), F.col("x.h")[i].alias("hit")) for i, t in enumerate(types)))
    return each.select("row_key", F.col("x.r.lo").alias("lo"), F.explode(named).alias("y")).where("y.hit is not null").select("row_key", "lo", "y.type", "y.hit.*")


def numeric_dates(texts: DataFrame) -> DataFrame:
    """The dates in digits of texts(row_key, folded), as candidates."""
    return texts.select("row_key", F.explode(digit_dates(F.col("folded"))).alias("c")).select("row_key", "c.*")


def month_dates(texts: DataFrame, lexicon: DataFrame, ascii_only: bool = True) -> DataFrame:
    """The dates with a month word of texts(row_key, text), as candidates."""
    t, language = _texts(texts)
    return annotate(t, lexicon, F.col("text"), ascii_only, language).select("row_key", F.explode(word_dates()).alias("c")).select("row_key", "c.*")


def extract_entities(texts: DataFrame, lexicon: DataFrame, types: list[str] | None = None, ascii_only: bool = True, name_extractor: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Candidates (row_key, type, normalized, start, end, part, k, cue) of texts(row_key, text), with language if the
    lexicon is one by language.

    types is not a filter on the result, see with_candidates; empty means all. (part, start, k) is the order of emission,
    which breaks ties later. name_extractor may add candidates of its own, as a DataFrame function. A null text has no
    candidates.
    """
    t, language = _texts(texts)
    found = extracted(t, lexicon, F.col("text"), types, ascii_only, language)
    out = found.select("row_key", F.explode("_found").alias("c")).select("row_key", "c.*")
    return out.unionByName(name_extractor(texts), allowMissingColumns=True) if name_extractor else out


def scored_entity(g: Column, found: Column, folded: Column) -> Column:
    """One gold value (type, surface, expected) against the candidates of its type: hit, else the nearest by edit distance
    (the one extracted first wins ties), and all of them in the order of extraction. On a hit nothing is found and the
    distance is 0."""
    mine = F.filter(found, lambda c: (c["type"] == g["type"]) & c["normalized"].isNotNull())

    def score(x):
        hit = F.exists(x["mine"], lambda c: c["normalized"] == x["g"]["expected"])
        order = lambda c: F.struct(F.levenshtein(x["g"]["expected"], c["normalized"]).alias("distance"), c["part"], c["start"], c["k"], c["normalized"].alias("normalized"), c["end"].alias("end"))
        near = F.when(~hit, F.array_min(F.transform(x["mine"], order)))
        return F.struct(x["g"].alias("g"), hit.alias("hit"), near.alias("near"), F.transform(F.sort_array(F.transform(x["mine"], lambda c: F.struct(c["part"], c["start"], c["k"], c["normalized"]))), lambda c: c["normalized"]).alias("candidates"))

    def shape(x):
        g_, near = x["g"], x["near"]
        surface = F.substr(folded, near["start"] + 1, near["end"] - near["start"])
        distance = F.when(x["hit"], 0).otherwise(near["distance"])
        return F.struct(g_["type"].alias("type"), g_["expected"].alias("expected"), g_["surface"].alias("expected_surface"), x["hit"].alias("hit"), near["normalized"].alias("found"), surface.alias("found_surface"), distance.alias("edit_distance"), x["candidates"].alias("candidates"))

    bound = F.transform(F.array(F.struct(g.alias("g"), mine.alias("mine"))), score)
    return _first(F.transform(bound, shape))


def gold_match(gold: DataFrame, candidates: DataFrame) -> DataFrame:
    """Each gold value (row_key, idx, type, expected) against candidates(row_key, type, ...) that another relation holds:
    as scored_entity, with the number of candidates. Rows that hold both need no join: see scoring.score_rows."""
    order = F.struct(F.levenshtein("expected", "normalized"), F.col("part"), F.col("start"), F.col("k"))
    some = F.col("normalized").isNotNull()
    joined = gold.join(candidates, ["row_key", "type"], "left").groupBy("row_key", "idx", "type", "expected").agg(
        F.coalesce(F.bool_or(F.col("normalized") == F.col("expected")), F.lit(False)).alias("hit"),
        F.min_by("normalized", F.when(some, order)).alias("nearest"),
        F.count("normalized").alias("candidates"),
    )
    return joined.select("row_key", "idx", "type", "expected", "hit", F.when(~F.col("hit"), F.col("nearest")).alias("found"), F.when(F.col("hit"), 0).otherwise(F.levenshtein("expected", "nearest")).alias("edit_distance"), "candidates")
