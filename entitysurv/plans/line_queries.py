"""Calls over a poor line with known damage: scoring, triage, re-scoring, cue survival. The damage is fixed by the row's
key, so that SQL can say what every score must be."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import cues as C
from ..operators import extraction as X
from ..operators import guards as G
from ..operators import metrics as M
from ..operators import scoring as S
from ..sources import io
from . import demo
from .call_queries import DIGITS_SQL, GOLD_SQL, TEXTS_SQL, calls, word_count_sql, words_sql
from .registry import query

#: What happened by kind = o_orderkey // 2 % 9, and the condition it counts under.
DAMAGE = ["nothing", "call failed", "blank", "last digit of the code wrong", "account lost", "code broken in two", "currency word lost", "code word lost", "account word lost"]
CONDITIONS = ["clean", "lost", "lost", "noisy", "noisy", "bursty", "bursty", "bursty", "noisy"]
BURSTY = ["bursty"]
NO_PIN = "9999999"

LINES = f"""WITH {DIGITS_SQL},
line AS (SELECT *, o_orderkey // 2 % 9 AS kind, {CONDITIONS}[o_orderkey // 2 % 9 + 1] AS condition, 't' || (o_orderkey % 7) AS template_id,
  left(otp, 5) || ((right(otp, 1)::INTEGER + 1) % 10) AS otp2 FROM o),
said AS (SELECT *, CASE WHEN kind = 1 THEN 'timeout' END AS error, CASE WHEN kind IN (1, 2) THEN '' ELSE 'your ' || CASE WHEN kind = 7 THEN '' ELSE 'code ' END || 'is '
  || CASE kind WHEN 3 THEN otp2 WHEN 5 THEN left(otp, 3) || ' blah ' || right(otp, 3) ELSE otp END || ' for the ' || CASE kind WHEN 4 THEN '' WHEN 8 THEN account || ' ' ELSE 'account ' || account || ' ' END
  || 'it has a pending sum of ' || CASE WHEN kind = 6 THEN '' ELSE 'rupees ' END || grouped || ' due on the ' || strftime(o_orderdate, '%d/%m/%Y') END AS hypothesis FROM line),
heard AS (SELECT *, regexp_replace(hypothesis, '[^0-9]', '', 'g') AS digits FROM said),
ent AS (SELECT *, 0 AS idx, 'otp' AS type, otp AS expected, kind IN (0, 4, 6, 8) AS hit, CASE kind WHEN 3 THEN otp2 WHEN 5 THEN left(otp, 3) END AS found,
    list_filter([CASE kind WHEN 3 THEN otp2 WHEN 5 THEN left(otp, 3) WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 7 THEN NULL ELSE otp END, CASE WHEN kind = 6 AND length(amount) BETWEEN 4 AND 6 THEN amount END], lambda x: x IS NOT NULL) AS candidates FROM heard
  UNION ALL SELECT *, 1, 'account_number', account, kind IN (0, 3, 5, 6, 7, 8), NULL,
    list_filter([CASE kind WHEN 3 THEN otp2 WHEN 5 THEN right(otp, 3) WHEN 0 THEN otp WHEN 6 THEN otp WHEN 7 THEN otp END, CASE WHEN kind IN (0, 3, 5, 6, 7, 8) THEN account END], lambda x: x IS NOT NULL) FROM heard
  UNION ALL SELECT *, 2, 'currency', 'INR:' || amount || '.00', kind IN (0, 3, 4, 5, 7, 8), NULL, CASE WHEN kind IN (0, 3, 4, 5, 7, 8) THEN ['INR:' || amount || '.00'] ELSE [] END FROM heard
  UNION ALL SELECT *, 3, 'date', strftime(o_orderdate, '%Y-%m-%d'), kind NOT IN (1, 2), NULL, CASE WHEN kind NOT IN (1, 2) THEN [strftime(o_orderdate, '%Y-%m-%d')] ELSE [] END FROM heard
  UNION ALL SELECT *, 4, 'pin_code', '{NO_PIN}', false, CASE WHEN length(amount) = 6 THEN amount END, CASE WHEN length(amount) = 6 THEN [amount] ELSE [] END FROM heard WHERE kind = 6),
miss AS (SELECT *, CASE WHEN found IS NOT NULL THEN levenshtein(expected, found) END::INT AS edit_distance,
  CASE WHEN kind = 1 THEN 'call_error' WHEN type = 'pin_code' THEN 'gold_error' WHEN kind = 7 THEN 'typed' WHEN kind = 6 OR type IN ('otp', 'account_number') AND contains(digits, expected) THEN 'digits'
    WHEN kind = 2 THEN 'empty_hypothesis' WHEN kind = 5 THEN 'digits' WHEN found IS NULL THEN 'dropped' ELSE 'different' END AS reason FROM ent WHERE NOT hit),
cause AS (SELECT o_orderkey AS row_key, condition, idx, type, expected, found, edit_distance, reason, CASE reason WHEN 'call_error' THEN 'uncertain' WHEN 'gold_error' THEN 'gold_error' WHEN 'typed' THEN 'extractor_error' WHEN 'digits' THEN 'extractor_error' WHEN 'empty_hypothesis' THEN 'uncertain' ELSE 'asr_error' END AS bucket,
  CASE reason WHEN 'call_error' THEN 'call_error::' || condition WHEN 'gold_error' THEN 'gold_error::' || type || '::' || template_id WHEN 'empty_hypothesis' THEN 'empty_hypothesis::' || condition WHEN 'dropped' THEN 'asr_error::' || type || '::dropped::' || condition
    WHEN 'different' THEN 'asr_error::' || type || '::d' || edit_distance || '::' || condition ELSE 'extractor_error::' || type || '::' || realization || '::' || template_id END AS pattern FROM miss)
"""


def lines(spark, sf) -> DataFrame:
    """(row_key, condition, realization, template_id, reference, hypothesis, error, gold): see DAMAGE."""
    c = calls(spark, sf)
    kind = F.floor(F.col("row_key") / 2) % 9
    is_ = lambda *k: kind.isin(*k)
    changed = F.concat(F.left("otp", F.lit(5)), ((F.right("otp", F.lit(1)).cast("int") + 1) % 10).cast("string"))
    code = F.when(is_(3), changed).when(is_(5), F.concat_ws(" ", F.left("otp", F.lit(3)), F.lit("blah"), F.right("otp", F.lit(3)))).otherwise(F.col("otp"))
    account = F.when(is_(4), None).when(is_(8), F.col("account")).otherwise(F.concat(F.lit("account "), F.col("account")))
    said = F.concat_ws(" ", F.lit("your"), F.when(~is_(7), "code"), F.lit("is"), code, F.lit("for the"), account, F.lit("it has a pending sum of"), F.when(~is_(6), "rupees"), T.indian_grouping(F.col("amount")), F.lit("due on the"), F.date_format("date", "dd/MM/yyyy"))
    one = lambda t, surface, value: F.struct(F.lit(t).alias("type"), surface.alias("surface"), value.alias("expected"))
    gold = [one("otp", F.col("otp"), F.col("otp")), one("account_number", F.col("account"), F.col("account")), one("currency", T.indian_grouping(F.col("amount")), T.normalize_currency(F.col("amount"))), one("date", F.date_format("date", "dd/MM/yyyy"), F.date_format("date", "yyyy-MM-dd"))]
    extra = F.when(is_(6), one("pin_code", F.lit(NO_PIN), F.lit(NO_PIN)))
    return c.select(
        "row_key", F.element_at(F.array(*map(F.lit, CONDITIONS)), (kind + 1).cast("int")).alias("condition"), "realization", F.concat(F.lit("t"), (F.col("row_key") % 7).cast("string")).alias("template_id"),
        F.col("text").alias("reference"), F.when(is_(1, 2), "").otherwise(said).alias("hypothesis"), F.when(is_(1), "timeout").alias("error"), F.filter(F.array(*gold, extra), lambda e: e.isNotNull()).alias("gold"),
    )


def scored(spark, sf) -> DataFrame:
    return S.score_rows(lines(spark, sf), L.lexicon(spark))


def entities(df: DataFrame) -> DataFrame:
    return df.select("row_key", "condition", "realization", F.posexplode("entities").alias("idx", "e"), "wer", "confusions").select("row_key", "condition", "realization", "idx", "e.*", "wer", F.size("confusions").alias("confusions"))


@query(LINES + """SELECT o_orderkey AS row_key, idx, type, expected, CASE type WHEN 'currency' THEN grouped WHEN 'date' THEN strftime(o_orderdate, '%d/%m/%Y') ELSE expected END AS expected_surface, hit, found, found AS found_surface,
  CASE WHEN hit THEN 0 WHEN found IS NOT NULL THEN levenshtein(expected, found) END::INT AS edit_distance, array_to_string(candidates, ' ') AS candidates, (count(*) FILTER (NOT hit) OVER (PARTITION BY o_orderkey))::INT AS confusions,
  CASE WHEN realization = 'digits' AND kind < 4 THEN round(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 1 / (21 + len(string_split(grouped, ',')))::DOUBLE ELSE 1 END, 6) END::DOUBLE AS wer FROM ent""")
def score_rows(spark, sf):
    """Word error rates are shown where SQL can tell them: digit sentences with at most one word changed."""
    e = entities(scored(spark, sf))
    known = (F.col("realization") == "digits") & (F.floor(F.col("row_key") / 2) % 9 < 4)
    return e.select("row_key", "idx", "type", "expected", "expected_surface", "hit", "found", "found_surface", "edit_distance", F.array_join("candidates", " ").alias("candidates"), "confusions", F.when(known, F.round("wer", 6)).alias("wer"))


def _triage(spark, sf) -> DataFrame:
    return S.triage(S.score_rows(lines(spark, sf), L.lexicon(spark), extracted=True), L.lexicon(spark))


@query(LINES + "SELECT * FROM cause")
def triage(spark, sf):
    return _triage(spark, sf)


@query(LINES + "SELECT bucket, count(*) AS n FROM cause GROUP BY 1")
def triage_counts(spark, sf):
    return _triage(spark, sf).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


@query(LINES + "SELECT pattern, count(*) AS n FROM cause GROUP BY 1 ORDER BY n DESC, pattern LIMIT 15")
def triage_patterns(spark, sf):
    """The fifteen commonest patterns: the report's own limit."""
    return _triage(spark, sf).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "pattern").limit(15)


@query(LINES + "SELECT bucket, pattern, row_key, idx, (count(*) OVER (PARTITION BY pattern))::BIGINT AS often FROM cause")
def triage_listing(spark, sf):
    t = X.staged(_triage(spark, sf), "triage")
    often = t.groupBy("pattern").agg(F.count(F.lit(1)).alias("often"))
    rank = F.array_position(F.array(*map(F.lit, S.BUCKETS)), F.col("bucket"))
    return t.join(often, "pattern").select("bucket", "pattern", "row_key", "idx", "often").orderBy(rank, F.desc("often"), "pattern", "row_key", "idx")


@query(LINES + """SELECT count(DISTINCT o_orderkey) AS rows, count(DISTINCT o_orderkey) AS utterances, count(DISTINCT condition) AS conditions, count(*) AS entities, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS rate,
  'run-0,run-1,run-2,run-3' AS run_id, 'batch,live' AS asr_impl, '-,m1' AS asr_model, 'transcribe' AS asr_mode FROM ent""")
def triage_header(spark, sf):
    k = F.col("row_key")
    by = {"run_id": F.concat(F.lit("run-"), (k % 4).cast("string")), "asr_impl": F.when(k % 2 == 0, "batch").otherwise("live"), "asr_model": F.when(k % 3 == 0, "m1"), "asr_mode": F.lit("transcribe")}
    h = S.triage_header(scored(spark, sf).withColumns(by))
    return h.withColumns({c: F.array_join(c, ",") for c in by})


@query(LINES + """SELECT o_orderkey AS row_key, idx, type, expected, CASE WHEN kind IN (1, 2) THEN NULL WHEN type = 'pin_code' THEN NULL WHEN hit OR kind = 7 AND type = 'otp' THEN 'typed' WHEN type = 'currency' OR contains(digits, expected) THEN 'digits' END AS how FROM ent""")
def value_present(spark, sf):
    x = S.value_present(lines(spark, sf), F.col("gold"), F.col("hypothesis"), L.lexicon(spark))
    return x.select("row_key", F.posexplode(F.arrays_zip("gold", "how")).alias("idx", "x")).select("row_key", "idx", "x.gold.type", "x.gold.expected", "x.how")


#: An earlier run that scored by containment of the digits alone: what re-scoring starts from.
STORED = "CASE WHEN type IN ('otp', 'account_number', 'pin_code') THEN contains(hypothesis, expected) ELSE false END"


def stored(x: DataFrame) -> DataFrame:
    old = F.col("type").isin("otp", "account_number", "pin_code") & F.contains("hypothesis", "expected")
    return S.gold_of(x, keep=("hypothesis", "condition")).select("row_key", "condition", "type", old.alias("hit"))


@query(LINES + "SELECT condition, type, count(*) AS total, count(*) FILTER (hit) AS hits, round(count(*) FILTER (hit) / count(*)::DOUBLE, 6) AS rate FROM ent GROUP BY ALL")
def rescore(spark, sf):
    """Scores recomputed from the stored hypotheses, after a check that no utterance is missing."""
    known = demo.table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_key"))
    return M.rates(entities(S.score_rows(G.require_utterances(lines(spark, sf), known, "row_key"), L.lexicon(spark))), "condition", "type")


@query(LINES + f"SELECT condition, type, count(*) FILTER ({STORED}) AS before, count(*) FILTER (hit) AS after, count(*) AS total, count(*) FILTER (hit) - count(*) FILTER ({STORED}) AS delta FROM ent GROUP BY ALL")
def rescore_delta(spark, sf):
    return M.rescore_delta(stored(lines(spark, sf)), entities(scored(spark, sf)), "condition", "type")


# ---- cues --------------------------------------------------------------------------------------------------------

CUES = LINES + f""", cue AS (SELECT o_orderkey, condition, kind, 3 AS cue_total, 3 - (kind IN (4, 6, 7, 8))::INT AS cue_kept,
  CASE realization WHEN 'digits' THEN 19 ELSE 13 + 6 + 11 + {word_count_sql("amount::BIGINT")} + {word_count_sql("day(o_orderdate)")} + 1 + {word_count_sql("year(o_orderdate)")} END AS word_total,
  CASE realization WHEN 'digits' THEN 19 - (kind IN (3, 4, 5))::INT ELSE 13 END AS word_kept FROM heard WHERE kind NOT IN (1, 2)),
orphan AS (SELECT o_orderkey, condition, type, expected, hit FROM ent WHERE kind = 7 AND type = 'otp' OR kind = 8 AND type = 'account_number'),
present AS (SELECT condition, count(*) AS value_present FROM ent WHERE hit OR kind = 7 AND type = 'otp' GROUP BY 1),
survival AS (SELECT condition, sum(cue_total)::BIGINT AS cue_total, sum(cue_kept)::BIGINT AS cue_kept, sum(word_total)::BIGINT AS word_total, sum(word_kept)::BIGINT AS word_kept, any_value(value_present) AS value_present,
  coalesce(any_value(orphans), 0) AS orphans, coalesce(any_value(unrecovered), 0) AS unrecovered, coalesce(any_value(by_type), '') AS by_type FROM cue LEFT JOIN present USING (condition)
  LEFT JOIN (SELECT condition, count(*) AS orphans, count(*) FILTER (NOT hit) AS unrecovered, any_value(type) || '=' || count(*) AS by_type FROM orphan GROUP BY 1) USING (condition) GROUP BY condition)
"""


def _tokens(spark, x, column) -> DataFrame:
    """(row_key, canon, cue_types) of every word; spelling is folded once a text."""
    w = X.words(x.select("row_key", T.folded_text(F.col(column), normalize=False).alias("folded")), L.canonical_words).withColumnRenamed("text", "canon")
    return w.join(F.broadcast(C.cue_index(L.lexicon(spark))), "canon", "left").select("row_key", "canon", "cue_types")  # the index is a fixed vocabulary


def _heard(spark, sf) -> DataFrame:
    """The calls that did not fail and were not blank."""
    return lines(spark, sf).where("error is null and trim(hypothesis) <> ''")


def _apart(spark, sf) -> tuple[DataFrame, DataFrame | None]:
    """The heard calls whose key comes once, and the others, if there are any."""
    x = _heard(spark, sf).where("row_key is not null")
    again = X.staged(x.groupBy("row_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("row_key"), "again")
    return x.join(again, "row_key", "left_anti"), None if again.isEmpty() else X.staged(x.join(again, "row_key", "left_semi"), "lines")


ORPHAN = ["row_key", "condition", "type", "expected", "cues_expected", "hit"]


def _shared(x: DataFrame, spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(counts, orphans, present values) of calls that share a key: their words are one bag, and their values one set."""
    ref, hyp = (X.staged(_tokens(spark, x, c), "words") for c in ("reference", "hypothesis"))
    found = X.staged(X.extract_entities(x.select("row_key", F.col("hypothesis").alias("text")), L.lexicon(spark)), "found")
    present = C.present_values(S.gold_of(x, keep=("condition",)), found)
    hit = found.select("row_key", "type", F.col("normalized").alias("expected"), F.lit(True).alias("hit")).distinct()
    orphan = C.orphans(present, ref, hyp).join(hit, ["row_key", "type", "expected"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    return C.word_counts(C.cue_multiset(ref, hyp), x), orphan.select(ORPHAN), present.select("condition", F.lit(1).alias("value_present"))


def _orphans(rows: DataFrame) -> DataFrame:
    return rows.select("row_key", "condition", F.explode("orphans").alias("o")).select("row_key", "condition", "o.*").select(ORPHAN)


def _survival(spark, sf) -> DataFrame:
    """Cue survival by condition. A call whose key is its own is read inside its row."""
    once, again = _apart(spark, sf)
    sums = X.staged(C.summed(C.read_in_rows(once, L.lexicon(spark))), "cues")
    counts, present = sums.select("condition", "cue_total", "cue_kept", "word_total", "word_kept"), sums.select("condition", "value_present")
    orphan = sums.select("condition", F.explode("orphans").alias("o"), "n").select("condition", "o.*", "n")
    if again is not None:
        more = _shared(again, spark)
        counts, present = counts.unionByName(more[0]), present.unionByName(more[2])
        orphan = orphan.unionByName(more[1].select("condition", "type", "hit", F.lit(1).alias("n")))
    return C.cue_survival(counts, orphan, present)


@query(CUES + "SELECT * FROM survival")
def cue_survival(spark, sf):
    listed = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return _survival(spark, sf).withColumn("by_type", listed)


@query(CUES + "SELECT o_orderkey AS row_key, condition, type, expected, 1::BIGINT AS cues_expected, hit FROM orphan")
def orphans(spark, sf):
    once, again = _apart(spark, sf)
    found = _orphans(C.read_in_rows(once, L.lexicon(spark)))
    return found if again is None else found.unionByName(_shared(again, spark)[1])


@query(CUES + "SELECT type, condition, o_orderkey AS row_key, hit FROM orphan")
def orphan_listing(spark, sf):
    return orphans(spark, sf).select("type", "condition", "row_key", "hit").orderBy("type", "condition", "row_key")


@query(CUES + """, r AS (SELECT condition, orphans, orphans / value_present::DOUBLE AS r, cue_kept / cue_total::DOUBLE AS s FROM survival)
SELECT condition, orphans, round(r, 6) AS orphan_rate, round(s, 6) AS cue_survival, round(s - (SELECT s FROM r WHERE condition = 'clean'), 6) AS against_clean, condition = 'bursty' AS least_kept, (SELECT sum(orphans) FROM r WHERE condition = 'bursty')::BIGINT AS bursty_orphans FROM r""")
def orphan_rate_rank(spark, sf):
    return C.orphan_rate_rank(_survival(spark, sf), BURSTY, "clean").orderBy(F.desc("orphan_rate"), "condition")


@query(CUES + "SELECT sum(value_present)::BIGINT AS value_present, sum(orphans)::BIGINT AS orphans, sum(unrecovered)::BIGINT AS unrecovered, sum(orphans)::BIGINT AS shaped, 0::BIGINT AS unshaped FROM survival")
def cue_totals(spark, sf):
    return C.cue_totals(_survival(spark, sf), S.DIGIT_TYPES)


@query(CUES + """, tt AS (SELECT string_agg(type || '=' || n, ',' ORDER BY type) AS all_by_type FROM (SELECT type, count(*) AS n FROM orphan GROUP BY 1))
SELECT 'transcribe' AS modes, (SELECT count(*) FROM cue) AS rows, condition, cue_total, cue_kept, round(cue_kept / cue_total::DOUBLE, 6) AS cue_survival, word_total, word_kept, round(word_kept / word_total::DOUBLE, 6) AS word_survival, value_present, orphans, unrecovered, by_type,
  all_by_type, (sum(orphans) OVER ())::BIGINT AS all_orphans, (sum(unrecovered) OVER ())::BIGINT AS all_unrecovered, (sum(value_present) OVER ())::BIGINT AS all_present, 'account_number,otp,pin_code' AS shaped FROM survival, tt""")
def cue_figures_json(spark, sf):
    """All figures, written as one JSON document and read back, one row per condition."""
    figures = C.cue_figures(_survival(spark, sf), _heard(spark, sf).count(), ["transcribe"], S.DIGIT_TYPES)
    path = io.scratch_path(spark, "figures")
    figures.write.text(path)
    d = io.cue_figures(spark, path).withColumn("c", F.explode("conditions"))
    listed = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    c = lambda field, name: F.col(f"c.{field}").alias(name)
    return d.select(
        F.array_join("modes", ",").alias("modes"), "rows", c("condition", "condition"), c("cueTotal", "cue_total"), c("cueKept", "cue_kept"), F.round("c.cueSurvival", 6).alias("cue_survival"), c("wordTotal", "word_total"), c("wordKept", "word_kept"),
        F.round("c.wordSurvival", 6).alias("word_survival"), c("valuePresent", "value_present"), c("orphans", "orphans"), c("orphansUnrecovered", "unrecovered"), listed(F.col("c.orphansByType")).alias("by_type"), listed(F.col("orphansByType")).alias("all_by_type"),
        F.col("totals.orphans").alias("all_orphans"), F.col("totals.orphansUnrecovered").alias("all_unrecovered"), F.col("totals.valuePresent").alias("all_present"), F.array_join("shapedTypes", ",").alias("shaped"),
    )


@query("""WITH f AS (SELECT o_orderpriority AS priority, count(*) AS rows FROM orders GROUP BY 1), n AS (SELECT *, (row_number() OVER (ORDER BY priority))::INT AS k FROM f),
m AS (SELECT priority AS file, rows, unnest(CASE k % 3 WHEN 1 THEN ['transcribe'] WHEN 2 THEN ['transcribe', 'verbatim'] ELSE ['-', 'translit'] END) AS mode FROM n)
SELECT mode, min(file) AS file, arg_min(rows, file) AS rows FROM m WHERE mode <> '-' GROUP BY 1""")
def cue_figures_by_mode(spark, sf):
    """Sidecar documents, one per order priority, written and read back: the first file by name that has a mode wins."""
    from pyspark.sql import Window

    f = demo.table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    k = F.row_number().over(Window.orderBy("file")) % 3  # one row per priority
    modes = F.when(k == 1, F.array(F.lit("transcribe"))).when(k == 2, F.array(F.lit("transcribe"), F.lit("verbatim"))).otherwise(F.array(F.lit("-"), F.lit("translit")))
    path = io.scratch_path(spark, "sidecars")
    f.withColumn("modes", modes).write.partitionBy("file").json(path)
    return io.cue_figures_by_mode(spark, path)


# ---- values and spans --------------------------------------------------------------------------------------------


#: The missed PIN is seven nines: leading nines are kept, at the first other digit the nines that are too many are missing,
#: and then nines are kept and other digits wrong.
DIFF = """, nine AS (SELECT *, regexp_extract(found, '^9*') AS lead, 7 - length(regexp_replace(found, '[^9]', '', 'g')) AS gone FROM ent WHERE NOT hit),
part AS (SELECT *, CASE WHEN found IS NULL THEN [expected || ':missing'] WHEN length(expected) = length(found) THEN [left(found, 5) || ':same', right(found, 1) || ':wrong'] WHEN type = 'otp' THEN [found || ':same', right(expected, 3) || ':missing']
  ELSE list_concat(CASE WHEN lead <> '' THEN [lead || ':same'] ELSE [] END, [repeat('9', gone) || ':missing'], list_transform(regexp_extract_all(substr(found, length(lead) + 1), '9+|[^9]+'), lambda p: p || CASE WHEN p[1] = '9' THEN ':same' ELSE ':wrong' END)) END AS parts FROM nine)"""


@query(LINES + DIFF + """ SELECT o_orderkey AS row_key, idx, array_to_string(parts, '|') AS parts, CASE WHEN found IS NULL THEN length(expected) WHEN length(expected) = length(found) THEN 1 WHEN type = 'otp' THEN 3 ELSE 2 * gone - 1 END::INT AS lost FROM part""")
def value_diff(spark, sf):
    """Every missed value against what was found, part by part, and how many characters are not on both sides."""
    e = entities(scored(spark, sf)).where("not hit").withColumn("d", T.value_diff(F.col("expected"), F.col("found")))
    return e.select("row_key", "idx", F.array_join(F.transform("d", lambda p: F.concat_ws(":", p["text"], p["kind"])), "|").alias("parts"), T.value_diff_lost(F.col("d")).alias("lost"))


@query(f"""WITH {DIGITS_SQL}, {TEXTS_SQL} SELECT o_orderkey AS row_key, CASE realization WHEN 'digits' THEN concat_ws(' ', 13, 36, 79, 79 + length(grouped) + 12) ELSE '- - - -' END AS starts FROM texts""")
def entity_spans(spark, sf):
    """Where each gold surface begins in its reference, searched from left to right; - where it is not found."""
    found = T.entity_starts(F.col("reference"), F.transform(F.slice("gold", 1, 4), lambda g: g["surface"]))
    return lines(spark, sf).select("row_key", F.array_join(F.transform(found, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), " ").alias("starts"))


@query("SELECT conv_id, turn, len(list_filter(range(len(string_split(text, ' '))), lambda i: (i + turn) % 9 = 0))::INT AS edits FROM conversations WHERE text IS NOT NULL")
def token_edit_distance(spark, sf):
    """Every text against itself without every ninth word: as many edits as words left out."""
    d = demo.table(spark, sf, "conversations").where("text is not null").select("conv_id", "turn", F.split("text", " ").alias("w"))
    kept = F.transform(F.filter(F.transform("w", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["i"] + F.col("turn")) % 9 != 0), lambda x: x["w"])
    return d.select("conv_id", "turn", T.token_edit_distance(F.col("w"), kept).alias("edits"))


@query(f"WITH {DIGITS_SQL} SELECT o_orderkey AS row_key, {words_sql('amount::BIGINT')} AS words FROM o")
def number_to_words(spark, sf):
    return calls(spark, sf).select("row_key", T.number_to_words(F.col("amount")).alias("words"))


@query("SELECT o_orderkey AS row_key, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '--%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '--%m') END AS normalized FROM orders")
def normalize_date(spark, sf):
    """Whole and partial dates: without a year, without a day, without both."""
    k, d = F.col("row_key") % 4, F.col("date")
    return calls(spark, sf).select("row_key", T.normalize_date(F.when(k.isin(0, 2), F.year(d)), F.month(d), F.when(k.isin(0, 1), F.dayofmonth(d))).alias("normalized"))


#: Consonants that are written doubled, and stops before their aspirates, with what is left of each.
DOUBLED = "क ग च ज ट ड त द प ब म ल व स".split()
ASPIRATED = "क्ख ग्घ च्छ ज्झ ट्ठ ड्ढ त्थ द्ध प्फ ब्भ".split()


@query(f"SELECT o_orderkey AS row_key, CASE WHEN o_orderkey % 3 = 0 THEN 'स' || right({ASPIRATED}[o_orderkey % {len(ASPIRATED)} + 1], 1) ELSE 'अ' || {DOUBLED}[o_orderkey % {len(DOUBLED)} + 1] END || 'र' AS word FROM orders")
def degeminate(spark, sf):
    """Doubled consonants and stops before their aspirates, written once."""
    k = F.col("o_orderkey")
    one = lambda words: F.element_at(F.array(*map(F.lit, words)), (k % len(words) + 1).cast("int"))
    twice = F.concat(F.lit("अ"), one(DOUBLED), F.lit("्"), one(DOUBLED))
    word = F.concat(F.when(k % 3 == 0, F.concat(F.lit("स"), one(ASPIRATED))).otherwise(twice), F.lit("र"))
    return demo.table(spark, sf, "orders").select(k.alias("row_key"), L.canonicalize(word).alias("word"))


@query(f"WITH {DIGITS_SQL}, {TEXTS_SQL}, w AS (SELECT o_orderkey AS row_key, unnest(string_split(text, ' ')) AS w FROM texts) SELECT row_key, count(*) FILTER (w IN ('code', 'account', 'rupees')) AS cues, count(*) FILTER (w IN ('hundred', 'thousand', 'lakh')) AS scales FROM w GROUP BY 1")
def lexicon_join(spark, sf):
    """Cue words and scales of every sentence, by the lexicon."""
    t = X.with_lexicon(X.tokenize(calls(spark, sf).select("row_key", T.folded_text(F.col("text"), normalize=False).alias("folded"))), L.lexicon(spark))
    return t.groupBy("row_key").agg(F.count_if(F.size("cue_types") > 0).alias("cues"), F.count_if(F.col("kind") == "scale").alias("scales"))


@query(GOLD_SQL + "SELECT row_key, type, expected AS normalized, count(*) AS n FROM gold GROUP BY ALL UNION ALL SELECT row_key, 'account_number', expected, 1 FROM gold WHERE type = 'otp'")
def union_candidates(spark, sf):
    """The bag of candidates from number runs and from dates."""
    return X.extract_entities(calls(spark, sf).select("row_key", "text"), L.lexicon(spark)).groupBy("row_key", "type", "normalized").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {DIGITS_SQL} SELECT o_orderkey AS row_key, 'clerk ' || lower(right(o_orderpriority, 3)) AS name FROM o")
def name_extractor(spark, sf):
    """A caller's own extractor of names, a DataFrame function, beside the built-in types."""

    def clerks(texts):
        name = F.regexp_extract("text", "(clerk \\S+)$", 1)
        return texts.where(name != "").select("row_key", F.lit("person_name").alias("type"), T.normalize_name(name).alias("normalized"), F.lit(3).alias("part"))

    o = demo.table(spark, sf, "orders")
    texts = o.select(F.col("o_orderkey").alias("row_key"), F.concat(F.lit("your order is with clerk "), F.right("o_orderpriority", F.lit(3))).alias("text"))
    return X.extract_entities(texts, L.lexicon(spark), name_extractor=clerks).where("type = 'person_name'").select("row_key", F.col("normalized").alias("name"))
