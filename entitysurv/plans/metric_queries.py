"""Figures over the score rows derived from the event table."""

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics as M
from ..operators import modes as O
from ..operators import rows as R
from ..sources.io import staged
from . import demo
from .oracle_base import OBS, ROWS, SAID
from .registry import query

WITH = f"WITH {ROWS}\n"
WITH_SAID = f"WITH {ROWS}{SAID}\n"
BURSTY = ["error"]


def rows(spark, sf):
    return R.dedupe_newest(R.exclude_mock(demo.obs(spark, sf)))


def prim(spark, sf):
    return R.primary_mode_rows(rows(spark, sf))


def ents(spark, sf):
    return R.entity_rows(rows(spark, sf))


def pents(spark, sf):
    return R.entity_rows(prim(spark, sf))


def once(spark, sf):
    """(rows, entities), of rows written once: for figures that stand on several aggregates of them."""
    r = staged(rows(spark, sf), "rows")
    return r, R.entity_rows(r)


RATE = "coalesce(sum(hit::INT), 0)::BIGINT AS hits, count(*) AS total, round(sum(hit::INT) / count(*)::DOUBLE, 6) AS rate"
MODEL = "coalesce(asr_model, '-') AS model"


@query(WITH + f"SELECT language, condition, type, {MODEL}, {RATE} FROM ents GROUP BY ALL")
def hit_rate(spark, sf):
    return M.hit_rate(ents(spark, sf))


@query(WITH + "SELECT language, condition, round(avg(wer), 6) AS mean_wer, count(*) AS n FROM rows_ GROUP BY ALL")
def wer_by_condition(spark, sf):
    return M.wer_by(rows(spark, sf), "language", "condition")


@query(WITH + f"SELECT {MODEL}, asr_mode AS mode, condition, type, {RATE}, count(*) < 10 AS low_n FROM ents GROUP BY ALL")
def hit_matrix(spark, sf):
    return M.hit_matrix(ents(spark, sf))


CONDS = "conds(name, kind, label) AS (VALUES ('click', 'clean', NULL), ('view', 'codec', '8 kHz + G.711'), ('purchase', 'scattered', '8 kHz + G.711 + scattered packet loss'), ('error', 'bursty', '8 kHz + G.711 + bursty packet loss'), ('signup', 'noise', 'background noise'), ('logout', 'bursty', '16 kHz + OPUS + bursty packet loss'), ('idle', 'scattered', '16 kHz + OPUS + scattered packet loss'))"


@query(WITH + f", {CONDS}, m AS (SELECT {MODEL}, asr_mode AS mode, type, condition, {RATE} FROM ents GROUP BY ALL), g AS (SELECT DISTINCT model, mode, type, name AS condition FROM m, conds) SELECT model, mode, type, condition, CASE WHEN total IS NULL THEN 'not_run' WHEN total < 10 THEN 'low_n' ELSE 'rate' END AS state, CASE WHEN total >= 10 THEN rate END AS shown FROM g LEFT JOIN m USING (model, mode, type, condition)")
def matrix_cell_state(spark, sf):
    return M.matrix_cell_state(ents(spark, sf), demo.conditions(spark))


@query(WITH + f"SELECT {MODEL}, asr_mode AS mode, condition, round(avg(wer), 6) AS mean_wer, count(*) AS n FROM rows_ GROUP BY ALL")
def wer_matrix(spark, sf):
    return M.wer_by(rows(spark, sf), R.model_of().alias("model"), R.mode_of().alias("mode"), "condition")


@query(WITH + f", {CONDS}, m AS (SELECT condition, asr_mode AS mode, {RATE} FROM ents GROUP BY ALL), g AS (SELECT DISTINCT mode, name AS condition FROM m, conds) SELECT condition, mode, hits, total, rate, total IS NULL AS missing FROM g LEFT JOIN m USING (condition, mode)")
def hit_by_condition_mode(spark, sf):
    return M.hit_by_condition_mode(ents(spark, sf), demo.conditions(spark))


WILSON = "p AS (SELECT *, hits / total::DOUBLE AS p, 1.96 * 1.96 AS z2 FROM m), w AS (SELECT *, (p + z2 / (2 * total)) / (1 + z2 / total) AS c, 1.96 * sqrt(p * (1 - p) / total + z2 / (4 * total * total)) / (1 + z2 / total) AS h FROM p)"


@query(WITH + f", m AS (SELECT condition, {RATE} FROM pents GROUP BY ALL), {WILSON} SELECT condition, hits, total, rate, round(c - h, 6) AS low, round(c + h, 6) AS high, row_number() OVER (ORDER BY rate DESC, condition)::INT AS place FROM w")
def rates_by_condition(spark, sf):
    return M.rates_by_condition(pents(spark, sf))


@query(WITH + f""", m AS (SELECT condition, {RATE} FROM pents GROUP BY ALL),
b AS (SELECT * FROM m ORDER BY hits / total::DOUBLE DESC, condition LIMIT 1), w AS (SELECT * FROM m ORDER BY hits / total::DOUBLE, condition LIMIT 1),
d AS (SELECT b.condition AS best, w.condition AS worst, b.rate AS r, b.hits / b.total::DOUBLE AS p1, w.hits / w.total::DOUBLE AS p2, b.total AS n1, w.total AS n2 FROM b, w),
e AS (SELECT *, 1.96 * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) AS h FROM d)
SELECT best, worst, round(p1 - p2, 6) AS lost, round(p1 - p2 - h, 6) AS low, round(p1 - p2 + h, 6) AS high, (SELECT count(*) FROM m WHERE hits / total::DOUBLE = e.p1)::INT AS tied FROM e WHERE (SELECT count(*) FROM m) >= 2""")
def finding(spark, sf):
    return M.finding(pents(spark, sf))


@query(WITH + f""", m AS (SELECT asr_model AS model, condition, {RATE} FROM pents WHERE asr_model IS NOT NULL GROUP BY ALL), p AS (SELECT *, hits / total::DOUBLE AS p FROM m)
SELECT model, condition, hits, total, rate, round((p + 1.9208 / total - 1.96 * sqrt(p * (1 - p) / total + 0.9604 / (total * total::DOUBLE))) / (1 + 3.8416 / total), 6) AS low, round((p + 1.9208 / total + 1.96 * sqrt(p * (1 - p) / total + 0.9604 / (total * total::DOUBLE))) / (1 + 3.8416 / total), 6) AS high FROM p""")
def model_cells(spark, sf):
    return M.model_cells(pents(spark, sf))


@query(WITH + f""", m AS (SELECT asr_model AS model, {RATE} FROM pents WHERE asr_model IS NOT NULL AND condition IN ('error') GROUP BY ALL),
d AS (SELECT a.model AS first, b.model AS second, a.rate AS first_rate, b.rate AS second_rate, b.hits / b.total::DOUBLE AS p1, a.hits / a.total::DOUBLE AS p2, b.total AS n1, a.total AS n2 FROM m a JOIN m b ON a.model < b.model WHERE (SELECT count(*) FROM m) = 2),
e AS (SELECT *, 1.96 * sqrt(p1 * (1 - p1) / n1 + p2 * (1 - p2) / n2) AS h FROM d)
SELECT first, second, first_rate, second_rate, round((p2 + 1.9208 / n2 - 1.96 * sqrt(p2 * (1 - p2) / n2 + 0.9604 / (n2 * n2::DOUBLE))) / (1 + 3.8416 / n2), 6) AS first_low, round((p2 + 1.9208 / n2 + 1.96 * sqrt(p2 * (1 - p2) / n2 + 0.9604 / (n2 * n2::DOUBLE))) / (1 + 3.8416 / n2), 6) AS first_high, round((p1 + 1.9208 / n1 - 1.96 * sqrt(p1 * (1 - p1) / n1 + 0.9604 / (n1 * n1::DOUBLE))) / (1 + 3.8416 / n1), 6) AS second_low, round((p1 + 1.9208 / n1 + 1.96 * sqrt(p1 * (1 - p1) / n1 + 0.9604 / (n1 * n1::DOUBLE))) / (1 + 3.8416 / n1), 6) AS second_high,
  round(p1 - p2, 6) AS delta, round(p1 - p2 - h, 6) AS low, round(p1 - p2 + h, 6) AS high, (p1 - p2 - h > 0 OR p1 - p2 + h < 0) AS separates FROM e""")
def model_split(spark, sf):
    return M.model_split(pents(spark, sf), BURSTY)


@query(WITH + f", m AS (SELECT asr_model AS model, condition, {RATE} FROM pents WHERE asr_model IS NOT NULL GROUP BY ALL) SELECT coalesce(bool_and(coalesce(b.hits * a.total >= a.hits * b.total, false)), false) AS never_worse FROM (SELECT * FROM m WHERE model = 'm1') b LEFT JOIN (SELECT * FROM m WHERE model = 'm0') a USING (condition)")
def never_worse(spark, sf):
    return M.never_worse(pents(spark, sf), "m0", "m1")


SHARED = f"cells AS (SELECT utterance_id, condition, {MODEL} FROM rows_ GROUP BY ALL HAVING count(DISTINCT asr_mode) = (SELECT count(DISTINCT asr_mode) FROM rows_))"


@query(WITH + f", {SHARED} SELECT * FROM cells")
def shared_cells(spark, sf):
    return M.shared_cells(rows(spark, sf))


@query(WITH + f""", {SHARED}, r AS (SELECT asr_mode AS mode, count(*) AS rows, round(avg(wer), 6) AS mean_wer, count(DISTINCT condition) AS conditions FROM rows_ x WHERE EXISTS (SELECT 1 FROM cells c WHERE c.utterance_id = x.utterance_id AND c.condition = x.condition AND c.model = coalesce(x.asr_model, '-')) GROUP BY 1),
e AS (SELECT asr_mode AS mode, {RATE} FROM ents x WHERE EXISTS (SELECT 1 FROM cells c WHERE c.utterance_id = x.utterance_id AND c.condition = x.condition AND c.model = coalesce(x.asr_model, '-')) GROUP BY 1) SELECT * FROM r LEFT JOIN e USING (mode)""")
def shared_mode_figures(spark, sf):
    return M.shared_mode_figures(*once(spark, sf))


@query(WITH + f", {SHARED} SELECT asr_mode AS mode, count(*) AS own_cells, (SELECT count(*) FROM cells) AS shared FROM (SELECT DISTINCT asr_mode, utterance_id, condition, {MODEL} FROM rows_) GROUP BY 1")
def mode_coverage(spark, sf):
    r = rows(spark, sf)
    own = r.select(R.mode_of().alias("mode"), "utterance_id", "condition", R.model_of().alias("model")).distinct().groupBy("mode").agg(F.count(F.lit(1)).alias("own_cells"))
    return own.join(F.broadcast(M.shared_cells(r).agg(F.count(F.lit(1)).alias("shared"))))


@query(WITH + f""", c AS (SELECT condition, avg(wer) AS w FROM prim GROUP BY 1), b AS (SELECT {MODEL}, avg(wer) AS w FROM prim GROUP BY 1)
SELECT hits, total, rate, round(least_wer, 6) AS least_wer, round(most_wer, 6) AS most_wer, least_condition, most_condition, best_model, models, utterances, conditions FROM (SELECT {RATE} FROM pents), (SELECT min(w) AS least_wer, max(w) AS most_wer FROM c),
(SELECT condition AS least_condition FROM c ORDER BY round(w, 9), condition LIMIT 1), (SELECT condition AS most_condition FROM c ORDER BY round(w, 9) DESC, condition LIMIT 1), (SELECT model AS best_model FROM b ORDER BY round(w, 6), model LIMIT 1), (SELECT string_agg(model || '=' || printf('%.4f', round(w, 6)), ',' ORDER BY round(w, 6), model) AS models FROM b), (SELECT count(DISTINCT utterance_id) AS utterances, count(DISTINCT condition) AS conditions FROM prim)""")
def headline(spark, sf):
    p = R.primary_mode_rows(once(spark, sf)[0])
    return M.headline(p, R.entity_rows(p))


@query(WITH + "SELECT (SELECT event_id FROM prim ORDER BY wer, event_id LIMIT 1) AS best_row, min(wer) AS least, (SELECT event_id FROM prim ORDER BY wer DESC, event_id LIMIT 1) AS worst_row, max(wer) AS most FROM prim")
def wer_spread(spark, sf):
    return M.wer_spread(prim(spark, sf))


@query(WITH + f"SELECT * FROM (SELECT count(DISTINCT utterance_id) AS utterances, count(*) AS rows FROM prim), (SELECT hits, total AS entities, rate FROM (SELECT {RATE} FROM pents)), (SELECT count(*) AS rows_all_modes FROM rows_)")
def summary(spark, sf):
    r = once(spark, sf)[0]
    p = R.primary_mode_rows(r)
    return M.summary(p, R.entity_rows(p), r)


@query(f"WITH {OBS} SELECT run_id, min('scores-' || event_id % 5 || '.json') AS source, string_agg(DISTINCT asr_impl, ',' ORDER BY asr_impl) AS impls, string_agg(DISTINCT coalesce(asr_model, '-'), ',' ORDER BY coalesce(asr_model, '-')) AS models, string_agg(DISTINCT asr_mode, ',' ORDER BY asr_mode) AS modes, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, string_agg(DISTINCT condition, ',' ORDER BY condition) AS conditions, count(DISTINCT utterance_id) AS utterances, count(*) AS rows, 2 * count(*) AS entities, count(error) AS errors FROM obs GROUP BY 1")
def runs(spark, sf):
    source = F.concat(F.lit("scores-"), (F.col("event_id") % 5).cast("string"), F.lit(".json"))
    return M.runs(demo.obs(spark, sf).withColumn("source", source))


@query(WITH + "SELECT type, expected, found AS got, CASE WHEN found IS NOT NULL THEN levenshtein(expected, found)::INT END AS edit_distance, count(*) AS n FROM ents WHERE NOT hit GROUP BY ALL")
def confusion_counts(spark, sf):
    return M.confusion_counts(ents(spark, sf))


@query(WITH + "SELECT 'type' AS kind, type AS name, count(*) AS n FROM pents GROUP BY 2 UNION ALL SELECT 'realization', coalesce(realization, '?'), count(DISTINCT utterance_id) FROM prim GROUP BY 2")
def corpus_profile(spark, sf):
    return M.corpus_profile(pents(spark, sf), prim(spark, sf))


MODES = WITH + f""", twins AS (SELECT utterance_id, condition, {MODEL}, arg_max(event_id, run_id || lpad(event_id::VARCHAR, 19, '0')) AS twin FROM rows_ WHERE asr_mode = 'verbatim' GROUP BY ALL),
te AS (SELECT event_id AS twin, type, expected, bool_or(hit) AS twin_hit FROM ents WHERE asr_mode = 'verbatim' GROUP BY ALL),
cl AS (SELECT x.utterance_id, x.condition, coalesce(x.asr_model, '-') AS model, x.type, x.expected, CASE WHEN x.hit THEN 'hit' WHEN twin_hit IS NULL THEN 'unpaired' WHEN twin_hit THEN 'rendering' ELSE 'acoustic' END AS kind
  FROM ents x LEFT JOIN twins t ON x.utterance_id = t.utterance_id AND x.condition = t.condition AND coalesce(x.asr_model, '-') = t.model LEFT JOIN te ON te.twin = t.twin AND te.type = x.type AND te.expected = x.expected WHERE x.asr_mode = 'transcribe')"""
KINDS = "count(*) AS scored, count(*) FILTER (kind = 'hit') AS hit, count(*) FILTER (kind = 'acoustic') AS acoustic, count(*) FILTER (kind = 'rendering') AS rendering, count(*) FILTER (kind = 'unpaired') AS unpaired, round(count(*) FILTER (kind = 'rendering') / nullif(count(*) FILTER (kind IN ('rendering', 'acoustic')), 0)::DOUBLE, 6) AS rendering_share"


def classified(spark, sf):
    r, e = once(spark, sf)
    return O.mode_classify(e, r)


@query(MODES + " SELECT * FROM cl")
def mode_classify(spark, sf):
    return classified(spark, sf)


@query(MODES + " SELECT utterance_id, condition, model, count(*) AS n, count(*) FILTER (kind = 'unpaired') AS unpaired FROM cl GROUP BY ALL")
def mode_twin_join(spark, sf):
    return classified(spark, sf).groupBy("utterance_id", "condition", "model").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "unpaired").alias("unpaired"))


@query(MODES + f" SELECT condition, {KINDS} FROM cl GROUP BY 1")
def mode_split(spark, sf):
    return O.mode_split(classified(spark, sf))


@query(MODES + f" SELECT coalesce(condition, 'ALL') AS condition, {KINDS} FROM cl GROUP BY ROLLUP (condition)")
def mode_split_total(spark, sf):
    return O.mode_split_total(classified(spark, sf))


REND = WITH_SAID + """, rend AS (SELECT e.*, hypothesis, regexp_replace(regexp_replace(split_part(expected, ':', -1), '\\.0+$', ''), '[^0-9]', '', 'g') AS d FROM ents e JOIN hyps USING (event_id)),
ren AS (SELECT *, CASE WHEN d = '' THEN 'n/a' WHEN contains(regexp_replace(hypothesis, '[^0-9]', '', 'g'), d) THEN 'digits' WHEN hit THEN 'words' ELSE 'absent' END AS rendering, coalesce(asr_model, '-') AS model, asr_mode AS mode FROM rend),
tab AS (SELECT utterance_id, mode, condition, type, expected, string_agg(model || '=' || rendering, ';' ORDER BY model || '=' || rendering) AS renderings, count(DISTINCT rendering) AS forms, round(max(wer) - min(wer), 6) AS spread FROM ren GROUP BY ALL)"""


@query(REND + " SELECT event_id, type, rendering FROM ren")
def rendering_of(spark, sf):
    return M.with_rendering(ents(spark, sf)).select("event_id", "type", "rendering")


@query(REND + " SELECT utterance_id, mode, condition, type, expected, forms, spread, (row_number() OVER (PARTITION BY utterance_id, mode, condition, type, expected ORDER BY model, rendering))::INT AS place, model, rendering, hit, wer, hypothesis FROM ren JOIN tab USING (utterance_id, mode, condition, type, expected)")
def rendering_table(spark, sf):
    """The table, one row per model's cell in its place."""
    t = M.rendering_table(ents(spark, sf)).select("*", F.posexplode("models").alias("at", "m"))
    return t.select("utterance_id", "mode", "condition", "type", "expected", "forms", "spread", (F.col("at") + 1).alias("place"), "m.*")


@query(REND + " SELECT * FROM (SELECT count(*) AS pairs, count(*) FILTER (forms > 1) AS disagreements FROM tab), (SELECT count(*) FILTER (f > 1) AS changes FROM (SELECT count(DISTINCT rendering) AS f FROM ren WHERE rendering NOT IN ('absent', 'n/a') GROUP BY utterance_id, model, mode, type, expected)), (SELECT count(*) FILTER (rendering <> realization AND rendering NOT IN ('absent', 'n/a')) AS rewrites FROM ren)")
def rendering_stats(spark, sf):
    return M.rendering_stats(once(spark, sf)[1])


@query(REND + " SELECT model, realization, count(*) FILTER (rendering = 'digits') AS digits, count(*) FILTER (rendering = 'words') AS words, count(*) FILTER (rendering = 'absent') AS absent, count(*) FILTER (rendering = 'n/a') AS n_a FROM ren GROUP BY ALL")
def rendering_crosstab(spark, sf):
    return M.rendering_crosstab(ents(spark, sf))


@query(REND + " SELECT * FROM tab WHERE forms > 1 OR (SELECT count(*) FROM tab) <= 24 ORDER BY spread DESC, utterance_id, mode, condition, type, expected LIMIT 24")
def disagreement_topk(spark, sf):
    t = M.disagreement_topk(ents(spark, sf))
    return t.withColumn("renderings", F.array_join(F.transform("models", lambda m: F.concat_ws("=", m["model"], m["rendering"])), ";")).drop("models")


@query(WITH + f"SELECT condition, {MODEL}, string_agg(DISTINCT asr_mode, ',' ORDER BY asr_mode) AS modes, string_agg(DISTINCT asr_mode, ',' ORDER BY asr_mode) = (SELECT string_agg(DISTINCT asr_mode, ',' ORDER BY asr_mode) FROM rows_) AS complete FROM rows_ GROUP BY ALL")
def mode_coverage_check(spark, sf):
    return M.mode_coverage_check(rows(spark, sf))


@query(WITH + f", {CONDS}, s AS (SELECT condition, count(*) AS n FROM rows_ GROUP BY 1) SELECT name AS condition, n IS NOT NULL AS exercised, coalesce(n, 0) AS rows FROM conds LEFT JOIN s ON s.condition = name")
def condition_coverage(spark, sf):
    return M.condition_coverage(rows(spark, sf), demo.conditions(spark))


@query(WITH_SAID + ", p AS (SELECT utterance_id, max(length(hypothesis)) AS chars, count(*) AS n FROM rows_ JOIN hyps USING (event_id) GROUP BY 1), s AS (SELECT count(*) AS utterances, sum(chars)::BIGINT AS chars, sum(greatest(1.0::DOUBLE, chars / 14.0::DOUBLE) * n) AS seconds FROM p) SELECT utterances, chars, (SELECT count(DISTINCT audio_sha256) FROM rows_) AS audio, round(seconds, 4) AS seconds, round(seconds * 0.00833::DOUBLE + chars / 1000 * 3.0::DOUBLE, 4) AS cost FROM s")
def usage(spark, sf):
    return M.usage(rows(spark, sf))


@query(WITH + "SELECT * EXCLUDE (value) FROM rows_")
def dedupe_newest(spark, sf):
    return rows(spark, sf).drop("entities", "hypothesis")


@query(f"WITH {OBS} SELECT event_id, asr_impl FROM obs WHERE asr_impl <> 'mock' OR NOT (SELECT bool_or(asr_impl <> 'mock') FROM obs)")
def exclude_mock(spark, sf):
    return R.exclude_mock(demo.obs(spark, sf)).select("event_id", "asr_impl")


@query(WITH + "SELECT event_id, asr_mode FROM prim")
def primary_mode_rows(spark, sf):
    return prim(spark, sf).select("event_id", "asr_mode")


@query(WITH_SAID + " SELECT event_id FROM hyps JOIN rows_ USING (event_id) WHERE error IS NULL AND trim(hypothesis) <> ''")
def drop_failed(spark, sf):
    return R.drop_failed(rows(spark, sf)).select("event_id")


@query(WITH + "SELECT event_id, type, expected FROM ents WHERE type IN ('otp', 'pin_code')")
def scored_types(spark, sf):
    return R.scored_types(ents(spark, sf), ["otp", "pin_code"]).select("event_id", "type", "expected")


@query(WITH + "SELECT event_id, condition, CASE condition WHEN 'view' THEN 1 ELSE 2 END AS place FROM rows_ WHERE condition IN ('view', 'click')")
def select_conditions(spark, sf):
    return R.select_conditions(rows(spark, sf), ["view", "click"]).select("event_id", "condition", "place")


@query(WITH + "SELECT DISTINCT utterance_id, type, expected, regexp_replace(regexp_replace(split_part(expected, ':', -1), '\\.0+$', ''), '[^0-9]', '', 'g') AS digits FROM ents")
def gold_digits(spark, sf):
    return M.digits_of_gold(ents(spark, sf))


@query(WITH + "SELECT event_id, type, hit, found, CASE WHEN hit THEN 0 WHEN found IS NOT NULL THEN levenshtein(expected, found) END::INT AS edit_distance FROM ents")
def edit_distance(spark, sf):
    return ents(spark, sf).select("event_id", "type", "hit", "found", "edit_distance")


@query(WITH + "SELECT DISTINCT expected, CASE WHEN starts_with(expected, 'INR:') THEN '₹' || regexp_replace(substr(expected, 5), '\\.00$', '') ELSE expected END AS pretty FROM ents")
def pretty_value(spark, sf):
    return ents(spark, sf).select("expected", T.pretty_value(F.col("expected")).alias("pretty")).distinct()


@query(f"WITH {OBS} SELECT DISTINCT language, split_part(lower(language), '-', 1) AS lang FROM obs")
def language_key(spark, sf):
    return demo.obs(spark, sf).select("language", T.language_key(F.col("language")).alias("lang")).distinct()


@query(f"""WITH {OBS} SELECT DISTINCT utterance_id, condition, sha256('{{"condition":"' || condition || '","utterance":"' || utterance_id || '"}}') AS key FROM obs""")
def request_key(spark, sf):
    return demo.obs(spark, sf).select("utterance_id", "condition", T.request_key(F.col("condition"), F.col("utterance_id").alias("utterance")).alias("key")).distinct()


@query()
def derived_seed(spark, sf):
    return demo.obs(spark, sf).select("event_id", T.derived_seed(F.lit(7), F.col("utterance_id"), F.col("condition")).alias("seed"))


LAB = "lab AS (SELECT lang AS language, source AS condition, (quality = 1) AS hit FROM documents JOIN labels USING (doc_id))"


@query(f"WITH {LAB}, m AS (SELECT language, condition, {RATE} FROM lab GROUP BY ALL), {WILSON} SELECT language, condition, hits, total, rate, total < 10 AS low_n, round(c - h, 6) AS low, round(c + h, 6) AS high FROM w")
def wilson_interval(spark, sf):
    from ..functions.stats import wilson

    lab = demo.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), F.col("source").alias("condition")).join(demo.table(spark, sf, "labels"), "doc_id").withColumn("hit", F.col("quality") == 1)
    low, high = wilson(F.col("hits"), F.col("total"))
    return M.rates(lab, "language", "condition").withColumns({"low_n": F.col("total") < 10, "low": M.rounded(low), "high": M.rounded(high)})
