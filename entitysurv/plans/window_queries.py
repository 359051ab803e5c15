"""Windows, series, conditions and cost over the demo relations."""

from pyspark.sql import functions as F

from ..operators import conditions as C
from ..operators import series as Z
from ..operators import windows as W
from . import demo
from .metric_queries import BURSTY, CONDS, WITH, ents, pents, prim, rows
from .oracle_base import OBS
from .registry import query

FRAMES = "fr AS (SELECT user_id AS series, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS v, event_type = 'error' AS lost FROM events)"


def frames(spark, sf):
    e = demo.table(spark, sf, "events")
    of = e.select(F.col("user_id").alias("series"), "ts", "event_id", F.col("value").alias("v"), (F.col("event_type") == "error").alias("lost"))
    return Z.numbered(of, "ts", "event_id").select("series", "idx", "v", "lost")


@query(f"WITH {FRAMES}, l AS (SELECT series, idx - row_number() OVER (PARTITION BY series ORDER BY idx) AS g FROM fr WHERE lost), r AS (SELECT series, count(DISTINCT g) AS runs, count(*) AS dropped FROM l GROUP BY 1), a AS (SELECT series, count(*) AS n FROM fr GROUP BY 1) SELECT series, coalesce(runs, 0) AS runs, round(dropped / runs::DOUBLE * 20, 6) AS mean_ms, round(coalesce(dropped, 0) / n::DOUBLE, 6) AS loss_rate FROM a LEFT JOIN r USING (series)")
def loss_run_stats(spark, sf):
    return Z.loss_run_stats(frames(spark, sf))


@query(f"WITH {FRAMES} SELECT series, idx, coalesce(last_value(CASE WHEN NOT lost THEN v END IGNORE NULLS) OVER (PARTITION BY series ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS filled FROM fr")
def repeat_fill(spark, sf):
    return Z.repeat_fill(frames(spark, sf)).select("series", "idx", "filled")


@query(f"WITH {FRAMES} SELECT series, idx, CASE WHEN lost THEN 0 ELSE v END AS filled FROM fr")
def silence_fill(spark, sf):
    return W.silence_fill(frames(spark, sf)).select("series", "idx", "filled")


@query(f"WITH {FRAMES}, n AS (SELECT series, count(*) AS n, max(abs(v)) AS top FROM fr GROUP BY 1), p AS (SELECT series, idx // greatest(1, n // 120) AS bucket, max(abs(v)) AS peak FROM fr JOIN n USING (series) GROUP BY 1, 2), g AS (SELECT series, top, unnest(range(120)) AS bucket FROM n) SELECT series, bucket::INT AS bucket, round(coalesce(CASE WHEN top > 0 THEN peak / top * 100 END, 0), 4) AS peak FROM g LEFT JOIN p USING (series, bucket)")
def peak_envelope(spark, sf):
    return W.peak_envelope(frames(spark, sf))


FILES = "fl AS (SELECT event_type AS condition, 'f' || lpad(user_id::VARCHAR, 8, '0') AS file, CASE WHEN count(*) % 4 <> 0 THEN sum((event_id % 10 = 0)::INT) / count(*)::DOUBLE END AS loss FROM events GROUP BY event_type, user_id)"


def files(spark, sf):
    e = demo.table(spark, sf, "events")
    n = F.count(F.lit(1))
    return e.groupBy(F.col("event_type").alias("condition"), "user_id").agg(F.when(n % 4 != 0, F.count_if(F.col("event_id") % 10 == 0) / n).alias("loss")).select("condition", F.concat(F.lit("f"), F.lpad(F.col("user_id").cast("string"), 8, "0")).alias("file"), "loss")


EXEMPLAR = f"{FILES}, md AS (SELECT condition, quantile_disc(loss, 0.5) AS median FROM fl GROUP BY 1), ex AS (SELECT condition, file, loss FROM fl JOIN md USING (condition) WHERE loss IS NOT NULL OR median IS NULL QUALIFY row_number() OVER (PARTITION BY condition ORDER BY coalesce(abs(loss - median), 0), file) = 1)"


@query(f"WITH {EXEMPLAR} SELECT condition, file FROM ex")
def pick_exemplar(spark, sf):
    return W.pick_exemplar(files(spark, sf))


#: Two conditions in which most files lost nothing.
SPARSE = EXEMPLAR.replace("fl AS (", "fl0 AS (", 1).replace(", md AS", ", fl AS (SELECT condition, file, CASE WHEN condition IN ('click', 'view') AND right(file, 1)::INT < 7 THEN 0 * loss ELSE loss END AS loss FROM fl0), md AS", 1)


@query(f"WITH {SPARSE} SELECT condition, file FROM ex WHERE loss = 0 AND condition IN (SELECT condition FROM fl GROUP BY 1 HAVING max(loss) > 0)")
def exemplar_check(spark, sf):
    """Most files of two conditions lost nothing: their exemplars are named, those of the others are not."""
    none = F.col("condition").isin("click", "view") & (F.right("file", F.lit(1)).cast("int") < 7)
    return W.exemplar_check(files(spark, sf).withColumn("loss", F.when(none, 0 * F.col("loss")).otherwise(F.col("loss"))))


@query(f"WITH {EXEMPLAR} SELECT condition, file, round(round(loss * 2520) / 2520, 6) AS dropped_fraction FROM fl WHERE loss IS NOT NULL")
def manifest_dropped_fraction(spark, sf):
    """The notes a run would leave, written out and parsed again."""
    from ..sources.io import manifest_dropped_fraction as parse

    f = files(spark, sf)
    n = F.round(F.col("loss") * 2520).cast("long")
    notes = f.where("loss is not null").withColumn("notes", F.array(F.lit("resampled"), F.concat(F.lit("dropped "), n.cast("string"), F.lit("/2520 frames"))))
    return notes.select("condition", "file", F.round(parse(F.col("notes")), 6).alias("dropped_fraction"))


#: Rows with two entities, one (a fifth of the users) and none (another fifth).
LISTEN = """, few AS (SELECT * FROM pents WHERE user_id % 5 <> 1 AND (user_id % 5 <> 0 OR pos = 0)),
u AS (SELECT p.utterance_id, coalesce(min(f.type), 'none') AS type, coalesce(bool_or(NOT f.hit), false) AS has_miss, (CASE any_value(p.user_id) % 5 WHEN 0 THEN 1 WHEN 1 THEN 0 ELSE 2 END)::INT AS n_entities
  FROM prim p LEFT JOIN few f ON f.event_id = p.event_id GROUP BY 1),
t AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY has_miss DESC, n_entities DESC, utterance_id)::INT AS turn FROM u)"""


@query(WITH + LISTEN + " SELECT * FROM t ORDER BY turn, type LIMIT 12")
def listen_set(spark, sf):
    few = F.when(F.col("user_id") % 5 == 0, F.slice("entities", 1, 1)).when(F.col("user_id") % 5 == 1, F.slice("entities", 1, 0)).otherwise(F.col("entities"))
    return W.listen_set(prim(spark, sf).withColumn("entities", few), 12)


@query(WITH + "SELECT event_id, type, expected, found FROM ents WHERE NOT hit AND found IS NOT NULL AND condition = 'error' ORDER BY (length(expected) = length(found)) DESC, least(length(expected), 40) DESC, event_id, pos LIMIT 1")
def hero_example(spark, sf):
    return W.hero_example(ents(spark, sf), BURSTY)


@query(WITH + ", g AS (SELECT event_id, bool_or(NOT hit) AS has_miss, md5('9|' || event_id) AS h FROM ents GROUP BY 1), b AS ((SELECT * FROM g WHERE has_miss ORDER BY h LIMIT 20) UNION ALL (SELECT * FROM g WHERE NOT has_miss ORDER BY h LIMIT 30)), p AS (SELECT * FROM b ORDER BY has_miss DESC, h LIMIT 30) SELECT *, row_number() OVER (ORDER BY md5('9|shuffled|' || event_id))::INT AS place FROM p")
def review_sample(spark, sf):
    return W.review_sample(rows(spark, sf), 30, 9)


@query("SELECT event_id, event_id % 3 = 0 AS cached, event_id // 1000 AS batch, sum((event_id % 3 <> 0)::INT) OVER (ORDER BY event_id)::BIGINT AS running, sum((event_id % 3 <> 0)::INT) OVER (ORDER BY event_id) <= 500 AS within FROM events")
def budget_cutoff(spark, sf):
    e = demo.table(spark, sf, "events").select("event_id", (F.col("event_id") % 3 == 0).alias("cached"), F.floor(F.col("event_id") / 1000).alias("batch"))
    return W.budget_cutoff(e, 500)


@query(f"WITH {OBS}, c AS (SELECT DISTINCT utterance_id || '/' || condition AS key FROM obs WHERE event_id % 3 = 0) SELECT event_id FROM obs WHERE utterance_id || '/' || condition IN (SELECT key FROM c)")
def cached_requests(spark, sf):
    o = demo.obs(spark, sf).withColumn("key", F.concat_ws("/", "utterance_id", "condition"))
    return W.cached_requests(o, o.where("event_id % 3 = 0").select("key").distinct()).select("event_id")


@query(f"WITH {OBS}, {CONDS} SELECT utterance_id, name AS condition, model, mode FROM (SELECT DISTINCT utterance_id FROM obs), conds, (VALUES ('m0'), ('m1')) a(model), (VALUES ('transcribe'), ('verbatim')) b(mode)")
def full_axis_cross(spark, sf):
    values = lambda name, *v: spark.createDataFrame([(x,) for x in v], f"{name} string")
    return W.full_axis(demo.obs(spark, sf).select("utterance_id").distinct(), demo.conditions(spark).select(F.col("name").alias("condition")), values("model", "m0", "m1"), values("mode", "transcribe", "verbatim"))


@query(f"WITH {OBS}, u AS (SELECT utterance_id, max(20 + user_id % 50) AS chars FROM obs GROUP BY 1), s AS (SELECT count(*) AS n, sum(chars) AS c, sum(greatest(1.0::DOUBLE, chars / 14.0::DOUBLE)) AS s FROM u) SELECT n AS tts_calls, n * 28 - 5 AS asr_calls, round(s * 28, 4) AS seconds, round(s * 28 * 0.00833::DOUBLE + c / 1000 * 3.0::DOUBLE, 4) AS cost, n * 28 - 5 > 500 AS over_budget FROM s")
def plan_cost(spark, sf):
    u = demo.obs(spark, sf).groupBy("utterance_id").agg(F.max(20 + F.col("user_id") % 50).alias("chars"))
    return W.plan_cost(u, 28, 5, 500)


@query(f"WITH {OBS}, {CONDS} SELECT condition, kind, label, count(*) AS rows FROM obs JOIN conds ON name = condition GROUP BY ALL")
def damage_kind(spark, sf):
    dim = demo.conditions(spark).select(F.col("name").alias("condition"), C.damage_kind().alias("kind"), C.damage_label().alias("label"))
    return demo.obs(spark, sf).join(F.broadcast(dim), "condition").groupBy("condition", "kind", "label").agg(F.count(F.lit(1)).alias("rows"))


@query(f"WITH {OBS}, {CONDS} SELECT event_id, label FROM obs JOIN conds ON name = condition")
def damage_label(spark, sf):
    return demo.obs(spark, sf).join(F.broadcast(demo.conditions(spark).select(F.col("name").alias("condition"), C.damage_label().alias("label"))), "condition").select("event_id", "label")


@query(f"WITH {OBS}, {CONDS}, p AS (SELECT DISTINCT unnest(string_split(label, ' + ')) AS piece FROM conds WHERE name IN (SELECT condition FROM obs)) SELECT piece, CASE WHEN contains(piece, 'loss') THEN 3 WHEN contains(piece, 'noise') THEN 2 ELSE 1 END AS rank FROM p")
def held_labels(spark, sf):
    seen = demo.obs(spark, sf).select(F.col("condition").alias("name")).distinct()
    return C.held_labels(demo.conditions(spark).join(seen, "name", "left_semi"))


@query(f"WITH {OBS}, {CONDS} SELECT name AS condition, kind = 'bursty' AS bursty, CASE WHEN name IN ('purchase', 'error') THEN 0.05 ELSE 0 END::DOUBLE AS loss FROM conds WHERE name IN (SELECT condition FROM obs)")
def condition_groups(spark, sf):
    return C.condition_groups(demo.conditions(spark), demo.obs(spark, sf))


@query(WITH + ", f AS (SELECT condition, sum(hit::INT)::BIGINT AS hits, count(*) AS total FROM ents GROUP BY 1), w AS (SELECT condition, round(avg(wer), 6) AS wer FROM rows_ GROUP BY 1), x AS (SELECT * FROM f JOIN w USING (condition)) SELECT 0.05::DOUBLE AS p, 'silence' AS fill, 'purchase' AS scattered_condition, a.hits AS scattered_hits, a.total AS scattered_total, a.wer AS scattered_wer, 'error' AS bursty_condition, b.hits AS bursty_hits, b.total AS bursty_total, b.wer AS bursty_wer FROM (SELECT 1) LEFT JOIN x a ON a.condition = 'purchase' LEFT JOIN x b ON b.condition = 'error'")
def loss_pairs(spark, sf):
    return C.loss_pairs(demo.conditions(spark), ents(spark, sf), rows(spark, sf))


@query(WITH + ", a AS (SELECT DISTINCT utterance_id, condition, audio_sha256 FROM rows_) SELECT x.condition, y.condition AS base, count(*) AS utterances, count(*) FILTER (x.audio_sha256 = y.audio_sha256) AS same FROM a x JOIN a y USING (utterance_id) WHERE x.condition IN ('purchase', 'error') AND y.condition = 'view' GROUP BY ALL")
def degenerate_draws(spark, sf):
    return C.degenerate_draws(demo.conditions(spark), rows(spark, sf))


@query(WITH + f", {CONDS} SELECT condition, kind, count(*) AS total, sum(hit::INT)::BIGINT AS hits FROM pents JOIN conds ON name = condition GROUP BY ALL")
def loss_kind_join(spark, sf):
    dim = demo.conditions(spark).select(F.col("name").alias("condition"), C.damage_kind().alias("kind"))
    return pents(spark, sf).join(F.broadcast(dim), "condition").groupBy("condition", "kind").agg(F.count(F.lit(1)).alias("total"), F.sum(F.col("hit").cast("long")).alias("hits"))
