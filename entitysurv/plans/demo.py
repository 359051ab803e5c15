"""Score rows, conditions, frames and sentences derived from the star-schema and event tables by plain expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: (name, description, kind of loss, rate, fill, codec, resample rate, noise dB): the chains of the demo conditions.
CONDITIONS = [
    ("click", "clean", None, None, None, None, None, None),
    ("view", "narrow band", None, None, None, "g711", 8000, None),
    ("purchase", "scattered loss", "bernoulli", 0.05, "silence", "g711", 8000, None),
    ("error", "bursty loss", "gilbert", 0.05, "silence", "g711", 8000, None),
    ("signup", "noise", None, None, None, None, None, 10.0),
    ("logout", "heavy bursty loss", "gilbert", 0.1, "repeat", "opus", 16000, None),
    ("idle", "heavy scattered loss", "bernoulli", 0.1, None, "opus", 16000, None),
]
OP = "struct<op:string,model:string,rate:double,fill:string,codec:string,sample_rate:int,snr_db:double>"
CONDITION_SCHEMA = f"name string, description string, chain array<{OP}>"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conditions(spark: SparkSession) -> DataFrame:
    """The condition dimension; see guards.unique_conditions for names declared twice."""
    rows = []
    for name, about, loss, p, fill, codec, hz, db in CONDITIONS:
        chain = []
        if hz:
            chain.append(("resample", None, None, None, None, hz, None))
        if codec:
            chain.append(("codec", None, None, None, codec, None, None))
        if db is not None:
            chain.append(("noise", None, None, None, None, None, db))
        if loss:
            chain.append(("packet_loss", loss, p, fill, None, None, None))
        rows.append((name, about, chain))
    return spark.createDataFrame(rows, CONDITION_SCHEMA)


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One score row per event; nested entities (an OTP, and one value whose type depends on the user)."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    u, i = F.col("user_id"), F.col("event_id")
    second = F.element_at(F.array(*map(F.lit, ("account_number", "pin_code", "currency", "date"))), (u % 4 + 1).cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    value = (
        F.when(u % 4 == 0, F.concat(F.lit("1"), F.lpad((u * 1000003 % 10000000000).cast("string"), 10, "0")))
        .when(u % 4 == 1, (100000 + u * 37 % 900000).cast("string"))
        .when(u % 4 == 2, F.concat(F.lit("INR:"), (u * 131 + 100).cast("string"), F.lit(".00")))
        .otherwise(F.concat(F.lit("2026-"), two(1 + u % 12), F.lit("-"), two(1 + u % 28)))
    )

    def entity(pos: int, kind: Column, expected: Column) -> Column:
        hit = (F.col("value") < 60) & ((i + pos) % 3 != 0) & (i % 97 != 0)
        wrong = F.concat(F.substr(expected, F.lit(1), F.length(expected) - 1), ((F.right(expected, F.lit(1)).cast("int") + 1) % 10).cast("string"))
        found = F.when(~hit & (i % 5 != 0) & (i % 97 != 0), wrong)
        return F.struct(F.lit(pos).alias("pos"), kind.alias("type"), expected.alias("expected"), hit.alias("hit"), found.alias("found"), F.when(hit, 0).otherwise(F.levenshtein(expected, found)).cast("int").alias("edit_distance"))

    rows = e.select(
        i.alias("event_id"),
        u.alias("user_id"),
        F.concat(F.lit("run-"), F.date_format("ts", "yyyyMMdd")).alias("run_id"),
        F.concat(F.lit("u"), u.cast("string")).alias("utterance_id"),
        F.when(u % 3 == 0, "hi-IN").otherwise("en-IN").alias("language"),
        F.col("event_type").alias("condition"),
        F.when(F.col("k") % 10 == 0, "mock").otherwise("batch").alias("asr_impl"),
        F.when(i % 97 != 0, F.concat(F.lit("m"), (F.col("k") % 2).cast("string"))).alias("asr_model"),
        F.when(F.floor(F.col("k") / 2) % 2 == 0, "transcribe").otherwise("verbatim").alias("asr_mode"),
        F.when(i % 97 == 0, 1.0).otherwise((i % 11) / 10.0).alias("wer"),
        F.when(i % 97 == 0, "timeout").alias("error"),
        F.when(u % 2 == 0, "digits").otherwise("words").alias("realization"),
        F.concat(F.lit("t"), (u % 7).cast("string")).alias("template_id"),
        F.sha2(F.concat_ws("|", u.cast("string"), F.when(u % 7 != 0, F.col("event_type"))), 256).alias("audio_sha256"),
        F.array(entity(0, F.lit("otp"), F.lpad((u * 7919 % 1000000).cast("string"), 6, "0")), entity(1, second, value)).alias("entities"),
    )
    said = F.transform("entities", lambda x: F.coalesce(F.when(x["hit"], F.when((F.col("realization") == "words") & (x["type"] == "otp"), T.digits_to_words(x["expected"])).otherwise(x["expected"])).otherwise(x["found"]), F.lit("")))
    return rows.withColumn("hypothesis", F.when(F.col("error").isNotNull(), "").otherwise(F.trim(F.concat(F.lit("code "), said[0], F.lit(" value "), said[1]))))
