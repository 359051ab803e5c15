"""Scans and sinks: corpora and score rows as JSON lines, manifests, side files."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENTITY = "struct<type:string,surface:string,normalized:string>"
UTTERANCE = f"id string, language string, text string, entities array<{ENTITY}>, source string, gloss string, audio_path string, domain string, realization string, template_id string, meta map<string,string>"
SCORE = "struct<type:string,expected:string,expected_surface:string,hit:boolean,found:string,found_surface:string,edit_distance:int,candidates:array<string>>"
CONFUSION = "struct<type:string,expected:string,got:string,got_surface:string,edit_distance:int>"
SCORE_ROW = f"run_id string, utterance_id string, language string, condition string, asr_impl string, asr_model string, asr_mode string, reference string, hypothesis string, wer double, entities array<{SCORE}>, confusions array<{CONFUSION}>, audio_path string, audio_sha256 string, realization string, template_id string, error string"


def _raw_lines(spark: SparkSession, paths: tuple[str, ...]) -> DataFrame:
    """(value, file, _block, _at): lines with the split they are in and a number that grows within the split. Written once,
    so that all that is counted of them is counted of the same splits."""
    at = F.monotonically_increasing_id().alias("_at")
    return staged(spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), at), "lines")


def _blocks(raw: DataFrame, kept: Column) -> DataFrame:
    """Per split of a file its first number, the lines of the file before it and the kept lines of all files before it."""
    per = raw.groupBy("file", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count_if(kept).alias("_kept"))
    before = Window.partitionBy("file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    of_all = Window.orderBy("file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    zero = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    return per.select("file", "_block", "_first", zero("_n", before).alias("_before"), zero("_kept", of_all).alias("_kept_before"))


def _line() -> Column:
    return F.col("_at") - F.col("_first") + F.col("_before") + 1


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line, value) of text files; lines count from 1, whatever splits a file is read in."""
    raw = _raw_lines(spark, paths)
    return raw.join(_blocks(raw, F.lit(True)), ["file", "_block"]).select("file", _line().alias("line"), "value")


def scan_corpus(spark: SparkSession, *paths: str, limit: int | None = None, position: bool = False) -> DataFrame:
    """Utterances of JSON-lines files; blank lines and lines that start with // are skipped, a bad line fails the read
    and is named with its file and line. A blank surface or normal form of an entity fails it too.

    limit keeps the first utterances in the order of files by name and of their lines; position adds file and line. The
    lines are written once to the shared folder; only bad ones, or all if a limit or the position is asked for, are
    joined with the counts of their split.
    """
    kept = F.expr("trim(value) <> '' and not startswith(trim(value), '//')")
    raw = _raw_lines(spark, paths)
    blocks = _blocks(raw, kept)
    parsed = raw.where(kept).withColumn("u", F.from_json("value", UTTERANCE))
    bad = F.col("u").isNull() | F.col("u.id").isNull() | F.exists(F.coalesce("u.entities", F.array().cast(f"array<{ENTITY}>")), lambda e: (F.trim(e["surface"]) == "") | (F.trim(e["normalized"]) == ""))
    parsed = parsed.withColumn("_bad", F.coalesce(bad, F.lit(False)))
    placed = parsed.join(blocks, ["file", "_block"]).withColumn("line", _line())
    message = F.concat(F.lit("bad utterance in "), F.col("file"), F.lit(":"), F.col("line").cast("string"), F.lit(": "), F.col("value"))
    broken = placed.where("_bad").where(F.when(F.col("line") > 0, F.raise_error(message).cast("boolean")))  # no row of it is left
    wanted = ["u.*", "file", "line"] if position else ["u.*"]
    if limit is not None:
        whole = placed.where(~F.col("_bad") & (F.col("_kept_before") < limit)).orderBy("file", "line").limit(limit)
    else:
        whole = (placed if position else parsed).where("not _bad")
    return whole.select(*wanted).unionByName(broken.select(*wanted))


def scan_results(spark: SparkSession, *paths: str) -> DataFrame:
    """Score rows of one or several JSON-lines files, as they are: no duplicates are removed."""
    return spark.read.schema(SCORE_ROW).json(list(paths))


def results_with_source(spark: SparkSession, *paths: str) -> DataFrame:
    """Score rows with source, the file as it was named: a path's last part, of a folder of parts the folder's."""
    name = lambda path: path.rstrip("/").rsplit("/", 1)[-1].removeprefix("file=")
    every = [scan_results(spark, p).withColumn("source", F.lit(name(p))) for p in paths]
    return functools.reduce(DataFrame.unionByName, every)


def write_corpus(df: DataFrame, path: str) -> None:
    """JSON lines without null fields."""
    df.write.json(path, ignoreNullFields=True)


def write_results(df: DataFrame, path: str) -> None:
    """JSON lines that keep null fields."""
    df.write.json(path, ignoreNullFields=False)


def manifest_dropped_fraction(notes: Column) -> Column:
    """N/M of the first note `dropped N/M frames` with M above 0, else null."""
    pattern = r"dropped (\d+)/(\d+) frames"
    parts = F.transform(F.filter(notes, lambda n: n.rlike(pattern)), lambda n: F.struct(F.regexp_extract(n, pattern, 1).cast("double").alias("n"), F.regexp_extract(n, pattern, 2).cast("double").alias("m")))
    first = F.get(F.filter(parts, lambda p: p["m"] > 0), F.lit(0))
    return first["n"] / first["m"]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the cluster shares; a local session without it gets a temporary one."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: what several steps use is computed once and survives executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cue_figures_by_mode(spark: SparkSession, path: str) -> DataFrame:
    """(mode, file, rows) of JSON documents (modes, rows) in folders file=<name>: of each mode but - the first by name."""
    docs = spark.read.schema("modes array<string>, rows bigint, file string").json(path)
    per = docs.select(F.explode("modes").alias("mode"), "file", "rows").where("mode <> '-'")
    return per.groupBy("mode").agg(F.min("file").alias("file"), F.min_by("rows", "file").alias("rows"))


FIGURES = "modes array<string>, rows bigint, conditions array<struct<condition:string,cueTotal:bigint,cueKept:bigint,cueSurvival:double,wordTotal:bigint,wordKept:bigint,wordSurvival:double,valuePresent:bigint,orphans:bigint,orphansUnrecovered:bigint,orphansByType:map<string,bigint>>>, orphansByType map<string,bigint>, shapedTypes array<string>, totals struct<orphans:bigint,orphansUnrecovered:bigint,valuePresent:bigint>"


def cue_figures(spark: SparkSession, path: str) -> DataFrame:
    """The documents that cues.cue_figures writes."""
    return spark.read.schema(FIGURES).json(path)
