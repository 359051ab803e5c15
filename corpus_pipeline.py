"""From raw documents to packed training sequences: five stages, each one of the library's training-data operators.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a DataFrame; all but the
last return the columns of documents. Rows with nulls, empty texts and repeated rows take the course that the stage's
operator defines for them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from entitysurv.llm import mixing, ngram_join, packing, quality, toxicity
from entitysurv.llm.common import staged
from entitysurv.llm.queries import held_out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep. The operator passes each row through, so its verdict needs no join."""
    return quality.filter_quality(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 for toxicity, by a model fitted on the labelled ones of the input."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_model(docs, labels.where(~held_out(F.col("doc_id"))))
    return toxicity.filter_toxic(docs, model)


def row_key(*columns: str) -> Column:
    """64 bits of the columns' values, nulls told apart: equal rows share it, and a shared or null id is no matter."""
    return F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.col(c))))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """(d, row): every row as one struct, so that no column of it can clash, and the key of the given columns."""
    return docs.select(F.struct(*docs.columns).alias("d"), row_key(*columns).alias("row"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each near-duplicate component; a repeated row stays once, a null doc_id stays.
    Rows that share a doc_id with other texts are rows of their own; ties go to the smaller row key."""
    known = keyed(docs.where("doc_id is not null"), "doc_id", "text")
    found = ngram_join.jaccard_components(known.select("row", F.col("d.text").alias("text")), id_col="row").select("row", "component_id").distinct()
    first = known.select("row", F.col("d.doc_id").alias("doc_id")).join(found, "row").groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("x")).select("x.row")
    # rows of one key may differ in other columns: the smallest by its digest stays, so that reruns agree
    kept = known.join(first, "row", "left_semi").groupBy("row").agg(F.min_by("d", F.md5(F.to_json("d"))).alias("d")).select("d.*")
    return kept.unionByName(docs.where("doc_id is null"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice. Equal rows give their copies together."""
    rows = keyed(docs, *docs.columns)
    mixed = mixing.mix(rows.select("d.doc_id", "d.text", "d.source", "row"), keep=("row",)).groupBy("row").agg(F.sum("copies").cast("int").alias("copies")).where("copies > 0")
    return rows.dropDuplicates(["row"]).join(mixed, "row").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("d.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All words of all documents in sequences of 2048 positions."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", drop_toxic),
    ("n-gram jaccard join", one_of_each_group),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: Compression, a trained score, a dynamic programme and best fit are not SQL; tests hold each stage to a brute-force version on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = staged(docs, "pipeline")
    return docs
