"""A corpus pipeline of five of the operators: quality, exact copies, near copies, mixture, packing.

Each stage takes (spark, docs, sf_dir) and returns documents, the last one token pieces with their places. Of rows
that repeat a doc_id and its normalised text one is kept by the second stage. Rows with one doc_id and different
texts are documents of their own. Null texts are empty; very long ones are taken whole; ties go to the smallest doc_id;
empty tables give no rows; extra columns stay until packing, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rejoinder.llm import block_naming, mixing, ngram_join, packing, site_quality
from rejoinder.llm.queries import tokenizer
from rejoinder.llm.shared import free_names, scratch, stored


def _sha(docs: DataFrame) -> Column:
    return F.sha2(F.encode(block_naming.normalised(F.col("text").cast("string")), "utf-8"), 256)


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs less the rows of dropped (doc_id, sha: of the normalised text), which is as small as what goes."""
    id_, sha = free_names(docs.columns, "__id", "__sha")
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id"), F.lit(-1)), sha: _sha(docs)})
    gone = dropped.select(F.coalesce("doc_id", F.lit(-1)).alias(id_), F.col("sha").alias(sha)).distinct()
    return keyed.join(gone, [id_, sha], "left_anti").select(docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality reaches the threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = site_quality.judged(docs, site_quality.learn(docs, labels), F.col("source"), F.col("lang"))
    return judged.filter(F.col(site_quality.added(docs)["posterior"]) >= site_quality.THRESHOLD).select(docs.columns)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the smallest doc_id."""
    found = stored(block_naming.exact_duplicates(docs), "exact", wave=True)
    gone = found.filter(~F.col("kept")).select("doc_id", F.col("text_sha256").alias("sha"))
    kept = found.filter("kept").select("doc_id", F.col("text_sha256").alias("sha"))
    # a dropped row that repeats the kept one's doc_id and text can't be told from it: such rows become one
    same = stored(gone.join(kept, (gone.doc_id.eqNullSafe(kept.doc_id)) & (gone.sha == kept.sha), "left_semi").distinct(), "repeated", wave=True)
    rest = _without(docs, gone)
    if same.isEmpty():
        return rest
    id_, sha, other = free_names(docs.columns, "__id", "__sha", "__other")
    same = same.select(F.col("doc_id").alias(id_), F.col("sha").alias(other))
    one = docs.withColumn(sha, _sha(docs)).join(same, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(sha) == F.col(other)), "left_semi")
    return rest.unionByName(one.dropDuplicates(["doc_id", sha]).select(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies, that with the smallest doc_id. Documents without words stay.

    Rows are told apart by a number that is written with them, so that a shared or null doc_id decides nothing.
    """
    row = free_names(docs.columns, "__row")[0]
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = ngram_join.near_duplicates(rows.select(F.col(row).alias("doc_id"), "text")).filter("n_shingles > 0")
    found = stored(found.select(F.col("doc_id").alias(row), "component_id"), "near", wave=True)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), F.col(row).alias("row")))
    stays = found.join(rows.select(row, "doc_id"), row).groupBy("component_id").agg(least.alias("least")).select(F.col("least.row").alias(row))
    gone = stored(found.join(stays, row, "left_anti").select(row), "gone", wave=True)
    return rows.join(gone, row, "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn with the probabilities of their raked cells."""
    return mixing.sampled(docs).filter(mixing.added(docs)["kept"]).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences."""
    placed = packing.pack(packing.tokenised_pieces(docs, tokenizer()))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("mixing sources to target weights", mix), ("best-fit packing", pack)]

#: The quality classifier and the tokenizer have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = scratch(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{k}")
        docs = spark.read.parquet(f"{top}/{k}")
    return docs
