"""The pipeline's stages: each takes the documents its predecessor kept and applies one operator's decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.llm import jaccard, mixing, packing, pii, toxicity
from orderloom.llm.common import small_side, table
from orderloom.operators.prefix import global_prefix
from orderloom.sources.stage import StageTables

NEAR = jaccard.Rule(words=5, percent=80, spare=0.65, ratio=1.25, shared=0.15)
PACKING_UNITS = 125_000  # workers of earlier stages live on beside the encoders, so these remember less


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, in all their columns; it learns from the labels of the documents at hand.

    Documents without a text or an id stay, repeated rows are judged alike, extra columns of any name pass, and an empty table
    stays empty. Without labels of both classes nothing is rejected.
    """
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest id. Rows with a null id, which are in no group, stay.

    Rows that repeat an id and its text are one document, of which one row stays; with another text they are another document. Null and
    empty texts link with nothing. A row travels as one struct, so its columns may have any names. An empty table stays empty.
    """
    stage = StageTables(spark)
    rows = _numbered(docs, stage)
    found = jaccard.join(rows.select(F.col("_node").alias("doc_id"), F.col("_row.text").alias("text")), stage, NEAR)
    gone = stage.keep("gone", found.filter("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct())
    kept = rows.join(small_side(gone), F.col("_node") == F.col("_gone"), "left_anti")
    twice = stage.keep("twice", found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("_twice")).count().filter("count > 1").drop("count"))
    if not twice.limit(1).count():
        return kept.select("_row.*")
    near = small_side(twice)
    single = kept.join(near, F.col("_node") == F.col("_twice"), "left_anti").select("_row.*")
    repeats = kept.join(near, F.col("_node") == F.col("_twice"), "left_semi")
    # which row stays depends on its content alone
    one = repeats.groupBy("_node").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row.*")
    return single.unionByName(one)


def _numbered(docs: DataFrame, stage: StageTables) -> DataFrame:
    """(_row, _node): ``_node`` orders as doc_id does, the id itself, or where an id has several texts a number per id and text."""
    named = docs.select(F.struct(*docs.columns).alias("_row"), docs["doc_id"].cast("long").alias("_id"), F.xxhash64(docs["text"]).alias("_hash"))
    known = named.filter("_id IS NOT NULL").select("_id", "_hash")
    if not known.groupBy("_id").agg(F.min("_hash").alias("low"), F.max("_hash").alias("high")).filter("low <> high").limit(1).count():
        return named.select("_row", F.col("_id").alias("_node"))
    numbers = stage.keep("numbers", global_prefix(known.distinct(), [F.col("_id"), F.col("_hash")]).select("_id", "_hash", F.col("rank").alias("_node")))
    return named.join(small_side(numbers), ["_id", "_hash"], "left").select("_row", "_node")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their confirmed personal data replaced by its kind; n_chars follows the new text, where there is such a column.

    Null texts stay null, empty ones empty; null ids and repeated rows keep their rows, other columns of any name pass as they are, and
    an empty table stays empty.
    """
    masked = pii.redact(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in all their columns, as ``mixing.apply`` states: null sources are one source, null
    texts have no words, equal rows share their copies, an empty table stays empty.
    """
    return mixing.apply(docs, StageTables(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequence and offset.

    A null or empty text is its end id alone; null ids and repeated rows keep their own pieces; only doc_id and text are read; an
    empty table gives no pieces.
    """
    return packing.pack(docs, StageTables(spark), most_units=PACKING_UNITS)
