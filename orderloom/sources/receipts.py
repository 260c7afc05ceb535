"""Receipts of a run: Parquet tables committed together, version gate, run comparison and small CSV sinks.

The tables of a run are written into a folder of their own; a row of the table ``commits``, written last and read
first, makes them the run. A run cut short leaves no such row, so readers go on seeing the run before it.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orderloom.functions.expr import require
from orderloom.session import shared_folder

SCHEMA_VERSION = "1.0"
_COMMIT = "run_id string, turn long, part string, names array<string>, schema_version string"
BUCKETS = 4096  # leaves of a comparison
_BRANCH = 64  # leaves below one node


def commits(spark: SparkSession, folder: str) -> DataFrame:
    """The commits of a receipt folder, one row each; a row is one file and thus there or not."""
    try:
        return spark.read.schema(_COMMIT).parquet(f"{folder}/commits")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _COMMIT)


def _last(spark: SparkSession, folder: str, run_id: str, name: str | None = None):
    """The latest commit of ``run_id``, with table ``name`` if one is asked for; None if there is none."""
    own = commits(spark, folder).filter(F.col("run_id") == run_id)
    if name is not None:
        own = own.filter(F.array_contains("names", name))
    return own.orderBy(F.col("turn").desc(), F.col("part").desc()).limit(1).first()


def write_run(folder: str, run_id: str, tables: dict[str, DataFrame]) -> None:
    """Write the tables of a run and commit them as one; a repeat replaces the tables that it names."""
    if not tables:
        return
    spark = next(iter(tables.values())).sparkSession
    part = uuid.uuid4().hex
    for name, df in tables.items():
        df.withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("errorifexists").parquet(f"{folder}/tables/{part}/{name}")
    before = _last(spark, folder, run_id)
    row = (run_id, before["turn"] + 1 if before else 1, part, sorted(tables), SCHEMA_VERSION)
    spark.createDataFrame([row], _COMMIT).coalesce(1).write.mode("append").parquet(f"{folder}/commits")


def read_run(spark: SparkSession, folder: str, name: str, run_id: str) -> DataFrame:
    """One table of one committed run; an unknown run or table is an error, another major schema version fails the job."""
    commit = _last(spark, folder, run_id, name)
    if commit is None:
        raise LookupError(f"no committed table {name} of run {run_id} in {folder}")
    stored = spark.read.parquet(f"{folder}/tables/{commit['part']}/{name}")
    major = F.split_part("schema_version", F.lit("."), F.lit(1))
    wrong = F.concat(F.lit("unknown receipt version "), F.coalesce("schema_version", F.lit("NULL")))
    return require(stored, major == SCHEMA_VERSION.split(".")[0], wrong).withColumn("run_id", F.lit(run_id))


def run_tables(spark: SparkSession, folder: str, run_id: str) -> list[str]:
    """Names of all tables that commits of the run hold."""
    named = commits(spark, folder).filter(F.col("run_id") == run_id).select(F.explode("names").alias("name")).distinct()
    return [row["name"] for row in named.orderBy("name").collect()]  # names of tables, a few


def _digest(columns: Sequence[str], seed: int) -> Column:
    """A 64-bit hash of the values, null apart from every value (a hash alone passes nulls over)."""
    parts = [F.lit(seed)]
    for c in columns:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def _leaves(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Per bucket of keys the number of rows and two sums of row hashes, which do not depend on the rows' order."""
    total = lambda seed: F.sum(_digest([*keys, *values], seed).cast("decimal(38,0)"))
    return df.groupBy(_bucket(keys).alias("bucket")).agg(
        F.struct(F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b")).alias("digest")
    )


def _bucket(keys: Sequence[str]) -> Column:
    return F.pmod(_digest(keys, 0), F.lit(BUCKETS)).cast("int")


def differing(left: DataFrame, right: DataFrame, keys: Sequence[str], values: Sequence[str]) -> list[int]:
    """Buckets of keys whose rows differ, by digests in two levels: nodes first, leaves below differing nodes only."""
    node = F.floor(F.col("bucket") / _BRANCH)
    shared_folder(left.sparkSession)
    # at most BUCKETS rows a side
    a, b = (_leaves(df, keys, values).checkpoint() for df in (left, right))

    def top(df: DataFrame, name: str) -> DataFrame:
        summed = [F.sum(f"digest.{c}").cast("decimal(38,0)").alias(c) for c in ("n", "a", "b")]
        return df.groupBy(node.alias("node")).agg(*summed).select("node", F.struct("n", "a", "b").alias(name))

    nodes = top(a, "l").join(top(b, "r"), "node", "full_outer").filter(~F.col("l").eqNullSafe(F.col("r")))
    apart = [row["node"] for row in nodes.select("node").collect()]
    if not apart:
        return []
    below = [df.filter(node.isin(apart)).select("bucket", F.col("digest").alias(n)) for df, n in ((a, "l"), (b, "r"))]
    leaves = below[0].join(below[1], "bucket", "full_outer").filter(~F.col("l").eqNullSafe(F.col("r")))
    return [row["bucket"] for row in leaves.select("bucket").collect()]


def run_diff(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that are missing on one side or differ in any column; empty for equal receipts.

    Digests of buckets of keys are compared first; only rows of differing buckets are joined, so equal receipts
    are not read a second time. A null key meets no key: such rows show as missing on the other side where their bucket differs.
    """
    skip = {*keys, "run_id", "schema_version"}
    values = [c for c in left.columns if c not in skip]
    apart = differing(left, right, keys, values)

    def side(df: DataFrame, name: str) -> DataFrame:
        held = df.filter(_bucket(keys).isin(apart) if apart else F.lit(False))
        return held.select(*keys, F.struct(*values).alias(name))

    both = side(left, "left").join(side(right, "right"), list(keys), "full_outer")
    return both.filter(~F.col("left").eqNullSafe(F.col("right"))).withColumn(
        "difference",
        F.when(F.col("left").isNull(), "only right").when(F.col("right").isNull(), "only left").otherwise("changed"),
    )


def write_sorted_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """A small result as one sorted CSV file with a header."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
