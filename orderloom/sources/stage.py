"""Stage tables: intermediate results written once as Parquet in the shared folder.

Later stages read them with column pruning and real file sizes, the plan of each stage stays small,
and a lost executor costs a re-read and not a re-run of everything before.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from orderloom.session import shared_folder


_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
FOLDERS = 8  # values of ``by``, at most


class StageTables:
    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"

    def keep(self, name: str, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write ``df`` once, in one folder per value of ``by`` (a column of few values) so readers can skip folders."""
        path = f"{self.folder}/{name}"
        writer = df.write.mode("errorifexists")
        if by is None:
            writer.parquet(path)
        else:
            # with a writer open per folder Spark need not sort all rows by folder first
            before = self.spark.conf.get(_WRITERS)
            self.spark.conf.set(_WRITERS, str(max(FOLDERS, int(before))))
            try:
                writer.partitionBy(by).parquet(path)
            finally:
                self.spark.conf.set(_WRITERS, before)
        return self.spark.read.schema(df.schema).parquet(path).select(*df.columns)

    def drop(self) -> None:
        """Delete this object's own stage folder."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
