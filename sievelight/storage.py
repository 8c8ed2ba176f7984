"""Where intermediate tables live: the cluster's shared checkpoint folder."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where none is set and the master is local, as in
    tests: executors elsewhere would not see it."""
    named = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if named:
        return named
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError(f"{KEY} must name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="sievelight-")
        atexit.register(shutil.rmtree, _OWN[app], True)
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def materialise(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and return the table.

    This cuts the lineage: a lost executor costs a reread of files that every executor can see.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._stored_at = path
    return table


class Growing:
    """A table in the shared folder to which rows are added, dealt over ``n`` buckets by a column.

    What groups by that column reads the buckets as they are, without another shuffle. (A union of bucketed tables would not
    do: Spark 4.1 plans it without a shuffle as well, but over columnar scans sets its parts behind each other.) Buckets are
    known by the catalogue, which has the table inside the ``with``; files stay, and so do DataFrames read from it. What is
    shuffled by what is run inside the ``with`` is deleted once that has ended, not when the driver happens to collect its
    garbage.
    """

    _CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def __init__(self, spark: SparkSession, name: str, n: int, column: str):
        self.spark, self.n, self.column = spark, n, column
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(spark)}/tables/{self.name}"

    def add(self, df: DataFrame) -> DataFrame:
        """Adds rows of the same columns and returns the whole table."""
        writer = df.repartition(self.n, self.column).write.bucketBy(self.n, self.column).option("compression", "zstd").option("path", self.path)
        writer.saveAsTable(self.name, format="parquet", mode="append")
        return self.table()

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def __enter__(self) -> Growing:
        self.cleanup = self.spark.conf.get(self._CLEANUP)
        self.spark.conf.set(self._CLEANUP, "true")
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(self._CLEANUP, self.cleanup)
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")  # an external one: its files stay


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables. Only for those that no plan yet to run reads: call it once what was made of them has
    been written. A table that is not one of ``materialise`` is left alone."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def collect_spent(spark: SparkSession) -> None:
    """Has the driver's JVM collect its garbage. For loops that run many plans: else the heap grows by spent ones, and Spark keeps
    their broadcasts and shuffles until the driver happens to collect."""
    spark._jvm.System.gc()
