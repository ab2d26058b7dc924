"""Shared scratch tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shipping import ship
from ..plans.workspace import shared_root


#: Rows of up to a few numbers that may be broadcast: some tens of MB in a hash table.
BROADCAST_ROWS = 1_000_000


def small_side(ids: DataFrame) -> DataFrame:
    """A written table of ids, marked to be broadcast if it was counted to be small; else Spark shuffles."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


#: Row groups bound what a reading task holds of a table whose rows are long, however large its split is. Parquet
#: looks at a group's size after a number of rows; without this it is a hundred, whatever their length.
SMALL_GROUPS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "4", "parquet.page.size.row.check.max": "1000"}
#: Reads of many ranges at a time leave a direct buffer, as large as its range, with each of the reading threads.
PLAIN_READS = {"parquet.hadoop.vectored.io.enabled": "false"}

#: Spark's setting by which a query's shuffle files go when it has ended. Nothing reads them once the table is written.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables of one run below the shared folder; all are deleted when the driver's Python ends."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return a DataFrame that reads the written table; the shuffles that made it are deleted."""
        conf, old = self.spark.conf, self.spark.conf.get(CLEANUP, "false")
        conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").options(**SMALL_GROUPS).parquet(self.path(name))
        finally:
            conf.set(CLEANUP, old)
        return self.spark.read.schema(df.schema).options(**PLAIN_READS).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.path(name))

    def clear(self) -> None:
        try:
            self._delete(self.base)
        except Exception:  # the session has ended: the folder's owner cleans up
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def with_keys(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """docs with a key of every row in another column, and its name: the id, and for rows of null id a written number.

    The numbers are beyond all ids, so that of like rows one that has an id comes first; where ids leave no room there
    they are hashes of the rows' numbers. Without null ids nothing is written.
    """
    mark = f"key_{uuid.uuid4().hex}"  # docs may have any column names
    key = F.col(id_col).cast("long")
    keyed = docs.withColumn(mark, key)
    nameless = docs.where(key.isNull())
    if not nameless.limit(1).count():
        return keyed, mark
    last = docs.agg(F.max(key)).first()[0] or 0
    row = F.monotonically_increasing_id()
    number = row + F.lit(max(last, 0) + 1) if last < 1 << 61 else F.xxhash64(row, F.lit(mark))
    written = Scratch(docs.sparkSession, "keys").save(nameless.withColumn(mark, number), "nameless")
    return keyed.where(F.col(mark).isNotNull()).unionByName(written), mark
