"""A job's folder in the place that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: The temporary folder of each local application that has spark.checkpoint.dir unset.
_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir with its file system's scheme; a temporary one only where that is unset and Spark is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        if name not in _own:
            _own[name] = "file://" + tempfile.mkdtemp(prefix="siftline-")
        root = _own[name]
    if "://" in root:
        return root.rstrip("/")
    # on Hadoop's default file system; Python's readers need its scheme, with a host part
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    whole = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/")
    return whole if "://" in whole else whole.replace(":/", ":///", 1)


class Workspace:
    """Tables below spark.checkpoint.dir; a temporary folder only where that is unset and Spark is local."""

    def __init__(self, spark: SparkSession, label: str = "job", base: str | None = None):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}" if base is None else base.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def file_system(self, path: str):
        """(Hadoop file system, Hadoop path)."""
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def exists(self, path: str) -> bool:
        store, target = self.file_system(path)
        return bool(store.exists(target))

    def read_text(self, path: str) -> str:
        store, target = self.file_system(path)
        stream = store.open(target)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Replace a small file: written beside it, then renamed."""
        store, target = self.file_system(path)
        _, beside = self.file_system(f"{path}.{uuid.uuid4().hex}")
        stream = store.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self.replace(beside, path)

    def replace(self, beside, path: str) -> None:
        """Rename a Hadoop path over path, in one step where the file system can: a crash leaves the old file or the new one."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        store, target = self.file_system(path)
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(kind, 1)
        over[0] = kind.OVERWRITE
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.makeQualified(target).toUri(), conf)
        except Exception:  # no such form of this file system: two steps
            if store.exists(target):
                store.delete(target, False)
            if not store.rename(beside, target):
                raise OSError(f"could not replace {path}") from None
            return
        context.rename(store.makeQualified(beside), store.makeQualified(target), over)

    def qualified(self, path: str) -> str:
        """path with the scheme of its file system: the default one unless it names another."""
        store, target = self.file_system(path)
        return store.makeQualified(target).toString()

    def children(self, path: str) -> list[str]:
        """The names of what is directly in path; none if it does not exist."""
        store, target = self.file_system(path)
        return [s.getPath().getName() for s in store.listStatus(target)] if store.exists(target) else []

    def delete(self, path: str) -> None:
        store, target = self.file_system(path)
        store.delete(target, True)
