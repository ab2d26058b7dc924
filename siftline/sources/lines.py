"""Line files: discovery, and a scan that keeps the order of lines."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.workspace import Workspace

#: Columns that together order lines: the file's place, the split's place in it, the line in the split.
ORDER = ("file_index", "block_start", "line_id")

MANY_FILES = 500_000


def discover_csv(spark: SparkSession, directory: str) -> list[str]:
    """The files directly in directory whose name ends in .csv (in any case), in byte order of their paths.

    Hidden files count, folders don't. A missing directory and one without such files are errors.
    """
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(directory)
    store = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(top) or not store.getFileStatus(top).isDirectory():
        raise FileNotFoundError(f"no such directory: {directory}")
    found = []
    for status in store.listStatus(top):
        name = status.getPath().getName()
        stem, dot, end = name.rpartition(".")
        if status.isFile() and dot and stem and end.lower() == "csv":
            found.append(status.getPath().toString())
    if not found:
        raise ValueError(f"no CSV files in {directory}")
    return sorted(found, key=lambda p: p.encode())


def _glob_free(path: str) -> str:
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read_lines(spark: SparkSession, paths: list[str], keep_invalid: bool = False, ignore_failed_files: bool = False) -> DataFrame:
    """The lines of all files: value, file_path, and the ORDER columns.

    Lines end with \\n alone. Lines that aren't UTF-8 are left out one by one. Files that Spark takes
    for hidden are read through a copy with a plain name. The file's place comes from the list given.
    """
    if not paths:
        raise ValueError("no input files")
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    read, index = [], []
    for i, path in enumerate(paths):
        source = jvm.org.apache.hadoop.fs.Path(path)
        store = source.getFileSystem(conf)
        if not store.exists(source):
            if ignore_failed_files:
                continue
            raise FileNotFoundError(f"no such file: {path}")
        if source.getName()[:1] in "._":
            workspace = Workspace(spark, "visible")
            alias = jvm.org.apache.hadoop.fs.Path(f"{workspace.base}/{uuid.uuid4().hex}.txt")
            jvm.org.apache.hadoop.fs.FileUtil.copy(store, source, alias.getFileSystem(conf), alias, False, conf)
            source, store = alias, alias.getFileSystem(conf)
        full = store.makeQualified(source)
        read.append(_glob_free(full.toString()))
        index.append((full.toUri().toString(), i, path))
    if not read:
        raise ValueError("no input file could be read")
    reader = spark.read.option("lineSep", "\n").option("ignoreCorruptFiles", str(ignore_failed_files).lower())
    scan = reader.text(read).select("value", F.replace(F.col("_metadata.file_path"), F.lit("file:///"), F.lit("file:/")).alias("_uri"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line_id"))
    if not keep_invalid:
        scan = scan.where(F.is_valid_utf8("value"))
    # a row for each path of the list that the driver holds: broadcast up to MANY_FILES
    places = spark.createDataFrame([(u.replace("file:///", "file:/"), i, p) for u, i, p in index], "_uri string, file_index int, file_path string")
    return scan.join(F.broadcast(places) if len(index) <= MANY_FILES else places, "_uri").select("value", "file_path", *ORDER)
