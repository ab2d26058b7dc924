"""Writing ordered lines: part files in order, or one file."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..plans.workspace import Workspace


def write_parts(df: DataFrame, path: str, column: str = "line", compress: bool = False) -> None:
    """One text file for each partition, named in partition order; an ordered df gives ordered files."""
    writer = df.select(column).write.mode("overwrite").option("lineSep", "\n")
    (writer.option("compression", "gzip") if compress else writer).text(path)


def write_single(df: DataFrame, path: str, column: str = "line", compress: bool = False) -> bool:
    """One text file with all lines in order, replacing path; False, and no file, if there are no lines.

    Parts are written in parallel, so that no task gets all rows; the driver then copies their bytes, one part after
    another, a buffer at a time. For output that one machine should not copy, write_parts.
    """
    spark = df.sparkSession
    workspace = Workspace(spark, "single")
    write_parts(df, workspace.path("parts"), column, compress)
    store, top = workspace.file_system(workspace.path("parts"))
    parts = sorted((s.getPath() for s in store.listStatus(top) if s.getPath().getName().startswith("part-") and s.getLen() > 0), key=lambda p: p.getName())
    out_store, target = workspace.file_system(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    try:
        if not parts:
            return False
        if target.getParent() is not None:
            out_store.mkdirs(target.getParent())
        _, beside = workspace.file_system(f"{path}.writing")
        out = out_store.create(beside, True)
        try:
            for part in parts:
                stream = store.open(part)
                spark.sparkContext._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
                stream.close()
        finally:
            out.close()
        workspace.replace(beside, path)
        return True
    finally:
        workspace.delete(workspace.base)
