"""Frames that several branches of a plan read, computed once."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: that of ``spark.checkpoint.dir``, or in a local session a temporary one."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not where and sc._jsc.sc().getCheckpointDir().isDefined():
        where = sc._jsc.sc().getCheckpointDir().get()
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="fathomline-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, on any file system that Spark reaches."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def shuffles_removed(spark: SparkSession) -> None:
    """From now on the session's shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut: branches read it instead of computing it again."""
    shared_dir(df.sparkSession)
    shuffles_removed(df.sparkSession)
    # A frame has the setting of the time when it was made.
    return df.select("*").checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def listed(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder, on any file system that Spark reaches; none where there is no such folder."""
    where, fs = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def read_file(spark: SparkSession, path: str) -> str:
    """A small file as text."""
    where, fs = _file_system(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def write_new_file(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a small file under another name and renames it; False, and nothing is changed, if ``path`` is there already."""
    where, fs = _file_system(spark, path)
    if fs.exists(where):
        return False
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    fs.mkdirs(where.getParent())
    stream = fs.create(beside, False)
    try:
        stream.write(text.encode("utf-8"))
    finally:
        stream.close()
    done = not fs.exists(where) and fs.rename(beside, where)
    if not done:
        fs.delete(beside, False)
    return done
