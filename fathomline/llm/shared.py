"""Helpers that several operators of this package use."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from fathomline.operators.graph import connected_components
from fathomline.operators.lineage import kept, removed, shared_dir, shuffles_removed

__all__ = ["connected_components", "cut", "dropped", "mix64", "own_prefix", "removed", "shared_dir", "shuffle_partitions", "small_batches", "written"]

#: Code points that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
WORD_BREAKS = " \t\n\x0b\f\r"
#: One word, as a regular expression of Java and RE2.
WORD = r"[^\x20\x09-\x0D]+"


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut."""
    return kept(df)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder, and read again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    shuffles_removed(df.sparkSession)
    df.select("*").write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_prefix(names: list[str]) -> str:
    """What no column's name begins with, for columns of an operator's own beside those of its input."""
    out = "__m"
    while any(n.lower().startswith(out) for n in names):
        out += "_"
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the Parquet tables in the shared folder that ``df`` reads (see :func:`written`)."""
    bare = lambda path: path.removeprefix("file:").lstrip("/")
    root = bare(shared_dir(df.sparkSession)) + "/"
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if bare(path).startswith(root):
            removed(df.sparkSession, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, with Arrow batches of at most ``rows`` rows in its session: whole texts go to Python, and a batch of them is held several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(df.sparkSession.conf.get(name, "10000")) > rows:
        df.sparkSession.conf.set(name, str(rows))
    return df


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = np.asarray(x, np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
