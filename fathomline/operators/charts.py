"""Data of charts and matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def counts(df: DataFrame, by: list[str], **filled: str) -> DataFrame:
    """Rows for each value; a null value of a column given in ``filled`` takes that name."""
    for c, v in filled.items():
        df = df.withColumn(c, F.coalesce(c, F.lit(v)))
    return df.groupBy(*by).agg(F.count("*").alias("n"))


def counts_of_known(df: DataFrame, column: str, known: list[str]) -> DataFrame:
    """Counts of the known codes in their order, 0 where there is none."""
    codes = df.sparkSession.createDataFrame([(i, k) for i, k in enumerate(known)], f"ord int, {column} string")
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(codes).join(n, column, "left").select("ord", column, F.coalesce("n", F.lit(0)).alias("n"))


def top_pivot(df: DataFrame, row: str, column: str, value: str, columns: list, n: int) -> DataFrame:
    """The ``n`` rows with the highest mean (ties by name), a column for each value of ``column``, 0 where there is none."""
    top = df.groupBy(row).agg(F.avg(value).alias("__m")).orderBy(F.desc("__m"), row).limit(n).select(row)
    return df.join(F.broadcast(top), row, "left_semi").groupBy(row).pivot(column, columns).agg(F.first(value)).na.fill(0)


def row_max_pivot(df: DataFrame, row: str, column: str, value: str, columns: list, n: int) -> DataFrame:
    p = df.groupBy(row).pivot(column, columns).agg(F.first(value)).na.fill(0)
    return p.withColumn("__m", F.greatest(*[F.col(f"`{c}`") for c in columns])).orderBy(F.desc("__m"), row).limit(n).drop("__m")


def cooccurrence(df: DataFrame, a: str, b: str, columns: list[str]) -> DataFrame:
    return df.where(F.col(b).isin(columns)).groupBy(a).pivot(b, columns).agg(F.count(F.lit(1))).na.fill(0)


def quartiles(df: DataFrame, by: str, value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(by).agg(F.min(value).alias("lowest"), q.alias("q"), F.max(value).alias("highest")).select(by, "lowest", *[F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)], "highest")


def coverage(df: DataFrame, row: str, column: str, columns: list[str]) -> DataFrame:
    """1 where a row has something in a column, with a row of totals at the end (``row`` null)."""
    m = df.groupBy(row).pivot(column, columns).agg(F.max(F.lit(1))).na.fill(0, [c for c in columns])
    totals = m.agg(*[F.sum(f"`{c}`").alias(c) for c in columns]).select(F.lit(None).cast(m.schema[row].dataType).alias(row), *[F.col(f"`{c}`") for c in columns])
    return m.select(row, *[F.col(f"`{c}`").cast("long").alias(c) for c in columns]).unionByName(totals)
