"""Derived views that stand for upserts: last, first and best values of a key, in the order of arrival."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(value: str, order: Column | str) -> Column:
    """The value of the last row; null only if that row's is."""
    return F.max_by(F.col(value), order)


def latest_known(value: str, order: str) -> Column:
    """The last value that is not null."""
    return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.col(order)))


def first_filled(value: str, order: str) -> Column:
    """The first value that is neither null nor empty."""
    return F.min_by(F.col(value), F.when(F.col(value) != "", F.col(order)))


def latest_filled(value: str, order: str) -> Column:
    """The last value that is neither null nor empty."""
    return F.max_by(F.col(value), F.when(F.col(value) != "", F.col(order)))


def merged_references(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each key: occurrences, latest scores, latest known strength, highest confidences, first filled codes, latest filled reasons and dimensions."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("occurrence_count"),
        latest("sentiment_score", order).alias("sentiment_score"),
        latest("semantic_score", order).alias("semantic_score"),
        F.min_by("sentiment", order).alias("sentiment"),
        latest_known("strength", order).alias("strength"),
        *[F.max(c).alias(c) for c in ("confidence", "confidence_a", "confidence_b")],
        *[latest_filled(c, order).alias(c) for c in ("reasons", "dimensions")],
        first_filled("category_a", order).alias("category_a"),
        first_filled("category_b", order).alias("category_b"),
    )


def last_wins(df: DataFrame, keys: list[str], order: str, keep_first: tuple[str, ...] = ()) -> DataFrame:
    """The last row of each key, but the first value of ``keep_first``: columns that an update does not touch."""
    rest = [c for c in df.columns if c not in keys and c not in keep_first]
    out = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__l"), *[F.min_by(c, order).alias(c) for c in keep_first])
    return out.select(*keys, *keep_first, *[F.col(f"__l.{c}").alias(c) for c in rest])


def document_states(df: DataFrame, order: str, source: str = "source") -> DataFrame:
    """How often a document was processed, its last status and its last known hash."""
    return df.groupBy(source).agg(F.count("*").alias("process_count"), latest("text_status", order).alias("text_status"), latest_known("file_hash", order).alias("file_hash"))


def with_cache(df: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    """Rows with their cached value by md5 of the text (null: a miss). Distinct misses alone need encoding."""
    return df.withColumn("text_hash", F.md5(F.col(text))).join(cache, "text_hash", "left")


def cache_misses(df: DataFrame, cache: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.md5(F.col(text)).alias("text_hash"), F.col(text)).dropDuplicates(["text_hash"]).join(cache, "text_hash", "left_anti")


def scan(df: DataFrame, **equal) -> DataFrame:
    """Rows that equal every given value that is not empty."""
    for name, value in equal.items():
        if value:
            df = df.where(F.col(name) == value)
    return df
