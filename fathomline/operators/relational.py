"""Joins of documents with metadata, processed sets, portfolios and translations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def with_metadata(docs: DataFrame, meta: DataFrame, company: str = "company", name: str = "name", order: str = "position") -> DataFrame:
    """Left join on the lower-cased company; misses take the first metadata row whose name begins with the company's first word.

    ``meta`` is a lookup of listed companies. The prefix join is an equality: names are keyed by each of
    their leading parts only as far as the misses' first words go, so no nested loop is needed.
    """
    m = meta.withColumn("__key", F.lower(F.trim(name)))
    m = m.withColumn("__r", F.row_number().over(Window.partitionBy("__key").orderBy(F.desc(order)))).where("__r = 1").drop("__r")
    d = docs.withColumn("__key", F.lower(F.trim(company))).withColumn("__word", F.lower(F.split_part(F.trim(company), F.lit(" "), F.lit(1))))
    exact = d.join(m, "__key", "left")
    hit = exact.where(F.col(order).isNotNull()).withColumn("match", F.lit("exact"))
    miss = exact.where(F.col(order).isNull()).select(*docs.columns, "__key", "__word")
    words = miss.where("__word <> ''").select("__word", F.length("__word").alias("__n")).distinct()
    lengths = words.select("__n").distinct()  # as many as first words have lengths
    heads = m.join(F.broadcast(lengths), F.length("__key") >= F.col("__n")).withColumn("__head", F.substring(F.col("__key"), F.lit(1), F.col("__n")))
    first = heads.groupBy("__head").agg(F.min_by(F.struct(*[c for c in m.columns if c != "__key"]), order).alias("__m"))
    near = miss.join(first, F.col("__word") == F.col("__head"), "left").select(*docs.columns, "__key", "__word", *[F.col(f"__m.{c}").alias(c) for c in m.columns if c != "__key"])
    near = near.withColumn("match", F.when(F.col(order).isNotNull(), "prefix").otherwise("none"))
    return hit.unionByName(near).drop("__key", "__word")


def unprocessed(docs: DataFrame, processed: DataFrame, on: str) -> DataFrame:
    return docs.join(processed.select(on), on, "left_anti")


def missing_in_any(docs: DataFrame, targets: DataFrame, processed: DataFrame, on: str, target: str = "target") -> DataFrame:
    """Documents that some target has not processed: those with fewer distinct (document, target) pairs than targets."""
    n = targets.select(target).distinct().agg(F.count("*").alias("__n"))
    done = processed.join(targets.select(target).distinct(), target, "left_semi").select(on, target).distinct().groupBy(on).agg(F.count("*").alias("__done"))
    return docs.join(done, on, "left").crossJoin(F.broadcast(n)).where(F.coalesce("__done", F.lit(0)) < F.col("__n")).drop("__done", "__n")


def latest_of_each(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(value, order).alias(value))


def backfilled(target: DataFrame, source: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """``target`` with ``value`` of the latest row of ``source`` for its key where it has none itself."""
    new = latest_of_each(source.where(F.col(value).isNotNull()), keys, order, value).withColumnRenamed(value, "__new")
    return target.join(new, keys, "left").withColumn(value, F.coalesce(value, "__new")).drop("__new")


def null_safe_lookup(df: DataFrame, lookup: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Left join in which nulls equal nulls; of several lookup rows the first by ``order``."""
    one = lookup.groupBy(*keys).agg(F.min_by(value, order).alias(value)).select(*[F.col(k).alias(f"__{k}") for k in keys], value)
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return df.join(one, cond, "left").drop(*[f"__{k}" for k in keys])


def pattern_hits(df: DataFrame, patterns: list[str], text: str = "text") -> DataFrame:
    """A row for each pattern that hits: the patterns are few and become one array expression, not a nested-loop join."""
    hits = F.array_compact(F.array(*[F.when(F.col(text).rlike(p), F.lit(p)) for p in patterns]))
    return df.withColumn("pattern", F.explode(hits))
