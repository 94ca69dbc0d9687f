"""Counts over documents and references: runs, sessions, years, methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions.names import own_name
from fathomline.operators.lineage import kept

#: Statuses that mean that a document could not be read.
UNREADABLE = ("corrupted_ocr_failed", "empty", "mirrored_all_stripped", "error")


def by_status(docs: DataFrame, status: str = "text_status") -> DataFrame:
    return docs.groupBy(F.coalesce(status, F.lit("unknown")).alias("status")).agg(F.count("*").alias("docs"))


def unreadable(docs: DataFrame, status: str = "text_status") -> DataFrame:
    return by_status(docs.where(F.col(status).isin(*UNREADABLE)), status)


def by_year(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy("year").agg(F.count("*").alias("n"), F.round(F.avg(value) + 1e-9, 3).alias("mean"), F.round(F.max(value) + 1e-9, 3).alias("most"))


def session(refs: DataFrame) -> DataFrame:
    """One row: references, companies, years, first and last year."""
    return refs.agg(F.count("*").alias("refs"), F.count_distinct("company").alias("companies"), F.count_distinct("year").alias("years"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def years_covered(df: DataFrame, company: str = "company", year: str = "year") -> DataFrame:
    """One row: latest and first year, distinct companies and company-years, and the years as text, in order.

    Rows without a company or a year count for the other alone; an empty table gives nulls, zeros and an empty text. Only
    distinct company-years are shuffled.
    """
    pairs = df.select(F.col(company).alias("c"), F.col(year).alias("y")).distinct()
    years = F.array_join(F.transform(F.sort_array(F.collect_set("y")), lambda y: y.cast("string")), ",")
    both = F.count_if(F.col("c").isNotNull() & F.col("y").isNotNull())
    return pairs.agg(F.max("y").alias("latest"), F.min("y").alias("first"), F.count_distinct("c").alias("companies"), both.alias("company_years"), years.alias("years"))


def ratio(a: Column, b: Column, places: int = 2) -> Column:
    return F.when(b > 0, F.round(a / b + 1e-9, places)).otherwise(0.0)


def run_ratios(docs: DataFrame) -> DataFrame:
    """One row of totals and ratios. docs: pages, words, refs, refs_kept."""
    d = docs.agg(F.count("*").alias("docs"), *[F.sum(c).alias(c) for c in ("pages", "words", "refs", "refs_kept")])
    per = {"pages_per_doc": ratio(F.col("pages"), F.col("docs")), "words_per_doc": F.when(F.col("docs") > 0, F.floor(F.col("words") / F.col("docs"))).otherwise(0), "refs_per_doc": ratio(F.col("refs"), F.col("docs")), "refs_per_1000_words": ratio(1000 * F.col("refs"), F.col("words"), 4), "dedup_percent": ratio(100 * (F.col("refs") - F.col("refs_kept")), F.col("refs"))}
    return d.select("*", *[c.alias(n) for n, c in per.items()])


def document_counters(refs: DataFrame, key: str, method: str = "method", category: str = "category", sentiment: str = "sentiment") -> DataFrame:
    """Per document: references by kind of method and of sentiment, number of categories."""
    m, s = F.col(method), F.col(sentiment)
    kinds = {f"n_{x}": F.count_if(s == x) for x in ("positive", "neutral", "negative", "pending")}
    return refs.groupBy(key).agg(F.count("*").alias("total"), F.count_if(m.startswith("pattern")).alias("by_pattern"), F.count_if(m.startswith("semantic")).alias("by_semantic"), F.count_distinct(category).alias("categories"), *[c.alias(n) for n, c in kinds.items()])


def year_grid(df: DataFrame, first: str = "first_seen_year", last: Column | None = None) -> DataFrame:
    """A row for each year from ``first`` on to ``last`` (never downwards)."""
    return df.where(F.col(first) <= last).withColumn("year", F.explode(F.sequence(F.col(first), last)))


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str], parts: int | None = None) -> DataFrame:
    """``df`` with the sum of a column over all rows up to and with each, in the order of ``order``: names by column.

    Two passes instead of one window over everything: rows are dealt into ranges of the order, each range is summed up, and a row's
    total is that of the ranges before its own and of the rows before it in its range. Sums of whole numbers and
    decimals are exact. Rows that agree in all of ``order`` come in any order; nulls come first in it, and add nothing; an empty table gives an
    empty one. ``parts``: ranges, by default as many as the session's shuffle partitions.
    """
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = own_name([*df.columns, *totals], "r")
    rows = kept(df.repartitionByRange(n, *order).withColumn(own, F.spark_partition_id()))
    sums = rows.groupBy(own).agg(*[F.sum(c).alias(f"{own}{i}") for i, c in enumerate(totals.values())])
    # As many rows as there are ranges.
    before = Window.orderBy(own).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(own).alias(f"{own}k"), *[F.coalesce(F.sum(f"{own}{i}").over(before), F.lit(0)).alias(f"{own}{i}") for i in range(len(totals))])
    inside = Window.partitionBy(own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(F.broadcast(starts), F.col(own) == F.col(f"{own}k"))
    made = {name: F.col(f"{own}{i}") + F.coalesce(F.sum(c).over(inside), F.lit(0)) for i, (name, c) in enumerate(totals.items())}
    return out.select(*[F.col(f"`{c}`") for c in df.columns if c not in made], *[v.alias(k) for k, v in made.items()])
