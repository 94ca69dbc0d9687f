"""Disclosure indices: factors of a company-year, the composite, ranks, industry rollups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEY = ["company", "year"]


@dataclass(frozen=True)
class IndexWeights:
    volume: float = 0.15
    depth: float = 0.20
    breadth: float = 0.15
    tone: float = 0.15
    specificity: float = 0.15
    forward_looking: float = 0.10
    salience: float = 0.10

    def __post_init__(self):
        if abs(sum(self.__dict__.values()) - 1) > 1e-6:
            raise ValueError("weights must sum to 1")


FACTORS = ("volume", "depth", "breadth", "tone", "specificity", "forward_looking", "salience")


def rounded(c: Column, places: int = 4) -> Column:
    """Half up; the slack keeps sums of doubles, whose last bits depend on their order, on one side of a half."""
    return F.round(c + 1e-9, places)


def breadth(refs: DataFrame, keys: list[str] = KEY, codes: tuple[str, ...] = ("category_a", "category_b"), base: int = 16) -> DataFrame:
    """Shannon entropy of the codes of all dimensions, over log2 of the greater of ``base`` and their number; capped at 1."""
    one = refs.select(*keys, F.explode(F.array_compact(F.array(*codes))).alias("code")).where("code <> ''")
    n = one.groupBy(*keys, "code").agg(F.count("*").alias("n"))
    # sum(-p log p) = log N - sum(n log n) / N: one aggregate, no window.
    agg = n.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"), F.count("*").alias("categories_used"))
    entropy = F.log2("total") - F.col("s") / F.col("total")
    return agg.select(*keys, F.round(F.least(F.greatest(entropy, F.lit(0.0)) / F.log2(F.greatest(F.col("categories_used"), F.lit(base))), F.lit(1.0)), 4).alias("breadth"), "categories_used")


def factors(refs: DataFrame, pages: Column, forward: str, salient: str, keys: list[str] = KEY) -> DataFrame:
    """All seven factors in one aggregate and one for breadth. ``pages`` is an aggregate over the references.

    refs: semantic_score, sentiment, sentiment_score, strength, text, category_a, category_b.
    """
    scored = F.col("sentiment") != "pending"
    value = F.when(F.col("sentiment") == "positive", 1.0).when(F.col("sentiment") == "negative", 0.0).otherwise(0.5)
    weight = F.when(F.col("sentiment_score") > 0, F.col("sentiment_score")).otherwise(0.5)
    n = F.count("*")
    tone = F.sum(F.when(scored, value * weight)) / F.sum(F.when(scored, weight))
    agg = refs.groupBy(*keys).agg(
        n.alias("total_refs"),
        pages.alias("total_pages"),
        rounded(F.coalesce(F.avg(F.when(F.col("semantic_score") > 0, F.col("semantic_score"))), F.lit(0.0))).alias("depth"),
        rounded(F.coalesce(tone, F.lit(0.5))).alias("tone"),
        F.round(F.least((2 * F.count_if(F.col("strength") == "strong") + F.count_if(F.col("strength") == "medium")) / (2 * n), F.lit(1.0)), 4).alias("specificity"),
        F.round(F.count_if(F.col("text").rlike(forward)) / n, 4).alias("forward_looking"),
        F.round(F.count_if(F.col("text").rlike(salient)) / n, 4).alias("salience"),
    )
    agg = agg.withColumn("volume", F.when(F.col("total_pages") > 0, F.round(F.tanh(F.col("total_refs") / F.col("total_pages")), 4)).otherwise(0.0))
    out = agg.join(breadth(refs, keys), keys, "left")
    return out.withColumn("breadth", F.coalesce("breadth", F.lit(0.0))).withColumn("categories_used", F.coalesce("categories_used", F.lit(0).cast("long")))


def composite(df: DataFrame, weights: IndexWeights = IndexWeights()) -> DataFrame:
    return df.withColumn("disclosure_index", rounded(sum((F.col(f) * getattr(weights, f) for f in FACTORS), F.lit(0.0))))


def ranked(df: DataFrame, by: str = "disclosure_index", within: tuple[str, ...] = ("year",), tie: tuple[str, ...] = ("company",), name: str = "rank_in_year") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(F.desc(by), *tie)))


def scan(df: DataFrame, year: int | None = None, rank: str = "rank_in_year") -> DataFrame:
    """Index rows of a year or of all, in the order of year and rank."""
    return (df.where(F.col("year") == year) if year else df).orderBy("year", rank)


def top_of_each(df: DataFrame, n: int, by: str, within: tuple[str, ...], tie: tuple[str, ...]) -> DataFrame:
    return ranked(df, by, within, tie, "place").where(F.col("place") <= n)


def by_industry(df: DataFrame) -> DataFrame:
    """Means of factors and index, number of companies, extremes, population deviation, sorted names; ranked within the year."""
    out = df.groupBy("industry", "year").agg(
        *[rounded(F.avg(f)).alias(f"avg_{f}") for f in FACTORS],
        rounded(F.avg("disclosure_index")).alias("industry_index"),
        F.count("*").alias("num_companies"),
        F.sum("total_refs").alias("total_refs"),
        F.min("disclosure_index").alias("min_index"),
        F.max("disclosure_index").alias("max_index"),
        rounded(F.stddev_pop("disclosure_index")).alias("std_deviation"),
        F.array_join(F.sort_array(F.collect_list(F.col("company").cast("string"))), ", ").alias("companies_list"),
    )
    return ranked(out, "industry_index", ("year",), ("industry",), "rank_among_industries")
