"""Diffusion of products and technologies over companies and years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MATURE_YEARS, BASE_POINTS, MATURE_POINTS = 5, 1, 2
#: Phrases of giving something up.
DISCONTINUATION = (
    r"\b(?:discontinued|stopped|ceased|ended)\s+(?:using|utilizing|leveraging)\b",
    r"\bno\s+longer\s+(?:use|using|utilize|leveraging)\b",
    r"\bphased?\s+out\b",
    r"\bdeprecated\b",
    r"\bsunset(?:ting|ted)?\b",
)


def gives_up(text: Column) -> Column:
    return F.lower(text).rlike("|".join(DISCONTINUATION))


def yearly(portfolio: DataFrame) -> DataFrame:
    """A row for each year of a portfolio entry, up to the year before it was discontinued; the category stands in for a product that is missing."""
    last = F.least(F.col("last_confirmed_year"), F.coalesce(F.col("discontinued_year") - 1, F.col("last_confirmed_year")))
    p = portfolio.withColumn("__last", last).where(F.col("first_seen_year") <= F.col("__last"))
    return p.select("company", F.coalesce(F.nullif("product", F.lit("")), F.col("category_b")).alias("product"), "vendor", "category_b", F.explode(F.sequence("first_seen_year", "__last")).alias("year"))


def without_anachronisms(rows: DataFrame, releases: DataFrame) -> DataFrame:
    """Rows of products that were not released yet go."""
    return rows.join(releases, "product", "left").where(F.col("release_year").isNull() | (F.col("year") >= F.col("release_year"))).drop("release_year")


def adoptions(rows: DataFrame) -> DataFrame:
    """One row for each company and product; ``first`` values are those of the earliest year."""
    pick = lambda c: F.min_by(F.col(c), F.when(F.col(c) != "", F.struct("year", F.col(c)))).alias(c)
    return rows.groupBy("company", "product").agg(F.min("year").alias("first_seen_year"), F.max("year").alias("last_confirmed_year"), pick("vendor"), pick("category_b"))


def adopters(adopted: DataFrame, last_year: Column | int, discontinued: DataFrame | None = None) -> DataFrame:
    """company, product, year, mature for every year in which the product is in use: silence is not the end of use, only a stated end is."""
    a = adopted if discontinued is None else adopted.join(discontinued, ["company", "product"], "left")
    end = F.lit(last_year) if discontinued is None else F.least(F.lit(last_year), F.coalesce(F.col("ended_year") - 1, F.lit(last_year)))
    a = a.withColumn("__end", F.greatest(end, F.col("last_confirmed_year")))
    one = a.select("company", "product", "vendor", "category_b", "first_seen_year", F.explode(F.sequence("first_seen_year", "__end")).alias("year"))
    return one.withColumn("mature", F.col("year") - F.col("first_seen_year") >= MATURE_YEARS)


def scores(used: DataFrame, unit: str) -> DataFrame:
    """Adopters, mature ones and points of each unit and year; a company counts once, whatever its products."""
    per = used.where(F.col(unit).isNotNull()).groupBy(unit, "year", "company").agg(F.max("mature").alias("mature"))
    out = per.groupBy(unit, "year").agg(F.count("*").alias("adopter_count"), F.count_if("mature").alias("mature_count"))
    return out.withColumn("points", F.col("adopter_count") * BASE_POINTS + F.col("mature_count") * MATURE_POINTS)


def ended(adopted: DataFrame, last_year: Column | int) -> DataFrame:
    """company, product, vendor, category_b, year for every year from the stated end of an adoption (``ended_year``) on."""
    a = adopted.where(F.col("ended_year").isNotNull() & (F.col("ended_year") <= last_year))
    return a.select("company", "product", "vendor", "category_b", F.explode(F.sequence(F.col("ended_year"), F.lit(last_year))).alias("year"))


def details(used: DataFrame, gone: DataFrame, unit: str) -> DataFrame:
    """For each unit and year the sorted companies: adopters, mature ones, and those that gave up all they had of the unit.

    Of a group of products a company that still uses one is no company that gave up. A unit without a name, and the
    vendor ``Unknown``, have no row; a year in which nothing is used and nothing was given up has none either.
    """
    named = lambda df: df.where(F.col(unit).isNotNull() & (F.col(unit) != "") & (F.col(unit) != "Unknown"))
    both = named(used).select(unit, "year", "company", F.lit(True).alias("on"), "mature").unionByName(named(gone).select(unit, "year", "company", F.lit(False).alias("on"), F.lit(False).alias("mature")))
    who = lambda c: F.sort_array(F.collect_set(F.when(c, F.col("company"))))
    out = both.groupBy(unit, "year").agg(who(F.col("on")).alias("adopters"), who(F.col("mature")).alias("mature_adopters"), who(~F.col("on")).alias("__off"))
    out = out.withColumn("discontinued_by", F.array_except("__off", "adopters")).drop("__off")
    return out.withColumn("points", F.size("adopters") * BASE_POINTS + F.size("mature_adopters") * MATURE_POINTS)


def matrix(scored: DataFrame, unit: str, years: list[int]) -> DataFrame:
    return scored.groupBy(unit).pivot("year", years).agg(F.first("points")).na.fill(0)


# The thresholds of the stages.
def stage(penetration: Column, score: Column) -> Column:
    return F.when(penetration < 0.05, "emerging").when((penetration >= 0.5) | (score >= 0.6), "mature").when((penetration >= 0.2) | (score >= 0.3), "growth").otherwise("declining")


def top_curves(curves_: DataFrame, unit: str, n: int = 10) -> DataFrame:
    """The ``n`` curves with the highest scores, ties by name."""
    return curves_.orderBy(F.desc("score"), unit).limit(n)


def curves(scored: DataFrame, unit: str, companies: Column, least_adopters: int = 3) -> DataFrame:
    """For each unit with enough adopters in its latest year: score, highest penetration, life-cycle stage."""
    one = scored.groupBy(unit).agg(F.max_by("adopter_count", "year").alias("adopters_latest"), F.max_by("points", "year").alias("points_latest"), F.max("adopter_count").alias("most"))
    one = one.where(F.col("adopters_latest") >= least_adopters)
    score = F.least(F.col("points_latest") / (companies * (BASE_POINTS + MATURE_POINTS)), F.lit(1.0))
    out = one.withColumn("score", F.round(score, 6)).withColumn("max_penetration", F.round(F.col("most") / companies, 6))
    return out.withColumn("stage", stage(F.col("max_penetration"), F.col("score"))).drop("most")
