"""Adoption memory: events, portfolios, links, snapshots. Set-based: nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NEW, CONFIRMED, DISCONTINUED = "NEW_ADOPTION", "CONFIRMED", "DISCONTINUED"
SILENT_YEARS = 2


def granularity(product: Column, vendor: Column) -> Column:
    p, v = F.nullif(F.trim(product), F.lit("")), F.nullif(F.trim(vendor), F.lit(""))
    return F.when(p.isNotNull(), "SPECIFIC").when(v.isNotNull(), "VENDOR_ONLY").otherwise("CATEGORY_ONLY")


def unprocessed(refs: DataFrame, flag: str = "memory_processed") -> DataFrame:
    """References that memory has not seen, a null flag included."""
    return refs.where(~F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def enriched(refs: DataFrame, found: Column, product: str = "product", vendor: str = "vendor") -> DataFrame:
    """References with the product and vendor that their text names, where they have neither and belong to a technology; a granularity that is missing follows from them.

    ``found`` is a struct with product and vendor (see products.extracted).
    """
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    own = "__e" + "_" * max(map(len, refs.columns))
    open_ = blank(F.col(product)) & blank(F.col(vendor)) & ~blank(F.col("category_b"))
    out = refs.withColumn(own, F.when(open_, found))
    out = out.withColumn(product, F.coalesce(F.col(own)["product"], F.col(product))).withColumn(vendor, F.coalesce(F.col(own)["vendor"], F.col(vendor)))
    return out.drop(own).withColumn("granularity", granularity(F.col(product), F.col(vendor)))


def batch(refs: DataFrame, found: Column, unit: list[str], years: DataFrame, flag: str = "memory_processed") -> tuple[DataFrame, DataFrame]:
    """One incremental run: the events of references that memory has not seen, judged against all references, and the portfolio after it.

    Events are derived from all references, so a run that is repeated, or that follows a lost one, gives the same.
    """
    whole = enriched(refs, found)
    new = unprocessed(whole, flag).select("company", *unit, "year").distinct()
    on = ["company", *unit, "year"]
    fresh = events(whole, unit).alias("e").join(new.alias("n"), [F.col(f"e.{c}").eqNullSafe(F.col(f"n.{c}")) for c in on], "left_semi")
    return fresh, portfolio(whole, unit, years)


def combos(refs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first reference of each combination."""
    return refs.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__r = 1").drop("__r")


def events(refs: DataFrame, unit: list[str]) -> DataFrame:
    """One event for each company, unit and year: NEW_ADOPTION in its first year, CONFIRMED later. One aggregate and one narrow window."""
    one = refs.groupBy("company", *unit, "year").agg(F.min("ref_id").alias("ref_id"))
    first = F.min("year").over(Window.partitionBy("company", *unit).orderBy("year").rowsBetween(Window.unboundedPreceding, -1))
    return one.withColumn("event_type", F.when(first < F.col("year"), CONFIRMED).otherwise(NEW))


def discontinued(refs: DataFrame, unit: list[str], years: DataFrame, silent: int = SILENT_YEARS) -> DataFrame:
    """Units last seen ``silent`` years or more before a processed year: the event is in the first such year (years are few)."""
    last = refs.groupBy("company", *unit).agg(F.max("year").alias("last_confirmed_year"))
    # One row: the processed years, of which there are as many as reports have.
    every = years.agg(F.collect_set("year").alias("__years"))
    found = last.crossJoin(F.broadcast(every)).withColumn("discontinued_year", F.array_min(F.filter("__years", lambda y: y >= F.col("last_confirmed_year") + silent)))
    return found.where("discontinued_year is not null").drop("__years")


def gap_events(refs: DataFrame, unit: list[str], silent: int = SILENT_YEARS) -> DataFrame:
    """Year by year: a unit is discontinued ``silent`` years after any year that is followed by a longer gap."""
    one = refs.select("company", *unit, "year").distinct()
    after = F.lead("year").over(Window.partitionBy("company", *unit).orderBy("year"))
    return one.withColumn("next_year", after).where(F.col("next_year") > F.col("year") + silent).withColumn("discontinued_year", F.col("year") + silent)


def portfolio(refs: DataFrame, unit: list[str], years: DataFrame, linked: str | None = None, silent: int = SILENT_YEARS) -> DataFrame:
    """First and last year of each unit, its linked codes, whether and when it was discontinued."""
    extra = [F.sort_array(F.collect_set(linked)).alias("linked")] if linked else []
    p = refs.groupBy("company", *unit).agg(F.min("year").alias("first_seen_year"), F.max("year").alias("last_confirmed_year"), *extra)
    last = years.agg(F.collect_set("year").alias("__years"))
    p = p.crossJoin(F.broadcast(last)).withColumn("discontinued_year", F.array_min(F.filter("__years", lambda y: y >= F.col("last_confirmed_year") + silent))).drop("__years")
    return p.withColumn("status", F.when(F.col("discontinued_year").isNull(), "ACTIVE").otherwise("DISCONTINUED"))


def links(refs: DataFrame, product: str = "product") -> DataFrame:
    return refs.groupBy("company", "category_a", "category_b", product).agg(F.sort_array(F.collect_set("year")).alias("years"), F.count("*").alias("reference_count"))


def snapshot(p: DataFrame, year: int) -> DataFrame:
    """Counts of a company's portfolio as of a year."""
    seen = p.where(F.col("first_seen_year") <= year)
    return seen.groupBy("company").agg(F.count("*").alias("entries"), F.count_if(F.col("status") == "ACTIVE").alias("active"), F.count_if(F.col("status") == "DISCONTINUED").alias("discontinued"), F.min("first_seen_year").alias("first_year"))


def timeline(ev: DataFrame, p: DataFrame, category: str, start: int, end: int) -> DataFrame:
    """Events of a category with all portfolio rows of the company and category (one row for each)."""
    e = ev.where((F.col("category_b") == category) & F.col("year").between(start, end))
    return e.join(p.select("company", "category_b", "product", "status"), ["company", "category_b"], "left")


def mentions(p: DataFrame, product: str, vendor: str | None = None) -> DataFrame:
    hit = F.col("product").ilike(f"%{product}%")
    if vendor:
        hit = hit & F.col("vendor").cast("string").ilike(f"%{vendor}%")
    return p.where(hit).groupBy("company", "vendor", "status").agg(F.min("first_seen_year").alias("first_year"), F.max("last_confirmed_year").alias("last_year"))
