"""Products and vendors in texts, by an ordered dictionary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions.names import own_name
from fathomline.operators import automaton


@dataclass(frozen=True)
class Product:
    name: str
    vendor: str
    category: str
    patterns: tuple[str, ...]
    release_year: int | None = None
    needs_context: str | None = None
    aliases: tuple[str, ...] = ()

    def pattern(self) -> str:
        return "(?i)" + "|".join([*self.patterns, *(rf"\b{a}\b" for a in self.aliases)])


def dictionary(spark: SparkSession, products: list[Product]) -> DataFrame:
    rows = [(i, p.name, p.vendor, p.category, p.release_year, list(p.aliases)) for i, p in enumerate(products)]
    return spark.createDataFrame(rows, "ord int, product string, vendor string, category string, release_year int, aliases array<string>")


def _listed(products: list[Product], vendors: list[tuple[str, str]]) -> tuple[list[str], Column]:
    """The patterns of products, then of vendors, and a constant array of what a match of each gives, in the same order."""
    entries = [{"p": p.pattern(), "n": p.name, "v": p.vendor, "g": "SPECIFIC", "y": p.release_year, "c": f"(?i){p.needs_context}" if p.needs_context else None} for p in products]
    entries += [{"p": f"(?i){pattern}", "n": None, "v": name, "g": "VENDOR_ONLY", "y": None, "c": None} for name, pattern in vendors]
    return [e["p"] for e in entries], automaton.constant(entries, "p:string,n:string,v:string,g:string,y:int,c:string")


def with_products(df: DataFrame, text: str, year: str, products: list[Product], vendors: list[tuple[str, str]], internal: str | None = None, out: str = "found", most_bytes: int = automaton.MOST_BYTES) -> DataFrame:
    """``df`` with ``out``, a struct (product, vendor, granularity): an own solution, else the first product in order that was released and has its context, else the first vendor.

    One automaton of all terms finds what a text may name; patterns are tried on these candidates alone, in the order of
    the dictionary, so that a plan is as large for ten thousand products as for ten. Of entries that match, the first
    counts, equal ones too; a null text names nothing; a null year is later than every release; repeated rows are
    judged one by one; an empty table or dictionary gives no finds; a column ``out`` is replaced, all others stay.
    """
    rows = df.drop(out)
    patterns, listed = _listed(products, vendors)
    own = own_name([*rows.columns, out], "p")
    found = automaton.with_candidates(rows, text, patterns, own, most_bytes)
    said, of = F.col(text), F.col(year)

    def named(i: Column) -> Column:
        e = F.get(listed, i)
        return F.rlike(said, e["p"]) & (e["y"].isNull() | of.isNull() | (of >= e["y"])) & (e["c"].isNull() | F.rlike(said, e["c"]))

    first = F.get(listed, F.get(F.filter(own, named), F.lit(0)))
    none = F.lit(None).cast("string")
    result = F.struct(first["n"].alias("product"), first["v"].alias("vendor"), F.coalesce(first["g"], F.lit("CATEGORY_ONLY")).alias("granularity"))
    if internal:
        name = F.trim(F.regexp_extract(said, r"(?i)(?:called|named|dubbed)\s+[\"']?([A-Za-z][A-Za-z0-9\s]{2,20})[\"']?", 1))
        solution = F.struct(F.nullif(name, F.lit("")).alias("product"), F.lit("Internal").alias("vendor"), F.lit("INTERNAL").alias("granularity"))
        result = F.when(said.rlike(f"(?i){internal}"), solution).otherwise(result)
    nothing = F.struct(none.alias("product"), none.alias("vendor"), F.lit("CATEGORY_ONLY").alias("granularity"))
    return found.withColumn(out, F.when(said.isNotNull(), result).otherwise(nothing)).drop(own)


def exclusions(df: DataFrame, text: str, year: str, products: list[Product], most_bytes: int = automaton.MOST_BYTES) -> DataFrame:
    """Mentions of products before their release: report_year, vendor, product, release_year. Candidates are found as in :func:`with_products`."""
    dated = [p for p in products if p.release_year]
    patterns, listed = _listed(dated, [])
    own = own_name(df.columns, "p")
    found = automaton.with_candidates(df, text, patterns, own, most_bytes)
    early = F.filter(own, lambda i: (F.get(listed, i)["y"] > F.col(year)) & F.rlike(F.col(text), F.get(listed, i)["p"]))
    one = found.select(F.col(year).alias("report_year"), F.explode(F.transform(early, lambda i: F.get(listed, i))).alias("e"))
    return one.select("report_year", F.col("e.n").alias("product"), F.col("e.v").alias("vendor"), F.col("e.y").alias("release_year"))


def exclusion_report(ex: DataFrame) -> DataFrame:
    """Counts by product, year and vendor in one pass."""
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in (("product", "product"), ("year", "report_year"), ("vendor", "vendor"))]))
    return ex.select(kinds.alias("k")).groupBy("k.kind", "k.value").agg(F.count("*").alias("n"))


def search(products: DataFrame, query: str) -> DataFrame:
    """Products whose name, or else an alias, holds ``query``; match_type says which."""
    q = query.lower()
    name = F.contains(F.lower("product"), F.lit(q))
    alias = F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(q)))
    return products.withColumn("match_type", F.when(name, "name").when(alias, "alias")).where("match_type is not null")


def statistics(products: DataFrame) -> DataFrame:
    return products.groupBy("category").agg(F.count("*").alias("products"), F.count_distinct("vendor").alias("vendors"))


def with_facts(mentions: DataFrame, products: DataFrame, product: str = "product") -> DataFrame:
    """Left join with the dictionary's vendor, category and release year; of entries with one name the first."""
    one = products.groupBy(F.col("product").alias("__p")).agg(*[F.min_by(c, "ord").alias(f"known_{c}") for c in ("vendor", "category", "release_year")])
    return mentions.join(one, F.col(product) == F.col("__p"), "left").drop("__p")


def tracked_unit(found: Column, defaults: dict[str, str], own: str = "Proprietary") -> Column:
    """What diffusion follows: the product; one label for own solutions; for a vendor alone its default product, else its name and ``AI``."""
    vendor = found["vendor"]
    default = F.concat(vendor, F.lit(" AI"))
    for v, p in defaults.items():
        default = F.when(vendor == v, p).otherwise(default)
    return F.when(found["granularity"] == "SPECIFIC", found["product"]).when(found["granularity"] == "INTERNAL", own).when(found["granularity"] == "VENDOR_ONLY", default)
