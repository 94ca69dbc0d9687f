"""Stand-ins: the domain's frames, made of the tables of a folder, in Spark and as SQL.

references: one for each order line. company is the customer, category_a the brand, category_b the type,
product the part's name, vendor the supplier, industry the market segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import lineage, memory, trajectory

LAST_YEARS_SQL = "years AS (SELECT DISTINCT year FROM refs)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_references(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """``columns`` of the references, computed once for all branches that read them."""
    return lineage.kept(references(spark, sf_dir).select(*columns))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o, p, c = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "customer"))
    sentiment = F.when(F.col("l_returnflag") == "A", "positive").when(F.col("l_returnflag") == "R", "negative").when(F.col("l_linestatus") == "O", "pending").otherwise("neutral")
    strength = F.when(F.col("o_orderpriority") == "1-URGENT", "strong").when(F.col("o_orderpriority") == "2-HIGH", "medium").otherwise("mention_only")
    joined = li.join(o, li.l_orderkey == o.o_orderkey).join(p, li.l_partkey == p.p_partkey).join(c, o.o_custkey == c.c_custkey)
    return joined.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref_id"),
        F.col("o_custkey").alias("company"),
        F.year("o_orderdate").alias("year"),
        F.col("p_brand").alias("category_a"),
        F.col("p_type").alias("category_b"),
        F.col("p_name").alias("product"),
        F.col("l_suppkey").cast("string").alias("vendor"),
        F.col("c_mktsegment").alias("industry"),
        sentiment.alias("sentiment"),
        F.col("l_discount").alias("sentiment_score"),
        (F.col("l_tax") * 10).alias("semantic_score"),
        strength.alias("strength"),
        F.concat_ws(" ", "o_orderpriority", "p_name").alias("text"),
        F.col("p_size").alias("pages"),
    )


def product_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dictionary of products made of parts, in the form of ``products.dictionary``: brands are vendors, types categories, the halves of a name aliases."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("ord"), F.col("p_name").alias("product"), F.col("p_brand").alias("vendor"), F.col("p_type").alias("category"), (F.col("p_size") % 9 + 1990).cast("int").alias("release_year"), F.split("p_brand", "#").alias("aliases"), "p_size")


REFS_SQL = """refs AS (
  SELECT l_orderkey * 10 + l_linenumber AS ref_id, o_custkey AS company, CAST(year(o_orderdate) AS INTEGER) AS year,
    p_brand AS category_a, p_type AS category_b, p_name AS product, CAST(l_suppkey AS VARCHAR) AS vendor, c_mktsegment AS industry,
    CASE WHEN l_returnflag = 'A' THEN 'positive' WHEN l_returnflag = 'R' THEN 'negative' WHEN l_linestatus = 'O' THEN 'pending' ELSE 'neutral' END AS sentiment,
    l_discount AS sentiment_score, l_tax * 10 AS semantic_score,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'strong' WHEN '2-HIGH' THEN 'medium' ELSE 'mention_only' END AS strength,
    o_orderpriority || ' ' || p_name AS text, p_size AS pages
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
)"""


def years(refs: DataFrame) -> DataFrame:
    return refs.select("year").distinct()


def units_and_years(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The spans of the references, which are as many as references and so not stored, and their years, which are."""
    refs = references(spark, sf_dir).select("company", "year", "category_a", "category_b", "product", F.lit(None).cast("string").alias("text"))
    # Dealt by company before a reference becomes several rows: what follows goes by company and is not shuffled again.
    return trajectory.spans(refs.repartition("company")), lineage.kept(years(refs))


def portfolio_a(refs: DataFrame) -> DataFrame:
    return memory.portfolio(refs, ["category_a"], years(refs), "category_b")


PORTFOLIO_A_SQL = """pa AS (
  SELECT *, (SELECT min(y.year) FROM years y WHERE y.year >= p.last_confirmed_year + 2) AS discontinued_year
  FROM (SELECT company, category_a, min(year) AS first_seen_year, max(year) AS last_confirmed_year, list_sort(list(DISTINCT category_b)) AS linked FROM refs GROUP BY ALL) p
)"""


def portfolio_b(refs: DataFrame) -> DataFrame:
    p = memory.portfolio(refs, ["category_b", "product"], years(refs)).withColumn("vendor", F.lit(""))
    return p.withColumn("granularity", memory.granularity(F.col("product"), F.col("vendor")))


PORTFOLIO_B_SQL = """pb AS (
  SELECT *, CASE WHEN discontinued_year IS NULL THEN 'ACTIVE' ELSE 'DISCONTINUED' END AS status, '' AS vendor, 'SPECIFIC' AS granularity FROM (
    SELECT *, (SELECT min(y.year) FROM years y WHERE y.year >= p.last_confirmed_year + 2) AS discontinued_year
    FROM (SELECT company, category_b, product, min(year) AS first_seen_year, max(year) AS last_confirmed_year FROM refs GROUP BY ALL) p)
)"""


def adoption_events(refs: DataFrame) -> DataFrame:
    """company, year, dimension, category, product, vendor, event_type: new and confirmed units, and ended ones."""
    y = lineage.kept(years(refs))
    a = memory.events(refs, ["category_a"]).select("company", "year", F.lit("A").alias("dimension"), F.col("category_a").alias("category"), F.lit("").alias("product"), F.lit("").alias("vendor"), "event_type")
    b = memory.events(refs, ["category_b", "product"]).select("company", "year", F.lit("B").alias("dimension"), F.col("category_b").alias("category"), "product", F.lit("").alias("vendor"), "event_type")
    end = lambda unit, d: memory.discontinued(refs, unit, y).select("company", F.col("discontinued_year").alias("year"), F.lit(d).alias("dimension"), F.col(unit[0]).alias("category"), (F.col(unit[1]) if len(unit) > 1 else F.lit("")).alias("product"), F.lit("").alias("vendor"), F.lit("DISCONTINUED").alias("event_type"))
    return a.unionByName(b).unionByName(end(["category_a"], "A")).unionByName(end(["category_b", "product"], "B"))


EVENTS_SQL = """ev AS (
  SELECT company, year, 'A' AS dimension, category_a AS category, '' AS product,
    CASE WHEN year > min(year) OVER (PARTITION BY company, category_a) THEN 'CONFIRMED' ELSE 'NEW_ADOPTION' END AS event_type
  FROM (SELECT DISTINCT company, category_a, year FROM refs)
  UNION ALL
  SELECT company, year, 'B', category_b, product, CASE WHEN year > min(year) OVER (PARTITION BY company, category_b, product) THEN 'CONFIRMED' ELSE 'NEW_ADOPTION' END
  FROM (SELECT DISTINCT company, category_b, product, year FROM refs)
  UNION ALL SELECT company, discontinued_year, 'A', category_a, '', 'DISCONTINUED' FROM pa WHERE discontinued_year IS NOT NULL
  UNION ALL SELECT company, discontinued_year, 'B', category_b, product, 'DISCONTINUED' FROM pb WHERE discontinued_year IS NOT NULL
)"""


def windows_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fathomline.operators import windows

    return windows.useful_windows(windows.char_windows(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))).drop("text")


WINDOWS_SQL = """w AS (
  SELECT doc_id, source, CAST(o AS INTEGER) AS "offset", substring(text, o + 1, 500) AS "window"
  FROM (SELECT doc_id, source, text, unnest(range(0, length(text), 400)) AS o FROM documents WHERE length(text) >= 20)
  WHERE length(trim(substring(text, o + 1, 500), ' ')) >= 30
)"""
