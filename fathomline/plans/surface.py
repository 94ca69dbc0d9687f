"""Queries over joins, stores, charts, evaluation, products, translation, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import text as tx
from fathomline.operators import charts, evaluate, products, relational, store, translate
from fathomline.plans import standins as st
from fathomline.plans.standins import REFS_SQL, references, table
from fathomline.sources import readers, writers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
KINDS = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Joins ---------------------------------------------------------------------------------------------------

COMPANIES_SQL = "d AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'nation_' || (c_nationkey) WHEN c_custkey % 3 = 1 THEN 'NATION_' || (c_nationkey // 2) || ' Holding' ELSE 'Nobody ' || c_custkey END AS company FROM customer)"


@query(
    f"""WITH {COMPANIES_SQL}, m AS (SELECT lower(n_name) AS k, n_name AS name, n_nationkey AS position FROM nation),
e AS (SELECT d.*, m.name, m.position FROM d LEFT JOIN m ON lower(trim(d.company)) = m.k),
p AS (SELECT id, company, (SELECT arg_min(name, position) FROM m WHERE starts_with(k, split_part(lower(trim(company)), ' ', 1))) AS name, (SELECT min(position) FROM m WHERE starts_with(k, split_part(lower(trim(company)), ' ', 1))) AS position FROM e WHERE position IS NULL)
SELECT id, company, name, position, 'exact' AS match FROM e WHERE position IS NOT NULL UNION ALL SELECT id, company, name, position, CASE WHEN position IS NULL THEN 'none' ELSE 'prefix' END FROM p"""
)
def join_metadata(spark, sf):
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("nation_"), "c_nationkey")).when(k % 3 == 1, F.concat(F.lit("NATION_"), F.floor(F.col("c_nationkey") / 2).cast("string"), F.lit(" Holding"))).otherwise(F.concat(F.lit("Nobody "), k.cast("string")))
    meta = table(spark, sf, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("position"))
    return relational.with_metadata(c.select(k.alias("id"), name.alias("company")), meta)


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND n_chars BETWEEN 500 AND 5000")
def join_anti_resume(spark, sf):
    d = table(spark, sf, "documents").where(F.col("n_chars").between(500, 5000)).select("doc_id", "lang")
    return relational.unprocessed(d, table(spark, sf, "labels"), "doc_id")


@query(
    "WITH t AS (SELECT DISTINCT quality AS target FROM labels), p AS (SELECT doc_id, quality AS target FROM labels UNION ALL SELECT doc_id, 1 - quality FROM labels WHERE toxic = 1) SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM t WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id AND p.target = t.target))"
)
def join_missing_in_any(spark, sf):
    lb = table(spark, sf, "labels")
    done = lb.select("doc_id", F.col("quality").alias("target")).union(lb.where("toxic = 1").select("doc_id", (1 - F.col("quality")).alias("target")))
    return relational.missing_in_any(table(spark, sf, "documents").select("doc_id"), lb.select(F.col("quality").alias("target")), done, "doc_id")


@query(
    "WITH s AS (SELECT user_id, event_type, arg_max(props, event_id) AS props FROM events GROUP BY ALL), t AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 2 = 0 THEN props END AS props FROM events) SELECT event_id, coalesce(t.props, s.props) AS props FROM t LEFT JOIN s USING (user_id, event_type)"
)
def join_latest_backfill(spark, sf):
    e = table(spark, sf, "events")
    t = e.select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 2 == 0, F.col("props")).alias("props"))
    return relational.backfilled(t, e, ["user_id", "event_type"], "event_id", "props").select("event_id", "props")


@query(
    "WITH l AS (SELECT nullif(p_brand, 'Brand#1') AS b, nullif(p_type, 'PROMO') AS t, min(p_partkey) AS first FROM part GROUP BY ALL) SELECT p_partkey, first FROM part p LEFT JOIN l ON nullif(p.p_brand, 'Brand#1') IS NOT DISTINCT FROM l.b AND nullif(p.p_type, 'PROMO') IS NOT DISTINCT FROM l.t"
)
def join_nullsafe(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.nullif("p_brand", F.lit("Brand#1")).alias("b"), F.nullif("p_type", F.lit("PROMO")).alias("t"))
    return relational.null_safe_lookup(p, p.withColumn("first", F.col("p_partkey")), ["b", "t"], "first", "p_partkey").select("p_partkey", "first")


PATTERNS = ["(?i)license", "!!", "[A-Z]{8,}", "ing[ .]"]


@query("SELECT doc_id, p AS pattern FROM documents, (VALUES " + ", ".join(f"('{p}')" for p in PATTERNS) + ") v(p) WHERE regexp_matches(text, p)")
def join_patterns(spark, sf):
    return relational.pattern_hits(table(spark, sf, "documents").select("doc_id", "text"), PATTERNS).select("doc_id", "pattern")


@query("WITH c AS (SELECT DISTINCT md5(text) AS h FROM documents WHERE doc_id % 2 = 0) SELECT count(DISTINCT md5(text)) AS misses, (SELECT count(*) FROM documents WHERE md5(text) IN (SELECT h FROM c)) AS hits FROM documents WHERE md5(text) NOT IN (SELECT h FROM c)")
def join_cache(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    cache = d.where("doc_id % 2 = 0").select(F.md5("text").alias("text_hash"), F.lit(1).alias("value")).dropDuplicates(["text_hash"])
    misses = store.cache_misses(d, cache).agg(F.count("*").alias("misses"))
    return misses.crossJoin(store.with_cache(d, cache).agg(F.count("value").alias("hits")))


# Stores --------------------------------------------------------------------------------------------------


@query(
    """SELECT user_id, event_type, count(*) AS occurrence_count, arg_max(value, event_id) AS sentiment_score, arg_max(value, event_id) AS semantic_score, arg_min(props, event_id) AS sentiment,
  arg_max(CASE WHEN event_id % 3 = 0 THEN props END, CASE WHEN event_id % 3 = 0 THEN event_id END) AS strength, max(value) AS confidence, max(value + 1) AS confidence_a, max(value + 2) AS confidence_b,
  arg_max(CASE WHEN value > 20 THEN props ELSE '' END, CASE WHEN value > 20 THEN event_id END) AS reasons, arg_max(props, event_id) AS dimensions,
  arg_min(CASE WHEN value > 10 THEN props ELSE '' END, CASE WHEN value > 10 THEN event_id END) AS category_a, arg_min(event_type, event_id) AS category_b FROM events GROUP BY user_id, event_type"""
)
def store_upsert_merge(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_type", "event_id", F.col("value").alias("sentiment_score"), F.col("value").alias("semantic_score"), F.col("props").alias("sentiment"), F.when(F.col("event_id") % 3 == 0, F.col("props")).alias("strength"), F.col("value").alias("confidence"), (F.col("value") + 1).alias("confidence_a"), (F.col("value") + 2).alias("confidence_b"), F.when(F.col("value") > 20, F.col("props")).otherwise("").alias("reasons"), F.col("props").alias("dimensions"), F.when(F.col("value") > 10, F.col("props")).otherwise("").alias("category_a"), F.col("event_type").alias("category_b"))
    return store.merged_references(e, ["user_id", "event_type"], "event_id")


@query("SELECT user_id, arg_min(event_type, event_id) AS event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props, max(event_id) AS event_id FROM events GROUP BY user_id")
def store_last_wins(spark, sf):
    return store.last_wins(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value", "props"), ["user_id"], "event_id", ("event_type",))


@query("SELECT source, count(*) AS process_count, arg_max(lang, doc_id) AS text_status, arg_max(CASE WHEN n_chars > 3000 THEN md5(text) END, CASE WHEN n_chars > 3000 THEN doc_id END) AS file_hash FROM documents GROUP BY source")
def store_document_state(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.col("lang").alias("text_status"), F.when(F.col("n_chars") > 3000, F.md5("text")).alias("file_hash"))
    return store.document_states(d, "doc_id")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def store_scan(spark, sf):
    return store.scan(table(spark, sf, "orders"), o_orderpriority="1-URGENT", o_orderstatus=None).select("o_orderkey", "o_custkey")


@query("SELECT coalesce(lang, 'unknown') AS status, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(n_chars), 3) AS avg_chars, max(n_chars) AS most, count(DISTINCT source) AS sources, count(*) FILTER (n_chars < 200) AS short FROM documents GROUP BY 1")
def stats_status(spark, sf):
    d = table(spark, sf, "documents").groupBy(F.coalesce("lang", F.lit("unknown")).alias("status"))
    return d.agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 3).alias("avg_chars"), F.max("n_chars").alias("most"), F.count_distinct("source").alias("sources"), F.count_if(F.col("n_chars") < 200).alias("short"))


@query("SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract(props, '$.k') AS INTEGER)) AS BIGINT) AS k, count(*) FILTER (json_extract(props, '$.k') IS NULL) AS bad FROM events GROUP BY event_type")
def json_dims(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.from_json("props", "k int")["k"])
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("k"), F.count_if(F.col("k").isNull()).alias("bad"))


@query(
    f"""WITH {REFS_SQL} SELECT company, year, text, sentiment, strength, category_a AS A, 0.5::DOUBLE AS "A Confidence", CASE WHEN pages > 25 THEN category_b END AS B, CASE WHEN pages > 25 THEN 0.25::DOUBLE END AS "B Confidence", CAST(pages AS VARCHAR) AS pages_identified, 0 AS occurrences, industry, product AS context FROM refs"""
)
def export_sheet(spark, sf):
    return _sheet(references(spark, sf))


def _sheet(r):
    dims = writers.dimension_json([("A", F.col("category_a"), F.lit(0.5)), ("B", F.when(F.col("pages") > 25, F.col("category_b")), F.lit(0.25))])
    return writers.reference_sheet(r.select("company", "year", "industry", "sentiment", "strength", "text", F.col("product").alias("context"), F.col("pages").alias("page"), dims.alias("dimensions")), ["A", "B"])


# Charts --------------------------------------------------------------------------------------------------

YEARS = list(range(1995, 2002))


@query(
    f"""WITH y AS (SELECT o_custkey AS company, CAST(year(o_orderdate) AS INTEGER) AS year, round(avg(o_totalprice), 2) AS v FROM orders GROUP BY ALL), t AS (SELECT company FROM (SELECT company, round(avg(v), 6) AS m FROM y GROUP BY company) ORDER BY m DESC, company LIMIT 10)
SELECT company, {", ".join(f'coalesce(max(v) FILTER (year = {y}), 0) AS "{y}"' for y in YEARS)} FROM y WHERE company IN (SELECT company FROM t) GROUP BY company"""
)
def viz_top10_pivot(spark, sf):
    y = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year")).agg(F.round(F.avg("o_totalprice"), 2).alias("v"))
    return charts.top_pivot(y, "company", "year", "v", YEARS, 10)


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"""SELECT p_brand, {", ".join(f"count(*) FILTER (p_type = '{t}') AS {t}" for t in TYPES)} FROM part GROUP BY p_brand""")
def viz_cooccurrence(spark, sf):
    return charts.cooccurrence(table(spark, sf, "part"), "p_brand", "p_type", TYPES)


@query(f"WITH {REFS_SQL} SELECT sentiment, year, count(*) AS n FROM refs GROUP BY ALL")
def viz_sentiment_year(spark, sf):
    return charts.counts(references(spark, sf), ["sentiment", "year"])


@query("SELECT coalesce(lang, 'en') AS lang, source, count(*) AS n FROM documents GROUP BY ALL")
def viz_language(spark, sf):
    return charts.counts(table(spark, sf, "documents"), ["lang", "source"], lang="en")


@query("SELECT i AS ord, t AS p_type, (SELECT count(*) FROM part WHERE p_type = t) AS n FROM (VALUES (0, 'PROMO'), (1, 'NONE'), (2, 'LARGE')) v(i, t)")
def viz_known_codes(spark, sf):
    return charts.counts_of_known(table(spark, sf, "part"), "p_type", ["PROMO", "NONE", "LARGE"])


@query("SELECT event_type, min(value) AS lowest, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS highest FROM events GROUP BY event_type")
def viz_quartiles(spark, sf):
    return charts.quartiles(table(spark, sf, "events"), "event_type", "value")


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "WITH m AS (SELECT o_custkey, " + ", ".join(f"CAST(count(*) FILTER (o_orderpriority = '{p}') > 0 AS BIGINT) AS \"{p}\"" for p in PRIORITIES) + " FROM orders GROUP BY o_custkey) SELECT * FROM m UNION ALL SELECT NULL, " + ", ".join(f'CAST(sum("{p}") AS BIGINT)' for p in PRIORITIES) + " FROM m"
)
def viz_coverage(spark, sf):
    return charts.coverage(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", PRIORITIES)


@query(
    "WITH y AS (SELECT c_mktsegment, CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL), p AS (SELECT c_mktsegment, " + ", ".join(f'coalesce(max(n) FILTER (year = {y}), 0) AS "{y}"' for y in YEARS) + " FROM y GROUP BY 1) SELECT * FROM p ORDER BY greatest(" + ", ".join(f'"{y}"' for y in YEARS) + ") DESC, c_mktsegment LIMIT 3"
)
def viz_row_max(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    y = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_mktsegment", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"))
    return charts.row_max_pivot(y, "c_mktsegment", "year", "n", YEARS, 3)


@query("SELECT p_partkey, CASE WHEN length(p_name || ' of ' || p_brand) > 22 THEN substring(p_name || ' of ' || p_brand, 1, 22) || '…' ELSE p_name || ' of ' || p_brand END AS short, substring(p_brand, 1, 2) AS code FROM part")
def viz_names(spark, sf):
    n = F.concat_ws(" of ", "p_name", "p_brand")
    return table(spark, sf, "part").select("p_partkey", tx.short_name(n).alias("short"), tx.category_code(F.col("p_brand")).alias("code"))


# Evaluation ----------------------------------------------------------------------------------------------

GOLD_SQL = "g AS (SELECT doc_id, 1 - quality AS label, CASE WHEN regexp_matches(text, '(!!|[#$%&]{2,})') THEN 1 ELSE 0 END AS predicted, source, lang, n_chars / 10000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"
_R = lambda a, b: f"CASE WHEN {b} > 0 THEN round(({a}) / ({b}), 6) ELSE 0 END"
CONFUSION_SQL = f"""SELECT *, {_R("tp", "tp + fp")} AS precision, {_R("tp", "tp + fn")} AS recall, {_R("2 * tp", "2 * tp + fp + fn")} AS f1, {_R("tp + tn", "tp + tn + fp + fn")} AS accuracy, {_R("fn", "tp + fn")} AS escape_rate FROM c"""


def _counts_sql(p: str) -> str:
    return f"count(*) FILTER (label = 1 AND {p}) AS tp, count(*) FILTER (label = 1 AND NOT {p}) AS fn, count(*) FILTER (label = 0 AND {p}) AS fp, count(*) FILTER (label = 0 AND NOT {p}) AS tn"


def _gold(spark, sf):
    g = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    return g.select("doc_id", (1 - F.col("quality")).alias("label"), F.col("text").rlike("(!!|[#$%&]{2,})").cast("int").alias("predicted"), "source", "lang", (F.col("n_chars") / 10000).alias("score"))


@query(f"WITH {GOLD_SQL}, c AS (SELECT {_counts_sql('predicted = 1')} FROM g) {CONFUSION_SQL}")
def eval_confusion(spark, sf):
    return evaluate.confusion(_gold(spark, sf), "label", "predicted")


@query(f"WITH {GOLD_SQL}, c AS (SELECT lang AS reason, count(*) AS total, count(*) FILTER (predicted = 1) AS caught FROM g WHERE label = 1 GROUP BY lang) SELECT *, total - caught AS missed, {_R('caught', 'total')} AS recall FROM c")
def eval_by_reason(spark, sf):
    return evaluate.by_reason(_gold(spark, sf), "label", "predicted", "lang")


@query(f"WITH {GOLD_SQL}, c AS (SELECT threshold, {_counts_sql('(score < threshold OR predicted = 1)')} FROM g, (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE)) t(threshold) GROUP BY threshold) {CONFUSION_SQL}")
def eval_threshold_sweep(spark, sf):
    return evaluate.sweep(_gold(spark, sf), "label", "score", [0.05, 0.1, 0.2], "predicted")


@query(
    f"""WITH {GOLD_SQL}, n AS (SELECT source, count(*) AS n FROM g GROUP BY source), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY md5(concat_ws('|', CAST(doc_id AS VARCHAR), '42'))) AS r FROM g)
SELECT doc_id, source FROM r JOIN n USING (source) WHERE r <= greatest(1, round(100 * n / (SELECT sum(n) FROM n)))"""
)
def eval_sample(spark, sf):
    return evaluate.stratified(_gold(spark, sf), "source", "doc_id", 100, 42).select("doc_id", "source")


@query(f"WITH {GOLD_SQL} SELECT doc_id, lang FROM g WHERE label = 1 AND predicted = 0 ORDER BY lang, doc_id LIMIT 50")
def eval_misses(spark, sf):
    return evaluate.worst(_gold(spark, sf), 1, 0, 50, ["lang", "doc_id"]).select("doc_id", "lang")


@query(
    """WITH x AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'Positive' WHEN 'view' THEN 'Negative' WHEN 'error' THEN '??' ELSE '' END AS a, CASE event_id % 4 WHEN 0 THEN 'Negative' WHEN 1 THEN 'Positive' ELSE '' END AS b FROM events)
SELECT event_id, CASE WHEN a = '' AND b = '' THEN CAST(event_id % 7 = 0 AS INTEGER) WHEN a = 'Positive' OR b = 'Positive' THEN 0 ELSE 1 END AS label FROM x WHERE (a = '' AND b = '') OR (a <> '' AND b <> '' AND a <> '??')"""
)
def eval_gold_labels(spark, sf):
    k = F.col("event_id")
    a = F.when(F.col("event_type") == "click", "Positive").when(F.col("event_type") == "view", "Negative").when(F.col("event_type") == "error", "??").otherwise("")
    e = table(spark, sf, "events").select("event_id", a.alias("a"), F.when(k % 4 == 0, "Negative").when(k % 4 == 1, "Positive").otherwise("").alias("b"), (k % 7 == 0).cast("string").alias("f"))
    return evaluate.gold_labels(e, "a", "b", "f").select("event_id", "label")


# Products and translation --------------------------------------------------------------------------------

PRODUCTS = [
    products.Product("Blue Ring", "Acme", "B4", (r"blue ring",), 1997),
    products.Product("Ring", "Ringco", "B4", (r"\bring\b",), None, "small"),
    products.Product("Bolt", "Acme", "B2", (), 1999, None, ("bolt",)),
]
VENDORS = [("Widget Works", r"widget"), ("Gearbox", r"gear")]


@query(
    f"""WITH {REFS_SQL}, x AS (SELECT ref_id, CASE WHEN regexp_matches(product, '(?i)green') THEN 'Internal|INTERNAL|' WHEN regexp_matches(product, '(?i)blue ring') AND year >= 1997 THEN 'Acme|SPECIFIC|Blue Ring'
  WHEN regexp_matches(product, '(?i)\\bring\\b') AND regexp_matches(product, '(?i)small') THEN 'Ringco|SPECIFIC|Ring' WHEN regexp_matches(product, '(?i)\\bbolt\\b') AND year >= 1999 THEN 'Acme|SPECIFIC|Bolt'
  WHEN regexp_matches(product, '(?i)widget') THEN 'Widget Works|VENDOR_ONLY|' WHEN regexp_matches(product, '(?i)gear') THEN 'Gearbox|VENDOR_ONLY|' ELSE '|CATEGORY_ONLY|' END AS k FROM refs)
SELECT split_part(k, '|', 1) AS vendor, split_part(k, '|', 2) AS granularity, split_part(k, '|', 3) AS product, count(*) AS n FROM x GROUP BY ALL"""
)
def prod_extract(spark, sf):
    r = products.with_products(references(spark, sf), "product", "year", PRODUCTS, VENDORS, "green", "x")
    e = F.lit("")
    return r.groupBy(F.coalesce("x.vendor", e).alias("vendor"), F.col("x.granularity").alias("granularity"), F.coalesce("x.product", e).alias("product")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {REFS_SQL}, x AS (SELECT year, 'Blue Ring' AS product, 'Acme' AS vendor FROM refs WHERE regexp_matches(product, '(?i)blue ring') AND year < 1997 UNION ALL SELECT year, 'Bolt', 'Acme' FROM refs WHERE regexp_matches(product, '(?i)\\bbolt\\b') AND year < 1999)
SELECT 'product' AS kind, product AS value, count(*) AS n FROM x GROUP BY 2 UNION ALL SELECT 'year', CAST(year AS VARCHAR), count(*) FROM x GROUP BY 2 UNION ALL SELECT 'vendor', vendor, count(*) FROM x GROUP BY 2"""
)
def prod_exclusions(spark, sf):
    return products.exclusion_report(products.exclusions(references(spark, sf), "product", "year", PRODUCTS))


@query("SELECT p_partkey AS ord, p_name AS product, CASE WHEN contains(lower(p_name), 'd') THEN 'name' ELSE 'alias' END AS match_type FROM part WHERE contains(lower(p_name), 'd') OR contains(lower(p_brand), 'd')")
def prod_search(spark, sf):
    return products.search(st.product_dictionary(spark, sf), "D").select("ord", "product", "match_type")


@query("SELECT p_type AS category, count(*) AS products, count(DISTINCT p_brand) AS vendors FROM part GROUP BY 1")
def prod_stats(spark, sf):
    return products.statistics(st.product_dictionary(spark, sf))


@query("SELECT lang, count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS translated, count(*) FILTER (doc_id % 3 <> 0) AS pending FROM documents WHERE lang <> 'en' GROUP BY lang")
def tr_coverage(spark, sf):
    d = table(spark, sf, "documents").withColumn("t", F.when(F.col("doc_id") % 3 == 0, F.lit("x")))
    return translate.coverage(d, "lang", "t")


@query("SELECT doc_id, CASE WHEN coalesce(lang, 'en') = 'en' AND doc_id % 2 = 1 THEN md5(text) WHEN doc_id % 2 = 0 THEN md5('done') END AS h, coalesce(lang, 'en') <> 'en' AND doc_id % 2 = 1 AS needs FROM documents")
def tr_backfill(spark, sf):
    d = table(spark, sf, "documents").withColumn("t", F.when(F.col("doc_id") % 2 == 0, F.lit("done")))
    d = d.withColumn("needs", translate.needs_translation(F.col("lang"), F.col("text"), F.col("t")))
    return translate.with_english(d, "lang", "text", "t").select("doc_id", F.md5("t").alias("h"), "needs")


# Sources -------------------------------------------------------------------------------------------------

@query(
    """SELECT s_suppkey, s_name AS company, CAST(CASE WHEN s_suppkey % 7 = 0 THEN 0 ELSE 2015 + s_nationkey % 11 END AS INTEGER) AS year, CASE s_suppkey % 4 WHEN 1 THEN 'Sustainability' WHEN 2 THEN 'Proxy' ELSE 'Annual Report' END AS doc_type,
  CAST(CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE s_suppkey % 1000 END AS INTEGER) AS position FROM supplier"""
)
def src_filename_meta(spark, sf):
    """Names of files made of suppliers: some without a place, some without a year."""
    k = F.col("s_suppkey")
    kind = F.when(k % 4 == 0, "annual report").when(k % 4 == 1, "sustainability report").when(k % 4 == 2, "proxy").otherwise("report")
    year = F.when(k % 7 == 0, "n.d.").otherwise((F.col("s_nationkey") % 11 + 2015).cast("string"))
    name = F.concat(F.when(k % 5 == 0, "").otherwise(F.concat((k % 1000).cast("string"), F.lit(". "))), "s_name", F.lit(" - "), year, F.lit(" - "), kind, F.lit(".pdf"))
    f = table(spark, sf, "supplier").select("s_suppkey", name.alias("name"))
    return f.select("s_suppkey", *[c.alias(n) for n, c in readers.file_facts(F.col("name")).items()])


@query("SELECT lower(s_name) AS key, s_name AS name, CAST(s_suppkey AS INTEGER) AS position, CAST(s_nationkey AS VARCHAR) AS industry, CAST(NULL AS VARCHAR) AS sector, 'x' AS country FROM supplier")
def src_company_list(spark, sf):
    s = table(spark, sf, "supplier").select(F.concat(F.lit("#"), F.col("s_suppkey").cast("string")).alias("RANK"), F.col("s_name").alias("NAME"), F.col("s_nationkey").cast("string").alias("Industry"), F.lit(" x ").alias("Country"))
    return readers.company_metadata(s).withColumn("sector", F.col("sector").cast("string"))


# Counts --------------------------------------------------------------------------------------------------


@query(
    f"WITH {REFS_SQL} SELECT count(*) AS refs, count(DISTINCT company) AS companies, count(DISTINCT year) AS years, min(year) AS first_year, max(year) AS last_year FROM refs"
)
def stats_session(spark, sf):
    from fathomline.operators import stats

    return stats.session(references(spark, sf))


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n, round(avg(o_totalprice) + 1e-9, 3) AS mean, round(max(o_totalprice) + 1e-9, 3) AS most FROM orders GROUP BY 1")
def stats_year(spark, sf):
    from fathomline.operators import stats

    return stats.by_year(table(spark, sf, "orders").withColumn("year", F.year("o_orderdate")), "o_totalprice")


@query(
    """WITH t AS (SELECT count(*) AS docs, CAST(sum(n_chars // 100) AS BIGINT) AS pages, CAST(sum(n_chars) AS BIGINT) AS words, CAST(sum(doc_id % 5) AS BIGINT) AS refs, CAST(sum(doc_id % 3) AS BIGINT) AS refs_kept FROM documents)
SELECT *, round(pages / docs + 1e-9, 2) AS pages_per_doc, words // docs AS words_per_doc, round(refs / docs + 1e-9, 2) AS refs_per_doc, round(1000 * refs / words + 1e-9, 4) AS refs_per_1000_words, round(100 * (refs - refs_kept) / refs + 1e-9, 2) AS dedup_percent FROM t"""
)
def stats_run(spark, sf):
    from fathomline.operators import stats

    n, k = F.col("n_chars"), F.col("doc_id")
    return stats.run_ratios(table(spark, sf, "documents").select(F.floor(n / 100).alias("pages"), n.alias("words"), (k % 5).alias("refs"), (k % 3).alias("refs_kept")))


@query(
    f"WITH {REFS_SQL}, m AS (SELECT *, CASE WHEN ref_id % 3 = 0 THEN 'semantic' ELSE 'pattern_hard' END AS method FROM refs) SELECT company, count(*) AS total, count(*) FILTER (method LIKE 'pattern%') AS by_pattern, count(*) FILTER (method = 'semantic') AS by_semantic, count(DISTINCT category_a) AS categories, "
    + ", ".join(f"count(*) FILTER (sentiment = '{x}') AS n_{x}" for x in ("positive", "neutral", "negative", "pending"))
    + " FROM m GROUP BY company"
)
def stats_counters(spark, sf):
    from fathomline.operators import stats

    r = references(spark, sf).withColumn("method", F.when(F.col("ref_id") % 3 == 0, "semantic").otherwise("pattern_hard"))
    return stats.document_counters(r, "company", category="category_a")


@query(
    f"""WITH {REFS_SQL}, u AS (SELECT CASE WHEN regexp_matches(product, '(?i)green') THEN 'Proprietary' WHEN regexp_matches(product, '(?i)blue ring') AND year >= 1997 THEN 'Blue Ring' WHEN regexp_matches(product, '(?i)\\bring\\b') AND regexp_matches(product, '(?i)small') THEN 'Ring'
  WHEN regexp_matches(product, '(?i)\\bbolt\\b') AND year >= 1999 THEN 'Bolt' WHEN regexp_matches(product, '(?i)widget') THEN 'Widget Works AI' WHEN regexp_matches(product, '(?i)gear') THEN 'Gear One' END AS unit FROM refs)
SELECT unit, count(*) AS n, CASE unit WHEN 'Ring' THEN 'Ringco' WHEN 'Blue Ring' THEN 'Acme' WHEN 'Bolt' THEN 'Acme' END AS known_vendor FROM u WHERE unit IS NOT NULL GROUP BY unit"""
)
def prod_units(spark, sf):
    r = products.with_products(references(spark, sf), "product", "year", PRODUCTS, VENDORS, "green", "x")
    u = r.select(products.tracked_unit(F.col("x"), {"Gearbox": "Gear One"}).alias("unit")).where("unit is not null").groupBy("unit").agg(F.count("*").alias("n"))
    return products.with_facts(u, products.dictionary(spark, PRODUCTS), "unit").select("unit", "n", "known_vendor")
