"""Queries over texts: windows, triggers, rules, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from fathomline.functions import text as tx
from fathomline.operators import dedup, rules, windows
from fathomline.operators.taxonomy import COOCCUR, COOCCUR_VERB, NONE, SOFT, Code, Taxonomy, Weights
from fathomline.plans.standins import WINDOWS_SQL, table, windows_of_documents

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TERMS = ("license", "token", "the", "der", "los", "les")
HARD, SOFT_TERMS = tx.word_of("license"), r"(^|[^\p{L}\p{N}_])(the|der|los|les)([^\p{L}\p{N}_]|$)"
#: A small taxonomy that hits the synthetic texts; patterns are alike in Java and RE2.
SAMPLE = Taxonomy(
    "sample",
    (
        ("A", (Code("A1", "articles", (("the", 1), ("der", 2)), (tx.word_of("the"),)), Code("A2", "links", (("and", 1), ("und", 3)), (tx.word_of("of"), tx.word_of("de"))), Code("A3", "rare", (("license", 1), ("token", 3))))),
        ("B", (Code("B1", "endings", (("tion", 2), ("ung", 2))), Code("B2", "marks", (("!!", 1),), (r"[#$%&]{2,}",)))),
    ),
    weights=Weights(0.5, (0.4, 0.25, 0.1)),
)
FALSE_POSITIVES = (("shouting", (r"!!", r"[A-Z]{9,}")), ("symbols", (r"[#$%&]{2,}",)), ("licences", ("license", "copyright")), ("plain", (r"\bwas\b",)))


@query(
    f"""WITH {WINDOWS_SQL}, hits AS (
  SELECT source, count(*) FILTER (regexp_matches("window", '{HARD.replace("(^", "(?i)(^")}') OR regexp_matches("window", '(?i){SOFT_TERMS}')) AS hits FROM w GROUP BY source
), d AS (SELECT source, count(*) AS docs FROM documents GROUP BY source), v AS (
  SELECT source, hits, docs, round(tanh(hits / docs), 4) AS volume FROM hits JOIN d USING (source))
SELECT source, hits, docs, volume, CAST(row_number() OVER (ORDER BY volume DESC, source) AS INTEGER) AS rank FROM v"""
)
def flagship_volume_rank(spark, sf):
    w = rules.triggered(windows_of_documents(spark, sf), HARD, SOFT_TERMS)
    hits = w.groupBy("source").agg(F.count("*").alias("hits"))
    docs = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("docs"))
    v = hits.join(docs, "source").withColumn("volume", F.round(F.tanh(F.col("hits") / F.col("docs")), 4))
    from pyspark.sql.window import Window

    return v.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("volume"), "source")))  # a row for each source


@query(f'WITH {WINDOWS_SQL} SELECT doc_id, count(*) AS n, CAST(sum(length("window")) AS BIGINT) AS chars, CAST(max("offset") AS BIGINT) AS last FROM w GROUP BY doc_id')
def txt_char_windows(spark, sf):
    return windows_of_documents(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("window")).alias("chars"), F.max(F.col("offset").cast("long")).alias("last"))


@query(
    r"""SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(text, '[^\s\x0B]+')) AS BIGINT) AS n_words,
  CAST(len(list_filter(regexp_split_to_array(text, '[.!?]+'), lambda s: length(trim(s, ' ')) > 10)) AS BIGINT) AS n_sentences FROM documents"""
)
def txt_counts(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.length(c).cast("long").alias("n_chars"), tx.word_count(c).cast("long").alias("n_words"), tx.sentence_count(c).cast("long").alias("n_sentences"))


@query(
    r"""SELECT doc_id, CASE WHEN length(text) > 0 THEN round((length(text) - length(replace(text, ' ', ''))) / length(text), 6) END AS ratio,
  coalesce(length(text) >= 20 AND (length(text) - length(replace(text, ' ', ''))) / length(text) < 0.08, false) AS deficient FROM documents"""
)
def txt_space_deficient(spark, sf):
    c = F.col("text")
    return table(spark, sf, "documents").select("doc_id", F.round(tx.space_ratio(c), 6).alias("ratio"), tx.is_space_deficient(c).alias("deficient"))


@query(
    r"""SELECT page_id, CAST(len(regexp_extract_all(html, '[a-z]{3,}[A-Z][a-z]{3,}')) AS BIGINT) AS joined, regexp_replace(regexp_replace(html, '[ \t]{2,}', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g') <> html AS collapses FROM pages"""
)
def txt_joined_words(spark, sf):
    h = F.col("html")
    collapsed = F.regexp_replace(F.regexp_replace(h, "[ \\t]{2,}", " "), "\\n{3,}", "\n\n")
    return table(spark, sf, "pages").select("page_id", F.size(tx.joined_words(h)).cast("long").alias("joined"), (collapsed != h).alias("collapses"))


@query(
    """WITH s AS (SELECT source, lang, count(*) AS n FROM documents WHERE len(regexp_extract_all(text, '[\\x{4E00}-\\x{9FFF}]')) <= 0.05 * length(text) GROUP BY 1, 2)
SELECT source, arg_max(lang, (n, -ascii(lang))) AS lang, CAST(sum(n) AS BIGINT) AS docs FROM s GROUP BY source"""
)
def txt_language(spark, sf):
    d = table(spark, sf, "documents").where(tx.script_language(F.col("text")) == "en")
    n = d.groupBy("source", "lang").agg(F.count("*").alias("n"))
    return n.groupBy("source").agg(F.max_by("lang", F.struct("n", (-F.ascii("lang")).alias("a"))).alias("lang"), F.sum("n").alias("docs"))


@query(
    r"""SELECT page_id, CAST(length(trim(regexp_replace(html, '(?i)(?:^|\n)\s*\d+\s*(?:\n|$)|(?:^|\n)\s*(?:Page|Pagina)\s+\d+|(?:^|\n)\s*©\s*\d{4}|(?:^|\n)\s*All\s+rights\s+reserved|(?:www\.|https?://)\S+', ' ', 'g'), ' ')) AS BIGINT) AS n FROM pages"""
)
def txt_boilerplate_strip(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.length(tx.without_boilerplate(F.col("html"))).cast("long").alias("n"))


@query(
    """WITH m AS (SELECT doc_id, text, instr(lower(text), 'the') AS p FROM documents), k AS (
  SELECT doc_id, text, CASE WHEN p > 0 AND NOT contains(text, '>>>') THEN substring(text, 1, p - 1) || '>>>' || substring(text, p, 3) || '<<<' || substring(text, p + 3) ELSE text END AS t FROM m)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n, CAST(instr(t, '>>>') AS BIGINT) AS at, replace(replace(t, '>>>', ''), '<<<', '') = text AS back FROM k"""
)
def txt_marker_roundtrip(spark, sf):
    m = tx.marked(F.col("text"), F.lit("The"))
    return table(spark, sf, "documents").select("doc_id", F.length(m).cast("long").alias("n"), F.instr(m, ">>>").cast("long").alias("at"), (tx.unmarked(m) == F.col("text")).alias("back"))


@query(
    r"""WITH s AS (SELECT page_id, replace(replace(replace(replace(translate(html, '•●○▪–—“”‘’　', '------""'''' '), '→', '->'), '…', '...'), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(t, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{fffe}\x{ffff}\x{fffd}]', '', 'g'), ' {2,}', ' ', 'g') AS t FROM s)
SELECT page_id, md5(regexp_replace(CASE WHEN length(t) > 32000 THEN substring(t, 1, 32000) || '...' ELSE t END, '^\s+|\s+$', '', 'g')) AS digest FROM c"""
)
def txt_sanitise(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(tx.sanitised(F.col("html"))).alias("digest"))


@query(
    r"""SELECT doc_id, substring(sha256(concat_ws('|', source, '2024', lang, CAST(doc_id AS VARCHAR), substring(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'), ' '), 1, 200))), 1, 32) AS ref_hash,
  md5(concat_ws('|', source, '2024', lang, CAST(doc_id AS VARCHAR), substring(text, 1, 200))) AS ref_md5 FROM documents"""
)
def txt_ref_hash(spark, sf):
    args = (F.col("source"), F.lit(2024), F.col("lang"), F.col("doc_id"), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", tx.reference_hash(*args).alias("ref_hash"), tx.reference_md5(*args).alias("ref_md5"))


@query(
    f"""WITH {WINDOWS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source, md5(substring("window", 1, 200)) ORDER BY doc_id, "offset") AS r FROM w)
SELECT source, count(*) AS kept, CAST(sum(doc_id + "offset") AS BIGINT) AS places FROM r WHERE r = 1 GROUP BY source"""
)
def txt_dedup_first_window(spark, sf):
    w = windows.first_window_of_each(windows_of_documents(spark, sf), ["source"], ["doc_id", "offset"])
    return w.groupBy("source").agg(F.count("*").alias("kept"), F.sum(F.col("doc_id") + F.col("offset")).alias("places"))


@query(
    """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), g AS (
  SELECT doc_id, count(*) AS n_pages, round(avg(length(t)), 6) AS avg_chars, avg(length(t)) < 50 AS scanned, count(*) FILTER (length(t) >= 100) AS long_pages FROM p GROUP BY doc_id)
SELECT * FROM g"""
)
def txt_pages(spark, sf):
    p = windows.pages(table(spark, sf, "documents").select("doc_id", "text"))
    s = windows.scanned_documents(p, ["doc_id"]).withColumn("avg_chars", F.round("avg_chars", 6))
    n = windows.long_pages(p).groupBy("doc_id").agg(F.count("*").alias("long_pages"))
    return s.join(n, "doc_id", "left").na.fill(0, ["long_pages"])


MIRROR = ["eht", "dna", "noit", "gni"]


@query(
    f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), h AS (
  SELECT doc_id, t, {" + ".join(f"CAST(contains(t, '{m}') AS INTEGER)" for m in MIRROR)} AS h FROM p), a AS (SELECT *, sum(h) OVER (PARTITION BY doc_id) AS s FROM h)
SELECT doc_id, count(*) AS pages, count(*) FILTER (s >= 2 AND h >= 2) AS blanked FROM a WHERE t <> '' GROUP BY doc_id"""
)
def txt_mirrored(spark, sf):
    p = windows.pages(table(spark, sf, "documents").select("doc_id", "text")).where("page_text <> ''")
    return windows.blank_mirrored(p, MIRROR).groupBy("doc_id").agg(F.count("*").alias("pages"), F.count_if(F.col("page_text") == "").alias("blanked"))


@query(
    """SELECT conv_id, turn, CAST(length(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS BIGINT) AS n FROM conversations"""
)
def txt_neighbours(spark, sf):
    c = windows.neighbours(table(spark, sf, "conversations"), ["conv_id"], "turn", "text")
    return c.select("conv_id", "turn", F.length("context").cast("long").alias("n"))


@query(
    f"""WITH {WINDOWS_SQL}, g AS (SELECT source, CASE {" ".join("WHEN regexp_matches(lower(\"window\"), '(?i)" + "|".join(f"(?:{p})" for p in ps) + f"') THEN '{g}'" for g, ps in FALSE_POSITIVES if g != "plain")}
  WHEN NOT regexp_matches(lower("window"), '(?i)token') AND regexp_matches(lower("window"), '{tx.word_of("was")}') THEN 'plain' END AS fp FROM w)
SELECT source, coalesce(fp, 'none') AS fp, count(*) AS n FROM g GROUP BY ALL"""
)
def rule_fp_first_match(spark, sf):
    groups = (*FALSE_POSITIVES[:-1], ("plain", (tx.word_of("was"),)))
    fp = rules.first_false_positive(F.col("window"), groups, catch_all=(tx.word_of("was"),), subject="token")
    return windows_of_documents(spark, sf).groupBy("source", F.coalesce(fp, F.lit("none")).alias("fp")).agg(F.count("*").alias("n"))


ACTORS, VERBS, MARKERS = ("the", "der"), ("ing", "ung"), ("license", "!!", "los")


@query(
    f"""WITH {WINDOWS_SQL}, f AS (
  SELECT *, {" OR ".join(f"contains(lower(\"window\"), '{x}')" for x in ACTORS)} AS actor, {" OR ".join(f"contains(lower(\"window\"), '{x}')" for x in VERBS)} AS verb,
    {" OR ".join(f"contains(lower(\"window\"), '{x}')" for x in MARKERS)} AS marker, CASE ("offset" // 400) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'cooccur' WHEN 2 THEN 'cooccur_verb' ELSE 'soft' END AS gate FROM w),
e AS (SELECT *, coalesce(max(CAST(verb AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY "offset" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS earlier FROM f),
p AS (SELECT *, CASE gate WHEN 'cooccur' THEN actor WHEN 'cooccur_verb' THEN actor AND verb WHEN 'soft' THEN marker OR earlier ELSE true END
    OR CAST(actor AS INTEGER) + CAST(verb AS INTEGER) + CAST(marker AS INTEGER) >= 2 AS pass FROM e)
SELECT gate, actor, verb, marker, earlier, pass, count(*) AS n FROM p GROUP BY ALL"""
)
def rule_gate_pass(spark, sf):
    t = F.col("window")
    step = (F.col("offset") / 400).cast("int") % 4
    w = windows_of_documents(spark, sf).withColumn("gate", F.when(step == 0, NONE).when(step == 1, COOCCUR).when(step == 2, COOCCUR_VERB).otherwise(SOFT))
    w = w.withColumn("actor", rules.holds_any(t, ACTORS)).withColumn("verb", rules.holds_any(t, VERBS)).withColumn("marker", rules.holds_any(t, MARKERS))
    w = w.withColumn("earlier", rules.earlier_hit(F.col("verb"), ["doc_id"], ["offset"]))
    w = w.withColumn("pass", rules.gate_pass(F.col("gate"), F.col("actor"), F.col("verb"), F.col("marker"), F.col("earlier")))
    return w.groupBy("gate", "actor", "verb", "marker", "earlier", "pass").agg(F.count("*").alias("n"))


def _score_sql(c: Code) -> str:
    parts = [f"CASE WHEN regexp_matches(lower(\"window\"), '(?i){p}') THEN 0.5::DOUBLE ELSE 0 END" for p in c.patterns]
    parts += [f"CASE WHEN contains(lower(\"window\"), '{k}') THEN {SAMPLE.weights.tiers[t - 1]}::DOUBLE ELSE 0 END" for k, t in c.keywords]
    return " + ".join(parts)


def _best_sql(dim: str, codes: tuple[Code, ...]) -> str:
    arms = []
    for k, c in enumerate(codes):
        has = " OR ".join(f"regexp_matches(lower(\"window\"), '(?i){p}')" for p in c.patterns) or "false"
        arms.append(f"SELECT doc_id, \"offset\", '{dim}' AS dim, '{c.code}' AS code, {_score_sql(c)} AS s, ({has}) AS p, {k} AS o FROM w")
    return " UNION ALL ".join(arms)


@query(
    f"""WITH {WINDOWS_SQL}, s AS ({" UNION ALL ".join(_best_sql(d, c) for d, c in SAMPLE.dimensions)}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, "offset", dim ORDER BY s DESC, p DESC, o) AS r FROM s WHERE s > 0),
b AS (SELECT w.doc_id, w."offset", a.code AS a, round(least(a.s, 1), 3) AS ca, b.code AS b, round(least(b.s, 1), 3) AS cb FROM w
  LEFT JOIN r a ON a.doc_id = w.doc_id AND a."offset" = w."offset" AND a.dim = 'A' AND a.r = 1 LEFT JOIN r b ON b.doc_id = w.doc_id AND b."offset" = w."offset" AND b.dim = 'B' AND b.r = 1)
SELECT CASE WHEN concat_ws('|', a, b) = '' THEN 'UNCLASSIFIED' ELSE concat_ws('|', a, b) END AS combined, count(*) AS n, round(sum(ca), 2) AS conf_a, round(sum(cb), 2) AS conf_b FROM b GROUP BY 1"""
)
def rule_classify(spark, sf):
    c = rules.classified(windows_of_documents(spark, sf), SAMPLE)
    return c.groupBy("combined").agg(F.count("*").alias("n"), F.round(F.sum("conf_A"), 2).alias("conf_a"), F.round(F.sum("conf_B"), 2).alias("conf_b"))


@query(
    """WITH x AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'B4' ELSE 'B2' END AS code, (doc_id % 10) / 10.0::DOUBLE AS conf, contains(text, 'The') AS amb, contains(text, 'ing') AS ctx FROM documents),
y AS (SELECT *, code = 'B4' AND amb AND NOT ctx AS doubt FROM x)
SELECT doc_id, CASE WHEN doubt AND conf - 0.4 < 0.3 THEN 'B8' ELSE code END AS code, round(CASE WHEN doubt AND conf - 0.4 < 0.3 THEN 0.15 WHEN doubt THEN conf - 0.4 ELSE conf END, 3) AS conf FROM y"""
)
def rule_vendor_gate(spark, sf):
    d = table(spark, sf, "documents")
    code, conf = rules.vendor_gated(F.when(F.col("doc_id") % 3 == 0, "B4").otherwise("B2"), (F.col("doc_id") % 10) / 10, F.contains("text", F.lit("The")), F.contains("text", F.lit("ing")), "B4", "B8")
    return d.select("doc_id", code.alias("code"), conf.alias("conf"))


@query(
    """WITH x AS (SELECT vec_id, abs(embedding[1]::DOUBLE) * 3 AS score, label % 2 = 0 AS hard, CAST(label % 3 AS INTEGER) AS pats FROM embeddings),
y AS (SELECT *, round(least(CASE WHEN hard THEN 0.5 ELSE 0 END + CASE WHEN pats >= 2 THEN 0.25 WHEN pats = 1 THEN 0.15 ELSE 0 END + CASE WHEN score >= 0.5 THEN 0.25 WHEN score >= 0.28 THEN 0.15 ELSE 0 END, 1)::DOUBLE, 3) AS conf FROM x)
SELECT vec_id, conf, CASE WHEN conf >= 0.7 THEN 'strong' WHEN conf >= 0.45 THEN 'medium' WHEN conf > 0 THEN 'mention_only' ELSE 'unknown' END AS strength,
  CASE WHEN hard AND pats > 0 THEN 'pattern_hard' WHEN hard THEN 'pattern_hard_kw' WHEN pats > 0 THEN 'pattern_soft' WHEN score >= 0.28 THEN 'semantic' ELSE 'unknown' END AS method,
  score >= 0.2 AND (score >= CASE WHEN hard THEN 0.28 ELSE 0.5 END OR (hard AND pats >= 1)) AS accepted FROM y"""
)
def rule_confidence(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", (F.abs(F.col("embedding")[0].cast("double")) * 3).alias("score"), (F.col("label") % 2 == 0).alias("hard"), (F.col("label") % 3).alias("pats"))
    a = (F.col("score"), F.col("hard"), F.col("pats"))
    e = e.withColumn("conf", rules.confidence(*a))
    return e.select("vec_id", "conf", rules.strength(F.col("conf")).alias("strength"), rules.method(*a).alias("method"), rules.accepted(*a).alias("accepted"))


@query(
    """WITH a AS (SELECT embedding AS e FROM embeddings WHERE vec_id < 16)
SELECT vec_id, round(max(list_cosine_similarity(v.embedding::DOUBLE[], a.e::DOUBLE[])), 4) AS max_cosine FROM embeddings v CROSS JOIN a GROUP BY vec_id"""
)
def vec_max_anchor(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return rules.max_similarity(e, e.where("vec_id < 16").select(F.col("embedding").alias("anchor"))).select("vec_id", F.round("max_cosine", 4).alias("max_cosine"))


@query(
    """WITH s AS (SELECT event_id, event_type, round(value / 50 - 1, 6) AS c FROM events),
l AS (SELECT *, CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM s)
SELECT event_type, label, CASE WHEN label = 'negative' AND regexp_matches(event_type, '(error|view)') THEN 'neutral' ELSE label END AS adjusted, count(*) AS n,
  round(sum(round(CASE WHEN c >= 0.05 THEN (c + 1) / 2 WHEN c <= -0.05 THEN (1 - c) / 2 ELSE 1 - abs(c) END, 4)), 2) AS prob FROM l GROUP BY ALL"""
)
def sent_map(spark, sf):
    e = table(spark, sf, "events").select("event_type", F.round(F.col("value") / 50 - 1, 6).alias("c"))
    e = e.withColumn("label", rules.sentiment_label(F.col("c"))).withColumn("adjusted", rules.governance_adjusted(F.col("label"), F.col("event_type"), "(error|view)"))
    return e.groupBy("event_type", "label", "adjusted").agg(F.count("*").alias("n"), F.round(F.sum(rules.sentiment_probability(F.col("c"))), 2).alias("prob"))


@query(
    r"""WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source, substring(trim(regexp_replace(text, '[\s\x0B]+', ' ', 'g'), ' '), 1, 100) ORDER BY n_chars DESC, doc_id) AS r FROM documents) SELECT doc_id FROM r WHERE r = 1"""
)
def dedup_exact(spark, sf):
    return dedup.exact(table(spark, sf, "documents"), ["source"], "text", "n_chars", "doc_id").select("doc_id")


@query(
    r"""WITH t AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> ''))) AS s FROM documents),
c AS (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY s) AS id FROM t WHERE len(s) > 0), o AS (SELECT id, len(s) AS n, unnest(s) AS token FROM c WHERE doc_id = id),
p AS (SELECT a.id AS id_a, b.id AS id_b, round(count(*) / (any_value(a.n) + any_value(b.n) - count(*)), 6) AS jaccard FROM o a JOIN o b ON a.token = b.token AND a.id < b.id GROUP BY ALL)
SELECT id_a, id_b, jaccard FROM p WHERE jaccard >= 0.7 UNION ALL SELECT id, doc_id, 1.0::DOUBLE FROM c WHERE doc_id > id"""
)
def dedup_jaccard_pairs(spark, sf):
    return dedup.similar_classes(table(spark, sf, "documents"), "doc_id", "text", 0.7)


@query()
def dedup_clusters(spark, sf):
    d = table(spark, sf, "documents").withColumn("confidence", (F.col("n_chars") % 100).cast("double"))
    return dedup.greedy_jaccard(d.select("source", "lang", "doc_id", "text", "confidence"), ["source", "lang"], "doc_id", "text", "confidence", 0.7)


@query()
def dedup_cosine(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("confidence", (F.col("vec_id") % 10).cast("double"))
    return dedup.greedy_cosine(e, ["label"], "vec_id", "embedding", "confidence", 0.5)


def _pages(spark, sf):
    return windows.pages(table(spark, sf, "documents").select("doc_id", "source", "text"))


@query()
def detect_references(spark, sf):
    import dataclasses

    from fathomline.operators import references

    t = dataclasses.replace(SAMPLE, hard_triggers="license", soft_triggers=r"\b(los|der|les)\b", anchors=("the license of the", "und der die"), false_positives=FALSE_POSITIVES[:2])
    refs = references.detect(_pages(spark, sf), t, ["doc_id"])
    return references.with_sentiment(references.deduplicated(refs, ["doc_id"]), governance="(?i)license")
