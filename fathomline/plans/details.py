"""Queries over details: places in texts, scripts, repair, sinks, scans, taxonomies, units of products."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from fathomline.functions import text as tx
from fathomline.operators import dedup, diffusion, evaluate, index, lineage, memory, products, references, rules, score, stats, store, taxonomy, trajectory, translate, vocabulary, windows
from fathomline.plans import standins as st
from fathomline.plans.metrics import DIFFUSION_SQL, MEM_SQL, TRAJ_SQL, UNITS
from fathomline.plans.standins import REFS_SQL, WINDOWS_SQL, shared_references, table, windows_of_documents
from fathomline.plans.surface import PRODUCTS, VENDORS
from fathomline.plans.texts import FALSE_POSITIVES, HARD, SAMPLE, SOFT_TERMS
from fathomline.sources import readers, writers

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# Places --------------------------------------------------------------------------------------------------

_PLACE = lambda p: f"length(regexp_extract(\"window\", '(?is)^(.*?)(?:{p})', 1)) + 1"


@query(
    f"""WITH {WINDOWS_SQL}, h AS (SELECT *, regexp_matches("window", '(?i){HARD}') AS is_hard FROM w), t AS (
  SELECT source, is_hard, CASE WHEN is_hard THEN {_PLACE(HARD)} ELSE {_PLACE(SOFT_TERMS)} END AS spot, length(regexp_extract("window", '(?i)' || CASE WHEN is_hard THEN '{HARD}' ELSE '{SOFT_TERMS}' END, 0)) AS chars
  FROM h WHERE is_hard OR regexp_matches("window", '(?i){SOFT_TERMS}'))
SELECT source, is_hard, count(*) AS n, CAST(sum(spot) AS BIGINT) AS places, CAST(max(spot) AS BIGINT) AS last, CAST(sum(chars) AS BIGINT) AS chars FROM t GROUP BY ALL"""
)
def txt_trigger_places(spark, sf):
    w = rules.triggered(windows_of_documents(spark, sf), HARD, SOFT_TERMS)
    return w.groupBy("source", "is_hard").agg(F.count("*").alias("n"), F.sum(F.col("at").cast("long")).alias("places"), F.max(F.col("at").cast("long")).alias("last"), F.sum(F.length("trigger")).alias("chars"))


@query(
    """WITH d AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS page_text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
p AS (SELECT *, CAST(coalesce(sum(length(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins, instr(lower(page_text), 'the') AS spot FROM d),
g AS (SELECT doc_id, page, substring(text, greatest(begins + spot - 500, 1), begins + spot + 3 + 500 - greatest(begins + spot - 500, 1)) AS t, substring(text, greatest(begins + spot - 400, 1), begins + spot + 3 + 400 - greatest(begins + spot - 400, 1)) AS m FROM p WHERE spot > 0)
SELECT doc_id, count(*) AS pages, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(length(m)) AS BIGINT) AS near, md5(string_agg(md5(t), '' ORDER BY page)) AS digest FROM g GROUP BY doc_id"""
)
def txt_gate_windows(spark, sf):
    p = windows.with_surroundings(windows.pages(table(spark, sf, "documents").select("doc_id", "text")), ["doc_id"], 2000)
    p = p.withColumn("at", F.instr(F.lower("page_text"), "the")).where("at > 0").withColumn("whole", F.concat("before", "page_text", "after"))
    around = lambda r: windows.around(F.col("whole"), F.length("before") + F.col("at"), F.lit(3), r)
    digest = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", F.md5("t").alias("h")))), lambda x: x["h"]), ""))
    return p.withColumns({"t": around(500), "m": around(400)}).groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.length("t")).alias("chars"), F.sum(F.length("m")).alias("near"), digest.alias("digest"))


#: Sentences of a text as RE2 finds them, which has no look-around: a mark between them first.
_SENTENCES = lambda t: rf"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])[\s\x0B]+([A-Z])', '\1' || chr(57344) || '\2', 'g'), chr(57344)), lambda x: regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g')), lambda x: x <> '')"
#: Windows of sentences of ``texts`` (id, text): one step for each sentence, for all texts at once.
SENTENCE_WINDOWS_SQL = f"""sents AS (SELECT id, text, {_SENTENCES("text")} AS s FROM texts WHERE length(text) >= 20),
fold(id, i, n, spot, last, opens, o) AS (
  SELECT id, 1, length(s[1]), length(s[1]) + 1, length(s[1]), true, 0 FROM sents WHERE len(s) > 1
  UNION ALL SELECT f.id, f.i + 1, CASE WHEN f.n + length(s[f.i + 1]) > 500 THEN f.last ELSE f.n END + length(s[f.i + 1]), f.spot + length(s[f.i + 1]) + 1, length(s[f.i + 1]), f.n + length(s[f.i + 1]) > 500,
    CASE WHEN f.n + length(s[f.i + 1]) > 500 THEN f.spot - f.last ELSE f.o END FROM fold f JOIN sents USING (id) WHERE f.i < len(s)
), begun AS (SELECT id, greatest(i - 1, 1) AS a, coalesce(lead(i) OVER (PARTITION BY id ORDER BY i) - 1, 1000000000) AS b, o, row_number() OVER (PARTITION BY id ORDER BY i) - 1 AS window_no FROM fold WHERE opens),
sw AS (
  SELECT id, window_no, array_to_string(s[a:b], ' ') AS "window", o AS "offset" FROM begun JOIN sents USING (id)
  UNION ALL SELECT id, o // 400, substring(text, o + 1, 500), o FROM (SELECT id, text, unnest(range(0, length(text), 400)) AS o FROM sents WHERE len(s) <= 1)
)"""


@query(
    f"""WITH RECURSIVE texts AS (SELECT doc_id AS id, text FROM documents), {SENTENCE_WINDOWS_SQL}
SELECT id AS doc_id, count(*) AS n, CAST(max(length("window")) AS BIGINT) AS longest, CAST(sum("offset") AS BIGINT) AS offsets, md5(string_agg("window", '|' ORDER BY window_no)) AS digest FROM sw GROUP BY id"""
)
def txt_sentence_windows(spark, sf):
    w = windows.text_windows(table(spark, sf, "documents").select("doc_id", "text"))
    digest = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("window_no", "window"))), lambda x: x["window"]), "|"))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("window").cast("long")).alias("longest"), F.sum(F.col("offset").cast("long")).alias("offsets"), digest.alias("digest"))


BOILERPLATE_SQL = tx.BOILERPLATE.replace("\\s", "[\\s\\x0B]")


@query(
    rf"""WITH d AS (SELECT doc_id, text, instr(lower(text), 'the') AS spot FROM documents), w AS (SELECT doc_id, substring(text, greatest(1, spot - 2000), spot + 3 + 2000 - greatest(1, spot - 2000)) AS t, spot - greatest(1, spot - 2000) AS rel FROM d WHERE spot > 0),
r AS (SELECT *, string_split(regexp_replace(t, '([.!?])([\s\x0B]+)([A-Z])', '\1' || chr(57344) || '\2\3', 'g'), chr(57344)) AS raw, {_SENTENCES("t")} AS s FROM w),
k AS (SELECT doc_id, s, least(len(list_filter(range(1, len(raw) + 1), lambda i: list_sum(list_transform(raw[1:i], lambda x: length(x))) <= rel AND regexp_replace(raw[i], '[\s\x0B]+', '', 'g') <> '')), greatest(len(s) - 1, 0)) AS target FROM r),
c AS (SELECT doc_id, array_to_string(s[greatest(1, target - 1):target + 3], ' ') AS c FROM k), m AS (SELECT doc_id, c, instr(lower(c), 'the') AS p FROM c),
b AS (SELECT doc_id, trim(regexp_replace(CASE WHEN p > 0 AND NOT contains(c, '>>>') THEN substring(c, 1, p - 1) || '>>>' || substring(c, p, 3) || '<<<' || substring(c, p + 3) ELSE c END, '(?i){BOILERPLATE_SQL}', ' ', 'g'), ' ') AS c FROM m),
o AS (SELECT doc_id, trim(regexp_replace(c, '[\s\x0B]{{2,}}', ' ', 'g'), ' ') AS c FROM b) SELECT doc_id, CASE WHEN length(c) > 2000 THEN substring(c, 1, 2000) || '...' ELSE c END AS context FROM o"""
)
def txt_context_sentences(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text").withColumn("at", F.instr(F.lower("text"), "the")).where("at > 0")
    return d.select("doc_id", windows.context_sentences(F.col("text"), F.col("at"), F.lit("the")).alias("context"))


# Scripts and repair --------------------------------------------------------------------------------------

_SCRIPTED = "CASE doc_id % 5 WHEN 0 THEN '漢字' WHEN 1 THEN 'ひら' WHEN 2 THEN 'カタ' WHEN 3 THEN '한글' ELSE 'ab' END"
_LANGUAGE_SQL = lambda t: rf"""CASE WHEN {t} IS NULL OR length({t}) < 20 THEN 'en' WHEN len(regexp_extract_all({t}, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{20000}}-\x{{2A6DF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}]')) / length({t}) > 0.15 THEN
  CASE WHEN len(regexp_extract_all({t}, '[\x{{3040}}-\x{{309F}}]')) / length({t}) > 0.01 OR len(regexp_extract_all({t}, '[\x{{30A0}}-\x{{30FF}}]')) / length({t}) > 0.02 THEN 'ja' WHEN len(regexp_extract_all({t}, '[\x{{AC00}}-\x{{D7AF}}]')) / length({t}) > 0.05 THEN 'ko' ELSE 'zh' END
  WHEN len(regexp_extract_all({t}, '[\x{{4E00}}-\x{{9FFF}}\x{{3400}}-\x{{4DBF}}\x{{20000}}-\x{{2A6DF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}]')) / length({t}) > 0.05 THEN 'zh' ELSE 'en' END"""  # noqa: E731


def _scripted(spark, sf, text="text"):
    k = F.col("doc_id") % 5
    two = F.when(k == 0, "漢字").when(k == 1, "ひら").when(k == 2, "カタ").when(k == 3, "한글").otherwise("ab")
    times = F.floor(F.length(text) * (F.col("doc_id") % 7) / 40).cast("int")
    return table(spark, sf, "documents").withColumns({"two": two, "times": times}).withColumn("t", F.concat(F.expr("repeat(two, times)"), F.col(text)))


@query(f"WITH t AS (SELECT doc_id, repeat({_SCRIPTED}, CAST(floor(length(text) * (doc_id % 7) / 40) AS INTEGER)) || text AS t FROM documents) SELECT doc_id, {_LANGUAGE_SQL('t')} AS lang FROM t")
def txt_script_language(spark, sf):
    return _scripted(spark, sf).select("doc_id", tx.script_language(F.col("t")).alias("lang"))


@query(
    f"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS pages FROM documents), p AS (SELECT doc_id, len(pages) AS n, unnest(pages) AS page_text, generate_subscripts(pages, 1) - 1 AS i FROM t),
s AS (SELECT doc_id, i, repeat({_SCRIPTED}, CAST((doc_id + i) % 3 AS INTEGER) * 40) || page_text AS t FROM p WHERE n <= 5 OR (i % (n // 5) = 0 AND i // (n // 5) < 5)),
g AS (SELECT doc_id, {_LANGUAGE_SQL('t')} AS lang, count(*) AS c, min(i) AS f FROM s GROUP BY ALL) SELECT doc_id, arg_max(lang, (c, -f)) AS language FROM g GROUP BY doc_id"""
)
def txt_document_language(spark, sf):
    k = F.col("doc_id") % 5
    two = F.when(k == 0, "漢字").when(k == 1, "ひら").when(k == 2, "カタ").when(k == 3, "한글").otherwise("ab")
    p = windows.pages(table(spark, sf, "documents").select("doc_id", "text"))
    p = p.withColumns({"two": two, "times": (((F.col("doc_id") + F.col("page") - 1) % 3) * 40).cast("int")})
    return references.document_language(p.withColumn("page_text", F.concat(F.expr("repeat(two, times)"), "page_text")), ["doc_id"])


_TERMS_SQL = ", ".join(f"'{t.lower()}'" for t in tx.PROTECTED_TERMS)


@query(f"SELECT page_id, len(list_filter(regexp_extract_all(html, '[a-z]{{3,}}[A-Z][a-z]{{3,}}'), lambda x: lower(x) NOT IN ({_TERMS_SQL}))) >= 2 AS joined FROM pages")
def txt_has_joined_words(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.has_joined_words(F.col("html")).alias("joined"))


_PLAIN_TERMS = "|".join(t.replace("-", r"\-") for t in sorted(tx.PROTECTED_TERMS, key=len, reverse=True))
_MASKED = lambda t: rf"array_to_string(regexp_split_to_array({t}, '(?i)\b(?:{_PLAIN_TERMS})\b'), 'x' || chr(57344) || chr(57345) || 'x')"
_SPLIT = lambda t: rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '([a-z])([A-Z][a-z])', '\1 \2', 'g'), '([a-z])([A-Z]{{2,}})', '\1 \2', 'g'), '([A-Z]{{2,}})([a-z])', '\1 \2', 'g'), '(\.)([A-Z])', '\1 \2', 'g'), '(,)([a-zA-Z])', '\1 \2', 'g')"


#: Texts with words run together, and terms among them that must stay whole.
_JOINED_SQL = "CASE doc_id % 3 WHEN 0 THEN replace(text, ' ', 'Xa') WHEN 1 THEN replace(text, 'e ', 'e chatgpt,SaaS deepLearning.Now  ') ELSE text END"


@query(
    rf"""WITH x AS (SELECT doc_id, {_JOINED_SQL} AS t FROM documents), d AS (SELECT doc_id, t, length(t) >= 20 AND (length(t) - length(replace(t, ' ', ''))) / length(t) < 0.08 AS poor,
  len(list_filter(regexp_extract_all(t, '[a-z]{{3,}}[A-Z][a-z]{{3,}}'), lambda x: lower(x) NOT IN ({_TERMS_SQL}))) >= 2 AS joined FROM x),
m AS (SELECT *, string_split({_SPLIT(_MASKED("t"))}, 'x' || chr(57344) || chr(57345) || 'x') AS parts, regexp_extract_all(t, '(?i)\b(?:{_PLAIN_TERMS})\b') AS terms FROM d),
s AS (SELECT doc_id, t, CASE WHEN poor OR joined THEN array_to_string(list_transform(range(1, len(parts) + 1), lambda i: parts[i] || coalesce(terms[i], '')), '') ELSE t END AS r FROM m),
o AS (SELECT doc_id, t, CASE WHEN length(t) < 20 THEN t ELSE regexp_replace(regexp_replace(regexp_replace(r, '[ \t]{{2,}}', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x0B]+|[\s\x0B]+$', '', 'g') END AS r FROM s)
SELECT doc_id, CAST(length(r) AS BIGINT) AS n, r <> t AS changed, md5(r) AS digest FROM o"""
)
def txt_repair(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.expr(_JOINED_SQL).alias("t")).withColumn("r", tx.repaired(F.col("t")))
    return d.select("doc_id", F.length("r").cast("long").alias("n"), (F.col("r") != F.col("t")).alias("changed"), F.md5("r").alias("digest"))


@query(
    r"""WITH s AS (SELECT doc_id, text, regexp_replace(text, '[aeiou]', ' ', 'g') AS r FROM documents)
SELECT doc_id, length(text) AS chars, CAST(len(regexp_extract_all(text, '[^\s\x0B]+')) AS INTEGER) AS words, CASE WHEN length(text) > 0 THEN round((length(text) - length(replace(text, ' ', ''))) / length(text), 3) ELSE 0 END AS ratio,
  CAST(len(regexp_extract_all(r, '[^\s\x0B]+')) AS INTEGER) AS words_after, CASE WHEN length(r) > 0 THEN round((length(r) - length(replace(r, ' ', ''))) / length(r), 3) ELSE 0 END AS ratio_after, r <> text AS changed FROM s"""
)
def txt_repair_stats(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", tx.repair_stats(F.col("text"), F.regexp_replace("text", "[aeiou]", " ")).alias("s"))
    return d.select("doc_id", F.col("s.original.chars").cast("long").alias("chars"), F.col("s.original.words").alias("words"), F.col("s.original.space_ratio").alias("ratio"), F.col("s.repaired.words").alias("words_after"), F.col("s.repaired.space_ratio").alias("ratio_after"), F.col("s.changed").alias("changed"))


@query(
    """SELECT n AS seconds, CASE WHEN n < 60 THEN printf('%.1fs', n) WHEN n < 3600 THEN CAST(floor(n / 60) AS BIGINT) || 'm ' || CAST(floor(n % 60) AS BIGINT) || 's' ELSE CAST(floor(n / 3600) AS BIGINT) || 'h ' || CAST(floor((n % 3600) / 60) AS BIGINT) || 'm ' || CAST(floor(n % 60) AS BIGINT) || 's' END AS said
FROM (SELECT DISTINCT n_chars / 4.0::DOUBLE AS n FROM documents)"""
)
def txt_duration(spark, sf):
    d = table(spark, sf, "documents").select((F.col("n_chars") / 4).alias("seconds")).distinct()
    return d.select("seconds", tx.duration(F.col("seconds")).alias("said"))


@query(
    """SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 0 THEN p_name || ' (' || p_brand || ')' WHEN p_partkey % 3 = 0 THEN p_name WHEN p_partkey % 2 = 0 THEN '[' || p_brand || ']' ELSE '[Generic]' END AS display,
  CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE '?' END || '|' || CASE WHEN p_partkey % 2 = 0 THEN p_brand ELSE '?' END AS combined FROM part"""
)
def viz_product_display(spark, sf):
    k = F.col("p_partkey")
    of = lambda n, c, miss: F.when(k % n == 0, F.col(c)).otherwise(F.lit(miss))
    return table(spark, sf, "part").select("p_partkey", tx.product_display(of(3, "p_name", ""), of(2, "p_brand", None)).alias("display"), tx.combined_category(of(3, "p_type", None), of(2, "p_brand", "")).alias("combined"))


# Rules ---------------------------------------------------------------------------------------------------


def _fp_sql(lower: bool) -> str:
    t = 'lower("window")' if lower else '"window"'
    groups = [(g, ps) for g, ps in FALSE_POSITIVES if g != "plain"]
    return f"CASE {' '.join(f'''WHEN regexp_matches({t}, '(?i)''' + '|'.join(f'(?:{p})' for p in ps) + f''''){' '}THEN '{g}' ''' for g, ps in groups)} END"


@query(f"WITH {WINDOWS_SQL}, g AS (SELECT source, {_fp_sql(True)} AS low, {_fp_sql(False)} AS as_is FROM w) SELECT source, coalesce(low, 'none') AS low, coalesce(as_is, 'none') AS as_is, count(*) AS n FROM g GROUP BY ALL")
def rule_fp_without_subject(spark, sf):
    groups = FALSE_POSITIVES[:-1]
    fp = lambda low: F.coalesce(rules.first_false_positive(F.col("window"), groups, lower=low), F.lit("none"))
    return windows_of_documents(spark, sf).groupBy("source", fp(True).alias("low"), fp(False).alias("as_is")).agg(F.count("*").alias("n"))


@query(
    """WITH t AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'digital twin ' WHEN 1 THEN 'machine learning ' WHEN 2 THEN 'smart portal ' ELSE '' END || md5(text) AS t FROM documents)
SELECT kind, count(*) AS n, count(*) FILTER (is_hard) AS hard FROM (
  SELECT 'ai' AS kind, regexp_matches(t, 'machine learning') AS is_hard FROM t WHERE regexp_matches(t, 'machine learning|smart') UNION ALL
  SELECT 'digital', regexp_matches(t, 'digital twin') FROM t WHERE regexp_matches(t, 'digital twin|portal')) GROUP BY kind"""
)
def rule_trigger_choice(spark, sf):
    k = F.col("doc_id") % 4
    t = table(spark, sf, "documents").select("doc_id", F.concat(F.when(k == 0, "digital twin ").when(k == 1, "machine learning ").when(k == 2, "smart portal ").otherwise(""), F.md5("text")).alias("window"))
    kinds = {"ai": taxonomy.Taxonomy("ai", (("A", (taxonomy.Code("A1"),)),)), "digital": taxonomy.Taxonomy("digital", (("D", (taxonomy.Code("D1_X"),)),))}
    both = [rules.triggered(t, *rules.trigger_patterns(x)).select(F.lit(n).alias("kind"), "is_hard") for n, x in kinds.items()]
    return both[0].unionByName(both[1]).groupBy("kind").agg(F.count("*").alias("n"), F.count_if("is_hard").alias("hard"))


SHEET = dataclasses.replace(SAMPLE, weights=taxonomy.Weights(0.7, (0.8, 0.6, 0.4)), lower_case=False)


def _sheet_best(dim: str, codes) -> str:
    arms = []
    for k, c in enumerate(codes):
        hits = [f"regexp_matches(\"window\", '(?i){p}')" for p in c.patterns]
        parts = [f"CASE WHEN {h} THEN 0.7::DOUBLE ELSE 0 END" for h in hits] + [f"CASE WHEN contains(lower(\"window\"), '{w}') THEN {SHEET.weights.tiers[t - 1]}::DOUBLE ELSE 0 END" for w, t in c.keywords]
        arms.append(f"SELECT doc_id, \"offset\", '{dim}' AS dim, '{c.code}' AS code, {' + '.join(parts)} AS s, ({' OR '.join(hits) or 'false'}) AS p, {k} AS o FROM w")
    return " UNION ALL ".join(arms)


@query(
    f"""WITH {WINDOWS_SQL}, s AS ({" UNION ALL ".join(_sheet_best(d, c) for d, c in SHEET.dimensions)}), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, "offset", dim ORDER BY s DESC, p DESC, o) AS r FROM s WHERE s > 0)
SELECT dim, code, count(*) AS n, round(sum(round(least(s, 1), 3)), 2) AS conf FROM r WHERE r = 1 GROUP BY ALL"""
)
def rule_classify_sheet(spark, sf):
    c = rules.classified(windows_of_documents(spark, sf), SHEET)
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(f"code_{d}").alias("code"), F.col(f"conf_{d}").alias("conf")) for d, _ in SHEET.dimensions]))
    return c.select(each.alias("x")).where("x.code is not null").groupBy("x.dim", "x.code").agg(F.count("*").alias("n"), F.round(F.sum("x.conf"), 2).alias("conf"))


_MENTION = "CASE event_type WHEN 'click' THEN 'strong growth ' WHEN 'error' THEN 'risk of loss ' WHEN 'view' THEN 'bias detection failure ' ELSE '' END"
_COUNT = lambda ws: f"len(regexp_extract_all(lower(t), '\\b(?:{'|'.join(ws)})\\b'))"


@query(
    f"""WITH x AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN 'positive' ELSE 'pending' END AS sentiment, substring({_MENTION} || ' ' || coalesce(props, ''), 1, 512) AS t, {_MENTION} || ' ' || coalesce(props, '') AS whole FROM events),
y AS (SELECT *, {_COUNT(score.POSITIVE)} - {_COUNT(score.NEGATIVE)} AS d FROM x), z AS (SELECT *, d / sqrt(d * d + 15) AS c FROM y),
l AS (SELECT *, CASE WHEN c >= 0.05 THEN 'positive' WHEN c <= -0.05 THEN 'negative' ELSE 'neutral' END AS label FROM z),
a AS (SELECT event_type, CASE WHEN sentiment <> 'pending' THEN sentiment WHEN label = 'negative' AND regexp_matches(whole, '(?i)bias detection') THEN 'neutral' ELSE label END AS sentiment,
  CASE WHEN sentiment = 'pending' THEN round(CASE WHEN c >= 0.05 THEN (c + 1) / 2 WHEN c <= -0.05 THEN (1 - c) / 2 ELSE 1 - abs(c) END, 4) ELSE 0 END AS s FROM l)
SELECT event_type, sentiment, count(*) AS n, round(sum(s), 3) AS total FROM a GROUP BY ALL"""
)
def sent_pending(spark, sf):
    said = F.when(F.col("event_type") == "click", "strong growth ").when(F.col("event_type") == "error", "risk of loss ").when(F.col("event_type") == "view", "bias detection failure ").otherwise("")
    r = table(spark, sf, "events").select("event_type", said.alias("text"), F.coalesce("props", F.lit("")).alias("context"), F.when(F.col("event_id") % 3 == 0, "positive").otherwise("pending").alias("sentiment"), F.lit(0.0).alias("sentiment_score"))
    return references.with_sentiment(r).groupBy("event_type", "sentiment").agg(F.count("*").alias("n"), F.round(F.sum("sentiment_score"), 3).alias("total"))


#: A taxonomy whose codes are gated, over pages of the documents; no anchors, so that hard triggers alone are accepted.
GATED = taxonomy.Taxonomy(
    "gated",
    (("D", (taxonomy.Code("D1_Ties", "ties", (("the", 1),), (tx.word_of("the"),), taxonomy.COOCCUR), taxonomy.Code("T1_Tools", "tools", (("license", 2),), (tx.word_of("license"),), taxonomy.COOCCUR_VERB))), ("G", (taxonomy.Code("G1_Goals", "goals", (("and", 3),), (tx.word_of("and"), tx.word_of("of")), taxonomy.SOFT),))),
    false_positives=(("shouting", (r"!!",)),), hard_triggers=tx.word_of("of"), soft_triggers=SOFT_TERMS, actors=("herth", "inan"), verbs=("ating", "entre"), markers=("thand",),
)
_OF, _THE, _AND, _LICENSE = (tx.word_of(x) for x in ("of", "the", "and", "license"))
_ANY = lambda c, ws: "(" + " OR ".join(f"contains({c}, '{x}')" for x in ws) + ")"


@query(
    f"""WITH RECURSIVE pages_ AS (SELECT doc_id, text AS whole, unnest(string_split(text, chr(10))) AS page_text, generate_subscripts(string_split(text, chr(10)), 1) AS page FROM documents),
placed AS (SELECT *, doc_id * 1000000 + page AS id, CAST(coalesce(sum(length(page_text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS begins FROM pages_),
texts AS (SELECT id, page_text AS text FROM placed WHERE length(page_text) >= 100), {SENTENCE_WINDOWS_SQL},
hit AS (SELECT *, regexp_matches("window", '(?i){_OF}') AS is_hard FROM sw WHERE length(trim("window", ' ')) >= 30),
t AS (SELECT *, CASE WHEN is_hard THEN {_PLACE(_OF)} ELSE {_PLACE(SOFT_TERMS)} END AS spot, length(regexp_extract("window", '(?i)' || CASE WHEN is_hard THEN '{_OF}' ELSE '{SOFT_TERMS}' END, 0)) AS n FROM hit WHERE is_hard OR regexp_matches("window", '(?i){SOFT_TERMS}')),
g AS (SELECT t.*, p.doc_id, p.page, begins + "offset" + spot AS place, whole FROM t JOIN placed p USING (id) WHERE NOT regexp_matches("window", '!!')),
n AS (SELECT *, lower(substring(whole, greatest(place - 500, 1), place + n + 500 - greatest(place - 500, 1))) AS near, lower(substring(whole, greatest(place - 400, 1), place + n + 400 - greatest(place - 400, 1))) AS close FROM g),
f AS (SELECT *, {_ANY("near", GATED.actors)} AS actor, {_ANY("near", GATED.verbs)} AS verb, {_ANY("close", GATED.markers)} AS marker,
  regexp_matches("window", '(?i){_THE}') AS d1, regexp_matches("window", '(?i){_LICENSE}') AS t1, regexp_matches("window", '(?i)(?:{_AND})|(?:{_OF})') AS g1 FROM n),
e AS (SELECT *, coalesce(max(CAST(own AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY page, window_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS earlier, max(CAST(own AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY page, window_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS so_far
  FROM (SELECT *, (d1 AND (actor OR CAST(actor AS INTEGER) + CAST(verb AS INTEGER) + CAST(marker AS INTEGER) >= 2)) OR (t1 AND ((actor AND verb) OR CAST(actor AS INTEGER) + CAST(verb AS INTEGER) + CAST(marker AS INTEGER) >= 2)) AS own FROM f)),
k AS (SELECT *, concat_ws('|', CASE WHEN d1 AND actor THEN 'D1_Ties' END, CASE WHEN t1 AND actor AND verb THEN 'T1_Tools' END, CASE WHEN g1 AND (marker OR so_far) THEN 'G1_Goals' END) AS codes FROM e
  WHERE (d1 AND actor) OR (t1 AND actor AND verb) OR (g1 AND (marker OR earlier)) OR CAST(actor AS INTEGER) + CAST(verb AS INTEGER) + CAST(marker AS INTEGER) >= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, md5(substring("window", 1, 200)) ORDER BY page, window_no) AS r FROM k)
SELECT doc_id, page, window_no, is_hard, CAST(place AS BIGINT) AS place, actor, verb, marker, codes FROM r WHERE r = 1"""
)
def detect_candidates(spark, sf):
    return _candidates(spark, sf, GATED)


#: The same taxonomy with its gates and signs as functions.
HOOKED = dataclasses.replace(
    GATED, dimensions=tuple((d, tuple(dataclasses.replace(c, gate=taxonomy.NONE) for c in codes)) for d, codes in GATED.dimensions), actors=(), verbs=(), markers=(),
    has_actor=lambda t: F.lower(t).rlike("herth|inan"), has_verb=lambda t: F.lower(t).rlike("ating|entre"), has_marker=lambda t: F.contains(F.lower(t), F.lit("thand")),
    gate_of={"D1_Ties": taxonomy.COOCCUR, "T1_Tools": taxonomy.COOCCUR_VERB, "G1_Goals": taxonomy.SOFT}.__getitem__,
)


@query(ORACLE_SQL["detect_candidates"])
def detect_hooked(spark, sf):
    return _candidates(spark, sf, HOOKED)


def _candidates(spark, sf, t):
    p = windows.pages(table(spark, sf, "documents").select("doc_id", "text"))
    starts = p.select("doc_id", "page", F.length("page_text").alias("chars"))
    w = references.candidates(p, t, ["doc_id"])
    # ``place`` counts from the surroundings of the page: from the document's start, it is the page's start and what is behind that.
    from pyspark.sql.window import Window

    before = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("begins", F.coalesce(F.sum(F.col("chars") + 1).over(before), F.lit(0)).cast("long")).drop("chars")
    w = w.join(starts, ["doc_id", "page"])
    place = (F.col("begins") + F.col("place") - F.length("before")).cast("long")
    return w.select("doc_id", F.col("page").cast("long").alias("page"), F.col("window_no").cast("long").alias("window_no"), "is_hard", place.alias("place"), "actor", "verb", "marker", F.array_join("pattern_codes", "|").alias("codes"))


# Memory, trajectories, diffusion -------------------------------------------------------------------------


@query(
    f"""WITH {REFS_SQL}, x AS (SELECT *, CASE WHEN ref_id % 4 = 0 THEN '' ELSE product END AS p0, CASE WHEN ref_id % 4 = 0 AND ref_id % 8 <> 0 THEN vendor ELSE '' END AS v0 FROM refs),
k AS (SELECT *, CASE WHEN regexp_matches(product, '(?i)blue ring') AND year >= 1997 THEN 'Blue Ring|Acme' WHEN regexp_matches(product, '(?i)\\bring\\b') AND regexp_matches(product, '(?i)small') THEN 'Ring|Ringco' WHEN regexp_matches(product, '(?i)\\bbolt\\b') AND year >= 1999 THEN 'Bolt|Acme'
  WHEN regexp_matches(product, '(?i)widget') THEN '|Widget Works' WHEN regexp_matches(product, '(?i)gear') THEN '|Gearbox' ELSE '|' END AS f FROM x),
e AS (SELECT *, CASE WHEN p0 = '' AND v0 = '' AND split_part(f, '|', 1) <> '' THEN split_part(f, '|', 1) ELSE p0 END AS p, CASE WHEN p0 = '' AND v0 = '' AND split_part(f, '|', 2) <> '' THEN split_part(f, '|', 2) ELSE v0 END AS v FROM k)
SELECT ref_id % 3 = 0 AS seen, CASE WHEN p <> '' THEN 'SPECIFIC' WHEN v <> '' THEN 'VENDOR_ONLY' ELSE 'CATEGORY_ONLY' END AS granularity, count(*) AS n, count(DISTINCT p) AS products, count(DISTINCT v) AS vendors FROM e GROUP BY ALL"""
)
def mem_enriched(spark, sf):
    k = F.col("ref_id")
    r = st.references(spark, sf).withColumn("said", F.col("product")).withColumn("vendor", F.when((k % 4 == 0) & (k % 8 != 0), F.col("vendor")).otherwise(""))
    r = r.withColumn("product", F.when(k % 4 == 0, "").otherwise(F.col("product")))
    e = memory.enriched(products.with_products(r, "said", "year", PRODUCTS, VENDORS, out="found"), F.col("found")).drop("found")
    return e.groupBy((k % 3 == 0).alias("seen"), "granularity").agg(F.count("*").alias("n"), F.count_distinct("product").alias("products"), F.count_distinct("vendor").alias("vendors"))


@query(
    f"""WITH {REFS_SQL}, u AS (SELECT company, category_a, year, min(year) OVER (PARTITION BY company, category_a) AS first FROM (SELECT DISTINCT company, category_a, year FROM refs)),
n AS (SELECT DISTINCT company, category_a, year FROM refs WHERE ref_id % 3 <> 0)
SELECT company, category_a, year, CASE WHEN year > first THEN 'CONFIRMED' ELSE 'NEW_ADOPTION' END AS event_type FROM u JOIN n USING (company, category_a, year)"""
)
def mem_batch(spark, sf):
    r = shared_references(spark, sf, *UNITS, "vendor").withColumn("memory_processed", (F.col("ref_id") % 3 == 0).cast("int"))
    none = F.struct(F.lit(None).cast("string").alias("product"), F.lit(None).cast("string").alias("vendor"))
    fresh, _ = memory.batch(r, none, ["category_a"], st.years(r))
    return fresh.select("company", "category_a", "year", "event_type")


@query(
    f"""WITH {TRAJ_SQL}, top AS (SELECT company, year FROM parts GROUP BY ALL ORDER BY count(*) DESC, company, year LIMIT 1)
SELECT company, year, component, category, points::DOUBLE AS points, CAST(row_number() OVER (ORDER BY abs(points) DESC, component, category) AS INTEGER) AS place FROM parts JOIN top USING (company, year)"""
)
def traj_contributions_of(spark, sf):
    from pyspark.sql.window import Window

    units, years = st.units_and_years(spark, sf)
    n = trajectory.year_contributions(units, years).groupBy("company", "year").agg(F.sum("n").alias("n"))
    top = lineage.kept(n.orderBy(F.desc("n"), "company", "year").limit(1)).first()
    of = trajectory.contributions_of(trajectory.listed_contributions(units.where(F.col("company") == top["company"]), years), top["company"], top["year"])
    return of.select("company", "year", "component", "category", "points", F.row_number().over(Window.orderBy(*trajectory.heaviest())).alias("place"))  # the parts of one company-year


@query(f"WITH {REFS_SQL}, {st.LAST_YEARS_SQL} SELECT year, name, value FROM years, (VALUES ('maturity_cap', 2.0::DOUBLE), ('inferred_penalty', -0.25), ('depth_divisor', 4.0)) v(name, value)")
def traj_parameters(spark, sf):
    """The parameters that each scored year is kept with."""
    one = F.broadcast(trajectory.parameters(spark).where("name in ('maturity_cap', 'inferred_penalty', 'depth_divisor')"))
    return st.years(st.references(spark, sf)).crossJoin(one).select("year", "name", "value")


@query(
    f"""WITH {MEM_SQL}, i AS (SELECT company, year, count(*) AS n FROM refs GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY year ORDER BY n DESC, company) AS INTEGER) AS rank_in_year FROM i)
SELECT company, year, n, rank_in_year FROM r WHERE year = 1996"""
)
def idx_scan(spark, sf):
    n = st.references(spark, sf).groupBy("company", "year").agg(F.count("*").alias("n"))
    return index.scan(index.ranked(n, "n"), 1996)


_ENDED = "CASE WHEN company % 4 = 0 THEN ly + 1 END"


@query(
    f"""WITH {DIFFUSION_SQL}, top AS (SELECT max(year) AS y FROM refs), a AS (SELECT *, {_ENDED} AS ended FROM ad), use AS (SELECT company, category_b, CAST(y AS INTEGER) AS year, y - fy >= 5 AS mature FROM (SELECT *, unnest(range(fy, greatest(least(coalesce(ended - 1, (SELECT y FROM top)), (SELECT y FROM top)), ly) + 1)) AS y FROM a)),
off AS (SELECT company, category_b, CAST(y AS INTEGER) AS year FROM (SELECT *, unnest(range(ended, (SELECT y FROM top) + 1)) AS y FROM a WHERE ended IS NOT NULL)),
g AS (SELECT category_b, year, list_sort(list(DISTINCT company) FILTER (o)) AS ad_, list_sort(list(DISTINCT company) FILTER (m)) AS ma_, list_sort(list(DISTINCT company) FILTER (NOT o)) AS off_ FROM (SELECT category_b, year, company, true AS o, mature AS m FROM use UNION ALL SELECT category_b, year, company, false, false FROM off) GROUP BY ALL)
SELECT category_b, year, md5(array_to_string(coalesce(ad_, []), ',')) AS adopters, CAST(len(coalesce(ma_, [])) AS INTEGER) AS mature, array_to_string(list_filter(coalesce(off_, []), lambda x: NOT list_contains(coalesce(ad_, []), x)), ',') AS discontinued_by, CAST(len(coalesce(ad_, [])) + 2 * len(coalesce(ma_, [])) AS INTEGER) AS points FROM g"""
)
def diffusion_details(spark, sf):
    r = shared_references(spark, sf, *UNITS)
    last = r.agg(F.max("year")).first()[0] or 0
    a = lineage.kept(diffusion.adoptions(diffusion.yearly(st.portfolio_b(r))))
    stated = a.select("company", "product", F.when(F.col("company") % 4 == 0, F.col("last_confirmed_year") + 1).alias("ended_year"))
    out = diffusion.details(diffusion.adopters(a, last, stated), diffusion.ended(a.join(stated, ["company", "product"]), last), "category_b")
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("category_b", "year", F.md5(join("adopters")).alias("adopters"), F.size("mature_adopters").alias("mature"), join("discontinued_by").alias("discontinued_by"), "points")


@query(f"WITH {DIFFUSION_SQL} SELECT product, count(*) AS n, min(year) AS first FROM (SELECT * FROM rows_ WHERE NOT (product LIKE '%blue%' AND year < 1997)) GROUP BY product")
def diffusion_released(spark, sf):
    r = shared_references(spark, sf, *UNITS)
    rows = diffusion.yearly(st.portfolio_b(r))
    releases = r.where("product like '%blue%'").select("product", F.lit(1997).alias("release_year")).distinct()
    return diffusion.without_anachronisms(rows, releases).groupBy("product").agg(F.count("*").alias("n"), F.min(F.col("year").cast("long")).alias("first"))


@query(
    f"""WITH {DIFFUSION_SQL}, s AS (SELECT product, year, count(DISTINCT company) AS adopter_count, count(DISTINCT company) + 2 * count(DISTINCT company) FILTER (mature) AS points FROM used GROUP BY ALL),
c AS (SELECT product, arg_max(adopter_count, year) AS adopters_latest, round(least(arg_max(points, year) / 3000, 1), 6) AS score FROM s GROUP BY product) SELECT * FROM c WHERE adopters_latest >= 3 ORDER BY score DESC, product LIMIT 10"""
)
def diffusion_top(spark, sf):
    r = shared_references(spark, sf, *UNITS)
    last = r.agg(F.max("year")).first()[0] or 0
    s = diffusion.scores(diffusion.adopters(diffusion.adoptions(diffusion.yearly(st.portfolio_b(r))), last), "product")
    return diffusion.top_curves(diffusion.curves(s, "product", F.lit(1000.0)), "product").select("product", "adopters_latest", "score")


@query("SELECT doc_id, regexp_matches(t, 'discontinued using|no longer use|phased out|deprecated|sunsetting') AS up FROM (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'was discontinued using it' WHEN 1 THEN 'we No Longer use' WHEN 2 THEN 'phased out' WHEN 3 THEN 'undeprecated' WHEN 4 THEN 'sunsetting' WHEN 5 THEN 'sunsets' ELSE 'kept' END AS s, lower(s) AS l, CASE WHEN l = 'undeprecated' THEN '' ELSE l END AS t FROM documents)")
def diffusion_gives_up(spark, sf):
    said = F.element_at(F.array(*[F.lit(x) for x in ("was discontinued using it", "we No Longer use", "phased out", "undeprecated", "sunsetting", "sunsets", "kept")]), (F.col("doc_id") % 7 + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", diffusion.gives_up(said).alias("up"))


@query(f"WITH {REFS_SQL}, k AS (SELECT ref_id, CASE ref_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' ELSE product END AS p, CASE ref_id % 3 WHEN 0 THEN ' ' ELSE vendor END AS v FROM refs) SELECT CASE WHEN trim(p) <> '' THEN 'SPECIFIC' WHEN trim(v) <> '' THEN 'VENDOR_ONLY' ELSE 'CATEGORY_ONLY' END AS granularity, count(*) AS n FROM k GROUP BY 1")
def mem_granularity(spark, sf):
    k = F.col("ref_id")
    g = memory.granularity(F.when(k % 4 == 0, "").when(k % 4 == 1, " ").otherwise(F.col("product")), F.when(k % 3 == 0, " ").otherwise(F.col("vendor")))
    return st.references(spark, sf).groupBy(g.alias("granularity")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {REFS_SQL} SELECT company, year, array_to_string(list_sort(list(DISTINCT category_a)), ',') AS sources, array_to_string(list_sort(list(DISTINCT pages)), ',') AS pages, count(DISTINCT product) AS doc_count, count(*) AS total_occurrences,
  round(avg(coalesce(CASE WHEN sentiment <> 'pending' THEN sentiment_score END, 0)) + 1e-9, 4) AS avg_sentiment, round(avg(semantic_score) + 1e-9, 4) AS avg_semantic, max(semantic_score) AS max_confidence, arg_max(ref_id, (semantic_score, -ref_id)) AS text FROM refs GROUP BY ALL"""
)
def dedup_summary(spark, sf):
    r = st.references(spark, sf).select("company", "year", "ref_id", F.col("category_a").alias("doc_type"), F.col("pages").alias("page"), F.col("product").alias("document"), F.when(F.col("sentiment") != "pending", F.col("sentiment_score")).alias("sentiment_score"), "semantic_score", F.col("semantic_score").alias("confidence"), F.col("ref_id").alias("text"))
    return dedup.summarised(r, ["company", "year"], "ref_id")


# Sinks: written to the shared folder and read again ------------------------------------------------------


def _read(df, *paths):
    """``df``, which reads ``paths``, computed, and those deleted."""
    out = lineage.kept(df)
    for path in paths:
        lineage.removed(df.sparkSession, path)
    return out


@query(f"WITH {REFS_SQL} SELECT company, year, n + CASE WHEN year = 1996 THEN 1 ELSE 0 END AS n FROM (SELECT company, year, count(*) AS n FROM refs GROUP BY ALL)")
def sink_years(spark, sf):
    n = st.references(spark, sf).groupBy("company", "year").agg(F.count("*").alias("n"))
    path = lineage.scratch(spark, "years")
    writers.write_years(n, path)
    writers.replaced(n.where("year = 1996").withColumn("n", F.col("n") + 1), path, ("year",))
    return _read(spark.read.parquet(path).select("company", "year", "n"), path)


@query("SELECT doc_id, CASE WHEN n_chars > 500 THEN lang END AS lang, CASE WHEN doc_id % 3 > 0 THEN n_chars / 7.0::DOUBLE END AS ratio, 'sample' AS title FROM documents")
def sink_json(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 500, F.col("lang")).alias("lang"), F.when(F.col("doc_id") % 3 > 0, F.col("n_chars") / 7).otherwise(F.lit(float("nan"))).alias("ratio"))
    path = lineage.scratch(spark, "json")
    writers.write_json_document(d, path, {"title": "sample"})
    meta, rows = writers.read_json_document(spark, path, "doc_id long, lang string, ratio double")
    return _read(rows.withColumn("title", F.lit(meta["title"])), path)


@query("SELECT page_id, url, md5(regexp_replace(replace(replace(replace(replace(translate(url, '–—“”‘’', '--\"\"'''''), '→', '->'), '…', '...'), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '^\\s+|\\s+$', '', 'g')) AS h FROM pages")
def sink_csv(spark, sf):
    path = lineage.scratch(spark, "csv")
    writers.write_csv(table(spark, sf, "pages").select("page_id", "url", F.col("url").alias("again")), path, mark=True)
    return _read(spark.read.csv(path, header=True, schema="page_id long, url string, again string", escape='"').select("page_id", "url", F.md5("again").alias("h")), path)


@query("SELECT user_id AS who, CAST(count(*) AS INTEGER) AS n, CAST(NULL AS VARCHAR) AS note FROM events GROUP BY user_id")
def sink_migrated(spark, sf):
    path = lineage.scratch(spark, "old")
    table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("dropped")).write.parquet(path)
    writers.migrated(spark.read.parquet(path), "who long, n int, note string", {"user_id": "who"}).write.parquet(f"{path}-new")
    return _read(spark.read.parquet(f"{path}-new"), path, f"{path}-new")


@query("SELECT lang, count(*) * 2 AS n FROM documents WHERE lang <> 'en' GROUP BY lang")
def sink_audit(spark, sf):
    path = lineage.scratch(spark, "audit")
    rows = table(spark, sf, "documents").where("lang <> 'en'").select("doc_id", "lang")
    for dry in (False, True, False):
        writers.append_audit(rows, path, dry)
    return _read(spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n")), path)


@query(
    f"""WITH {DIFFUSION_SQL}, s AS (SELECT product, year, count(DISTINCT company) AS adopter_count, count(DISTINCT company) + 2 * count(DISTINCT company) FILTER (mature) AS points FROM used GROUP BY ALL),
c AS (SELECT product, min(year) AS first_year, max(year) AS last_year, arg_max(adopter_count, year) AS a FROM s GROUP BY product) SELECT product AS key, 'product' AS kind, first_year, last_year, s.year, points::DOUBLE AS points FROM c JOIN s USING (product) WHERE a >= 3"""
)
def sink_diffusion_records(spark, sf):
    r = shared_references(spark, sf, *UNITS)
    last = r.agg(F.max("year")).first()[0] or 0
    s = lineage.kept(diffusion.scores(diffusion.adopters(diffusion.adoptions(diffusion.yearly(st.portfolio_b(r))), last), "product"))
    one, years = writers.summary_records(diffusion.curves(s, "product", F.lit(1000.0)), s, "product", "product")
    folder = lineage.scratch(spark, "records")
    writers.workbook(folder, {"summary": one, "yearly": years})
    read = lambda n, df: spark.read.csv(f"{folder}/{n}", header=True, schema=df.schema)
    return _read(read("summary", one).join(read("yearly", years), ["key", "kind"]).select("key", "kind", "first_year", "last_year", "year", "points"), folder)


# Sources and scans ---------------------------------------------------------------------------------------

TABLES = ("benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier")


@query("SELECT name || '.parquet' AS name, row_number() OVER (ORDER BY name) <= 3 AS first FROM (VALUES " + ", ".join(f"('{t}')" for t in TABLES) + ") v(name)")
def src_discover(spark, sf):
    """Tables are files or folders of files."""
    files = readers.discover(spark, sf, "*.parquet").select("path")
    tables = files.select(readers.table_name(readers.below(spark, sf)).alias("path")).distinct()
    first = readers.first_paths(tables, 3)
    return tables.join(first.withColumn("first", F.lit(True)), "path", "left").select(F.col("path").alias("name"), F.coalesce("first", F.lit(False)).alias("first"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(quality, 1) AS label, '' AS context, lang AS category, 0 AS year FROM documents LEFT JOIN labels USING (doc_id)")
def src_gold_fragments(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("quality").alias("label"), F.col("lang").alias("category"))
    return readers.gold_fragments(d).select("id", "label", "context", "category", "year")


@query("SELECT 'nation' AS name, count(*) AS n FROM nation UNION ALL SELECT 'missing', 0")
def src_table_or_empty(spark, sf):
    of = lambda n: readers.table_or_empty(spark, f"{sf}/{n}.parquet", "n_nationkey long").agg(F.lit(n).alias("name"), F.count("*").alias("n"))
    return of("nation").union(of("missing"))


@query("SELECT name FROM (SELECT (n_nationkey * 10) || '. ' || n_name || ' - 2024 - annual report' || CASE WHEN n_nationkey % 2 = 0 THEN '_CN' ELSE '' END || '.pdf' AS name, n_nationkey * 10 AS p FROM nation) WHERE p BETWEEN 50 AND 120")
def src_positions(spark, sf):
    k = F.col("n_nationkey")
    n = table(spark, sf, "nation").select(F.concat((k * 10).cast("string"), F.lit(". "), "n_name", F.lit(" - 2024 - annual report"), F.when(k % 2 == 0, "_CN").otherwise(""), F.lit(".pdf")).alias("name"))
    return readers.in_positions(n, 50, 120)


@query("SELECT n_nationkey, n_nationkey % 3 = 0 AS translated FROM nation")
def src_translated_files(spark, sf):
    k = F.col("n_nationkey")
    name = F.concat("n_name", F.when(k % 6 == 0, "_CN.pdf").when(k % 6 == 3, "-cn").otherwise("CN.pdf"))
    return table(spark, sf, "nation").select("n_nationkey", readers.is_translated_file(name).alias("translated"))


@query("SELECT max(CAST(year(o_orderdate) AS INTEGER)) AS latest, min(CAST(year(o_orderdate) AS INTEGER)) AS first, count(DISTINCT o_custkey) AS companies, count(DISTINCT (o_custkey, year(o_orderdate))) AS company_years, array_to_string(list_sort(list(DISTINCT CAST(year(o_orderdate) AS INTEGER))), ',') AS years FROM orders")
def stats_years(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("company"), F.year("o_orderdate").alias("year"))
    return stats.years_covered(o)


@query("SELECT c_custkey, CAST(unnest(range(1990 + c_custkey % 12, 2000)) AS INTEGER) AS year FROM customer WHERE 1990 + c_custkey % 12 <= 1999")
def stats_year_grid(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 12 + 1990).alias("first_seen_year"))
    return stats.year_grid(c, last=F.lit(1999)).select("c_custkey", F.col("year").cast("int").alias("year"))


_STATUS = "CASE doc_id % 6 WHEN 0 THEN 'valid' WHEN 1 THEN 'empty' WHEN 2 THEN 'error' WHEN 3 THEN 'ocr' WHEN 4 THEN 'mirrored_all_stripped' ELSE 'corrupted_ocr_failed' END"


@query(f"SELECT {_STATUS} AS status, count(*) AS docs FROM documents WHERE doc_id % 6 NOT IN (0, 3) GROUP BY 1")
def stats_unreadable(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("valid", "empty", "error", "ocr", "mirrored_all_stripped", "corrupted_ocr_failed")])
    return stats.unreadable(table(spark, sf, "documents").select(F.element_at(kinds, (F.col("doc_id") % 6 + 1).cast("int")).alias("text_status")))


@query(f"WITH {REFS_SQL}, c AS (SELECT company, year, count(*) AS n FROM refs GROUP BY ALL) SELECT o_orderkey, o_custkey FROM orders WHERE o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' AND (SELECT count(*) FROM c) > 0")
def store_scan_two(spark, sf):
    return store.scan(table(spark, sf, "orders"), o_orderpriority="2-HIGH", o_orderstatus="F", o_custkey=None).select("o_orderkey", "o_custkey")


@query(
    """SELECT CASE doc_id % 4 WHEN 0 THEN NULL ELSE lang END AS language, count(*) AS total, count(*) FILTER (doc_id % 3 = 0) AS translated, count(*) FILTER (doc_id % 5 = 0) AS context_translated, count(*) FILTER (doc_id % 2 = 0) AS via_first, count(*) FILTER (doc_id % 2 = 1) AS via_second, count(*) FILTER (doc_id % 3 <> 0) AS pending FROM documents GROUP BY 1"""
)
def tr_by_engine(spark, sf):
    k = F.col("doc_id")
    d = table(spark, sf, "documents").select(F.when(k % 4 != 0, F.col("lang")).alias("language"), F.when(k % 3 == 0, "x").when(k % 3 == 1, "").alias("t"), F.when(k % 5 == 0, "x").alias("c"), F.when(k % 2 == 0, "first").otherwise("second").alias("e"))
    return translate.by_engine(d, "language", "t", "c", "e", ["first", "second"])


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '[^\\s\\x0B\\x1C-\\x1F\\x85\\xA0]') THEN 'turned' ELSE 'none' END AS engine, md5(reverse(substring(text, 1, 1000))) AS h FROM documents WHERE lang <> 'en'")
def tr_engines(spark, sf):
    def fails(text, lang):
        raise RuntimeError(lang)

    def no_library():
        raise ImportError("no such engine here")

    engines = translate.available({"missing": no_library, "fails": lambda: fails, "turned": lambda: lambda t, lang: t[::-1]})
    d = table(spark, sf, "documents").where("lang <> 'en'").select("doc_id", "text", "lang")
    return translate.translated(d, "text", "lang", engines).select("doc_id", "engine", F.md5("translation").alias("h"))


# Taxonomies and products ---------------------------------------------------------------------------------


def _sheets(spark, sf):
    """Sheets made of parts: types are codes, brands' first digits dimensions, names keywords, sizes tiers."""
    p = table(spark, sf, "part")
    categories = p.select(F.substring("p_type", 1, 1).alias("dimension"), F.col("p_type").alias("code"))
    keywords = p.select(F.col("p_type").alias("code"), F.col("p_name").alias("keyword"), F.when(F.col("p_size") % 4 > 0, (F.col("p_size") % 4).cast("string")).alias("tier"))
    patterns = p.where("p_size = 50").select(F.col("p_type").alias("code"), F.col("p_brand").alias("pattern"))
    return categories, keywords, patterns


_TERMS_SQL = """terms AS (SELECT substring(p_type, 1, 1) AS dim, p_type AS code, 'keyword' AS kind, p_name AS term, min(CASE WHEN p_size % 4 > 0 THEN p_size % 4 ELSE 2 END) AS tier FROM part GROUP BY ALL
  UNION ALL SELECT DISTINCT substring(p_type, 1, 1), p_type, 'pattern', p_brand, 0 FROM part WHERE p_size = 50)"""


@query(f"WITH {_TERMS_SQL} SELECT dim, count(DISTINCT code) AS codes, count(*) FILTER (kind = 'keyword') AS keywords, count(*) FILTER (kind = 'pattern') AS patterns FROM terms GROUP BY dim")
def tax_statistics(spark, sf):
    return taxonomy.term_statistics(taxonomy.sheet_terms(*_sheets(spark, sf)))


@query(
    f"""WITH {_TERMS_SQL}, more AS (SELECT DISTINCT p_type AS code, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_brand END AS term FROM part UNION SELECT 'NO SUCH CODE', p_name FROM part)
SELECT code, kind, term, tier FROM terms UNION ALL SELECT m.code, 'keyword', m.term, 1 FROM more m WHERE m.code IN (SELECT code FROM terms) AND NOT EXISTS (SELECT 1 FROM terms t WHERE t.kind = 'keyword' AND t.code = m.code AND t.term = m.term)"""
)
def tax_merged(spark, sf):
    p = table(spark, sf, "part")
    more = p.select(F.col("p_type").alias("code"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.col("p_brand")).alias("term"))
    more = more.unionByName(p.select(F.lit("NO SUCH CODE").alias("code"), F.col("p_name").alias("term")))
    return taxonomy.merged_terms(taxonomy.sheet_terms(*_sheets(spark, sf)), more).select("code", "kind", "term", "tier")


@query(f"WITH {REFS_SQL}, {_TERMS_SQL} SELECT r.category_b AS code, r.product AS keyword, coalesce(t.tier, 2) AS tier, count(*) AS n FROM refs r LEFT JOIN terms t ON t.kind = 'keyword' AND t.code = r.category_b AND t.term = r.product GROUP BY ALL")
def tax_tiers(spark, sf):
    found = st.references(spark, sf).select(F.col("category_b").alias("code"), F.col("product").alias("keyword"))
    return taxonomy.with_tiers(found, taxonomy.sheet_terms(*_sheets(spark, sf))).groupBy("code", "keyword", "tier").agg(F.count("*").alias("n"))


@query("SELECT r_name, CASE r_regionkey % 3 WHEN 0 THEN 'A1_Product_Innovation' WHEN 1 THEN 'B6_Robotics_Autonomous' ELSE r_name END AS code FROM region")
def tax_former_codes(spark, sf):
    k = F.col("r_regionkey")
    name = F.when(k % 3 == 0, "Research & Innovation").when(k % 3 == 1, "Agentic AI Systems").otherwise(F.col("r_name"))
    return table(spark, sf, "region").select("r_name", taxonomy.current_code(name).alias("code"))


@query(
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'generative AI' WHEN 1 THEN 'zero trust' WHEN 2 THEN '数字化转型' ELSE substring(text, 1, 50) END AS term, doc_id % 4 < 3 AS found
FROM (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'zero trust and generative AI' WHEN 1 THEN 'a zero trust model' WHEN 2 THEN '我们的数字化转型' ELSE translate(md5(text), '0123456789', 'qqqqqqqqqq') END AS text FROM documents)"""
)
def tax_priority_term(spark, sf):
    k = F.col("doc_id") % 4
    t = F.when(k == 0, "zero trust and generative AI").when(k == 1, "a zero trust model").when(k == 2, "我们的数字化转型").otherwise(F.translate(F.md5("text"), "0123456789", "qqqqqqqqqq"))
    d = table(spark, sf, "documents").select("doc_id", t.alias("t")).withColumn("x", references.first_priority_term(F.col("t")))
    return d.select("doc_id", "x.term", F.contains("x.marked", F.lit(">>>")).alias("found"))


@query(
    f"""WITH {REFS_SQL}, d AS (SELECT p_name, arg_min(p_brand, p_partkey) AS vendor, arg_min(p_type, p_partkey) AS category, arg_min(1990 + p_size % 9, p_partkey) AS release_year FROM part WHERE p_size > 5 GROUP BY p_name)
SELECT product AS unit, vendor, category, CAST(release_year AS INTEGER) AS release_year, count(*) AS n FROM (SELECT CASE WHEN ref_id % 5 = 0 THEN 'Other' ELSE product END AS product FROM refs) r LEFT JOIN d ON d.p_name = r.product GROUP BY ALL"""
)
def prod_facts(spark, sf):
    """References' products with the facts of a dictionary made of parts; of its entries with one name the first counts."""
    m = st.references(spark, sf).select(F.when(F.col("ref_id") % 5 == 0, "Other").otherwise(F.col("product")).alias("unit"))
    known = st.product_dictionary(spark, sf).where("p_size > 5")
    out = products.with_facts(m, known, "unit").select("unit", F.col("known_vendor").alias("vendor"), F.col("known_category").alias("category"), F.col("known_release_year").alias("release_year"))
    return out.groupBy("unit", "vendor", "category", "release_year").agg(F.count("*").alias("n"))


@query(
    """WITH g AS (SELECT doc_id, 1 - quality AS label, regexp_matches(lower(text), '(?i)(?:!!)|(?:[A-Z]{9,})') AS a, regexp_matches(lower(text), '(?i)(?:[#$%&]{2,})') AS b, n_chars / 10000.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)),
p AS (SELECT 'rules' AS method, label, a OR b AS p FROM g UNION ALL SELECT 'rules_or_score', label, a OR b OR score < 0.05 FROM g)
SELECT method, count(*) FILTER (label = 1 AND p) AS tp, count(*) FILTER (label = 1 AND NOT p) AS fn, count(*) FILTER (label = 0 AND p) AS fp, count(*) FILTER (label = 0 AND NOT p) AS tn FROM p GROUP BY method"""
)
def eval_rules(spark, sf):
    g = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id").select((1 - F.col("quality")).alias("label"), "text", (F.col("n_chars") / 10000).alias("score"))
    rule = rules.first_false_positive(F.col("text"), FALSE_POSITIVES[:2])
    both = [evaluate.judged(g, rule).withColumn("method", F.lit("rules")), evaluate.judged(g, rule, F.col("score"), 0.05).withColumn("method", F.lit("rules_or_score"))]
    return evaluate.confusion(both[0].unionByName(both[1]), "label", "predicted", ["method"]).select("method", "tp", "fn", "fp", "tn")


@query("SELECT CASE WHEN s_nationkey % 2 = 0 THEN 'en' ELSE 'xx' END AS lang, count(*) AS texts, count(*) AS alike FROM supplier GROUP BY 1")
def vec_encoders(spark, sf):
    """An encoder for each language: that of one gets its texts in capitals, which the other takes for the same."""
    a = table(spark, sf, "supplier").select("s_name", F.when(F.col("s_nationkey") % 2 == 0, "en").otherwise("xx").alias("lang"))
    two = score.by_language(score.encoded(a, "s_name"), "s_name", "lang", {"xx": lambda t: score.hashing_encoder([x.upper() for x in t])}, name="other")
    return two.groupBy("lang").agg(F.count("*").alias("texts"), F.count_if(F.col("embedding") == F.col("other")).alias("alike"))


@query()
def detect_taxonomies(spark, sf):
    p = windows.pages(table(spark, sf, "documents").select("doc_id", "text"))
    other = dataclasses.replace(SAMPLE, name="other", hard_triggers="license", soft_triggers=r"\b(los|der|les)\b")
    r = references.for_taxonomies(p, [GATED, other], ["doc_id"])
    return r.groupBy("taxonomy", "category").agg(F.count("*").alias("n"), F.sum(F.length("context")).alias("chars"))
