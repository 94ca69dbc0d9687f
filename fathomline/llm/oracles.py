"""SQL (DuckDB) for the queries of this package that SQL can express."""

from __future__ import annotations

from fathomline.llm import secrets
from fathomline.llm.chat import BODY, CONTROL, END, TURN
from fathomline.llm.quality_rules import STOP_WORDS, THRESHOLDS, Rule


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


OP1 = """
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64.0 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.rid, q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(q.e, d.e) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 20 = 0 AND d.rid <> q.rid
), r AS (
  SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS k FROM s
)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= 20
"""


def _broken(r: Rule) -> str:
    under = r.denominator or "1"
    tests = [f"{r.numerator} < {float(r.low)!r}::DOUBLE * {under}"] if r.low is not None else []
    tests += [f"{r.numerator} > {float(r.high)!r}::DOUBLE * {under}"] if r.high is not None else []
    return f"({under} > 0 AND ({' OR '.join(tests)}))"


OP3 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d
), g AS (
  SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)
), again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again CROSS JOIN (VALUES (0), (1), (2)) s(k) GROUP BY rid
), m AS (
  SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({", ".join(_text(x) for x in dict.fromkeys(y for v in STOP_WORDS.values() for y in v))}))) AS n_stop_words,
    CASE WHEN 2 * strlen(t) <= 3 * length(t) THEN len(ws) ELSE 0 END AS n_listed_words,
    length(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS n_letters, length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper
  FROM w LEFT JOIN covered USING (rid)
), j AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT ({" OR ".join(_broken(r) for r in THRESHOLDS)}) AS kept
FROM j
"""

_LINK = {
    "a": r"""(?is)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)""",
    "b": r"""(?is)<link\b[^>]*\bhref\s*=\s*["'']?([^"''\s>]+)[^>]*\brel\s*=\s*["'']?canonical\b""",
    "c": r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*\burl\s*=\s*["'']?([^"''\s>]+)""",
}


def _rule_of(rules: list, host: str, path: str, what: str) -> str:
    out = []
    for r in sorted(rules, key=lambda r: (-len(r.text), r.action, r.text)):
        out.append(f"WHEN ({host} = {_text(r.host)} OR {host} LIKE {_text('%.' + r.host)}) AND starts_with({path}, {_text('/' + r.path)}) THEN {_text(r.text if what == 'rule' else r.action)}")
    return "CASE " + " ".join(out) + " END"


def op4(rules: list) -> str:
    host = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    path = lambda u: f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    found = " UNION ALL ".join(f"SELECT url AS a, regexp_extract(coalesce(html, ''), '{p}', 1) AS b FROM pages" for p in _LINK.values())
    return f"""
WITH RECURSIVE links AS (
  SELECT DISTINCT split_part(a, '#', 1) AS a, split_part(b, '#', 1) AS b FROM ({found}) WHERE b LIKE '%://%' AND a IS NOT NULL
), both_ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach(a, b) AS (
  SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a
), votes AS (
  SELECT a, min({_rule_of(rules, host("b"), path("b"), "action")}) AS inherited FROM reach GROUP BY a
), p AS (
  SELECT page_id, url, {host("url")} AS host, {path("url")} AS path FROM pages
)
SELECT page_id, host, path, {_rule_of(rules, "host", "path", "rule")} AS rule,
  coalesce({_rule_of(rules, "host", "path", "action")}, inherited, 'allow') AS verdict
FROM p LEFT JOIN votes ON split_part(p.url, '#', 1) = votes.a
"""


_ESCAPES = " + ".join([r"length(x) - length(replace(x, '\', ''))", *(f"(length(x) - length(replace(x, {_text(c)}, ''))) // {len(c)}" for c in CONTROL)])
OP7 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
), g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role, x) AS said,
    coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role, x) FILTER (role = 'assistant'), '') AS loss,
    sum({len(TURN) + len(BODY) + len(END) + 1} + length(role) + length(x) + {_ESCAPES}) AS n
  FROM t GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars FROM g
"""

OP10 = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w
), f AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s
), o AS (
  SELECT a.doc_id AS i, b.doc_id AS j, any_value(a.n) AS n, any_value(b.n) AS m, count(*) AS shared
  FROM f a JOIN f b ON a.x = b.x AND a.doc_id < b.doc_id AND 10 * a.n >= 9 * b.n AND 10 * b.n >= 9 * a.n GROUP BY 1, 2
), l AS (
  SELECT i, j FROM o WHERE 100 * shared >= 90 * (n + m - shared)
), both_ways AS (
  SELECT i, j FROM l UNION SELECT j, i FROM l
), reach(i, j) AS (
  SELECT i, j FROM both_ways UNION SELECT r.i, b.j FROM reach r JOIN both_ways b ON r.j = b.i
), c AS (
  SELECT i, min(j) AS j FROM reach GROUP BY i
)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(c.j, doc_id)) AS component_id FROM s LEFT JOIN c ON c.i = s.doc_id
"""


def op11(min_count: int = 10, max_words: int = 3, covered: int = 50, top: int = 2000) -> str:
    """Phrases of every length are lists of words here, counted as they are."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    grams = " UNION ALL ".join(f"SELECT lang, unnest(list_transform(range(1, len(ws) - {n - 2}), lambda i: ws[i:i + {n - 1}])) AS g FROM w" for n in range(1, max_words + 1))
    return f"""
WITH p AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({lower}, '[.,;:!?\\x0A-\\x0D]')) AS x FROM documents
), w AS (
  SELECT lang, regexp_extract_all(x, '[^\\x20\\x09]+') AS ws FROM p
), n AS (
  SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
), f AS (
  SELECT lang, g, count(*) AS c FROM ({grams}) GROUP BY lang, g HAVING count(*) >= {min_count}
), cuts AS (
  SELECT lang, g, c, unnest(range(1, len(g))) AS k FROM f WHERE len(g) >= 2
), s AS (
  SELECT x.lang, x.g, x.c AS a, k, l.c AS l, r.c AS r, 1000000::HUGEINT * x.c * x.c // (l.c::HUGEINT * r.c) AS score
  FROM cuts x JOIN f l ON l.lang = x.lang AND l.g = x.g[1:k] JOIN f r ON r.lang = x.lang AND r.g = x.g[k + 1:]
), best AS (
  SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS place FROM s
), inner_ AS (
  SELECT lang, c, unnest(flatten(list_transform(range(2, len(g)), lambda m: list_transform(range(1, len(g) - m + 2), lambda i: g[i:i + m - 1])))) AS g FROM f WHERE len(g) > 2
), longer AS (
  SELECT lang, g, max(c) AS c FROM inner_ GROUP BY lang, g
), kept AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, a, l, r, score FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.g = b.g
  WHERE place = 1 AND (o.c IS NULL OR 100 * o.c < {covered} * a)
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN n USING (lang) WHERE rank <= {top}
"""


def _spans(of: str, pattern: str, group: int, least: int, kind: str, rank: int) -> str:
    """A row for each match of enough characters: rid, rank, kind, start, stop, value."""
    at = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, CAST(s.a AS BIGINT) AS start, CAST(s.a + length(s.m) AS BIGINT) AS stop, s.v AS value FROM (
    SELECT rid, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'a': {at}, 'm': m[i], 'v': v[i]}})) AS s FROM (
      SELECT rid, string_split_regex(t, {_text(pattern)}) AS g, regexp_extract_all(t, {_text(pattern)}) AS m, regexp_extract_all(t, {_text(pattern)}, {group}) AS v FROM {of}
    )
  ) WHERE length(s.v) >= {least}"""


def op12() -> str:
    """The models' counts are exact; a ratio is rounded to thousandths as in the operator."""
    base = " UNION ALL ".join(_spans("d", k.pattern, k.group, k.least, k.name, i) for i, k in enumerate(secrets.BASE))
    rest = "t"
    for k in secrets.BASE:
        rest = f"regexp_replace({rest}, {_text(k.pattern)}, ' ', 'g')"
    words = secrets.CANDIDATE.replace("{16,}", f"{{{secrets.LEAST_WORD},}}")
    text = lambda where="": f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){where}, '')"
    c = secrets.CODES
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), base AS (
  {base}
), sample AS (
  SELECT * FROM d WHERE h <= (SELECT max(h) FROM (SELECT h FROM d ORDER BY h LIMIT {secrets.FIT_DOCS}))
), samples AS (
  SELECT DISTINCT rid, true AS secret, value FROM base WHERE rid IN (SELECT rid FROM sample)
  UNION ALL
  SELECT rid, false, x FROM (SELECT rid, unnest(list_distinct(regexp_extract_all({rest}, {_text(words)}))) AS x FROM sample) WHERE regexp_matches(x, '[A-Za-z]')
), pairs AS (
  SELECT secret, unnest(list_transform(range(1, length(value) + 1), lambda i: CASE WHEN i = 1 THEN 0 ELSE ascii(value[i - 1]) END * {c} + ascii(value[i]))) AS p FROM samples
), counts AS (
  SELECT p, count(*) FILTER (secret) AS yes, count(*) FILTER (NOT secret) AS no FROM pairs GROUP BY p
), sums AS (
  SELECT p // {c} AS x, sum(yes) AS yes, sum(no) AS no FROM counts GROUP BY 1
), cells AS (
  SELECT i AS p, CAST(round({secrets.UNIT} * (ln((coalesce(n.yes, 0) + 1) / (coalesce(s.yes, 0) + 64)) - ln((coalesce(n.no, 0) + 1) / (coalesce(s.no, 0) + 64)))) AS BIGINT) AS w
  FROM range({c * c}) r(i) LEFT JOIN counts n ON n.p = i LEFT JOIN sums s ON s.x = i // {c}
), runs AS (
  {_spans("d", secrets.CANDIDATE, 0, 0, secrets.MODEL, len(secrets.BASE))}
), free AS (
  SELECT r.* FROM runs r WHERE regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Za-z]')
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = r.rid AND b.start < r.stop AND r.start < b.stop)
), rated AS (
  SELECT rid, start, sum(w) AS w FROM (
    SELECT rid, start, unnest(list_transform(range(1, length(value) + 1), lambda i: CASE WHEN i = 1 THEN 0 ELSE ascii(value[i - 1]) END * {c} + ascii(value[i]))) AS p FROM free
  ) JOIN cells USING (p) GROUP BY rid, start
), every AS (
  SELECT rid, rank, kind, start, stop FROM base
  UNION ALL
  SELECT f.rid, rank, kind, f.start, stop FROM free f JOIN rated USING (rid, start) WHERE w >= {secrets.LEAST_TOTAL} AND w >= {secrets.LEAST_EACH} * length(value)
), o AS (
  SELECT rid, {", ".join(f"count(*) FILTER (kind = '{k.name}') AS n_{k.name}" for k in secrets.BASE)}, {text(f" FILTER (kind <> '{secrets.MODEL}')")} AS base, {text()} AS spans FROM every GROUP BY rid
)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (rid)
"""


_NEXT = "CASE {s} WHEN 2 THEN 3 ELSE 2 END"
_KEPT = "CASE WHEN {s} = 0 AND i_ = 's' THEN 1 WHEN {s} IN (0, 1, 3) AND i_ = 'u' THEN 2 WHEN {s} = 2 AND i_ = 'a' THEN 3 END"


def _of(s: str, c: str = "c") -> str:
    return f"CASE {s} WHEN 0 THEN {c}0 WHEN 1 THEN {c}1 WHEN 2 THEN {c}2 WHEN 3 THEN {c}3 ELSE 1000000000 END"


def _taken(s: int) -> str:
    """What it costs to take a turn in state ``s``: to delete it, or if it may stay to keep it or to change its role."""
    stay = f"least({_of('(' + _KEPT.format(s=s) + ')')}, 1 + {_of('(' + _NEXT.format(s=s) + ')')}) + extra"
    return f"least(2 + c{s}, CASE WHEN gone THEN 1000000000 ELSE {stay} END)"


#: States of the grammar are 0 (nothing yet), 1 (system), 2 (user) and 3 (assistant). DuckDB has no crc32.
OP13 = f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) ORDER BY n) AS t FROM range(256) r(n)
), kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
      lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS kind
  FROM conversations, crc
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last, left(role, 1) AS i_
  FROM damaged
), r AS (
  SELECT *, CASE WHEN last = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
    lag(i_) OVER (PARTITION BY conv_id ORDER BY i) || i_ AS pair
  FROM placed
), q AS (
  SELECT *, coalesce(fault IN ('blank', 'duplicate'), false) AS gone, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM r
), v(conv_id, i, c0, c1, c2, c3) AS (
  SELECT conv_id, max(i) + 1, 0, 10, 5, 0 FROM q GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, least(x0, 5 + x2, 10 + x3), least(x1, 5 + x2, 10 + x3), least(x2, 5 + x3), least(x3, 5 + x2) FROM (
    SELECT q.conv_id, q.i, {", ".join(f"{_taken(s)} AS x{s}" for s in range(4))} FROM v JOIN q ON q.conv_id IS NOT DISTINCT FROM v.conv_id AND q.i = v.i - 1
  )
), both_ AS (
  SELECT v.*, w.c0 AS d0, w.c1 AS d1, w.c2 AS d2, w.c3 AS d3, q.role, q.text, q.i_, q.gone, q.extra
  FROM v LEFT JOIN v w ON w.conv_id IS NOT DISTINCT FROM v.conv_id AND w.i = v.i + 1 LEFT JOIN q ON q.conv_id IS NOT DISTINCT FROM v.conv_id AND q.i = v.i
), f(conv_id, i, s, audit, said) AS (
  SELECT DISTINCT conv_id, CAST(1 AS BIGINT), 0, '', CAST([] AS VARCHAR[]) FROM q
  UNION ALL
  SELECT conv_id, CASE e WHEN 'I' THEN i ELSE i + 1 END, CASE e WHEN 'D' THEN s WHEN 'K' THEN kept ELSE next END, audit || e,
    CASE e WHEN 'D' THEN said ELSE list_append(said, CASE e WHEN 'K' THEN role WHEN 'R' THEN put ELSE put END || ':' || CASE e WHEN 'I' THEN '' ELSE text END) END
  FROM (
    SELECT *, CASE next WHEN 3 THEN 'assistant' ELSE 'user' END AS put,
      CASE WHEN 2 + {_of("s", "d")} = now THEN 'D' WHEN 5 + {_of("next")} = now THEN 'I'
        WHEN NOT gone AND extra + {_of("kept", "d")} = now THEN 'K' WHEN NOT gone AND 1 + extra + {_of("next", "d")} = now THEN 'R' END AS e
    FROM (
      SELECT f.i, f.s, f.audit, f.said, b.* EXCLUDE (i), {_of("f.s")} AS now, {_NEXT.format(s="f.s")} AS next, {_KEPT.format(s="f.s")} AS kept
      FROM f JOIN both_ b ON b.conv_id IS NOT DISTINCT FROM f.conv_id AND b.i = f.i
    ) WHERE role IS NOT NULL OR s IN (1, 2)
  )
), done AS (
  SELECT f.conv_id, f.audit, array_to_string(said, chr(10)) AS said FROM f JOIN (SELECT conv_id, max(i) + 1 AS n FROM q GROUP BY conv_id) e ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND f.i = e.n
  WHERE f.s IN (0, 3)
), sums AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM q GROUP BY conv_id
), costs AS (
  SELECT conv_id, c0 AS cost FROM v WHERE i = 1
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM a.conv_id
  LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN costs ON costs.conv_id IS NOT DISTINCT FROM a.conv_id
"""
