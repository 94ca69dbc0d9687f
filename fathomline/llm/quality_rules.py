"""Quality rules: a table of thresholds compiled into one projection.

Everything here is a Spark SQL expression over the whole text: no user function, no explode, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.shared import WORD, own_prefix

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Frequent function words, by language.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "it", "as", "was", "with", "be", "by", "on", "not", "he", "this", "are", "or", "his", "from", "at", "which", "but", "have", "an", "had", "they", "you", "were", "their", "a"),
    "fr": ("le", "la", "les", "de", "des", "du", "et", "un", "une", "est", "que", "qui", "dans", "en", "pour", "par", "sur", "pas", "au", "ce", "il", "se", "ne", "plus", "avec"),
    "de": ("der", "die", "das", "und", "in", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "er"),
    "it": ("il", "lo", "gli", "di", "del", "della", "che", "non", "per", "con", "una", "sono", "è", "ma", "come", "nel"),
    "pt": ("o", "os", "as", "do", "da", "dos", "das", "em", "um", "uma", "não", "com", "para", "por", "mais", "ao", "na"),
    "nl": ("het", "een", "van", "dat", "op", "te", "voor", "niet", "met", "zijn", "aan", "ook", "maar", "bij", "om"),
    "es": ("el", "la", "los", "las", "de", "y", "que", "en", "un", "una", "por", "con", "no", "para", "es", "se", "del", "al", "lo", "como", "su"),
}


@dataclass(frozen=True)
class Rule:
    """``name`` holds where ``numerator / denominator`` lies within the bounds (None: no bound there)."""

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None

    def broken(self) -> Column:
        """True where the rule is broken; a ratio over nothing breaks no rule. No division takes place."""
        top = F.col(self.numerator).cast("double")
        under = F.lit(1.0) if self.denominator is None else F.col(self.denominator).cast("double")
        out = F.lit(False)
        if self.low is not None:
            out = out | (top < F.lit(self.low) * under)
        if self.high is not None:
            out = out | (top > F.lit(self.high) * under)
        return F.coalesce(out & (under > 0), F.lit(False))


#: The thresholds of the verdict. ``low`` and ``high`` are inclusive.
THRESHOLDS = (
    Rule("too_short", "n_words", low=50),
    Rule("word_length", "word_chars", "n_words", low=2.0, high=12.0),
    Rule("symbols", "n_symbols", "n_words", high=0.1),
    Rule("repeated_words", "n_repeat_words", "n_words", high=0.5),
    Rule("repeated_lines", "n_dup_lines", "n_lines", high=0.6),
    Rule("stop_words", "n_stop_words", "n_listed_words", low=0.04),
    Rule("shouting", "n_upper", "n_letters", high=0.4),
)


def text_measures(df: DataFrame, text: str = "text", stop_words: tuple[str, ...] | None = None, hashed: str = "xxhash64") -> DataFrame:
    """``df`` with the counts that rules speak about, as long columns.

    n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_stop_words, n_listed_words
    (n_words where the text has at most one and a half bytes for a code point, as in alphabets that the stop words are
    written in, else 0), n_letters and n_upper. A null text
    counts as an empty one: all counts are 0. Columns of these names in ``df`` are replaced, all others stay, whatever
    their names. Words are split at space, tab, line feed, vertical tab, form feed and carriage return only; the whole
    text counts, whatever its length. ``hashed``: the SQL function of three words that finds equal windows; any one
    gives the same counts.
    """
    if stop_words is None:
        stop_words = tuple(dict.fromkeys(w for words in STOP_WORDS.values() for w in words))
    names = df.columns
    pre = own_prefix(names)
    t, w, l, n, b, m, h, s, q = (f"{pre}{x}" for x in "twlnbmhsq")
    one = F.expr
    step = df.select(
        *[F.col(f"`{c}`") for c in names],
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias(t),
    )
    step = step.withColumn(w, F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")).withColumn(l, F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD)))
    # Windows of three words by their hashes. Most texts have no window twice: they end at the first count. In others
    # a hash gives up its highest bits for the window's place, so that sorting compares numbers alone.
    step = step.withColumn(n, F.size(w)).withColumn(b, F.length(F.bin(n)))
    step = step.withColumn(m, one(f"shiftleft(1L, {b}) - 1")).withColumn(h, one(f"case when {n} > 3 then transform(slice({w}, 1, {n} - 2), (x, i) -> {hashed}(x, get({w}, i + 1), get({w}, i + 2))) end"))
    step = step.withColumn(s, one(f"case when size(array_distinct({h})) < {n} - 2 then sort_array(transform({h}, (x, i) -> shiftleft(x, {b}) + i)) end"))
    key = lambda of, i: f"shiftright(get({of}, {i}), {b})"
    step = step.withColumn(q, one(f"filter({s}, (x, i) -> shiftright(x, {b}) <=> {key(s, 'i - 1')} or shiftright(x, {b}) <=> {key(s, 'i + 1')})"))
    # Equality is decided on the words: where neighbours agree in the hash alone, the windows themselves are sorted.
    word = lambda at, k: f"get({w}, cast({at} & {m} as int) + {k})"
    alike = " and ".join(f"{word('x', k)} <=> {word(f'get({q}, i - 1)', k)}" for k in range(3))
    met = f"size(filter({q}, (x, i) -> shiftright(x, {b}) <=> {key(q, 'i - 1')} and not ({alike}))) > 0"
    window = f"struct(x as a, get({w}, i + 1) as b, get({w}, i + 2) as c, i as p)"
    sorted_ = f"sort_array(transform(slice({w}, 1, {n} - 2), (x, i) -> {window}))"
    near = " or ".join("(get(y, {0}).a <=> x.a and get(y, {0}).b <=> x.b and get(y, {0}).c <=> x.c)".format(i) for i in ("i - 1", "i + 1"))
    slow = f"sort_array(transform(flatten(transform(array({sorted_}), y -> filter(y, (x, i) -> {near}))), x -> x.p))"
    step = step.withColumn(f"{pre}r", one(f"case when size({q}) <= 0 then null when {met} then {slow} else sort_array(transform({q}, x -> cast(x & {m} as int))) end"))
    # A window at p covers p, p + 1, p + 2; what the next one covers too is not counted twice.
    covered = one(f"aggregate({pre}r, named_struct('to', 0, 'n', 0L), (s, p) -> named_struct('to', p + 3, 'n', s.n + p + 3 - greatest(s.to, p)), s -> s.n)")
    t_, l_ = F.col(t), F.col(l)
    new = {
        "n_words": F.col(n).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.regexp_count(t_, F.lit(f"[{SYMBOLS}]")).cast("long"),
        "n_lines": F.size(l_).cast("long"),
        "n_dup_lines": (F.size(l_) - F.size(F.array_distinct(l_))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
        "n_stop_words": _members(stop_words, w).cast("long"),
        "n_letters": F.length(F.regexp_replace(t_, r"[^\p{L}]++", "")).cast("long"),
        "n_upper": F.length(F.regexp_replace(t_, r"[^\p{Lu}]++", "")).cast("long"),
        "n_listed_words": F.when(2 * F.octet_length(t_) <= 3 * F.length(t_), F.col(n)).otherwise(0).cast("long"),
    }
    # A generator of one row: the optimizer does not push filters on its columns below it, which would repeat the
    # expressions of all steps for each use of a column.
    return step.select(*[F.col(f"`{c}`") for c in names if c not in new], F.inline(F.array(F.struct(*[v.alias(k) for k, v in new.items()]))))


def _members(stop_words: tuple[str, ...], of: str) -> Column:
    words = ", ".join("'" + w.replace("'", "\\'") + "'" for w in stop_words)
    return F.expr(f"size(filter({of}, x -> lower(rtrim('.,;:!?', x)) in ({words})))")


def apply_rules(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """``df`` with the measures of its texts, ``base_failed``, ``broken`` (names of broken rules) and ``kept``.

    base_failed: under 50 words, or more than half of them in repeated windows of three. kept is false
    there, and else true where no rule is broken. Null and empty texts have no words and fail; texts count in
    whole, whatever their length. An empty table gives an empty one; repeated rows are judged one by one; nothing is
    ordered, so there are no ties. Columns with the names of the results are replaced, all others stay.
    """
    out = text_measures(df, text)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    broken = F.array_compact(F.array(*[F.when(r.broken(), F.lit(r.name)) for r in rules]))
    out = out.withColumn("base_failed", base).withColumn("broken", broken)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def kept_documents(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = THRESHOLDS) -> DataFrame:
    """The rows of ``df`` that all rules keep, with the columns of ``df``, whatever their names."""
    names = df.columns
    flagged = df.select(*[F.col(f"`{c}`").alias(f"__in_{i}") for i, c in enumerate(names)], F.col(f"`{text}`").alias("__text"))
    good = apply_rules(flagged, "__text", rules).where("kept")
    return good.select(*[F.col(f"__in_{i}").alias(c) for i, c in enumerate(names)])
