"""Secret scans: fixed patterns, and character Markov models of random strings and of ordinary identifiers.

Everything is a Spark SQL expression: no user function. Places are found by cutting a text at the matches of a pattern
and adding up the lengths of what lies between. The models are two tables of transition counts over labelled samples;
of them only the log-likelihood ratio of each pair of characters remains, a table of fixed size that goes into the
plan as a constant.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.llm.shared import own_prefix

_KEYWORD = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) + end for w, end in (("password", ""), ("passwd", ""), ("secret", ""), ("token", ""), ("api", "_?[Kk][Ee][Yy]")))
#: What may be part of a secret.
VALUE = "[A-Za-z0-9+/_.=-]"


@dataclass(frozen=True)
class Kind:
    """A pattern whose matches are secrets if ``group`` (0: the match) has at least ``least`` characters; shorter ones are matches all the same."""

    name: str
    pattern: str
    group: int
    least: int


#: In the order in which spans of one start are listed.
BASE = (
    Kind("assign", rf"""({_KEYWORD})["']?\x20*[:=]\x20*["']?({VALUE}+)""", 2, 6),
    Kind("access", "AKIA[A-Z0-9]{16,}", 0, 20),
    Kind("hex", "[0-9a-f]{24,}", 0, 24),
)
#: The kind of spans that the models add, and what they look at: runs of letters, digits and signs that are no word's punctuation.
MODEL, CANDIDATE = "random", "[A-Za-z0-9+/_=-]{16,}"
#: Documents that the models are fitted on, those with the least digests of their ids.
FIT_DOCS = 20_000
#: Samples of one kind may be ordinary words of at least so many characters.
LEAST_WORD = 8
#: Codes of characters: ASCII, 0 for the start of a string.
CODES = 128
#: Log-likelihood ratios are whole numbers of thousandths of a nat; a run needs so many of them, and so many for each character.
UNIT, LEAST_TOTAL, LEAST_EACH = 1000, 2_000, 50


def running_sums(values: Column) -> Column:
    """The sums of an array up to and with each item, as longs. Blocks of the root of its size, so that growing arrays are copied in blocks alone."""

    def grown(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.array(start), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    def tail(block: Column) -> Column:
        return F.slice(block, F.lit(2), F.greatest(F.size(block) - 1, F.lit(0)))

    n = F.size(values)
    step = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("int"), F.lit(1))
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda i: F.slice(values, i * step + 1, step))).otherwise(F.array().cast("array<array<bigint>>"))
    sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
    before = grown(sums, F.lit(0).cast("bigint"))
    return F.flatten(F.transform(blocks, lambda b, i: tail(grown(b, F.get(before, i)))))


def _lengths(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.char_length(x).cast("bigint"))


def spans_of(df: DataFrame, text: str, pattern: str, group: int, out: str) -> DataFrame:
    """``df`` with ``out``: the leftmost non-overlapping matches of ``pattern`` as an array of (start, end, value).

    start and end count code points, end is exclusive; value is the match's ``group``. Texts without a match get an
    empty array and cost one search.
    """
    pre = own_prefix(df.columns)
    quoted = F.lit(pattern)
    hit = F.rlike(F.col(text), quoted)
    some = lambda x: F.when(hit, x)
    step = df.withColumn(f"{pre}h", some(F.regexp_extract_all(text, quoted, F.lit(0)))).withColumn(f"{pre}g", some(F.split(text, pattern, -1)))
    value = F.col(f"{pre}h") if group == 0 else some(F.regexp_extract_all(text, quoted, F.lit(group)))
    step = step.withColumn(f"{pre}v", value).withColumn(f"{pre}n", _lengths(F.col(f"{pre}h")))
    # Behind the first i + 1 stretches between matches and the first i matches the next match begins.
    lengths = F.zip_with(F.slice(F.col(f"{pre}g"), 1, F.size(f"{pre}h")), f"{pre}n", lambda g, n: F.char_length(g) + n)
    step = step.withColumn(f"{pre}e", running_sums(lengths))
    made = F.zip_with(F.zip_with(f"{pre}e", f"{pre}n", lambda e, n: F.struct((e - n).alias("start"), e.alias("end"))), f"{pre}v", lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value")))
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    return step.withColumn(out, F.when(F.col(f"{pre}h").isNotNull(), made).otherwise(none)).drop(*[f"{pre}{x}" for x in "hgvne"])


def with_base(df: DataFrame, text: str, pre: str) -> DataFrame:
    """``df`` with a column ``pre`` + name for each kind of ``BASE``: its spans with enough characters."""
    for kind in BASE:
        df = spans_of(df, text, kind.pattern, kind.group, f"{pre}{kind.name}")
        df = df.withColumn(f"{pre}{kind.name}", F.filter(f"{pre}{kind.name}", lambda s: F.char_length(s["value"]) >= kind.least))  # noqa: B023
    return df


def labelled_samples(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """value, secret of at most ``fit_docs`` documents (more where digests of ids tie): the values that the fixed patterns find, and ordinary words.

    Ordinary are runs of ``CANDIDATE``'s characters of at least ``LEAST_WORD`` that hold a letter and are no part of a
    found span. Every distinct value of a document counts once there, so that a text that repeats a word does not make
    the model.
    """
    one = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("d"))
    last = one.select("d").orderBy("d").limit(fit_docs).agg(F.max("d").alias("last")).first()["last"]
    base = with_base(one.where(F.col("d") <= F.lit(last)), "t", "s_")
    secret = F.array_distinct(F.flatten(F.array(*[F.transform(f"s_{k.name}", lambda s: s["value"]) for k in BASE])))
    # A found span is taken out of the text before its words are.
    rest = reduce(lambda t, k: F.regexp_replace(t, F.lit(k.pattern), F.lit(" ")), BASE, F.col("t"))
    words = F.filter(F.array_distinct(F.regexp_extract_all(rest, F.lit(CANDIDATE.replace("{16,}", f"{{{LEAST_WORD},}}")), F.lit(0))), lambda w: w.rlike("[A-Za-z]"))
    both = F.array(F.struct(secret.alias("v"), F.lit(True).alias("secret")), F.struct(words.alias("v"), F.lit(False).alias("secret")))
    return base.select(F.explode(both).alias("s")).select(F.explode("s.v").alias("value"), F.col("s.secret").alias("secret"))


def _codes(value: Column) -> Column:
    """The characters of an ASCII string as numbers, with the start before them."""
    return F.concat(F.array(F.lit(0)), F.transform(F.split(value, ""), lambda c: F.ascii(c)))


def fit(samples: DataFrame) -> list[int]:
    """The log-likelihood ratio of each pair of characters, in thousandths of a nat, by first code * 128 + second.

    Both models are of first order with one more of each pair of the alphabet: (count(xy) + 1) / (count(x) + 64), so
    that without samples of a kind its model is the even one, and without any sample no string is more random than
    another. ``samples``: value, secret; characters outside of ASCII, null labels and null values are left out. What
    comes to the driver are the counts of at most 2 * 128 * 128 pairs.
    """
    known = samples.where("value is not null and secret is not null").select("secret", F.regexp_replace("value", r"[^\x01-\x7F]", "").alias("v")).where("v <> ''")
    pairs = known.select("secret", F.explode(F.zip_with(_codes(F.col("v")), F.slice(_codes(F.col("v")), F.lit(2), F.length("v")), lambda a, b: a * CODES + b)).alias("p"))
    counts = pairs.where("p is not null").groupBy("secret", "p").count()
    of = counts.withColumn("x", F.expr(f"p div {CODES}"))
    total = of.groupBy("secret", "x").agg(F.sum("count").alias("all"))
    rows = of.join(total, ["secret", "x"]).collect()
    seen = {(r["secret"], r["p"]): r["count"] for r in rows}
    sums = {(r["secret"], r["x"]): r["all"] for r in rows}

    def log(secret: bool, p: int) -> float:
        return math.log((seen.get((secret, p), 0) + 1) / (sums.get((secret, p // CODES), 0) + 64))

    return [round(UNIT * (log(True, p) - log(False, p))) for p in range(CODES * CODES)]


def ratio(value: Column, model: list[int]) -> Column:
    """The log-likelihood ratio of an ASCII string, as a long: the sum over its pairs of characters, the start included."""
    # Parsed from one string, which the optimizer does once: a constant array, not 16,384 expressions.
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<int>")
    first = F.struct(F.lit(0).alias("last"), F.lit(0).cast("bigint").alias("sum"))
    step = lambda s, c: F.struct(c.alias("last"), (s["sum"] + F.get(table, s["last"] * CODES + c)).alias("sum"))
    return F.aggregate(F.transform(F.split(value, ""), lambda c: F.ascii(c)), first, step, lambda s: s["sum"])


def scan(docs: DataFrame, model: list[int]) -> DataFrame:
    """``docs`` with ``spans``: all secrets as an array of (start, rank, kind, end, value), sorted by start and rank of the kind.

    Spans of the fixed patterns stay, whatever the models say. The models look at all other runs of ``CANDIDATE``'s
    characters that hold a digit and a letter and overlap no fixed span, and add those with a ratio of at least ``LEAST_TOTAL`` and
    ``LEAST_EACH`` for each character. Null texts are empty and hold nothing; texts count in whole; spans of one start
    are in the order of kinds; repeated rows are judged one by one; an empty table gives an empty one; a column
    ``spans`` of ``docs`` is replaced, all others stay, whatever their names.
    """
    pre = own_prefix(docs.columns)
    names = [c for c in docs.columns if c != "spans"]
    step = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col("text").cast("string"), F.lit("")).alias(f"{pre}t"))
    step = spans_of(with_base(step, f"{pre}t", pre), f"{pre}t", CANDIDATE, 0, f"{pre}{MODEL}")
    fixed = F.flatten(F.array(*[F.col(f"{pre}{k.name}") for k in BASE]))

    def wanted(s: Column) -> Column:
        r = ratio(s["value"], model)
        free = ~F.exists(fixed, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (r >= LEAST_TOTAL) & (r >= LEAST_EACH * F.char_length(s["value"])) & free

    step = step.withColumn(f"{pre}{MODEL}", F.filter(f"{pre}{MODEL}", wanted))
    order = [*[k.name for k in BASE], MODEL]

    def shown(kind: str) -> Column:
        return F.transform(f"{pre}{kind}", lambda s: F.struct(s["start"].alias("start"), F.lit(order.index(kind)).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))

    return step.select(*[F.col(f"`{c}`") for c in names], F.array_sort(F.flatten(F.array(*map(shown, order)))).alias("spans"))


def scan_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans (as text) of all documents, by models fitted on them."""
    found = scan(docs.select("doc_id", "text"), fit(labelled_samples(docs)))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k.name).alias(f"n_{k.name}") for k in BASE]
    base = F.filter("spans", lambda s: s["kind"] != MODEL)
    return found.select("doc_id", *counts, F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
