"""Rules over windows: triggers, false positives, gates, classification, confidence, sentiment."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.operators import vocabulary
from fathomline.operators.taxonomy import COOCCUR, COOCCUR_VERB, SOFT, Taxonomy

# Thresholds.
SEMANTIC, SEMANTIC_STRICT, SEMANTIC_FLOOR = 0.28, 0.50, 0.20


def trigger_patterns(taxonomy: Taxonomy) -> tuple[str, str]:
    """The hard and the soft trigger of a taxonomy: its own, else those of its subject, which a code's first letter shows."""
    digital = any(c.startswith(vocabulary.DIGITAL_ROOTS) for c in taxonomy.codes())
    hard, soft = (vocabulary.DIGITAL_HARD, vocabulary.DIGITAL_SOFT) if digital else (vocabulary.AI_HARD, vocabulary.AI_SOFT)
    return taxonomy.hard_triggers or hard, taxonomy.soft_triggers or soft


def triggered(df: DataFrame, hard: str, soft: str, text: str = "window") -> DataFrame:
    """Rows that a hard or else a soft trigger hits, with the first match, its place (from 1) and whether it was hard."""
    h, s = F.regexp_extract(text, f"(?i){hard}", 0), F.regexp_extract(text, f"(?i){soft}", 0)
    is_hard = h != ""
    out = df.withColumn("is_hard", is_hard).withColumn("trigger", F.when(is_hard, h).otherwise(s)).where("trigger <> ''")
    place = lambda pattern: F.regexp_instr(text, F.lit(f"(?i){pattern}"))
    return out.withColumn("at", F.when(F.col("is_hard"), place(hard)).otherwise(place(soft)))


def first_false_positive(text: Column, groups: tuple[tuple[str, tuple[str, ...]], ...], catch_all: tuple[str, ...] = (), subject: str | None = None, lower: bool = True) -> Column:
    """The first group, in order, of which a pattern hits; catch-all patterns do not count where the subject's context hits."""
    t = F.lower(text) if lower else text
    of_subject = t.rlike(f"(?i){subject}") if subject else F.lit(False)
    out = F.lit(None).cast("string")
    for name, patterns in reversed(groups):
        plain = [p for p in patterns if p not in catch_all]
        hit = F.lit(False)
        if plain:
            hit = t.rlike("(?i)" + "|".join(f"(?:{p})" for p in plain))
        if wide := [p for p in patterns if p in catch_all]:
            hit = hit | (~of_subject & t.rlike("(?i)" + "|".join(f"(?:{p})" for p in wide)))
        out = F.when(hit, F.lit(name)).otherwise(out)
    return out


def holds_any(text: Column, terms: tuple[str, ...], words: bool = False) -> Column:
    """Whether the lower-cased text holds one of the terms (as whole words, if asked)."""
    t = F.lower(text)
    if words:
        return t.rlike("|".join(rf"(^|[^\p{{L}}\p{{N}}_]){x}([^\p{{L}}\p{{N}}_]|$)" for x in terms)) if terms else F.lit(False)
    return sum((F.contains(t, F.lit(x)).cast("int") for x in terms), F.lit(0)) > 0


def gate_pass(gate: Column, actor: Column, verb: Column, marker: Column, earlier: Column) -> Column:
    """A gated pattern counts with an actor, an actor and a verb, or a marker or an earlier hit; an ungated one always. Two of the three signs overrule all."""
    own = F.when(gate == COOCCUR, actor).when(gate == COOCCUR_VERB, actor & verb).when(gate == SOFT, marker | earlier).otherwise(F.lit(True))
    return own | (actor.cast("int") + verb.cast("int") + marker.cast("int") >= 2)


def earlier_hit(hit: Column, keys: list[str], order: list[str], with_current: bool = False) -> Column:
    """Whether ``hit`` was true in an earlier row of the document (or, if asked, is in this one)."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if with_current else -1)
    return F.coalesce(F.max(hit.cast("int")).over(w), F.lit(0)) == 1


def classified(df: DataFrame, taxonomy: Taxonomy, text: str = "window") -> DataFrame:
    """With ``code_<dim>`` and ``conf_<dim>`` for each dimension and ``combined`` (codes joined by ``|``).

    The best code has the highest sum of weights; of equals, one with a pattern hit, then the first. Its
    confidence is capped at 1. Three native projections, no shuffle, no user function: every pattern and keyword is
    looked for once, then each dimension has its best code, then code and confidence are read from it.
    """
    names = df.columns
    own = "__r" + "_" * max((len(c) for c in names), default=0)
    low, hits = f"{own}l", f"{own}h"
    looks: dict[tuple[str, str], int] = {}
    for _, codes in taxonomy.dimensions:
        for c in codes:
            for kind, terms in (("pattern", c.patterns), ("keyword", [w.lower() for w, _ in c.keywords])):
                for x in terms:
                    looks.setdefault((kind, x), len(looks))
    read = F.col(low) if taxonomy.lower_case else F.col(text)
    found = [F.coalesce(read.rlike(f"(?i){x}") if kind == "pattern" else F.contains(F.col(low), F.lit(x)), F.lit(False)) for kind, x in looks]
    out = df.withColumn(low, F.lower(text)).withColumn(hits, F.array(*found) if found else F.array().cast("array<boolean>"))
    weight = lambda kind, x, w: F.when(F.get(F.col(hits), F.lit(looks[kind, x])), w).otherwise(0.0)
    best = {}
    for d, (_, codes) in enumerate(taxonomy.dimensions):
        rows = []
        for k, c in enumerate(codes):
            by_pattern = sum((weight("pattern", p, taxonomy.weights.pattern) for p in c.patterns), F.lit(0.0))
            by_word = sum((weight("keyword", w.lower(), taxonomy.weights.tiers[tier - 1]) for w, tier in c.keywords), F.lit(0.0))
            any_pattern = F.exists(F.array(*[F.get(F.col(hits), F.lit(looks["pattern", p])) for p in c.patterns]), lambda x: x) if c.patterns else F.lit(False)
            rows.append(F.struct((by_pattern + by_word).alias("score"), any_pattern.alias("pattern"), F.lit(-k).alias("ord"), F.lit(c.code).alias("code")))
        best[f"{own}b{d}"] = F.array_max(F.filter(F.array(*rows), lambda x: x["score"] > 0))
    out = out.withColumns(best)
    codes = [F.col(f"{own}b{d}")["code"] for d in range(len(taxonomy.dimensions))]
    confs = [F.round(F.least(F.col(f"{own}b{d}")["score"], F.lit(1.0)), 3) for d in range(len(taxonomy.dimensions))]
    joined = F.concat_ws("|", *codes)
    made = [x for (dim, _), c, p in zip(taxonomy.dimensions, codes, confs, strict=True) for x in (c.alias(f"code_{dim}"), p.alias(f"conf_{dim}"))]
    return out.select(*[F.col(f"`{c}`") for c in names], *made, F.when(joined == "", F.lit("UNCLASSIFIED")).otherwise(joined).alias("combined"))


def vendor_gated(code: Column, conf: Column, ambiguous: Column, vendor_context: Column, code_to_doubt: str, fallback: str) -> tuple[Column, Column]:
    """An ambiguous name without its vendor's context lowers the confidence of one code by 0.4; below 0.3 it falls back with 0.15."""
    doubt = (code == code_to_doubt) & ambiguous & ~vendor_context
    lower = conf - 0.4
    return F.when(doubt & (lower < 0.3), F.lit(fallback)).otherwise(code), F.round(F.when(doubt & (lower < 0.3), F.lit(0.15)).when(doubt, lower).otherwise(conf), 3)


def confidence(score: Column, hard: Column, patterns: Column) -> Column:
    raw = F.when(hard, 0.5).otherwise(0.0) + F.when(patterns >= 2, 0.25).when(patterns == 1, 0.15).otherwise(0.0) + F.when(score >= SEMANTIC_STRICT, 0.25).when(score >= SEMANTIC, 0.15).otherwise(0.0)
    return F.round(F.least(raw, F.lit(1.0)), 3)


def strength(conf: Column) -> Column:
    return F.when(conf >= 0.7, "strong").when(conf >= 0.45, "medium").when(conf > 0, "mention_only").otherwise("unknown")


def reasons(score: Column, hard: Column, patterns: Column) -> Column:
    return F.concat_ws(
        "|",
        F.when(hard, "hard_trigger"),
        F.when(patterns >= 2, F.concat(F.lit("pattern_matches="), patterns.cast("string"))).when(patterns == 1, F.lit("pattern_match=1")),
        F.when(score >= SEMANTIC_STRICT, F.concat(F.lit("semantic_strict="), F.format_string("%.3f", score))).when(score >= SEMANTIC, F.concat(F.lit("semantic="), F.format_string("%.3f", score))),
    )


def method(score: Column, hard: Column, patterns: Column, threshold: float = SEMANTIC) -> Column:
    return F.when(hard & (patterns > 0), "pattern_hard").when(hard, "pattern_hard_kw").when(patterns > 0, "pattern_soft").when(score >= threshold, "semantic").otherwise("unknown")


def accepted(score: Column, hard: Column, patterns: Column) -> Column:
    """Above the floor, and above the threshold of its kind or with a hard trigger and a pattern."""
    return (score >= SEMANTIC_FLOOR) & ((score >= F.when(hard, SEMANTIC).otherwise(SEMANTIC_STRICT)) | (hard & (patterns >= 1)))


#: Anchors that one row may be compared with: they are a literal of the plan.
MOST_ANCHORS = 10_000


def max_similarity(df: DataFrame, anchors: DataFrame, vector: str = "embedding", anchor: str = "anchor") -> DataFrame:
    """The highest cosine to any anchor.

    Anchors are phrases of a taxonomy: few. They are brought to unit length once and become a literal; more than
    ``MOST_ANCHORS`` are refused. A row's own length is computed once.
    """
    rows = anchors.select(F.col(anchor).cast("array<double>").alias("a")).limit(MOST_ANCHORS + 1).collect()
    if len(rows) > MOST_ANCHORS:
        raise ValueError(f"more than {MOST_ANCHORS} anchors")
    units = []
    for r in rows:
        n = math.sqrt(sum(x * x for x in r["a"]))
        units.append([x / n for x in r["a"]] if n else [float("nan")] * len(r["a"]))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    own = "__v" + "_" * max((len(c) for c in df.columns), default=0)
    out = df.withColumn(own, F.col(vector).cast("array<double>")).withColumn(f"{own}n", F.sqrt(dot(F.col(own), F.col(own))))
    few = F.lit(units) if units else F.array().cast("array<array<double>>")
    best = F.array_max(F.transform(few, lambda a: dot(F.col(own), a)))
    return out.withColumn("max_cosine", best / F.col(f"{own}n")).drop(own, f"{own}n")


def sentiment_label(compound: Column) -> Column:
    return F.when(compound >= 0.05, "positive").when(compound <= -0.05, "negative").otherwise("neutral")


def sentiment_probability(compound: Column) -> Column:
    return F.round(F.when(compound >= 0.05, (compound + 1) / 2).when(compound <= -0.05, (1 - compound) / 2).otherwise(1 - F.abs(compound)), 4)


def governance_adjusted(label: Column, text: Column, pattern: str) -> Column:
    return F.when((label == "negative") & text.rlike(pattern), "neutral").otherwise(label)
