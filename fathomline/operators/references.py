"""From pages to references: one lazy plan for a taxonomy.

Cheap native filters come first (length, trigger, false positives, gates), then one duplicate check per
document, then the encoder on what is left, then classification of what is accepted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.functions import text as tx
from fathomline.operators import dedup, lineage, rules, score, vocabulary, windows
from fathomline.operators.taxonomy import NONE, Taxonomy
from fathomline.sources.writers import dimension_json


@dataclass(frozen=True)
class DetectConfig:
    window: int = windows.WINDOW
    overlap: int = windows.OVERLAP
    min_page: int = windows.MIN_PAGE
    min_window: int = windows.MIN_WINDOW
    gate_radius: int = 500
    marker_radius: int = 400
    dedup_threshold: float = 0.6
    relational_roots: tuple[str, ...] = ("D", "T")


#: Characters on either side of a page that gates and contexts may read.
SURROUNDINGS = 2000


def _flags(df: DataFrame, taxonomy: Taxonomy, cfg: DetectConfig) -> DataFrame:
    n = F.length("trigger")
    near = windows.around(F.col("surroundings"), F.col("place"), n, cfg.gate_radius)
    close = windows.around(F.col("surroundings"), F.col("place"), n, cfg.marker_radius)
    sign = lambda hook, text, terms: F.coalesce(hook(text), F.lit(False)) if hook else rules.holds_any(text, terms)
    out = df.withColumn("actor", sign(taxonomy.has_actor, near, taxonomy.actors)).withColumn("verb", sign(taxonomy.has_verb, near, taxonomy.verbs))
    return out.withColumn("marker", sign(taxonomy.has_marker, close, taxonomy.markers))


def page_windows(pages: DataFrame, keys: list[str], cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Windows of pages that are long enough, with the document around their page. pages: ``keys``, page, page_text."""
    p = windows.long_pages(windows.with_surroundings(pages.select(*keys, "page", "page_text"), keys, max(SURROUNDINGS, cfg.gate_radius, cfg.marker_radius)), least=cfg.min_page)
    return windows.useful_windows(windows.text_windows(p, "page_text", cfg.window, cfg.overlap), cfg.min_window)


def candidates(pages: DataFrame, taxonomy: Taxonomy, keys: list[str], cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Windows that a trigger hits, that are no false positives and pass the gates; the first of each kind in a document.

    pages: ``keys``, page, page_text. Gate windows and contexts are those of the document, whose pages are joined by
    line feeds: ``surroundings`` is the page with SURROUNDINGS characters of the document on either side, ``place``
    (from 1) where the trigger stands in it.
    """
    return passing(rules.triggered(page_windows(pages, keys, cfg), *rules.trigger_patterns(taxonomy)), taxonomy, keys, cfg)


def passing(w: DataFrame, taxonomy: Taxonomy, keys: list[str], cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """Of triggered windows those that are no false positives and pass the gates; the first of each kind in a document."""
    fp = rules.first_false_positive(F.concat_ws(" ", "trigger", "window"), taxonomy.false_positives, taxonomy.catch_all, taxonomy.subject_context, taxonomy.lower_case)
    w = w.where(fp.isNull())
    w = w.withColumn("place", F.length("before") + F.col("offset") + F.col("at")).withColumn("surroundings", F.concat("before", "page_text", "after"))
    w = _flags(w, taxonomy, cfg)
    order = ["page", "window_no"]
    codes = [(c, any_hit) for c in taxonomy.codes().values() if c.patterns for any_hit in [F.col("window").rlike("(?i)" + "|".join(f"(?:{x})" for x in c.patterns))]]
    gate = {c.code: taxonomy.gate(c.code) for c, _ in codes}
    gated = any(g != NONE for g in gate.values())
    false = F.lit(False)
    if gated:
        # Hits of the relational roots do not depend on earlier ones: their running maximum is a window function.
        own = false
        for c, hit in codes:
            if c.code.startswith(cfg.relational_roots):
                own = own | (hit & rules.gate_pass(F.lit(gate[c.code]), F.col("actor"), F.col("verb"), F.col("marker"), false))
        w = w.withColumn("root_hit", own)
        w = w.withColumn("earlier", rules.earlier_hit(F.col("root_hit"), keys, order)).withColumn("so_far", rules.earlier_hit(F.col("root_hit"), keys, order, True))
    else:
        w = w.withColumn("earlier", false).withColumn("so_far", false)
    signs = [F.col("actor"), F.col("verb"), F.col("marker")]
    passed = lambda seen: F.array_compact(F.array(*[F.when(hit & _own_gate(gate[c.code], *signs, F.col(seen)), F.lit(c.code)) for c, hit in codes])) if codes else F.array().cast("array<string>")
    w = w.withColumn("passing", passed("earlier")).withColumn("pattern_codes", passed("so_far"))
    if gated:
        two = F.col("actor").cast("int") + F.col("verb").cast("int") + F.col("marker").cast("int") >= 2
        w = w.where((F.size("passing") > 0) | two)
    return windows.first_window_of_each(w, keys, order)


def _own_gate(gate: str, actor, verb, marker, earlier):
    from fathomline.operators.taxonomy import COOCCUR, COOCCUR_VERB, SOFT

    return {COOCCUR: actor, COOCCUR_VERB: actor & verb, SOFT: marker | earlier}.get(gate, F.lit(True))


def detect(pages: DataFrame, taxonomy: Taxonomy, keys: list[str], encoder: score.Encoder = score.hashing_encoder, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """References: keys, page, text (the trigger), context, codes, confidences, method, strength, scores; sentiment is pending.

    Anchors of the taxonomy (few, by nature) are encoded on the driver once.
    """
    return referenced(candidates(pages, taxonomy, keys, cfg), taxonomy, keys, encoder)


def referenced(c: DataFrame, taxonomy: Taxonomy, keys: list[str], encoder: score.Encoder = score.hashing_encoder) -> DataFrame:
    """The references of candidates: scored (unless they have a ``semantic_score``), accepted, classified, with their context."""
    spark = c.sparkSession
    if "semantic_score" in c.columns:
        pass
    elif taxonomy.anchors:
        rows = [(v.tolist(),) for v in encoder(list(taxonomy.anchors))]
        anchors = spark.createDataFrame(rows, "anchor array<double>")
        c = rules.max_similarity(score.encoded(c, "window", encoder), anchors).withColumnRenamed("max_cosine", "semantic_score").drop("embedding")
    else:
        c = c.withColumn("semantic_score", F.lit(0.0))
    n = F.size("pattern_codes")
    a = (F.col("semantic_score"), F.col("is_hard"), n)
    kept = c.where(rules.accepted(*a) | (F.lit(not taxonomy.anchors) & F.col("is_hard")))
    out = rules.classified(kept, taxonomy)
    out = out.withColumn("confidence", rules.confidence(*a)).withColumn("strength", rules.strength(F.col("confidence"))).withColumn("method", rules.method(*a)).withColumn("reasons", rules.reasons(*a))
    out = out.withColumn("context", F.substring(windows.context_sentences(F.col("surroundings"), F.col("place"), F.col("trigger")), 1, 2000))
    dims = [d for d, _ in taxonomy.dimensions]
    out = out.withColumn("dimensions", dimension_json([(d, F.col(f"code_{d}"), F.col(f"conf_{d}")) for d in dims]))
    ab = [F.coalesce(F.col(f"code_{dims[i]}"), F.lit("")) if i < len(dims) else F.lit("") for i in (0, 1)]
    return out.select(*keys, "page", "window_no", F.substring(F.trim("trigger"), 1, 1000).alias("text"), "context", F.col("combined").alias("category"), ab[0].alias("category_a"), ab[1].alias("category_b"), "dimensions", "method", F.round("semantic_score", 4).alias("semantic_score"), "strength", "confidence", "reasons", F.lit("pending").alias("sentiment"), F.lit(0.0).alias("sentiment_score"))


def deduplicated(refs: DataFrame, keys: list[str], threshold: float = 0.6) -> DataFrame:
    """Within a document: exact repeats of a page go, then each reference joins the first similar, more confident one."""
    # A place in the document as one long: windows of a page are fewer than 2^32.
    order = F.shiftleft(F.col("page").cast("long"), 32) + F.col("window_no")
    one = dedup.exact(refs.withColumn("seq", order), [*keys, "page"], "text", "confidence", "seq")
    clusters = dedup.greedy_jaccard(one.select(*keys, "seq", "text", "confidence"), keys, "seq", "text", "confidence", threshold)
    return one.join(clusters.where("seq = cluster").select(*keys, "seq"), [*keys, "seq"], "left_semi").drop("seq")


def with_sentiment(refs: DataFrame, scorer: score.Scorer = score.lexicon_scorer, governance: str | None = vocabulary.GOVERNANCE) -> DataFrame:
    """Pending references with label and probability; governance contexts turn negative into neutral."""
    out = score.compound(refs, scorer)
    label = rules.sentiment_label(F.col("compound"))
    if governance:
        label = rules.governance_adjusted(label, F.concat_ws(" ", "text", "context"), governance)
    pending = F.col("sentiment") == "pending"
    return out.withColumn("sentiment_score", F.when(pending, rules.sentiment_probability(F.col("compound"))).otherwise(F.col("sentiment_score"))).withColumn("sentiment", F.when(pending, label).otherwise(F.col("sentiment"))).drop("compound")


#: What a document's references carry of it.
DOCUMENT_FIELDS = ("company", "year", "position", "industry", "sector", "country", "doc_type")


def analysed(pages: DataFrame, documents: DataFrame, taxonomy: Taxonomy, key: str, encoder: score.Encoder = score.hashing_encoder, scorer: score.Scorer = score.lexicon_scorer, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """The whole run over documents: references found, deduplicated within their document, with sentiment and the document's fields.

    pages: ``key``, page, page_text. documents: ``key`` and any of DOCUMENT_FIELDS; fields that are not there are null,
    further columns are ignored, and so are documents without pages. Pages of documents that are not listed, or whose
    key is null, have no references here. Of documents that repeat a key one counts, the first in the order of its fields.
    """
    have = [c for c in DOCUMENT_FIELDS if c in documents.columns]
    one = documents.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.lit(0).alias("__0"), *have)).alias("__d"))
    fields = one.select(key, *[(F.col(f"__d.{c}") if c in have else F.lit(None).cast("string")).alias(c) for c in DOCUMENT_FIELDS])
    mine = pages.join(one.select(key), key, "left_semi")
    refs = with_sentiment(deduplicated(lineage.kept(detect(mine, taxonomy, [key], encoder, cfg)), [key], cfg.dedup_threshold), scorer)
    return refs.join(fields, key)


def analysed_document(spark: SparkSession, page_texts: list[str | None], fields: dict, taxonomy: Taxonomy, encoder: score.Encoder = score.hashing_encoder, scorer: score.Scorer = score.lexicon_scorer, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """One document by itself: ``analysed`` for its pages, in their order from 1, and its fields. No pages, no references; a null page is an empty one."""
    pages = spark.createDataFrame([(0, i, t) for i, t in enumerate(page_texts, 1)], "doc long, page int, page_text string")
    unknown = set(fields) - set(DOCUMENT_FIELDS)
    if unknown:
        raise ValueError(f"unknown fields: {sorted(unknown)}")
    types = {"year": "int", "position": "int"}
    document = spark.createDataFrame([(0, *fields.values())], ", ".join(["doc long", *[f"{c} {types.get(c, 'string')}" for c in fields]]))
    return analysed(pages, document, taxonomy, "doc", encoder, scorer, cfg).drop("doc")


def for_taxonomies(pages: DataFrame, taxonomies: list[Taxonomy], keys: list[str], encoder: score.Encoder = score.hashing_encoder, cfg: DetectConfig = DetectConfig()) -> DataFrame:
    """The references of several taxonomies in one frame, told apart by ``taxonomy``.

    Pages are read and cut into windows once: every window is looked at for the triggers of all taxonomies in one
    projection, and has a row for each that hits. Those rows, a small part of all, are kept for the taxonomies' own rules.
    """
    w = page_windows(pages, keys, cfg)
    hits = []
    for k, t in enumerate(taxonomies):
        hard, soft = (f"(?i){p}" for p in rules.trigger_patterns(t))
        is_hard = F.col("window").rlike(hard)
        match = lambda f: F.when(is_hard, f(hard)).otherwise(f(soft))  # noqa: B023, E731
        found = F.struct(F.lit(k).alias("k"), is_hard.alias("is_hard"), match(lambda p: F.regexp_extract("window", p, 0)).alias("trigger"), match(lambda p: F.regexp_instr("window", F.lit(p))).alias("at"))
        hits.append(F.when(is_hard | F.col("window").rlike(soft), found))
    rows = w.withColumn("__t", F.explode(F.array_compact(F.array(*hits))))
    rows = lineage.kept(rows.select(*w.columns, "__t.k", "__t.is_hard", "__t.trigger", "__t.at"))
    passed = [passing(rows.where(F.col("k") == k).drop("k"), t, keys, cfg) for k, t in enumerate(taxonomies)]
    anchored = [k for k, t in enumerate(taxonomies) if t.anchors]
    if anchored:
        # Every window that is left in any taxonomy is encoded once, and scored against all anchors at once.
        passed = [lineage.kept(x) if k in anchored else x for k, x in enumerate(passed)]
        distinct = reduce(DataFrame.union, [passed[k].select("window") for k in anchored]).distinct()
        matrices = [np.asarray(encoder(list(taxonomies[k].anchors))) for k in anchored]
        scores = lineage.kept(score.best_of_each(score.encoded(distinct, "window", encoder), matrices).select(F.md5("window").alias("__h"), "scores"))
        for place, k in enumerate(anchored):
            of = scores.select("__h", F.get("scores", F.lit(place)).alias("semantic_score"))
            passed[k] = passed[k].withColumn("__h", F.md5("window")).join(of, "__h").drop("__h")
    return reduce(DataFrame.unionByName, [referenced(x, t, keys, encoder).withColumn("taxonomy", F.lit(t.name)) for x, t in zip(passed, taxonomies, strict=True)])


def document_language(pages: DataFrame, keys: list[str], sample: int = 5, text: str = "page_text") -> DataFrame:
    """The most frequent language of at most ``sample`` evenly spaced pages; of equals the one seen first."""
    from pyspark.sql.window import Window

    w = Window.partitionBy(*keys)
    p = pages.withColumn("__n", F.count("*").over(w)).withColumn("__i", F.row_number().over(w.orderBy("page")) - 1)
    step = F.floor(F.col("__n") / sample)
    p = p.where((F.col("__n") <= sample) | ((F.col("__i") % step == 0) & (F.col("__i") / step < sample)))
    one = p.select(*keys, "__i", tx.script_language(F.col(text)).alias("lang")).groupBy(*keys, "lang").agg(F.count("*").alias("c"), F.min("__i").alias("f"))
    return one.groupBy(*keys).agg(F.max_by("lang", F.struct("c", (-F.col("f")).alias("f"))).alias("language"))


def first_priority_term(c, patterns: tuple[str, ...] = vocabulary.PRIORITY_TERMS):
    """(term, marked text) of the first pattern in order that hits, else the first 50 characters and the text as it is."""
    found = F.coalesce(*[F.nullif(F.regexp_extract(c, f"(?i){p}", 0), F.lit("")) for p in patterns])
    return F.struct(F.coalesce(found, F.substring(c, 1, 50)).alias("term"), F.when(found.isNotNull(), tx.marked(c, found)).otherwise(c).alias("marked"))
