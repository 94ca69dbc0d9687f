"""Taxonomies: plain data, compiled to expressions where it is needed.

A taxonomy has ordered dimensions of ordered codes with keywords (in tiers) and patterns, groups of patterns
that show false positives, anchor phrases, gate terms and weights. No state is kept anywhere: operators take
the taxonomy as a parameter.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import AnalysisException, IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import vocabulary

NONE, COOCCUR, COOCCUR_VERB, SOFT = "none", "cooccur", "cooccur_verb", "soft"


@dataclass(frozen=True)
class Code:
    code: str
    name: str = ""
    keywords: tuple[tuple[str, int], ...] = ()  # (keyword, tier); tier 2 where none is stated
    patterns: tuple[str, ...] = ()
    gate: str = NONE


@dataclass(frozen=True)
class Weights:
    pattern: float = 0.5
    tiers: tuple[float, float, float] = (0.4, 0.25, 0.1)


@dataclass(frozen=True)
class Taxonomy:
    name: str
    dimensions: tuple[tuple[str, tuple[Code, ...]], ...]
    version: str = "1"
    false_positives: tuple[tuple[str, tuple[str, ...]], ...] = ()
    catch_all: tuple[str, ...] = ()  # false-positive patterns that a context of the subject overrules
    subject_context: str | None = None
    hard_triggers: str | None = None
    soft_triggers: str | None = None
    anchors: tuple[str, ...] = ()
    actors: tuple[str, ...] = ()
    verbs: tuple[str, ...] = ()
    markers: tuple[str, ...] = ()
    weights: Weights = field(default_factory=Weights)
    lower_case: bool = True
    # Hooks: from the text around a trigger to a boolean column, instead of the lists of actors, verbs and markers.
    has_actor: Callable[[Column], Column] | None = None
    has_verb: Callable[[Column], Column] | None = None
    has_marker: Callable[[Column], Column] | None = None
    gate_of: Callable[[str], str] | None = None  # the gate of a code, instead of the code's own

    def gate(self, code: str) -> str:
        """The gate of a code: what ``gate_of`` says, else its own; that of an unknown code is NONE."""
        return self.gate_of(code) if self.gate_of else self.codes()[code].gate if code in self.codes() else NONE

    def codes(self) -> dict[str, Code]:
        return {c.code: c for _, codes in self.dimensions for c in codes}

    def keyword_tier(self, code: str, keyword: str) -> int:
        return dict(self.codes()[code].keywords).get(keyword, 2) if code in self.codes() else 2

    def keywords(self) -> list[str]:
        return list(dict.fromkeys(k for c in self.codes().values() for k, _ in c.keywords))

    def patterns(self) -> list[str]:
        return list(dict.fromkeys(p for c in self.codes().values() for p in c.patterns))

    def checked(self) -> tuple[Taxonomy, list[str]]:
        """The taxonomy without patterns that do not compile, and those patterns."""
        bad: list[str] = []

        java = SparkContext._active_spark_context

        def good(p: str) -> bool:
            try:
                # Java runs the patterns, so Java judges them where it is there; without a session Python does.
                java._jvm.java.util.regex.Pattern.compile(p) if java else re.compile(p)
            except (re.error, Py4JJavaError, IllegalArgumentException):
                bad.append(p)
                return False
            return True

        dims = tuple((d, tuple(Code(c.code, c.name, c.keywords, tuple(filter(good, c.patterns)), c.gate) for c in codes)) for d, codes in self.dimensions)
        fps = tuple((g, tuple(filter(good, ps))) for g, ps in self.false_positives)
        return Taxonomy(**(self.__dict__ | {"dimensions": dims, "false_positives": fps})), bad

    def merged(self, more: dict[str, tuple[str, ...]], tier: int = 1) -> Taxonomy:
        """With further keywords by code; those that are there already stay as they are."""
        dims = tuple((d, tuple(Code(c.code, c.name, c.keywords + tuple((k, tier) for k in dict.fromkeys(more.get(c.code, ())) if k not in dict(c.keywords)), c.patterns, c.gate) for c in codes)) for d, codes in self.dimensions)
        return Taxonomy(**(self.__dict__ | {"dimensions": dims}))


def current_code(c: Column) -> Column:
    """The code of a category of the earlier list; any other stays as it is."""
    known = F.create_map(*[F.lit(x) for pair in vocabulary.FORMER_CATEGORIES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, c), c)


_registry: dict[str, Taxonomy] = {}


def register(taxonomy: Taxonomy) -> Taxonomy:
    _registry[taxonomy.name] = taxonomy
    return taxonomy


def by_name(name: str) -> Taxonomy:
    if name not in _registry:
        raise KeyError(f"no taxonomy {name!r}; known: {sorted(_registry)}")
    return _registry[name]


def terms(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    """The taxonomy as rows: dim, dim_ord, code, code_ord, kind, term, tier, weight. As many as the taxonomy has terms."""
    rows = []
    for d, (dim, codes) in enumerate(taxonomy.dimensions):
        for k, c in enumerate(codes):
            rows += [(dim, d, c.code, k, "pattern", p, 0, taxonomy.weights.pattern) for p in c.patterns]
            rows += [(dim, d, c.code, k, "keyword", w, t, taxonomy.weights.tiers[t - 1]) for w, t in c.keywords]
    return spark.createDataFrame(rows, "dim string, dim_ord int, code string, code_ord int, kind string, term string, tier int, weight double")


def sheet_terms(categories: DataFrame, keywords: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """The terms of sheets that are tables: dim, code, kind, term, tier. Categories(dimension, code), Keywords(code, keyword, tier), Patterns(code, pattern).

    A keyword without a tier is of the second; terms of codes that the categories lack, and null ones, are left out;
    of a term that a code has twice the lowest tier counts. The tables may be of any size: nothing comes to the driver.
    """
    dims = categories.where("code is not null").groupBy("code").agg(F.min("dimension").alias("dim"))
    rows = keywords.select("code", F.lit("keyword").alias("kind"), F.col("keyword").alias("term"), F.coalesce(F.col("tier").try_cast("int"), F.lit(2)).alias("tier"))
    if patterns is not None:
        rows = rows.unionByName(patterns.select("code", F.lit("pattern").alias("kind"), F.col("pattern").alias("term"), F.lit(0).alias("tier")))
    one = rows.where("term is not null").groupBy("code", "kind", "term").agg(F.min("tier").alias("tier"))
    return one.join(dims, "code").select("dim", "code", "kind", "term", "tier")


def merged_terms(terms: DataFrame, more: DataFrame, tier: int = 1) -> DataFrame:
    """``terms`` with further keywords (code, term): those that a code has already stay as they are, those of unknown codes are left out."""
    have = terms.where("kind = 'keyword'").select("code", "term")
    fresh = more.select("code", "term").where("term is not null").distinct().join(have, ["code", "term"], "left_anti")
    dims = terms.groupBy("code").agg(F.min("dim").alias("dim"))
    return terms.select("dim", "code", "kind", "term", "tier").unionByName(fresh.join(dims, "code").select("dim", "code", F.lit("keyword").alias("kind"), "term", F.lit(tier).alias("tier")))


def with_tiers(found: DataFrame, terms: DataFrame, code: str = "code", keyword: str = "keyword") -> DataFrame:
    """``found`` with the tier of each keyword in its code: the second where the code does not have it."""
    tiers = terms.where("kind = 'keyword'").groupBy(F.col("code").alias("__code"), F.col("term").alias("__term")).agg(F.min("tier").alias("__tier"))
    met = found.join(tiers, (F.col(code) == F.col("__code")) & (F.col(keyword) == F.col("__term")), "left")
    return met.withColumn("tier", F.coalesce("__tier", F.lit(2))).drop("__code", "__term", "__tier")


def term_statistics(terms: DataFrame) -> DataFrame:
    """By dimension: codes, keywords, patterns."""
    return terms.groupBy("dim").agg(F.count_distinct("code").alias("codes"), F.count_if(F.col("kind") == "keyword").alias("keywords"), F.count_if(F.col("kind") == "pattern").alias("patterns"))


def statistics(spark: SparkSession, taxonomy: Taxonomy) -> DataFrame:
    return term_statistics(terms(spark, taxonomy))


def from_sheets(name: str, categories: list[dict], keywords: list[dict], patterns: list[dict] = (), fp_patterns: list[dict] = (), meta: dict | None = None) -> Taxonomy:
    """A taxonomy from tables: Categories(dimension, code, name), Keywords(code, keyword, tier), Patterns(code, pattern), FP_Patterns(fp_category, pattern)."""
    for sheet, rows, needed in (("Categories", categories, ("dimension", "code")), ("Keywords", keywords, ("code", "keyword")), ("Patterns", patterns, ("code", "pattern")), ("FP_Patterns", fp_patterns, ("fp_category", "pattern"))):
        for row in rows:
            if missing := [c for c in needed if not row.get(c)]:
                raise ValueError(f"{sheet}: a row lacks {missing}")
    dims: dict[str, list[Code]] = {}
    for row in categories:
        code = row["code"]
        kw = tuple((r["keyword"], int(r.get("tier") or 2)) for r in keywords if r["code"] == code)
        pt = tuple(r["pattern"] for r in patterns if r["code"] == code)
        dims.setdefault(row["dimension"], []).append(Code(code, row.get("name") or code, kw, pt))
    fps: dict[str, list[str]] = {}
    for row in fp_patterns:
        fps.setdefault(row["fp_category"], []).append(row["pattern"])
    meta = meta or {}
    return Taxonomy(meta.get("taxonomy_name") or name, tuple((d, tuple(c)) for d, c in dims.items()), str(meta.get("version") or "1"), tuple((g, tuple(p)) for g, p in fps.items()), weights=Weights(0.7, (0.8, 0.6, 0.4)), lower_case=False)


SHEETS = ("Categories", "Keywords", "Patterns", "FP_Patterns", "Taxonomy_Meta")


def _clean(rows: list[dict]) -> list[dict]:
    """Rows with stripped, lower-cased names and stripped texts, without empty ones."""
    text = lambda v: "" if v is None or v != v else str(v).strip()
    found = [{str(k or "").strip().strip("\ufeff").lower(): text(v) for k, v in r.items()} for r in rows]
    return [r for r in found if any(r.values())]


def _from_tables(name: str, tables: dict[str, list[dict]]) -> Taxonomy:
    of = {k: _clean(tables.get(k, [])) for k in SHEETS}
    return from_sheets(name, of["Categories"], of["Keywords"], of["Patterns"], of["FP_Patterns"], of["Taxonomy_Meta"][0] if of["Taxonomy_Meta"] else None)


def read_sheets(folder: str, spark: SparkSession | None = None) -> Taxonomy:
    """A taxonomy from CSV files named after their sheets; header names are stripped and lower-cased, empty rows left out.

    With a session (the active one, if none is given) the folder may be on any file system that Spark reads. A
    taxonomy's terms are few and end up in plans, so they are brought to the driver.
    """
    import csv
    import os

    spark = spark or SparkSession.getActiveSession()

    def rows(name: str) -> list[dict]:
        path = f"{folder.rstrip('/')}/{name}.csv"
        if spark is None:
            if not os.path.exists(path):
                return []
            with open(path, newline="", encoding="utf-8-sig") as f:
                return list(csv.DictReader(f))
        try:
            return [r.asDict() for r in spark.read.csv(path, header=True, escape='"', multiLine=True).collect()]
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    return _from_tables(os.path.basename(folder.rstrip("/")), {n: rows(n) for n in SHEETS})


def read_workbook(path: str) -> Taxonomy:
    """A taxonomy from a workbook with these sheets, where a reader of workbooks is installed."""
    import os

    import pandas as pd

    book = pd.read_excel(path, sheet_name=None, dtype=str)
    return _from_tables(os.path.splitext(os.path.basename(path))[0], {n: book[n].to_dict("records") for n in SHEETS if n in book})
