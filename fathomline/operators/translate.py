"""Translation of fragments: selection, injected engines, backfill, coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_CHARS = 1000


def needs_translation(language: Column, text: Column, translated: Column) -> Column:
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    return (F.coalesce(language, F.lit("en")) != "en") & ~blank(text) & blank(translated)


def with_english(df: DataFrame, language: str, text: str, translated: str) -> DataFrame:
    """Where the language is English or unknown and no translation is there, the text is its own."""
    own = (F.coalesce(language, F.lit("en")) == "en") & (F.col(translated).isNull() | (F.trim(translated) == ""))
    return df.withColumn(translated, F.when(own, F.col(text)).otherwise(F.col(translated)))


def translated(df: DataFrame, text: str, language: str, engines: list[tuple[str, Callable[[str, str], str]]]) -> DataFrame:
    """With ``translation`` and ``engine``: engines are tried in order, texts are cut to MAX_CHARS, blank ones pass through. Each distinct text of a batch is translated once."""
    schema = "translation string, engine string"

    @F.pandas_udf(schema)
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, languages in parts:
            seen: dict[tuple, tuple] = {}
            rows = []
            for t, lang in zip(texts, languages, strict=True):
                if (t, lang) not in seen:
                    out = (t, "none")
                    if t and t.strip():
                        for name, engine in engines:
                            try:
                                out = (engine(t[:MAX_CHARS], lang), name)
                                break
                            except Exception:  # noqa: BLE001  an engine may fail in any way; the next one is tried
                                continue
                    seen[t, lang] = out
                rows.append(seen[t, lang])
            yield pd.DataFrame(rows, columns=["translation", "engine"])

    return df.withColumn("__t", run(F.col(text), F.col(language))).select(*df.columns, "__t.translation", "__t.engine")


def available(engines: dict[str, Callable[[], Callable[[str, str], str]]]) -> list[tuple[str, Callable[[str, str], str]]]:
    """The engines that can be made here, in the order given: a factory that fails (a missing library or key) leaves its engine out."""
    out = []
    for name, make in engines.items():
        try:
            out.append((name, make()))
        except Exception:  # noqa: BLE001  whatever an engine lacks, the others remain
            continue
    return out


def by_engine(df: DataFrame, language: str, translated_: str, context: str, engine: str, engines: list[str]) -> DataFrame:
    """For each language: fragments, translated and pending ones, translated contexts, and how many each engine translated."""
    filled = lambda c: F.count_if(F.coalesce(F.col(c), F.lit("")) != "")
    g = df.groupBy(language).agg(F.count("*").alias("total"), filled(translated_).alias("translated"), filled(context).alias("context_translated"), *[F.count_if(F.col(engine) == e).alias(f"via_{e}") for e in engines])
    return g.withColumn("pending", F.col("total") - F.col("translated"))


def coverage(df: DataFrame, language: str, translated_: str) -> DataFrame:
    """Total, translated and pending fragments of each language but English."""
    g = df.where(F.coalesce(language, F.lit("en")) != "en").groupBy(language).agg(F.count("*").alias("total"), F.count_if(F.coalesce(F.trim(translated_), F.lit("")) != "").alias("translated"))
    return g.withColumn("pending", F.col("total") - F.col("translated"))
