"""Encoders and sentiment scorers: injected callables, with deterministic defaults."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str]], list[float]]
SENTIMENT_CHARS = 512

#: A small lexicon for the default scorer.
POSITIVE = ("growth", "improve", "improved", "strong", "success", "successful", "benefit", "gain", "efficient", "innovation", "opportunity", "leading", "good", "better", "best", "enhance", "enhanced", "progress")
NEGATIVE = ("risk", "loss", "decline", "weak", "failure", "fail", "failed", "problem", "threat", "adverse", "bad", "worse", "worst", "breach", "harm", "concern", "negative", "penalty")


def hashing_encoder(texts: list[str], dims: int = 256) -> np.ndarray:
    """Words and character trigrams hashed into a vector of unit length."""
    out = np.zeros((len(texts), dims), np.float32)
    for i, t in enumerate(texts):
        words = re.findall(r"\w+", (t or "").lower())
        for w in words:
            grams = [w, *(f"#{w}#"[k : k + 3] for k in range(len(w)))]
            for g in grams:
                h = zlib.crc32(g.encode())
                out[i, h % dims] += 1.0 if h >> 31 else -1.0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def lexicon_scorer(texts: list[str]) -> list[float]:
    """A compound in [-1, 1] from counts of good and bad words."""
    out = []
    for t in texts:
        words = re.findall(r"\w+", (t or "").lower())
        d = sum(w in POSITIVE for w in words) - sum(w in NEGATIVE for w in words)
        out.append(d / (d * d + 15) ** 0.5)
    return out


def by_language(df: DataFrame, text: str, language: str, encoders: dict[str, Encoder], default: Encoder = hashing_encoder, name: str = "embedding") -> DataFrame:
    """With the vector of each text by the encoder of its language; a language without one has ``default``. An encoder is made where it is first called."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, languages in parts:
            out = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            kinds = languages.where(languages.isin(list(encoders)), "")
            for kind in kinds.unique():
                at = kinds.index[kinds == kind]
                for i, v in zip(at, encoders.get(kind, default)(list(texts[at].fillna(""))), strict=True):
                    out[i] = v
            yield out

    return df.withColumn(name, run(F.col(text), F.col(language)))


def encoded(df: DataFrame, text: str, encoder: Encoder = hashing_encoder, name: str = "embedding") -> DataFrame:
    """With the vector of each text; a batch encodes each distinct text once."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            codes, distinct = pd.factorize(texts.fillna(""))
            vectors = encoder(list(distinct)) if len(distinct) else np.zeros((0, 1))
            yield pd.Series([vectors[c] for c in codes], index=texts.index)

    return df.withColumn(name, run(F.col(text)))


def best_of_each(df: DataFrame, anchors: list[np.ndarray], vector: str = "embedding", name: str = "scores") -> DataFrame:
    """With the highest cosine of the vector to the anchors of each group, as an array in the order of the groups; null for a group without anchors.

    ``anchors``: a matrix for each group; all of them are one product for a batch. A zero vector is at 0 to every anchor.
    """
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    filled = [k for k, a in enumerate(anchors) if len(a)]
    starts = np.cumsum([0, *(len(anchors[k]) for k in filled)])[:-1]

    @F.pandas_udf("array<double>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        every = unit(np.concatenate([anchors[k] for k in filled]).astype(float)) if filled else None
        for vectors in parts:
            out = np.full((len(vectors), len(anchors)), np.nan)
            if filled and len(vectors):
                out[:, filled] = np.maximum.reduceat(unit(np.stack(vectors.to_numpy()).astype(float)) @ every.T, starts, axis=1)
            yield pd.Series([[None if x != x else x for x in row] for row in out.tolist()], index=vectors.index, dtype=object)

    return df.withColumn(name, run(F.col(vector)))


def compound(df: DataFrame, scorer: Scorer = lexicon_scorer, text: str = "text", context: str = "context", name: str = "compound") -> DataFrame:
    """With the compound sentiment of text and context, cut to SENTIMENT_CHARS characters."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            yield pd.Series(scorer(list(texts.fillna(""))), index=texts.index, dtype="float64")

    return df.withColumn(name, run(F.substring(F.concat_ws(" ", text, context), 1, SENTIMENT_CHARS)))
