"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Trained by follow-the-regularised-leader (FTRL-proximal) with an elastic-net penalty, then calibrated by a
temperature. The classifier is fitted on a bounded sample of labelled rows (``FitSpec.max_rows`` and ``max_grams``,
documented bounds); executors turn its texts to n-gram counts, so that no text reaches the driver. Predictions read
every text in whole.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm import tokens
from fathomline.llm.shared import cut, own_prefix, small_batches

UNDEFINED = "und"


@dataclass(frozen=True)
class FitSpec:
    """max_rows: labelled rows that the fit uses at most, as many of each language; where there are more languages than
    that, one of each of the most frequent. max_grams: n-grams of these rows that reach the driver at
    most (about; a row's count once for each distinct one, a row of each language always counts). max_cells: size of the
    model's table at most; with so many languages that it does not suffice, n-grams share features.
    bits: of the hashed feature space; sizes: lengths of the n-grams; alpha, beta, l1, l2: of FTRL-proximal;
    held: every so-manieth row of the sample is left out of the training and used for the temperature."""

    max_rows: int = 4000
    max_grams: int = 16_000_000
    max_cells: int = 1 << 23
    bits: int = 16
    sizes: tuple[int, ...] = (1, 2, 3)
    epochs: int = 2
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 1e-3
    l2: float = 1e-3
    held: int = 5


@dataclass
class Model:
    languages: list[str]
    bits: int
    sizes: tuple[int, ...]
    idf: np.ndarray
    weights: np.ndarray  # (features, languages)
    bias: np.ndarray
    temperature: float = 1.0
    extra: dict = field(default_factory=dict)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(text: str, bits: int, sizes: tuple[int, ...], step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """(features, counts) of the hashed character n-grams of the whole text, lower-cased, white space as one space.

    Long texts are hashed in stretches that overlap by an n-gram less one character: none is lost or counted twice.
    """
    text = " " + " ".join(text.lower().split()) + " "
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    total = None
    shift = np.uint64(64 - bits)
    with np.errstate(over="ignore"):
        for lo in range(0, len(code), step):
            found = []
            for n in sizes:
                part = code[lo : lo + step + n - 1]
                if len(part) < n:
                    continue
                h = np.full(len(part) - n + 1, 0x9E3779B97F4A7C15 * n & 0xFFFFFFFFFFFFFFFF, np.uint64)
                for k in range(n):
                    h = (h ^ part[k : len(part) - n + 1 + k]) * np.uint64(0x100000001B3) * np.uint64(0x9E3779B97F4A7C15)
                found.append(h >> shift)
            here = np.bincount(np.concatenate(found).astype(np.int64), minlength=1 << bits)
            total = here if total is None else total + here
    at = np.flatnonzero(total).astype(np.int32)
    return at, total[at].astype(np.int32)


def tfidf(text: str, idf: np.ndarray, bits: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    at, n = ngram_counts(text, bits, sizes)
    x = (1.0 + np.log(n)) * idf[at]
    return at, x / max(np.sqrt((x**2).sum()), 1e-12)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def table_bits(n_languages: int, spec: FitSpec) -> int:
    """How many bits of features the model's table has room for."""
    return max(1, min(spec.bits, int(spec.max_cells // max(1, n_languages)).bit_length() - 1))


def fit(texts: list[str], labels: list[str], spec: FitSpec = FitSpec()) -> Model:
    """Trains on ``texts`` in the order given. Fewer than one text with a letter gives a model that knows no language."""
    pairs = [(t, y) for t, y in zip(texts, labels, strict=True) if has_letter(t)]
    bits = table_bits(len({y for _, y in pairs}), spec)
    return fit_counts([ngram_counts(t, bits, spec.sizes) for t, _ in pairs], [y for _, y in pairs], bits, spec)


def fit_counts(grams: list[tuple[np.ndarray, np.ndarray]], labels: list[str], bits: int, spec: FitSpec = FitSpec()) -> Model:
    """Trains on n-gram counts in the order given; ``grams`` is used up."""
    languages = sorted(set(labels))
    size, n_lang, n_rows = 1 << bits, len(languages), len(labels)
    seen = np.zeros(size)
    for at, _ in grams:
        seen[at] += 1
    idf = np.log((1.0 + n_rows) / (1.0 + seen)) + 1.0
    # The table has rows for the features that occur; the last one is the bias.
    active = np.flatnonzero(seen)
    row_of = np.zeros(size, np.int32)
    row_of[active] = np.arange(len(active))
    bias, rows = len(active), []
    for k, (at, n) in enumerate(grams):
        grams[k] = None
        x = (1.0 + np.log(n)) * idf[at]
        rows.append((row_of[at], (x / max(np.sqrt((x**2).sum()), 1e-12)).astype(np.float32)))
    number = {v: i for i, v in enumerate(languages)}
    y = np.array([number[v] for v in labels], int)
    z, n2 = np.zeros((bias + 1, n_lang)), np.zeros((bias + 1, n_lang))
    order = np.random.Generator(np.random.PCG64(7)).permutation(n_rows)
    train = [i for k, i in enumerate(order) if k % spec.held or len(order) < 2 * spec.held]
    hold = [i for k, i in enumerate(order) if not k % spec.held]

    def weights(zi, ni, l1):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((spec.beta + np.sqrt(ni)) / spec.alpha + spec.l2))

    for _ in range(spec.epochs if n_lang > 1 else 0):
        for i in train:
            at, x = rows[i]
            at, x = np.append(at, bias), np.append(x, 1.0)
            zi, ni = z[at], n2[at]
            l1 = np.where(at == bias, 0.0, spec.l1)[:, None]  # the bias is not penalised by l1
            wi = weights(zi, ni, l1)
            p = _softmax(x @ wi)
            p[y[i]] -= 1.0
            g = x[:, None] * p[None, :]
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / spec.alpha * wi
            n2[at] = ni + g * g
    l1 = np.full((bias + 1, 1), spec.l1)
    l1[bias] = 0.0
    w = weights(z, n2, l1)
    del z, n2
    table = np.zeros((size, n_lang))
    table[active] = w[:bias]
    model = Model(languages, bits, spec.sizes, idf, table, w[bias])
    if n_lang > 1 and hold:
        logits = np.stack([rows[i][1] @ w[rows[i][0]] + model.bias for i in hold])
        model.temperature = calibrate(logits, y[hold])
    return model


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least log loss on held-out rows, by golden-section search over its logarithm, within 1/20 and 20."""
    def loss(t: float) -> float:
        p = _softmax(logits / np.exp(t))
        return float(-np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean())

    lo, hi, g = -np.log(20.0), np.log(20.0), (np.sqrt(5.0) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and probability for each text; ``und`` and 0 where it is null or has no letter, or no language was learned."""
    out, score = [], []
    for t in texts:
        if not model.languages or not has_letter(t):
            out.append(UNDEFINED)
            score.append(0.0)
            continue
        at, x = tfidf(t, model.idf, model.bits, model.sizes)
        p = _softmax((x @ model.weights[at] + model.bias) / model.temperature)
        k = int(p.argmax())
        out.append(model.languages[k])
        score.append(float(min(1.0, p[k])))
    return out, score


def held_out(doc_id: Column) -> Column:
    """True for documents that must not be learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_sample(docs: DataFrame, spec: FitSpec = FitSpec(), doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fits on at most ``max_rows`` documents, as many of each language where there are, those with the smallest hashes of their ids, none held out.

    Rows with a null label or text are not learned from, nor are texts without a letter. Of rows that share an id and a
    label one counts, that with the smallest hash of its text, so ties have a defined order. Long texts count in whole.
    An empty table gives a model that knows no language. Further columns are ignored.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id)))
    # How many ids of a language have a hash of so many bits: from this, without a sort, the number of bits that enough
    # of them, and not many more, keep to.
    bits_of = lambda h: F.length(F.bin(h))
    counts = cut(rows.select(F.col(lang).alias("lang"), bits_of(F.xxhash64(doc_id)).alias("b")).groupBy("lang", "b").count())
    n_lang = counts.select("lang").distinct().count()
    if not n_lang:
        return fit([], [], spec)
    each, bits = max(1, spec.max_rows // n_lang), table_bits(min(n_lang, spec.max_rows), spec)
    upto = counts.withColumn("upto", F.sum("count").over(Window.partitionBy("lang").orderBy("b")))
    edges = upto.groupBy("lang").agg(F.max("upto").alias("n"), F.coalesce(F.min(F.when(F.col("upto") >= each, F.col("b"))), F.lit(64)).alias("__b"))
    edges = edges.orderBy(F.desc("n"), "lang").limit(spec.max_rows).select(F.col("lang").alias("__lang"), "__b")
    # ``edges`` has ``max_rows`` rows at most: proven small enough to be sent.
    sample = rows.select(F.col(lang).alias("lang"), F.xxhash64(doc_id).alias("h"), F.col(text).alias("text"))
    sample = sample.join(F.broadcast(edges), (F.col("lang") == F.col("__lang")) & (bits_of(F.col("h")) <= F.col("__b")))
    sample = sample.groupBy("lang", "h").agg(F.min(F.struct(F.xxhash64("text").alias("tie"), F.col("text"))).alias("t")).select("lang", "h", F.col("t.text").alias("text"))

    def count(batches):
        for pdf in batches:
            out = [(a, h, *(x.tobytes() for x in ngram_counts(t, bits, spec.sizes))) for a, h, t in zip(pdf["lang"], pdf["h"], pdf["text"], strict=True) if has_letter(t)]
            yield pd.DataFrame(out, columns=["lang", "h", "at", "n"])

    counted = cut(small_batches(sample).mapInPandas(count, "lang string, h long, at binary, n binary"))
    # Which of them fit: the least hashes first, languages in turns, until the rows or the n-grams suffice.
    sizes = counted.select("lang", "h", (F.length("at") / 4).cast("long").alias("grams")).toPandas()
    sizes["u"] = sizes["h"].to_numpy(np.int64).view(np.uint64)
    sizes = sizes.sort_values(["lang", "u"])
    sizes["turn"] = sizes.groupby("lang").cumcount()
    sizes = sizes[sizes["turn"] < each].sort_values(["turn", "u", "lang"])
    good = sizes[(sizes["grams"].cumsum() <= spec.max_grams) | (sizes["turn"] == 0)]
    chosen = docs.sparkSession.createDataFrame([(x, int(h)) for x, h in zip(good["lang"], good["h"], strict=True)], "__lang string, __h long")
    got = counted.join(F.broadcast(chosen), (F.col("lang") == F.col("__lang")) & (F.col("h") == F.col("__h"))).select("lang", "h", "at", "n").collect()
    got.sort(key=lambda r: (r["h"] % (1 << 64), r["lang"]))
    return fit_counts([(np.frombuffer(r["at"], np.int32), np.frombuffer(r["n"], np.int32)) for r in got], [r["lang"] for r in got], bits, spec)


def identify(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (or other ``names``), which replace columns of those names; all others stay.

    A null text, or one without a letter, is ``und`` with score 0. Texts count in whole. Of languages with equal
    probabilities the first in the order of their names is predicted; repeated rows are judged one by one; an empty
    table stays empty.
    """
    active = np.flatnonzero(np.abs(model.weights).sum(1))
    packed = (model.languages, model.bits, model.sizes, model.idf.astype(np.float32), active, model.weights[active].astype(np.float32), model.bias, model.temperature)
    sent = docs.sparkSession.sparkContext.broadcast(packed)
    loaded: dict[int, Model] = {}

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        if 0 not in loaded:
            tokens.forget()
            languages, bits, sizes, idf, at, w, bias, temperature = sent.value
            weights = np.zeros((1 << bits, len(languages)))
            weights[at] = w
            loaded[0] = Model(languages, bits, sizes, idf.astype(float), weights, bias, temperature)
        out, score = predict(loaded[0], list(texts))
        return pd.DataFrame({"lang_pred": out, "score": score})

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    own = own_prefix(docs.columns)
    # Called non-deterministic, so that a filter on its results does not have it run twice.
    both = small_batches(docs).select(*rest, run.asNondeterministic()(F.col(text)).alias(own))
    return both.select(*rest, F.col(f"{own}.lang_pred").alias(names[0]), F.col(f"{own}.score").alias(names[1]))
