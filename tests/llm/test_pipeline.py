"""The pipeline, stage by stage, against plain Python."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fathomline.llm import language_id, quality_rules

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_texts import WORD, base_measures, whole_ids  # noqa: E402
from test_vectors_and_graphs import brute_components  # noqa: E402

ODD = [
    (10_001, None, "en", "src0", 0), (10_002, "", "fr", None, 0), (10_003, "1234 !? " * 60, "en", "src1", 5), (10_004, "wort " * 30000, None, "src1", 5),
    (None, "the of and to in is that for it as was with be by on not he this are or his from at which but have " * 3, "en", "src2", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    twice = real.where("doc_id in (3, 5)").withColumn("doc_id", F.col("doc_id") + 20_000)
    odd = spark.createDataFrame(ODD, real.schema)
    out = real.union(twice).union(odd)
    return out.withColumn("score", F.lit("clash")).withColumn("kept", F.lit("clash")).withColumn("size", F.lit("clash"))


def rows_of(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_language_stage(spark, docs):
    out = corpus_pipeline.language(spark, docs, "")
    assert out.columns == docs.columns
    model = language_id.fit_sample(docs)
    every = docs.collect()
    pred, score = language_id.predict(model, [r["text"] for r in every])
    want = [(r["doc_id"], r["text"]) for r, p, s in zip(every, pred, score, strict=True) if p != "und" and s >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    assert rows_of(out) == sorted(want, key=str) and len(want) >= 200
    lang = {(r["doc_id"], r["text"]): r["lang"] or p for r, p in zip(every, pred, strict=True)}
    assert all(r["lang"] == lang[r["doc_id"], r["text"]] is not None for r in out.collect())
    assert corpus_pipeline.language(spark, docs.limit(0), "").count() == 0
    assert out._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1


def python_verdict(text):
    n, chars, symbols, dup, repeat, failed = base_measures(text)
    t = text or ""
    stops = {w for v in quality_rules.STOP_WORDS.values() for w in v}
    m = {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "n_lines": sum(bool(WORD.search(x)) for x in t.split("\n")),
        "n_stop_words": sum(w.rstrip(".,;:!?").lower() in stops for w in WORD.findall(t)), "n_listed_words": n if 2 * len(t.encode()) <= 3 * len(t) else 0, "n_letters": sum(c.isalpha() for c in t), "n_upper": sum(c.isupper() for c in t),
    }
    for r in quality_rules.THRESHOLDS:
        under = m[r.denominator] if r.denominator else 1
        if under and ((r.low is not None and m[r.numerator] < r.low * under) or (r.high is not None and m[r.numerator] > r.high * under)):
            return False
    return not failed


def test_quality_stage(spark, docs):
    out = corpus_pipeline.quality(spark, docs, "")
    assert out.columns == docs.columns
    assert rows_of(out) == sorted(((r["doc_id"], r["text"]) for r in docs.collect() if python_verdict(r["text"])), key=str)
    assert corpus_pipeline.quality(spark, docs.limit(0), "").count() == 0


def test_near_duplicate_stage(spark, docs):
    few = docs.where("doc_id is null or doc_id < 90 or doc_id > 9999")
    out = corpus_pipeline.near_duplicates(spark, few, "")
    assert out.columns == docs.columns
    rows = [(r["doc_id"], r["text"]) for r in few.collect()]
    ids = {i for i, _, c in brute_components(rows, 5, 80) if i == c}
    assert rows_of(out) == sorted(((i, t) for i, t in rows if i in ids), key=str)
    assert not {20_003, 20_005} & {i for i, _ in rows_of(out)}


def test_mixture_and_packing_stages(spark, docs):
    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.columns == docs.columns
    total = sum(len(WORD.findall(r["text"] or "")) for r in docs.collect())
    got = mixed.collect()
    assert abs(sum(len(WORD.findall(r["text"])) for r in got) - total) < 0.05 * total
    assert corpus_pipeline.mixture(spark, docs.limit(0), "").count() == 0
    few = docs.where("doc_id is null or doc_id < 40 or doc_id > 9999")
    packed = corpus_pipeline.pack(spark, few, "").toPandas()
    ids = whole_ids([r["text"] for r in few.collect()])
    assert packed["length"].sum() == sum(map(len, ids))
    whole = {zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids if len(x) in (512, 256, 128) or len(x) < 128}
    assert whole <= set(packed["ids_crc32"])


def test_whole_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    assert len(out) and (out.groupby("sequence_id")["length"].sum() <= 1024).all()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "near_duplicates", "mixture", "packing"]


def test_tables_of_former_stages_go(spark, docs):
    from pathlib import Path
    from urllib.parse import urlparse

    from fathomline.llm.shared import dropped, written

    one, two = written(docs, "one"), written(docs.limit(3), "two")
    here = [Path(urlparse(t.inputFiles()[0]).path).parent for t in (one, two)]
    dropped(one)
    assert [p.exists() for p in here] == [False, True] and two.count() == 3
    dropped(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))  # not in the shared folder: stays
    assert Path("/root/testdata/sf0.001/region.parquet").exists()
