"""Readers: pages, metadata, labelled data, configuration, documents in binary form."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomline.operators import lineage, windows

#: Kinds of documents by words in file names, in this order.
DOC_TYPES = (
    ("annual", "Annual Report"), ("sustainability", "Sustainability"), ("proxy", "Proxy"), ("quarterly", "Quarterly Report"), ("10k", "Annual Report"),
    ("10q", "Quarterly Report"), ("def14a", "Proxy"), ("esg", "Sustainability"), ("csr", "Sustainability"),
)


def discover(spark: SparkSession, folder: str, pattern: str = "*.pdf", recursive: bool = True) -> DataFrame:
    """Paths, sizes and contents of the files of a folder; the content is read only if it is used."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive).load(folder)


def below(spark: SparkSession, folder: str, path: str = "path") -> Column:
    """A path from ``folder`` on, without the folder itself; the path as it stands where it is not below it."""
    where, fs = lineage._file_system(spark, folder)
    base = fs.makeQualified(where).toString().rstrip("/") + "/"
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(F.col(path))


def table_name(path: Column, suffix: str = ".parquet") -> Column:
    """The first part of a path that has the suffix: a table's own file, or the folder of its files."""
    return F.get(F.filter(F.split(path, "/"), lambda x: x.endswith(suffix)), F.lit(0))


def first_paths(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy("path").limit(n)


def extract_pages(files: DataFrame, extractor: Callable[[bytes], tuple[list[str], str]]) -> DataFrame:
    """path, status, pages by an injected extractor; a failure gives the status ``error`` and no page."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    pages, status = extractor(bytes(content))
                except Exception:  # noqa: BLE001  a damaged file must not end the job
                    pages, status = [], "error"
                rows.append((path, status, pages))
            yield pd.DataFrame(rows, columns=["path", "status", "pages"])

    return files.select("path", "content").mapInPandas(run, "path string, status string, pages array<string>")


#: Fewer characters a page than this on average: a scanned document.
SCANNED_CHARS = 50


def extract_documents(files: DataFrame, readers: list[Callable[[bytes], list[str]]], ocr: Callable[[bytes], list[str]] | None = None, markers: list[str] | None = None) -> DataFrame:
    """path, text_status, pages: each file by the first of ``readers`` that reads it, scanned ones by ``ocr``, mirrored pages blanked.

    text_status: corrupted_ocr_failed where no reader reads the file, or a scanned one is not recognised; else empty
    where no page has text; else corrupted_ocr_success where it was recognised; else mirrored_all_stripped where all
    pages were mirrored; else valid. A page that is null is an empty one. Contents are read by the executors; what a
    reader does with them is its own.
    """
    first = list(readers)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                raw, pages, status = bytes(content or b""), None, "valid"
                for read in first:
                    try:
                        pages = [x or "" for x in read(raw)]
                        break
                    except Exception:  # noqa: BLE001  a damaged file must not end the job; the next reader is tried
                        continue
                if pages is None:
                    rows.append((path, "corrupted_ocr_failed", []))
                    continue
                if pages and sum(map(len, pages)) / len(pages) < SCANNED_CHARS:
                    status = "corrupted_ocr_success"
                    try:
                        if ocr is None:
                            raise ValueError("no recognition")
                        pages = [x or "" for x in ocr(raw)]
                    except Exception:  # noqa: BLE001
                        status = "corrupted_ocr_failed"
                rows.append((path, status, pages))
            yield pd.DataFrame(rows, columns=["path", "text_status", "pages"])

    out = files.select("path", "content").mapInPandas(run, "path string, text_status string, pages array<string>")
    has_text = lambda pages: F.exists(pages, lambda x: F.trim(x) != "")
    unreadable = F.col("text_status") == "corrupted_ocr_failed"
    out = out.withColumn("text_status", F.when(~has_text(F.col("pages")) & ~(unreadable & (F.size("pages") == 0)), "empty").otherwise(F.col("text_status")))
    blank = F.transform("pages", lambda x: F.when(windows.mirror_hits(x, list(markers or windows.MIRRORED)) >= windows.MIRROR_HITS, F.lit("")).otherwise(x))
    out = out.withColumn("pages", F.when(F.col("text_status") == "valid", blank).otherwise(F.col("pages")))
    return out.withColumn("text_status", F.when((F.col("text_status") == "valid") & ~has_text(F.col("pages")), "mirrored_all_stripped").otherwise(F.col("text_status")))


def pdf_readers() -> list[Callable[[bytes], list[str]]]:
    """Readers of PDF files by the libraries that are installed, the one that keeps columns first."""
    import importlib.util
    import io

    def by_words(raw: bytes) -> list[str]:
        import pdfplumber

        with pdfplumber.open(io.BytesIO(raw)) as doc:
            return [columns_of_words(pd.DataFrame(p.extract_words() or [], columns=["x0", "x1", "top", "text"]), float(p.width)) for p in doc.pages]

    def plain(raw: bytes) -> list[str]:
        import fitz

        with fitz.open(stream=raw, filetype="pdf") as doc:
            return [p.get_text() for p in doc]

    return [f for name, f in (("pdfplumber", by_words), ("fitz", plain)) if importlib.util.find_spec(name)]


def columns_of_words(words: pd.DataFrame, width: float, gap: float = 0.03, line: float = 5.0) -> str:
    """Reading order of word boxes (x0, x1, top, text): columns are parted where no word is over ``gap`` of the width."""
    bins = 200
    used = [False] * bins
    for x0, x1 in zip(words["x0"], words["x1"], strict=True):
        for k in range(max(0, int(x0 / width * bins)), min(bins, int(x1 / width * bins) + 1)):
            used[k] = True
    edges, k = [], 0
    while k < bins:
        if not used[k]:
            j = k
            while j < bins and not used[j]:
                j += 1
            if k and j < bins and (j - k) / bins >= gap:
                edges.append((k + j) / 2 / bins * width)
            k = j
        else:
            k += 1
    of = words.assign(column=[sum(x >= e for e in edges) for x in words["x0"]])
    out = []
    for _, col in of.groupby("column"):
        rows: list[tuple[float, list]] = []
        for w in col.sort_values(["top", "x0"]).itertuples():
            if rows and abs(w.top - rows[-1][0]) <= line:
                rows[-1][1].append((w.x0, w.text))
            else:
                rows.append((w.top, [(w.x0, w.text)]))
        out += [" ".join(t for _, t in sorted(r)) for _, r in rows]
    return "\n".join(out)


def file_facts(name: Column) -> dict[str, Column]:
    """company, year (0: none), doc_type and position from a file name like ``12. Name - 2024 - annual report.pdf``.

    Without a part that is a year, the first year inside of the name counts; one behind another digit, as within a number of a name, is none.
    """
    stem = F.regexp_replace(name, r"(?i)\.pdf$", "")
    position = F.coalesce(F.regexp_extract(stem, r"^(\d{1,3})\.", 1).try_cast("int"), F.lit(0))
    rest = F.regexp_replace(stem, r"^\d{1,3}\.\s*", "")
    parts = F.split(rest, r"\s+-\s+")
    years = F.filter(parts, lambda p: p.rlike(r"^\s*20(1[5-9]|2[0-5])\s*$"))
    year = F.coalesce(F.trim(F.get(years, F.lit(0))).try_cast("int"), F.regexp_extract(rest, r"(?<!\d)(20(?:1[5-9]|2[0-5]))", 1).try_cast("int"), F.lit(0))
    kind = F.lit("Annual Report")
    for word, value in reversed(DOC_TYPES):
        kind = F.when(F.contains(F.lower(rest), F.lit(word)), value).otherwise(kind)
    company = F.trim(F.regexp_replace(F.get(parts, F.lit(0)), r"^\d+\.\s*", ""))
    return {"company": company, "year": year, "doc_type": kind, "position": position}


def in_positions(files: DataFrame, first: int, last: int, name: str = "name") -> DataFrame:
    """Files whose name begins with a position from ``first`` to ``last``; those without one go."""
    return files.where(F.regexp_extract(name, r"^(\d+)\.", 1).try_cast("int").between(first, last))


def is_translated_file(name: Column) -> Column:
    return F.upper(name).rlike(r"[_-]CN(\.|$)")


def company_metadata(raw: DataFrame) -> DataFrame:
    """Either header layout of a company list as name, position, industry, sector, country; the later row of a name wins."""
    have = {c.strip().strip("﻿").lower(): c for c in raw.columns}
    pick = lambda *names: next((F.col(f"`{have[n]}`") for n in names if n in have), F.lit(None))
    df = raw.withColumn("__seq", F.monotonically_increasing_id())
    digits = F.regexp_replace(pick("position", "rank").cast("string"), r"\D", "")
    out = df.select("__seq", F.trim(pick("company", "name")).alias("name"), F.coalesce(digits.try_cast("int"), F.lit(0)).alias("position"), *[F.trim(pick(c)).alias(c) for c in ("industry", "sector", "country")])
    return out.where("name <> ''").groupBy(F.lower("name").alias("key")).agg(F.max_by(F.struct("name", "position", "industry", "sector", "country"), "__seq").alias("r")).select("key", "r.*")


def read_company_metadata(spark: SparkSession, path: str) -> DataFrame:
    return company_metadata(spark.read.option("encoding", "UTF-8").csv(path, header=True))


def gold_fragments(df: DataFrame) -> DataFrame:
    """Labelled fragments with defaults: label 1, year 0, texts empty."""
    have = set(df.columns)
    col = lambda c, d, t: (F.coalesce(F.col(c).cast(t), F.lit(d)) if c in have else F.lit(d).cast(t)).alias(c)
    return df.select(col("id", "", "string"), col("text", "", "string"), col("context", "", "string"), col("label", 1, "int"), col("fp_reason", "", "string"), col("category", "", "string"), col("company", "", "string"), col("year", 0, "int"))


def config(defaults: dict, path: str | None = None, **given) -> dict:
    """Given values go before those of a JSON file, and those before the defaults; unknown names in the file are left out."""
    out = dict(defaults)
    if path:
        with open(path, encoding="utf-8") as f:
            out |= {k: v for k, v in json.load(f).items() if k in defaults}
    return out | {k: v for k, v in given.items() if v is not None}


def table_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one where there is none."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(e):
            return spark.createDataFrame([], schema)
        raise
