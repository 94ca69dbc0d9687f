"""Writers: flat exports of references in several formats, matrices, partitioned tables."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from fathomline.functions import text as tx
from fathomline.operators.lineage import kept


def reference_sheet(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """The flat sheet: fixed columns, then a code and a confidence for each dimension of the JSON column ``dimensions``."""
    have = set(df.columns)
    parsed = F.from_json("dimensions", "map<string, array<string>>")
    english = lambda t: F.coalesce(F.nullif(F.trim(f"{t}_translated"), F.lit("")), F.col(t)) if f"{t}_translated" in have else F.col(t)
    page = F.coalesce(F.nullif(F.col("pages").cast("string"), F.lit("")), F.col("page").cast("string"), F.lit("")) if "pages" in have else F.coalesce(F.col("page").cast("string"), F.lit(""))
    count = F.coalesce(*[F.col(c).try_cast("int") for c in ("occurrence_count", "total_occurrences") if c in have], F.lit(0))
    out = df.withColumn("__d", parsed)
    fixed = [c for c in ("company", "year", "position", "industry", "sector", "country", "doc_type", "sentiment", "strength") if c in have]
    extra = [x for d in dimensions for x in (F.get(F.col("__d")[d], F.lit(0)).alias(d), F.get(F.col("__d")[d], F.lit(1)).try_cast("double").alias(f"{d} Confidence"))]
    return out.select(*fixed, page.alias("pages_identified"), count.alias("occurrences"), tx.sanitised(tx.unmarked(english("text"))).alias("text"), tx.sanitised(tx.unmarked(english("context"))).alias("context"), *extra)


def dimension_json(pairs: list[tuple[str, Column, Column]]) -> Column:
    """``{"dim": [code, confidence], ...}`` of the dimensions that have a code."""
    entries = F.filter(F.array(*[F.struct(F.lit(d).alias("key"), F.array(c.cast("string"), F.round(p, 4).cast("string")).alias("value")) for d, c, p in pairs]), lambda e: e["value"][0].isNotNull())
    return F.to_json(F.map_from_entries(entries))


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV files with a header; texts are sanitised. With ``mark`` each file begins with a byte-order mark, which spreadsheets look for."""
    plain = df.select(*[tx.sanitised(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`") for f in df.schema])
    if mark:
        # The header is part of the first name: Spark writes it at the top of each file.
        plain = plain.toDF(*[("\ufeff" if not i else "") + c for i, c in enumerate(df.columns)])
    plain.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def without_nan(df: DataFrame) -> DataFrame:
    """``df`` with null instead of NaN."""
    return df.select(*[F.when(~F.isnan(f"`{f.name}`"), F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("double", "float") else F.col(f"`{f.name}`") for f in df.schema])


def write_json(df: DataFrame, path: str) -> None:
    without_nan(df).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_document(df: DataFrame, path: str, meta: dict | None = None, name: str = "references") -> None:
    """One JSON document ``{"meta": {...}, "<name>": [...]}`` as text files of ``path``, which joined in the order of their names are the document.

    Rows are written by the executors, each with its comma; no row passes the driver.
    """
    rows = without_nan(df)
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {"ignoreNullFields": "false"})
    # Computed once: numbers of rows are not the same in a second run where partitions differ.
    one = kept(rows.select(text.alias("value"), F.monotonically_increasing_id().alias("__n")))
    first = one.agg(F.min("__n")).first()[0]
    head = json.dumps({"meta": meta or {}}, ensure_ascii=False, default=str)[:-1] + f', "{name}": ['
    spark = df.sparkSession
    body = one.select(F.concat(F.when(F.col("__n") == first, "").otherwise(","), "value").alias("value"))
    lines = spark.createDataFrame([(head,)], "value string").coalesce(1).union(body).union(spark.createDataFrame([("]}",)], "value string").coalesce(1))
    lines.write.mode("overwrite").text(path)


def read_json_document(spark: SparkSession, path: str, schema: str, name: str = "references") -> tuple[dict, DataFrame]:
    """``meta`` and the rows of a document that write_json_document has written, read line by line: the document is never one row.

    A row is a line, so each is parsed by itself. Commas are checked: all rows but the first have one; a document for
    which this does not hold, or without its first or last line, raises ValueError. A document without rows gives none.
    """
    # The place of a line: its file, the block of the file that a task reads, and its number in the task.
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), "value")
    head = json.dumps({name: 0}, ensure_ascii=False)[1:-2] + "["
    kind = F.when(F.startswith("value", F.lit('{"meta": ')) & F.endswith("value", F.lit(head)), "head").when(F.col("value") == "]}", "foot").when(F.startswith("value", F.lit(",")), "more").otherwise("first")
    marked = lines.withColumn("kind", kind)
    at = F.struct("f", "b", "i")
    found = {r["kind"]: r for r in marked.groupBy("kind").agg(F.count("*").alias("n"), F.min(at).alias("least"), F.max(at).alias("most"), F.max(F.when(F.col("kind") == "head", F.col("value"))).alias("head")).collect()}
    count = {k: found[k]["n"] if k in found else 0 for k in ("head", "first", "more", "foot")}
    order = [found[k]["least"] for k in ("head", "first") if count[k]]
    if count["head"] != 1 or count["foot"] != 1 or count["first"] != (1 if count["more"] or count["first"] else 0):
        raise ValueError(f"not one document: {count}")
    order += [found["more"]["least"], found["more"]["most"]] if count["more"] else []
    order.append(found["foot"]["least"])
    if order != sorted(order):
        raise ValueError("lines of the document are out of order")
    meta = json.loads(found["head"]["head"][: -len(head) - 2] + "}")["meta"]
    body = marked.where(F.col("kind").isin("first", "more")).select(F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("r"))
    return meta, body.select("r.*")


def workbook(folder: str, sheets: dict[str, DataFrame], write=write_csv) -> list[str]:
    """A table for each sheet, in files of a folder; the paths."""
    out = []
    for name, df in sheets.items():
        write(df, path := f"{folder}/{name}")
        out.append(path)
    return out


def diffusion_workbook(folder: str, by_product: DataFrame, by_category: DataFrame, by_vendor: DataFrame, detail: DataFrame, log: DataFrame, write=write_csv) -> list[str]:
    """The three matrices of points by year, the adopters behind them, and the log of exclusions."""
    return workbook(folder, {"products": by_product, "categories": by_category, "vendors": by_vendor, "adopters": detail, "log": log}, write)


def summary_records(curves: DataFrame, yearly: DataFrame, unit: str, kind: str) -> tuple[DataFrame, DataFrame]:
    """A row for each curve (key, kind, score, highest penetration, stage, first and last year) and one for each of its years."""
    span = yearly.groupBy(unit).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    one = curves.join(span, unit).select(F.col(unit).alias("key"), F.lit(kind).alias("kind"), F.round("score", 4).alias("score"), F.round("max_penetration", 4).alias("max_penetration"), F.col("stage").alias("lifecycle_stage"), "first_year", "last_year")
    years = yearly.join(curves.select(unit), unit, "left_semi").select(F.col(unit).alias("key"), F.lit(kind).alias("kind"), "year", F.round(F.col("points").cast("double"), 4).alias("points"))
    return one, years


def write_excel(df: DataFrame, path: str, most: int = 1_000_000) -> None:
    """One sheet, where the writer is installed; a sheet holds a bounded number of rows and more is refused."""
    import openpyxl  # noqa: F401

    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows do not fit into a sheet")
    rows.to_excel(path, index=False)


WRITERS = {"csv": write_csv, "json": write_json, "xlsx": write_excel, "parquet": lambda df, path: df.write.mode("overwrite").parquet(path)}


def export_all(df: DataFrame, folder: str, name: str, formats: list[str]) -> list[str]:
    """The frame in every format; the paths."""
    out = []
    for f in formats:
        WRITERS[f](df, path := f"{folder}/{name}.{f}")
        out.append(path)
    return out


def write_years(df: DataFrame, path: str, keys: tuple[str, ...] = ("year",)) -> None:
    """Replaces only the partitions that ``df`` has rows for."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def write_clustered(df: DataFrame, path: str, keys: list[str], files: int) -> None:
    """Writes ``df`` in ``files`` files, each with a range of ``keys``, and beside them a table of the files with their least and greatest keys and rows.

    A key with a third of all rows fills several files only if a later key tells its rows apart. Nulls come first.
    """
    df.repartitionByRange(files, *keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(f"{path}/rows")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    ends = [f(k).alias(f"{n}_{k}") for k in keys for n, f in (("least", F.min), ("most", F.max))]
    nulls = [F.count_if(F.col(k).isNull()).alias(f"nulls_{k}") for k in keys]
    written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), *ends, *nulls).coalesce(1).write.mode("overwrite").parquet(f"{path}/files")


def clustered_files(spark: SparkSession, path: str, **ranges: tuple) -> list[str]:
    """The files of :func:`write_clustered` that may hold a row with every key within its (least, greatest), ends included; None is no end."""
    known = spark.read.parquet(f"{path}/files")
    for key, (low, high) in ranges.items():
        if low is not None:
            known = known.where(F.col(f"most_{key}") >= low)
        if high is not None:
            known = known.where(F.col(f"least_{key}") <= high)
    return sorted(r["file"] for r in known.select("file").collect())


def clustered_scan(spark: SparkSession, path: str, **ranges: tuple) -> DataFrame:
    """The rows within ``ranges``, read from the files that may hold one; all others are not opened. Null keys are in no range."""
    schema = spark.read.parquet(f"{path}/rows").schema
    files = clustered_files(spark, path, **ranges)
    out = spark.read.schema(schema).parquet(*[f"{path}/rows/{f}" for f in files]) if files else spark.createDataFrame([], schema)
    for key, (low, high) in ranges.items():
        if low is not None:
            out = out.where(F.col(key) >= low)
        if high is not None:
            out = out.where(F.col(key) <= high)
    return out


def evolved(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new, allowMissingColumns=True)


def migrated(old: DataFrame, schema: StructType | str, renamed: dict[str, str] | None = None) -> DataFrame:
    """``old`` in another schema: columns renamed, cast, added as nulls or left out. Written to a new path, it takes the place of the old table."""
    wanted = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    of = {new: was for was, new in (renamed or {}).items()}
    have = set(old.columns)
    pick = lambda f: F.col(f"`{of.get(f.name, f.name)}`") if of.get(f.name, f.name) in have else F.lit(None)
    return old.select(*[pick(f).cast(f.dataType).alias(f.name) for f in wanted])


def replaced(df: DataFrame, path: str, keys: tuple[str, ...]) -> None:
    """Deletes the rows of a partitioned table that share ``keys`` with ``df`` and writes those of ``df``, in one commit; other keys stay."""
    write_years(df, path, keys)


def write_evaluation(report: DataFrame, predictions: DataFrame, folder: str) -> None:
    write_json(report, f"{folder}/report.json")
    write_csv(predictions, f"{folder}/predictions.csv")


def append_audit(rows: DataFrame, path: str, dry_run: bool = False) -> None:
    """Appends translation records; nothing on a dry run."""
    if not dry_run:
        rows.withColumn("logged_at", F.current_timestamp()).write.mode("append").parquet(path)


def taxonomy_template(folder: str) -> list[str]:
    """Empty sheets of a taxonomy, as CSV files with a row of examples each."""
    import csv
    import os

    sheets = {
        "Categories": (["dimension", "code", "name", "description"], ["A", "A1", "Example", "What it covers"]),
        "Keywords": (["code", "keyword", "tier"], ["A1", "example word", "1"]),
        "Patterns": (["code", "pattern"], ["A1", r"\bexample\b"]),
        "FP_Patterns": (["fp_category", "pattern"], ["not_meant", r"\bfor example\b"]),
        "Taxonomy_Meta": (["taxonomy_name", "display_name", "version", "description"], ["example", "Example", "1.0", ""]),
    }
    out = []
    for name, (header, row) in sheets.items():
        path = os.path.join(folder, f"{name}.csv")
        with open(path, "w", newline="", encoding="utf-8") as f:
            csv.writer(f).writerows([header, row])
        out.append(path)
    return out
