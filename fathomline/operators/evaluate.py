"""Evaluation of rules against labelled data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)


def confusion(df: DataFrame, label: str, predicted: str, by: list[str] | None = None) -> DataFrame:
    """Counts and precision, recall, F1, accuracy, escape rate; 0 where a ratio has nothing below. Positive: both columns 1."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    g = df.groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"))
    g = g.withColumn("precision", _ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    g = g.withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
    g = g.withColumn("accuracy", _ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")))
    return g.withColumn("escape_rate", _ratio(F.col("fn"), F.col("tp") + F.col("fn")))


def by_reason(df: DataFrame, label: str, predicted: str, reason: str) -> DataFrame:
    """Caught and missed positives for each reason; a blank reason is unknown."""
    pos = df.where(F.col(label) == 1).withColumn("reason", F.when(F.trim(reason) == "", "unknown").otherwise(F.coalesce(reason, F.lit("unknown"))))
    g = pos.groupBy("reason").agg(F.count("*").alias("total"), F.count_if(F.col(predicted) == 1).alias("caught"))
    return g.withColumn("missed", F.col("total") - F.col("caught")).withColumn("recall", _ratio(F.col("caught"), F.col("total")))


def sweep(df: DataFrame, label: str, score: str, thresholds: list[float], rule: str | None = None) -> DataFrame:
    """The confusion of ``score < threshold`` (or a rule) for every threshold: one pass, one row for each threshold in each row's array."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds]))
    hit = F.col(score) < F.col("threshold")
    if rule:
        hit = hit | (F.col(rule) == 1)
    return confusion(df.withColumn("threshold", t).withColumn("__p", F.coalesce(hit, F.lit(False)).cast("int")), label, "__p", ["threshold"])


def judged(gold: DataFrame, rule: Column, score: Column | None = None, threshold: float | None = None, name: str = "predicted") -> DataFrame:
    """Labelled fragments with the verdict of the rules (1: a false positive), or of the rules and a score below ``threshold``.

    ``rule`` is the name of a group of false positives, or null (see rules.first_false_positive).
    """
    hit = rule.isNotNull()
    if score is not None and threshold is not None:
        hit = hit | F.coalesce(score < threshold, F.lit(False))
    return gold.withColumn("fp_group", rule).withColumn(name, hit.cast("int"))


def stratified(df: DataFrame, reason: str, key: str, size: int, seed: int) -> DataFrame:
    """About ``size`` rows, each reason in proportion and once at least, chosen by a hash of key and seed."""
    n = df.groupBy(reason).agg(F.count("*").alias("__n"))
    total = n.agg(F.sum("__n").alias("__t"))
    quota = F.greatest(F.lit(1), F.round(size * F.col("__n") / F.col("__t"))).cast("int")
    w = Window.partitionBy(reason).orderBy(F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))
    ranked = df.withColumn("__r", F.row_number().over(w)).join(n, reason).crossJoin(F.broadcast(total))
    return ranked.where(F.col("__r") <= quota).drop("__r", "__n", "__t")


def gold_labels(df: DataFrame, first: str, second: str, flag: str) -> DataFrame:
    """Labels of two reviewers (1: a false positive; 0 where either says Positive).

    A row with one review alone goes, and so does one that either finds unclear. Without any review ``flag`` decides.
    """
    a, b = F.trim(F.coalesce(first, F.lit(""))), F.trim(F.coalesce(second, F.lit("")))
    unclear = a.isin("??", "?", "Borderline") | b.isin("??", "?", "Borderline")
    reviewed = F.when((a == "") | (b == "") | (a == "None") | (b == "None") | unclear, F.lit(None)).otherwise(F.when((a == "Positive") | (b == "Positive"), 0).otherwise(1))
    own = F.when(F.lower(F.coalesce(flag, F.lit("true"))).isin("true", "1", "yes"), 1).otherwise(0)
    return df.withColumn("label", F.when((a == "") & (b == ""), own).otherwise(reviewed)).where("label is not null")


def gold_workbook(spark: SparkSession, path: str, first: str, second: str, flag: str, sheet: int | str = 0) -> DataFrame:
    """Labelled fragments from a workbook with two reviewers' columns, where a reader of workbooks is installed. Such sheets are made by hand: few rows."""
    import pandas as pd

    rows = pd.read_excel(path, sheet_name=sheet, dtype=str)
    rows.columns = [str(c).strip() for c in rows.columns]
    frame = spark.createDataFrame(rows.astype(object).where(rows.notna(), None), ", ".join(f"`{c}` string" for c in rows.columns))
    return gold_labels(frame, first, second, flag)


def worst(df: DataFrame, label: int, predicted: int, n: int, order: list[str], label_col: str = "label", predicted_col: str = "predicted") -> DataFrame:
    return df.where((F.col(label_col) == label) & (F.col(predicted_col) == predicted)).orderBy(*order).limit(n)


