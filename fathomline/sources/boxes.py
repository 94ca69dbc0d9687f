"""Reading order of word boxes: columns by gaps and islands, lines by their tops, native."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A page's width is looked at in so many bins; a gap of this share of the width parts columns; tops of a line differ by so much at most.
BINS, GAP, LINE = 200, 0.03, 5.0


def with_columns(words: DataFrame, page: list[str], gap: float = GAP) -> DataFrame:
    """``words`` (x0, x1, width) with ``column``, the number of the page's column from 0.

    The bins that words are over are unions of intervals: in the order of their left ends, one begins behind a gap if its left end is
    beyond all right ends before it. A column begins behind a gap of ``gap`` of the width or more, and a word is in the last
    column that begins no later than its left end: in the middle of the gap before it.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.col("width") * BINS).cast("int")
    rows = words.withColumn("__low", F.greatest(F.lit(0), bin_of("x0"))).withColumn("__high", F.least(F.lit(BINS - 1), bin_of("x1")))
    # A bin is counted once however many words begin in it: a page has as many rows here as bins at most.
    starts = rows.where("__high >= __low").groupBy(*page, "width", "__low").agg(F.max("__high").alias("__high"))
    before = Window.partitionBy(*page, "width").orderBy("__low").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("__high").over(before)
    free = F.col("__low") - reach - 1
    edges = starts.withColumn("__edge", F.when((free > 0) & (free / BINS >= gap), (reach + 1 + F.col("__low")) / 2 / BINS * F.col("width")))
    of_page = edges.groupBy(*page, "width").agg(F.sort_array(F.collect_list("__edge")).alias("__edges"))
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"e.{c}")) for c in (*page, "width")]
    met = rows.alias("w").join(of_page.alias("e"), same, "left").select("w.*", "e.__edges")
    column = F.size(F.filter(F.coalesce("__edges", F.array().cast("array<double>")), lambda e: e <= F.col("x0")))
    return met.withColumn("column", column).drop("__low", "__high", "__edges")


def page_texts(words: DataFrame, page: list[str], gap: float = GAP, line: float = LINE) -> DataFrame:
    """``page``, columns (how many hold a word), text: words (x0, x1, top, text, width) in reading order, a line for each row of a column.

    In a column, words are taken from the top; a word is on the line before if it is at most ``line`` below that line's
    first word. Lines are read from the left. Words without a place or text are left out; words of one place are in the order of their texts; a page
    without words gives no row, and its width, if stated in several ways, parts it into pages. A column's words meet in one row, as
    they do on the page.
    """
    placed = with_columns(words.where("x0 is not null and x1 is not null and top is not null and text is not null and width > 0"), page, gap)
    one = placed.groupBy(*page, "width", "column").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))).alias("__w"))
    # A fold over the tops finds where lines begin; texts are not copied before a line is cut out.
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(None).cast("double").alias("first"), F.lit(0).alias("i"))

    def step(a, top):
        begins = a["first"].isNull() | (top - a["first"] > line)
        return F.struct(F.when(begins, F.concat(a["cuts"], F.array(a["i"]))).otherwise(a["cuts"]).alias("cuts"), F.when(begins, top).otherwise(a["first"]).alias("first"), (a["i"] + 1).alias("i"))

    one = one.withColumn("__c", F.aggregate(F.transform("__w", lambda w: w["top"].cast("double")), start, step, lambda a: a["cuts"]))

    def text(at, k):
        end = F.coalesce(F.get("__c", k + 1), F.size("__w"))
        words_ = F.array_sort(F.transform(F.slice("__w", at + 1, end - at), lambda w: F.struct(w["x0"].alias("x0"), w["text"].alias("text"))))
        return F.array_join(F.transform(words_, lambda w: w["text"]), " ")

    one = one.select(*page, "column", F.array_join(F.transform("__c", text), "\n").alias("text"))
    whole = F.array_sort(F.collect_list(F.struct("column", "text")))
    return one.groupBy(*page).agg(F.count("*").alias("columns"), F.array_join(F.transform(whole, lambda x: x["text"]), "\n").alias("text"))
