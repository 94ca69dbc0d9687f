"""Windows of text: pages, overlapping character windows, groups of sentences, context around a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.functions import text as tx

WINDOW, OVERLAP = 500, 100
MIN_PAGE, MIN_WINDOW = 100, 30
# Reversed words that show a mirrored page, and how many of them do.
MIRRORED = ("noitcurtsnoC", "noillim", "sraey", "gnireenignE", "dnoB", "etaroproC", "tnempoleveD", "noitazinagrO")
MIRROR_HITS = 2
SCANNED_CHARS = 50


def pages(docs: DataFrame, text: str = "text", separator: str = "\n") -> DataFrame:
    """A row for each page (piece between separators) with its number from 1."""
    return docs.select(*[c for c in docs.columns if c != text], F.posexplode(F.split(F.col(text), separator)).alias("__p", "page_text")).withColumn("page", F.col("__p") + 1).drop("__p")


def long_pages(df: DataFrame, text: str = "page_text", least: int = MIN_PAGE) -> DataFrame:
    return df.where(F.length(text) >= least)


def scanned_documents(df: DataFrame, keys: list[str], text: str = "page_text") -> DataFrame:
    """Documents whose pages have too few characters on average to hold text."""
    return df.groupBy(*keys).agg(F.avg(F.length(text)).alias("avg_chars"), F.count("*").alias("n_pages")).withColumn("scanned", F.col("avg_chars") < SCANNED_CHARS)


def mirror_hits(c: Column, markers: list[str]) -> Column:
    """How many of ``markers`` the text holds, case and all."""
    return sum((F.contains(c, F.lit(m)).cast("int") for m in markers), F.lit(0))


def blank_mirrored(df: DataFrame, markers: list[str], text: str = "page_text") -> DataFrame:
    """Pages with MIRROR_HITS markers are blanked. (A document that has such a page has as many markers itself.)"""
    return df.withColumn(text, F.when(mirror_hits(F.col(text), markers) >= MIRROR_HITS, F.lit("")).otherwise(F.col(text)))


def mirror_status(df: DataFrame, keys: list[str], text: str = "page_text") -> DataFrame:
    """The status of documents after blanking: mirrored_all_stripped where no page has text left."""
    return df.groupBy(*keys).agg(F.when(F.max(F.length(F.trim(text))) > 0, "valid").otherwise("mirrored_all_stripped").alias("text_status"))


def char_windows(df: DataFrame, text: str = "text", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Windows of ``size`` characters that overlap, with their offset; texts under 20 characters have none.

    A text is cut once into pieces as long as a window's step, and a window is a piece with the beginning of those
    after it: places in a text need no counting from its start, so that a long text costs no more for each character.
    """
    step = size - overlap
    if step < 1:
        raise ValueError("windows must overlap by less than their size")
    own = "__c" + "_" * max((len(c) for c in df.columns), default=0)
    pieces = df.where(F.length(text) >= 20).withColumn(own, F.regexp_extract_all(F.col(text), F.lit(f"(?s).{{1,{step}}}"), F.lit(0)))

    def window(p: Column, k: Column) -> Column:
        tail = F.concat(*[F.coalesce(F.get(F.col(own), k + j), F.lit("")) for j in range(1, -(-overlap // step) + 1)]) if overlap else F.lit("")
        return F.concat(p, F.left(tail, F.lit(overlap))) if overlap else p

    out = pieces.select(*df.columns, F.posexplode(F.transform(own, window)).alias("offset", "window"))
    return out.withColumn("offset", F.col("offset") * step)


def sentence_windows(df: DataFrame, text: str = "text", size: int = WINDOW) -> DataFrame:
    """Groups of sentences of about ``size`` characters; the last sentence of a group begins the next.

    Columns of ``df``, window_no, window, and offset (from 0): where the window begins if each sentence is followed by
    one separator; the sentence that a window shares with the one before counts as if it had none. A fold over the
    lengths of a row's sentences finds where windows begin, native: no shuffle, no user function, and no text is copied
    before its window is cut out. Texts of one sentence have none here (see text_windows).
    """
    own = "__w" + "_" * max((len(c) for c in df.columns), default=0)
    s, cuts = f"{own}s", f"{own}c"
    start = F.struct(F.array().cast("array<struct<i:int,o:int>>").alias("cuts"), *[F.lit(0).alias(c) for c in ("n", "at", "i", "last")])

    def step(a: Column, x: Column) -> Column:
        full = (a["n"] + x > size) & (a["i"] > 0)
        begun = F.concat(a["cuts"], F.array(F.struct(a["i"].alias("i"), (a["at"] - a["last"]).alias("o"))))
        return F.struct(F.when(full, begun).otherwise(a["cuts"]).alias("cuts"), F.when(full, a["last"] + x).otherwise(a["n"] + x).alias("n"), (a["at"] + x + 1).alias("at"), (a["i"] + 1).alias("i"), x.alias("last"))

    first = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("o")))
    rows = df.withColumn(s, tx.sentences(F.col(text))).where((F.length(text) >= 20) & (F.size(s) > 1))
    rows = rows.withColumn(cuts, F.aggregate(F.transform(s, lambda x: F.length(x)), start, step, lambda a: F.concat(first, a["cuts"])))

    def window(c: Column, k: Column) -> Column:
        begin = F.greatest(c["i"] - 1, F.lit(0))
        end = F.coalesce(F.get(F.col(cuts), k + 1)["i"], F.size(s))
        return F.struct(F.array_join(F.slice(s, begin + 1, end - begin), " ").alias("window"), c["o"].alias("offset"))

    rows = rows.select(*df.columns, F.posexplode(F.transform(cuts, window)).alias("window_no", own))
    return rows.select(*df.columns, "window_no", F.col(own)["window"].alias("window"), F.col(own)["offset"].alias("offset"))


def text_windows(df: DataFrame, text: str = "text", size: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Sentence windows where a text has two sentences or more, else character windows; numbered within the row, with their offset."""
    single = df.where(F.size(tx.sentences(F.col(text))) <= 1)
    chars = char_windows(single, text, size, overlap).withColumn("window_no", (F.col("offset") / (size - overlap)).cast("int")).select(*df.columns, "window_no", "window", "offset")
    return sentence_windows(df, text, size).unionByName(chars)


def with_surroundings(pages: DataFrame, keys: list[str], radius: int, page: str = "page", text: str = "page_text") -> DataFrame:
    """``pages`` with ``before`` and ``after``: what the document has next to the page, at most ``radius`` characters, pages being joined by line feeds.

    A null text is an empty one; a null page number comes first; pages that share a number are in the order of the other
    columns. Windows over a document's pages, so they stream through a task and are never one row: a running total gives
    each page's place, and a page looks at the ends of those that lie within ``radius`` characters of its place.
    """
    rest = [c for c in pages.columns if c not in keys]
    own = "__s" + "_" * max(len(c) for c in pages.columns)
    start, end, tail, head = (own + x for x in "beth")
    order = [F.col(f"`{c}`").asc_nulls_first() for c in (page, *[c for c in rest if c != page])]
    group = Window.partitionBy(*keys)
    w = group.orderBy(*order)
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    df = pages.withColumn(end, F.sum(F.length(said).cast("long") + 1).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(start, F.col(end) - F.length(said) - 1)
    # A page carries the end of the page before it and the beginning of that after it, so that a frame of `radius` characters holds the page it cuts.
    df = df.withColumn(tail, F.lag(F.concat(F.right(said, F.lit(radius)), F.lit("\n"))).over(w)).withColumn(head, F.lead(F.concat(F.lit("\n"), F.left(said, F.lit(radius)))).over(w))
    near = lambda c, by, a, b: F.array_join(F.collect_list(c).over(group.orderBy(by).rangeBetween(a, b)), "")
    reach = max(radius, 1) - 1
    before = F.right(near(tail, start, -reach, 0), F.lit(radius))
    after = F.left(near(head, end, 0, reach), F.lit(radius))
    return df.select(*keys, *rest, before.alias("before"), after.alias("after"))


def useful_windows(df: DataFrame, least: int = MIN_WINDOW) -> DataFrame:
    return df.where(F.length(F.trim("window")) >= least)


def around(text: Column, at: Column, length: Column, radius: int) -> Column:
    """``radius`` characters on either side of a match that begins at ``at`` (from 1), clipped."""
    start = F.greatest(F.lit(1), at - radius)
    return F.substring(text, start, at + length + radius - start)


def context_sentences(text: Column, at: Column, term: Column, before: int = 2, after: int = 2, most: int = 2000) -> Column:
    """The sentence that holds the match at ``at`` (from 1) and its neighbours, the term marked, boilerplate blanked, at most ``most`` characters."""
    window = around(text, at, F.length(term), 2000)
    rel = at - F.greatest(F.lit(1), at - 2000)
    # Sentences with the white space before them, so that their lengths add up to places in the window.
    raw = F.split(F.regexp_replace(window, r"(?<=[.!?])(\s+)(?=[A-Z])", "\ue000$1"), "\ue000")
    strip = lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")
    sents = F.filter(F.transform(raw, strip), lambda x: x != "")
    step = lambda a, x: F.struct((a["end"] + F.length(x)).alias("end"), (a["n"] + F.when((a["end"] + F.length(x) <= rel) & (strip(x) != ""), 1).otherwise(0)).alias("n"))
    # The sentence that holds the match has as many before it as end no later than the match begins.
    target = F.least(F.aggregate(raw, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), step, lambda a: a["n"]), F.greatest(F.size(sents) - 1, F.lit(0)))
    chosen = F.slice(sents, F.greatest(F.lit(1), target + 1 - before), F.least(target, F.lit(before)) + 1 + after)
    out = tx.without_boilerplate(tx.marked(F.array_join(chosen, " "), term))
    out = F.trim(F.regexp_replace(out, r"\s{2,}", " "))
    return F.when(F.length(out) > most, F.concat(F.substring(out, 1, most), F.lit("..."))).otherwise(out)


def neighbours(df: DataFrame, keys: list[str], order: str, text: str, before: int = 2, after: int = 2) -> DataFrame:
    """Each row with the joined texts of the rows around it in its group."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    return df.withColumn("context", F.array_join(F.collect_list(text).over(w), " "))


def first_window_of_each(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of windows that begin alike (200 characters) in a document, the first."""
    w = Window.partitionBy(*keys, F.md5(F.substring("window", 1, 200))).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
