"""Mixing sources to target weights.

The words of every source are packed, in a fixed order of its documents, into blocks of equal length. Each
output shard draws its number of blocks from every source (a multinomial draw over what the sources still
owe: among groups of sources first, then within each group), the slots of a source run through pseudorandom
permutations of its block indices, one permutation for each pass, and slots are joined to blocks by (source,
index). The table of sources is a DataFrame throughout; the driver holds sums over it and a row for each group,
of which there are as many as the root of the number of sources.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.shared import WORD, cut, mix64, own_prefix, shuffle_partitions, small_batches


@dataclass(frozen=True)
class MixSpec:
    """weights: of the sources in the order of their code points, null last, again and again.
    cap: how often a source may be repeated at most. block_words: the length of a block.
    shards: output shards. bucket_rows: rows for which positions are summed in one window at most (about).
    min_buckets: windows of a source at least, so that one source is summed by as many tasks.
    group_sources: sources whose draws one task makes (or the root of their number, where that is more).
    sent_sources: the table of sources is sent to all tasks if it has no more rows than that, else it is joined.
    run_slots: slots that one row stands for before they are written out, at most."""

    weights: tuple[float, ...] = (5.0, 2.0, 1.0)
    cap: int = 3
    block_words: int = 64
    shards: int = 256
    seed: int = 20240229
    bucket_rows: int = 20_000
    min_buckets: int = 64
    group_sources: int = 4096
    sent_sources: int = 10_000
    run_slots: int = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD.replace("]+", "]++"))), F.lit(0)).cast("long")


def ranked_sources(sized: DataFrame, spec: MixSpec) -> DataFrame:
    """source, size, n (rows), sid (its rank in the order of code points, null last) and weight of each source, computed once."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    order = F.col("source").asc_nulls_last()
    # The number of a row is its partition's (a range of names) and its place there.
    dealt = cut(totals.repartitionByRange(order).sortWithinPartitions(order).withColumn("id", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("part", F.shiftright("id", 33))
    counts = dealt.groupBy("part").agg(F.count("*").alias("k"))
    before = counts.select("part", (F.sum("k").over(Window.orderBy("part")) - F.col("k")).alias("before"))  # a row for each partition
    sid = (F.col("before") + F.col("id").bitwiseAND((1 << 33) - 1)).cast("long")
    weights = F.array(*[F.lit(float(w)) for w in spec.weights])
    return dealt.join(before, "part").select("source", "size", "n", sid.alias("sid")).withColumn("weight", F.get(weights, F.pmod("sid", F.lit(len(spec.weights))).cast("int")))


def fill_unit(sources: DataFrame, cap: float) -> float:
    """The share of a weight of 1 where all sizes are shared in proportion to weights, no source gets above ``cap`` times its size, and the excess is shared again.

    A source that is above at some share stays above at all larger ones, so the share grows from round to round until
    nothing changes; a round is one sum over the sources. 0 where there is nothing to share.
    """
    total, unit, was = float(sources.agg(F.sum("size")).first()[0] or 0), 0.0, None
    while True:
        over = F.col("weight") * F.lit(unit) > F.lit(float(cap)) * F.col("size")
        fixed, n, free = sources.agg(F.sum(F.when(over, F.lit(float(cap)) * F.col("size"))), F.count(F.when(over, 1)), F.sum(F.when(~over, F.col("weight")))).first()
        if n == was or not free:
            return unit
        unit, was = (total - (fixed or 0.0)) / free, n


def shard_slots(slots: int, shards: int) -> np.ndarray:
    """How many of ``slots`` each shard has."""
    ends = [slots * k // shards for k in range(shards + 1)]
    return np.diff(np.array(ends, np.int64))


def draw_shards(owed: np.ndarray, most: np.ndarray, wanted: np.ndarray, seed: int) -> np.ndarray:
    """Blocks that each shard takes from each source: a (shards, sources) table; a row of it adds up to what the shard wants.

    A shard's slots are a multinomial draw with what each source still owes as weights, so that chance does
    not add up over shards. No source gives more than ``most`` blocks in all: the surplus is drawn again
    among the others.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    given = np.zeros(len(owed), np.int64)
    out = np.zeros((len(wanted), len(owed)), np.int64)
    for k, want in enumerate(wanted):
        want = int(want)
        while want > 0:
            room = most - given
            p = np.where(room > 0, np.maximum(owed - given, 0.0), 0.0)
            if p.sum() <= 0:
                p = room.astype(float)
            got = np.minimum(rng.multinomial(want, p / p.sum()), room)
            out[k] += got
            given += got
            want -= int(got.sum())
    return out


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The place of ``index`` in a pseudorandom permutation of range(n) chosen by ``key``: a Feistel network, walked until it is within n."""
    index, n, key = (np.asarray(x, np.uint64) for x in (index, n, key))
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(n.astype(float), 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << bits) - np.uint64(1)
    out, open_ = index.copy(), np.arange(len(index))
    with np.errstate(over="ignore"):
        while len(open_):
            b, m, k = bits[open_], mask[open_], key[open_]
            left, right = out[open_] >> b, out[open_] & m
            for r in range(4):
                left, right = right, left ^ (mix64(right + mix64(k + np.uint64(r + 1))) & m)
            out[open_] = (left << b) | right
            open_ = open_[out[open_] >= n[open_]]
    return out.astype(np.int64)


def mix_plan(docs: DataFrame, spec: MixSpec, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """Sized documents with their place in their source, and the table of sources.

    The first has a row for each row of ``docs``: doc_id, source, size, th (hash of the text), sid (rank of the source), at (words
    of the source before it). The second has a row for each source: sid, source, size, n (rows), weight, target,
    blocks, owed (blocks that make up the target).
    """
    sized = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("th")))
    sources = cut(ranked_sources(sized, spec))
    share = F.lit(fill_unit(sources, spec.cap)) * F.col("weight")
    most = F.lit(float(spec.cap)) * F.col("size")
    sources = sources.withColumn("target", F.when(share > most, most).otherwise(share)).withColumn("blocks", F.ceil(F.col("size") / spec.block_words).cast("long"))
    sources = sources.withColumn("owed", F.when(F.col("size") > 0, F.col("target") / F.col("size") * F.col("blocks")).otherwise(0.0))
    n_sources, n_rows = sources.agg(F.count("*"), F.sum("n")).first()
    buckets = max(spec.min_buckets, -(-int(n_rows or 0) // spec.bucket_rows))
    ids = sources.select("sid", F.col("source").alias("__s"), F.col("size").alias("source_size"), "target")
    ids = F.broadcast(ids) if n_sources <= spec.sent_sources else ids
    placed = sized.join(ids, F.col("source").eqNullSafe(F.col("__s"))).drop("__s").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "size", "th", F.lit(spec.seed)), F.lit(buckets)).cast("int"))
    # Places are running sums in the order (bucket, doc_id, size, text): a hot source has as many windows as buckets, and
    # so have documents of one id, or without any.
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("s"))
    before = sums.select("sid", "bucket", (F.sum("s").over(Window.partitionBy("sid").orderBy("bucket")) - F.col("s")).alias("base"))
    inside = Window.partitionBy("sid", "bucket").orderBy("doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumn("upto", F.sum("size").over(inside)).join(before, ["sid", "bucket"])
    return placed.select("doc_id", "source", "size", "th", "sid", "source_size", "target", (F.col("base") + F.col("upto") - F.col("size")).alias("at")), sources


def mix_slots(sources: DataFrame, spec: MixSpec) -> DataFrame:
    """Every slot of every output shard: shard, slot (of the source's own), sid, pass (how often the source ran through before), block."""
    spark = sources.sparkSession
    schema = "shard int, slot long, sid long, pass int, block long"
    n_sources = sources.count()
    width = max(spec.group_sources, int(np.ceil(np.sqrt(n_sources))))
    grouped = sources.where("blocks > 0").select("sid", "blocks", "owed", F.floor(F.col("sid") / width).cast("int").alias("grp"))
    sums = sorted(grouped.groupBy("grp").agg(F.sum("owed"), F.sum("blocks")).collect())
    if not sums:
        return spark.createDataFrame([], schema)
    owed, most = np.array([r[1] for r in sums], float), spec.cap * np.array([r[2] for r in sums], np.int64)
    counts = draw_shards(owed, most, shard_slots(int(min(round(owed.sum()), most.sum())), spec.shards), spec.seed)
    wants = spark.createDataFrame([(int(r[0]), counts[:, k].tolist()) for k, r in enumerate(sums)], "__grp int, wanted array<long>")
    seed, cap, run = spec.seed, spec.cap, spec.run_slots

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sid")
        blocks = pdf["blocks"].to_numpy(np.int64)
        given = draw_shards(pdf["owed"].to_numpy(float), cap * blocks, np.asarray(pdf["wanted"].iloc[0], np.int64), seed + 1 + int(pdf["grp"].iloc[0]))
        shard, at = np.nonzero(given)
        n, first = given[shard, at], (np.cumsum(given, axis=0) - given)[shard, at]
        # Long runs of slots are cut, so that they can be dealt out.
        pieces = -(-n // run)
        of = np.repeat(np.arange(len(n)), pieces)
        skip = run * (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        return pd.DataFrame({"shard": shard[of].astype(np.int32), "sid": pdf["sid"].to_numpy(np.int64)[at[of]], "blocks": blocks[at[of]], "first": first[of] + skip, "n": np.minimum(run, n[of] - skip)})

    def fill(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), 256):
                part = pdf.iloc[lo : lo + 256]
                n = part["n"].to_numpy(np.int64)
                each = lambda c: np.repeat(part[c].to_numpy(), n)  # noqa: E731, B023
                order = each("first") + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                sid, blocks = each("sid"), each("blocks")
                turn = order // blocks
                with np.errstate(over="ignore"):
                    key = mix64(mix64(sid.astype(np.uint64) + np.uint64(seed)) + turn.astype(np.uint64))
                yield pd.DataFrame({"shard": each("shard"), "slot": order, "sid": sid, "pass": turn.astype(np.int32), "block": permuted(order % blocks, blocks, key)})

    runs = grouped.join(wants, F.col("grp") == F.col("__grp")).groupBy("grp").applyInPandas(draw, "shard int, sid long, blocks long, first long, n long")
    return runs.repartition(shuffle_partitions(spark), "shard", "sid", "first").mapInPandas(fill, schema)


def mix_pieces(placed: DataFrame, slots: DataFrame, spec: MixSpec) -> DataFrame:
    """The mix: one row for each part of a document in each slot.

    shard, slot, source, doc_id, first_word, n_words (of the document), and at: the document's place in its
    source, which tells rows with one doc_id apart. Documents without words are in no slot.
    """
    b = spec.block_words
    parts = placed.where("size > 0").select("doc_id", "source", "sid", "size", "at", F.explode(F.sequence(F.floor(F.col("at") / b), F.floor((F.col("at") + F.col("size") - 1) / b))).alias("block"))
    lo, hi = F.greatest(F.col("at"), F.col("block") * b), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * b)
    parts = parts.select("doc_id", "source", "sid", "block", "at", "size", (lo - F.col("at")).alias("first_word"), (hi - lo).alias("n_words"))
    # Slots come from a few rows that stand for many each: by the size of those they would be taken for a side to send.
    return slots.join(parts.hint("merge"), ["sid", "block"])


def mix_documents(docs: DataFrame, spec: MixSpec = MixSpec(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces, documents, sources) of the mix of ``docs`` (doc_id, text, source).

    Null texts and texts without words have size 0 and are in no slot; a null source is one of its own, the
    last; repeated rows are documents of their own; an empty table gives empty ones; further columns are ignored.
    Texts count in whole. Documents of one id are in the order of their sizes and their texts' hashes; those that agree
    in all take each other's place. Any number of sources is mixed. Reruns agree: every choice comes from the seed, the doc_ids and the
    sizes.
    """
    placed, sources = mix_plan(docs, spec, doc_id, text, source)
    placed = cut(placed)
    return mix_pieces(placed, mix_slots(sources, spec), spec), placed, sources


def mixed_sizes(docs: DataFrame, spec: MixSpec = MixSpec()) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target (of its source), taken (words of it in the mix)."""
    pieces, placed, _ = mix_documents(docs, spec)
    taken = pieces.groupBy("sid", "at").agg(F.sum("n_words").alias("taken"))
    joined = placed.join(taken.withColumnRenamed("sid", "__sid").withColumnRenamed("at", "__at"), (F.col("sid") == F.col("__sid")) & (F.col("at") == F.col("__at")) & (F.col("size") > 0), "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, spec: MixSpec = MixSpec(), doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents, with the columns of ``docs``: for each pass over its source, a document with the words that the mix takes of it.

    A pass that takes a document in whole gives its text unchanged; else the stretches that it takes are
    joined by line feeds. Documents that the mix does not take do not appear, null and empty texts among them. Other
    columns go along, whatever their names; of rows that agree in id, source and text each takes the runs of one.
    """
    pieces, placed, _ = mix_documents(docs, spec, doc_id, text, source)
    runs = pieces.groupBy("sid", "at", "pass").agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words"))).alias("runs"))
    own = own_prefix(docs.columns)
    same = ["doc_id", "source", "size", "th"]
    number = lambda order: F.row_number().over(Window.partitionBy(*[f"{own}{c}" for c in same]).orderBy(order))
    # Rows that agree in all four are told apart by a number.
    rows = placed.where("size > 0").select(*[F.col(c).alias(f"{own}{c}") for c in same], F.col("sid").alias(f"{own}sid"), F.col("at").alias(f"{own}at")).withColumn(f"{own}no", number(F.col(f"{own}at")))
    taken = runs.select(F.col("sid").alias(f"{own}s"), F.col("at").alias(f"{own}a"), F.col("runs").alias(f"{own}runs"))
    taken = rows.join(taken, (F.col(f"{own}sid") == F.col(f"{own}s")) & (F.col(f"{own}at") == F.col(f"{own}a"))).drop(*[f"{own}{c}" for c in ("s", "a", "sid", "at")])
    mine = {"doc_id": F.col(doc_id), "source": F.col(source).cast("string"), "size": word_count(F.col(text)), "th": F.xxhash64(text)}
    texts = small_batches(docs).select("*", *[v.alias(f"{own}{k}") for k, v in mine.items()])
    texts = texts.withColumn(f"{own}no", number(F.lit(0)))
    on = [texts[f"{own}{k}"].eqNullSafe(taken[f"{own}{k}"]) for k in (*same, "no")]
    both = texts.join(taken, on).select(*[texts[f"`{c}`"] for c in docs.columns], taken[f"{own}size"], taken[f"{own}runs"])

    @F.pandas_udf("string")
    def stretch(t: pd.Series, size: pd.Series, runs: pd.Series) -> pd.Series:
        import re

        out = []
        for text_, n, parts in zip(t, size, runs, strict=True):
            parts = [(int(p["first_word"]), int(p["n_words"])) for p in parts]
            if sum(k for _, k in parts) == n:
                out.append(text_)
                continue
            words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text_)]
            joined = []
            for a, k in parts:
                if joined and joined[-1][1] == a:
                    joined[-1][1] = a + k
                else:
                    joined.append([a, a + k])
            out.append("\n".join(text_[words[a][0] : words[b - 1][1]] for a, b in joined))
        return pd.Series(out, dtype="object")

    made = both.withColumn(f"{own}new", stretch(F.col(text), F.col(f"{own}size"), F.col(f"{own}runs")))
    return made.select(*[F.col(f"{own}new").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])
