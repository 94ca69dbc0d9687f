"""Packing documents into sequences of bounded length: shortest pack first, over the histogram of lengths.

Only the histogram reaches the driver (as many numbers as a sequence has tokens). Lengths are placed longest
first, each into the shortest open pack that has room, counts of packing patterns are updated, and a pattern
stands for as many sequences as its count. Pieces of documents find their sequence by their rank among the
pieces of the same length.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.shared import cut, small_batches
from fathomline.llm.tokens import default_tokenizer, encoded

MAX_TOKENS = 1024
#: Rows that one window ranks at most (about).
RANK_ROWS = 20_000
#: Buckets of a length at least, so that pieces of one length are ranked by as many tasks.
MIN_BUCKETS = 64


@dataclass(frozen=True)
class Pattern:
    count: int
    lengths: tuple[int, ...]


def shortest_pack_first(histogram: dict[int, int], limit: int = MAX_TOKENS) -> list[Pattern]:
    """Patterns of lengths that sum to ``limit`` at most, with counts, which use up ``histogram``.

    The number of patterns is bounded by the number of distinct lengths, not by the counts: a step either
    uses up a length or an open pattern.
    """
    open_: dict[int, list[Pattern]] = {}  # by the tokens used so far
    done: list[Pattern] = []

    def put(p: Pattern) -> None:
        used = sum(p.lengths)
        (done if used == limit else open_.setdefault(used, [])).append(p)

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[Pattern] = []
        while left:
            used = min((u for u in open_ if u + length <= limit), default=None)
            if used is None:
                times = limit // length  # fresh packs take the length as often as it fits
                full, rest = divmod(left, times)
                if full:
                    placed.append(Pattern(full, (length,) * times))
                if rest:
                    placed.append(Pattern(1, (length,) * rest))
                break
            p = open_[used].pop()
            if not open_[used]:
                del open_[used]
            n = min(p.count, left)
            if p.count > n:
                put(Pattern(p.count - n, p.lengths))
            placed.append(Pattern(n, (*p.lengths, length)))
            left -= n
            if sum(placed[-1].lengths) + length <= limit:
                put(placed.pop())
        for p in placed:
            put(p)
    return done + [p for u in sorted(open_, reverse=True) for p in open_[u]]


def slot_table(patterns: list[Pattern]) -> pd.DataFrame:
    """For each length, runs of ranks and where they lie: length, first (rank), count, sequence (of the first), offset."""
    rows, seen, base = [], {}, 0
    for p in patterns:
        at = 0
        for n in p.lengths:
            rows.append((n, seen.get(n, 0), p.count, base, at))
            seen[n] = seen.get(n, 0) + p.count
            at += n
        base += p.count
    return pd.DataFrame(rows, columns=["length", "first", "count", "sequence", "offset"], dtype="int64").sort_values(["length", "first"], ignore_index=True)


def cut_lengths(n: int, limit: int = MAX_TOKENS) -> list[int]:
    """How a document of ``n`` ids is cut: whole sequences, then halves of what is left down to an eighth, then the rest.

    Pieces of a half and a quarter of a sequence fill up with each other, and short rests fill the gaps.
    """
    out = [limit] * (n // limit)
    n %= limit
    for part in (limit // 2, limit // 4, limit // 8):
        if n >= part:
            out.append(part)
            n -= part
    return [*out, n] if n else out


def token_pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = MAX_TOKENS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The pieces of each document: uid (of the row), doc_id, start, length, ids_crc32, doc_tokens.

    A null text counts as an empty one; a document ends with id 0 and so has one id at least. Rows that repeat a doc_id
    are documents of their own; long texts are cut in whole; an empty table gives an empty one.
    """
    path = tokenizer or default_tokenizer()
    schema = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"

    def run(batches):
        for pdf in batches:
            cols: list[list[int | None]] = [[], [], [], [], []]
            for d, ids in zip(pdf["doc_id"].astype("Int64"), encoded(path, iter(pdf["text"])), strict=True):
                at, n, raw = 0, len(ids) // 4, memoryview(ids)
                for k in cut_lengths(n, limit):
                    for c, v in zip(cols, (None if d is pd.NA else int(d), at, k, zlib.crc32(raw[4 * at : 4 * (at + k)]), n), strict=True):
                        c.append(v)
                    at += k
            yield pd.DataFrame({"doc_id": pd.array(cols[0], "Int64"), "start": cols[1], "length": np.array(cols[2], np.int32), "ids_crc32": cols[3], "doc_tokens": cols[4]})

    return small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInPandas(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, limit: int = MAX_TOKENS) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Sequences are numbered from 0 without gaps; in each, offsets run from 0 without gaps. Rows that repeat a
    doc_id are documents of their own, a null doc_id is none's; long texts are packed in whole. Pieces of one length are
    in the order of doc_id, start and checksum, so ties change places among equals alone. An empty table gives an empty
    one; further columns are ignored.
    """
    pieces = cut(token_pieces(docs, tokenizer, limit))
    # At most ``limit`` rows, whatever the input.
    hist = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = slot_table(shortest_pack_first(hist, limit))
    buckets = max(MIN_BUCKETS, -(-sum(hist.values()) // RANK_ROWS))
    # Ranks within a length: a count for each (length, bucket), summed up, and a window within each of them.
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("r", F.row_number().over(inside)).join(before, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("r") - 1)
    # The rows of ``slots`` are bounded by ``limit`` too: they go along with the function.
    key = slots["length"].to_numpy() * (1 << 48) + slots["first"].to_numpy()
    first, base, offset = (slots[c].to_numpy() for c in ("first", "sequence", "offset"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def place(batches):
        for pdf in batches:
            rank = pdf["rank"].to_numpy(np.int64)
            i = np.searchsorted(key, pdf["length"].to_numpy(np.int64) * (1 << 48) + rank, side="right") - 1
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "start": pdf["start"], "length": pdf["length"].astype("int64"), "ids_crc32": pdf["ids_crc32"], "doc_tokens": pdf["doc_tokens"], "sequence_id": base[i] + rank - first[i], "offset": offset[i]})

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInPandas(place, schema)
