"""Token ids in files: frequency-ranked, byte-aligned, with separate control bytes.

A table of frames holds the documents in ascending order of doc_id. A frame has the ids of consecutive
documents, or a part of a very long one. Its distinct ids are ranked by their frequency in the frame, so
that the most frequent ids get the smallest numbers; ranks are stored with the least number of bytes (1 to
4), low byte first, in ``data``, and the lengths, two bits for each rank, four to a byte, lowest bits first,
in ``control``. ``vocabulary`` lists the ids in the order of their ranks. Frames are self-contained, so that
any can be decoded alone, and the ranking never needs a second pass over the corpus.

Frames are rows of a Parquet table that Spark writes (the id streams are binary columns of it): the commit
protocol then keeps the files whole when executors are lost, on any file system that Spark reaches.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fathomline.llm.shared import cut, removed, shared_dir, shuffle_partitions, small_batches
from fathomline.llm.tokens import default_tokenizer, encoded

#: Ids in a frame at most.
FRAME_IDS = 1 << 20

FRAMES = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("frame", T.IntegerType()),
        T.StructField("n_ids", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),  # documents that begin in the frame or go on in it
        T.StructField("lengths", T.ArrayType(T.LongType())),  # their ids in this frame
        T.StructField("goes_on", T.BooleanType()),  # the first document began in an earlier frame
        T.StructField("vocabulary", T.BinaryType()),
        T.StructField("control", T.BinaryType()),
        T.StructField("data", T.BinaryType()),
    ]
)

#: For each control byte: bytes of data for its four numbers, and the places of their bytes among 16.
_SIZES = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.int64)


def pack(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(vocabulary, control, data) of unsigned 32-bit ids."""
    if len(ids) and int(ids.max()) < 1 << 22:  # a vocabulary's ids: counting needs no sort
        counts = np.bincount(ids)
        vocab = np.flatnonzero(counts)
        order = np.argsort(-counts[vocab], kind="stable")
        rank_of = np.empty(len(counts), np.uint32)
        rank_of[vocab[order]] = np.arange(len(vocab), dtype=np.uint32)
        ranks = rank_of[ids]
    else:
        vocab, inverse, counts = np.unique(ids, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank_of = np.empty(len(vocab), np.uint32)
        rank_of[order] = np.arange(len(vocab), dtype=np.uint32)
        ranks = rank_of[inverse]
    size = 1 + (ranks >= 1 << 8).astype(np.uint8) + (ranks >= 1 << 16) + (ranks >= 1 << 24)
    padded = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    padded[: len(ranks)] = size - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    return vocab[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(n: int, vocabulary: bytes, control: bytes, data: bytes) -> np.ndarray:
    """The ids again: each control byte looks up the sizes of its four numbers in a table."""
    size = _SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(size)
    starts = ends - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    ranks = raw[starts].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(size > k)
        if len(more):
            ranks[more] |= raw[starts[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(vocabulary, "<u4")[ranks]


def _frames(tokenizer: str, frame_ids: int):
    def run(batches):
        from pyspark import TaskContext

        shard, frame = TaskContext.get().partitionId(), 0
        docs, lengths, held, total, goes_on = [], [], [], 0, False

        def close(next_goes_on):
            nonlocal docs, lengths, held, total, goes_on, frame
            ids = np.frombuffer(b"".join(held), "<u4")
            row = (shard, frame, len(ids), docs, lengths, goes_on, *pack(ids))
            docs, lengths, held, total, goes_on, frame = [], [], [], 0, next_goes_on, frame + 1
            return pd.DataFrame([row], columns=FRAMES.names)

        for pdf in batches:
            for d, ids in zip(pdf["doc_id"].astype("Int64"), encoded(tokenizer, iter(pdf["text"])), strict=True):
                d = None if d is pd.NA else int(d)
                at, n = 0, len(ids) // 4
                while at < n:
                    take = min(n - at, frame_ids - total)
                    docs.append(d)
                    lengths.append(take)
                    held.append(ids[4 * at : 4 * (at + take)])
                    total, at = total + take, at + take
                    if total == frame_ids:
                        yield close(at < n)
        if total:
            yield close(False)

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, frame_ids: int = FRAME_IDS, doc_id: str = "doc_id", text: str = "text") -> None:
    """Writes the ids of all documents to ``path`` as frames, in ascending order of doc_id (null first).

    A null text counts as an empty one; every document ends with id 0. Rows with one doc_id are documents of
    their own and follow each other in the order of their texts' hashes. Long texts go on over several frames. An
    empty table gives no frames; further columns are ignored.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    # Partitions are ranges of doc_id, so (shard, frame) is the order of the whole.
    dealt.mapInPandas(_frames(tokenizer or default_tokenizer(), frame_ids), FRAMES).write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Frames are decoded one by one; what is returned no longer reads them. A document that goes on over several frames is put together from the
    checksums of its parts, in order, by one window over those parts alone.
    """
    frames = spark.read.schema(FRAMES).parquet(path)
    heads = frames.select("shard", "frame", "n_ids", "goes_on")
    shards = heads.groupBy("shard").agg(F.sum("n_ids").alias("s"))
    # One row for each shard: as many as partitions were written.
    shards = shards.select("shard", (F.sum("s").over(Window.orderBy("shard")) - F.col("s")).alias("before"))
    inside = heads.select("shard", "frame", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("frame")) - F.col("n_ids")).alias("inner"))
    places = cut(inside.join(shards, "shard").select("shard", "frame", (F.col("inner") + F.col("before")).alias("first")))
    schema = "shard int, frame int, place int, goes_on boolean, last boolean, doc_id long, inner long, n long, crc long"

    def parts(batches):
        for pdf in batches:
            for f in pdf.itertuples(index=False):
                raw = memoryview(unpack(f.n_ids, f.vocabulary, f.control, f.data).astype("<u4").tobytes())
                n = np.asarray(f.lengths, np.int64)
                ends = np.cumsum(n)
                at = ends - n
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at, ends, strict=True)]
                k = len(n)
                yield pd.DataFrame(
                    {"shard": np.full(k, f.shard, np.int32), "frame": np.full(k, f.frame, np.int32), "place": np.arange(k, dtype=np.int32), "goes_on": (np.arange(k) == 0) & bool(f.goes_on), "last": np.arange(k) == k - 1, "doc_id": pd.array([None if d is None or d != d else int(d) for d in f.doc_ids], "Int64"), "inner": at, "n": n, "crc": crc}
                )

    # Read by three branches below: decoded once, and kept (a row for each document and frame).
    one = cut(frames.mapInPandas(parts, schema)).join(places, ["shard", "frame"])
    one = one.withColumn("start", F.col("first") + F.col("inner"))
    # What may be in several frames: the first and the last document of each. Number them by where they begin.
    edge = one.where("goes_on or last")
    begun = Window.partitionBy("shard").orderBy("frame", "place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("from", F.max(F.when(~F.col("goes_on"), F.col("start"))).over(begun))
    joined = edge.groupBy("shard", "from").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("start", "n", "crc"))).alias("parts"))
    whole = joined.select("doc_id", F.col("from").alias("start"), "n_tokens", _joined_crc("parts").alias("ids_crc32"))
    return one.where("not (goes_on or last)").select("doc_id", "start", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32")).union(whole)


def _joined_crc(column: str):
    @F.pandas_udf("long")
    def join(parts: pd.Series) -> pd.Series:
        return pd.Series([crc32_joined([(int(p["crc"]), 4 * int(p["n"])) for p in row]) for row in parts], dtype="int64")

    return join(F.col(column))


def crc32_joined(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of a concatenation from (CRC-32, length) of its parts: each is moved on by the length of what follows, as polynomials over GF(2)."""

    def times(a: int, b: int) -> int:
        out = 0
        while b:
            if b & 0x80000000:
                out ^= a
            b = b << 1 & 0xFFFFFFFF
            a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
        return out

    def power(n: int) -> int:  # x ** (8 n), bits reflected
        out, base = 0x80000000, 0x00800000
        while n:
            if n & 1:
                out = times(out, base)
            base, n = times(base, base), n >> 1
        return out

    crc = 0
    for c, n in parts:
        crc = times(crc, power(n)) ^ c if n else crc
    return crc


def token_files(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the ids of ``docs`` and reads the files back (see read_tokens). Without a ``path`` they are in the shared folder, and go when they have been read."""
    spark = docs.sparkSession
    where = path or f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, where, tokenizer)
    out = read_tokens(spark, where)
    if path is None:
        removed(spark, where)
    return out
