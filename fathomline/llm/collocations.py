"""Phrase collocations: count-min sketches find what may be frequent, a second pass counts that alone and exactly.

A sketch for each phrase length, shortest first: tasks count hashed phrases in sparse pieces of the sketch, the
pieces are added block by block, and of the sum only a bit for each cell remains (does it reach the least count?).
A cell never holds less than any of its phrases, so no frequent phrase is lost; a phrase enters the sketch of its
length only if its two shorter parts pass theirs, as neither can be rarer. The pass behind the sketches counts the
phrases themselves, as words and not as hashes. Scores and nested phrases are joins and aggregates of Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fathomline.llm.shared import cut, mix64, small_batches

#: Bytes that end a piece, and those that separate words in it.
PIECE_ENDS, BLANKS = b".,;:!?\n\x0b\x0c\r", b" \t"
#: The language of texts that state none.
NO_LANG = "und"
#: Bytes of text that are taken at a time; a single longer word is still taken whole.
SLICE = 2 << 20
#: Rows of a sketch, blocks of a row (whatever its cells, so that a slice gives as many pieces at every size), and the least and most cells of a row, all as
#: binary logarithms but the first. A row of bits has an eighth of as many bytes as cells.
ROWS, BLOCKS, LEAST_BITS, MOST_BITS = 2, 9, 20, 28
#: Hashes that a task holds before it gives them away as a piece of the sketch.
MOST_HELD = 2_000_000
#: Hash buckets in which a language's phrases are ranked before they are ranked together.
RANK_BUCKETS = 16

_BASE = 0x9E3779B97F4A7C15
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(PIECE_ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of the base and of its inverse modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, SLICE + 2)
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(m, base, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        if n > SLICE + 2:  # of a single long word: not kept
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


class _Slice:
    """The words of a stretch of one language's text: where they are, which piece they belong to, their hashes."""

    def __init__(self, lang: str, text: np.ndarray, old: int):
        """``old``: so many words at the start were in the slice before; phrases that end within them count there."""
        self.lang, self.old, self.text = lang, old, _LOWER[text]
        kind = _KIND[self.text]
        inside = np.concatenate(([False], kind == 0, [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.piece = np.searchsorted(np.flatnonzero(kind == 2), self.starts)
        up, down = _power(len(text) + 1)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((self.text.astype(np.uint64) + np.uint64(1)) * up[: len(text)], dtype=np.uint64)))
        seed = int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        length = (self.ends - self.starts).astype(np.uint64)
        self.first = mix64((total[self.ends] - total[self.starts]) * down[self.starts] + length * np.uint64(_BASE) ^ np.uint64(seed))

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, before: np.ndarray | None, n: int) -> np.ndarray:
        """Of the phrases of ``n`` words from each word on, by those of one word less."""
        return self.first if n == 1 else mix64(before[:-1] * np.uint64(0xD1342543DE82EF95) + self.first[n - 1 :])

    def one_piece(self, n: int) -> np.ndarray:
        return self.piece[n - 1 :] == self.piece[: len(self) - n + 1]

    def alive(self, bits: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """n, hashes and which phrases of ``n`` words may be frequent, for each sketch; then, without a sketch, which may enter the next one."""
        h = ok = None
        for n in range(1, len(bits) + 2):
            if n > len(self):
                return
            h = self.hashes(h, n)
            ok = np.ones(len(self), bool) if ok is None else ok[:-1] & ok[1:] & self.one_piece(n)
            if n <= len(bits):
                at = np.flatnonzero(ok)
                ok = np.zeros(len(ok), bool)
                ok[at[_passes(bits[n - 1], h[at])]] = True
            yield n, h, ok

    def new(self, ok: np.ndarray, n: int) -> np.ndarray:
        """Places of phrases that are ``ok`` and do not end among the words of the slice before."""
        at = np.flatnonzero(ok)
        return at[at + n > self.old]


def _cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return mix64(h + np.uint64((row + 1) * 0xA0761D6478BD642F & (1 << 64) - 1)) >> np.uint64(64 - width)


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """``bits``: an array of bytes for each row of the sketch."""
    out = np.ones(len(h), bool)
    for row, of in enumerate(bits):
        c = _cells(h, row, len(of).bit_length() + 2)
        out &= (of[c >> np.uint64(3)] >> (c & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def _slices(batches: Iterator[pa.RecordBatch], keep: int) -> Iterator[_Slice]:
    """The texts of each language, one behind the other, in slices of about ``SLICE`` bytes.

    A slice ends at the end of a piece; a longer piece is cut at a blank, and then the last ``keep`` words come again
    in the next slice.
    """
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}

    def cut_up(lang: str) -> Iterator[_Slice]:
        text, at, old = np.frombuffer(b"".join(held.pop(lang)), np.uint8), 0, 0
        sizes.pop(lang)
        while at < len(text):
            to, again, size = len(text), 0, SLICE
            while len(text) - at > size:
                kind = _KIND[text[at : at + size]]
                ends = np.flatnonzero(kind == 2)
                if len(ends):
                    to = at + int(ends[-1]) + 1
                    break
                inside = np.concatenate(([False], kind == 0))
                begins = np.flatnonzero(inside[1:] & ~inside[:-1])
                if len(begins) > keep + max(1, old):
                    # The last word may go on: it comes whole in the next slice, behind the words that phrases begin with.
                    to, begins, again = at + int(begins[-1]), begins[:-1], keep
                    break
                size += SLICE
            yield _Slice(lang, text[at:to], old)
            old, at = again, at + int(begins[-again]) if again else to

    for batch in batches:
        texts, langs = batch.column(0).cast(pa.large_binary()), batch.column(1).dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            mine = texts.filter(pc.equal(langs.indices, code)) if len(langs.dictionary) > 1 else texts
            one = b"\n".join([*mine.to_pylist(), b""])
            held.setdefault(lang, []).append(one)
            sizes[lang] = sizes.get(lang, 0) + len(one)
            if sizes[lang] >= SLICE:
                yield from cut_up(lang)
        if sum(sizes.values()) >= 4 * SLICE:
            yield from cut_up(max(sizes, key=sizes.get))
    for lang in list(held):
        yield from cut_up(lang)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one behind the other in the bytes ``data``."""
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


_PIECES = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("low", pa.binary()), ("high", pa.binary()), ("counts", pa.binary())])


def _piece_rows(row: int, cells: np.ndarray, counts: np.ndarray, bits: int, dtype: np.dtype) -> pa.RecordBatch:
    """A row of a sketch's piece for each block: steps from one cell to the next, low and high bytes apart, and counts. ``cells`` ascend; longer steps are taken in several, with counts of 0."""
    block = (cells >> np.uint64(bits)).astype(np.int64)
    low = (cells & np.uint64((1 << bits) - 1)).astype(np.int64)
    change = np.flatnonzero(block[1:] != block[:-1]) + 1
    before = np.concatenate(([-1], low[:-1]))
    before[change] = -1
    step = low - before
    more = (step - 1) // 0xFFFF
    ends = np.cumsum(more + 1)
    steps, numbers = np.full(ends[-1], 0xFFFF, np.uint16), np.zeros(ends[-1], dtype)
    steps[ends - 1], numbers[ends - 1] = step - more * 0xFFFF, counts
    last = np.concatenate((change, [len(block)]))
    to = ends[last - 1]
    return pa.record_batch([pa.array(np.full(len(last), row, np.int32)), pa.array(block[last - 1].astype(np.int32)), _binary((steps & 0xFF).astype(np.uint8), to), _binary((steps >> 8).astype(np.uint8), to), _binary(numbers, to * dtype.itemsize)], schema=_PIECES)


def _entering(part: _Slice, bits: list) -> np.ndarray:
    """The hashes of a slice's phrases that enter the sketch behind those of ``bits``."""
    for n, h, ok in part.alive(bits):
        if n > len(bits):
            return h[part.new(ok, n)]
    return np.zeros(0, np.uint64)


def _sketch_pieces(hashes: Iterator[np.ndarray], width: int, dtype: np.dtype) -> Iterator[pa.RecordBatch]:
    """Pieces of a sketch: equal hashes of a task are added up before, as far as they are held."""
    found, counts, fresh, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every, at = np.unique(np.concatenate((found, *fresh)), return_inverse=True)
        weights = np.concatenate((counts, np.ones(len(at) - len(found), np.int64)))
        return every, np.bincount(at, weights, len(every)).astype(np.int64)

    def given() -> Iterator[pa.RecordBatch]:
        for row in range(ROWS):
            cells = _cells(found, row, width)
            order = np.argsort(cells, kind="stable")
            cells, of = cells[order], counts[order]
            first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            of = np.minimum(np.add.reduceat(of, first), np.iinfo(dtype).max).astype(dtype)
            yield _piece_rows(row, cells[first], of, width - BLOCKS, dtype)

    for h in hashes:
        fresh.append(h)
        n += len(h)
        if len(found) + n >= MOST_HELD:
            found, counts = merged()
            fresh, n = [], 0
            if 2 * len(found) >= MOST_HELD:
                yield from given()
                found, counts = found[:0], counts[:0]
    found, counts = merged()
    if len(found):
        yield from given()


def _sketch(texts: DataFrame, bits: list, shared, width: int, min_count: int, max_words: int) -> np.ndarray:
    """The cells of the sketch of the next length that reach ``min_count``: bits, an array of bytes for each row."""
    dtype = np.dtype(np.min_scalar_type(min_count))

    def pieces(batches):
        known = [b.value for b in shared]
        return _sketch_pieces((_entering(part, known) for part in _slices(batches, max_words - 1)), width, dtype)

    def merged(batches):
        now, total = None, np.zeros(1 << width - BLOCKS, np.uint64)

        def row():
            packed = np.packbits(total >= min_count, bitorder="little").tobytes()
            return pa.record_batch([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([packed], pa.binary())], names=["row", "block", "bits"])

        for batch in batches:
            for r, block, low, high, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != (r, block):
                    if now is not None:
                        yield row()
                    now = (r, block)
                    total[:] = 0
                steps = np.frombuffer(low, np.uint8) + (np.frombuffer(high, np.uint8).astype(np.int64) << 8)
                total[np.cumsum(steps) - 1] += np.frombuffer(counts, dtype)
        if now is not None:
            yield row()

    out = np.zeros((ROWS, 1 << width - 3), np.uint8)
    parts = texts.mapInArrow(pieces, "row int, block int, low binary, high binary, counts binary").repartition("row", "block").sortWithinPartitions("row", "block")
    size = 1 << width - BLOCKS - 3
    for r in parts.mapInArrow(merged, "row int, block int, bits binary").collect():
        out[r["row"], r["block"] * size : (r["block"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


_COUNTS = pa.schema([("key", pa.string()), ("f", pa.int64())])


def _counted(part: _Slice, bits: list) -> Iterator[pa.RecordBatch]:
    """The phrases of a slice that may be frequent, behind their language and a line feed, with their counts there; an empty phrase has the number of all words."""

    def batch(phrases: pa.Array, f: np.ndarray) -> pa.RecordBatch:
        return pa.record_batch([pc.binary_join_element_wise(pa.scalar(part.lang), phrases, "\n"), pa.array(f.astype(np.int64))], schema=_COUNTS)

    if len(part) > part.old:
        yield batch(pa.array([""]), np.array([len(part) - part.old]))
    ids = groups = words = None
    for n, _, ok in part.alive(bits):
        if n > len(bits) or not ok.any():
            return
        at = np.flatnonzero(ok)
        if n == 1:
            # Words of the slice that may be frequent, as a dictionary: equal ids are equal words.
            starts, ends = part.starts[at], part.ends[at]
            step = np.zeros(len(part.text) + 1, np.int8)
            step[starts] += 1
            step[ends] -= 1
            data = part.text[np.cumsum(step[:-1], dtype=np.int8).astype(bool)]
            offsets = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int32)
            coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())).dictionary_encode()
            words = coded.dictionary
            ids = np.full(len(part), -1, np.int64)
            ids[at] = np.asarray(coded.indices)
            key = ids[at]
        else:
            key = groups[at] * len(words) + ids[at + n - 1]
        found, first, group = np.unique(key, return_index=True, return_inverse=True)
        groups = np.full(len(part), -1, np.int64)
        groups[at] = group
        count = np.bincount(group[at + n > part.old], minlength=len(found))
        mine = at[first[count > 0]]
        if len(mine):
            phrases = pc.binary_join_element_wise(*[words.take(pa.array(ids[mine + i])) for i in range(n)], " ") if n > 1 else words.take(pa.array(ids[mine]))
            yield batch(phrases, count[count > 0])


def sketch_bits(size: int) -> int:
    """The binary logarithm of the cells of a sketch's row for texts of ``size`` bytes: about sixteen bytes for a cell, within the bounds."""
    return min(MOST_BITS, max(LEAST_BITS, (max(1, size // 16) - 1).bit_length()))


def phrase_counts(docs: DataFrame, min_count: int = 10, max_words: int = 3, width: int | None = None) -> DataFrame:
    """lang, words, phrase, f of all phrases of 1 to ``max_words`` words with f >= ``min_count``, and for each language a row of 0 words, whose f is the number of all words.

    Texts are lower-cased in A-Z and split at ``PIECE_ENDS``; phrases are runs of words within a piece. Null texts are
    empty, null languages are ``und``, repeated rows count each; texts count in whole; an empty table gives an empty one;
    columns but text and lang are ignored. ``width``: see :func:`sketch_bits`; what the sketches let through is
    counted exactly, so it changes no result. At most ``max_words`` * 64 MB of bits are sent to the tasks.
    """
    if min_count < 1 or max_words < 1:
        raise ValueError("min_count and max_words are at least 1")
    spark = docs.sparkSession
    texts = small_batches(docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang")))
    if width is None:
        width = sketch_bits(int(texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0))
    bits, shared = [], []
    for _ in range(max_words):
        bits.append(_sketch(texts, bits, shared, width, min_count, max_words))
        shared.append(spark.sparkContext.broadcast(bits[-1]))

    def counted(batches):
        known = [b.value for b in shared]
        for part in _slices(batches, max_words - 1):
            yield from _counted(part, known)

    f = texts.mapInArrow(counted, "key string, f long").groupBy("key").agg(F.sum("f").alias("f"))
    phrase = F.substring_index("key", "\n", -1)
    f = f.withColumn("phrase", phrase).where((F.col("f") >= min_count) | (F.col("phrase") == ""))
    words = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    out = cut(f.select(F.left("key", F.length("key") - F.length("phrase") - 1).alias("lang"), words.alias("words"), "phrase", "f"))
    for b in shared:
        b.destroy()
    return out


def scored(counts: DataFrame, max_words: int = 3, covered_percent: int = 50) -> DataFrame:
    """Phrases of 2 words or more of :func:`phrase_counts` that no longer one covers: lang, phrase, a, l, r, score.

    Cut behind its first k words, a phrase scores floor(1000000 * a * a / (l * r)), a, l and r being the counts of the
    phrase, of its first and of its last part; the lowest score counts, of equal ones that with the smallest k. A phrase
    goes if its words lie within a longer one with 100 * count >= ``covered_percent`` * a, whether that one stays or not.
    Products are decimals of 38 digits, exact for counts up to 10^15.
    """
    found = counts.where("words >= 2").withColumn("w", F.split("phrase", " "))
    join = lambda start, n: F.concat_ws(" ", F.slice("w", start, n))
    parts = []
    for k in range(1, max_words):
        for side, start, n in (("l", F.lit(1), F.lit(k)), ("r", F.lit(k + 1), F.col("words") - k)):
            parts.append(F.when(F.col("words") > k, F.struct(join(start, F.greatest(n, F.lit(0))).alias("part"), F.lit(f"{side}{k}").alias("place"))))
    asked = found.select("lang", "phrase", "f", F.explode(F.array_compact(F.array(*parts))).alias("p")).select("lang", "phrase", "f", "p.part", "p.place")
    known = counts.where("words >= 1").select(F.col("lang").alias("known_lang"), F.col("phrase").alias("known"), F.col("f").alias("of"))
    met = asked.join(known, (F.col("lang") == F.col("known_lang")) & (F.col("part") == F.col("known")))
    places = [f"{s}{k}" for k in range(1, max_words) for s in "lr"]
    rows = met.select("lang", "phrase", F.col("f").alias("a"), *[F.when(F.col("place") == p, F.col("of")).alias(p) for p in places], F.lit(None).cast("long").alias("longer"))
    for n in range(2, max_words):
        for start in range(1, max_words - n + 2):
            inner = found.where((F.col("words") > n) & (F.col("words") >= start + n - 1))
            empty = [F.lit(None).cast("long").alias(c) for c in ("a", *places)]
            rows = rows.unionByName(inner.select("lang", join(F.lit(start), F.lit(n)).alias("phrase"), *empty, F.col("f").alias("longer")))
    one = rows.groupBy("lang", "phrase").agg(*[F.max(c).alias(c) for c in ("a", *places, "longer")])
    kept = one.where(F.col("longer").isNull() | (100 * F.col("longer") < covered_percent * F.col("a")))
    big = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = []
    for k in range(1, max_words):
        both = f"cast(cast(1000000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(a as decimal(38,0)) as decimal(38,0)) div cast(cast(l{k} as decimal(38,0)) * cast(r{k} as decimal(38,0)) as decimal(38,0))"
        cuts.append(F.when(F.col(f"l{k}").isNotNull(), F.struct(F.expr(both).cast("long").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r"))))
    best = F.array_min(F.array_compact(F.array(*cuts)))
    return kept.withColumn("b", best).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def collocations(docs: DataFrame, min_count: int = 10, max_words: int = 3, covered_percent: int = 50, top: int = 2000, width: int | None = None) -> DataFrame:
    """Each language's first ``top`` phrases by score, then count (both descending), then the phrase in byte order: lang, rank, phrase, a, l, r, n, score.

    n is the number of all words of the language. Null and empty texts have no words, null languages are ``und``; very
    long texts count in whole; repeated rows count each; no two phrases tie, as they differ in the last key; an empty
    table gives an empty one; columns but text and lang are ignored, whatever their names. A language's phrases are
    ranked within hash buckets first, so that no task gets all of them.
    """
    counts = phrase_counts(docs, min_count, max_words, width)
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    found = scored(counts, max_words, covered_percent).withColumn("bucket", F.pmod(F.xxhash64("phrase"), F.lit(RANK_BUCKETS)))
    near = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "bucket").orderBy(*order))).where(F.col("rank") <= top)
    first = near.drop("rank", "bucket").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    n = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    out = first.join(n, "lang")
    return out.select("lang", F.col("rank").cast(T.LongType()).alias("rank"), "phrase", "a", "l", "r", "n", "score")
