"""Deduplication of references: exact, pairwise similar, greedy in order of confidence, clusters of a company-year."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fathomline.operators.graph import connected_components
from fathomline.operators.index import rounded
from fathomline.operators.lineage import kept


def exact(df: DataFrame, keys: list[str], text: str, confidence: str, order: str) -> DataFrame:
    """Of rows that agree in ``keys`` and the first 100 characters (white space collapsed), the most confident, then the first."""
    k = F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, 100)
    w = Window.partitionBy(*keys, k).orderBy(F.desc(confidence), order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def tokens(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda x: x != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets given as arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either > 0, both / either).otherwise(0.0)


def similar_pairs(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """Pairs with a token Jaccard of ``threshold`` or more."""
    name = F.col("id").cast("string")
    sets = kept(_hashed(df, key, text, name))
    return _pairs_within(_candidates(sets, threshold), sets.select("id", "k", "k2"), df, key, text, name, threshold)


def similar_classes(df: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    """As similar_pairs, with rows of equal token sets as one class, named by its smallest key.

    Rows are the pairs of similar classes, and each further row of a class beside the class's name (Jaccard 1): a pair
    is similar if its classes are equal or paired. A group of copies takes as many rows as it has members.
    """
    sets = kept(_hashed(df, key, text, _words("set")))
    first = kept(sets.groupBy("k", "k2").agg(F.min("id").alias("id")))
    copies = sets.select(F.col("id").alias("id_b"), "k", "k2").join(first, ["k", "k2"]).where("id < id_b").select(F.col("id").alias("id_a"), "id_b", F.lit(1.0).alias("jaccard"))
    return _pairs_within(_candidates(sets, threshold), first, df, key, text, _words("set"), threshold).unionByName(copies)


def _words(c: str) -> Column:
    return F.array_join(F.array_sort(c), " ")


def _two_hashes(*of: Column) -> list[Column]:
    return [F.xxhash64(*of).alias("k"), F.xxhash64(F.lit(1), *of).alias("k2")]


def _hashed(df: DataFrame, key: str, text: str, of: Column) -> DataFrame:
    """id, k and k2 (128 bits of a hash of ``of``), h: the tokens of each text that has any, hashed: two of one hash can only add candidates."""
    sets = df.where(F.col(text).rlike(r"\S")).select(F.col(key).alias("id"), tokens(F.col(text)).alias("set"))
    return sets.select("id", *_two_hashes(of), F.transform("set", lambda t: F.xxhash64(t)).alias("h"))


def _picked(rows: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """``rows`` joined with ``keys``, which are sent if they are few, so that the rows are not shuffled."""
    few = keys.limit(MOST_SENT + 1).count() <= MOST_SENT
    return rows.join(F.broadcast(keys) if few else keys, on)


def _pairs_within(ties: DataFrame, names: DataFrame, df: DataFrame, key: str, text: str, of: Column, threshold: float) -> DataFrame:
    """All similar pairs of ids, with the Jaccard of their tokens, within the components of ``ties``; only texts that have a tie are read again.

    A component is dealt into blocks of about CELL_SETS sets, and every two of its blocks are one task's work; small components share one.
    """
    parts = connected_components(ties).select(F.col("node").alias("k"), "root")
    named = kept(_picked(names, parts, "k").select("id", F.col("k").alias("__k"), F.col("k2").alias("__k2"), "root"))
    sizes = named.groupBy("root").agg(F.ceil(F.count("*") / CELL_SETS).cast("int").alias("chunks"))
    bins = -(-named.count() // CELL_SETS) or 1
    # Kept before tokens are taken, so that those of all other texts are not.
    texts = kept(_picked(df.select(F.col(key).alias("id"), F.col(text).alias("__text")), named.join(sizes, "root"), "id"))
    sets = texts.withColumn("set", tokens(F.col("__text"))).withColumns({"k": _two_hashes(of)[0], "k2": _two_hashes(of)[1]}).where("k = __k and k2 = __k2")
    block = F.pmod(F.xxhash64("id", F.lit(3)), F.col("chunks")).cast("int")
    part = F.when(F.col("chunks") == 1, F.pmod(F.xxhash64("root"), F.lit(bins))).otherwise(F.col("root"))
    rows = sets.select("id", "root", part.alias("part"), block.alias("block"), F.array_join("set", " ").alias("words"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("o"))
    rows = rows.withColumn("i", F.least("block", "o")).withColumn("j", F.greatest("block", "o")).drop("o")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"i": pdf["id"][:0], "j": pdf["id"][:0], "both": [], "either": []})]
        split = pdf["i"].iloc[0] != pdf["j"].iloc[0]
        for _, g in pdf.drop_duplicates(["id", "words"]).groupby("root", sort=False):
            words = [w.split(" ") for w in g["words"]]
            n, of = np.array([len(w) for w in words]), np.repeat(np.arange(len(words)), [len(w) for w in words])
            code = pd.factorize(np.concatenate(words))[0]
            many = np.bincount(code) > 1
            used, number = many[code], np.cumsum(many) - 1
            of, code = of[used], number[code[used]]
            both = np.zeros((len(n), len(n)), np.float32)
            for at in range(0, int(many.sum()), 2048):
                here = (code >= at) & (code < at + 2048)
                has = np.zeros((len(n), 2048), np.float32)
                has[of[here], code[here] - at] = 1
                both += has @ has.T
            either = n[:, None] + n[None, :] - both
            near = np.triu(both >= (threshold - 1e-6) * either, 1)
            if split:
                near &= g["block"].to_numpy()[:, None] != g["block"].to_numpy()[None, :]
            a, b = np.nonzero(near)
            if len(a):
                ids = g["id"].to_numpy()
                out.append(pd.DataFrame({"i": ids[a], "j": ids[b], "both": both[a, b], "either": either[a, b]}))
        return pd.concat(out[1:] or out)

    kind = df.schema[key].dataType.simpleString()
    out = rows.groupBy("part", "i", "j").applyInPandas(compare, f"i {kind}, j {kind}, both long, either long").where("i <> j")
    out = out.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"), F.round(F.col("both") / F.col("either"), 6).alias("jaccard"))
    return out.where(F.col("jaccard") >= threshold)


#: Slots in which tokens are counted (a byte each is sent), tokens of sets for each bucket (about), pairs compared at a time.
SLOT_BITS, BUCKET_TOKENS, PAIRS_AT_ONCE = 24, 12_000_000, 1 << 18
#: Bits of the smallest and of the largest parity map, keys that are sent at most to pick rows by.
LEAST_BITS, MOST_BITS, MOST_SENT = 128, 4096, 500_000
#: Sets of a component in one block.
CELL_SETS = 1000


def _levels(sets: DataFrame) -> np.ndarray:
    """For each slot of hashes how many tokens of sets fall into it, as a byte that grows with the number: 0 for one at most."""
    slots = sets.select(F.explode("h").alias("h")).groupBy(F.shiftrightunsigned("h", 64 - SLOT_BITS).cast("int").alias("slot")).agg(F.count("*").alias("n"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf["slot"].to_numpy()
        out = np.zeros(1 << 16, np.uint8)
        out[at & 0xFFFF] = np.minimum(255, np.floor(8 * np.log2(pdf["n"].to_numpy())))
        return pd.DataFrame({"part": [int(at[0]) >> 16], "levels": [out.tobytes()]})

    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    for row in slots.groupBy(F.shiftright("slot", 16)).applyInPandas(pack, "part int, levels binary").toLocalIterator():
        levels[row["part"] << 16 : (row["part"] + 1) << 16] = np.frombuffer(row["levels"], np.uint8)
    return levels


def _least_shared(low: float, both: np.ndarray) -> np.ndarray:
    """Of two sets of ``both`` tokens together, how many they share at least if they are similar."""
    return np.ceil(low / (1 + low) * both - 1e-9).astype(np.int64)


def _rare_tokens(sent, low: float, buckets: int):
    """Batches of k, k2, h: for each set and bucket of tokens a row with the set's size and parity map and its rarest tokens there, with their places."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column("h")
        h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        of, begin = np.repeat(np.arange(len(n)), n), np.cumsum(n) - n
        level = sent.value[h >> np.uint64(64 - SLOT_BITS)]
        # Any order that all sets share will do; the rarest come first.
        order = np.lexsort((h, level, of))
        place = np.arange(len(h)) - begin[of]
        used = (place < (n - np.ceil(low * n - 1e-9).astype(np.int64) + 1)[of]) & (level[order] > 0)
        h_used, of_used, place = h[order][used], of[used], place[used]
        bits = np.minimum(MOST_BITS, np.maximum(LEAST_BITS, 1 << np.ceil(np.log2(1.5 * n)).astype(np.int64)))
        edge = np.concatenate(([0], np.cumsum(bits)))
        odd = np.bincount(edge[of] + (h & (bits[of] - 1).astype(np.uint64)).astype(np.int64), minlength=edge[-1]) & 1
        maps = np.packbits(odd.astype(np.uint8))
        bucket = ((h_used >> np.uint64(12)) & np.uint64(0xFFFFF)).astype(np.int64) % buckets
        order = np.lexsort((bucket, of_used))
        h_used, of_used, place, bucket = h_used[order], of_used[order], place[order], bucket[order]
        new = np.flatnonzero(np.diff(of_used * buckets + bucket, prepend=-1))
        ends = pa.array(np.append(new, len(h_used)).astype(np.int32))
        row = of_used[new]
        cols = {
            "bucket": pa.array(bucket[new].astype(np.int32)),
            "k": batch.column("k").take(pa.array(row)),
            "k2": batch.column("k2").take(pa.array(row)),
            "n": pa.array(n[row].astype(np.int32)),
            "map": pa.array([maps[a:b].tobytes() for a, b in zip(edge[row] >> 3, edge[row + 1] >> 3, strict=True)], pa.binary()),
            "tokens": pa.ListArray.from_arrays(ends, pa.array(h_used.astype(np.uint32).view(np.int32))),
            "places": pa.ListArray.from_arrays(ends, pa.array(place.astype(np.int32))),
        }
        return pa.RecordBatch.from_pydict(cols)

    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 1000):
                yield one(batch.slice(at, 1000))

    return run


def _maps_by_size(raw: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each number of words: the row of each set (-1: none), and the maps of sets of that size and of larger ones, folded to it."""
    words = np.fromiter((len(x) // 8 for x in raw), np.int64, len(raw))
    out = {}
    for w in np.unique(words):
        at, rows, n = np.full(len(raw), -1), [], 0
        for v in np.unique(words[words >= w]):
            of = np.flatnonzero(words == v)
            at[of] = n + np.arange(len(of))
            rows.append(np.bitwise_xor.reduce(np.frombuffer(b"".join(raw[i] for i in of), np.uint64).reshape(len(of), -1, w), axis=1))
            n += len(of)
        out[int(w)] = at, np.concatenate(rows)
    return out


def _meet(low: float):
    """The rows of a bucket: ties a, b of sets (k) that share a rare token and may be similar, by sizes, places and parity maps, enough of them for the components of all such pairs."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        cols = {c: table.column(c).to_numpy() for c in ("k", "k2", "n")}
        order = np.lexsort((cols["k2"], cols["k"], cols["n"]))
        k, k2, n = (cols[c][order] for c in ("k", "k2", "n"))
        # Equal sets meet as one.
        first = np.concatenate(([True], (k[1:] != k[:-1]) | (k2[1:] != k2[:-1])))
        table, k, n = table.take(pa.array(order[first])), k[first], n[first].astype(np.int64)
        maps = _maps_by_size(table.column("map").to_pylist())
        size = pc.binary_length(table.column("map")).to_numpy().astype(np.int64) // 8
        lists = table.column("tokens").combine_chunks()
        count = np.diff(lists.offsets.to_numpy())
        token = lists.flatten().to_numpy().view(np.uint32).astype(np.uint64) << np.uint64(32)
        place = table.column("places").combine_chunks().flatten().to_numpy()
        of = np.repeat(np.arange(len(n)), count)
        order = np.argsort(token | of.astype(np.uint64), kind="stable")
        token, of, place = token[order], of[order], place[order].astype(np.int64)
        # Of two sets the smaller, which comes first, shares one of fewer rare tokens.
        index = np.flatnonzero(place < (n - _least_shared(low, 2 * n) + 1)[of])
        known = token[index] | of[index].astype(np.uint64)
        start = np.searchsorted(known, token | np.searchsorted(n, np.ceil(low * n - 1e-9))[of].astype(np.uint64))
        many = np.searchsorted(known, token | of.astype(np.uint64)) - start
        up = np.arange(len(n))
        found = [np.zeros(0, np.int64)]

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        def roots() -> np.ndarray:
            while not np.array_equal(top := up[up], up):
                up[:] = top
            return up

        def compare(i: np.ndarray, j: np.ndarray, first: np.ndarray, second: np.ndarray) -> None:
            least = _least_shared(low, n[i] + n[j])
            may = (np.minimum(n[i] - first, n[j] - second) >= least) & (n[i] >= low * n[j] - 1e-9) & (i < j)
            may &= (top := roots())[i] != top[j]
            i, j, least = i[may], j[may], least[may]
            differ = n[i] + n[j] - 2 * least
            for w in np.unique(size[i]):
                sel = np.flatnonzero(size[i] == w)
                where, rows = maps[int(w)]
                apart = np.bitwise_count(rows[where[i[sel]]] ^ rows[where[j[sel]]]).sum(axis=1, dtype=np.int64)
                near = sel[apart <= differ[sel]]
                tied = []
                for p in np.unique(i[near] << 32 | j[near]).tolist():
                    a, b = root(p >> 32), root(p & 0xFFFFFFFF)
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        tied.append(p)
                found.append(np.array(tied, np.int64))

        if len(of):
            # Every set of a token with the first: a group of near copies is one component then, and is not compared with itself.
            head = np.flatnonzero(np.diff(token, prepend=token[:1] - np.uint64(1)))
            length = np.diff(np.append(head, len(token)))
            top = np.repeat(head, length)
            for at in range(0, len(of), PAIRS_AT_ONCE):
                part = slice(at, at + PAIRS_AT_ONCE)
                compare(of[top[part]], of[part], place[top[part]], place[part])
            whole = np.minimum.reduceat(roots()[of], head) == np.maximum.reduceat(up[of], head)
            many[np.repeat(whole, length)] = 0
        ends = np.cumsum(many)
        at = 0
        while at < len(many):
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + PAIRS_AT_ONCE, "right")))
            own = np.repeat(np.arange(at, to), many[at:to])
            other = index[start[own] + np.arange(len(own)) - np.repeat(ends[at:to] - many[at:to] - before, many[at:to])]
            compare(of[other], of[own], place[other], place[own])
            at = to
        pairs = np.concatenate(found)
        return pa.table({"a": k[pairs >> 32], "b": k[pairs & 0xFFFFFFFF]})

    return run


def _candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """Ties a, b between keys k of sets that may be similar, enough of them for the components of all similar pairs, few wrong; ``sets`` (k, k2, h: 64-bit hashes of tokens) is read three times.

    Prefix filter: a pair must share one of the rarest tokens of either side. How rare a token is, is told by counts in a bounded number of
    slots (a shared slot makes a token seem more frequent, and loses nothing), so that no token is shuffled to be counted
    but those of the prefixes, bucket by bucket. Beside them goes a parity map of the whole set: each token flips a bit, so maps
    differ in no more bits than the sets in tokens. Pairs are compared where they meet, and of a bucket's no more are written than connect its sets. Buckets have
    about as many tokens each, whatever the input, and a row for each set in a bucket. A wrong tie can only join components.
    """
    low = threshold - 1e-6  # Jaccards are rounded to six places
    spark = sets.sparkSession
    total = sets.agg(F.sum(F.size("h"))).first()[0] or 0
    sent = spark.sparkContext.broadcast(_levels(sets))
    buckets = max(2 * spark.sparkContext.defaultParallelism if total > 1_000_000 else 2, -(-total // BUCKET_TOKENS))
    rare = sets.select("k", "k2", "h").mapInArrow(_rare_tokens(sent, low, buckets), "bucket int, k long, k2 long, n int, map binary, tokens array<int>, places array<int>")
    out = rare.groupBy("bucket").applyInArrow(_meet(low), "a long, b long")
    return kept(out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _ties_of_sets(sets: DataFrame, threshold: float) -> DataFrame:
    """Ties a, b between similar sets (id, set; further bits of equal sets' ids as k2), enough of them to have the components of all similar pairs, without all pairs.

    A few ties may be wrong, as maps of bits are compared: they can only join components.
    """
    hashed = F.col("set") if sets.schema["set"].dataType.elementType == T.LongType() else F.transform("set", lambda t: F.xxhash64(t))
    return _candidates(sets.select(F.col("id").alias("k"), (F.col("k2") if "k2" in sets.columns else F.lit(0).cast("long")).alias("k2"), hashed.alias("h")), threshold).where("a <> b")


def _greedy(similar, n: int) -> list[int]:
    """For each item, in order, the first earlier representative that it is similar to, else itself."""
    heads: list[int] = []
    out = []
    for i in range(n):
        hit = similar(i, heads) if heads else None
        out.append(i if hit is None else hit)
        if hit is None:
            heads.append(i)
    return out


def greedy_jaccard(df: DataFrame, group: list[str], key: str, text: str, confidence: str, threshold: float) -> DataFrame:
    """key, cluster (the key of its representative): items of a group in order of confidence join the first similar representative.

    Order-dependent by definition. What an item joins depends on similar items alone, so the order matters only within
    a component of the group's graph of similar items: components are found first, by an equality join on rare tokens,
    and each is one task's work. Items that are similar to none are their own clusters.
    """
    schema = T.StructType([*[df.schema[g] for g in group], df.schema[key], T.StructField("cluster", df.schema[key].dataType)])
    node = F.struct(*[F.col(c) for c in (*group, key)])
    # Tokens of a group are told apart from those of all others, so that items meet within their group alone.
    sets = df.where(F.col(text).rlike(r"\S")).select(node.alias("id"), tokens(F.col(text)).alias("set"))
    hashed = F.transform("set", lambda x: F.xxhash64(*[F.col("id")[c] for c in group], x))
    # Texts are split once, whatever reads the sets; equal sets of a group are one class.
    sets = kept(sets.select("id", *_two_hashes(*[F.col("id")[c] for c in group], _words("set")), hashed.alias("h")))
    of_class = connected_components(_ties_of_sets(sets.select(F.col("k").alias("id"), "k2", F.col("h").alias("set")), threshold))
    rooted = kept(sets.select("id", "k").join(of_class, F.col("k") == F.col("node"), "left").select(F.col("id").alias("__node"), F.coalesce("root", "k").alias("__root")))
    many = rooted.groupBy("__root").agg(F.count("*").alias("n")).where("n > 1").select("__root")
    parts = kept(rooted.join(many, "__root", "left_semi").select("__node", "__root"))
    tied = _picked(df.select(*group, key, text, confidence, node.alias("__node")), parts, "__node").drop("__node")
    alone = df.select(*group, key, node.alias("__node")).join(parts, "__node", "left_anti").select(*group, key, F.col(key).alias("cluster"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([confidence, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        sets = [frozenset((t or "").lower().split()) for t in pdf[text]]
        first: dict[frozenset, int] = {}
        where: dict[str, list[int]] = {}  # representatives by token
        out = np.empty(len(pdf), int)
        for i, s in enumerate(sets):
            if s in first:
                out[i] = first[s]
                continue
            counts: dict[int, int] = {}
            for t in s:
                for h in where.get(t, ()):
                    counts[h] = counts.get(h, 0) + 1
            hits = [h for h, c in counts.items() if c / (len(s) + len(sets[h]) - c) >= threshold]
            out[i] = min(hits, default=i)
            first[s] = out[i]
            if out[i] == i:
                for t in s:
                    where.setdefault(t, []).append(i)
        res = pdf[[*group, key]].copy()
        res["cluster"] = pdf[key].to_numpy()[out]
        return res

    return tied.groupBy(*group, "__root").applyInPandas(run, schema).unionByName(alone)


#: Pivots of a group, and rows of either side that one task compares.
MOST_PIVOTS, BLOCK_ROWS = 32, 2048


def _cosine_ties(vectors: DataFrame, threshold: float) -> DataFrame:
    """Ties a, b between ids of vectors (grp, id, v: of length 1) whose cosine in their group is ``threshold`` or more: enough for the components of all such pairs.

    The angle is a distance on the sphere, so the triangle inequality holds for it: a vector of the cell of pivot p
    cannot be within the angle of any in the cell of q if its angle to q exceeds that to p by more than twice as much.
    Every vector goes to its nearest pivot's cell and to the cells (of smaller number) where that does not rule it
    out; the rows of a cell are dealt into blocks, and every two blocks are one task. A block's ties are a forest, not all pairs.
    """
    angle = float(np.arccos(min(1.0, threshold))) + 1e-6
    hashed = vectors.withColumn("h", F.xxhash64("id", F.lit(7)))
    first = Window.partitionBy("grp").orderBy("h", "id")
    pivots = hashed.withColumn("pivot", F.row_number().over(first) - 1).where(F.col("pivot") < MOST_PIVOTS).select("grp", "pivot", "v")
    chunks = vectors.groupBy("grp").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("chunks"))
    dealt = vectors.join(chunks, "grp").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).select("grp", "chunk", "id", "v")
    sent = pivots.join(chunks, "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("grp", "chunk", "pivot", "v").toDF("of", "part", "pivot", "at")

    def place(rows: pd.DataFrame, by: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"grp": [], "cell": [], "home": [], "id": [], "v": []})
        by = by.sort_values("pivot")
        far = np.arccos(np.clip(np.stack(rows["v"].to_numpy()) @ np.stack(by["at"].to_numpy()).T, -1.0, 1.0))
        near = far.argmin(axis=1)
        visits = far - far[np.arange(len(far)), near][:, None] <= 2 * angle
        visits &= np.arange(far.shape[1])[None, :] <= near[:, None]
        visits[np.arange(len(far)), near] = True
        at, cell = np.nonzero(visits)
        out = rows.iloc[at][["grp", "id", "v"]].copy()
        out["cell"], out["home"] = cell.astype(np.int32), near[at] == cell
        return out[["grp", "cell", "home", "id", "v"]]

    kind = vectors.schema["id"].dataType.simpleString()
    placed = kept(dealt.groupBy("grp", "chunk").cogroup(sent.groupBy("of", "part")).applyInPandas(place, f"grp string, cell int, home boolean, id {kind}, v array<double>"))
    blocks = placed.groupBy("grp", "cell").agg(F.ceil(F.count_if("home") / BLOCK_ROWS).cast("int").alias("homes"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("all"))
    rows = placed.join(blocks, ["grp", "cell"])
    block = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = rows.where("home").withColumn("i", block("homes", 1)).withColumn("j", every("all")).withColumn("asks", F.lit(False))
    asking = rows.where("homes > 0").withColumn("j", block("all", 2)).withColumn("i", every("homes")).withColumn("asks", F.lit(True))
    cols = ["grp", "cell", "i", "j", "asks", "id", "v"]

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        ask, home = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        if not len(ask) or not len(home):
            return pd.DataFrame({"a": [], "b": []})
        names, ids = np.unique(np.concatenate((ask["id"].to_numpy(), home["id"].to_numpy())), return_inverse=True)
        left, right = ids[: len(ask)], ids[len(ask) :]
        near = np.stack(ask["v"].to_numpy()) @ np.stack(home["v"].to_numpy()).T >= threshold - 1e-9
        up = np.arange(len(names))

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for i, row in zip(left, near, strict=True):
            # Those that share a root with the one before need no second look.
            for j in np.unique(up[right[np.flatnonzero(row)]]):
                a, b = root(int(i)), root(int(j))
                up[max(a, b)] = min(a, b)
        top = np.array([root(x) for x in range(len(names))])
        tied = np.flatnonzero(top != np.arange(len(names)))
        return pd.DataFrame({"a": names[top[tied]], "b": names[tied]})

    return own.select(*cols).unionByName(asking.select(*cols)).groupBy("grp", "cell", "i", "j").applyInPandas(meet, f"a {kind}, b {kind}")


def greedy_cosine(df: DataFrame, group: list[str], key: str, vector: str, confidence: str, threshold: float = 0.85) -> DataFrame:
    """As greedy_jaccard, by cosine of vectors, with a ``threshold`` over 0.

    What a vector joins depends on similar vectors alone, so the order matters within a component of a group's graph
    of similar vectors: components come first (see :func:`_cosine_ties`), and each is one task's work; no task holds
    a whole group unless all of it is similar. Vectors of different lengths are not similar, nor are null, empty and zero vectors to any: they are
    clusters of their own. Of equal confidences the smaller key goes first; equal vectors join like others; a row that
    repeats a key is judged as one vector of that key; an empty table gives an empty one.
    """
    if threshold <= 0:
        raise ValueError("the threshold of cosines is over 0")
    schema = T.StructType([*[df.schema[g] for g in group], df.schema[key], T.StructField("cluster", df.schema[key].dataType)])
    norm = F.sqrt(F.aggregate("__v", F.lit(0.0), lambda s, x: s + x * x))
    rows = df.select(*group, key, confidence, F.col(vector).cast("array<double>").alias("__v")).withColumn("__n", norm)
    rows = kept(rows.withColumn("__id", F.monotonically_increasing_id()))
    unit = rows.where("__n > 0").select(F.to_json(F.struct(*group, F.size("__v").alias("__size"))).alias("grp"), F.col("__id").alias("id"), F.transform("__v", lambda x: x / F.col("__n")).alias("v"))
    parts = connected_components(_cosine_ties(unit, threshold)).select(F.col("node").alias("__id"), F.col("root").alias("__root"))
    tied = rows.join(parts, "__id")
    alone = rows.join(parts, "__id", "left_anti").select(*group, key, F.col(key).alias("cluster"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([confidence, key], ascending=[False, True], kind="stable").reset_index(drop=True)
        m = np.stack(pdf["__v"].to_numpy()).astype(float)
        m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)

        def similar(i, heads):
            hit = np.flatnonzero(m[heads] @ m[i] >= threshold)
            return heads[hit[0]] if len(hit) else None

        res = pdf[[*group, key]].copy()
        res["cluster"] = pdf[key].to_numpy()[_greedy(similar, len(pdf))]
        return res

    return tied.groupBy("__root").applyInPandas(run, schema).unionByName(alone)


def summarised(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row for each cluster: kinds, pages, number of documents, means (null counts as 0), the most confident text."""
    return df.groupBy(*keys).agg(
        F.array_join(F.array_sort(F.collect_set("doc_type")), ",").alias("sources"),
        F.array_join(F.transform(F.array_sort(F.collect_set("page")), lambda p: p.cast("string")), ",").alias("pages"),
        F.count_distinct("document").alias("doc_count"),
        F.count("*").alias("total_occurrences"),
        rounded(F.avg(F.coalesce("sentiment_score", F.lit(0.0)))).alias("avg_sentiment"),
        rounded(F.avg(F.coalesce("semantic_score", F.lit(0.0)))).alias("avg_semantic"),
        F.max("confidence").alias("max_confidence"),
        F.max_by("text", F.struct("confidence", (-F.col(order)).alias("o"))).alias("text"),
    )
