"""Exact top-k search by inner product: a Voronoi k-nearest-neighbour join.

An inner product becomes a distance when data vectors get one more component, sqrt(M^2 - |x|^2), and queries a
zero there: |q - x|^2 = |q|^2 + M^2 - 2 q.x. In that space queries and data are grouped by their nearest
pivot. Summaries of the groups (count, radius, the smallest distances to the pivot) bound, for each query
group, how far its k-th neighbour can be; a data vector is sent to a query group only if the triangle
inequality allows it to be nearer than that, and a query only to the data groups that hold such vectors.
Query groups and data groups are bounded, so a task never holds more than one of each, and each task solves
its share exactly; the best of all tasks are merged. Vectors of different lengths have pivots and groups of
their own, all in one plan.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fathomline.llm.shared import cut

#: Slack for rounding in distances, relative to their size: only ever sends more. A distance is the root of a
#: difference of squares, so its error is the root of theirs.
SLACK = 1e-6
#: Sums below this are exact in double precision.
EXACT = float(1 << 53)


@dataclass(frozen=True)
class KnnSpec:
    """k: neighbours; pivots: for each length the root of its number of vectors, at most this many (a table that every task
    holds); group_queries, chunk_rows: queries and vectors that a task holds at most (about); scale: of the grid."""

    k: int = 20
    pivots: int = 2048
    group_queries: int = 4096
    chunk_rows: int = 16384
    scale: float = 64.0


def grid_vectors(df: DataFrame, spec: KnnSpec, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, dim and vec (components turned into floor(scale * x)) of the rows that take part, each with a number of its own, ``row``.

    Left out: a null id, a null vector, and a vector with a null, NaN or infinite component.
    """
    e = F.col(embedding)
    fine = e.isNotNull() & F.col(vec_id).isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = df.where(fine).select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(e, lambda x: _floor(x.cast("double") * spec.scale)).alias("vec"))
    return rows.withColumn("dim", F.size("vec")).withColumn("row", F.monotonically_increasing_id())


def _floor(x: Column) -> Column:
    """floor(x) as a double, of any size."""
    r = F.rint(x)
    return F.when(r > x, r - 1.0).otherwise(r)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _distances(x: np.ndarray, extra: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From each row of (x, extra) to each pivot; both have the extra component."""
    full = np.concatenate([x, extra[:, None]], axis=1)
    d = (full**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2.0 * full @ pivots.T
    return np.sqrt(np.maximum(d, 0.0))


def _scores(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Exact inner products; beyond 64 bits they stop at the ends of the range."""
    bound = np.abs(q).max(initial=0.0) * np.abs(d).max(initial=0.0) * max(1, q.shape[1])
    if bound < EXACT:
        return (q @ d.T).astype(np.int64)
    whole = np.array([[int(v) for v in r] for r in q], object) @ np.array([[int(v) for v in r] for r in d], object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, own: int, k: int) -> np.ndarray:
    """Places of the k best by (score descending, id), without the row ``own``."""
    open_ = np.flatnonzero(rows != own)
    s = scores[open_]
    if len(s) > k:
        kth = np.partition(s, len(s) - k)[len(s) - k]
        open_ = open_[s >= kth]
        s = scores[open_]
    return open_[np.lexsort((rows[open_], ids[open_], -s))][:k]


def top_k(df: DataFrame, is_query: Column, spec: KnnSpec = KnnSpec(), vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query row, ties to the smaller vec_id.

    ``is_query`` is a condition on ``vec_id``. A query finds only vectors of its own length, and every row but its own:
    rows that repeat an id, or a whole row, are vectors and queries of their own. Where fewer than k take part, all are
    returned. Scores beyond 64 bits stop at the ends of the range. No query, or an empty table, gives no row; further
    columns are ignored.
    """
    spark = df.sparkSession
    vectors = grid_vectors(df, spec, vec_id, embedding).withColumn("is_query", F.coalesce(is_query, F.lit(False)))
    norm = F.aggregate("vec", F.lit(0.0), lambda s, x: s + x * x)
    # A row for each length: as many as the longest vector is long, at most.
    lengths = vectors.groupBy("dim").agg(F.max(norm).alias("big"), F.count("*").alias("n"), F.max("is_query").alias("asked")).where("asked").orderBy("dim").collect()
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = _solved(vectors, {r["dim"]: (float(r["big"]), int(r["n"])) for r in lengths}, spec)
    w = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= spec.k).select("query_id", "rank", "vec_id", "score")


def group_bounds(radius: np.ndarray, smallest: list[np.ndarray], pivots: np.ndarray, k: int) -> np.ndarray:
    """For each query group, a distance within which each of its queries has k neighbours other than itself.

    radius: of the query groups (NaN: none). smallest: for each data group its k + 1 smallest distances to
    its pivot. A query of group i is at most radius[i] + |p_i p_j| + d from a vector of group j at distance d.
    """
    between = _between(pivots)
    near = np.concatenate([np.asarray(s, float) for s in smallest]) if len(smallest) else np.zeros(0)
    of = np.concatenate([np.full(len(s), j) for j, s in enumerate(smallest)]).astype(int) if len(smallest) else np.zeros(0, int)
    out = np.full(len(radius), np.inf)
    if len(near) > k:  # one of them may be the query itself
        for i in np.flatnonzero(~np.isnan(radius)):
            reach = np.partition(radius[i] + between[i, of] + near, k)[k]
            out[i] = np.inf if np.isnan(reach) else reach
    return out


def _between(pivots: np.ndarray) -> np.ndarray:
    return _distances(pivots[:, :-1], pivots[:, -1], pivots)


def gathered(size: np.ndarray, between: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Groups of neighbouring pivots with at most ``most`` members in all: (first group, number of groups) of each pivot, and how many there are.

    A pivot with more members is split into groups of its own; one without any gets none.
    """
    first, split, groups = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64), 0
    left = size > 0
    for i in np.flatnonzero(left):
        if not left[i]:
            continue
        left[i] = False
        first[i], split[i] = groups, -(-int(size[i]) // most)
        if split[i] == 1:
            others = np.flatnonzero(left)
            total = int(size[i])
            for j in others[np.argsort(between[i, others], kind="stable")]:
                if total + int(size[j]) <= most:
                    first[j], split[j], left[j] = groups, 1, False
                    total += int(size[j])
        groups += int(split[i])
    return first, split, groups


@dataclass
class _Cells:
    """What tasks know about the vectors of one length. Groups are numbered over all lengths."""

    offset: int  # of its pivots
    pivots: np.ndarray
    big: float
    limit: np.ndarray  # for each pivot: how far from it a vector may be that one of its queries can need
    blocks: list[tuple[int, int, np.ndarray]]  # query groups: first, how many, pivots
    block_of: np.ndarray
    block_split: np.ndarray
    chunk_of: np.ndarray
    chunk_split: np.ndarray
    asks: list[np.ndarray]  # for each query group's first: the chunks that hold what it can need

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.big - (x**2).sum(1), 0.0))


def _parts(pdf: pd.DataFrame):
    """(length, places, matrix) of the rows of each length."""
    dims = pdf["dim"].to_numpy(np.int64)
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        yield int(dim), at, _matrix(pdf["vec"].iloc[at]).reshape(len(at), int(dim))


def _solved(vectors: DataFrame, lengths: dict[int, tuple[float, int]], spec: KnnSpec) -> DataFrame:
    """query (a row), query_id, row, vec_id, score: for each query the best of each task, its k best among them."""
    k, sc = spec.k, vectors.sparkSession.sparkContext
    wanted = {dim: max(1, min(spec.pivots, int(np.ceil(np.sqrt(n))))) for dim, (_, n) in lengths.items()}
    known = vectors.sparkSession.createDataFrame(sorted(wanted.items()), "__dim int, __pivots int")
    vectors = vectors.join(F.broadcast(known), F.col("dim") == F.col("__dim")).drop("__dim")
    # Pivots: of each share of a length's rows the one with the smallest hash.
    drawn = vectors.groupBy("dim", F.pmod(F.xxhash64("row"), F.col("__pivots")).alias("share")).agg(F.min(F.struct(F.xxhash64("row", F.lit(1)), "vec")).alias("p"))
    chosen = drawn.select("dim", "share", F.col("p.vec").alias("vec")).orderBy("dim", "share").toPandas()
    pivots, offset = {}, {}
    for dim, (big, _) in lengths.items():
        drawn = chosen.loc[chosen["dim"] == dim, "vec"]
        base = _matrix(drawn).reshape(len(drawn), dim)
        offset[dim] = sum(map(len, pivots.values()))
        pivots[dim] = np.concatenate([base, np.sqrt(np.maximum(big - (base**2).sum(1), 0.0))[:, None]], axis=1)
    placing = sc.broadcast({dim: _Cells(offset[dim], pivots[dim], lengths[dim][0], *[None] * 7) for dim in lengths})

    def assign(batches):
        for pdf in batches:
            for dim, at, x in _parts(pdf):
                c, part = placing.value[dim], pdf.iloc[at]
                out = {n: part[n] for n in ("row", "vec_id", "dim", "vec", "is_query")}
                for kind, lifted in (("data", c.lifted(x)), ("query", np.zeros(len(x)))):
                    d = _distances(x, lifted, c.pivots)
                    near = d.argmin(1)
                    out |= {f"{kind}_pivot": (near + c.offset).astype(np.int32), f"{kind}_dist": d[np.arange(len(x)), near]}
                yield pd.DataFrame(out)

    # Kept, as a vector must have one and the same group wherever it is asked for: of two pivots at nearly one distance,
    # rounding may find either the nearer one.
    vectors = cut(vectors.select("row", "vec_id", "dim", "vec", "is_query").mapInPandas(assign, "row long, vec_id long, dim int, vec array<double>, is_query boolean, data_pivot int, data_dist double, query_pivot int, query_dist double"))
    of = lambda q, kind: F.struct(F.lit(q).alias("q"), F.col(f"{kind}_pivot").alias("pivot"), F.col(f"{kind}_dist").alias("dist"))
    placed = vectors.select("row", F.explode(F.array_compact(F.array(of(False, "data"), F.when(F.col("is_query"), of(True, "query"))))).alias("x")).select("row", "x.q", "x.pivot", "x.dist")
    # Summaries: for each group its size and radius, for data also the k + 1 smallest distances, merged salt by salt.
    ranked = placed.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(64))).withColumn("r", F.row_number().over(Window.partitionBy("pivot", "q", "salt").orderBy("dist")))
    few = ranked.groupBy("pivot", "q", "salt").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.collect_list(F.when((F.col("r") <= k + 1) & ~F.col("q"), F.col("dist"))).alias("near"))
    summary = few.groupBy("pivot", "q").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k + 1).alias("near")).collect()
    total = sum(map(len, pivots.values()))
    asked, held, reach, spread, nearest = np.zeros(total, np.int64), np.zeros(total, np.int64), np.full(total, np.nan), np.zeros(total), [np.zeros(0)] * total
    for r in summary:
        if r["q"]:
            asked[r["pivot"]], reach[r["pivot"]] = r["n"], np.inf if np.isnan(r["radius"]) else r["radius"]
        else:
            held[r["pivot"]], spread[r["pivot"]], nearest[r["pivot"]] = r["n"], np.inf if np.isnan(r["radius"]) else r["radius"], np.asarray(r["near"], float)
    cells, blocks, chunks = {}, 0, 0
    for dim, (big, _) in lengths.items():
        here = slice(offset[dim], offset[dim] + len(pivots[dim]))
        between = np.nan_to_num(_between(pivots[dim]), nan=np.inf)
        limit = reach[here] + group_bounds(reach[here], nearest[here], pivots[dim], k) + SLACK * (1.0 + np.sqrt(big))
        limit = np.where(np.isnan(limit), np.inf, limit)
        block_of, block_split, n_blocks = gathered(asked[here], between, spec.group_queries)
        chunk_of, chunk_split, n_chunks = gathered(held[here], between, spec.chunk_rows)
        units, asks = [], []
        for first in np.unique(block_of[block_split > 0]):
            members = np.flatnonzero((block_of == first) & (block_split > 0))
            units.append((int(first) + blocks, int(block_split[members[0]]), members))
            # A vector of a group is at least as far from a pivot as the pivots are, less its group's radius.
            needs = np.flatnonzero((held[here] > 0) & ~(between[members] - spread[here][None, :] > limit[members][:, None]).all(0))
            asks.append(np.unique(np.concatenate([np.arange(chunk_of[j], chunk_of[j] + chunk_split[j]) for j in needs] or [np.zeros(0, np.int64)])) + chunks)
        cells[dim] = _Cells(offset[dim], pivots[dim], big, limit, units, block_of + blocks, block_split, chunk_of + chunks, chunk_split, asks)
        blocks, chunks = blocks + n_blocks, chunks + n_chunks
    sending = sc.broadcast(cells)

    def send(batches):
        for pdf in batches:
            for dim, at, x in _parts(pdf):
                c = sending.value[dim]
                rows, ids = pdf["row"].to_numpy(np.int64)[at], pdf["vec_id"].to_numpy(np.int64)[at]
                deal = pd.util.hash_array(rows)
                raw = np.array([v.tobytes() for v in x], object)
                d = _distances(x, c.lifted(x), c.pivots)
                home = pdf["data_pivot"].to_numpy(np.int64)[at] - c.offset
                chunk = c.chunk_of[home] + (deal % np.maximum(c.chunk_split[home], 1).astype(np.uint64)).astype(np.int64)
                for first, split, members in c.blocks:
                    go = np.flatnonzero(~(d[:, members] > c.limit[members][None, :]).all(1))
                    for b in range(first, first + split):
                        if len(go):
                            yield pd.DataFrame({"block": np.int32(b), "chunk": chunk[go].astype(np.int32), "row": rows[go], "vec_id": ids[go], "dim": np.int32(dim), "q": False, "raw": raw[go]})
                asks = np.flatnonzero(pdf["is_query"].to_numpy(bool)[at])
                if not len(asks):
                    continue
                mine = pdf["query_pivot"].to_numpy(np.int64)[at][asks] - c.offset
                block = c.block_of[mine] + ((deal[asks] >> np.uint64(20)) % np.maximum(c.block_split[mine], 1).astype(np.uint64)).astype(np.int64)
                for (first, split, _), to in zip(c.blocks, c.asks, strict=True):
                    go = np.flatnonzero((block >= first) & (block < first + split))
                    for j in to if len(go) else ():
                        yield pd.DataFrame({"block": block[go].astype(np.int32), "chunk": np.int32(j), "row": rows[asks[go]], "vec_id": ids[asks[go]], "dim": np.int32(dim), "q": True, "raw": raw[asks[go]]})

    def solve(pdf):
        q, d = pdf[pdf["q"]], pdf[~pdf["q"]]
        out = {"query": [], "query_id": [], "row": [], "vec_id": [], "score": []}
        if len(q) and len(d):
            dim = int(pdf["dim"].iloc[0])
            ids, rows = d["vec_id"].to_numpy(np.int64), d["row"].to_numpy(np.int64)
            dm = np.frombuffer(b"".join(d["raw"]), np.float64).reshape(len(d), dim)
            for lo in range(0, len(q), 256):
                part = q.iloc[lo : lo + 256]
                s = _scores(np.frombuffer(b"".join(part["raw"]), np.float64).reshape(len(part), dim), dm)
                for own, own_id, row in zip(part["row"].to_numpy(np.int64), part["vec_id"].to_numpy(np.int64), s, strict=True):
                    best = _best(ids, rows, row, own, k)
                    for c, v in (("query", np.full(len(best), own)), ("query_id", np.full(len(best), own_id)), ("row", rows[best]), ("vec_id", ids[best]), ("score", row[best])):
                        out[c].append(v)
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.int64) for c, v in out.items()})

    sent = vectors.select("row", "vec_id", "dim", "vec", "is_query", "data_pivot", "query_pivot").mapInPandas(send, "block int, chunk int, row long, vec_id long, dim int, q boolean, raw binary")
    return sent.groupBy("block", "chunk").applyInPandas(solve, "query long, query_id long, row long, vec_id long, score long")
