"""Exact n-gram Jaccard join: T-occurrence search over inverted lists.

A document is the set of its distinct word shingles. Documents are linked when 100 * intersection >= percent *
union. All steps are linear in the input, and every task is bounded:

1. Equal sets are one class; one of its documents stands for it.
2. A set can be linked only if enough of its shingles occur in other sets too. One pass over all shingles counts,
   in slots, which do (a shared slot may count too much, never too little); most documents end here.
3. Of the rest, sets that can be linked differ in few shingles. A set is dealt into more parts than it may differ
   in, so two linked sets agree on a part as a whole: sets that share the hash of a part are tied, a group of n
   by n - 1 ties, and connected components over ties are the only places where links can be. A passage that many
   documents quote ties few of them, as parts mix it with other shingles. No pair within a group is written out.
4. Each component is searched by itself, in blocks of bounded size: inverted lists over its sets, for each
   query set the short lists merged and the long ones probed by binary search (DivideSkip), and sets that
   reach the overlap which the threshold requires are linked. Sets already connected need no second link.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm import tokens
from fathomline.llm.shared import connected_components, cut, mix64, own_prefix, shuffle_partitions, small_batches

_BASE = np.uint64(0x9E3779B97F4A7C15)
_ODD = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass(frozen=True)
class JoinSpec:
    """words: of a shingle; percent: of the union that linked sets share; block_shingles: shingles in a block at most (about,
    a block holds one set at least); chunk_bytes: of text that are shingled at a time; skip: DivideSkip's tuning constant; bucket_rows: documents for
    each bucket in which shared shingles are counted (about); most_bits: of the number of buckets, beyond which slots are 32 bits wide instead of 24."""

    words: int = 3
    percent: int = 90
    block_shingles: int = 4_000_000
    chunk_bytes: int = 600_000
    skip: float = 0.005
    bucket_rows: int = 1024
    most_bits: int = 24


def _inverse_odd(r: int) -> int:
    return pow(r, -1, 1 << 64)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Bytes of text whose words are hashed at a time, so that memory does not follow the length of a text.
_STRETCH = 1 << 18


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse up to ``n``."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((int(_BASE), _inverse_odd(int(_BASE)))):
            table = np.full(n + 1, base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers


def _word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, that of a polynomial over its bytes, whatever its place."""
    h = np.empty(len(starts), np.uint64)
    edges = np.append(np.searchsorted(starts, np.arange(0, len(buf), _STRETCH)), len(starts))
    for i, j in zip(edges[:-1], edges[1:], strict=True):
        if i == j:
            continue
        lo, hi = int(starts[i]), int(ends[j - 1])
        power, back = _power_tables(max(_STRETCH, hi - lo))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(power[: hi - lo] * (buf[lo:hi].astype(np.uint64) + np.uint64(1)), dtype=np.uint64)])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        h[i:j] = mix64((run[e] - run[s]) * back[s] + (e - s).astype(np.uint64))
    return h


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; A-Z in lower case; fewer words than a shingle has are one shingle."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter((len(b) + 1 for b in raw), np.int64, len(raw))
    buf = _LOWER[np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)]
    del raw
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _SPACE[buf], [True]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    with np.errstate(over="ignore"):
        h = _word_hashes(buf, starts, ends)
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
        long = sum(((h[k : len(h) - words + 1 + k] if len(h) >= words else h[:0]) * _ODD[k % 5] ** np.uint64(1 + k // 5)) for k in range(words))
        long = mix64(np.asarray(long, np.uint64))
        out = []
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= words:
                s = np.sort(long[a : b - words + 1])
                out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
            elif b > a:
                x = np.uint64(b - a)
                for k in range(a, b):
                    x = mix64((x + h[k]) * _ODD[4])
                out.append(np.array([x], np.uint64))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def class_key(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, as signed integers."""
    with np.errstate(over="ignore"):
        n = np.uint64(len(s))
        pair = [mix64(mix64(s ^ k).sum(dtype=np.uint64) + n) for k in _ODD[:2]]
    return tuple(int(x.view(np.int64)) for x in pair)


def needed(n: int | np.ndarray, percent: int):
    """The least overlap of a set of ``n`` shingles with any set that it is linked with."""
    return -(-percent * n // 100)


def size_bounds(percent: int, top: int = 1 << 40) -> np.ndarray:
    """Lower bounds of size classes such that sizes of linked sets are in the same or in neighbouring classes."""
    out = [1]
    while out[-1] < top:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out, np.int64)


def max_difference(total: int, percent: int) -> int:
    """How many shingles two linked sets with ``total`` shingles together may not share, at most: from 100 o >= percent (total - o)."""
    return total * (100 - percent) // (100 + percent)


def part_hashes(s: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of which two sets share one at least if they can be linked and are not equal.

    For a pair of size classes a set is dealt into more parts than two linked sets may differ in, and some to
    spare. Of a set with no more empty parts than there are to spare, one part that holds something is
    untouched by the differences, whatever the other set is. A set with more of them adds the prefix that any
    two linked sets share a shingle of; if both sets of a pair do, they meet there.
    """
    n, out = len(s), []
    if not n:
        return np.zeros(0, np.uint64)
    c = int(np.searchsorted(bounds, n, side="right")) - 1
    spread = mix64(s ^ _ODD[2])
    with np.errstate(over="ignore"):
        for g in (c, c + 1):
            differ = max_difference(2 * int(bounds[g + 1] - 1), percent)
            if not differ:
                continue
            spare = 2 + differ // 16
            k = differ + 1 + spare
            part = ((s >> np.uint64(11)) % np.uint64(k)).astype(np.int64)
            sums, filled = np.zeros(k, np.uint64), np.zeros(k, bool)
            np.add.at(sums, part, spread)
            filled[part] = True
            name = mix64(np.arange(k, dtype=np.uint64) * _ODD[3] + np.uint64(g))
            out.append(mix64(sums[filled] + name[filled]))
            if k - int(filled.sum()) > spare:
                prefix = s[: n - -(-percent * n // 100) + 1]
                out.append(mix64(prefix + mix64(np.uint64(g) ^ _ODD[4])))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


#: Classes go by 40 bits of their key where places of possible links are looked for, and hashes of parts by 32 bits
#: besides their bucket's: an accidental meeting only makes a place larger.
_WHO = (1 << 40) - 1


def _packed(who: np.ndarray) -> bytes:
    return (who & 0xFFFFFFFF).astype("<u4").tobytes() + (who >> 32).astype(np.uint8).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    n = len(raw) // 5
    return np.frombuffer(raw, "<u4", n).astype(np.int64) | np.frombuffer(raw, np.uint8, n, 4 * n).astype(np.int64) << 32


def _ties(sig: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, least member of each, tie a, tie b): rows that share a hash are tied to the least of them."""
    order = np.lexsort((who, sig))
    sig, who = sig[order], who[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]]) if len(sig) else np.zeros(0, bool)
    lead = who[first][np.cumsum(first) - 1] if len(sig) else who
    other = lead != who
    pairs = np.unique(np.stack([lead[other], who[other]], 1), axis=0) if other.any() else np.zeros((0, 2), np.int64)
    return sig[first], who[first], pairs[:, 0], pairs[:, 1]


def _texts_in_chunks(ids: Iterator, texts: Iterator, most: int):
    held, n = [], 0
    for i, t in zip(ids, texts, strict=True):
        held.append((i, t))
        n += len(t or "") + 1
        if n >= most:
            yield held
            held, n = [], 0
    if held:
        yield held


def _slot_bytes(x: np.ndarray, wide: bool) -> bytes:
    return x.astype("<u4").tobytes() if wide else x.astype("<u2").tobytes() + (x >> 16).astype(np.uint8).tobytes()


def _slots_of(raw: bytes, wide: bool) -> np.ndarray:
    if wide:
        return np.frombuffer(raw, "<u4")
    n = len(raw) // 3
    return np.frombuffer(raw, "<u2", n).astype(np.uint32) | np.frombuffer(raw, np.uint8, n, 2 * n).astype(np.uint32) << np.uint32(16)


def _count_side(spec: JoinSpec, bits: int, wide: bool) -> Callable:
    """Texts to packed rows: for each bucket of hashes the slots (24 bits, or 32 if ``wide``) that one document of the flush has,
    with its number, and those that several have, without; and the flush's documents, with how many slots of theirs the flush itself shares.

    A shingle that many documents have is so one entry of a flush, however many there are. Buckets are wide, so that a
    flush has few rows: with 5 million documents about a hundred shingles go into each.
    """
    low = 32 if wide else 24

    def run(batches):
        from pyspark import TaskContext

        tokens.forget()
        part = TaskContext.get().partitionId()
        sets: list[np.ndarray] = []
        docs: list[tuple] = []
        first: dict[tuple, int] = {}
        total = made = 0

        def flush():
            flush_id = part << 32 | made
            rows, here = [], np.zeros(len(docs), np.int64)
            if any(len(x) for _, x in sets):
                who = np.repeat(np.array([w for w, _ in sets], np.uint16), [len(x) for _, x in sets])
                h = np.concatenate([x for _, x in sets]) >> np.uint64(64 - bits - low)
                order = np.argsort(h)
                h, who = h[order], who[order]
                new = np.concatenate([[True], h[1:] != h[:-1], [True]])
                single = new[:-1] & new[1:]
                here = np.bincount(who[~single], minlength=len(docs))
                lead = np.flatnonzero(new[:-1])
                h, who, single = h[lead], who[lead], single[lead]
                bucket, slot = (h >> np.uint64(low)).astype(np.int64), (h & np.uint64((1 << low) - 1)).astype(np.uint32)
                ends = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(h))
                for i, j in zip(ends[:-1], ends[1:], strict=True):
                    one = single[i:j]
                    rows.append((0, int(bucket[i]), flush_id, _slot_bytes(slot[i:j][one], wide), who[i:j][one].tobytes(), _slot_bytes(slot[i:j][~one], wide)))
            rows.append((1, int(mix64(np.uint64(flush_id)) >> np.uint64(64 - bits)), flush_id, np.column_stack([np.array(docs, np.int64), here]).tobytes(), b"", b""))
            sets.clear()
            docs.clear()
            first.clear()
            return pd.DataFrame(rows, columns=["kind", "bucket", "flush", "slot", "who", "several"])

        for pdf in batches:
            for chunk in _texts_in_chunks(zip(pdf["doc_id"].astype("Int64"), pdf["th"], strict=True), iter(pdf["text"]), spec.chunk_bytes):
                for ((i, th), _), s in zip(chunk, shingle_sets([t for _, t in chunk], spec.words), strict=True):
                    a, b = class_key(s)
                    if (a, b) not in first:
                        first[a, b] = len(docs)
                        sets.append((len(docs), s))
                        total += len(s)
                    docs.append((0 if i is pd.NA else int(i), int(i is not pd.NA), len(s), a, b, first[a, b], int(th)))
                    if total >= 1_500_000 or len(docs) >= 60_000:
                        yield flush()
                        total, made = 0, made + 1
        if docs:
            yield flush()

    return run


def _shared_slots(single: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Which of ``single`` occur in it twice, or in ``several`` as well."""
    order = np.argsort(single)
    ranked = single[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1], [True]])
    out = np.empty(len(single), bool)
    out[order] = ~(new[:-1] & new[1:])
    return out | np.isin(single, several)


def _shared_side(wide: bool) -> Callable:
    """Rows sorted by bucket: of each flush, the numbers of documents once for every shingle of theirs whose slot another one has too."""
    def run(batches):
        out, waiting = {}, 0

        def emit():
            frame = pd.DataFrame([(0, f, b"".join(x)) for f, x in out.items()], columns=["kind", "flush", "data"])
            out.clear()
            return frame

        for _, rows in _grouped(batches, ["bucket"]):
            held = [r for r in rows if r.kind == 0]
            for r in rows:
                if r.kind == 1:
                    yield pd.DataFrame([(1, r.flush, r.slot)], columns=["kind", "flush", "data"])
            if held:
                slots = [_slots_of(r.slot, wide) for r in held]
                several = np.concatenate([_slots_of(r.several, wide) for r in held])
                twice = _shared_slots(np.concatenate(slots), several)
                at = 0
                for r, x in zip(held, slots, strict=True):
                    hit = np.frombuffer(r.who, np.uint16)[twice[at : at + len(x)]]
                    at += len(x)
                    if len(hit):
                        out.setdefault(r.flush, []).append(hit.tobytes())
                        waiting += len(hit)
                if waiting >= 2_000_000:
                    yield emit()
                    waiting = 0
        if out:
            yield emit()

    return run


def _alive_side(spec: JoinSpec) -> Callable:
    """Rows sorted by flush to documents: doc_id, n_shingles, class key, text hash, and whether enough of their shingles occur elsewhere."""

    def run(batches):
        for _, rows in _grouped(batches, ["flush"]):
            docs = np.concatenate([np.frombuffer(r.data, np.int64) for r in rows if r.kind == 1]).reshape(-1, 8)
            hits = [np.frombuffer(r.data, np.uint16) for r in rows if r.kind == 0]
            n = docs[:, 7] + (np.bincount(np.concatenate(hits), minlength=len(docs)) if hits else 0)
            size = docs[:, 2]
            alive = (size > 0) & (n[docs[:, 5]] >= needed(size, spec.percent))
            ids = pd.array(docs[:, 0], "Int64")
            ids[docs[:, 1] == 0] = pd.NA
            yield pd.DataFrame({"doc_id": ids, "n_shingles": size, "ka": docs[:, 3], "kb": docs[:, 4], "th": docs[:, 6], "alive": alive})

    return run


def _tie_side(spec: JoinSpec, bits: int) -> Callable:
    """Sets to packed rows: ties found here, and for each bucket of hashes of parts (hash, least class)."""

    def run(batches):
        tokens.forget()
        bounds = size_bounds(spec.percent)
        sigs, whos, waiting = [], [], 0

        def flush():
            sig, who, a, b = _ties(np.concatenate(sigs), np.concatenate(whos))
            bucket = (sig >> np.uint64(64 - bits)).astype(np.int64)
            ends = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(sig))
            low = (sig >> np.uint64(32 - bits)).astype("<u4")
            rows = [(int(bucket[i]), low[i:j].tobytes(), _packed(who[i:j]), b"") for i, j in zip(ends[:-1], ends[1:], strict=True)]
            rows.append((int(bucket[0]), b"", b"", np.stack([a, b], 1).astype(np.int64).tobytes()))
            sigs.clear()
            whos.clear()
            return pd.DataFrame(rows, columns=["bucket", "sig", "who", "ties"])

        for pdf in batches:
            for k, sh in zip(pdf["who"], pdf["sh"], strict=True):
                h = part_hashes(np.frombuffer(sh, np.uint64), bounds, spec.percent)
                if not len(h):
                    continue
                sigs.append(h)
                whos.append(np.full(len(h), k, np.int64))
                waiting += len(h)
                if waiting >= 1_000_000:
                    yield flush()
                    waiting = 0
        if sigs:
            yield flush()

    return run


def _reduce_side(batches):
    """Rows sorted by bucket to ties a, b."""
    now, sig, who = None, [], []

    def close():
        _, _, a, b = _ties(np.frombuffer(b"".join(sig), "<u4"), np.concatenate([_unpacked(w) for w in who]))
        return pd.DataFrame({"a": a, "b": b})

    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if r.bucket != now:
                if sig:
                    yield close()
                now, sig, who = r.bucket, [], []
            if r.sig:
                sig.append(r.sig)
                who.append(r.who)
            if r.ties:
                t = np.frombuffer(r.ties, np.int64).reshape(-1, 2)
                yield pd.DataFrame({"a": t[:, 0], "b": t[:, 1]})
    if sig:
        yield close()


def block_links(sets: list[np.ndarray], percent: int, skip: float, is_query: np.ndarray | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect all sets of the list that links connect (a forest), by T-occurrence search.

    With ``is_query`` only pairs with a query set in them are looked at. Sets of one ``group`` (an integer from
    0) count as connected from the start.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    asks = np.ones(m, bool) if is_query is None else np.asarray(is_query, bool)[order]
    flat = np.concatenate([sets[i] for i in order]) if m else np.zeros(0, np.uint64)
    by = np.argsort(flat, kind="stable").astype(np.int32)
    flat = flat[by]  # in order; equal shingles follow each other
    rank = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]]), dtype=np.int32) if len(flat) else np.zeros(0, np.int32)
    del flat
    n_tokens = int(rank[-1]) + 1 if len(rank) else 0
    token = np.empty(len(rank), np.int32)
    token[by] = rank
    of_doc = np.concatenate([[0], np.cumsum(size)])
    postings = np.repeat(np.arange(m, dtype=np.int32), size)[by]  # of each token, in the order of documents
    del by
    first = np.concatenate([[0], np.cumsum(np.bincount(rank, minlength=n_tokens))])
    place = rank.astype(np.int64) * m + postings  # ascending: binary search in any list
    del rank
    filled = np.zeros(n_tokens, np.int64)  # entries of each list that stand for documents before the current one
    label, links = np.arange(m) if group is None else np.asarray(group)[order].copy(), []
    joined = np.argsort(label, kind="stable")
    heads = np.flatnonzero(np.concatenate([[True], label[joined][1:] != label[joined][:-1]])) if m else np.zeros(0, int)
    members = {int(label[x[0]]): [x] for x in np.split(joined, heads[1:])} if m else {}
    count = {k: len(v[0]) for k, v in members.items()}

    def unite(a: int, b: int) -> None:
        """The smaller group takes the label of the larger one, so that no set is labelled anew more than log2(m) times."""
        if count[a] > count[b]:
            a, b = b, a
        for x in members[a]:
            label[x] = b
        members[b] += members.pop(a)
        count[b] += count.pop(a)

    for i in range(m):
        mine = token[of_doc[i] : of_doc[i + 1]]
        s = int(size[i])
        least = -(-percent * s // 100)
        used = mine[filled[mine] > 0]
        if least and len(used) >= least:
            used = used[np.argsort(filled[used], kind="stable")]
            longest = int(filled[used[-1]])
            n_long = min(least - 1, int(least / (skip * np.log2(max(2, longest)) + 1)))
            short, long = used[: len(used) - n_long], used[len(used) - n_long :]
            n = filled[short]
            at = np.repeat(first[short] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            if len(at) * 4 > i:
                seen = np.bincount(postings[at], minlength=i)
                near = np.flatnonzero(seen >= least - n_long)
                seen = seen[near]
            else:  # few entries: no table over all sets
                near, seen = np.unique(postings[at], return_counts=True)
                near, seen = near[seen >= least - n_long], seen[seen >= least - n_long]
            fits = (100 * size[near] >= percent * s) & (label[near] != label[i])
            if not asks[i]:
                fits &= asks[near]
            near, seen = near[fits], seen[fits]
            likely = np.argsort(-seen, kind="stable")
            near, seen = near[likely], seen[likely]
            while len(near):
                # The likeliest few of each group of connected sets: one link to each group is enough.
                groups = label[near]
                nth = np.empty(len(near), np.int64)
                o = np.argsort(groups, kind="stable")
                new = np.concatenate([[True], groups[o][1:] != groups[o][:-1]])
                nth[o] = np.arange(len(o)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                now = np.flatnonzero(nth < 16)[:512]
                some = near[now]
                if n_long:
                    want = long[None, :].astype(np.int64) * m + some[:, None]
                    spot = np.minimum(np.searchsorted(place, want.ravel()), len(place) - 1)
                    both = seen[now] + (place[spot] == want.ravel()).reshape(want.shape).sum(1)
                else:
                    both = seen[now]
                good = some[(100 + percent) * both >= percent * (s + size[some])]
                for x in good:
                    if label[x] != label[i]:
                        links.append((int(order[x]), int(order[i])))
                        unite(int(label[x]), int(label[i]))
                rest = label[near] != label[i]
                rest[now] = False
                near, seen = near[rest], seen[rest]
        filled[mine] += 1
    return links


def _grouped(batches, keys: list[str]):
    """Rows that follow each other with equal keys, as lists."""
    now, held = None, []
    for pdf in batches:
        for r in pdf.itertuples(index=False):
            key = tuple(getattr(r, k) for k in keys)
            if key != now:
                if held:
                    yield now, held
                now, held = key, []
            held.append(r)
    if held:
        yield now, held


def _search(spec: JoinSpec) -> Callable:
    def run(batches):
        tokens.forget()
        for _, rows in _grouped(batches, ["root", "block"]):
            rows = list({r.cid: r for r in sorted(rows, key=lambda r: r.asks)}.values())
            sets = [np.frombuffer(r.sh, np.uint64) for r in rows]
            asks = np.array([r.asks for r in rows], bool)
            group = np.unique([r.grp for r in rows], return_inverse=True)[1]
            found = block_links(sets, spec.percent, spec.skip, None if asks.all() else asks, group)
            if found:
                yield pd.DataFrame({"a": [rows[i].cid for i, _ in found], "b": [rows[j].cid for _, j in found]})

    return run


def _cid(a: str, b: str):
    return F.concat(F.lpad(F.hex(a), 16, "0"), F.lpad(F.hex(b), 16, "0"))


def jaccard_components(docs: DataFrame, spec: JoinSpec = JoinSpec(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id that links lead to) for each row of ``docs``.

    A null or empty text, or one of white space alone, has no shingle and is linked with nothing: its component is
    its own doc_id. Rows that repeat a doc_id are documents of their own; a null doc_id is never the name of
    a component unless all its documents have none. Texts count in whole, a stretch at a time. An empty table gives an
    empty one; further columns are ignored.
    """
    rows = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    parts = shuffle_partitions(docs.sparkSession)
    n_rows = rows.count()
    bits = min(spec.most_bits, max(8, (16 * parts).bit_length(), 1 + int(n_rows / spec.bucket_rows).bit_length()))
    # Hashes of parts are few beside shingles: their buckets are narrow, and as many whatever the number of tasks.
    tie_bits = min(spec.most_bits, max(8, 1 + int(n_rows / 64).bit_length()))
    wide = bits == spec.most_bits
    counted = rows.mapInPandas(_count_side(spec, bits, wide), "kind int, bucket int, flush long, slot binary, who binary, several binary")
    shared = counted.repartition(parts, "bucket").sortWithinPartitions("bucket", "flush").mapInPandas(_shared_side(wide), "kind int, flush long, data binary")
    base = shared.repartition(parts, "flush").sortWithinPartitions("flush").mapInPandas(_alive_side(spec), "doc_id long, n_shingles long, ka long, kb long, th long, alive boolean")
    sized = cut(base)
    # A class goes by its smallest doc_id; its text is that of a row which has this id and, as ids can repeat, this hash.
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("least")
    classes = sized.where("n_shingles > 0").groupBy("ka", "kb").agg(least, F.min("n_shingles").alias("size"), F.max("alive").alias("alive"))
    classes = classes.select("ka", "kb", F.col("least.doc_id").alias("rep"), F.col("least.th").alias("rep_th"), "size", "alive").withColumn("cid", _cid("ka", "kb"))

    def sets_of(*more: str) -> Callable:
        def run(batches):
            tokens.forget()
            found: set[str] = set()  # classes of this task: rows that repeat both id and text meet here
            for pdf in batches:
                pdf = pdf[~pdf.duplicated(["cid", "text"]) & ~pdf["cid"].isin(found)]
                done = 0
                for chunk in _texts_in_chunks(iter(pdf["cid"]), iter(pdf["text"]), spec.chunk_bytes):
                    part = pdf.iloc[done : done + len(chunk)]
                    done += len(chunk)
                    sets = shingle_sets([t for _, t in chunk], spec.words)
                    same = np.array([class_key(s) == (a, b) for s, a, b in zip(sets, part["ka"], part["kb"], strict=True)], bool)
                    kept = part[same]
                    found.update(kept["cid"])
                    yield pd.DataFrame({**{c: kept[c] for c in more}, "sh": [s.tobytes() for s, k in zip(sets, same, strict=True) if k]})

        return run

    # Sets take more room than their texts and are not stored: texts are read once for ties, and those of places once more.
    reps = classes.where("alive").select("ka", "kb", "cid", "rep", "rep_th", "size", F.col("ka").bitwiseAND(F.lit(_WHO)).alias("who"))
    texts_of = lambda of, *more: rows.join(of, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("th") == F.col("rep_th"))).select("text", "ka", "kb", "cid", *more)
    sets_with, ties_of = sets_of("who"), _tie_side(spec, tie_bits)
    tied = texts_of(reps, "who").mapInPandas(lambda batches: ties_of(sets_with(batches)), "bucket int, sig binary, who binary, ties binary")
    places = connected_components(tied.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInPandas(_reduce_side, "a long, b long"))
    placed = cut(reps.join(places, F.col("who") == F.col("node")).select("ka", "kb", "cid", "rep", "rep_th", "size", "root"))
    widths = placed.groupBy("root").agg(F.ceil(F.sum("size") / spec.block_shingles).cast("int").alias("blocks"))
    placed = placed.join(widths, "root").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    sets = texts_of(placed, "root", "block", "blocks").mapInPandas(sets_of("root", "block", "blocks", "cid"), "root long, block int, blocks int, cid string, sh binary")
    search = lambda df: df.repartition(parts, "root", "block").sortWithinPartitions("root", "block").select("root", "block", "cid", "grp", "sh", "asks").mapInPandas(_search(spec), "a string, b string")
    widest = widths.agg(F.max("blocks")).first()[0] or 0
    if widest > 1:
        sets = cut(sets)
    links = cut(search(sets.withColumn("asks", F.lit(True)).withColumn("grp", F.col("cid"))))
    links = _between_blocks(sets, links, search, spec) if widest > 1 else links
    groups = connected_components(links)
    named = groups.join(classes.select("cid", "rep"), F.col("node") == F.col("cid"))
    least = named.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = named.join(least, "root").select(F.col("cid").alias("__cid"), "component")
    all_classes = classes.join(of_class, F.col("cid") == F.col("__cid"), "left").select(F.col("ka").alias("__ka"), F.col("kb").alias("__kb"), F.coalesce("component", "rep").alias("component"))
    out = sized.join(all_classes, (F.col("ka") == F.col("__ka")) & (F.col("kb") == F.col("__kb")) & (F.col("n_shingles") > 0), "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def _between_blocks(sets: DataFrame, links: DataFrame, search: Callable, spec: JoinSpec) -> DataFrame:
    """Links between blocks of components that fill more than one.

    Sets of the largest group found so far need not be compared with each other again: all others ask against
    all blocks, first with one set of each block's largest group, then whoever is still outside and has not asked.
    Those that ask are dealt into blocks as well, usually one, and each meets every block of the component.
    """
    wide = sets.where("blocks > 1").select("root", "block", "blocks", "cid", "sh")
    asked = None
    while True:
        groups = connected_components(links).withColumnRenamed("root", "grp")
        heads = wide.select("root", "block", "cid", (F.length("sh") / 8).alias("w")).join(groups, F.col("cid") == F.col("node"), "left").select("root", "block", "cid", "w", F.coalesce("grp", "cid").alias("grp"))
        scope = ["root", "block"] if asked is None else ["root"]
        counts = heads.groupBy(*scope, "grp").agg(F.count("*").alias("n"), F.min("cid").alias("one"))
        top = counts.groupBy(*scope).agg(F.max(F.struct("n", "grp", "one")).alias("top")).select(*scope, F.col("top.grp").alias("top"), "top.one")
        out = heads.join(top, scope).where((F.col("grp") != F.col("top")) | (F.col("cid") == F.col("one")) if asked is None else F.col("grp") != F.col("top"))
        ask = out.select("root", "cid", "w")
        ask = cut(ask if asked is None else ask.join(asked, "cid", "left_anti"))
        if ask.isEmpty():
            return links
        chunks = ask.groupBy("root").agg(F.ceil(F.sum("w") / spec.block_shingles).cast("int").alias("chunks"))
        asked = ask.select("cid") if asked is None else cut(asked.union(ask.select("cid")))
        tagged = wide.join(heads.select("cid", "grp"), "cid").join(chunks, "root")
        place = F.col("other") * F.col("chunks") + F.col("chunk")
        going = tagged.join(ask.select("cid"), "cid").withColumn("chunk", F.pmod(F.xxhash64("cid", F.lit(1)), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("asks", F.lit(True))
        there = tagged.withColumn("other", F.col("block")).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("asks", F.lit(False))
        links = cut(links.union(search(going.withColumn("block", place).unionByName(there.withColumn("block", place), allowMissingColumns=True))))


def one_of_each(docs: DataFrame, spec: JoinSpec = JoinSpec(), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each component, one with its smallest doc_id (null last); all columns stay, whatever their names.

    Rows that repeat a doc_id are documents of their own. Null and empty texts are linked with nothing and stay; long
    texts count in whole; of equal texts the smallest doc_id stays, of rows with equal ids any one; an empty table gives
    an empty one.
    """
    own = own_prefix(docs.columns)
    if not docs.groupBy(doc_id).count().where("count > 1").isEmpty():
        row, known = f"{own}row", f"{own}id"
        rows = cut(docs.withColumn(row, F.monotonically_increasing_id()))
        of = jaccard_components(rows, spec, row, text).select(F.col("doc_id").alias(row), "component_id")
        named = rows.select(row, F.col(doc_id).cast("long").alias(known)).join(of, row)
        first = named.groupBy("component_id").agg(F.min(F.struct(F.col(known).isNull(), known, row)).alias("first"))
        return rows.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    kept = jaccard_components(docs, spec, doc_id, text).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias(f"{own}kept")).distinct()
    return docs.join(kept, F.col(doc_id).eqNullSafe(F.col(f"{own}kept")), "left_semi")
