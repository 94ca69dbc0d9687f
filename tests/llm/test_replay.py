"""The mix and the whole pipeline, replayed in plain Python: places, draws, permutations, joins, texts, packs."""

import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from fathomline.llm import language_id, mixing, packing

sys.path.insert(0, str(Path(__file__).resolve().parent))
from test_pipeline import python_verdict  # noqa: E402
from test_texts import WORD, brute_targets, frame, sample, whole_ids  # noqa: E402
from test_vectors_and_graphs import brute_components  # noqa: E402

MASK = (1 << 64) - 1


def hash64(*values):
    """Spark's xxhash64: of texts and of integers of 8 or, given as (value,), 4 bytes; nulls leave the hash as it is."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64(raw, seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def spread(x):
    """The finaliser of splitmix64, on one number."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def place_in_permutation(i, n, key):
    half = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    low = (1 << half) - 1
    while True:
        left, right = i >> half, i & low
        for turn in range(4):
            left, right = right, left ^ (spread((right + spread((key + turn + 1) & MASK)) & MASK) & low)
        i = (left << half) | right
        if i < n:
            return i


def draws(owed, most, wanted, seed):
    rng, given, out = np.random.Generator(np.random.PCG64(seed)), [0] * len(owed), []
    for want in wanted:
        row = [0] * len(owed)
        while want:
            room = [m - g for m, g in zip(most, given, strict=True)]
            p = [max(o - g, 0.0) if r > 0 else 0.0 for o, g, r in zip(owed, given, room, strict=True)]
            p = p if sum(p) > 0 else [float(r) for r in room]
            got = [min(int(x), r) for x, r in zip(rng.multinomial(want, np.array(p) / np.sum(p)), room, strict=True)]
            row, given = [a + b for a, b in zip(row, got, strict=True)], [a + b for a, b in zip(given, got, strict=True)]
            want -= sum(got)
        out.append(row)
    return out


def replayed_mix(rows, spec):
    """Of rows (doc_id, text, source): taken words of each row, and the runs that each pass takes of it: {(row, pass): [(first word, words)]}."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    of = {s: [i for i, r in enumerate(rows) if r[2] == s] for s in order}
    total = [sum(size[i] for i in of[s]) for s in order]
    target = brute_targets(total, [spec.weights[k % len(spec.weights)] for k in range(len(order))], spec.cap) if sum(total) else [0.0] * len(order)
    blocks = [-(-n // spec.block_words) for n in total]
    owed = [t / n * b if n else 0.0 for t, n, b in zip(target, total, blocks, strict=True)]
    width = max(spec.group_sources, math.ceil(math.sqrt(len(order))))
    groups = {}
    for sid, b in enumerate(blocks):
        if b:
            groups.setdefault(sid // width, []).append(sid)
    names = sorted(groups)
    group_owed, group_most = [sum(owed[s] for s in groups[g]) for g in names], [spec.cap * sum(blocks[s] for s in groups[g]) for g in names]
    slots = min(round(sum(group_owed)), sum(group_most))
    wanted = [slots * (k + 1) // spec.shards - slots * k // spec.shards for k in range(spec.shards)]
    by_group = draws(group_owed, group_most, wanted, spec.seed) if names else []
    given = [0] * len(order)
    for k, g in enumerate(names):
        of_group = draws([owed[s] for s in groups[g]], [spec.cap * blocks[s] for s in groups[g]], [r[k] for r in by_group], spec.seed + 1 + g)
        for at, s in enumerate(groups[g]):
            given[s] = sum(r[at] for r in of_group)
    buckets = max(spec.min_buckets, -(-len(rows) // spec.bucket_rows))
    taken, runs = [0] * len(rows), {}
    for sid, s in enumerate(order):
        placed = []
        for i in of[s]:
            th = hash64(rows[i][1])
            placed.append((hash64(rows[i][0], size[i], th, (spec.seed,)) % buckets, (rows[i][0] is not None, rows[i][0] or 0), size[i], th, i))
        # The block that each word of the source lies in, as stretches of documents.
        within, at = {}, 0
        for *_, i in sorted(placed):
            lo = 0
            while lo < size[i]:
                block = (at + lo) // spec.block_words
                hi = min(size[i], (block + 1) * spec.block_words - at)
                within.setdefault(block, []).append((i, lo, hi - lo))
                lo = hi
            at += size[i]
        for slot in range(given[sid]):
            turn, index = divmod(slot, blocks[sid])
            for i, lo, n in within[place_in_permutation(index, blocks[sid], spread((spread(sid + spec.seed) + turn) & MASK))]:
                taken[i] += n
                runs.setdefault((i, turn), []).append((lo, n))
    return size, target, taken, runs


def mixed_texts(rows, spec):
    size, _, _, runs = replayed_mix(rows, spec)
    out = []
    for (i, _), parts in runs.items():
        held = {w for lo, n in parts for w in range(lo, lo + n)}
        assert len(held) == sum(n for _, n in parts)
        text = rows[i][1]
        if len(held) < size[i]:
            words = [m.span() for m in WORD.finditer(text)]
            firsts, lasts = [w for w in sorted(held) if w - 1 not in held], [w for w in sorted(held) if w + 1 not in held]
            text = "\n".join(text[words[a][0] : words[b][1]] for a, b in zip(firsts, lasts, strict=True))
        out.append((rows[i][0], text))
    return out


def filled(lengths, limit):
    """How full packs are when each length, the longest first, goes into the emptiest open pack that has room."""
    packs = []
    for n in sorted(lengths, reverse=True):
        least = min((u for u in packs if u + n <= limit), default=None)
        if least is not None:
            packs.remove(least)
        packs.append(n + (least or 0))
    return sorted(packs)


def same_pack(pieces, texts):
    """Whether pieces (a frame) are those of (doc_id, text), in packs as full as those of the plain rule."""
    want = Counter()
    for (d, _), ids in zip(texts, whole_ids([t for _, t in texts]), strict=True):
        at = 0
        for n in packing.cut_lengths(len(ids)):
            want[d, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)] += 1
            at += n
        assert at == len(ids)
    got = [tuple(r) for r in pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()]
    assert Counter(r[:5] for r in got) == want
    packs = {}
    for r in got:
        packs.setdefault(r[5], []).append((r[6], r[2]))
    assert sorted(packs) == list(range(len(packs)))
    for p in packs.values():
        at = 0
        for offset, n in sorted(p):
            assert offset == at
            at += n
    assert sorted(sum(n for _, n in p) for p in packs.values()) == filled([r[2] for r in got], packing.MAX_TOKENS)


SPECS = [mixing.MixSpec(), mixing.MixSpec(block_words=16, shards=20, bucket_rows=30), mixing.MixSpec(weights=(1.0, 9.0), cap=2, block_words=5, shards=3, group_sources=2, min_buckets=2, run_slots=7, seed=5)]


@pytest.mark.parametrize("spec", SPECS)
def test_mix_is_that_of_plain_python(spark, spec):
    rows = [(r[0], r[1], r[3]) for r in sample(150, 8)]
    rows += [(500 + k, "one more source " * k, f"s{k}") for k in range(6)]
    df = frame(spark, [(i, t, "en", s) for i, t, s in rows])
    size, target, taken, _ = replayed_mix(rows, spec)
    order = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    of = dict(zip(order, target, strict=True))
    want = Counter((i, s, n, k) for (i, _, s), n, k in zip(rows, size, taken, strict=True))
    got = mixing.mixed_sizes(df, spec).collect()
    assert Counter((r["doc_id"], r["source"], r["size"], r["taken"]) for r in got) == want
    assert all(math.isclose(r["target"], of[r["source"]]) for r in got) and sum(taken) > 0
    texts = mixing.mixed_documents(df, spec).select("doc_id", "text").collect()
    assert Counter(map(tuple, texts)) == Counter(mixed_texts(rows, spec))


def test_mix_of_a_given_table_is_that_of_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]
    size, _, taken, _ = replayed_mix(rows, mixing.MixSpec())
    got = {r["doc_id"]: (r["size"], r["taken"]) for r in mixing.mixed_sizes(docs).collect()}
    assert got == {r[0]: (n, k) for r, n, k in zip(rows, size, taken, strict=True)}


def test_packs_are_those_of_plain_python(spark):
    rows = sample(150, 12)
    same_pack(packing.pack_documents(frame(spark, rows)), [(r[0], r[1]) for r in rows])


def test_whole_pipeline_is_that_of_plain_python(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    rows = docs.collect()
    # The model is the operator's own: other tests hold its training against a plain one.
    pred, score = language_id.predict(language_id.fit_sample(docs), [r["text"] for r in rows])
    rows = [r for r, p, s in zip(rows, pred, score, strict=True) if p != language_id.UNDEFINED and s >= corpus_pipeline.MIN_LANGUAGE_SCORE]
    rows = [r for r in rows if python_verdict(r["text"])]
    first = {i for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in rows], 5, 80) if i == c}
    rows = [(r["doc_id"], r["text"], r["source"]) for r in rows if r["doc_id"] in first]
    assert 50 < len(rows) < docs.count()
    same_pack(corpus_pipeline.run(spark, path), mixed_texts(rows, mixing.MixSpec()))
