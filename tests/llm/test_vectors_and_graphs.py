"""kNN join, connected components, url filter, n-gram join: against brute force on small inputs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.llm import knn, ngram_join, url_filter
from fathomline.llm.shared import connected_components

VEC = "vec_id long, embedding array<float>"


def brute_top_k(rows, k):
    """Every row is a candidate but the query's own, whatever ids repeat."""
    good = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        good.append((i, [float(np.floor(64.0 * float(np.float32(x)))) for x in v]))
    out = []
    for at, (q, w) in enumerate(good):
        if q % 20 == 0:
            s = [(-int(sum(int(a) * int(b) for a, b in zip(w, v, strict=True))), i) for j, (i, v) in enumerate(good) if j != at and len(v) == len(w)]
            out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(sorted(s)[:k])]
    return sorted(out)


@pytest.mark.parametrize("spec", [knn.KnnSpec(), knn.KnnSpec(k=3, pivots=5, group_queries=2, chunk_rows=40), knn.KnnSpec(k=7, pivots=1, chunk_rows=7)])
def test_knn_matches_brute_force(spark, spec):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(4, 6)) * 3
    rows = [(i, [float(x) for x in (centres[i % 4] + rng.normal(size=6) * 0.1)]) for i in range(200)]
    rows += [(200 + i, list(rows[0][1])) for i in range(30)]  # ties
    rows += [(20, [9.0] * 6), (None, [1.0] * 6), (300, None), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (320, [float("nan")] * 6), (340, [float("inf")] + [0.0] * 5), (360, [1.0, 2.0]), (361, [1.0, 2.0]), (380, []), (380, []), (rows[7][0], list(rows[7][1])), (rows[40][0], list(rows[40][1])), (400, [1.0]), (420, [2.0] * 3)]
    df = spark.createDataFrame(rows, VEC).withColumn("rank", F.lit(1)).repartition(3)
    assert sorted(map(tuple, knn.top_k(df, F.col("vec_id") % 20 == 0, spec).collect())) == brute_top_k(rows, spec.k)


def test_knn_large_components_and_empty(spark):
    rows = [(0, [1e15, 1.0]), (1, [1e15, 2.0]), (2, [-3.4e38, 0.0])]
    got = knn.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0).collect()
    assert [r["vec_id"] for r in got] == [1, 2] and got[1]["score"] == -(1 << 63)
    assert knn.top_k(spark.createDataFrame([], VEC), F.col("vec_id") % 20 == 0).count() == 0


def test_knn_takes_any_number_of_lengths(spark):
    rows = [(20 * n + i, [float(i + n % 5)] * (n + 1)) for n in range(300) for i in range(2)]
    got = sorted(map(tuple, knn.top_k(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0).collect()))
    assert got == brute_top_k(rows, 20) and len(got) == 300


def test_knn_sends_queries_only_where_they_can_find_something(spark):
    rng = np.random.default_rng(2)
    centres = np.eye(6) * 1000
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=6)]) for i in range(600)]
    spec = knn.KnnSpec(k=5, pivots=12, group_queries=3, chunk_rows=50)
    assert sorted(map(tuple, knn.top_k(spark.createDataFrame(rows, VEC), F.col("vec_id") % 20 == 0, spec).collect())) == brute_top_k(rows, 5)
    between = np.abs(np.arange(5.0)[:, None] - np.arange(5.0)[None, :])
    first, split, n = knn.gathered(np.array([3, 0, 2, 9, 1]), between, 4)
    assert split.tolist() == [1, 0, 1, 3, 1] and n == 5 and first[0] == first[4] != first[2]


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(5, 5), (7, 6), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(parent)}
    got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == want and len(got) == len(want)
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    rule = url_filter.UrlRule
    rules = [rule("block", "com", "en/"), rule("allow", "example.com", "en/7"), rule("block", "net")]
    page = '<LINK href="{0}" rel="canonical">'
    turn = "<meta http-equiv='refresh' content='0; url={0}'>"
    rows = [
        (1, "https://Example.COM/en/7?x#y", ""), (2, "http://a.example.com/en/8", None), (3, "http://com/en/", ""), (4, "http://notcom/en/", ""), (5, None, "x"), (6, "no scheme/en/", ""),
        (7, "http://x.org/1", page.format("http://b.net/z")), (8, "http://x.org/2#f", turn.format("http://x.org/1")), (9, "http://x.org/2", ""), (10, "http://x.org/3", page.format("http://example.com/en/77")), (11, "http://net", ""),
        (12, "http://x.org/4", page.format("http://x.org/3")), (13, "http://b.net/q", page.format("http://x.org/3")), (13, "http://b.net/q", page.format("http://x.org/3")),
        (14, None, page.format("http://b.net/z")), (None, None, None), (15, "", "x" * 1_000_000),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    every = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(df, rules).collect()]
    assert (None, "", "", None, "allow") in every and len(every) == len(rows)
    got = sorted(x for x in every if x[0] is not None)
    verdicts = [(i, rule_, v) for i, _, _, rule_, v in got]
    assert verdicts == [
        (1, "example.com/en/7", "allow"), (2, "com/en/", "block"), (3, "com/en/", "block"), (4, None, "allow"), (5, None, "allow"), (6, None, "allow"), (7, None, "block"), (8, None, "block"), (9, None, "block"),
        (10, None, "allow"), (11, None, "allow"), (12, None, "allow"), (13, "net/", "block"), (13, "net/", "block"), (14, None, "allow"), (15, None, "allow"),
    ]
    assert got[0][1:3] == ("example.com", "/en/7") and got[4][1:3] == ("", "") and got[5][1:3] == ("", "")
    assert url_filter.judge_urls(df.limit(0), rules).count() == 0


def test_alias_links_are_resolved(spark):
    from urllib.parse import urljoin

    bases = ["http://h.org/a/b?q=1#f", "https://h.org", "http://h.org/a/b/"]
    hrefs = ["/x", "//o.net/x?y", "x", "../x", "./x/../y/", "../../../x", "?z=1", "http://o.net/x", "/a/./b/..", "x?u=../v", "."]
    rows = [(b, f"<LINK REL='alternate cAnonical' href='{h}'>") for b in bases for h in hrefs]
    want = [(b, urljoin(b, h)) for b in bases for h in hrefs]
    rows += [("http://h.org/1", '<link rel=canonical href=/2><link href="3" rel="canonical"/>'), ("http://h.org/4", '<META HTTP-EQUIV="rEfResh" content="0; URL=/5">'), ("http://h.org/6", '<base href="/deep/"><link rel="canonical" href="7">')]
    want += [("http://h.org/1", "http://h.org/2"), ("http://h.org/1", "http://h.org/3"), ("http://h.org/4", "http://h.org/5"), ("http://h.org/6", "http://h.org/deep/7")]
    rows += [("http://h.org/8", x) for x in ('<link rel="canonical-not" href="/9">', '<link rel="canonical" href="mailto:a@b">', '<link rel="canonical" href="#top">', '<link rel="icon" href="/canonical">')] + [("no scheme", '<link rel="canonical" href="/9">')]
    got = url_filter.alias_links(spark.createDataFrame(rows, "url string, html string")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    page = spark.createDataFrame([(1, "http://b.org/1", '<link rel="canonical" href="//b.net/z">')], "page_id long, url string, html string")
    assert url_filter.judge_urls(page, [url_filter.UrlRule("block", "net")]).first()["verdict"] == "block"


def sets_of(text, words):
    w = [] if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", w) if text is not None else []
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute_components(rows, words, percent):
    sets = [sets_of(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            o = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * o >= percent * (len(sets[i]) + len(sets[j]) - o):
                parent[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    name = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            name[i] = min(ids) if ids else None
    return sorted(((rows[i][0], len(sets[i]), name[i]) for i in range(len(rows))), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(60)] + ["É", "ß", "the", "OF"]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.65:
            base = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randrange(4)):
                base[rng.randrange(len(base))] = rng.choice(vocab)
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 5, 20, 45, 60, 90, 150])))))
    return rows


@pytest.mark.parametrize(("words", "percent", "block", "seed"), [(3, 90, 1_500_000, 1), (3, 90, 400, 2), (5, 80, 300, 3), (3, 50, 150, 4)])
def test_ngram_join_matches_brute_force(spark, words, percent, block, seed):
    rows = corpus(seed, 150) + [(500, None), (501, ""), (502, " \n\t"), (503, "One Two"), (504, "one\ttwo"), (505, "ONE"), (None, "one two"), (None, None), (3, "again " * 30), (506, "x " * 30000), (507, "a b c d")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit(1)).repartition(3)
    spec = ngram_join.JoinSpec(words=words, percent=percent, block_shingles=block, chunk_bytes=3000)
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(df, spec).collect()), key=str)
    assert got == brute_components(rows, words, percent)


def test_ngram_join_stores_no_sets(spark, monkeypatch):
    r, stored = random.Random(11), []
    texts = [" ".join(str(r.randrange(900)) for _ in range(80)) for _ in range(6)]
    df = spark.createDataFrame([(6 * k + i, f"copy{k} {t}") for k in range(4) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(ngram_join, "cut", lambda frame, cut=ngram_join.cut: stored.append(frame.columns) or cut(frame))
    got = {x["doc_id"]: x["component_id"] for x in ngram_join.jaccard_components(df).collect()}
    assert got == {i: i % 6 for i in range(24)}  # sets of near copies, all of which are searched
    assert stored and not [c for c in stored if "sh" in c]


def test_ngram_join_with_wide_slots_and_repeated_ids(spark):
    rows = [(i % 7 if i % 3 else None, t) for i, t in corpus(6, 120)]
    rows += [(1, "same id same text " * 4)] * 5 + [(None, "no id same text " * 4)] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in ngram_join.jaccard_components(df, ngram_join.JoinSpec(most_bits=8, chunk_bytes=2000)).collect()), key=str)
    assert got == brute_components(rows, 3, 90)


def test_slots_are_shared_from_the_second_on():
    got = ngram_join._shared_slots(np.array([5, 7, 5, 9, 65535, 0], np.uint32), np.array([9, 11], np.uint32))
    assert got.tolist() == [True, False, True, True, False, False]
    assert not len(ngram_join._shared_slots(np.zeros(0, np.uint32), np.zeros(0, np.uint32)))
    x = np.random.default_rng(1).integers(0, 1 << 24, 1000).astype(np.uint32)
    for wide, size in ((False, 3), (True, 4)):
        raw = ngram_join._slot_bytes(x, wide)
        assert len(raw) == size * len(x) and (ngram_join._slots_of(raw, wide) == x).all() and not len(ngram_join._slots_of(b"", wide))


def test_a_flush_has_few_rows(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(402))) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("th", F.lit(0).cast("long")).coalesce(1)
    counted = df.mapInPandas(ngram_join._count_side(ngram_join.JoinSpec(), 10, False), "kind int, bucket int, flush long, slot binary, who binary, several binary")
    n, slots = counted.where("kind = 0").agg(F.count("*"), F.sum(F.length("slot")) / 3).first()
    assert n <= 1 << 10 and abs(slots - 400_000) < 100


@pytest.mark.parametrize(("percent", "grouped"), [(50, False), (80, True), (90, False)])
def test_block_links_connect_what_links_connect(percent, grouped):
    rng = np.random.default_rng(percent)
    base = [np.unique(rng.integers(0, 1 << 40, rng.integers(1, 40), dtype=np.uint64)) for _ in range(12)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > 0.1], rng.integers(0, 1 << 40, 1, dtype=np.uint64)])) for b in base for _ in range(12)]
    group = rng.integers(0, 100, len(sets)) if grouped else None
    parent = list(range(len(sets) + 100))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)) if grouped else ():
        parent[find(i)] = find(len(sets) + int(group[i]))
    link = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (o := len(np.intersect1d(sets[i], sets[j]))) >= percent * (len(sets[i]) + len(sets[j]) - o)]
    start = list(parent)
    for i, j in link:
        parent[find(i)] = find(j)
    want = {frozenset(k for k in range(len(sets)) if find(k) == find(i)) for i in range(len(sets))}
    parent = start
    found = ngram_join.block_links(sets, percent, 0.005, None, group)
    assert {(max(x), min(x)) for x in found} <= set(link)
    for i, j in found:
        assert find(i) != find(j)  # a forest
        parent[find(i)] = find(j)
    assert {frozenset(k for k in range(len(sets)) if find(k) == find(i)) for i in range(len(sets))} == want


def test_ngram_join_keeps_one_of_each(spark):
    rows = [(1, "a b c d e"), (2, "a b c d e"), (3, "z"), (4, None), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit("x"))
    assert sorted(r["doc_id"] for r in ngram_join.one_of_each(df).collect()) == [1, 3, 4, 5]
    assert ngram_join.jaccard_components(df.limit(0)).count() == 0


def test_ngram_join_keeps_one_of_each_where_ids_repeat(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (2, "a b c d e"), (2, "p q r s t"), (7, "p q r s t"), (1, "p q r s t"), (None, "z z"), (None, "z z"), (3, None), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit("x")).repartition(3)
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted([(1, "a b c d e"), (1, "p q r s t"), (None, "z z"), (3, None), (3, None)], key=str)


@pytest.mark.parametrize("percent", [50, 80, 90])
def test_part_hashes_meet_whenever_sets_can_be_linked(percent):
    rng = np.random.default_rng(5)
    bounds = ngram_join.size_bounds(percent)
    met = 0
    for _ in range(600):
        n = int(rng.integers(1, 160))
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        drop = int(rng.integers(0, max(1, n // 4)))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, max(1, n // 4))), dtype=np.uint64)]))
        o = len(np.intersect1d(a, b))
        if len(b) and 100 * o >= percent * (len(a) + len(b) - o) and o < max(len(a), len(b)):
            met += 1
            assert len(np.intersect1d(ngram_join.part_hashes(a, bounds, percent), ngram_join.part_hashes(b, bounds, percent)))
    assert met > 50


def test_bounds_hold_and_prune_clustered_groups():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(3, 8)) * 1000
    x = np.round(np.concatenate([c + rng.normal(size=(40, 8)) for c in centres]))
    big = float((x**2).sum(1).max())
    lift = lambda v, q: np.zeros(len(v)) if q else np.sqrt(np.maximum(big - (v**2).sum(1), 0))
    pivots = np.concatenate([x[::40], lift(x[::40], False)[:, None]], 1)
    d, q = knn._distances(x, lift(x, False), pivots), knn._distances(x, lift(x, True), pivots)
    home, near = d.argmin(1), q.argmin(1)
    radius = np.array([q[near == j, j].max() if (near == j).any() else np.nan for j in range(3)])
    bound = knn.group_bounds(radius, [np.sort(d[home == j, j])[:6] for j in range(3)], pivots, 5)
    for i in range(len(x)):
        every = np.sort(np.sqrt(np.maximum((x[i] ** 2).sum() + big - 2 * x @ x[i], 0)))
        assert every[5] <= bound[near[i]] + 1e-6


def test_packed_classes():
    who = np.array([0, 1, (1 << 40) - 1, 1 << 33], np.int64)
    assert (ngram_join._unpacked(ngram_join._packed(who)) == who).all()


@pytest.mark.parametrize(
    ("html", "links"),
    [
        ('<link rel="canonical" href="/p?a=1&amp;b=2&#38;c=&#x33;&lt;&bogus;&#0;">', ["http://h.org/p?a=1&b=2&c=3<&bogus;&#0;"]),
        ('<link title="a > b" rel="canonical" href="/q">', ["http://h.org/q"]),
        ("<link title='rel=canonical' href=/no>", []),
        ('<!-- <link rel="canonical" href="/no"> --><link rel="canonical" href="/yes">', ["http://h.org/yes"]),
        ('<!-- open <link rel="canonical" href="/no">', []),
        ('<script>var x = "<!--"; y = \'<link rel="canonical" href="/no">\';</script><link rel=canonical href=/yes>', ["http://h.org/yes"]),
        ('<meta content="0; url=\'/turn?x=1&amp;y=2\'" http-equiv=refresh>', ["http://h.org/turn?x=1&y=2"]),
        ('<link rel="canonical">', []),
        ('<link rel="canonical" href>', []),
        ('<link rel="alternate Canonical" href=" /spaced ">', ["http://h.org/spaced"]),
        ('<link data-rel="canonical" href="/no"><link rel="canonical" data-href="/no" href="/yes" href="/second">', ["http://h.org/yes"]),
        ('<base href="http://o.org/x/"><base href="/second/"><link rel="canonical" href="y">', ["http://o.org/x/y"]),
        ('<link rel="canonical" href="&#128512;">', ["http://h.org/\U0001f600"]),
        ("<link " + "a='b' " * 3000 + "rel=canonical href=/long>", ["http://h.org/long"]),
        ("<link rel=canonical href='/never ends" + " x" * 3000, []),
    ],
)
def test_links_of_every_form(spark, html, links):
    df = spark.createDataFrame([("http://h.org/1", html, "t", 1)], "url string, html string, tag string, row int")
    assert [x["b"] for x in url_filter.alias_links(df).collect()] == links


def test_scheme_and_host_are_the_same_in_any_case(spark):
    rows = [(1, "http://ok.com/z", ""), (2, "http://bad.org/es/1", '<link rel="canonical" href="HTTP://OK.com/z">'), (3, "http://OK.com/Z", "")]
    got = {x["page_id"]: x["verdict"] for x in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), [url_filter.UrlRule("block", "org", "es/")]).collect()}
    assert got == {1: "block", 2: "block", 3: "allow"}


@pytest.mark.parametrize("ids", [(1, 2, 3, 4), (1, 1, 2, None)])
def test_near_duplicates_keep_columns_of_any_name(spark, ids):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(d, t, i, f"x{i}", 2.5) for i, (d, t) in enumerate(zip(ids, (text, text, text + " more", None), strict=True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row long, __kept string, component_id double")
    got = ngram_join.one_of_each(df)
    assert got.columns == df.columns
    kept = [tuple(x) for x in got.collect()]
    assert all(x in rows for x in kept) and sorted(x[2] for x in kept)[-1] == 3 and len(kept) == 2


def test_urls_without_a_host_link_nothing(spark):
    page = '<link rel="canonical" href="{0}">'
    rows = [(1, "", page.format("http://a.org/es/1")), (2, "", page.format("http://b.com/ok")), (3, "no scheme", page.format("http://a.org/es/1")), (4, "http://b.com/ok", ""), (5, "http://a.org/es/1", "")]
    got = {x["page_id"]: x["verdict"] for x in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), [url_filter.UrlRule("block", "org", "es/")]).collect()}
    assert got == {1: "allow", 2: "allow", 3: "allow", 4: "allow", 5: "block"}
