"""Dictionaries of patterns, clusters without all pairs, and tables that are changed by key."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.operators import automaton, dedup, memory, products, stats, store
from fathomline.sources import boxes, keyed, readers, writers


@pytest.mark.parametrize(
    ("pattern", "terms"),
    [
        (r"\bGPT-4\b", ("gpt-4",)),
        (r"(?i)Watson|\bWatson\s*x\b", ("watson",)),
        (r"azure\s+openai", ("openai",)),
        (r"colou?r map", ("r map",)),
        (r"a{0,2}bcd+", ("bcd",)),
        (r"x(foo|bar)long", ("long",)),
        (r"[Gg]emini", ("emini",)),
        (r"\d{4}", None),
        (r"foo|\d+", None),
        (r"\Qa.b|c\E", ("a.b|c",)),
        (r"a\.b\+c", ("a.b+c",)),
        (r"É-cole", ("É-cole",)),
        (r"(?:long group)x", None),
        (r"\x41bcdef", None),
    ],
)
def test_required_terms(pattern, terms):
    assert automaton.required_terms(pattern) == terms


def test_automaton_equals_plain_search():
    r = random.Random(1)
    terms = [("".join(r.choice("abAB-é") for _ in range(r.randrange(1, 6))).lower().replace("É", "é"), r.randrange(40)) for _ in range(60)] + [("", 1), ("abab", 41)]
    machine = automaton.Automaton.of(terms)
    texts = ["".join(r.choice("abABc-éx") for _ in range(r.choice([0, 3, 50, 700, 1500]))) for _ in range(120)] + [None, "", "é" * 600]
    for t, got in zip(texts, machine.find(texts), strict=True):
        low = automaton.lowered(t or "")
        assert got.tolist() == sorted({e for x, e in terms if x and x in low})
    assert [x.tolist() for x in automaton.Automaton.of([]).find(["a", None])] == [[], []]


def plain_product(text, year, known, vendors):
    import regex

    for p in known:
        if regex.search("|".join([*p.patterns, *(rf"\b{a}\b" for a in p.aliases)]), text, regex.I) and (p.release_year is None or year is None or year >= p.release_year) and (not p.needs_context or regex.search(p.needs_context, text, regex.I)):
            return p.name, p.vendor, "SPECIFIC"
    hit = next((n for n, v in vendors if regex.search(v, text, regex.I)), None)
    return (None, hit, "VENDOR_ONLY") if hit else (None, None, "CATEGORY_ONLY")


@pytest.mark.parametrize(("many", "most_bytes"), [(100, automaton.MOST_BYTES), (100, 10), (10_000, automaton.MOST_BYTES)])
def test_dictionaries_of_any_size_give_the_first_match(spark, many, most_bytes):
    r = random.Random(many)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randrange(3, 6)))
    known = [products.Product(f"P{i}", f"V{i % 7}", "B1", (rf"\b{word()}\b", word() + r"\s+" + word()), r.choice([None, 2019, 2022]), r.choice([None, None, "model"]), (word(),)) for i in range(many)]
    vendors = [("Acme", "acme"), ("Digits", r"\d\d")]
    rows = [(i, " ".join(r.choice([word(), "model", "Acme", "42", "x"]) for _ in range(12)), r.choice([None, 2018, 2020, 2023]), "z") for i in range(60)] + [(60, None, 2020, "z"), (61, "", 2020, "z")]
    df = spark.createDataFrame(rows, "id int, said string, year int, __p string")
    out = products.with_products(df, "said", "year", known, vendors, out="found", most_bytes=most_bytes)
    assert out.columns == ["id", "said", "year", "__p", "found"]
    got = {x["id"]: tuple(x["found"]) for x in out.collect()}
    for i, text, year, _ in rows:
        assert got[i] == plain_product(text or "", year, known, vendors)
    early = products.exclusions(df, "said", "year", known, most_bytes).collect()
    want = [(y, p.name) for _, t, y, _ in rows for p in known if t and y and p.release_year and y < p.release_year and plain_product(t, None, [products.Product("x", "x", "x", p.patterns, aliases=p.aliases)], [])[0]]
    assert sorted((x["report_year"], x["product"]) for x in early) == sorted(want)


def test_first_match_of_patterns(spark):
    df = spark.createDataFrame([("Foo bar",), ("bar 12",), ("nothing",), (None,), ("12",)], "t string")
    got = automaton.first_match(df, "t", ["foo", r"\d+", "ba[rz]"], "n").collect()
    assert [x["n"] for x in got] == [0, 1, None, None, 1]
    assert automaton.first_match(df.where("false"), "t", ["foo"], "n").collect() == []


# -- clusters ----------------------------------------------------------------


def plain_clusters(rows, similar):
    out, heads = {}, {}
    for g, i, x, _ in sorted(rows, key=lambda r: (-r[3], r[1])):
        hit = next((h for h, y in heads.get(g, []) if similar(x, y)), None)
        out[g, i] = i if hit is None else hit
        if hit is None:
            heads.setdefault(g, []).append((i, x))
    return out


def test_cosine_clusters_equal_a_plain_loop(spark, monkeypatch):
    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 8))
    rows = [(int(i % 3), int(i), (centres[i % 12] + r.normal(size=8) * r.choice([0.1, 0.5, 1.0])).tolist(), float(i % 5)) for i in range(300)]
    rows += [(0, 300 + i, rows[0][2], 1.0) for i in range(6)] + [(1, 310, [0.0] * 8, 9.0), (1, 311, [0.0] * 8, 9.0)]
    plus = [(1, 320, None, 1.0), (1, 321, [], 1.0), (1, 322, [1.0, 0.0], 1.0), (1, 323, [2.0, 0.1], 0.5)]
    df = spark.createDataFrame(rows + plus, "g int, id int, v array<double>, conf double")

    def similar(x, y):
        a, b = np.array(x), np.array(y)
        return len(a) == len(b) and len(a) and a.any() and b.any() and float(a @ b / np.linalg.norm(a) / np.linalg.norm(b)) >= t

    for t in (0.85, 0.5):
        got = {(x["g"], x["id"]): x["cluster"] for x in dedup.greedy_cosine(df, ["g"], "id", "v", "conf", t).collect()}
        want = plain_clusters([x for x in rows + plus if x[2]], similar) | {(1, 320): 320, (1, 321): 321}
        assert got == want and len(set(want.values())) > 5
    assert dedup.greedy_cosine(df.where("false"), ["g"], "id", "v", "conf").collect() == []


def test_cosine_blocks_meet(spark, monkeypatch):
    """Vectors of one cell in several blocks: all of them come to one component, by ties whose number is linear."""
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 40)
    monkeypatch.setattr(dedup, "MOST_PIVOTS", 3)
    r = np.random.default_rng(4)
    vectors = r.normal(size=(300, 5)) * 0.2 + np.ones(5)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([("g", i, v.tolist()) for i, v in enumerate(vectors)], "grp string, id long, v array<double>")
    ties = dedup._cosine_ties(df, 0.9).collect()
    up = list(range(300))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in ties:
        assert vectors[x["a"]] @ vectors[x["b"]] > -1
        up[max(root(x["a"]), root(x["b"]))] = min(root(x["a"]), root(x["b"]))
    near = vectors @ vectors.T >= 0.9
    plain = list(range(300))
    for _ in range(300):
        new = [min([plain[j] for j in np.flatnonzero(near[i])]) for i in range(300)]
        if new == plain:
            break
        plain = new
    assert [root(i) for i in range(300)] == plain


def test_a_group_of_near_copies_gives_few_ties(spark):
    r = random.Random(6)
    base = [f"w{i}" for i in range(40)]
    sets = [base[:k] + base[k + 1 :] + [f"own{i}"] for i, k in enumerate(r.randrange(40) for _ in range(800))]
    sets += [[f"u{i}{j}" for j in range(12)] + ["w1"] for i in range(50)]
    df = spark.createDataFrame([(i, sorted(set(s))) for i, s in enumerate(sets)], "id long, set array<string>")
    ties = {(x["a"], x["b"]) for x in dedup._ties_of_sets(df, 0.7).collect()}
    assert len(ties) < 12 * 800
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in ties:
        assert len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.7 - 1e-6
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert all(root(i) == 0 for i in range(800)) and all(root(i) == i for i in range(800, 850))


# -- tables ------------------------------------------------------------------


def test_keyed_table_replaces_keys_in_one_commit(spark, tmp_path):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ("company", "year"), 5)
    with pytest.raises(ValueError, match="nothing"):
        t.read()
    rows = [(c, y, i, "bucket") for c in ("a", "b", None) for y in (2020, 2021) for i in range(3)]
    schema = "company string, year int, n int, __bucket string"
    assert t.replace(spark.createDataFrame(rows, schema)) == 1
    assert t.replace(spark.createDataFrame([("a", 2020, 9, "x"), (None, 2021, 8, "y"), ("c", 2022, 7, "z")], schema)) == 2
    want = [x for x in rows if (x[0], x[1]) not in (("a", 2020), (None, 2021))] + [("a", 2020, 9, "x"), (None, 2021, 8, "y"), ("c", 2022, 7, "z")]
    assert sorted(map(str, map(tuple, t.read().collect()))) == sorted(map(str, want))
    assert sorted(map(str, map(tuple, t.read(1).collect()))) == sorted(map(str, rows))
    assert t.replace(spark.createDataFrame([], schema)) == 2  # nothing to change
    assert t.replace(spark.createDataFrame([("a", 2020, 1, "x", 2.5)], schema + ", more double")) == 3
    assert t.read().where("more is not null").count() == 1 and "more" in t.read().columns
    assert t.vacuum() >= 0 and t.read().count() == len(want)
    merged = lambda both: store.last_wins(both, ["company", "year"], "n")
    t.upsert(spark.createDataFrame([("b", 2020, 50, "v", None)], schema + ", more double"), merged)
    assert [x["n"] for x in t.read().where("company = 'b' and year = 2020").collect()] == [50]


def test_a_writer_that_fails_leaves_the_old_version(spark, tmp_path):
    t = keyed.KeyedTable(spark, f"file://{tmp_path}/t", ("k",), 4)
    t.replace(spark.range(40).select(F.col("id").alias("k"), F.lit("old").alias("v")))

    def broken(old, new):
        both = old.unionByName(new)  # some tasks write their files, one fails
        return both.withColumn("v", F.when(F.col("k") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit("new")))

    with pytest.raises(Exception, match="lost"):
        t.change(spark.range(40).select(F.col("id").alias("k"), F.lit("new").alias("v")), broken)
    assert t.version() == 1 and {x["v"] for x in t.read().collect()} == {"old"} and t.read().count() == 40
    assert t.vacuum() <= 1 and t.read().count() == 40
    one, two = keyed.KeyedTable(spark, t.path, ("k",), 4), keyed.KeyedTable(spark, t.path, ("k",), 4)
    now = spark.range(1).select(F.col("id").alias("k"), F.lit("x").alias("v"))

    def overtaken(old, new):
        two.replace(now)
        return new

    with pytest.raises(RuntimeError, match="another writer"):
        one.change(now, overtaken)
    assert t.version() == 2


def test_cache_encodes_what_it_lacks(spark, tmp_path):
    cache = keyed.VectorCache(spark, f"file://{tmp_path}/c")
    asked = []

    def encoder(texts):
        asked.append(texts.count())
        return texts.select("text_hash", F.array(F.length("text") / 3, F.lit(-0.1)).alias("vector"))

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "a", None, "", "ccc"])], "id int, text string").withColumn("__h", F.lit(1))
    out, run = cache.encoded(df, "text", encoder)
    got = {x["id"]: x["vector"] for x in out.collect()}
    assert out.columns == ["id", "text", "__h", "vector"] and run == {"rows": 6, "texts": 4, "hits": 0, "misses": 4, "added": 4}
    assert got[3] is None and got[4] == [0.0, float(np.float32(-0.1))] and got[0] == got[2] == [float(np.float32(1 / 3)), float(np.float32(-0.1))]
    assert cache.encoded(df, "text", encoder)[1] == {"rows": 6, "texts": 4, "hits": 4, "misses": 0, "added": 0}
    more = df.unionByName(spark.createDataFrame([(9, "new", 1)], "id int, text string, __h int"))
    assert cache.encoded(more, "text", encoder)[1]["misses"] == 1 and asked == [4, 0, 1]
    one = cache.rows().where("dim = 2").first()
    assert np.frombuffer(one["vector"], "<f4")[1] == np.float32(-0.1)
    assert cache.add(spark.createDataFrame([(one["text_hash"], [5.0])], "text_hash string, vector array<double>")) == 0


def test_three_batches_equal_one_run(spark, tmp_path):
    r = random.Random(7)
    rows = [(i, r.choice("ab"), r.choice(["X", "Y", None]), r.randrange(2015, 2024)) for i in range(90)]
    refs = spark.createDataFrame(rows, "ref_id long, company string, category string, year int")
    s = keyed.MemoryStore(spark, f"file://{tmp_path}/m", ["category"])
    assert s.state() is None and s.batches() == [] and s.unprocessed(refs).count() == 90
    for n in range(3):
        assert s.merge(n, refs.where(F.col("ref_id") % 3 == n))
        before = sorted(map(str, s.state().collect()))
        assert not s.merge(n, refs.where(F.col("ref_id") % 3 == n)) and sorted(map(str, s.state().collect())) == before
        assert s.unprocessed(refs).count() == 90 - 30 * (n + 1)
    assert s.batches() == [0, 1, 2]
    whole = memory.events(refs, ["category"]).select("company", "category", "year", "ref_id", "event_type")
    assert sorted(map(str, s.events().collect())) == sorted(map(str, whole.collect()))
    years = refs.select("year").distinct()
    assert sorted(map(str, s.portfolio(years).collect())) == sorted(map(str, memory.portfolio(refs, ["category"], years).collect()))


def test_a_merge_reads_no_old_references(spark, tmp_path):
    s = keyed.MemoryStore(spark, f"file://{tmp_path}/m", ["category"])
    refs = spark.createDataFrame([(1, "a", "X", 2020)], "ref_id long, company string, category string, year int")
    refs.write.parquet(f"{tmp_path}/r1")
    s.merge(1, spark.read.parquet(f"file://{tmp_path}/r1"))
    for f in (tmp_path / "r1").glob("*.parquet"):
        f.unlink()
    s.merge(2, refs.withColumn("ref_id", F.lit(2).cast("long")).withColumn("year", F.lit(2018)))
    assert [(x["year"], x["ref_id"], x["event_type"]) for x in s.events().orderBy("year").collect()] == [(2018, 2, "NEW_ADOPTION"), (2020, 1, "CONFIRMED")]


# -- layouts, boxes, running totals ------------------------------------------


def test_a_scan_reads_only_files_of_its_ranges(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    df = spark.range(6000).select((F.col("id") % 6 + 2015).cast("int").alias("year"), (F.col("id") * 7919 % 1000).alias("company"), "id")
    writers.write_clustered(df, path, ["year", "company"], 12)
    every = writers.clustered_files(spark, path)
    some = writers.clustered_files(spark, path, year=(2016, 2016), company=(0, 100))
    assert len(every) >= 6 and 0 < len(some) <= 3
    found = writers.clustered_scan(spark, path, year=(2016, 2016), company=(0, 100))
    want = df.where("year = 2016 and company <= 100")
    assert sorted(map(str, found.collect())) == sorted(map(str, want.collect())) and found.count() > 0
    assert len(found.inputFiles()) == len(some)
    assert {x["f"] for x in found.select(F.col("_metadata.file_name").alias("f")).distinct().collect()} <= set(some)
    assert writers.clustered_scan(spark, path, year=(1900, 1901)).collect() == []
    open_end = writers.clustered_scan(spark, path, year=(2019, None))
    assert open_end.count() == df.where("year >= 2019").count()


def test_boxes_read_as_columns_of_words_does(spark):
    r = random.Random(11)
    rows = []
    for page in range(60):
        columns = r.choice([[(0, 600)], [(0, 280), (320, 600)], [(5, 180), (210, 380), (420, 610)]])
        for _ in range(r.randrange(1, 40)):
            a, b = r.choice(columns)
            x0 = r.uniform(a, b - 30)
            rows.append((page, x0, x0 + r.uniform(5, 30), float(r.randrange(30)) + r.random() * 3, f"w{r.randrange(99)}", 612.0))
    df = spark.createDataFrame([*rows, (99, None, 1.0, 1.0, "no", 612.0), (98, 1.0, 2.0, 1.0, None, 612.0)], "page int, x0 double, x1 double, top double, text string, width double")
    got = {x["page"]: x["text"] for x in boxes.page_texts(df, ["page"]).collect()}
    assert set(got) == set(range(60))
    for page, text in got.items():
        words = pd.DataFrame([x[1:5] for x in rows if x[0] == page], columns=["x0", "x1", "top", "text"])
        assert text == readers.columns_of_words(words, 612.0)


def test_running_totals(spark):
    r = random.Random(12)
    rows = [(r.randrange(50), i, r.choice([None, 1, 5, -2])) for i in range(500)]
    df = spark.createDataFrame(rows, "t int, id int, v long").repartition(5)
    got = {x["id"]: x["total"] for x in stats.running_totals(df, ["t", "id"], {"total": "v"}, 7).collect()}
    total = 0
    for _, i, v in sorted(rows):
        total += v or 0
        assert got[i] == total
    assert len(got) == 500 and stats.running_totals(df.where("false"), ["t"], {"total": "v"}).collect() == []


def test_windows_are_encoded_once_for_all_taxonomies(spark, tmp_path):
    import dataclasses

    from fathomline.operators import references, score
    from fathomline.plans.texts import SAMPLE

    log = f"{tmp_path}/encoded"

    def encoder(texts):
        with open(log, "a") as f:
            f.writelines("x\n" for _ in texts)
        return score.hashing_encoder(texts)

    r = random.Random(3)
    words = ["the", "license", "of", "new", "los", "und", "der", "systems", "company", "plans", "to", "grow"]
    pages = [(d, p, " ".join(r.choice(words) for _ in range(60)) + ".") for d in range(6) for p in (1, 2)]
    pages += [(9, 1, pages[0][2])]
    df = spark.createDataFrame(pages, "doc_id long, page int, page_text string")
    one = dataclasses.replace(SAMPLE, name="one", hard_triggers="license", soft_triggers=r"\blos\b", anchors=("the license of the company", "new systems"))
    two = dataclasses.replace(one, name="two", hard_triggers="systems", anchors=("plans to grow",))
    three = dataclasses.replace(one, name="three", anchors=())
    together = references.for_taxonomies(df, [one, two, three], ["doc_id"], encoder)
    got = sorted(map(str, together.drop("taxonomy", "reasons").collect()))
    encoded = sum(1 for _ in open(log))
    want = []
    for t in (one, two, three):
        want += [str(x) for x in references.detect(df, t, ["doc_id"], score.hashing_encoder).drop("reasons").collect()]
    assert got == sorted(want) and len(got) > 5
    windows_ = {x["window"] for t in (one, two) for x in references.candidates(df, t, ["doc_id"]).select("window").collect()}
    assert encoded == len(windows_) + 3  # and the anchors
