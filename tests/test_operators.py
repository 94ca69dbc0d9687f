"""Operators on literal fixtures, and properties of whole tables."""

import functools
import json
import math
import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.functions import text as tx
from fathomline.operators import charts, dedup, diffusion, evaluate, index, memory, products, relational, rules, store, taxonomy, trajectory, translate, vocabulary, windows
from fathomline.plans import catalogue
from fathomline.plans.texts import SAMPLE
from fathomline.sources import readers, writers


def one(spark, expr, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return row.select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "lang"),
    [("We seek to invest efficiently in AI technologies and machine learning solutions.", "en"), ("私たちは人工知能を導入しました。" * 5, "ja"), ("我们公司部署了人工智能系统用于风险管理和客户服务等多个方面", "zh"), ("우리는 인공지능을 도입했습니다 그리고 한국어 문장을 씁니다", "ko"), ("short", "en"), (None, "en")],
)
def test_script_language(spark, text, lang):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tx.script_language(F.col("t")).alias("x")).first()["x"] == lang


def test_repair(spark):
    c = F.col("t")
    assert one(spark, tx.repaired(c), t="machineLearning modelsDeployed across theGroup here") == "machine Learning models Deployed across the Group here"
    assert one(spark, tx.repaired(c), t="a clean sentence with  many   spaces\n\n\n\nand lines") == "a clean sentence with many spaces\n\nand lines"
    assert one(spark, tx.repaired(c), t="tooShort") == "tooShort"
    assert one(spark, tx.split_joined(c), t="our APIs and,SaaS plansGrow.Now ourAPIs") == "our APIs and, SaaS plans Grow. Now our API s"


def test_markers_and_sanitising(spark):
    t = F.col("t")
    assert one(spark, tx.marked(t, F.lit("ai")), t="Our AI and ai") == "Our >>>AI<<< and ai"
    assert one(spark, tx.marked(t, F.lit("ai")), t="Our >>>x<<< ai") == "Our >>>x<<< ai"
    assert one(spark, tx.unmarked(t), t="a >>>b\nc<<< d") == "a b\nc d"
    assert one(spark, tx.sanitised(t), t=" “a”\u0000  • b…\r\nc ") == '"a" - b...\nc'
    assert len(one(spark, tx.sanitised(t), t="x" * 40000)) == 32003


def python_windows(text, size=500):
    import re

    sents = [s.strip() for s in re.split(r"(?<=[.!?])\s+(?=[A-Z])", text) if s.strip()]
    if len(text) < 20:
        return []
    if len(sents) <= 1:
        return [text[i : i + size] for i in range(0, len(text), size - 100)]
    out, now, n = [], [], 0
    for s in sents:
        if n + len(s) > size and now:
            out.append(" ".join(now))
            now = now[-1:]
            n = len(now[0])
        now.append(s)
        n += len(s)
    return [*out, " ".join(now)]


def test_text_windows_equal_a_plain_loop(spark):
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefg ") for _ in range(rng.randrange(3, 300))).strip().capitalize() + rng.choice(".!?") for _ in range(rng.randrange(1, 12))) for _ in range(40)] + ["short", "", "x" * 1300]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {}
    for r in windows.text_windows(df).orderBy("id", "window_no").collect():
        got.setdefault(r["id"], []).append(r["window"])
    assert got == {i: w for i, t in enumerate(texts) if (w := python_windows(t))}


def test_context_sentences(spark):
    text = "First one here. Second two here. We use AI now. Fourth four. Fifth five. Sixth six."
    got = one(spark, windows.context_sentences(F.col("t"), F.instr("t", "AI"), F.lit("AI"), 1, 1), t=text)
    assert got == "Second two here. We use >>>AI<<< now. Fourth four."


FP = (("embedding", (r"embedding (esg|culture)",)), ("person", (r"ceo \w+ \w+", r"claude monet")), ("robot", (r"\brobot\b",)))


@pytest.mark.parametrize(("text", "want"), [("embedding ESG values", "embedding"), ("CEO Claude Monet", "person"), ("welding robot arm", "robot"), ("autonomous robot using machine learning", None), ("nothing", None)])
def test_false_positives(spark, text, want):
    assert one(spark, rules.first_false_positive(F.col("t"), FP, catch_all=(r"\brobot\b",), subject="machine learning"), t=text) == want


def test_gates(spark):
    df = spark.createDataFrame([("none", False, False, False, False), ("cooccur", True, False, False, False), ("cooccur", False, True, True, False), ("cooccur_verb", True, False, False, False), ("soft", False, False, False, True), ("soft", False, True, False, False)], "g string, a boolean, v boolean, m boolean, e boolean")
    assert [r["x"] for r in df.select(rules.gate_pass(*[F.col(c) for c in "gavme"]).alias("x")).collect()] == [True, True, True, False, True, False]


def test_classification_prefers_patterns_then_order(spark):
    df = spark.createDataFrame([("the license",), ("und of",), ("nothing",), (None,)], "window string")
    rows = rules.classified(df, SAMPLE).collect()
    assert [r["combined"] for r in rows] == ["A1", "A2", "UNCLASSIFIED", "UNCLASSIFIED"]
    assert rows[0]["conf_A"] == 0.9
    assert rows[1]["code_B"] is None


def test_confidence(spark):
    df = spark.createDataFrame([(0.6, True, 2), (0.3, False, 1), (0.1, False, 0), (0.3, True, 0)], "s double, h boolean, p int")
    a = [F.col(c) for c in "shp"]
    got = df.select(rules.confidence(*a).alias("c"), rules.method(*a).alias("m"), rules.accepted(*a).alias("k"), rules.reasons(*a).alias("r")).withColumn("s", rules.strength(F.col("c"))).collect()
    assert [(r["c"], r["s"], r["m"], r["k"]) for r in got] == [(1.0, "strong", "pattern_hard", True), (0.3, "mention_only", "pattern_soft", False), (0.0, "unknown", "unknown", False), (0.65, "medium", "pattern_hard_kw", True)]
    assert got[0]["r"] == "hard_trigger|pattern_matches=2|semantic_strict=0.600"


def test_taxonomies():
    t = taxonomy.from_sheets("x", [{"dimension": "A", "code": "A1", "name": "n"}], [{"code": "A1", "keyword": "k"}], [{"code": "A1", "pattern": "("}, {"code": "A1", "pattern": "ok"}], [{"fp_category": "f", "pattern": "p"}])
    good, bad = t.checked()
    assert bad == ["("] and good.patterns() == ["ok"] and good.keyword_tier("A1", "k") == 2 and good.keyword_tier("A1", "none") == 2
    assert good.merged({"A1": ("k", "new")}).keywords() == ["k", "new"]
    assert taxonomy.by_name(taxonomy.register(good).name) is good
    with pytest.raises(KeyError):
        taxonomy.by_name("absent")
    with pytest.raises(ValueError, match="Keywords"):
        taxonomy.from_sheets("x", [{"dimension": "A", "code": "A1"}], [{"code": "A1"}])


def test_taxonomy_terms(spark):
    assert taxonomy.statistics(spark, SAMPLE).orderBy("dim").collect()[0].asDict() == {"dim": "A", "codes": 3, "keywords": 6, "patterns": 3}


def refs(spark, rows):
    return spark.createDataFrame(rows, "company string, year int, category_a string, category_b string, product string, ref_id long")


def test_memory_over_years(spark):
    r = refs(spark, [("T", 2022, "A3", "B4", "X", 1), ("T", 2022, "A2", "B7", "Y", 2), ("T", 2022, "A7", "B8", "", 3), ("T", 2023, "A3", "B4", "X", 4)])
    ev = {(x["category_b"], x["year"]): x["event_type"] for x in memory.events(r, ["category_b", "product"]).collect()}
    assert ev == {("B4", 2022): "NEW_ADOPTION", ("B7", 2022): "NEW_ADOPTION", ("B8", 2022): "NEW_ADOPTION", ("B4", 2023): "CONFIRMED"}
    years = spark.createDataFrame([(2022,), (2023,), (2025,)], "year int")
    p = {x["category_b"]: (x["first_seen_year"], x["last_confirmed_year"], x["status"], x["discontinued_year"]) for x in memory.portfolio(r, ["category_b", "product"], years).collect()}
    assert p == {"B4": (2022, 2023, "DISCONTINUED", 2025), "B7": (2022, 2022, "DISCONTINUED", 2025), "B8": (2022, 2022, "DISCONTINUED", 2025)}
    assert memory.links(r).where("category_b = 'B4'").first()["years"] == [2022, 2023]
    assert one(spark, memory.granularity(F.col("p"), F.col("v")), p="", v="Acme") == "VENDOR_ONLY"


def test_event_trajectory_of_one_company(spark):
    ev = spark.createDataFrame(
        [("T", 2021, "A", "A3", "", "", "NEW_ADOPTION"), ("T", 2021, "B", "B4", "GPT-3", "OpenAI", "NEW_ADOPTION"), ("T", 2021, "B", "B3", "", "", "NEW_ADOPTION"), ("T", 2023, "B", "B3", "", "", "DISCONTINUED"), ("T", 2025, "A", "A7", "", "", "NEW_ADOPTION")],
        "company string, year int, dimension string, category string, product string, vendor string, event_type string",
    )
    pb = spark.createDataFrame([("T", "B4", "", "", "CATEGORY_ONLY", 2021, 2025, None, "ACTIVE"), ("T", "B3", "", "", "CATEGORY_ONLY", 2021, 2021, 2023, "DISCONTINUED")], "company string, category_b string, product string, vendor string, granularity string, first_seen_year int, last_confirmed_year int, discontinued_year int, status string")
    years = spark.createDataFrame([("T", y) for y in range(2021, 2026)], "company string, year int")
    n = spark.createDataFrame([("T", 2021, 10), ("T", 2022, 15), ("T", 2023, 20), ("T", 2024, 25), ("T", 2025, 30)], "company string, year int, n int")
    t = {r["year"]: r for r in trajectory.event_trajectory(trajectory.contributions(ev, pb, years), years, n).collect()}
    assert [(t[y]["delta_a"], t[y]["delta_b"], t[y]["delta_p"], t[y]["maturity_m"], t[y]["retirement_r"], t[y]["breadth"]) for y in range(2021, 2026)] == [(2, 2, 0, 0, 0, 4), (0, 0, 0, 0, 0, 0), (0, -1, 0, 0, -1, -2), (0, 0, 0, 0, 0, 0), (2, 0, 0, 1, 0, 3)]
    assert round(t[2021]["depth"], 3) == 0.865 and t[2022]["depth"] == 1.0
    assert len(trajectory.TrajectoryParams().config_hash()) == 12


def made_references(spark, n=400):
    rng = random.Random(11)
    rows = [(rng.choice(["c", "d", "e"]), rng.randint(2010, 2024), rng.choice(["A1", "A2", "A3"]), rng.choice(["B1", "B2", "B3"]), rng.choice(["", "x", "y"]), rng.choice(["", "v"]), rng.choice(["t1", "t2", "t3", None]), rng.choice(["positive", "pending", "neutral"])) for _ in range(n)]
    rows = [r for r in rows if r[1] % 7 or r[0] == "c"]
    return spark.createDataFrame(rows + rows[:9], "company string, year int, category_a string, category_b string, product string, vendor string, text string, sentiment string")


def event_route(refs):
    """Contributions from stored events and portfolios."""
    y = refs.select("year").distinct()
    r = refs.withColumn("ref_id", F.lit(1))
    unit_b = ["category_b", "product", "vendor"]
    p = memory.portfolio(r, unit_b, y).withColumn("granularity", memory.granularity(F.col("product"), F.col("vendor")))
    as_event = lambda e, d, c, year="year": e.select("company", F.col(year).alias("year"), F.lit(d).alias("dimension"), F.col(c).alias("category"), *[F.col(k) if d == "B" else F.lit("").alias(k) for k in ("product", "vendor")], "event_type")
    ev = as_event(memory.events(r, ["category_a"]), "A", "category_a").unionByName(as_event(memory.events(r, unit_b), "B", "category_b"))
    for d, unit in (("A", ["category_a"]), ("B", unit_b)):
        ev = ev.unionByName(as_event(memory.discontinued(r, unit, y).withColumn("event_type", F.lit("DISCONTINUED")), d, unit[0], "discontinued_year"))
    cy = refs.select("company", "year").distinct()
    return trajectory.contributions(ev, p, cy), cy


def rounded(rows):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in rows), key=str)


def test_trajectories_of_units_equal_those_of_events(spark):
    refs = made_references(spark)
    c, cy = event_route(refs)
    units, years = trajectory.spans(refs, vendor="vendor"), refs.select("year").distinct()
    names = ["company", "year", "component", "category", "event_type"]
    want = c.groupBy(*names).agg(F.count("*").alias("units"), F.sum("points").alias("points"))
    got = trajectory.unit_contributions(units, years).join(cy, ["company", "year"], "left_semi")
    want = want.join(cy, ["company", "year"], "left_semi")
    assert rounded(got.select(*names, "units", "points").collect()) == rounded(want.select(*names, "units", "points").collect()) and got.where("component = 'maturity' and units > 1").count()
    n = refs.groupBy("company", "year").agg(F.count_distinct("text").alias("n"))
    old = trajectory.event_trajectory(c, cy, n)
    assert rounded(trajectory.unit_trajectory(units, years).select(*old.columns).collect()) == rounded(old.collect())
    other = trajectory.TrajectoryParams(maturity_years=3, new_b=0.5, product_cap=0.75)
    assert trajectory.unit_trajectory(units, years, other).agg(F.max("delta_p")).first()[0] <= 0.75


def test_pairs_of_references_equal_those_of_links(spark):
    refs = made_references(spark)
    lone = refs.where("company = 'c' and year = 2010").limit(1).withColumn("category_a", F.lit("A9")).withColumn("sentiment", F.lit("pending"))
    refs = refs.union(lone)
    a, b = (refs.select("company", "year", F.col(f"category_{k}").alias("category")) for k in "ab")
    old = trajectory.pair_trajectory(trajectory.year_pairs(memory.links(refs.where("sentiment <> 'pending'")), a, b))
    new = trajectory.pair_scores(trajectory.reference_pairs(refs, F.col("sentiment") != "pending"))
    assert new.columns == old.columns and rounded(new.collect()) == rounded(old.collect())


def test_trajectories_of_odd_references(spark):
    rows = [(None, 2020, "A1", "B1", None, None, "t", "positive"), ("c", None, "A1", "B1", "x", "v", "t", "positive"), ("c", 2020, None, " ", "x", "v", None, None), ("d", 2020, "A1", None, "x", "v", "t", "positive"), ("d", 2020, "A1", None, "x", "v", "t", "positive"), ("d", 2020, None, "B2", "x", "v", "long " * 9000, "pending")]
    odd = spark.createDataFrame(rows, made_references(spark, 1).schema).withColumn("at", F.lit("clash")).withColumn("linked", F.lit("clash")).withColumn("ended", F.lit("clash"))
    units = trajectory.spans(odd, vendor="vendor")
    t = {(r["company"], r["year"]): r for r in trajectory.unit_trajectory(units, odd.select("year").where("year is not null").distinct()).collect()}
    assert set(t) == {(None, 2020), ("c", 2020), ("d", 2020)}
    assert t["c", 2020]["breadth"] == 0.0 and t["c", 2020]["depth"] == 0.0
    assert (t["d", 2020]["delta_a"], t["d", 2020]["delta_b"], t["d", 2020]["delta_p"]) == (2.0, 1.0, 0.5) and round(t["d", 2020]["depth"], 6) == round(math.log2(3) / 4, 6)
    assert (t[None, 2020]["delta_a"], t[None, 2020]["delta_b"], t[None, 2020]["delta_p"]) == (2.0, 1.0, 0.0)
    s = {r["company"]: (r["pair_points"], r["new_pairs"]) for r in trajectory.pair_scores(trajectory.reference_pairs(odd, F.col("sentiment") != "pending")).collect()}
    assert s == {None: (3.0, 1), "d": (3.0, 2)}
    none = odd.limit(0)
    assert trajectory.unit_trajectory(trajectory.spans(none), none.select("year")).count() == 0 == trajectory.pair_scores(trajectory.reference_pairs(none, F.lit(True))).count()


def test_stages_and_phrases(spark):
    df = spark.createDataFrame([(0.01, 0.0), (0.6, 0.0), (0.1, 0.7), (0.25, 0.0), (0.1, 0.1)], "p double, s double")
    assert [r["x"] for r in df.select(diffusion.stage(F.col("p"), F.col("s")).alias("x")).collect()] == ["emerging", "mature", "mature", "growth", "declining"]
    assert one(spark, diffusion.gives_up(F.col("t")), t="They PHASED OUT it") and not one(spark, diffusion.gives_up(F.col("t")), t="They use it")


def test_yearly_rows_never_count_down(spark):
    p = spark.createDataFrame([("c", "b", "x", "v", 2020, 2022, 2022), ("c", "b", "y", "v", 2021, 2021, 2020), ("c", "b", "", "v", 2020, 2020, None)], "company string, category_b string, product string, vendor string, first_seen_year int, last_confirmed_year int, discontinued_year int")
    assert sorted((r["product"], r["year"]) for r in diffusion.yearly(p).collect()) == [("b", 2020), ("x", 2020), ("x", 2021)]


def test_index_bounds(spark):
    with pytest.raises(ValueError):
        index.IndexWeights(volume=0.5)
    rows = [("c", 2020, 0.4, "positive", 0.9, "strong", "we will invest", "A1", "B1", 10), ("c", 2020, 0.0, "pending", 0.0, "x", "none", None, "", 10)]
    df = spark.createDataFrame(rows, "company string, year int, semantic_score double, sentiment string, sentiment_score double, strength string, text string, category_a string, category_b string, pages int")
    r = index.composite(index.factors(df, F.sum("pages"), "will", "invest")).first()
    assert all(0 <= r[f] <= 1 for f in (*index.FACTORS, "disclosure_index")) and r["tone"] == 1.0 and r["depth"] == 0.4 and r["specificity"] == 0.5 and r["breadth"] == 0.25


def test_similar_classes_are_all_pairs_of_all_languages(spark, tmp_path):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(5, 20))] for _ in range(12)]
    texts = [" ".join(w if rng.random() > 0.1 else f"x{rng.randrange(9)}" for w in rng.choice(base)) for _ in range(120)]
    texts += [t.upper() for t in texts[:30]] + ["same again"] * 20 + ["", " ", None]
    rows = [(i, t, ("en", "fr", "de", "es", None)[i % 5]) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id int, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["id_a"], r["id_b"], r["jaccard"]) for r in catalogue.QUERIES["dedup_jaccard_pairs"](spark, str(tmp_path)).collect()]
    sets = {i: frozenset(t.lower().split()) for i, t, _ in rows if t and t.strip()}
    first = {s: min(i for i in sets if sets[i] == s) for s in sets.values()}
    heads = sorted(first.values())
    want = [(first[s], i, 1.0) for i, s in sets.items() if first[s] < i]
    want += [(a, b, j) for a in heads for b in heads if a < b and (j := round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6)) >= 0.7]
    assert sorted(got) == sorted(want) and len(want) > len(sets) - len(heads)
    paired = {(a, b) for a, b, _ in got} | {(a, a) for a in heads}
    alike = {(a, b) for a in sets for b in sets if a < b and round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) >= 0.7}
    name = {i: first[s] for i, s in sets.items()}
    assert alike == {(a, b) for a in sets for b in sets if a < b and tuple(sorted((name[a], name[b]))) in paired}
    lang = {i: x for i, _, x in rows}
    assert any(lang[a] != lang[b] for a, b, _ in got) and any(lang[a] is None for a, _, _ in got)


@pytest.mark.parametrize(("threshold", "block"), [(0.7, 1000), (0.35, 7)])
def test_similar_pairs_of_all_sizes_equal_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(dedup, "CELL_SETS", block)
    rng = random.Random(8)
    texts = []
    for size in (1, 3, 9, 40, 150, 400):
        base = [f"w{rng.randrange(900)}" for _ in range(size)]
        texts += [" ".join(base[: rng.randint(max(1, size // 3), size)] + [f"x{rng.randrange(99)}" for _ in range(rng.randint(0, size // 6))]) for _ in range(25)]
    got = {(r["id_a"], r["id_b"]): r["jaccard"] for r in dedup.similar_pairs(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", threshold).collect()}
    sets = [set(t.split()) for t in texts]
    want = {(a, b): j for a in range(150) for b in range(a + 1, 150) if (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= threshold}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-6 for p in want) and len(want) > 300


def _shuffled(spark) -> int:
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(x.totalShuffleWrite() for x in [spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0)])


def test_similar_classes_shuffle_less_than_every_word_twice(spark):
    rng = random.Random(9)
    texts = [" ".join(f"word{int(rng.paretovariate(0.4)) % 100_000}" for _ in range(250)) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts + [t + " more" for t in texts[:20]])), "id int, t string").repartition(4).localCheckpoint()
    before, words = _shuffled(spark), sum(len(set(t.split())) for t in texts)
    assert dedup.similar_classes(df, "id", "t", 0.7).where("jaccard < 1").count() == 20
    assert _shuffled(spark) - before < 16 * words


def test_greedy_clusters_equal_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(g, i, " ".join(rng.choice("abcdef") for _ in range(4)), rng.choice([0.1, 0.5, 0.9])) for g in "xy" for i in range(60)]
    df = spark.createDataFrame(rows, "g string, id int, text string, conf double")
    got = {(r["g"], r["id"]): r["cluster"] for r in dedup.greedy_jaccard(df, ["g"], "id", "text", "conf", 0.6).collect()}
    for g in "xy":
        heads = []
        for _, i, t, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1])):
            s = set(t.split())
            hit = next((h for h, hs in heads if len(s & hs) / len(s | hs) >= 0.6), None)
            if hit is None:
                heads.append((i, s))
            assert got[g, i] == (i if hit is None else hit)


def test_greedy_clusters_shuffle_less_than_every_word_twice(spark):
    rng = random.Random(9)
    texts = [" ".join(f"word{int(rng.paretovariate(0.4)) % 100_000}" for _ in range(250)) for _ in range(1500)]
    rows = [("g", i, t, 0.5) for i, t in enumerate(texts + [t + " more" for t in texts[:20]])]
    df = spark.createDataFrame(rows, "g string, id int, t string, c double").repartition(4).localCheckpoint()
    before, words = _shuffled(spark), sum(len(set(t.split())) for t in texts)
    assert dedup.greedy_jaccard(df, ["g"], "id", "t", "c", 0.7).where("id <> cluster").count() == 20
    assert _shuffled(spark) - before < 16 * words


def test_products(spark):
    known = [products.Product("Copilot", "Microsoft", "B4", (r"copilot",), 2023), products.Product("Gemini", "Google", "B4", (r"gemini",), None, r"\b(ai|model)\b")]
    df = spark.createDataFrame([("We deployed Copilot", 2024), ("We deployed Copilot", 2020), ("Gemini clinical trial", 2024), ("Gemini AI", 2024), ("Partnered with Anthropic", 2024), ("proprietary ML platform called DataBrain", 2024)], "t string, y int")
    got = [tuple(r["x"]) for r in products.with_products(df, "t", "y", known, [("Anthropic", "anthropic")], "proprietary ml", "x").collect()]
    assert got == [("Copilot", "Microsoft", "SPECIFIC"), (None, None, "CATEGORY_ONLY"), (None, None, "CATEGORY_ONLY"), ("Gemini", "Google", "SPECIFIC"), (None, "Anthropic", "VENDOR_ONLY"), ("DataBrain", "Internal", "INTERNAL")]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\ftwo")
    (tmp_path / "b.pdf").write_bytes(b"!")
    got = readers.extract_pages(readers.discover(spark, f"file://{tmp_path}"), lambda b: (b.decode().split("\f"), "valid") if len(b) > 1 else 1 / 0).orderBy("path").collect()
    assert [(r["status"], r["pages"]) for r in got] == [("valid", ["one", "two"]), ("error", [])]
    (tmp_path / "m.csv").write_text("﻿company,year,position,industry\nAcme,2020,#7,Tools\nacme,2021,8,More\n", encoding="utf-8")
    m = readers.read_company_metadata(spark, f"file://{tmp_path}/m.csv").collect()
    assert len(m) == 1 and (m[0]["key"], m[0]["position"], m[0]["industry"]) == ("acme", 8, "More")
    (tmp_path / "c.json").write_text(json.dumps({"a": 2, "zzz": 1}))
    assert readers.config({"a": 1, "b": 1}, str(tmp_path / "c.json"), b=3) == {"a": 2, "b": 3}
    df = spark.createDataFrame([(2020, "a"), (2021, "b")], "year int, t string")
    writers.write_years(df, f"file://{tmp_path}/y")
    writers.write_years(spark.createDataFrame([(2021, "c")], "year int, t string"), f"file://{tmp_path}/y")
    assert sorted(r["t"] for r in spark.read.parquet(f"file://{tmp_path}/y").collect()) == ["a", "c"]
    for path in writers.export_all(df, f"file://{tmp_path}/e", "x", ["csv", "json", "parquet"]):
        assert path
    assert writers.evolved(df, df.withColumn("new", F.lit(1))).columns == ["year", "t", "new"]
    assert readers.table_or_empty(spark, f"file://{tmp_path}/absent", "a int").count() == 0
    words = pd.DataFrame([(0, 40, 0, "left"), (60, 100, 0, "right"), (0, 40, 20, "below")], columns=["x0", "x1", "top", "text"])
    assert readers.columns_of_words(words, 100) == "left\nbelow\nright"
    assert readers.gold_fragments(spark.createDataFrame([("t",)], "text string")).first()["label"] == 1


def test_export_takes_all_references(spark):
    sf = "/root/testdata/sf0.001"
    got = catalogue.QUERIES["export_sheet"](spark, sf)
    assert got.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count() and got.where("company >= 20").count() > 0


def test_translation(spark):
    df = spark.createDataFrame([("hallo", "de"), ("", "de"), (None, "fr")], "t string, l string")

    def broken(text, lang):
        raise RuntimeError

    got = [(r["translation"], r["engine"]) for r in translate.translated(df, "t", "l", [("a", broken), ("b", lambda t, lang: t.upper())]).collect()]
    assert got == [("HALLO", "b"), ("", "none"), (None, "none")]


def test_joins_and_stores_with_nulls(spark):
    d = spark.createDataFrame([(1, "Acme Corp"), (2, "Beta Holding"), (3, ""), (4, None)], "id int, company string")
    m = spark.createDataFrame([("ACME corp", 5), ("Beta AG", 2), ("Beta Z", 9)], "name string, position int")
    got = {r["id"]: (r["name"], r["match"]) for r in relational.with_metadata(d, m).collect()}
    assert got == {1: ("ACME corp", "exact"), 2: ("Beta AG", "prefix"), 3: (None, "none"), 4: (None, "none")}
    e = spark.createDataFrame([("k", 1, None), ("k", 2, "b"), ("k", 3, None)], "k string, n int, v string")
    r = e.groupBy("k").agg(store.latest("v", "n").alias("l"), store.latest_known("v", "n").alias("lk"), store.first_filled("v", "n").alias("f")).first()
    assert (r["l"], r["lk"], r["f"]) == (None, "b", "b")


def test_backfill_takes_all_events(spark):
    sf = "/root/testdata/sf0.001"
    e = {r["event_id"]: r for r in spark.read.parquet(f"{sf}/events.parquet").collect()}
    latest = {(r["user_id"], r["event_type"]): r["props"] for _, r in sorted(e.items()) if r["props"] is not None}
    got = {r["event_id"]: r["props"] for r in catalogue.QUERIES["join_latest_backfill"](spark, sf).collect()}
    assert got == {i: r["props"] if i % 2 == 0 and r["props"] is not None else latest.get((r["user_id"], r["event_type"])) for i, r in e.items()}


def test_evaluation_guards_empty_ratios(spark):
    df = spark.createDataFrame([(0, 0)], "label int, predicted int")
    r = evaluate.confusion(df, "label", "predicted").first()
    assert (r["tn"], r["precision"], r["recall"], r["f1"], r["accuracy"]) == (1, 0.0, 0.0, 0.0, 1.0)


def test_coverage_has_totals(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "y")], "r string, c string")
    assert sorted(map(tuple, charts.coverage(df, "r", "c", ["x", "y"]).collect()), key=str) == [("a", 1, 0), ("b", 0, 1), (None, 1, 1)]


def test_detection_of_a_small_document(spark):
    import dataclasses

    from fathomline.operators import builtin, references
    from fathomline.operators.taxonomy import COOCCUR, Code, Taxonomy

    t = Taxonomy("t", (("A", (Code("A1", patterns=("fraud detection",)), Code("D1", patterns=("supplier portal",), gate=COOCCUR))), ("B", (Code("B4", keywords=(("chatgpt", 1),), patterns=("chatgpt",)),))), false_positives=(("art", ("claude monet",)),), hard_triggers=r"\b(ChatGPT|AI)\b", soft_triggers=r"\b(model|portal)\b", actors=("supplier",))
    pad = " We report on the year as a whole and on what we did in all our markets."
    pages = spark.createDataFrame([(1, 1, "We deployed ChatGPT for customer support." + pad * 2), (1, 2, "Claude Monet used an AI portal." + pad * 2), (1, 3, "Our fraud detection runs on AI." + pad * 2), (1, 4, "short AI"), (2, 1, "Nothing to see here." + pad * 3), (3, 1, "A supplier portal went live for AI."  + pad * 2)], "doc_id int, page int, page_text string")
    refs = references.with_sentiment(references.deduplicated(references.detect(pages, t, ["doc_id"]), ["doc_id"]))
    got = sorted((r["doc_id"], r["page"], r["text"], r["category"], r["method"], r["sentiment"]) for r in refs.collect())
    assert got == [(1, 1, "ChatGPT", "B4", "pattern_hard", "neutral"), (1, 3, "AI", "A1", "pattern_hard", "neutral"), (3, 1, "AI", "D1", "pattern_hard", "neutral")]
    r = refs.where("page = 1 and doc_id = 1").first()
    assert ">>>ChatGPT<<<" in r["context"] and json.loads(r["dimensions"]) == {"B": ["B4", "0.9"]}
    both = references.for_taxonomies(pages, [t, dataclasses.replace(t, name="u", anchors=("ChatGPT for customer support",))], ["doc_id"])
    assert {r["taxonomy"] for r in both.collect()} == {"t", "u"}


def test_document_language_takes_spaced_pages(spark):
    from fathomline.operators import builtin, references

    ja = "私たちは人工知能を導入しました。" * 3
    pages = spark.createDataFrame([(1, i, ja if i in (1, 3) else "plain words of a report page") for i in range(1, 12)] + [(2, 1, ja)], "doc_id int, page int, page_text string")
    assert {r["doc_id"]: r["language"] for r in references.document_language(pages, ["doc_id"]).collect()} == {1: "en", 2: "ja"}


def test_priority_terms(spark):
    from fathomline.operators import builtin, references

    r = one(spark, references.first_priority_term(F.col("t"), (r"\bgenerative ai\b", r"\bai\b")), t="Our AI and Generative AI")
    assert (r["term"], r["marked"]) == ("Generative AI", "Our AI and >>>Generative AI<<<")


def test_taxonomy_sheets_and_command_line(spark, tmp_path, capsys):
    from fathomline.__main__ import main

    assert main(["template", str(tmp_path)]) == 0
    t = taxonomy.read_sheets(str(tmp_path))
    assert t.name == "example" and t.codes()["A1"].patterns == (r"\bexample\b",) and not t.lower_case
    assert main(["queries"]) == 0
    assert "flagship_volume_rank" in capsys.readouterr().out


REPORTS = [
    (1, "Acme", 2020, "retail", "We use machine learning and predictive analytics for fraud detection across all of our stores, and we plan to invest in generative AI. " * 3 + "\f" + "Our chatbot, built on a large language model, improves customer service for millions of shoppers every single day of the year. " * 2),
    (2, "Acme", 2021, "retail", "The machine learning platform was deployed in logistics, where it is strong and successful, and we expect growth from it in the next year. " * 3),
    (3, "Beta", 2021, "energy", "An offshore platform and its automation were repaired in the summer, and the weather was fine on most of the days of that summer too. " * 3),
    (4, "Beta", 2020, "energy", "Deep learning and computer vision detect cracks in pipes; responsible AI and AI governance rules reduce the risk of failure in the field. " * 2),
]


def test_command_line_from_documents_to_curves(spark, tmp_path, capsys):
    from fathomline.__main__ import main

    store, docs = f"file://{tmp_path}/store", f"file://{tmp_path}/docs"
    frame = spark.createDataFrame(REPORTS, "doc_id long, company string, year int, industry string, text string")
    frame.where("doc_id < 4").write.parquet(docs)
    (tmp_path / "c.json").write_text('{"store": "%s", "unknown": 1}' % store)
    base = ["--config", str(tmp_path / "c.json")]
    assert main([*base, "ingest", docs]) == 0
    refs = spark.read.parquet(f"{store}/references")
    first = refs.count()
    assert first > 0 and {r["company"] for r in refs.collect()} == {"Acme"}
    frame.write.mode("append").parquet(docs)
    assert main([*base, "ingest", docs]) == 0  # what was read before is left out
    refs = spark.read.parquet(f"{store}/references")
    assert refs.count() > first and refs.groupBy("doc_id", "page", "window_no").count().where("count > 1").count() == 0
    for command in (["dedupe"], ["sentiment", "--governance"], ["index"], ["memory"], ["diffusion"], ["status"], ["export", f"file://{tmp_path}/out", "--format", "csv", "--format", "json"]):
        assert main([*base, *command]) == 0
    assert {r["sentiment"] for r in spark.read.parquet(f"{store}/references").collect()} <= {"positive", "neutral", "negative"}
    assert spark.read.parquet(f"{store}/indices").count() == 3 and spark.read.parquet(f"{store}/industries").count() == 3
    assert spark.read.csv(f"file://{tmp_path}/out/references_dedup.csv", header=True, multiLine=True).count() == spark.read.parquet(f"{store}/deduplicated").count()
    capsys.readouterr()
    assert main([*base, "config", "--store", "elsewhere"]) == 0
    assert '"store": "elsewhere"' in capsys.readouterr().out
    with pytest.raises(SystemExit, match="run memory first"):
        main([*base, "diffusion", "--store", f"file://{tmp_path}/none"])


def test_builtin_taxonomies(spark):
    from fathomline.operators import builtin

    for t in (builtin.AI, builtin.DIGITAL):
        assert t.checked()[1] == [] and rules.trigger_patterns(t)[0] in (vocabulary.AI_HARD, vocabulary.DIGITAL_HARD)
        assert taxonomy.by_name(t.name) is t
    df = spark.createDataFrame([("Our generative AI chatbot helps customer service",), ("A supplier portal connects partners",)], "window string")
    assert [r["combined"] for r in rules.classified(df, builtin.AI).collect()][0] == "A3_Customer_Experience|B4_GenAI_LLMs"
    assert rules.classified(df, builtin.DIGITAL).collect()[1]["code_D"] == "D1_Partner_Onboarding_Access"


def test_segmentation_parts_lines_without_spaces(spark):
    from fathomline.functions import segmentation

    counts = {"we": 50, "use": 40, "deep": 10, "learning": 12, "for": 60, "all": 30, "reports": 8, "a": 90, "in": 80}
    model = segmentation.Unigrams(counts)

    def best(text):  # every way to part it
        if not text:
            return [(0.0, [])]
        return [(s + model.of(text[:k]), [text[:k], *w]) for k in range(1, len(text) + 1) for s, w in [max(best(text[k:]))]]

    for t in ("weuse", "deeplearn", "forallin"):
        assert model.segment(t) == max(best(t))[1]
    page = "weusedeeplearningforallreports\nOpenAI,forallreportsweusedeeplearning\n  a line with spaces is as it was"
    got = one(spark, segmentation.segmented(model)(F.col("t")), t=page)
    assert got.split("\n") == ["we use deep learning for all reports", "OpenAI for all reports we use deep learning", "  a line with spaces is as it was"]
    assert one(spark, tx.repaired(F.col("t"), segmentation.segmented(model)), t="weusedeeplearningforallreports") == "we use deep learning for all reports"
    assert one(spark, segmentation.segmented(model)(F.col("t")), t=None) is None


def test_learned_segmentation_by_either_way(spark):
    from fathomline.functions import segmentation

    prose = "the quick brown fox jumps over the lazy dog and the dog sleeps"
    docs = spark.createDataFrame([(prose + "\n" + "nospaceshereatallinthislonglineoftext",), (prose.upper(),), (None,), ("",), ("one two",)], "text string")
    counts = segmentation.learned(docs)
    plain: dict = {}
    for line in (prose, prose, "one two"):
        for word in line.split():
            plain[word] = plain.get(word, 0) + 1
    assert {r["word"]: r["n"] for r in counts.collect()} == plain
    model, long = segmentation.Unigrams(plain), "thedogandthefox" * 700
    texts = ["thequickfox", "thequickfox", "thelazydogsleeps,ontwo", "OpenAI,thefox2dogs", "", "..", None, long, "\u00e9thefox", "xyzzy"]
    lines = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(texts)], "id long, line string, __l string")
    want = [None if t is None else segmentation.line_segmented(t, model, re.compile(tx.protected_pattern())) for t in texts]
    assert want[0] == "the quick fox" and want[4] == want[5] == "" and want[7].split()[:5] == ["the", "dog", "and", "the", "fox"]
    for most in (segmentation.MOST_BYTES, 0):
        got = segmentation.with_words(lines, "line", counts, most_bytes=most)
        assert got.columns == ["id", "line", "__l", "words"] and [r["words"] for r in got.orderBy("id").collect()] == want
    assert segmentation.with_words(lines.limit(0), "line", counts, most_bytes=0).count() == 0
    assert [r["words"] for r in segmentation.with_words(lines.where("id = 0"), "line", counts.limit(0)).collect()] == [" ".join("thequickfox")]


def test_arrays_of_lines_are_parted_by_either_way_with_few_words_shuffled(spark, monkeypatch):
    from fathomline.functions import segmentation

    monkeypatch.setattr(segmentation, "CHUNK_BYTES", 2000)
    rng = random.Random(3)
    known = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    rows = [(i, [rng.choice(known) + rng.choice(known) for _ in range(40)] + [None, ""]) for i in range(60)] + [(60, None), (61, []), (62, ["ab" * 30])]
    lines = spark.createDataFrame(rows, "id long, line array<string>").repartition(4).localCheckpoint()
    counts = spark.createDataFrame([(w, i + 1) for i, w in enumerate(dict.fromkeys(known))], "word string, n long").localCheckpoint()
    model = segmentation.Unigrams({r["word"]: r["n"] for r in counts.collect()})
    want = {i: x if x is None else [t if t is None else " ".join(model.segment(t)) for t in x] for i, x in rows}
    for most in (segmentation.MOST_BYTES, 0):
        before = _shuffled(spark)
        assert {r["id"]: r["words"] for r in segmentation.with_words(lines, "line", counts, most_bytes=most).collect()} == want
        # Every stretch of every line would be over half a million bytes.
        assert _shuffled(spark) - before < 500_000


def test_segmented_documents_equal_plain_python(spark, tmp_path):
    texts = {1: "We read the report. The board reads it too", 2: "reports of the board, and of a boardroom", 3: None, 4: "", 5: "a report\n" + "theboardreadsareportofareport", 6: "we", 7: "the \u00e9cole of the board " * 30}
    spark.createDataFrame([(i, t) for i, t in texts.items()], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    counts: dict = {}
    for t in texts.values():
        for line in (t or "").split("\n"):
            if len(line) < 20 or line.count(" ") / len(line) >= 0.05:
                for w in re.findall("[a-z0-9]+", line.lower()):
                    counts[w] = counts.get(w, 0) + (len(w) <= 24)
    total = sum(counts.values())

    def best(text):  # every way to part it, word by word
        if not text:
            return (0.0, 0, [])
        ways = []
        for k in range(max(0, len(text) - 24), len(text)):
            w = text[k:]
            p = math.log(counts[w] / total) if counts.get(w) else math.log(10.0 / total) - len(w) * math.log(10.0)
            score, _, parts = memo(text[:k])
            ways.append((score + p, k, [*parts, w]))
        return max(ways)

    memo = functools.cache(best)
    want = {}
    for i, t in texts.items():
        words = re.findall("[a-z0-9]+", (t or "").lower())
        pairs = [words[k : k + 2] for k in range(0, len(words), 2)]
        if pairs:
            found = [" ".join(memo("".join(p))[2]) for p in pairs]
            want[i] = (len(pairs), sum(f == " ".join(p) for f, p in zip(found, pairs, strict=True)), sum(len(f.split()) for f in found), min(found), max(found))
    got = {r["doc_id"]: tuple(r)[1:] for r in catalogue.QUERIES["txt_segmented"](spark, f"file://{tmp_path}").collect()}
    assert got == want


def test_lines_parted_together_equal_single_ones():
    import pyarrow as pa

    from fathomline.functions import segmentation, text

    r, protected = random.Random(4), re.compile(text.protected_pattern())
    for letters, longest in (("ab", 24), ("abcdefgh01", 24), ("abc", 5), ("ab", 30)):
        counts = {"".join(r.choice(letters) for _ in range(r.randrange(1, r.choice([4, 8, 26])))): r.randrange(1, 50) for _ in range(200)}
        model = segmentation.Unigrams(counts, longest)
        lines = ["".join(r.choice([*counts, "zz"]) for _ in range(r.randrange(1, 6)))[: r.randrange(1, 70)] for _ in range(500)]
        lines += ["", None, "Ab ab", "\u00e9a", "aB-ab ChatGPT ab", "chatgpt", "github", "1github22a", "a1github2", "xgithub", "a" * 200, *[t.lower() for t in text.PROTECTED_TERMS]]
        want = [None if x is None else segmentation.line_segmented(x, model, protected) for x in lines]
        together = segmentation._many(model)
        assert together(pa.array(lines, pa.string())).to_pylist() == want
        rows = pa.array([lines[:3], None, [], lines[3:], lines[495:505]], pa.list_(pa.string())).slice(1)
        assert segmentation._parted(rows, together).to_pylist() == [None, [], want[3:], want[495:505]]
    assert segmentation._many(segmentation.Unigrams({}))(pa.array(["abc", None], pa.string())).to_pylist() == ["a b c", None]


def test_one_document_by_itself_equals_the_run_over_all(spark):
    from fathomline.operators import builtin, references

    said = ["Our customers rely on machine learning for fraud detection in every market.", "We deployed ChatGPT for customer support automation last year.", "The board met twice and the weather was fine.", "A predictive model for demand forecasting uses deep learning on sales."]
    r = random.Random(3)
    texts = {k: [None if r.random() < 0.1 else " ".join(r.choice(said) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(2, 5))] for k in range(2)} | {2: []}
    pages = spark.createDataFrame([(k, i, t) for k, ps in texts.items() for i, t in enumerate(ps, 1)] + [(99, 1, said[1] * 3), (None, 1, said[1] * 3)], "doc long, page int, page_text string")
    fields = {k: {"company": f"c{k}", "year": 2020 + k, "sector": None if k == 1 else "s"} for k in texts}
    documents = spark.createDataFrame([(k, *f.values(), "further") for k, f in fields.items()] + [(0, "c9", 2030, "z", "repeated"), (None, "c", 1, "s", "null")], "doc long, company string, year int, sector string, page_text string")
    t = builtin.AI
    out = references.analysed(pages, documents, t, "doc")
    columns = [c for c in out.columns if c != "doc"]
    whole = sorted(((x["doc"], *[x[c] for c in columns]) for x in out.collect()), key=str)
    single = [(1, *[x[c] for c in columns]) for x in references.analysed_document(spark, texts[1], fields[1], t).collect()]
    assert single and [x for x in whole if x[0] == 1] == sorted(single, key=str) and {x[0] for x in whole} == {0, 1}
    assert {x[1 + columns.index("company")] for x in whole} <= {f"c{k}" for k in texts} and {x[1 + columns.index("country")] for x in whole} == {None}
    with pytest.raises(ValueError, match="unknown fields"):
        references.analysed_document(spark, [], {"colour": "red"}, t)


def test_years_covered_of_nothing_and_of_nulls(spark):
    from fathomline.operators import stats

    df = spark.createDataFrame([("a", 2001), ("a", 2001), ("b", 1999), (None, 2005), ("c", None)], "company string, year int")
    assert tuple(stats.years_covered(df).first()) == (2005, 1999, 3, 2, "1999,2001,2005")
    assert tuple(stats.years_covered(df.limit(0)).first()) == (None, None, 0, 0, "")


def test_surroundings_equal_plain_joins(spark):
    r = random.Random(5)
    rows = [(d, p, r.choice([None, "", "x", "ab\u00e9" * r.randrange(1, 9)]), f"{p}-{d}") for d in ("a", "b", None) for p in range(r.randrange(1, 30))] + [("a", 3, "same page", "z"), ("c", None, "alone", "q")]
    df = spark.createDataFrame(rows, "doc string, page int, page_text string, __s string").repartition(3)
    for radius in (0, 1, 4, 17, 500):
        got = {(x["doc"], x["page"], x["__s"]): (x["before"], x["after"]) for x in windows.with_surroundings(df, ["doc"], radius).collect()}
        for doc in ("a", "b", "c", None):
            mine = sorted((x for x in rows if x[0] == doc), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3]))
            for i, x in enumerate(mine):
                before, after = "".join((y[2] or "") + "\n" for y in mine[:i]), "".join("\n" + (y[2] or "") for y in mine[i + 1 :])
                assert got[doc, x[1], x[3]] == (before[len(before) - radius if len(before) > radius else 0 :], after[:radius])
        assert len(got) == len(rows)
    assert windows.with_surroundings(df.limit(0), ["doc"], 5).count() == 0


def test_json_document_is_read_line_by_line(spark, tmp_path):
    df = spark.createDataFrame([(i, "x,\n]}" if i % 2 else None) for i in range(9)], "id long, t string").repartition(3)
    for rows, n in ((df, 9), (df.limit(0), 0)):
        path = f"file://{tmp_path}/r{n}"
        writers.write_json_document(rows, path, {"title": "t"})
        meta, back = writers.read_json_document(spark, path, "id long, t string")
        assert meta == {"title": "t"} and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    with pytest.raises(ValueError, match="not one document"):
        writers.read_json_document(spark, path, "id long", name="other")
    for broken in (['{"meta": {}, "references": [', '{"id":1}', '{"id":2}', "]}"], ['{"meta": {}, "references": [', ',{"id":1}', "]}"], ['{"meta": {}, "references": [', '{"id":1}']):
        spark.createDataFrame([(x,) for x in broken], "value string").coalesce(1).write.mode("overwrite").text(f"file://{tmp_path}/broken")
        with pytest.raises(ValueError, match="not one document"):
            writers.read_json_document(spark, f"file://{tmp_path}/broken", "id long")
    shuffled = ['{"meta": {}, "references": [', ',{"id":2}', '{"id":1}', "]}"]
    spark.createDataFrame([(x,) for x in shuffled], "value string").coalesce(1).write.mode("overwrite").text(f"file://{tmp_path}/broken")
    with pytest.raises(ValueError, match="out of order"):
        writers.read_json_document(spark, f"file://{tmp_path}/broken", "id long")


def test_json_document_is_one_document(spark, tmp_path):
    import json

    df = spark.createDataFrame([(i, "x" if i % 2 else None, float("nan") if i == 3 else i / 2) for i in range(7)], "id long, t string, v double").repartition(3)
    for rows, n in ((df, 7), (df.limit(0), 0)):
        writers.write_json_document(rows, f"file://{tmp_path}/j{n}", {"title": "t"})
        parts = sorted((tmp_path / f"j{n}").glob("part-*"))
        found = json.loads("".join(p.read_text() for p in parts))
        assert found["meta"] == {"title": "t"} and len(found["references"]) == n
        assert all(r["v"] is None for r in found["references"] if r["id"] == 3) and all("t" in r for r in found["references"])


def test_documents_by_a_chain_of_readers(spark, tmp_path):
    files = [("a", b"long enough " * 9), ("b", b"broken"), ("c", b"scan"), ("d", b"dud"), ("e", b"mirror"), ("f", b""), ("g", b"half")]
    df = spark.createDataFrame([(p, bytearray(c)) for p, c in files], "path string, content binary")
    back = "noitcurtsnoC noillim and more of what is written " * 2

    def strict(raw):
        if raw.startswith((b"broken", b"half")):
            raise ValueError
        return {b"mirror": [back, back], b"scan": ["x"], b"dud": ["y"], b"": []}.get(raw, [raw.decode(), None])

    def lenient(raw):
        if raw == b"broken":
            raise ValueError
        return [back, "plain text " * 9]

    def ocr(raw):
        if raw == b"dud":
            raise ValueError
        return ["recognised"]

    got = {r["path"]: (r["text_status"], r["pages"]) for r in readers.extract_documents(df, [strict, lenient], ocr).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "valid", "b": "corrupted_ocr_failed", "c": "corrupted_ocr_success", "d": "corrupted_ocr_failed", "e": "mirrored_all_stripped", "f": "empty", "g": "valid"}
    assert got["g"][1] == ["", "plain text " * 9] and got["e"][1] == ["", ""] and got["a"][1][1] == "" and got["c"][1] == ["recognised"]
    assert all(callable(f) for f in readers.pdf_readers())


def test_sheets_are_read_by_spark_and_without_it(spark, tmp_path, monkeypatch):
    writers.taxonomy_template(str(tmp_path))
    by_spark = taxonomy.read_sheets(str(tmp_path))
    monkeypatch.setattr(taxonomy.SparkSession, "getActiveSession", staticmethod(lambda: None))
    assert taxonomy.read_sheets(str(tmp_path)) == by_spark and by_spark.name == "example" and by_spark.codes()["A1"].keywords == (("example word", 1),)


@pytest.mark.parametrize(("size", "overlap"), [(500, 100), (7, 0), (10, 9), (10, 6)])
def test_character_windows_of_any_overlap(spark, size, overlap):
    texts = ["x" * 19, "ab🎉é\n" * 9, "".join(chr(0x41 + i % 50) for i in range(1234)), None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "offset_ int, text string")
    got = sorted((r["offset_"], r["offset"], r["window"]) for r in windows.char_windows(df, "text", size, overlap).collect())
    assert got == sorted((i, k, t[k : k + size]) for i, t in enumerate(texts) if t and len(t) >= 20 for k in range(0, len(t), size - overlap))
    with pytest.raises(ValueError):
        windows.char_windows(df, "text", 5, 5)


def test_shuffle_files_of_kept_frames_go(spark):
    from fathomline.operators import lineage

    def files():
        manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", manager.getAllBlocks().mkString(" ")))

    before = files()
    keyed = spark.range(10_000).groupBy((F.col("id") % 1001).alias("k")).count()
    assert lineage.kept(keyed.join(keyed.withColumnRenamed("count", "n"), "k")).count() == 1001
    end = time.monotonic() + 20
    while files() - before and time.monotonic() < end:
        time.sleep(0.2)
    assert not files() - before


def test_no_year_within_a_number_of_a_name(spark):
    names = ["Supplier#000002016 - n.d. - proxy.pdf", "3. Firm 12023 - report.pdf", "Firm 20240131 - report.pdf", "Firm FY2019 report.pdf", "Firm#2023.pdf"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r[0] for r in df.select(readers.file_facts(F.col("name"))["year"]).collect()] == [0, 0, 2024, 2019, 2023]


def test_tables_that_are_folders_are_found_by_name(spark, tmp_path):
    for name in ("b", "a"):
        spark.range(5).repartition(2).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("d", "c"):
        spark.range(3).toPandas().to_parquet(f"{tmp_path}/{name}.parquet")
    got = {r["name"]: r["first"] for r in catalogue.QUERIES["src_discover"](spark, str(tmp_path)).collect()}
    assert got == {"a.parquet": True, "b.parquet": True, "c.parquet": True, "d.parquet": False}


def test_heaviest_contributions_have_one_order(spark):
    rows = [("c", 2020, "delta_b", k, p) for k in "xyz" for p in (-1.0, 1.0)] + [("c", 2020, "delta_a", "x", 2.0)]
    want = [("x", 2.0), *[(k, p) for k in "xyz" for p in (1.0, -1.0)]]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "company string, year int, component string, category string, points double")
        assert [(r["category"], r["points"]) for r in trajectory.contributions_of(df, "c", 2020).collect()] == want


def test_contributions_of_spans_are_those_of_stored_events(spark):
    from fathomline.plans import standins as st

    rng = random.Random(8)
    rows = [(i, rng.randrange(6), rng.choice((2010, 2011, 2013, 2014, 2016, 2019)), f"a{rng.randrange(3)}", f"b{rng.randrange(2)}", f"p{rng.randrange(4)}", None) for i in range(150)]
    r = spark.createDataFrame(rows, "ref_id long, company long, year int, category_a string, category_b string, product string, text string")
    stored = trajectory.contributions(st.adoption_events(r), st.portfolio_b(r), r.select("company", "year").distinct())
    cols = ["company", "year", "component", "category", "points"]
    want = sorted(map(tuple, stored.select(*cols).collect()))
    units, years = trajectory.spans(r), st.years(r)
    assert sorted(map(tuple, trajectory.listed_contributions(units, years).select(*cols).collect())) == want
    assert any(x[2] == "maturity" for x in want) and any(x[2] == "retirement_explicit" for x in want)
    sums = {}
    for c, y, k, _, p in want:
        n, total = sums.get((c, y, k), (0, 0.0))
        sums[c, y, k] = n + 1, total + p
    assert {(x[0], x[1], x[2]): (x[3], x[4]) for x in trajectory.year_contributions(units, years).select("company", "year", "component", "n", "points").collect()} == sums
