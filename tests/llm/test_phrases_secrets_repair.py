import hashlib
import heapq
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from fathomline.llm import collocations, conversation_repair, secrets

DOCS = "doc_id long, text string, lang string, phrase long, score string, bucket int"


# -- phrases -----------------------------------------------------------------


def plain_counts(rows, max_words=3):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, max_words + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    return f, n


def plain_collocations(rows, least=10, max_words=3, top=2000):
    f, n = plain_counts(rows, max_words)
    often = {k: c for k, c in f.items() if c >= least}
    inside = Counter()
    for (lang, g), c in often.items():
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                inside[lang, g[i : i + k]] = max(inside[lang, g[i : i + k]], c)
    found = {}
    for (lang, g), a in often.items():
        if len(g) < 2 or 100 * inside[lang, g] >= 50 * a:
            continue
        score, k = min((1000000 * a * a // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g)))
        found.setdefault(lang, []).append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return {(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, x in found.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:top])}


def test_collocations_equal_plain_counts(spark):
    r = random.Random(5)
    words = ["La", "le", "New", "York", "x", "ÀB", "é", "\U0001f600", "a-b"]
    rows = [("".join(r.choice(words) + r.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", " "]) for _ in range(r.randrange(120))), r.choice(["en", "fr", None, "und"])) for _ in range(150)]
    rows += [(None, "en"), ("", None), ("new york " * 4000, "en"), ("!!! \n", "xx"), ("word" * 5000, "xx")] + [("the same text again", "en")] * 12
    df = spark.createDataFrame([(i, t, lang, 1, "s", 2) for i, (t, lang) in enumerate(rows)], DOCS).repartition(5)
    for most, top in ((3, 2000), (2, 7), (4, 2000)):
        out = collocations.collocations(df, max_words=most, top=top)
        assert out.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        got = out.collect()
        assert len(got) == len({tuple(x) for x in got})
        assert {tuple(x) for x in got} == plain_collocations(rows, max_words=most, top=top)


def test_collocations_of_nothing(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).collect() == []
    assert collocations.collocations(spark.createDataFrame([(None, None, None, 1, "", 1)], DOCS)).collect() == []


@pytest.mark.parametrize("size", [8, 40, 300])
def test_slices_count_each_phrase_once(monkeypatch, size):
    monkeypatch.setattr(collocations, "SLICE", size)
    collocations._powers.clear()
    r = random.Random(size)
    texts = [" ".join(r.choice(["a", "bb", "ccccccccc", "d" * 90]) for _ in range(60)) + r.choice([".", "", " "]) for _ in range(8)] + [None, "", "a, b", " "]
    texts = [t or "" for t in texts]
    batch = pa.record_batch([pa.array(texts), pa.array(["en"] * len(texts))], names=["text", "lang"])
    everything = [np.full((2, 1 << 17), 255, np.uint8)] * 3
    f, n = Counter(), 0
    for part in collocations._slices(iter([batch]), 2):
        for got in collocations._counted(part, everything):
            for key, c in zip(got["key"].to_pylist(), got["f"].to_pylist(), strict=True):
                lang, phrase = key.split("\n")
                n += 0 if phrase else c
                if phrase:
                    f[(lang, tuple(phrase.split(" ")))] += c
    want, total = plain_counts([(t, "en") for t in texts])
    collocations._powers.clear()
    assert f == want and n == total["en"]


def test_narrow_sketch_loses_nothing(spark):
    r = random.Random(9)
    rows = [(" ".join(f"w{int(r.paretovariate(0.7)) % 500}" for _ in range(300)), "en") for _ in range(40)]
    df = spark.createDataFrame([(i, t, lang, 1, "s", 2) for i, (t, lang) in enumerate(rows)], DOCS)
    f, _ = plain_counts(rows)
    got = {(x["lang"], tuple(x["phrase"].split(" "))): x["f"] for x in collocations.phrase_counts(df, width=16).where("words > 0").collect()}
    assert got == {k: c for k, c in f.items() if c >= 10}


def test_scores_pass_64_bits(spark):
    rows = [("en", 0, "", 10**15), ("en", 1, "a", 3 * 10**12 + 1), ("en", 1, "b", 2 * 10**12), ("en", 2, "a b", 10**12 + 7)]
    got = collocations.scored(spark.createDataFrame(rows, "lang string, words int, phrase string, f long")).collect()
    assert [x["score"] for x in got] == [1000000 * (10**12 + 7) ** 2 // ((3 * 10**12 + 1) * 2 * 10**12)]


# -- secrets -----------------------------------------------------------------

PLAIN = (
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def plain_base(text):
    out = [(m.start(), i, f"{k}:{m.start()}:{m.end()}") for i, (k, p, g, least) in enumerate(PLAIN) for m in p.finditer(text or "") if len(m[g]) >= least]
    return [x[2] for x in sorted(out)]


def test_base_spans_equal_plain_search(spark):
    r = random.Random(2)
    parts = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "apıkey", "toKen", " ", ":", "=", '"', "'", "abc", "abcdef", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "deadbeefdeadbeef", "\U0001f600", "é", "\n", ".", "-"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(400)]
    texts += [None, "", "secret=token: abcdefgh", "token==ab cdefgh", "\U0001f600" * 50 + "token=abcdef", "token=abcdef " * 300, "AKIA" + "A" * 15, "AKIA" + "A" * 16, "f" * 23, "f" * 24, "a" * 3000, "password: password: password"]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, spans string, __mh int")
    got = {x["doc_id"]: x for x in secrets.scan_digest(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain_base(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), t
        assert [got[i][f"n_{k}"] for k, *_ in PLAIN] == [sum(x.startswith(k + ":") for x in want) for k, *_ in PLAIN]
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("random:")] == want
    assert secrets.scan(df, [0] * 128 * 128).columns == ["doc_id", "text", "__mh", "spans"]


def test_scan_of_nothing_and_repeated_rows(spark):
    schema = "doc_id long, text string"
    assert secrets.scan_digest(spark.createDataFrame([], schema)).collect() == []
    got = secrets.scan_digest(spark.createDataFrame([(1, "token=abcdef"), (1, "token=abcdef"), (None, None)], schema)).collect()
    assert sorted((x["doc_id"] or 0, x["n_assign"], x["spans"]) for x in got) == [(0, 0, ""), (1, 1, "assign:0:12"), (1, 1, "assign:0:12")]


def plain_model(samples):
    pairs, firsts = Counter(), Counter()
    for value, secret in samples:
        codes = [0, *value.encode()]
        for a, b in zip(codes, codes[1:], strict=False):
            pairs[secret, a, b] += 1
            firsts[secret, a] += 1
    return lambda v: sum(np.log((pairs[True, a, b] + 1) / (firsts[True, a] + 64)) - np.log((pairs[False, a, b] + 1) / (firsts[False, a] + 64)) for a, b in zip([0, *v.encode()], v.encode(), strict=False))


def test_models_tell_random_strings_from_identifiers(spark):
    r = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    syllables = ["get", "set", "data", "user", "_id", "index", "List", "Map", "value", "To", "2", "Stream", "read", "er", "tion", "con", "64", "Key"]
    made = [("".join(r.choice(letters) for _ in range(r.randrange(16, 40))), True) for _ in range(600)]
    made += [("".join(r.choice(syllables) for _ in range(r.randrange(4, 9))), False) for _ in range(600)]
    r.shuffle(made)
    train, held = made[:800], made[800:]
    model = secrets.fit(spark.createDataFrame([*train, (None, True), ("x", None), ("é", False)], "value string, secret boolean"))
    plain = plain_model(train)
    rows = spark.createDataFrame(held, "value string, secret boolean")
    got = rows.select("value", "secret", secrets.ratio(rows["value"], model).alias("r")).collect()
    for x in got:
        assert abs(x["r"] / 1000 - plain(x["value"])) < 0.001 * (len(x["value"]) + 1)
    right = sum((x["r"] >= secrets.LEAST_TOTAL and x["r"] >= secrets.LEAST_EACH * len(x["value"])) == x["secret"] for x in got)
    assert right / len(got) > 0.97
    text = f"call {held[0][0]} and key {'q7Zk2Xv9Lw4Tn8Rb3Yc6'} here"
    spans = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first()["spans"]
    assert any(text[s["start"] : s["end"]] == "q7Zk2Xv9Lw4Tn8Rb3Yc6" == s["value"] for s in spans)


def test_models_without_samples_find_nothing(spark):
    empty = secrets.fit(spark.createDataFrame([], "value string, secret boolean"))
    assert set(empty) == {0}
    assert secrets.scan(spark.createDataFrame([(1, "q7Zk2Xv9Lw4Tn8Rb3Yc6")], "doc_id long, text string"), empty).first()["spans"] == []


# -- conversations -----------------------------------------------------------


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def plain_repair(rows):
    """By a search over all edits in the order of cost, then of the list of edits."""
    rows = sorted(rows, key=lambda x: (x[1] is not None, x[1] or 0, x[2], x[3]))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]+", "", text)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, said, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", said):
            break
        if (i, said) in done:
            continue
        done.add((i, said))
        ok = lambda x: re.fullmatch("s?(ua)*u?", x)
        if i < len(rows):
            role, text, fault = rows[i][2], rows[i][3], faults[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, said, out))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                for edit, price, to in (("K", 0, role), ("R", 1, "user"), ("R", 1, "assistant")):
                    if to[:1] and ok(said + to[:1]):
                        heapq.heappush(heap, (cost + price + more, audit + edit, i + 1, said + to[:1], (*out, f"{to}:{text}")))
        for to in ("user", "assistant"):
            if ok(said + to[0]):
                heapq.heappush(heap, (cost + 5, audit + "I", i, said + to[0], (*out, f"{to}:")))
    turns = [x[1] for x in rows if x[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    first = [x[2][:1] for x in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:], strict=False))
    return (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


TURNS = "conv_id long, turn long, role string, text string, place long, edit string, __m int"


def test_repair_equals_search_over_all_edits(spark):
    r = random.Random(8)
    rows = []
    for conv in [*range(150), None]:
        for turn in [*range(r.randrange(0, 8)), *[None] * (r.random() < 0.1)]:
            for _ in range(1 + (r.random() < 0.1)):
                role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
                rows.append((conv, turn * r.choice([1, 1, 2]) if turn is not None else None, role, r.choice(["Yes.", "No!", "cut off", " \n", "", None, "Yes.", "é? \t", " "])))
    df = spark.createDataFrame([(*x, 1, "E", 2) for x in rows], TURNS).repartition(3)
    got = {x["conv_id"]: tuple(x)[1:] for x in conversation_repair.repair_report(df).collect()}
    assert set(got) == {x[0] for x in rows}
    left = plain_damage(rows)
    for conv in got:
        assert got[conv] == plain_repair([x for x in left if x[0] == conv]), conv


def test_repair_without_damage_and_of_nothing(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "There."), (2, 0, "assistant", "x"), (3, 0, "system", "s."), (3, 1, "user", "u."), (3, 2, "assistant", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = [(x["conv_id"], x["place"], x["edit"], x["was"], x["role"], x["text"], x["cost"]) for x in conversation_repair.repaired(df).orderBy("conv_id", "place").collect()]
    assert got[:2] == [(1, 0, "K", "user", "user", "Hi.", 0), (1, 1, "R", "user", "assistant", "There.", 1)]
    assert got[2:] == [(2, 0, "D", "assistant", "assistant", "x", 2), (3, 0, "K", "system", "system", "s.", 0), (3, 1, "K", "user", "user", "u.", 0), (3, 2, "K", "assistant", "assistant", "a.", 0)]
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.repair_report(empty).collect() == [] == conversation_repair.repaired(empty).collect()


def test_long_conversation(spark):
    n = 30_000
    df = spark.range(n).selectExpr("5L as conv_id", "id as turn", "case when id % 2 = 0 then 'user' else 'assistant' end as role", "concat('t', id % 7000, '.') as text")
    x = conversation_repair.repair_digest(conversation_repair.repaired(df)).first()
    assert (x["duplicate"], x["gaps"], x["illegal"]) == (n - 7000, 0, 0)
    assert x["audit"] == "K" * 7000 + "D" * (n - 7000) and x["cost"] == 2 * (n - 7000)
