"""Quality rules, mixing, tokens, packing, chat, language id, token counts."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fathomline.llm import chat, language_id, mixing, packing, quality_rules, token_counts, token_files
from fathomline.llm.tokens import default_tokenizer, encoder, encoded

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string"


def sample(n=120, seed=1):
    rng = random.Random(seed)
    vocab = ["the", "of", "Wort", "été", "naïve", "a,b", "x|y", "##", "漢字", "don't", "I'm", "🎉", "WORD"] + ["w%d" % i for i in range(30)]
    out = []
    for i in range(n):
        k = rng.choice([0, 1, 2, 3, 10, 60, 200])
        sep = rng.choice([" ", " ", "\n", "  ", "\t", " \n", "\xa0"])
        out.append((i, sep.join(rng.choice(vocab) for _ in range(k)), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "ü", None])))
    return out + [(n, None, "en", "a"), (n + 1, "", None, None), (None, "null id here", "en", "b"), (3, "repeated id", "en", "a"), (3, "repeated id", "en", "a"), (n + 2, "long " * 20000, "en", "c"), (n + 3, "same line\nsame line\n\nsame line", "en", "b")]


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash")).withColumn("size", F.lit(-1)).repartition(3)


def base_measures(text):
    w = WORD.findall(text or "")
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {p + k for v in grams.values() if len(v) > 1 for p in v for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed


def test_quality_base_columns(spark):
    rows = sample()
    got = quality_rules.apply_rules(frame(spark, rows)).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:7] == base_measures(r["text"]), r["text"]
        assert not (r["base_failed"] and r["kept"])


def test_quality_measures_do_not_depend_on_the_hash_or_on_names(spark):
    rows = sample(60, 9) + [(900, "a b c x a b c y b c z " * 9, "en", "a"), (901, " ".join(random.Random(3).choice("pqr") * random.Random(4).randrange(1, 3) for _ in range(40)), "en", "a")]
    df = frame(spark, rows)
    for c in ("__t", "__w", "__l", "__n", "__s", "__r", "__m", "__mt", "kept", "broken"):
        df = df.withColumn(c, F.lit("clash"))
    want = sorted(base_measures(t)[4] for _, t, *_ in rows)
    for hashed in ("xxhash64", "crc_of_nothing"):
        expr = "xxhash64" if hashed == "xxhash64" else "0L * hash"  # all windows meet
        assert sorted(r["n_repeat_words"] for r in quality_rules.text_measures(df, hashed=expr).collect()) == want
    got = quality_rules.apply_rules(df)
    assert {"__t", "__mt", "__r"} <= set(got.columns) and got.select("__t", "__mt").distinct().collect() == [("clash", "clash")]
    assert quality_rules.kept_documents(df).columns == df.columns


def test_quality_leaves_stop_words_of_other_alphabets_alone(spark):
    words = "река берег окно письмо город зима дорога сад капитан бумага вечер утро".split()
    text = " ".join(random.Random(7).choice(words) + str(i) for i in range(80))
    r = quality_rules.apply_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r["kept"] and r["n_listed_words"] == 0 and r["n_words"] == 80


def test_quality_keeps_prose_and_drops_junk(spark):
    rng = random.Random(2)
    stop, other = ["the", "of", "and", "to", "in", "is"], ["harbour", "winter", "letter", "window", "garden", "river", "summer", "paper", "captain", "market"]
    prose = " ".join(rng.choice(stop if rng.random() < 0.4 else other) for _ in range(200))
    junk = ["$$$ ### *** " * 40, "BUY NOW CHEAP! " * 30, "".join(rng.choice("xyzq") for _ in range(3000)), " ".join(rng.choice(other) for _ in range(300)), "the " * 20]
    df = spark.createDataFrame([(0, prose), *((i + 1, t) for i, t in enumerate(junk))], "doc_id long, text string").withColumn("kept", F.lit("mine"))
    out = quality_rules.kept_documents(df)
    assert [r["doc_id"] for r in out.collect()] == [0] and out.columns == df.columns
    assert quality_rules.kept_documents(df.limit(0)).count() == 0


def brute_targets(sizes, weights, cap):
    total, fixed = sum(sizes), {}
    while True:
        free = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = [i for i in free if share[i] > cap * sizes[i]]
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= {i: cap * sizes[i] for i in over}


def test_mixing(spark):
    rows = sample(400, 5)
    df = frame(spark, rows)
    spec = mixing.MixSpec(block_words=16, shards=20, bucket_rows=30)
    got = mixing.mixed_sizes(df, spec).toPandas()
    again = mixing.mixed_sizes(df.repartition(2), spec).toPandas()
    key = ["doc_id", "source", "size", "taken"]
    assert got[key].sort_values(key).values.tolist().__repr__() == again[key].sort_values(key).values.tolist().__repr__()
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3), strict=True))
    assert len(got) == len(rows) and (got["taken"] <= 3 * got["size"]).all()
    for s in order:
        part = got[got["source"].isna()] if s is None else got[got["source"] == s]
        assert (part["source_size"] == sizes[s]).all() and np.allclose(part["target"], want[s])
        assert abs(part["taken"].sum() - want[s]) <= 0.02 * want[s] + 3 * 16
    assert mixing.mixed_sizes(df.limit(0), spec).count() == 0


def test_mixing_any_number_of_sources(spark):
    rows = [(i, "w " * (1 + i % 40), "en", f"s{i % 900:04d}" if i % 901 else None) for i in range(3000)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + len(t.split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, brute_targets([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3), strict=True))
    spec = mixing.MixSpec(block_words=4, shards=7, group_sources=50, sent_sources=10, run_slots=8)
    got = mixing.mixed_sizes(df, spec).toPandas()
    by = got.groupby("source", dropna=False).agg(target=("target", "first"), taken=("taken", "sum"))
    assert len(got) == 3000 and (got["taken"] <= 3 * got["size"]).all()
    for s, r in zip([None if x != x else x for x in by.index], by.itertuples(), strict=True):
        assert np.isclose(r.target, want[s]) and r.taken <= 3 * sizes[s]
    assert abs(by["taken"].sum() - sum(sizes.values())) < 0.03 * sum(sizes.values())
    for w in (5, 2, 1):
        of = [s for i, s in enumerate(order) if (5, 2, 1)[i % 3] == w]
        assert abs(sum(by["taken"][by.index.isna() if s is None else by.index == s].sum() for s in of) / sum(want[s] for s in of) - 1) < 0.05


def test_draws_add_up_and_keep_to_what_there_is():
    owed, most = np.array([50.5, 30.0, 0.0, 3.5]), np.array([51, 90, 9, 3])
    wanted = mixing.shard_slots(84, 5)
    out = mixing.draw_shards(owed, most, wanted, 1)
    assert out.sum(1).tolist() == wanted.tolist() and wanted.sum() == 84 and (out.sum(0) <= most).all()
    assert abs(out.sum(0) - owed).max() <= 8


def test_mixed_documents_hold_the_words_that_are_taken(spark):
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(random.Random(i).choice([0, 1, 7, 40, 100]))), "en", "ab"[i % 2]) for i in range(60)]
    rows += [(60, "twin text", "en", "a"), (60, "twin text", "en", "a")]
    df = frame(spark, rows)
    spec = mixing.MixSpec(block_words=8, shards=5)
    taken = {}
    for r in mixing.mixed_sizes(df, spec).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    out = mixing.mixed_documents(df, spec)
    assert out.columns == df.columns
    found = {}
    text = dict((r[0], r[1]) for r in rows)
    for r in out.collect():
        words = WORD.findall(r["text"])
        found[r["doc_id"]] = found.get(r["doc_id"], 0) + len(words)
        assert set(words) <= set(WORD.findall(text[r["doc_id"]])) and len(words) == len(set(words)) or r["doc_id"] == 60
    assert found == {k: v for k, v in taken.items() if v}


def test_permutations_are_permutations():
    for n in (1, 2, 3, 10, 257):
        for key in (0, 1, 99):
            got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(got.tolist()) == list(range(n))
    assert mixing.permuted(np.arange(50), np.full(50, 50), np.full(50, 1)).tolist() != list(range(50))


def test_word_encoder_equals_the_library():
    rng = random.Random(4)
    parts = ["a", "B", " ", "\n", " 's", "'s", "'ll", "é", "1", "23", "!", "..", ",", "\t", "\xa0", "\x1c", "漢", "<|endoftext|>", "\x85", "  ", "\r\n", "🎉", "I'm", "word", "ſ", "́"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)] + ["", "plain words here, and there.\nNext line"]
    texts += ["hello <|endoftext|> x", "a<|endoftext|>b c", "one <|endoftext|>\ntwo <|endoftext", "<|endoftext|>" * 3]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoded(default_tokenizer(), iter(texts))] == whole_ids(texts)
    assert 50256 in whole_ids(texts[-4:-3])[0]


def test_other_kinds_of_tokenizers_encode_whole_texts():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["Plain words here, and there.\nNext line", "", "A  B"]
    assert not encoder(path).by_word and encoder(default_tokenizer()).by_word
    assert [np.frombuffer(encoder(path).encode(t), "<u4").tolist() for t in texts] == [Tokenizer.from_file(path).encode(t, add_special_tokens=False).ids for t in texts]


def whole_ids(texts):
    """By the library alone, as an object of its own."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(default_tokenizer())
    return [lib.encode(t or "", add_special_tokens=False).ids + [0] for t in texts]


@pytest.mark.parametrize("frame_ids", [1 << 20, 50])
def test_token_files_round_trip(spark, tmp_path, frame_ids):
    rows = [r for r in sample() if r[0] != 3] + [(3, "repeated id", "en", "a")] * 2 + [(3, "another", "en", "a")]
    path = f"file://{tmp_path}/t"
    token_files.write_tokens(frame(spark, rows), path, frame_ids=frame_ids)
    got = sorted((tuple(r) for r in token_files.read_tokens(spark, path).collect()), key=lambda r: r[1])
    assert sorted(got, key=lambda r: (r[0] is not None, r[0] or 0, r[1])) == got and len(got) == len(rows)
    at, want = 0, sorted((str(i), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, *_), x in zip(rows, whole_ids([r[1] for r in rows]), strict=True))
    assert sorted((str(d), n, c) for d, _, n, c in got) == want
    for _, start, n, _ in got:
        assert start == at
        at += n


def test_token_files_go_once_they_are_read(spark, tmp_path):
    from pathlib import Path

    from fathomline.llm.shared import shared_dir

    rows = frame(spark, sample(20))
    kept = token_files.token_files(rows, path=f"file://{tmp_path}/mine")
    gone = token_files.token_files(rows)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(map(tuple, gone.collect()), key=str) and (tmp_path / "mine").exists()
    assert not list(Path(shared_dir(spark).removeprefix("file:")).glob("tokens-*"))


def test_token_files_of_nothing(spark, tmp_path):
    token_files.write_tokens(frame(spark, sample()).limit(0), f"file://{tmp_path}/t")
    assert token_files.read_tokens(spark, f"file://{tmp_path}/t").count() == 0


def test_pack_and_unpack():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 1 << 32, 1000, dtype=np.uint32), rng.zipf(1.3, 70000).astype(np.uint32), np.zeros(3, np.uint32), np.arange(70001, dtype=np.uint32)):
        assert (token_files.unpack(len(ids), *token_files.pack(ids)) == ids).all()


def test_packing(spark):
    rows = sample(300, 8)
    got = packing.pack_documents(frame(spark, rows)).toPandas()
    ids = whole_ids([r[1] for r in rows])
    assert sorted((str(d), n) for d, n in {(r[0], len(x)) for r, x in zip(rows, ids, strict=True)}) == sorted((str(None if pd.isna(d) else int(d)), n) for d, n in set(zip(got["doc_id"].astype(object), got["doc_tokens"], strict=True)))
    want = sorted(zlib.crc32(np.array(x[a : a + n], "<u4").tobytes()) for x in ids for a, n in zip(np.cumsum([0, *packing.cut_lengths(len(x))[:-1]]).tolist(), packing.cut_lengths(len(x)), strict=True))
    assert sorted(got["ids_crc32"]) == want and got["length"].sum() == sum(map(len, ids))
    lengths = []
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() and s["length"].sum() <= 1024
        lengths.append(int(s["length"].sum()))
    assert sorted(got["sequence_id"].unique()) == list(range(len(lengths)))
    padded = sum(n if n & (n - 1) == 0 else 1024 for n in lengths)
    assert padded <= 1.02 * sum(lengths) + 1024
    assert packing.pack_documents(frame(spark, rows).limit(0)).count() == 0


def test_shortest_pack_first_uses_up_the_histogram():
    rng = random.Random(1)
    for _ in range(30):
        h = {n: rng.randrange(1, 1000) for n in rng.sample(range(1, 101), rng.randrange(1, 40))}
        used = {}
        patterns = packing.shortest_pack_first(h, 100)
        for p in patterns:
            assert sum(p.lengths) <= 100 and p.count > 0
            for n in p.lengths:
                used[n] = used.get(n, 0) + p.count
        assert used == h and len(patterns) < 40 * len(h)


def test_chat_round_trip(spark):
    rng = random.Random(6)
    parts = [*chat.CONTROL, "\\", "\\\\", "<", "<|", "|>", "[", "/", "a", "é", "\n", " ", "<<s>", "<|turn<|turn|>", "$1", "[[INST]"]
    turns = [(i % 7 if i % 11 else None, i // 7, rng.choice(["user", "assistant", "system", None, "odd<|text|>\nrole"]), "".join(rng.choice(parts) for _ in range(rng.randrange(9)))) for i in range(400)]
    turns += [(3, None, "user", "first"), (3, 2, "assistant", None), (3, 2, "assistant", None), (8, 0, "user", "x" * 100000)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash")).repartition(3)
    formatted = chat.format_turns(df)
    for r in formatted.collect():
        inner = r["formatted"][len(chat.TURN) : -len(chat.END) - 1]
        assert inner.count(chat.BODY) == 1 and not any(c in inner.replace(chat.BODY, "", 1) for c in chat.CONTROL)
    got = {r["conv_id"]: r for r in chat.digest_segments(formatted).collect()}
    by = {}
    for c, t, role, text in turns:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    for c, rows in by.items():
        rows.sort()
        loss = "".join(x for _, _, r, x in rows if r == "assistant")
        assert got[c]["n_turns"] == len(rows)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest_segments(chat.format_turns(df.limit(0))).count() == 0


def test_layouts(spark):
    rows = [
        (1, '{"prompt": "p", "response": "r"}'), (2, '{"messages": [{"role": "system", "content": "s"}, {"content": "c", "role": "user"}]}'), (3, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": null}]}'),
        (4, '{"output": "o", "instruction": "i", "input": ""}'), (5, '{"output": "o", "instruction": "i", "input": "n"}'), (6, "not json"), (7, None), (8, "[1]"), (9, '{"other": 1}'), (10, '{"completion": "c", "prompt": "p"}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = sorted(tuple(r) for r in chat.canonical_turns(df).collect())
    assert got == [(1, 0, "user", "p"), (1, 1, "assistant", "r"), (2, 0, "system", "s"), (2, 1, "user", "c"), (3, 0, "user", "h"), (3, 1, "assistant", ""), (4, 0, "user", "i"), (4, 1, "assistant", "o"), (5, 0, "user", "i\n\nn"), (5, 1, "assistant", "o"), (10, 0, "user", "p"), (10, 1, "assistant", "c")]
    assert sorted(r["conv_id"] for r in chat.unmapped(df).collect()) == [6, 7, 8, 9]


def test_layouts_ignore_other_fields_and_take_rows(spark):
    rows = [
        (1, '{"id": 7, "prompt": "p", "response": "r"}'), (2, '{"messages": [{"role": "user", "content": "c", "name": "n"}], "meta": {"a": [1]}}'), (3, '{"turn": 4, "role": "user", "text": "t", "extra": null}'),
        (4, '{"messages": [{"role": "user", "content": [{"text": "x"}]}, {"role": "user", "content": "c"}]}'), (5, '{"messages": ["x", {"role": "user", "content": "c"}]}'), (6, '{"output": "o", "instruction": "i", "input": "n", "id": 1}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    got = sorted(tuple(r) for r in chat.canonical_turns(df).collect())
    assert got == [(1, 0, "user", "p"), (1, 1, "assistant", "r"), (2, 0, "user", "c"), (3, 4, "user", "t"), (6, 0, "user", "i\n\nn"), (6, 1, "assistant", "o")]
    assert sorted(r["conv_id"] for r in chat.unmapped(df).collect()) == [4, 5]
    table = spark.createDataFrame([(1, 0, "human", "t", "x"), (None, None, None, None, None)], "conv_id long, turn int, role string, text string, more string")
    assert sorted(map(tuple, chat.table_turns(table).collect()), key=str) == [(1, 0, "human", "t"), (None, None, None, None)]
    other = chat.Layout("said", ("n", "who", "said"), role="who", text="said", turn="n", roles=(("human", "user"),))
    renamed = table.toDF("conv_id", "n", "who", "said", "more")
    assert {tuple(r) for r in chat.table_turns(renamed, (*chat.LAYOUTS, other)).collect()} == {(1, 0, "user", "t"), (None, None, None, None)}
    with pytest.raises(ValueError, match="no layout"):
        chat.table_turns(renamed)


def test_hostile_records(spark):
    deep = '{"messages": ' + "[" * 5000 + "]" * 5000 + "}"
    rows = [
        (1, '{"messages":[{"role":"user","content":5}, {"role":null,"content":true}]}'), (2, deep), (3, '{"prompt": "a\\ud800b", "response": "\\ud83c\\udf89"}'), (4, '{"messages": []}'), (5, '{"messages": [null]}'),
        (6, '{"messages": {}}'), (7, '{"prompt": {}, "response": "r"}'), (8, '{"messages": [], "conversations": [{"from": "human", "value": "h"}]}'), (9, '{"turn": 9223372036854775807, "role": "user", "text": "x"}'), (9, '{"turn": true, "role": 1.5, "text": ""}'),
        (None, '{"prompt": "p", "response": ""}'), (10, "{}"), (11, ""), (12, '{"prompt": "' + "x" * 300000 + '", "response": [1]}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, record string").withColumn("fingerprint", F.lit("clash")).withColumn("turn", F.lit("clash"))
    got = sorted(map(tuple, chat.canonical_turns(df).collect()), key=str)
    assert got == sorted([(1, 0, "user", "5"), (1, 1, "", "true"), (3, 0, "user", "a\ufffdb"), (3, 1, "assistant", "🎉"), (8, 0, "user", "h"), (9, 2**63 - 1, "user", "x"), (9, None, "1.5", ""), (None, 0, "user", "p"), (None, 1, "assistant", "")], key=str)
    assert sorted(r["conv_id"] for r in chat.unmapped(df).collect()) == [2, 5, 6, 7, 10, 11, 12]
    assert chat.canonical_turns(df.limit(0)).count() == 0 and chat.unmapped(df.limit(0)).count() == 0


def test_digests_read_joined_texts(spark, monkeypatch):
    turns = [("user", "a<|end|>\nb"), ("x<|turn|>", "\\"), ("assistant", "</s><|text|>")]
    segments = ["".join([chat.TURN, e(r), chat.BODY, e(t), chat.END, "\n"]) for r, t in turns for e in [lambda s: spark.range(1).select(chat.escaped(F.lit(s))).first()[0]]]
    text = "".join(segments)
    assert [(r, t) for r, t, *_ in chat.parse_text(text)[0]] == turns
    with pytest.raises(ValueError):
        chat.parse_text(text + "more")
    monkeypatch.setattr(chat, "JOIN_CHARS", 1)
    one, many = chat._Digest(), chat._Digest()
    mask = [x[2:] for x in chat.parse_text(text)[0] if x[0] == "assistant"]
    one.read(text, mask)
    for s in segments:
        many.read(s, [(a, b) for r, _, a, b in chat.parse_text(s)[0] if r == "assistant"])
    assert (one.said.hexdigest(), one.loss.hexdigest(), one.turns, one.chars) == (many.said.hexdigest(), many.loss.hexdigest(), 3, len(text))


def test_language_id(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**9, None, "xx"), (10**9 + 1, "", "xx"), (10**9 + 2, "123 !?", None), (None, "the of and", None)], "doc_id long, text string, lang string")
    both = docs.union(odd).withColumn("score", F.lit("clash"))
    model = language_id.fit_sample(both)
    assert model.languages == ["de", "en", "es", "fr"]
    got = language_id.identify(both, model).withColumn("held", language_id.held_out(F.col("doc_id"))).toPandas()
    assert len(got) == both.count() and got["score"].between(0, 1).all()
    assert got.loc[got["doc_id"] >= 10**9, "lang_pred"].tolist() == ["und"] * 3
    held = got[got["held"] & got["lang"].notna() & (got["doc_id"] < 10**9)]
    assert all((zlib.crc32(str(int(d)).encode()) % 4 == 2) == h for d, h in zip(got["doc_id"].fillna(0), got["held"], strict=True) if d == d)
    assert (held["lang"] == held["lang_pred"]).mean() > 0.95
    assert language_id.identify(both.limit(0), model).count() == 0
    twice = language_id.identify(both.limit(3).union(both.limit(3)), model).collect()
    assert sorted(map(str, twice[:3])) == sorted(map(str, twice[3:]))
    empty = language_id.fit_sample(both.limit(0))
    assert language_id.identify(both.limit(5), empty).select("lang_pred").distinct().collect()[0][0] == "und"


def test_all_languages_are_learned(spark):
    rng = random.Random(11)
    alphabets = [[chr(0x61 + (7 * k + j) % 26) + chr(0x3B1 + k % 20) for j in range(4)] + [f"q{k}"] for k in range(260)]
    rows = [(260 * j + k, " ".join(rng.choice(alphabets[k]) for _ in range(30)), f"l{k}") for k in range(260) for j in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("__p", F.lit("clash"))
    model = language_id.fit_sample(docs, language_id.FitSpec(max_cells=1 << 20))
    assert len(model.languages) == 260 and model.bits == 11
    got = language_id.identify(docs, model).toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.8 and (got["__p"] == "clash").all()
    few = language_id.fit_sample(docs.withColumn("lang", F.when(F.col("lang") == "l7", "l8").otherwise(F.col("lang"))), language_id.FitSpec(max_rows=5, epochs=1))
    assert len(few.languages) == 5 and "l8" in few.languages  # a row for each of the most frequent


def test_the_sample_is_bounded_in_rows_and_in_ngrams(spark, monkeypatch):
    rows = [(i, "abc " * (50 if i % 3 else 3000) + f"w{i}", "ab"[i % 2]) for i in range(600)] + [(7, "repeated", "a"), (7, "repeated", "a"), (None, "no id", "b"), (None, None, "a"), (601, "12", "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language_id, "fit_counts", lambda grams, labels, bits, spec: seen.append((list(grams), list(labels))))
    language_id.fit_sample(docs, language_id.FitSpec(max_rows=40))
    language_id.fit_sample(docs, language_id.FitSpec(max_rows=40, max_grams=sum(len(a) for a, _ in seen[0][0]) // 2))
    language_id.fit_sample(docs.limit(0), language_id.FitSpec(max_rows=40))
    (first, labels), (half, fewer) = seen[:2]
    assert sorted(labels) == ["a"] * 13 + ["b"] * 13 and 8 <= len(fewer) < 20 and abs(fewer.count("a") - fewer.count("b")) <= 1
    assert {x[0].tobytes() for x in half} < {x[0].tobytes() for x in first}


def test_ftrl_equals_a_plain_one():
    rng = random.Random(5)
    spec = language_id.FitSpec(bits=6, sizes=(1, 2), epochs=2, held=4)
    texts = ["".join(rng.choice("ab c" if i % 3 else "xyz c") for _ in range(30)) for i in range(24)]
    labels = [f"l{i % 3}" for i in range(24)]
    model = language_id.fit(texts, labels, spec)
    grams = [dict(zip(*map(list, language_id.ngram_counts(t, 6, (1, 2))), strict=True)) for t in texts]
    idf = [math.log(25 / (1 + sum(f in g for g in grams))) + 1 for f in range(64)]
    rows = []
    for g in grams:
        x = {f: (1 + math.log(n)) * idf[f] for f, n in g.items()}
        norm = math.sqrt(sum(v * v for v in x.values()))
        rows.append({f: float(np.float32(v / norm)) for f, v in x.items()} | {64: 1.0})
    z, n2 = [[0.0] * 3 for _ in range(65)], [[0.0] * 3 for _ in range(65)]

    def weight(f, k):
        l1 = 0.0 if f == 64 else spec.l1
        if abs(z[f][k]) <= l1:
            return 0.0
        return -(z[f][k] - math.copysign(l1, z[f][k])) / ((spec.beta + math.sqrt(n2[f][k])) / spec.alpha + spec.l2)

    order = np.random.Generator(np.random.PCG64(7)).permutation(24).tolist()
    for _ in range(2):
        for i in (i for k, i in enumerate(order) if k % 4):
            w = {f: [weight(f, k) for k in range(3)] for f in rows[i]}
            s = [math.exp(sum(v * w[f][k] for f, v in rows[i].items())) for k in range(3)]
            p = [v / sum(s) - (k == i % 3) for k, v in enumerate(s)]
            for f, v in rows[i].items():
                for k in range(3):
                    g = v * p[k]
                    z[f][k] += g - (math.sqrt(n2[f][k] + g * g) - math.sqrt(n2[f][k])) / spec.alpha * w[f][k]
                    n2[f][k] += g * g
    want = np.array([[weight(f, k) for k in range(3)] for f in range(64)])
    assert np.allclose(model.weights, want, atol=1e-5) and np.abs(want).max() > 0.1


def test_ngrams_of_long_texts_are_counted_once():
    text = " ".join(random.Random(1).choice(["abc", "xy", "ü"]) for _ in range(500))
    whole, parts = language_id.ngram_counts(text, 12, (1, 2, 3)), language_id.ngram_counts(text, 12, (1, 2, 3), step=37)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def brute_tokens(word, pieces):
    best = [(0.0, 0)]
    for e in range(1, len(word) + 1):
        options = [(best[e - 1][0] - 1e3, best[e - 1][1] + 1)]
        options += [(best[s][0] + pieces[word[s:e]], best[s][1] + 1) for s in range(e) if word[s:e] in pieces]
        best.append(max(options, key=lambda o: (o[0], -o[1])))
    return best[-1][1]


def test_token_counts(spark):
    rows = sample()
    pieces = token_counts.load_pieces(token_counts.default_vocabulary())
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(frame(spark, rows)).collect())
    want = []
    for i, t, *_ in rows:
        w = WORD.findall(t or "")
        seen = {x: brute_tokens(b" " + x.encode(), pieces) for x in set(w)}
        want.append((str(i), len(w), sum(seen[x] for x in w)))
    assert got == sorted(want)
    assert token_counts.count_tokens(frame(spark, rows).limit(0)).count() == 0
    small = {b"a": -1.0, b"ab": -1.5, b"b": -1.0, b"abc": math.log(0.5)}
    counter = token_counts.TrieCounter(small)
    counter.learn([b"abc", b"ab", b"abd", b"", b"zz"])
    assert counter.known == {w: brute_tokens(w, small) for w in (b"abc", b"ab", b"abd", b"", b"zz")}


def test_trie_shares_prefixes_and_forgets(monkeypatch):
    small = {b"a": -1.0, b"ab": -1.5, b"b": -1.0, b" ": -1.0, b" a": -1.2}
    counter = token_counts.TrieCounter(small)
    counter.learn([b"abab", b"abb", b"ab"])
    assert counter.nodes == 1 + len({w[:k] for w in (b"abab", b"abb") for k in range(1, len(w) + 1)})
    made = counter.nodes
    counter.learn([b"aba", b"abab"])
    assert counter.nodes == made and counter.known[b"aba"] == brute_tokens(b"aba", small)
    monkeypatch.setattr(token_counts, "MOST_NODES", 12)
    texts = [b"a ab", b"b abab", b"abba " * 3, b"", b"abababababababab"]
    want = [(len(t.split()), sum(brute_tokens(b" " + w, small) for w in t.split())) for t in texts]
    assert [x for t in texts for x in counter.totals([t])] == want and counter.nodes < 30


def test_long_words_count_as_short_ones_do(monkeypatch):
    import random

    from fathomline.llm import token_counts

    r = random.Random(3)
    pieces = {bytes(p): -float(i % 7) - 1 for i, p in enumerate({tuple(r.choice(b"abc ") for _ in range(r.randrange(1, 6))) for _ in range(60)})}
    words = [b" " + bytes(r.choice(b"abcx") for _ in range(r.randrange(1, 200))) for _ in range(200)]
    counter = token_counts.TrieCounter(pieces)
    counter.learn(words)
    assert [counter.alone(w) for w in words] == [counter.known[w] for w in words]
    texts = [b"".join(words[i : i + 5]) for i in range(0, 200, 5)] + [b"", b"ab " * 10]
    want = token_counts.TrieCounter(pieces).totals(texts)
    monkeypatch.setattr(token_counts, "LONG_WORD", 50)
    again = token_counts.TrieCounter(pieces)
    assert again.totals(texts) == want and again.nodes < counter.nodes


def test_a_very_long_word_makes_no_nodes(spark):
    from fathomline.llm import token_counts

    vocabulary = token_counts.load_pieces(token_counts.default_vocabulary())
    counter = token_counts.TrieCounter(vocabulary)
    ((words, tokens),) = counter.totals([b"the" * 400_000])
    assert words == 1 and counter.nodes == 1 and tokens >= 400_000 // 8
