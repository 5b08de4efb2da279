"""Operators on texts against brute force, over test documents and awkward rows."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowlens.llm import decontaminate, langid, lm, ngram_join, packing, quality_gam, queries, rules, token_counts
from flowlens.llm.common import ALNUM, SPACED, words_of
from flowlens.llm.tokens import encoded, tokenizer_path

LONG = " ".join(f"w{i % 977} and" for i in range(30_000))
AWKWARD = [
    (None, "no id at all here"), (1_000_001, None), (1_000_002, ""), (1_000_003, " \t\n\x0b\x0c\r "), (1_000_004, "one"), (1_000_005, "a b c d"), (1_000_006, "a b c d"),
    (1_000_007, "same row twice in this table"), (1_000_007, "same row twice in this table"), (1_000_008, LONG), (1_000_009, "12 + 34 = 46 !!! ###"), (1_000_010, "İstanbul ÉCOLE é\u00a0x \U0001f600"), (-3, "A b C d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, KEPT int, id long, items string"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame([(k, t, None, None, None, "mine", 7, 8, "x") for k, t in AWKWARD], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf, awkward):
    return spark.read.parquet(f"{sf}/documents.parquet").unionByName(awkward.select("doc_id", "text", "lang", "source", "n_chars")).cache()


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def spaced(text):
    return (text or "").encode().lower().split()


def shingles(text, size=5):
    w = spaced(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(rows):
    """(id, text) rows to their component ids, by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders, common, parent = defaultdict(list), Counter(), list(range(len(rows)))
    for i, s in enumerate(sets):
        for g in s:
            for j in holders[g]:
                common[j, i] += 1
            holders[g].append(i)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, j), n in common.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            parent[root(j)] = root(i)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return sorted(((k, len(s), least.get(root(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.select(*columns).collect()), key=str)


def test_words_equal_python():
    texts = [t for _, t in AWKWARD]
    got = [w for _, _, words in words_of(pa.array(texts, pa.string()), SPACED) for w in words.array().to_pylist()]
    assert got == [w for t in texts for w in spaced(t)]


def test_language_id(spark, sf, docs, awkward, empty):
    rows = queries.op1_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9
    net = langid.fit(docs)
    got = {r.doc_id: r for r in langid.predict(awkward, net).collect()}
    assert all(got[k].lang_pred == "und" and got[k].score == 0 for k in (1_000_001, 1_000_002, 1_000_003, 1_000_009))
    assert got[1_000_008].lang_pred in net.langs and 0 <= got[1_000_008].score <= 1 and got[1_000_008].KEPT == 7
    assert langid.predict(empty, net).count() == 0
    assert langid.fit(empty) is None and langid.predict(awkward, None).where("lang_pred <> 'und'").count() == 0
    assert langid.known_language(awkward, net, 0.0).columns == awkward.columns


def test_language_windows_come_from_whole_texts(spark):
    """All texts open with the same passage; only what follows tells the languages apart."""
    rng, head = random.Random(4), "licence of the archive, all rights reserved. " * 40
    body = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(1500))
    rows = [(i, head + body("abcdefgh" if i % 2 else "rstuvwxy"), "aa" if i % 2 else "bb") for i in range(60)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    alone = spark.createDataFrame([(1, body("abcdefgh"), "aa"), (2, body("rstuvwxy"), "bb")], "doc_id long, text string, lang string")
    assert all(r.lang == r.lang_pred and r.score > 0.8 for r in langid.predict(alone, net).collect())


def test_language_rows_of_a_repeated_id_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train_windows", lambda cut, langs: seen.append((cut, langs)))
    rows = [(1, f"text number {i} of one id", "aa") for i in range(200)] + [(1, "a copy", "aa")] * 50 + [(2, "another id", "aa"), (3, "a third", "bb")]
    langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=10)
    (cut, langs), = seen
    assert Counter(langs) == {"aa": 10, "bb": 1} and b"another id" in cut and cut.count(b"a copy") <= 1


def test_near_duplicates(spark, docs, empty):
    rng = random.Random(1)
    base = [f"u{rng.randrange(4000)}" for _ in range(150)]
    near = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        near.append((2_000_000 + i, " ".join(w)))
    own = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()] + near
    got = plain(ngram_join.near_duplicates(spark.createDataFrame(own, "doc_id long, text string")), "doc_id", "n_shingles", "component_id")
    assert got == components(own)
    assert ngram_join.near_duplicates(empty).count() == 0


def test_one_of_each_keeps_the_smallest(spark):
    t = "the quick brown fox jumps over the lazy dog again and again"
    df = spark.createDataFrame([(4, t, 1), (2, t, 2), (9, t + " now", 3), (5, "another text of some words here", 4), (5, "another text of some words here", 5), (6, None, 6), (7, None, 7)], "doc_id long, text string, extra int")
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [2, 5, 6, 7]


def test_one_of_each_goes_by_rows(spark):
    t, other = "the quick brown fox jumps over the lazy dog again and again", "something else that nobody wrote before at all"
    rows = [(4, t, 1), (2, t, 2), (4, other, 3), (None, t + " now", 4), (None, "a text of its own with no id", 5), (None, "two copies without any id here", 6), (None, "two copies without any id here", 6), (4, "a third text under that same id", 7), (4, None, 8), (4, None, 9)]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, extra int"))
    assert sorted(r.extra for r in kept.collect()) == [2, 3, 5, 6, 7, 8, 9]


def test_packing(spark, docs, empty):
    rows = packing.packed_documents(docs).collect()
    ids = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        ids[r.doc_id].append(np.append(encoded(r.text, tokenizer_path()), 2).astype("<u4"))
    total = sum(len(x) for v in ids.values() for x in v)
    by_sequence, by_doc = defaultdict(list), Counter()
    for r in rows:
        part = ids[r.doc_id][0][r.start : r.start + r.length]
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == 1024)
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id] += r.length
    assert all(by_doc[k] == sum(map(len, v)) for k, v in ids.items())
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(by_sequence) <= 1.03 * -(-total // 1024)
    whole = packing.pack(packing.pieces(docs), docs.count(), extra=("ids",))
    assert sum(len(r.ids) for r in packing.sequences(whole).collect()) == 4 * total
    assert packing.packed_documents(empty).count() == 0


@pytest.mark.parametrize("rule", ["dot", "norm"])
def test_best_fit_keeps_every_limit(rule):
    length = np.random.default_rng(2).integers(1, 1024, 700)
    bins, offsets = packing.best_fit(length, (1024, 3, 500_000), (1.0, 0.2, 0.2), rule) if length.max() ** 2 <= 500_000 else packing.best_fit(np.minimum(length, 700), (1024, 3, 500_000), (1.0, 0.2, 0.2), rule)
    length = np.minimum(length, 700) if length.max() ** 2 > 500_000 else length
    for b in set(bins.tolist()):
        own = bins == b
        assert length[own].sum() <= 1024 and own.sum() <= 3 and (length[own] ** 2).sum() <= 500_000
        order = np.argsort(offsets[own])
        assert (offsets[own][order] == np.concatenate([[0], np.cumsum(length[own][order])[:-1]])).all()


def test_ids_equal_the_tokenizers_library(docs):
    from tokenizers import Tokenizer

    texts = [r.text or "" for r in docs.collect()] + ["<|endoftext|> x", "  a  b \n\n c\t", "don't I'LL 12345 ½ ٣"]
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    for text, e in zip(texts, t.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert encoded(text, tokenizer_path()).tolist() == e.ids


def test_decontamination(spark, sf, docs, awkward, empty):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [(900, "a b c"), (901, None), (902, "!!"), (903, "a b c"), (None, "one"), (904, " ".join(LONG.split()[50:70]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").encode().lower().decode())
    windows = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(k)
    sizes = {len(w) for w in windows}
    expected = []
    for r in docs.collect():
        w, hit, found = words(r.text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (g := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[g]
        expected.append((r.doc_id, len(w), len(hit), sorted(str(x) for x in found if x is not None), bool(hit)))
    scanned = decontaminate.scan(docs, bench)
    got = [(r.doc_id, r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in scanned.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    cut = decontaminate.without_spans(scanned)
    assert decontaminate.scan(cut.select("doc_id", "text"), bench.where("item_id < 900")).where("contaminated").count() == 0
    assert decontaminate.clean_documents(awkward, bench).columns == awkward.columns
    assert decontaminate.scan(empty, bench).count() == 0 and decontaminate.scan(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_in_blocks(spark, sf, docs, monkeypatch):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    one = plain(decontaminate.scan(docs, bench).select("doc_id", "n_hit", F.array_join("items", ",").alias("i")), "doc_id", "n_hit", "i")
    monkeypatch.setattr(decontaminate, "BLOCK_WINDOWS", 300)
    assert len(decontaminate.blocks(bench, "item_id", "text", 10)) > 3
    assert plain(decontaminate.scan(docs, bench).select("doc_id", "n_hit", F.array_join("items", ",").alias("i")), "doc_id", "n_hit", "i") == one


def auc(good, bad):
    return sum((a > b) + 0.5 * (a == b) for a in good for b in bad) / (len(good) * len(bad))


def test_quality_classifier(spark, awkward, empty):
    big = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op6_quality_gam(spark, big).collect()}
    held = [(got[r.doc_id], r.quality) for r in spark.read.parquet(f"{big}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.7) for r in got.values())
    assert auc([r.score for r, q in held if q], [r.score for r, q in held if not q]) > 0.95
    labels = spark.createDataFrame([(1_000_008, 1), (1_000_004, 0), (1_000_004, None), (None, 1), (1_000_007, 1), (1_000_007, 0), (5, 1)], "doc_id long, quality int")
    model = quality_gam.fit(awkward, labels)
    rows = quality_gam.score(awkward, model).collect()
    assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and r.KEPT == 7 for r in rows)
    assert quality_gam.score(empty, model).count() == 0 and quality_gam.fit(empty, labels) is None
    assert quality_gam.good_documents(awkward, model, least=0.0).columns == awkward.columns


def test_lm_scores(spark, sf, awkward, empty):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(awkward.select("doc_id", "text"))
    learning = docs.where("doc_id % 7 <> 2")
    rows = docs.collect()
    counts = Counter(w for r in learning.collect() for w in [*spaced(r.text), b" "])
    n, v = sum(counts.values()), len(counts)
    expected = []
    for r in rows:
        w = [*spaced(r.text), b" "]
        expected.append((r.doc_id, len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), 5)))
    got = lm.score(docs, learning).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got), key=str) == sorted(expected, key=str)
    assert all(r.score < 0 for r in got)
    assert lm.score(empty, learning).count() == 0
    none = lm.score(awkward, empty).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 and r.score < 0 for r in none)


def test_rare_words_are_joined(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one = {r.doc_id: (r.n_known, round(r.base_score, 5)) for r in lm.score(docs, docs).collect()}
    monkeypatch.setattr(lm, "HEAD_WORDS", 3)
    assert {r.doc_id: (r.n_known, round(r.base_score, 5)) for r in lm.score(docs, docs).collect()} == one


def test_attention_is_a_causal_distribution():
    rng = np.random.default_rng(0)
    texts = [rng.integers(0, 300, n).astype(np.uint32) for n in (5, 80, 200)]
    model = lm.train(texts)
    start = np.array([7, 7, 9, 30, 1] * 7, np.uint32)
    # All continuations of a text sum to one; the text before is scored alike in each.
    base = model.log10(start, np.array([0, len(start)]))[0]
    every = np.concatenate([np.append(start, np.uint32(x)) for x in range(lm.VOCABULARY)][:400] + [np.append(start, np.uint32(x)) for x in range(400, lm.VOCABULARY)])
    each = model.log10(every, np.arange(0, len(every) + 1, len(start) + 1))
    assert abs(sum(10 ** (each - base)) - 1) < 1e-3


def test_lm_counts_cover_whole_texts(spark):
    """More texts than the sample of old, and ids that only the end of a long text holds."""
    own = [(i, f"plain words of text {i % 7}") for i in range(900)] + [(900, "a b c d " * 6000 + "zebra quartz zebra"), (900, "repeated id"), (None, "no id xylophone"), (901, None)]
    learning = spark.createDataFrame(own, "doc_id long, text string")
    ids = [np.append(encoded(t and t.lower(), tokenizer_path()), np.uint32(lm.END)) for _, t in own]
    model = lm.fit(learning, "doc_id", "text")
    assert set(np.flatnonzero(model.column >= 0)) == set(np.concatenate(ids).tolist())
    one = lm.train(ids)
    assert (model.cls == one.cls).all() and np.allclose(model.seen, one.seen) and np.allclose(model.rest, one.rest)


def test_lm_windows_grow_with_the_input():
    """One share of the windows of whole texts, at any number of texts; each window in one round at most."""
    rng = np.random.default_rng(2)
    y = rng.integers(0, 50_000, 24 * 1000 - 5)
    every = {w.tobytes() for w in lm.windows(y, np.array([0, len(y)]), *lm.places(np.array([0, len(y)])))[1]}
    assert len(every) == 1000
    drawn = []
    for rows in (8, 64):
        rounds = [[lm.drawn(np.array([row]), y, np.array([0, len(y)]), turn)[1] for row in range(rows)] for turn in range(lm.ROUNDS)]
        assert all(w.tobytes() in every for part in rounds for t in part for w in t)
        for row in range(rows):
            own = [w.tobytes() for part in rounds for w in part[row]]
            assert len(own) == len(set(own))
        drawn.append(sum(len(t) for part in rounds for t in part))
        assert abs(drawn[-1] - rows * 1000 / lm.SHARE) < 5 * math.sqrt(rows * 1000 / lm.SHARE)
    late = {w.tobytes() for part in rounds for t in part for w in t}
    assert lm.windows(y, np.array([0, len(y)]), np.array([0]), np.array([999]))[1].tobytes() in every and len(late) > 32_000 / lm.SHARE  # distinct ones


def test_lm_attention_by_brute_force():
    rng = np.random.default_rng(8)
    model = lm.train([rng.integers(0, 500, 90).astype(np.uint32) for _ in range(30)])
    y = np.append(rng.integers(0, 600, 77), lm.END)
    p = {k: v.astype(float) for k, v in model.p.items()}
    total = 0.0
    for t in range(len(y)):
        first = t // lm.STEP * lm.STEP - (lm.WINDOW - lm.STEP)  # the window that scores place t
        u = [y[i - 1] if i >= 1 else lm.BEGIN for i in range(first, t + 1)]
        x = p["e"][u] + p["pos"][: len(u)]
        w = np.exp((x[-1] @ p["q"]) @ (x @ p["k"]).T)
        r = x[-1] + w / w.sum() @ (x @ p["v"])
        z = np.maximum(r @ p["w1"] + p["b1"], 0) @ p["w2"] + p["b2"]
        total += (z[model.cls[y[t]]] - np.log(np.exp(z).sum())) / np.log(10) + float(model.within(model.before[np.array([u[-1]])], y[t : t + 1])[0])
    assert model.log10(y, np.array([0, len(y)]))[0] == pytest.approx(total, rel=1e-5)


def test_lm_beats_a_subword_unigram_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op8_lm_score(spark, sf).collect()
    held = {r.doc_id: r for r in rows if r.held_out}
    ids = {r.doc_id: np.append(encoded(lm._lowered(r.text), tokenizer_path()), lm.END).astype(np.int64) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    counts = sum(np.bincount(v, minlength=lm.VOCABULARY) for k, v in ids.items() if k not in held)
    logs = np.log10((counts + 1) / (counts.sum() + lm.VOCABULARY))
    n = sum(len(ids[k]) for k in held)
    model, unigram = sum(r.score for r in held.values()) / n, sum(logs[ids[k]].sum() for k in held) / n
    better = sum(r.score > logs[ids[k]].sum() for k, r in held.items()) / len(held)
    print("log10 a token", model, unigram, "better texts", better)
    assert model > unigram + 0.05 and better > 0.9


def test_quality_rules(docs, awkward, empty):
    expected = []
    for r in docs.collect():
        t = r.text or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        times, hit = Counter(win), set()
        for i, g in enumerate(win):
            if times[g] > 1:
                hit.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
        expected.append((r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)))
    got = rules.judge(docs)
    assert plain(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(expected, key=str)
    assert got.where("kept and base_failed").count() == 0
    kept = rules.judge(awkward)
    assert "KEPT" not in kept.columns and kept.where("kept is null").count() == 0
    assert rules.judge(empty).count() == 0


def test_filters_on_rules_repeat_no_work(spark):
    rng = np.random.default_rng(5)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the"], 60_000))
    docs = spark.createDataFrame([(1, long), (2, "the " + " ".join("word" + chr(97 + i % 26) * (1 + i // 26) for i in range(40)))], "doc_id long, text string")
    rules.judge(docs).collect()
    start = time.time()
    every = {r.doc_id: r for r in rules.judge(docs).collect()}
    plain_s, start = time.time() - start, time.time()
    kept = rules.judge(docs).where("kept").collect()
    failed = rules.judge(docs).where("base_failed and n_repeat_words > 10").collect()
    assert time.time() - start <= 2 * (2 * plain_s + 2)
    assert [r.doc_id for r in kept] == [2] and [r.doc_id for r in failed] == [1]
    assert every[1].n_repeat_words > 50_000 and every[2].n_repeat_words == 0


def test_rules_tell_labelled_texts_apart(spark):
    big = "/root/testdata/sf0.01"
    rows = queries.op9_quality_rules(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("not base_failed").collect()
    assert sum(r.kept for r in rows if r.quality == 1) / sum(1 for r in rows if r.quality == 1) > 0.97
    assert sum(r.kept for r in rows if r.quality == 0) / max(1, sum(1 for r in rows if r.quality == 0)) < 0.3


def test_token_counts(spark, docs, empty):
    expected = sorted(((r.doc_id, len(encoded(r.text, tokenizer_path()))) for r in docs.collect()), key=str)
    assert plain(token_counts.counted_documents(docs), "doc_id", "n_tokens") == expected
    assert token_counts.counted_documents(empty).count() == 0


@pytest.mark.parametrize("block", [6, 37, 1000])
def test_separator_scan_over_block_edges(spark, tmp_path, block):
    rng = np.random.default_rng(block)
    flat = rng.integers(0, 60_000, 5000).astype("<u2")
    flat[rng.integers(0, 5000, 200)] = token_counts.END
    flat[100:104] = token_counts.END
    flat[-1] = 5
    (tmp_path / "x.bin").write_bytes(flat.tobytes())
    (tmp_path / "none.bin").write_bytes(b"")
    ends = np.flatnonzero(flat == token_counts.END).tolist()
    starts = [0, *(e + 1 for e in ends)]
    expected = [(i, s, e - s, c) for i, (s, e, c) in enumerate(zip(starts, [*ends, len(flat)], [True] * len(ends) + [False], strict=True))]
    got = token_counts.scan(spark, str(tmp_path), head=0, block_ids=block).orderBy("nth").collect()
    assert [(r.nth, r.start, r.n_tokens, r.closed) for r in got] == expected


def test_digest_of_no_item():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")


def test_alnum_table():
    assert all(ALNUM[b] == bool(re.match(b"[^\x00-\x2f\x3a-\x60\x7b-\x7f]", bytes([b]).lower())) for b in range(256))
