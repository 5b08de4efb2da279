"""Spelling variants against a brute-force count and edit distances of all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from flowlens.llm import queries, variants

SF = "/root/testdata/sf0.001"


def counted(rows):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 31 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def neighbours(words):
    """Near words by shared strings with one letter left out, checked by edit distance."""
    held = {}
    for w in words:
        for v in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            held.setdefault(v, set()).add(w)
    near = {w: set() for w in words}
    for group in held.values():
        for x in group:
            near[x] |= {y for y in group if x != y and y not in near[x] and distance(x, y) == 1}
    return near


def distance(x, y):
    last = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        now = [i]
        for j, b in enumerate(y, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (a != b)))
        last = now
    return last[-1]


def expected(n):
    near, form, out = neighbours(n), {}, []
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def plain(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = expected(counted(rows))
    assert want and any(r[1] for r in want) and any(r[4] for r in want)
    assert plain(queries.op12_spelling_variants(spark, SF)) == want


def vocabulary(seed, letters="aab", size=400):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, 12))) for _ in range(size)}
    return {w: rng.choice([2, 3, 25, 40, 400, 5000, 60_000]) for w in words}


@pytest.mark.parametrize("most", [2, 17, 4096])
def test_any_block_limit_finds_each_pair_once(spark, most):
    """Few letters: many pairs, repeated letters (several places for one edit), large blocks, words of one letter."""
    n = vocabulary(most)
    got = plain(variants.forms(spark.createDataFrame(list(n.items()), "word string, n long"), most))
    assert got == expected(n)


def test_bitsets_equal_edit_distance():
    words = sorted(vocabulary(5, "abcé", 150))
    letters, size = variants._letters(words)
    order = np.argsort(-size, kind="stable")
    all_words = variants.bitset_rows(np.zeros(len(words), np.int64))
    sets = variants.one_edit(letters[order], size[order], variants.PositionIndex(letters, size), all_words)
    for bits, step in zip(sets, (0, 1, -1)):
        i, j = variants._pairs(bits)
        got = {(words[order[x]], words[y]) for x, y in zip(i, j) if size[y] == size[order[x]] + step}
        assert got == {(x, y) for x in words for y in words if len(y) == len(x) + step and distance(x, y) == 1}


def test_chains_lead_to_their_root(spark):
    n = {"a" * 7 + "b" * k: 10 ** (k + 1) for k in range(6)}
    got = plain(variants.forms(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == expected(n) and {r[2] for r in got} == {"aaaaaaabbbbb"}


def test_awkward_rows(spark):
    long = "x" * 5000
    rows = [
        (None, "Straßenbahn Straßenbahn"), (1, None), (2, ""), (3, "ÉCOLESX écolesx Écolesx ÉCOLESX"), (3, "ÉCOLESX écolesx Écolesx ÉCOLESX"), (None, "straSSenbahn x " + long), (5, long + " " + long + "y"),
        (6, "don't 1234567 \U0001f600\U0001f600\U0001f600\U0001f600\U0001f600\U0001f600\U0001f600 ×××××××÷"),
    ] + [(7, "wordword " * 300)] * 3
    docs = spark.createDataFrame([(k, t, "mine", 1) for k, t in rows], "doc_id long, text string, word string, N int")
    words = {r.word: r.n for r in variants.word_counts(docs).collect()}
    assert words == counted(rows)
    assert plain(variants.forms(variants.word_counts(docs))) == expected(words)
    nothing = docs.where("false")
    assert variants.forms(variants.word_counts(nothing)).count() == 0
