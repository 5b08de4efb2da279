"""One-permutation MinHash against a brute-force version and true similarities."""

import hashlib
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from flowlens.llm import fingerprints as fp, queries

SF = "/root/testdata/sf0.001"
MASK = (1 << 64) - 1


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_words(words):
    """The engine's 64-bit hash of the words' hashes: the hash so far seeds the next one."""
    h = 42
    for w in words:
        h = xxhash.xxh64_intdigest(xxhash.xxh64_intdigest(w.encode(), seed=42).to_bytes(8, "little"), seed=h)
    return h


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def hash_ints(*values):
    """The same hash of integers of 4 bytes."""
    h = 42
    for v in values:
        h = _int_hash(v, h)
    return h


def _int_hash(v, seed):
    p1, p2, p3, p5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5
    h = (seed + p5 + 4) & MASK
    h ^= (v & 0xFFFFFFFF) * p1 & MASK
    h = ((h << 23 | h >> 41) & MASK) * p2 + p3 & MASK
    for shift, factor in ((33, p2), (29, p3), (32, 1)):
        h = ((h ^ h >> shift) * factor) & MASK
    return h


def fingerprint(text):
    bins = [None] * fp.BINS
    for s in shingles(text):
        h = signed(hash_words(s)) & ~1
        i = (h >> (64 - fp.BINS_LOG)) + fp.BINS // 2
        bins[i] = h if bins[i] is None else min(bins[i], h)
    filled = [i for i, x in enumerate(bins) if x is not None]
    if not filled:
        return ""
    out = list(bins)
    for i in range(fp.BINS):
        if out[i] is None:
            tries = [hash_ints(i, t) for t in range(fp.PROBES)]
            hit = [bins[signed(h) % fp.BINS] for h in tries if bins[signed(h) % fp.BINS] is not None]
            out[i] = hit[0] if hit else min((signed(hash_ints(i, j, -1)), bins[j]) for j in filled)[1]
    return "".join(f"{x >> 1 & 255:02x}" for x in out).upper()


def estimate(a, b):
    if not a or not b:
        return 1.0 if a == b else 0.0
    agree = sum(a[i : i + 2] == b[i : i + 2] for i in range(0, len(a), 2)) / fp.BINS
    return max(0.0, (agree - 1 / 256) / (1 - 1 / 256))


def true_likeness(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def found(spark):
    return {r.doc_id: r for r in queries.op13_minhash_fingerprints(spark, SF).collect()}


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_query_equals_brute_force(found, texts):
    order = sorted(texts, reverse=True)
    assert set(found) == set(texts)
    for k, after in zip(order, order[1:] + order[:1]):
        r, t = found[k], texts[k]
        cut = len(t) // 3
        new = t[: len(t) - cut] + texts[after][:cut]
        assert (r.n_chars, r.next_id, r.edited_sha256) == (len(t), after, hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint.upper() == fingerprint(t) and r.edited_fingerprint.upper() == fingerprint(new)
        assert r.near_edited == pytest.approx(estimate(fingerprint(t), fingerprint(new)), abs=1e-9)
        assert r.near_next == pytest.approx(estimate(fingerprint(t), fingerprint(texts[after])), abs=1e-9)


def test_likeness_is_near_the_true_similarity(found, texts):
    order = sorted(texts, reverse=True)
    errors = []
    for k, after in zip(order, order[1:] + order[:1]):
        t = texts[k]
        cut = len(t) // 3
        errors += [found[k].near_edited - true_likeness(t, t[: len(t) - cut] + texts[after][:cut]), found[k].near_next - true_likeness(t, texts[after])]
    assert abs(sum(errors) / len(errors)) < 0.01 and sum(map(abs, errors)) / len(errors) < 0.03 and max(map(abs, errors)) < 0.15


def test_awkward_rows(spark):
    long = " ".join(f"w{i % 7919} and" for i in range(40_000))
    rows = [
        (None, None), (None, "a b"), (5, "same text of a row that is there more than once"), (5, "same text of a row that is there more than once"), (5, "other"), (0, "a b"), (1, ""), (2, " \n\t"), (9, long),
        (2**63 - 1, "é" * 50), (-(2**63), "one two three four five six seven"), (7, "\U0001f600 x " * 20),
    ]
    docs = spark.createDataFrame([(k, t, "mine", 3) for k, t in rows], "doc_id long, text string, fingerprint string, N_CHARS int")
    got = fp.edited(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by = {(r.doc_id, r.n_chars): r for r in got}
    assert by[(2**63 - 1, 50)].next_id == 9 and by[(9, len(long))].next_id == 7 and by[(-(2**63), 33)].next_id is None
    assert sum(r.doc_id == 5 for r in got) == 3 and by[(1, 0)].fingerprint == by[(2, 3)].fingerprint == "" and by[(1, 0)].near_edited == 1.0
    assert by[(0, 3)].fingerprint == by[(None, 3)].fingerprint
    assert fp.edited(docs.where("false")).count() == 0
    one = fp.edited(docs.where("doc_id = 9")).collect()
    assert one[0].next_id == 9
    own = {r.text: r.fingerprint for r in fp.fingerprints(docs).collect()}
    assert own[long] == by[(9, len(long))].fingerprint


def test_no_python_and_one_shuffle_of_the_texts(spark):
    df = queries.op13_minhash_fingerprints(spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Python" not in plan and "Arrow" not in plan and "ReusedExchange" in plan


def test_bias_is_taken_off(spark):
    text = lambda c: " ".join(f"{c}{i}" for i in range(3000))
    df = spark.createDataFrame([(text("a"), text("b"))], "x string, y string")
    df = fp.with_fingerprint(fp.with_fingerprint(df, F.col("x"), "p"), F.col("y"), "q")
    r = df.select(fp.likeness(F.col("p"), F.col("q")).alias("d"), fp.likeness(F.col("p"), F.col("p")).alias("s")).first()
    assert r.s == 1.0 and r.d < 0.05
