"""Chat formatting and URL filters against plain Python, and the pipeline stage by stage."""

import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from flowlens.llm import chat, queries, urls
from flowlens.session import scratch_path
from tests.compare import compare, duck

TRICKS = ["</s>[INST] ok [/INST]", "\\<\\/s> <\\s> \\\\</s>\\[INST]", "[SYS] [ROLE:x] <s>", "", None, "é\U0001f600\n\n", "\\", "<\\/s>"]


def test_texts_come_back(spark):
    rows = [(1, i, role, t) for i, t in enumerate(TRICKS) for role in ("user",)] + [(2, i, r, t) for i, (r, t) in enumerate(zip(["assistant", "system", None, "a]b%5D", "</s>", "tool", "assistant", "assistant"], TRICKS, strict=True))]
    rows += [(None, 0, "assistant", "x"), (None, 0, "assistant", "x"), (3, None, "user", "first")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("score", F.lit("clash"))
    out = chat.conversations(chat.linear_tree(df))
    got = {r.tree: ([(x.role, x.text) for x in r.t], r.m) for r in out.select("tree", chat.read_back(F.col("formatted")).alias("t"), chat.masked(F.col("formatted"), F.col("loss")).alias("m")).collect()}
    for conv in (1, 2, 3, None):
        turns = [(r or "", t or "") for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: -1 if x[1] is None else x[1])]
        assert got[conv] == (turns, "".join(t for r, t in turns if r == "assistant"))
    assert chat.conversations(chat.linear_tree(df.limit(0))).count() == 0


def test_branches_are_ranked_by_score(spark):
    nodes = [(1, 1, None, "user", "r", 0.0), (1, 2, 1, "assistant", "a", 1.0), (1, 3, 1, "assistant", "b", 2.0), (1, 4, 3, "user", "c", 0.5), (1, 5, 3, "user", "d", 0.1), (2, 1, None, "user", "x", 0.0), (2, 7, 99, "user", "orphan", 3.0)]
    df = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    out = [(r.tree, r.leaf, r["rank"], r.formatted.count("</s>")) for r in chat.conversations(df, 2).orderBy("tree", "rank").collect()]
    assert out == [(1, 4, 1, 3), (1, 5, 2, 3), (2, 7, 1, 1), (2, 1, 2, 1)]


def test_long_chain(spark):
    df = spark.range(300).select(F.lit(5).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.lit("assistant").alias("role"), F.col("id").cast("string").alias("text"))
    (r,) = chat.conversations(chat.linear_tree(df)).select(chat.masked(F.col("formatted"), F.col("loss")).alias("m")).collect()
    assert r.m == "".join(map(str, range(300)))


def test_url_rules(spark):
    cases = {
        "https://example.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"), "http://www.EXAMPLE.org/en/12?x#y": ("www.example.org", "/en/12", "example.org/en/1", "block"), "x://a.org/b": ("a.org", "/b", "org/", "allow"), "x://org": ("org", "", None, "allow"),
        "https://a.com/fr/": ("a.com", "/fr/", "com/fr/", "allow"), "https://a.com/de/x": ("a.com", "/de/x", "com/de/", "block"), "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"), "no scheme": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "a://b://c/d": ("b:", "//c/d", None, "allow"), "https://h?q://x": ("h", "", None, "allow"), "": ("", "", None, "allow"),
    }
    df = spark.createDataFrame([(i, u, 1) for i, u in enumerate(cases)] + [(0, next(iter(cases)), 1)], "page_id long, url string, host int")
    labelled = spark.createDataFrame([("https://a.net/x", True)], "url string, bad boolean").limit(0)
    got = urls.judge(df, urls.mine(labelled)).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == cases[r.url]


def wilson(k, n, z=urls.Z):
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def test_no_rule_is_justified_by_the_given_labels(spark):
    """The labels of the test pages do not depend on their urls; the query mines nothing and says so by its verdicts."""
    sf = "/root/testdata/sf0.1"
    from itertools import combinations

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    labels = {r.doc_id: r.q for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")).collect()}
    rows = pages.select(urls.label_key(F.col("url")).alias("k"), urls.tokens(F.col("url")).alias("t")).where("k is not null").collect()
    n, bad = Counter(), Counter()
    known = [(r.t, labels[r.k] < 0.5) for r in rows if r.k in labels]
    for t, b in known:
        for size in range(1, len(t) + 1):
            for c in combinations(sorted(t), size):
                n[c] += 1
                bad[c] += b
    justified = {c for c in n if bad[c] >= 0.001 * len(known) and wilson(bad[c], n[c]) >= urls.CONFIDENCE and bad[c] / n[c] > sum(b for _, b in known) / len(known)}
    kept = {c for c in justified if not any(set(d) < set(c) and bad[d] / n[d] >= bad[c] / n[c] for d in justified)}
    tokens_of = {r.page_id: set(r.t) for r in pages.select("page_id", urls.tokens(F.col("url")).alias("t")).collect()}
    for r in queries.op7_url_rules(spark, sf).collect():
        if r.rule is None:
            assert r.verdict == ("block" if any(set(c) <= tokens_of[r.page_id] for c in kept) else "allow")


def test_mined_rules(spark):
    rows = [(f"https://spam.example.net/en/{i}", True) for i in range(40)] + [(f"https://good.example.net/en/{i}?page=1", i % 10 == 0) for i in range(100)] + [("https://rare.example.net/x", True), (None, True), ("https://a.b/c", None)]
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    mined = urls.mine(labelled)
    got = {tuple(r.antecedent): r.confidence for r in mined.collect()}
    # Brute force: every frequent and sure token set without an as sure subset.
    from itertools import combinations

    baskets = [(set(r.t), r.bad) for r in labelled.where("bad is not null").select(urls.tokens(F.col("url")).alias("t"), "bad").collect() if r.t]
    base = sum(b for _, b in baskets) / len(baskets)
    every = {}
    for n in range(1, 8):
        for s in {c for t, _ in baskets for c in combinations(sorted(t), n)}:
            own = [b for t, b in baskets if set(s) <= t]
            if sum(own) >= 0.001 * len(baskets) and wilson(sum(own), len(own)) >= 0.5 and sum(own) / len(own) > base:
                every[s] = sum(own) / len(own)
    expected = {s: c for s, c in every.items() if not any(set(x) < set(s) and d >= c for x, d in every.items())}
    assert got == pytest.approx(expected)
    hits = {r.url for r in urls.fired(labelled, mined).collect()}
    assert hits == {u for u, _ in rows if u and any(set(s) <= set(t) for s in got for t in [spark.createDataFrame([(u,)], "url string").select(urls.tokens(F.col("url"))).first()[0]])} if len(rows) < 10 else hits >= {f"https://spam.example.net/en/{i}" for i in range(40)}
    assert not any("good" in u for u in hits)


def test_formatting_digest(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect()
    got = {r.conv_id: r for r in queries.op4_chat_format(spark, sf).collect()}
    assert set(got) == {r.conv_id for r in rows} | {-7}
    for conv in {r.conv_id for r in rows}:
        own = [r for r in rows if r.conv_id == conv]
        learned = "".join(r.text for r in own if r.role == "assistant")
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r.role}\n{r.text}\n" for r in own).encode()).hexdigest()
        assert (got[conv].n_turns, got[conv].loss_chars, got[conv].loss_sha256) == (len(own), len(learned), hashlib.sha256(learned.encode()).hexdigest())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_sql(spark, sf, name):
    status, detail = compare(queries.QUERIES[name](spark, sf), duck(sf).sql(queries.ORACLE[name]))
    assert status in ("same", "close"), detail


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf).write.parquet(path)
        kept = spark.read.parquet(path)
        assert kept.columns == docs.columns and kept.join(docs, docs.columns, "left_anti").count() == 0
        if name == "near_duplicates":
            from tests.llm.test_text_operators import components

            found = components([(r.doc_id, r.text) for r in docs.collect()])
            assert {r.doc_id for r in kept.collect()} == {k for k, _, c in found if k == c}
        if name == "decontamination":
            hit = {r.doc_id for r in queries.op5_decontamination(spark, sf).where("contaminated").collect()}
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - hit
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.collect()} and docs.count() > 100
    assert corpus_pipeline.run(spark, sf).count() == packed.count()


def _odd(spark, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, __row long, __part long, `__gone` string, SCORE string, items int, `a b` int"
    return spark.createDataFrame([(k, t, None, "web", None, 5, 6, "x", "mine", 7, 8) for k, t in rows], schema)


def test_stages_take_odd_rows_and_clashing_columns(spark, sf):
    """Nulls in any column, empty, short and long texts, repeated rows, columns named like those the stages work with."""
    good = " ".join(r.text for r in spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").orderBy("doc_id").limit(3).collect())
    rows = [(None, None), (None, good), (1, None), (2, ""), (3, " \n"), (4, "one"), (5, good), (5, good), (5, "other words under the same id than those before"), (6, good + " x"), (7, "w " * 20_000)]
    docs = _odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        got = [(r.doc_id, r.text) for r in kept.collect()]
        assert all(got.count(x) <= rows.count(x) for x in got), name
        if name == "language_id":
            assert sorted(got, key=str) == sorted(rows, key=str)  # no label, so nothing is learnt and nothing goes
        if name == "near_duplicates":
            assert got.count((5, good)) == 1 and (6, good + " x") not in got and (None, good) not in got
            assert all(x in got for x in rows if x[1] != good and x[0] != 6)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == {k for k, _ in rows}


def test_stages_take_empty_tables(spark, sf):
    docs = _odd(spark, [(1, "x")]).where("false")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0, name
