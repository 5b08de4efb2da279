"""Benchmark decontamination: a broadcast set of normalised test n-grams against every window of every text.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. The windows of an item
are its runs of ``size`` consecutive words; an item of fewer words, but not none, is one window.
Tasks number the words of the test set, combine the numbers of each text window into a hash, look
that up in the sorted hashes of the test windows, and verify each hit word by word.

A block of at most ``BLOCK_WINDOWS`` test windows is broadcast at a time; a larger test set is a
row of passes, each of which adds its hits to a column. No pass shuffles or leaves a text out.

Defined results: null text has no words; a null or wordless item matches nothing; repeated items
with one id count once, null item ids are left out of the list but their windows hit. Rows
are judged each for itself, so repeated rows repeat their result. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.common import ALNUM, Words, mixed, split_words, text_bytes, chunks, with_results

BLOCK_WINDOWS = 200_000
HITS = "struct<n:bigint,spans:array<struct<start:int,length:int>>,items:array<bigint>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))


class TestWindows:
    """Windows of some items: word numbers, and by window length the sorted hashes, the words and the items."""

    def __init__(self, ids: list[int | None], texts: list[str | None], size: int):
        raw, at = text_bytes(pa.array(texts, pa.string()))
        words = split_words(raw, at, ALNUM)
        coded = words.array().dictionary_encode()
        self.words = coded.dictionary
        number = coded.indices.to_numpy().astype(np.int64)
        found: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for d, item in enumerate(ids):
            own = number[words.ptr[d] : words.ptr[d + 1]].tolist()
            n = min(size, len(own))
            for i in range(len(own) - n + 1 if n else 0):
                found.setdefault(n, {}).setdefault(tuple(own[i : i + n]), set()).update(() if item is None else (item,))
        self.by_length = {}
        for n, windows in found.items():
            table = np.array(list(windows), np.int32).reshape(-1, n)
            h = combined(table)
            order = np.argsort(h, kind="stable")
            items = list(windows.values())
            self.by_length[n] = (h[order], table[order], [items[i] for i in order.tolist()])


def combined(table: np.ndarray) -> np.ndarray:
    h = np.zeros(len(table), np.uint64)
    for i in range(table.shape[1]):
        h = mixed(h ^ table[:, i].astype(np.uint64), i + 1)
    return h


def hits_of(words: Words, test: TestWindows) -> list[tuple[list[tuple[int, int]], set[int]]]:
    """Of each text: (first word, number of words) of the occurrences of test windows, and the items these belong to."""
    out: list[tuple[list[tuple[int, int]], set[int]]] = [([], set()) for _ in words.counts]
    number = pc.fill_null(pc.index_in(words.array(), test.words), -1).to_numpy().astype(np.int32)
    known = np.concatenate([[0], np.cumsum(number >= 0)])
    ends = np.repeat(words.ptr[1:], words.counts)
    for n, (hashes, table, items) in test.by_length.items():
        if len(number) < n:
            continue
        place = np.arange(len(number) - n + 1)
        at = place[(known[n:] - known[:-n] == n) & (place + n <= ends[: len(place)])]
        own = number[at[:, None] + np.arange(n)]
        h = combined(own)
        low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
        for k in np.flatnonzero(high > low).tolist():
            for m in range(low[k], high[k]):
                if (table[m] == own[k]).all():
                    d = int(np.searchsorted(words.ptr, at[k], "right")) - 1
                    out[d][0].append((int(at[k] - words.ptr[d]), n))
                    out[d][1].update(items[m])
    return out


def _scanner(broadcast) -> Callable[[Column], Column]:  # noqa: ANN001
    @F.arrow_udf(HITS)
    def scan(texts: pa.Array) -> pa.Array:
        raw, offsets = text_bytes(texts)
        n, found = [np.zeros(0, np.int64)], []
        for i, j in chunks(offsets):
            at = offsets[i : j + 1]
            words = split_words(raw[at[0] : at[-1]], at - at[0], ALNUM)
            n.append(words.counts)
            found += hits_of(words, broadcast.value)
        spans = pa.array([[{"start": s, "length": k} for s, k in sorted(h)] for h, _ in found], _SPANS)
        items = pa.array([sorted(x) for _, x in found], pa.list_(pa.int64()))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(n), pa.int64()), spans, items], ["n", "spans", "items"])

    return scan.asNondeterministic()


def blocks(benchmark: DataFrame, item: str, text: str, size: int) -> list[TestWindows]:
    """The test set in blocks of a bounded number of windows. An item longer than a block is a block of its own."""
    out, ids, texts, windows = [], [], [], 0
    items = benchmark.select(F.col(item).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    for row in items.toLocalIterator():
        more = len(row["text"] or "") // 2 + 1
        if texts and windows + more > BLOCK_WINDOWS:
            out.append(TestWindows(ids, texts, size))
            ids, texts, windows = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        windows += more
    return [*out, TestWindows(ids, texts, size)] if texts or not out else out


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 10) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, hits (all occurrences), items (ids, sorted as text), contaminated."""
    sc = docs.sparkSession.sparkContext
    df, names = docs, []
    for k, block in enumerate(blocks(benchmark, item, item_text, size)):
        names.append(f"__hits_{k}")
        df = df.withColumn(names[-1], _scanner(sc.broadcast(block))(F.col(text).cast("string")))
    df = df.withColumn("__hits", F.sort_array(F.concat(*[F.col(f"{c}.spans") for c in names]))).withColumn("__items", F.array_distinct(F.concat(*[F.col(f"{c}.items") for c in names]))).withColumn("__n", F.col(f"{names[0]}.n")).drop(*names)
    # Sorted by start, each hit adds the words beyond the furthest end so far.
    add = lambda s, h: F.struct(F.greatest(s.getField("end"), h.start + h.length).alias("end"), (s.getField("n") + F.greatest(F.lit(0), h.start + h.length - F.greatest(s.getField("end"), h.start))).alias("n"))
    covered = F.aggregate("__hits", F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")), add, lambda s: s.getField("n").cast("long"))
    df = df.withColumn("__hit", covered)
    items = F.sort_array(F.col("__items").cast("array<string>"))
    return with_results(df, {"n_words": F.col("__n"), "n_hit": F.col("__hit"), "hits": F.col("__hits"), "items": items, "contaminated": F.col("__hit") > 0}).drop("__hits", "__items", "__n", "__hit")


def _cut(texts: pa.Array, hits: pa.Array) -> pa.Array:
    out = []
    for value, found in zip(texts.to_pylist(), hits.to_pylist(), strict=True):
        if not value or not found:
            out.append(value)
            continue
        raw = np.frombuffer(value.encode(), np.uint8)
        inside = ALNUM[raw]
        starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
        ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
        gone = np.zeros(len(raw), bool)
        for h in found:
            gone[starts[h["start"]] : ends[h["start"] + h["length"] - 1]] = True
        out.append(raw[~gone].tobytes().decode())
    return pa.array(out, pa.string())


def without_spans(scanned: DataFrame, text: str = "text") -> DataFrame:
    """A scanned table whose texts have lost the bytes from the first to the last word of each hit."""
    cut = F.arrow_udf(_cut, "string")
    return scanned.withColumn(text, F.when(F.col("contaminated"), cut(F.col(text), F.col("hits"))).otherwise(F.col(text)))


def clean_documents(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without any hit."""
    return scan(docs, benchmark, text).where("not contaminated").select(*[F.col(f"`{c}`") for c in docs.columns])
