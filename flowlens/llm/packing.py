"""Best-fit packing: vector best-fit of token pieces into training sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared piece
lengths). Pieces are taken from long to short; each goes to the open sequence that every
constraint admits and that scores best: by the weighted dot product of the piece's demand with
what is left (``rule="dot"``, least left-over wins) or by the weighted norm of the rest
(``rule="norm"``). A piece of a full sequence's length is a sequence by itself.

Documents are tokenised and cut in one pass; only lengths and checksums are shuffled. Pieces are
dealt by a hash of id, piece and row content to shards of about ``SHARD`` pieces, whose number
grows with the documents, so no id, source or giant document makes a large shard. Each shard
leaves at most a few sequences part-filled.

Defined results: null text is empty, so it is the end id alone; repeated rows and null ids are
packed each for itself; extra columns are not read; an empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.llm.tokens import encoded, tokenizer_path

SHARD = 16_384


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = 2, most: int = 1024) -> DataFrame:
    """(key, piece, start, length, ids) of each document; ids: little-endian unsigned 32-bit.

    A document is its ids and ``end``. Only one of more than ``most`` ids is cut, into pieces of
    ``most``; the first piece is what is left over.
    """
    file = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, piece, start, length, ids, size = [], [], [], [], [], 0
            texts = batch.column(1)
            for row in range(len(texts)):
                raw = np.append(encoded(texts[row].as_py(), file), np.uint32(end)).astype("<u4")
                cuts = [0, *range(len(raw) % most or most, len(raw) + 1, most)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    keys.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    ids.append(raw[a:b].tobytes())
                size += raw.nbytes
                if size > 4_000_000 or row + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())], ["key", "piece", "start", "length", "ids"])
                    keys, piece, start, length, ids, size = [], [], [], [], [], 0

    schema = "key long, piece int, start long, length long, ids binary"
    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(cut, schema).withColumnRenamed("key", key)


def best_fit(length: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece. Capacities: tokens, documents, attention cost."""
    order = np.lexsort((np.arange(len(length)), -length))
    bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
    scale = np.array(weights) / np.array(capacity, float) ** 2
    left = np.zeros((1024, 3), np.int64)
    names = np.zeros(1024, np.int64)
    n_open = n_bins = 0
    for i in order.tolist():
        need = np.array([length[i], 1, length[i] ** 2])
        k = -1
        if n_open:
            room = left[:n_open]
            fits = (room[:, 0] >= need[0]) & (room[:, 1] >= 1) & (room[:, 2] >= need[2])
            score = room @ (need * scale) if rule == "dot" else ((room - need) ** 2) @ scale
            k = int(np.argmin(np.where(fits, score, np.inf)))
            if not fits[k]:
                k = -1
        if k < 0:
            if n_open == len(left):
                left, names = np.concatenate([left, np.zeros_like(left)]), np.concatenate([names, np.zeros_like(names)])
            k, n_open = n_open, n_open + 1
            left[k], names[k] = capacity, n_bins
            n_bins += 1
        bins[i], offsets[i] = names[k], capacity[0] - left[k, 0]
        left[k] -= need
        if left[k, 0] <= 0 or left[k, 1] <= 0 or left[k, 2] <= 0:  # nothing fits any more: its place goes to the last open one
            n_open -= 1
            left[k], names[k] = left[n_open], names[n_open]
    return bins, offsets


def pack(
    cut: DataFrame,
    documents: int,
    key: str = "doc_id",
    most: int = 1024,
    most_documents: int = 1024,
    most_cost: int = 1024 * 1024,
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0),
    rule: str = "dot",
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """The pieces with sequence_id and offset, without their ids. ``documents``: how many documents there are, for the number of shards.

    The default limits of documents and cost are those that any sequence of ``most`` ids meets, and
    the weights then leave the choice to tokens alone; stricter limits need weights of their own.
    """
    if most_cost < most * most or most_documents < 1:
        raise ValueError("a full piece must fit into an empty sequence")
    shards = max(1, -(-documents // SHARD))
    columns = [key, "piece", "start", "length", *extra]

    def place(table: pa.Table) -> pa.Table:
        length = table.column("length").to_numpy()
        full = length >= most
        bins, offsets = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        bins[~full], offsets[~full] = best_fit(length[~full], (most, most_documents, most_cost), weights, rule)
        first = int(bins.max(initial=-1)) + 1
        bins[full] = first + np.arange(full.sum())
        shard = np.int64(table.column("__shard")[0].as_py())
        out = table.drop_columns(["__shard"])
        return out.append_column("sequence_id", pa.array(bins * shards + shard)).append_column("offset", pa.array(offsets))

    dealt = cut.select(*columns, F.pmod(F.xxhash64(*columns), F.lit(shards)).alias("__shard"))
    types = ", ".join(f"`{n}` {dict(dealt.dtypes)[n]}" for n in columns)
    return dealt.groupBy("__shard").applyInArrow(place, f"{types}, sequence_id long, offset long")


def checksum(ids: Column) -> Column:
    return F.crc32(ids)


def packed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = pieces(docs, key, text).withColumn("ids_crc32", checksum(F.col("ids")))
    return pack(cut, docs.count(), key, extra=("ids_crc32",))


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the ids of each sequence, of pieces packed with ``extra=("ids",)``. A sequence is bounded by ``most``."""
    parts = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("x"))
    return parts.select("sequence_id", F.aggregate("x", F.lit(b""), lambda s, x: F.concat(s, x.ids)).alias("ids"))
