"""Token counts: end-of-document identifiers searched for in flat, unindexed token files.

A flat file is nothing but little-endian unsigned 16-bit ids, each document closed by the end id.
``write_flat`` makes such files with Spark's own text writer: a row's bytes are its ids and the
line separator is the end id. ``scan`` finds the documents of any such files without an index:

1. Each file is cut into blocks of a fixed number of ids. A block is searched with one vectorised
   comparison and answers with the documents that start in it, and its first end.
2. A prefix scan over the block rows of a file numbers the documents; a scan from behind gives
   each block the first end after it, which closes the document that runs over its edge, over
   however many blocks.

A document may begin with ``head`` ids that carry its key (15 bits an id, so never the end id);
they are not counted. Blocks overlap by these ids.

Files come whole to a task that cuts them (Spark's ``binaryFile`` source, which refuses files over
2 GB with an error); ``write_flat`` bounds a file by the rows of a task and ``FILE_ROWS``.

Defined results: an empty document counts 0 ids; ids behind the last end of a file are a document
that is not closed (``closed`` false), none if there are no such ids; an empty file gives no row.
A file of an odd number of bytes is an error. Null text is empty; null keys stay null; repeated
rows are documents of their own; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowlens.llm.tokens import encoded, tokenizer_path
from flowlens.session import scratch_path

END = 50_256
HEAD = 5
BLOCK_IDS = 1 << 19
FILE_ROWS = 20_000


def key_ids(key: int | None) -> np.ndarray:
    value = 16 << 60 if key is None else key % 2**64
    return np.array([value >> (15 * i) & 0x7FFF for i in range(HEAD)], "<u2")


def key_of(ids: np.ndarray) -> int | None:
    value = sum(int(x) << (15 * i) for i, x in enumerate(ids.tolist()))
    return None if value >> 64 else value - (2**64 if value >> 63 else 0)


def write_flat(docs: DataFrame, out: str, key: str = "doc_id", text: str = "text", path: str | None = None, end: int = END) -> None:
    """Writes the documents as flat token files below ``out``, each with its key in front."""
    file = path or tokenizer_path()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts, raw, size = batch.column(0), batch.column(1), [], 0
            for row in range(len(texts)):
                ids = encoded(texts[row].as_py(), file)
                if (ids == end).any() or ids.max(initial=0) > 0xFFFF:
                    raise ValueError("a text holds the end id or an id beyond 16 bits")
                raw.append(key_ids(keys[row].as_py()).tobytes() + ids.astype("<u2").tobytes())
                size += len(raw[-1])
                if size > 4_000_000 or row + 1 == len(texts):
                    yield pa.RecordBatch.from_arrays([pa.array(raw, pa.binary())], ["ids"])
                    raw, size = [], 0

    ids = docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(coded, "ids binary")
    # The separator's two bytes are written as they are in this charset, and so are the ids.
    line_end = end.to_bytes(2, "little").decode("latin-1")
    ids.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", line_end).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_ROWS).text(out)


def scan(spark: SparkSession, path: str, end: int = END, head: int = HEAD, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, nth, key, start, n_tokens, closed) of each document of the flat files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where("length > 0")
    size, extra = 2 * block_ids, 2 * head
    parts = F.transform(F.sequence(F.lit(0), F.expr(f"cast((length - 1) div {size} as int)")), lambda i: F.substring("content", F.lit(1) + i * size, size + extra))
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length"), F.posexplode(parts).alias("block", "raw"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, length, block, raw in zip(*(batch.column(i) for i in range(4)), strict=True):
                if length.as_py() % 2:
                    raise ValueError(f"{file} is no file of 16-bit ids")
                ids = np.frombuffer(raw.as_buffer(), "<u2")
                ends = np.flatnonzero(ids[:block_ids] == end)
                starts = np.concatenate([[0], ends + 1] if block.as_py() == 0 else [ends + 1])
                starts = starts[starts + block.as_py() * block_ids < length.as_py() // 2]
                nexts = np.searchsorted(ends, starts)
                base = block.as_py() * block_ids
                own = [{"start": s + base, "key": key_of(ids[s : s + head]) if head else None, "end": int(ends[k]) + base if k < len(ends) else None} for s, k in zip(starts.tolist(), nexts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()]), pa.array([length.as_py() // 2]), pa.array([block.as_py()], pa.int32()), pa.array([int(ends[0]) + base if len(ends) else None], pa.int64()), pa.array([own], pa.list_(pa.struct([("start", pa.int64()), ("key", pa.int64()), ("end", pa.int64())])))],
                    ["file", "ids", "block", "first_end", "docs"],
                )

    found = rows.mapInArrow(searched, "file string, ids long, block int, first_end long, docs array<struct<start:long,key:long,end:long>>")
    order = Window.partitionBy("file").orderBy("block")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("file").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    stitched = found.withColumn("first", F.coalesce(F.sum(F.size("docs")).over(before), F.lit(0))).withColumn("next_end", F.min("first_end").over(after))
    each = stitched.select("file", "ids", "first", "next_end", F.posexplode("docs").alias("i", "d"))
    stop = F.coalesce(F.col("d.end"), F.col("next_end"))
    return each.select(
        "file", (F.col("first") + F.col("i")).alias("nth"), F.col("d.key").alias("key"), F.col("d.start").alias("start"), (F.coalesce(stop, F.col("ids")) - F.col("d.start") - head).alias("n_tokens"), stop.isNotNull().alias("closed")
    )


def counted_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: key and n_tokens, found in flat files that are written below the shared folder."""
    out = scratch_path(docs.sparkSession, "flat")
    write_flat(docs, out, key, text)
    return scan(docs.sparkSession, out).select(F.col("key").alias(key), "n_tokens")
