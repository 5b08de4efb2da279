"""Spelling variants: words of a corpus, their near words (one edit) and the form that a rare spelling stands for.

``word_counts`` counts words over whole texts. ``near_words`` searches a vocabulary in itself: words that can
be one edit apart meet in blocks, and in each block a bit-sliced position index (one bitset over the block's
words per position and letter) is read by every word of the block at once: word-parallel recurrences carry
the set of words without error and, with positions shifted by nothing, one ahead or one behind, the sets with
one error. ``forms`` follows the chosen forms to their roots.

Blocks. Let m be the length of the shorter word of a pair one edit apart. Its letters agree with the other
word's in front and at the end except for at most one, so either the first half of a stretch agrees or the
second half does. A block (m, a, b) holds the words of m or m + 1 letters that share a letters in front and
b at the end; it is halved into (m, a + g, b) and (m, a, b + r - g) with r = m - a - b, g = r // 2. Blocks of
more than ``MOST`` words are halved again, down to r = 1, where the free letters bound them. No pair is lost
and each is counted once: the length of its common prefix tells the one half that it belongs to.

Defined results: null text: no words; a null id counts as '' in the deletion rule; repeated rows count again;
no words: no rows; ties between forms go to the smaller word in code-point order; other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from flowlens.operators.scale import materialize

LEAST_LETTERS = 7
LEAST_COUNT = 2
#: A form occurs at least so many times as often as its variant.
TIMES = 10
#: Of the runs, one in so many loses a letter before it is counted.
NOISE = 31
#: Blocks of more words are halved again.
MOST = 4096
#: Words of a task's small blocks that share one index.
BATCH = 1024
#: Letters of one index, counted as words times the longest of them.
BATCH_LETTERS = 1_000_000
#: Distinct words that a task counts before it passes them on.
HELD = 200_000

RUN = re.compile("[a-zÀ-ÿ]{%d,}" % LEAST_LETTERS)


def _noisy(run: str, crc: int) -> str:
    h = zlib.crc32(run.encode(), crc)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n) of all words with at least ``LEAST_LETTERS`` letters and ``LEAST_COUNT`` occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words, n = list(held), list(held.values())
            held.clear()
            return pa.record_batch([pa.array(words, pa.string()), pa.array(n, pa.int64())], ["word", "n"])

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                # bytes.lower changes A-Z alone
                runs = Counter(RUN.findall(t.as_py().encode().lower().decode())) if t.is_valid else {}
                crc = zlib.crc32(f"{'' if k is None else k}:".encode()) if runs else 0
                for run, n in runs.items():
                    word = _noisy(run, crc)
                    if len(word) >= LEAST_LETTERS:
                        held[word] += n
                if len(held) >= HELD:
                    yield out()
        yield out()

    rows = docs.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").cast("string").alias("t"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _halved(df: DataFrame) -> DataFrame:
    """Every row once in each half of its block."""
    r = F.col("m") - F.col("a") - F.col("b")
    g = F.floor(r / 2).cast("int")
    front = F.struct((F.col("a") + g).alias("a"), F.col("b"))
    back = F.struct(F.col("a"), (F.col("b") + r - g).alias("b"))
    return df.withColumn("__half", F.explode(F.array(front, back))).withColumns({"a": F.col("__half.a"), "b": F.col("__half.b")}).drop("__half")


def _block() -> Column:
    size = F.char_length("word")
    return F.concat_ws(" ", "m", "a", F.substring(F.col("word"), F.lit(1), F.col("a")), F.substring(F.col("word"), size - F.col("b") + 1, F.col("b")))


def blocks(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, m, a, b, block): every word in the blocks that it is compared in, two for either value of m at first."""
    size = F.char_length("word")
    lengths = F.filter(F.array(size - 1, size), lambda m: m >= 1)
    rows = words.select("word", "n", F.explode(lengths).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    done: DataFrame | None = None
    while True:
        rows = _halved(rows).withColumn("block", _block()).withColumn("__h", F.xxhash64("block"))
        # counted by hash: blocks that share one may be halved without need, which changes no result
        sizes = rows.groupBy("__h").agg(F.count(F.lit(1)).alias("__n"), F.max(F.col("m") - F.col("a") - F.col("b")).alias("__r"))
        big = materialize(sizes.where((F.col("__n") > most) & (F.col("__r") > 1)).select("__h"))
        last = big.isEmpty()
        small = (rows if last else rows.join(big, "__h", "left_anti")).drop("__h")
        done = small if done is None else done.unionByName(small)
        if last:
            return done
        rows = rows.join(big, "__h", "left_semi").drop("__h", "block")


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points with zeros behind, one row per word; lengths)."""
    size = np.fromiter((len(w) for w in words), np.int64, len(words))
    out = np.zeros((len(words), int(size.max()) + 1), np.uint32)
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


class PositionIndex:
    """One bitset over the words per (position, letter) that occurs."""

    def __init__(self, letters: np.ndarray, size: np.ndarray):
        word, place = np.nonzero(np.arange(letters.shape[1]) < size[:, None])
        code = place.astype(np.uint64) << np.uint64(32) | letters[word, place]
        self.codes, row = np.unique(code, return_inverse=True)
        self.width = (len(letters) + 63) // 64
        # the last row is empty: it answers for letters that never stand at a place
        self.bits = np.zeros((len(self.codes) + 1, self.width), np.uint64)
        np.bitwise_or.at(self.bits, (row, word >> 6), np.uint64(1) << (word & 63).astype(np.uint64))

    def at(self, place: int, letters: np.ndarray) -> np.ndarray:
        """The bitsets of the words that have ``letters[i]`` at ``place``, one row per i."""
        if place < 0:
            return self.bits[np.full(len(letters), -1)]
        want = np.uint64(place) << np.uint64(32) | letters.astype(np.uint64)
        row = np.searchsorted(self.codes, want)
        hit = self.codes[np.minimum(row, len(self.codes) - 1)] == want
        return self.bits[np.where(hit, row, len(self.codes))]


def bitset_rows(group: np.ndarray) -> np.ndarray:
    """Per row the bitset of the rows with the same group number."""
    width = (len(group) + 63) // 64
    sets = np.zeros((int(group.max()) + 1, width), np.uint64)
    i = np.arange(len(group))
    np.bitwise_or.at(sets, (group, i >> 6), np.uint64(1) << (i & 63).astype(np.uint64))
    return sets[group]


def one_edit(letters: np.ndarray, size: np.ndarray, index: PositionIndex, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bitsets per query word, within ``start``: words with one letter replaced, one more, one fewer.

    Queries are in order of falling length. After i letters, ``none`` holds the words whose first i letters
    are the query's; ``other`` those with one replaced; ``more`` those with one letter more, which are read one
    place ahead; ``fewer`` those with one letter fewer, read one place behind. Lengths are not compared here.
    """
    none, other, more, fewer = start.copy(), np.zeros_like(start), np.zeros_like(start), np.zeros_like(start)
    for i in range(int(size[0])):
        k = int(np.searchsorted(-size, -i, "left"))  # queries with more than i letters
        q, z = letters[:k, i], none[:k]
        here = index.at(i, q)
        fewer[:k] = (fewer[:k] & index.at(i - 1, q)) | z
        more[:k] = (more[:k] | z) & index.at(i + 1, q)
        other[:k] = (other[:k] & here) | (z & ~here)
        none[:k] = z & here
    return other, more | none, fewer


def _pairs(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    row, word = np.nonzero(bits)
    chunk = np.unpackbits(bits[row, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, bit = np.nonzero(chunk)
    return row[at], word[at] * 64 + bit


def near_pairs(words: list[str], m: np.ndarray, a: np.ndarray, b: np.ndarray, group: np.ndarray, tile: int = BATCH) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of one block whose words are one edit apart and that belong to the block; both directions."""
    letters, size = _letters(words)
    index = PositionIndex(letters, size)
    mine, lengths = bitset_rows(group), bitset_rows(size)
    by_length = {int(s): lengths[i] for i, s in enumerate(size)}
    nothing = np.zeros(index.width, np.uint64)
    out_i, out_j = [], []
    order = np.argsort(-size, kind="stable")
    for lo in range(0, len(order), tile):
        q = order[lo : lo + tile]
        other, more, fewer = one_edit(letters[q], size[q], index, mine[q])
        short = (size[q] == m[q])[:, None]
        same = np.stack([by_length[int(s)] for s in size[q]])
        longer = np.stack([by_length.get(int(s) + 1, nothing) for s in size[q]])
        shorter = np.stack([by_length.get(int(s) - 1, nothing) for s in size[q]])
        found = np.where(short, (other & same) | (more & longer), fewer & shorter)
        i, j = _pairs(found)
        out_i.append(q[i])
        out_j.append(j)
    i, j = np.concatenate(out_i), np.concatenate(out_j)
    # the one path of halves that the common prefix leads down
    prefix = (letters[i] != letters[j]).argmax(axis=1)
    u, v, want_a, want_b, least = np.zeros_like(i), np.zeros_like(i), a[i], b[i], m[i]
    ok = (want_a == 0) & (want_b == 0)
    for _ in range(64):
        r = least - u - v
        if not (r > 1).any():
            break
        g = r // 2
        front = prefix >= u + g
        u, v = np.where(front & (r > 1), u + g, u), np.where(~front & (r > 1), v + r - g, v)
        ok |= (u == want_a) & (v == want_b)
    return i[ok], j[ok]


def _compared(words: list[str], n: np.ndarray, m: np.ndarray, a: np.ndarray, b: np.ndarray, group: np.ndarray) -> pa.RecordBatch:
    """Per row with near words in its block: how many, and the most frequent one (ties: the smaller word)."""
    i, j = near_pairs(words, m, a, b, group)
    if len(i):
        rank = np.empty(len(words), np.int64)
        rank[np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)] = np.arange(len(words))
        order = np.lexsort((rank[j], -n[j], i))
        i, j = i[order], j[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    best = [words[x] for x in j[first]]
    count = np.diff(np.append(first, len(i)))
    return pa.record_batch(
        [pa.array([words[x] for x in i[first]], pa.string()), pa.array(count, pa.int64()), pa.array(best, pa.string()), pa.array(n[j[first]], pa.int64())],
        ["word", "n_near", "best", "best_n"],
    )


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their block. Small blocks share one index, none is cut; a word alone has nothing to meet."""
    batch: list[tuple[str, int, int, int, int, int]] = []
    block: list[tuple[str, int, int, int, int]] = []
    name, longest, groups = None, 0, 0

    def compared() -> pa.RecordBatch:
        words, *nums = zip(*batch)
        batch.clear()
        n, m, a, b, group = (np.array(c, np.int64) for c in nums)
        return _compared(list(words), n, m, a, b, group)

    def closed() -> Iterator[pa.RecordBatch]:
        nonlocal longest, groups
        if len(block) > 1:
            long = max(len(row[0]) for row in block)
            if batch and (len(batch) + len(block) > BATCH or (len(batch) + len(block)) * max(longest, long) > BATCH_LETTERS):
                yield compared()
                longest, groups = 0, 0
            batch.extend((*row, groups) for row in block)
            longest, groups = max(longest, long), groups + 1
        block.clear()

    for part in batches:
        for k, *row in zip(*(part.column(c).to_pylist() for c in ("block", "word", "n", "m", "a", "b"))):
            if k != name:
                yield from closed()
                name = k
            block.append(tuple(row))
    yield from closed()
    if batch:
        yield compared()


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """Per word of (word, n) with near words: their number ``n_near``, the most frequent one ``best`` and its count."""
    rows = blocks(words, most).select("block", "word", F.col("n").cast("long"), F.col("m").cast("long"), F.col("a").cast("long"), F.col("b").cast("long"))
    found = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_in_blocks, "word string, n_near long, best string, best_n long")
    # largest count first, then the smaller word
    top = F.min(F.struct((-F.col("best_n")).alias("c"), F.col("best").alias("w")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("t")).select("word", "n_near", F.col("t.w").alias("best"), (-F.col("t.c")).alias("best_n"))


def roots(links: DataFrame) -> DataFrame:
    """(word, root): the end of each chain of (word, form).

    Counts grow along a chain by ``TIMES`` at least, so it has few links, and each round doubles the links followed.
    """
    now = materialize(links.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("__from"), F.col("root").alias("__to"))
        step = materialize(now.join(on, F.col("root") == F.col("__from"), "left").select("word", F.coalesce("__to", "root").alias("root"), F.col("__to").isNotNull().alias("__moved")))
        if step.where("__moved").isEmpty():
            return now
        now = step.drop("__moved")


def forms(words: DataFrame, most: int = MOST) -> DataFrame:
    """Every row of (word, n) with its form, root, number of near words and the form's count."""
    words = materialize(words.select("word", F.col("n").cast("long").alias("n")))
    near = materialize(near_words(words, most))
    j = words.join(near, "word", "left")
    chosen = F.col("best_n") >= TIMES * F.col("n")
    j = j.select("word", "n", F.when(chosen, F.col("best")).alias("form"), F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(chosen, F.col("best_n")).alias("form_n"))
    ends = roots(j.where("form is not null").select("word", "form"))
    return j.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
