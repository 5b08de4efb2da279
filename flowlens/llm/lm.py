"""LM scoring: a causal self-attention model over subword ids, and a word model as its base.

Base: add-one smoothed word counts. Words are counted over all learning texts; the most frequent
``HEAD_WORDS`` are looked up where the text is (a broadcast of that bound), all others are joined
to the counts by a shuffle of (text, word, occurrences).

Model: subword ids of a public byte-level BPE file, over the text with A-Z lower-cased and an end
id. One attention layer predicts a class, and the id within its class comes from smoothed counts
after the class of the id before, so probabilities of all ids sum to one. The most frequent ids are classes of their own, the
others are dealt to classes by rank. Windows of ``WINDOW`` inputs overlap by ``WINDOW - STEP``;
each id is scored once, with at least that overlap as context, many windows at a time under one
causal mask. Texts are tokenised once, into a table. Ids, and ids after the class of the id before, are
counted there over all whole learning texts (sums of at most vocabulary x 65 counts). The weights
are trained in numpy where the texts are, on every window of all whole learning texts, each in one of
``ROUNDS`` rounds. In a round every task takes steps on its own windows from the same weights, and the
weights are averaged, each task's by its number of windows. The driver sees the averages alone, and a
round takes as long as a task, however many there are.

Defined results: null text is empty: one end token; repeated rows and null ids are scored each for
itself; without learning texts counts are 0 and the model is uniform. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from flowlens.llm.common import LOWER, SPACED, chunks, mixed, split_words, text_bytes
from flowlens.llm.tokens import encoded, encoded_texts, tokenizer_path
from flowlens.session import scratch_path

HEAD_WORDS = 1 << 17
#: Parts that the windows of a round are dealt to by hash; a round goes through all of them, so that a step mixes texts.
SHARE = 128
ROUNDS = 2
STEP_WINDOWS = 128
#: Weights that travel in one row.
WEIGHTS = 8192
HELD_IDS = 1_000_000
#: Bytes of texts whose distinct pieces are encoded together.
CODED_BYTES = 4_000_000
VOCABULARY = 50_257
END = 50_256
BEGIN = 50_257
WINDOW, STEP = 32, 24
DIM, HIDDEN = 8, 16
OWN_CLASSES, SHARED_CLASSES = 48, 16
BATCH = 256
EPOCHS = 3
CENTRE = 4.0
#: Bound of scores and logits, so that their exponentials stay finite.
TOP = 60.0
END_WORD = b" "


def places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, number in the text) of the windows over texts ``y[at[i]:at[i + 1]]``."""
    count = -(-np.diff(at) // STEP)
    text = np.repeat(np.arange(len(count)), count)
    return text, np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)


def windows(y: np.ndarray, at: np.ndarray, text: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets or -1) of some windows."""
    t = nth[:, None] * STEP - (WINDOW - STEP) + np.arange(WINDOW)
    first, n = at[:-1][text][:, None], np.diff(at)[text][:, None]
    last = max(len(y) - 1, 0)
    u = np.where(t >= 1, y[np.minimum(first + np.maximum(t - 1, 0), last)].astype(np.int64), BEGIN)
    t = t[:, WINDOW - STEP :]
    return u, np.where(t < n, y[np.minimum(first + np.maximum(t, 0), last)].astype(np.int64), -1)


@dataclass
class Attention:
    cls: np.ndarray  # id -> class
    # log10 probability of an id within its class, after the class of the id before (the last row: a text's begin):
    column: np.ndarray  # id -> column of ``seen``, -1 for an id without any count
    seen: np.ndarray
    whole: np.ndarray  # ids without counts: id -> log10 of its share of the class
    rest: np.ndarray  # (class before, class) -> log10 of what these ids share
    p: dict[str, np.ndarray]

    def within(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        column = self.column[ids]
        out = self.seen[before, column].astype(float)
        new = np.flatnonzero(column < 0)
        out[new] = self.whole[ids[new]] + self.rest[before[new], self.cls[ids[new]]]
        return out

    @property
    def before(self) -> np.ndarray:
        return np.append(self.cls, OWN_CLASSES + SHARED_CLASSES)

    def inputs(self, y: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(inputs, targets or -1, text) of the windows over texts ``y[at[i]:at[i + 1]]``."""
        text, nth = places(at)
        return *windows(y, at, text, nth), text

    def log10(self, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log10 probability of each text."""
        text, nth = places(at)
        out = np.zeros(len(at) - 1)
        for a in range(0, len(text), BATCH):
            u, target = windows(y, at, text[a : a + BATCH], nth[a : a + BATCH])
            z = forward(self.p, u)[-1]
            t = target.ravel()
            own = np.flatnonzero(t >= 0)
            t = t[own]
            picked = z[own, self.cls[t]]
            np.exp(z, out=z)
            before = self.before[u[:, WINDOW - STEP :].ravel()[own]]
            score = (picked - np.log((z @ ONES)[own])) / np.log(10) + self.within(before, t)
            out += np.bincount(text[a : a + BATCH][own // STEP], score, len(out))
        return out


ONES = np.ones(OWN_CLASSES + SHARED_CLASSES, np.float32)
#: Inputs of a window that each scored place may see, as an addend.
MASK = np.where(np.arange(WINDOW) <= np.arange(WINDOW - STEP, WINDOW)[:, None], 0, -np.inf).astype(np.float32)


def forward(p: dict[str, np.ndarray], ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """(inputs, their queries, keys and values, weights, sums of the weights, weighted values, places, hidden, logits) of windows."""
    x = np.take(p["e"], ids, axis=0)
    x += p["pos"]
    qkv = (x.reshape(-1, DIM) @ np.concatenate([p["q"], p["k"], p["v"]], axis=1)).reshape(*ids.shape, 3 * DIM)
    w = qkv[:, WINDOW - STEP :, :DIM] @ qkv[:, :, DIM : 2 * DIM].transpose(0, 2, 1)
    np.clip(w, -TOP, TOP, out=w)
    w += MASK
    np.exp(w, out=w)
    total = w @ np.ones((WINDOW, 1), np.float32)
    o = w @ qkv[:, :, 2 * DIM :]
    o /= total
    r = (o + x[:, WINDOW - STEP :]).reshape(-1, DIM)
    h = r @ p["w1"]
    h += p["b1"]
    np.maximum(h, 0, out=h)
    z = h @ p["w2"]
    z += p["b2"]
    np.clip(z, -TOP, TOP, out=z)
    return x, qkv, w, total, o, r, h, z


def untrained() -> Attention:
    cls = np.arange(VOCABULARY) % (OWN_CLASSES + SHARED_CLASSES)
    return _assembled(cls, np.zeros((OWN_CLASSES + SHARED_CLASSES + 1, VOCABULARY), np.float32), np.random.default_rng(3), 0.0)


def _assembled(cls: np.ndarray, counts: np.ndarray, rng: np.random.Generator, scale: float) -> Attention:
    classes = OWN_CLASSES + SHARED_CLASSES
    total = np.bincount(cls, counts.sum(axis=0) + 1, classes)
    # Counts after each class, drawn towards the counts of the class as a whole by the weight of CENTRE occurrences.
    whole = (counts.sum(axis=0) + 1) / total[cls]
    by_class = np.stack([np.bincount(cls, own, classes) for own in counts])
    ids = np.flatnonzero(counts.sum(axis=0) > 0)
    column = np.full(VOCABULARY, -1)
    column[ids] = np.arange(len(ids))
    seen = np.log10((counts[:, ids] + CENTRE * whole[ids]) / (by_class[:, cls[ids]] + CENTRE))
    seen = np.concatenate([seen, np.zeros((len(seen), 1))], axis=1).astype(np.float32)  # what column -1 reads
    shape = {"e": (VOCABULARY + 1, DIM), "pos": (WINDOW, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "v": (DIM, DIM), "w1": (DIM, HIDDEN), "b1": (HIDDEN,), "w2": (HIDDEN, classes), "b2": (classes,)}
    p = {name: (rng.normal(0, scale * (0.5 if name == "e" else 0.3), s) if scale else np.zeros(s)).astype(np.float32) for name, s in shape.items()}
    if scale:
        p["b2"] = np.log(total / total.sum()).astype(np.float32)
    return Attention(cls, column, seen, np.log10(whole), np.log10(CENTRE / (by_class + CENTRE)), p)


def classes_of(counts: np.ndarray) -> np.ndarray:
    """id -> class, by rank of its count."""
    rank = np.empty(VOCABULARY, np.int64)
    rank[np.lexsort((np.arange(VOCABULARY), -counts))] = np.arange(VOCABULARY)
    # Ranks beyond the own classes double in number from class to class.
    steps = np.geomspace(OWN_CLASSES + 8, VOCABULARY, SHARED_CLASSES)
    return np.where(rank < OWN_CLASSES, rank, OWN_CLASSES + np.minimum(np.searchsorted(steps, rank, "right"), SHARED_CLASSES - 1))


def cells(y: np.ndarray, at: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Class before x vocabulary + id, of each id of texts ``y[at[i]:at[i + 1]]``, none of them empty."""
    prior = np.empty(len(y), np.int64)
    prior[1:] = before[y[:-1]]
    prior[at[:-1]] = OWN_CLASSES + SHARED_CLASSES
    return prior * VOCABULARY + y


def train(texts: list[np.ndarray], seed: int = 3) -> Attention:
    """A model fitted to all windows of id sequences."""
    if not texts:
        return untrained()
    rng = np.random.default_rng(seed)
    y = np.concatenate(texts).astype(np.int64)
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    cls = classes_of(np.bincount(y, minlength=VOCABULARY))
    after = np.bincount(cells(y, at, cls), minlength=(OWN_CLASSES + SHARED_CLASSES + 1) * VOCABULARY).reshape(-1, VOCABULARY)
    model = _assembled(cls, after, rng, 1.0)
    u, target, _ = model.inputs(y, at)
    orders = (rng.permutation(len(u)) for _ in range(EPOCHS))
    return trained(model, ((u[own], target[own]) for order in orders for own in (order[a : a + BATCH] for a in range(0, len(order), BATCH))))


def trained(model: Attention, batches: Iterable[tuple[np.ndarray, np.ndarray]]) -> Attention:
    """The model after a step of Adam on the cross entropy of the classes for each of (inputs, targets)."""
    p = model.p
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    n = 0

    def step(name: str, rows: slice | np.ndarray, d: np.ndarray, n: int) -> None:
        m, vv = (x[rows] for x in moments[name])
        m, vv = m + 0.1 * (d - m), vv + 0.01 * (d * d - vv)
        moments[name][0][rows], moments[name][1][rows] = m, vv
        p[name][rows] -= (0.01 * (m / (1 - 0.9**n)) / (np.sqrt(vv / (1 - 0.99**n)) + 1e-8)).astype(np.float32)

    for ids, t in batches:
        x, qkv, w, total, o, r, h, g = forward(p, ids)
        t = t.ravel()
        known = np.flatnonzero(t >= 0)
        share = np.float32(1 / max(1, len(known)))
        np.exp(g, out=g)
        scale = np.zeros(len(t), np.float32)
        scale[known] = share / (g @ ONES)[known]
        g *= scale[:, None]
        g[known, model.cls[t[known]]] -= share
        dh = g @ p["w2"].T
        dh *= h > 0
        dr = (dh @ p["w1"].T).reshape(o.shape)
        # the weights are not divided by their sums, so the gradients that meet them are
        do = dr / total
        ds = do @ qkv[:, :, 2 * DIM :].transpose(0, 2, 1)
        ds -= np.einsum("bij,bij->bi", do, o)[:, :, None]
        ds *= w
        d = np.zeros_like(qkv)
        d[:, WINDOW - STEP :, :DIM] = ds @ qkv[:, :, DIM : 2 * DIM]
        d[:, :, DIM : 2 * DIM] = ds.transpose(0, 2, 1) @ qkv[:, WINDOW - STEP :, :DIM]
        d[:, :, 2 * DIM :] = w.transpose(0, 2, 1) @ do
        flat = lambda m: m.reshape(-1, m.shape[-1])
        mix = np.concatenate([p["q"], p["k"], p["v"]], axis=1)
        dx = (flat(d) @ mix.T).reshape(x.shape)
        dx[:, WINDOW - STEP :] += dr
        dq, dk, dv = np.split(flat(x).T @ flat(d), 3, axis=1)
        grad = {"pos": dx.sum(axis=0), "q": dq, "k": dk, "v": dv, "w1": r.T @ dh, "b1": dh.sum(axis=0), "w2": h.T @ g, "b2": g.sum(axis=0)}
        n += 1
        for name, d in grad.items():
            step(name, slice(None), d, n)
        # of the table only the rows of the step's ids move
        order = np.argsort(ids.ravel().astype(np.uint16), kind="stable")
        own = ids.ravel()[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        step("e", own[first], np.add.reduceat(np.take(flat(dx), order, axis=0), first, axis=0), n)
    return model


def _lowered(text: str | None) -> str | None:
    return LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes().decode() if text else text


def _ids(text: str | None, file: str) -> np.ndarray:
    return np.append(encoded(_lowered(text), file), np.uint32(END))


def _table(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, c) over all texts, each with one end word; words are bytes."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        held_rows = 0

        def merged() -> pa.RecordBatch:
            table = pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).combine_chunks()
            held.clear()
            return pa.RecordBatch.from_arrays([table.column("word").combine_chunks().cast(pa.binary()), table.column("c_sum").combine_chunks()], ["word", "c"])

        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for i, j in chunks(offsets):
                at = offsets[i : j + 1]
                found = pc.value_counts(split_words(raw[at[0] : at[-1]], at - at[0], SPACED).array())
                held.append(pa.table({"word": found.field("values"), "c": found.field("counts")}))
                held.append(pa.table({"word": pa.array([END_WORD], pa.large_binary()), "c": pa.array([j - i], pa.int64())}))
                held_rows += len(found)
            if held_rows > 1_500_000:
                yield merged()
                held_rows = 0
        if held:
            yield merged()

    return texts.select(F.col(text).cast("string")).mapInArrow(counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _coded(docs: DataFrame, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(__text, keep, __ids, __row) of each row, as a table: 16-bit subword ids with the end id, and a row number."""
    file = tokenizer_path()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_bytes(batch.column(0))
            for i, j in chunks(offsets, CODED_BYTES):
                at = offsets[i : j + 1]
                y, to = encoded_texts(LOWER[raw[at[0] : at[-1]]], at - at[0], file)
                y = np.insert(y, to[1:], END).astype("<u2")
                cuts = 2 * (to + np.arange(j - i + 1))
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(y)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(i, j - i) for c in batch.columns), ids], [*batch.schema.names, "__ids"])
            pa.default_memory_pool().release_unused()

    types = "".join(f"`{c}` {dict(docs.dtypes)[c]}, " for c in keep)
    done = docs.select(F.col(text).cast("string").alias("__text"), *keep).mapInArrow(coded, f"__text string, {types}__ids binary")
    return _table(done.withColumn("__row", F.monotonically_increasing_id()), "coded", "zstd")


def _sequences(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts back to back, their offsets)."""
    ids = ids.cast(pa.large_binary())
    _, offsets, data = ids.buffers()
    at = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw.view("<u2"), (at - at[0]) // 2


def _sequences_of(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, ids, offsets) of chunk after chunk of a batch that begins with the ids."""
    y, at = _sequences(batch.column(0))
    for i, j in chunks(at):
        yield i, j, y[at[i] : at[j]].astype(np.int64), at[i : j + 1] - at[i]


def _summed(coded: DataFrame, places_of: Callable[[np.ndarray, np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """How often each of ``size`` numbers occurs among ``places_of(ids, offsets)`` of all texts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(size, np.int64), [], 0
        for batch in batches:
            for _, _, y, at in _sequences_of(batch):
                held.append(places_of(y, at))
                n += len(held[-1])
                if n > HELD_IDS:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=size)
        found = np.flatnonzero(total)
        for a in range(0, len(found), 1 << 17):
            own = found[a : a + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(total[own])], ["i", "c"])

    table = coded.select("__ids").mapInArrow(counted, "i int, c long").groupBy("i").agg(F.sum("c").alias("c")).toArrow()
    out = np.zeros(size, np.int64)
    out[table.column("i").to_numpy()] = table.column("c").to_numpy()
    return out


def _flat(p: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def dealt(row: np.ndarray, at: np.ndarray, first: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, number in the text) of the windows of some of all SHARE x ROUNDS parts, in order of their parts.

    Every window has one part, by a hash of row number and place.
    """
    text, nth = places(at)
    part = mixed(mixed(row.astype(np.uint64), 1)[text] ^ nth.astype(np.uint64), 2) % np.uint64(SHARE * ROUNDS)
    own = np.flatnonzero((part >= first) & (part < first + parts))
    own = own[np.argsort(part[own].astype(np.uint16), kind="stable")]
    return text[own], nth[own]


def drawn(row: np.ndarray, y: np.ndarray, at: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, targets) of the windows of one part."""
    return windows(y, at, *dealt(row, at, turn, 1))


def steps_of(batches: Iterable[pa.RecordBatch], turn: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(inputs, targets) of step after step of a round over batches of (ids, row): all rounds have every window once."""
    u, t = np.empty((0, WINDOW), np.int64), np.empty((0, STEP), np.int64)
    for batch in batches:
        for i, j, y, at in _sequences_of(batch):
            text, nth = dealt(batch.column(1).slice(i, j - i).to_numpy(), at, turn * SHARE, SHARE)
            a = 0
            while a < len(text):
                b = a + STEP_WINDOWS - len(u)
                more = windows(y, at, text[a:b], nth[a:b])
                u, t, a = np.concatenate([u, more[0]]), np.concatenate([t, more[1]]), b
                if len(u) == STEP_WINDOWS:
                    yield u, t
                    u, t = u[:0], t[:0]
    if len(u):
        yield u, t


def averaged(coded: DataFrame, model: Attention) -> Attention:
    """The model after ``ROUNDS`` rounds of steps in all tasks and averages of their weights."""
    for turn in range(ROUNDS):
        shared = coded.sparkSession.sparkContext.broadcast((model.cls, model.p))

        def stepped(batches: Iterator[pa.RecordBatch], turn: int = turn, shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            cls, start = shared.value
            own = Attention(cls, None, None, None, None, {k: v.copy() for k, v in start.items()})
            n = 0

            def steps() -> Iterator[tuple[np.ndarray, np.ndarray]]:
                nonlocal n
                for u, t in steps_of(batches, turn):
                    n += len(u)
                    yield u, t

            flat = _flat(trained(own, steps()).p).astype(np.float64) * n
            if n:
                cuts = range(0, len(flat), WEIGHTS)
                yield pa.RecordBatch.from_arrays([pa.array(range(len(cuts)), pa.int32()), pa.array([n] * len(cuts), pa.int64()), pa.array([flat[a : a + WEIGHTS].tobytes() for a in cuts], pa.binary())], ["k", "n", "w"])

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, list] = {}
            for batch in batches:
                for k, n, w in zip(*(c.to_pylist() for c in batch.columns)):
                    own = total.setdefault(k, [0, 0.0])
                    own[0], own[1] = own[0] + n, own[1] + np.frombuffer(w)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([n for n, _ in total.values()], pa.int64()), pa.array([w.tobytes() for _, w in total.values()], pa.binary())], ["k", "n", "w"])

        kind = "k int, n long, w binary"
        rows = coded.select("__ids", "__row").mapInArrow(stepped, kind).repartition("k").mapInArrow(summed, kind).orderBy("k").collect()
        if rows:
            model.p = _unflat(np.concatenate([np.frombuffer(r.w) for r in rows]) / rows[0].n, model.p)
        shared.unpersist()
    return model


def fitted(coded: DataFrame, seed: int = 3) -> Attention:
    """A model of all rows of a coded table: counts of every id, weights from every window."""
    counts = _summed(coded, lambda y, at: y, VOCABULARY)
    if not counts.any():
        return untrained()
    rng = np.random.default_rng(seed)
    cls = classes_of(counts)
    small = cls.astype(np.int8)
    after = _summed(coded, lambda y, at: cells(y, at, small), (OWN_CLASSES + SHARED_CLASSES + 1) * VOCABULARY)
    model = _assembled(cls, after.reshape(-1, VOCABULARY), rng, 1.0)
    return averaged(coded, model)


def fit(learning: DataFrame, key: str, text: str) -> Attention:
    """A model of all learning texts."""
    return fitted(_coded(learning.select(key, text), text))


def score(docs: DataFrame, learning: DataFrame | str, key: str = "doc_id", text: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """(key, extra, n_tokens, n_known, train_tokens, base_score, score) of each row of ``docs``, learning from ``learning``.

    ``learning`` may be a condition on key and extra: its rows of ``docs`` are then tokenised once for both purposes.
    """
    spark = docs.sparkSession
    columns = [key, *extra]
    coded = _coded(docs, text, tuple(columns))
    learned = coded.where(learning) if isinstance(learning, str) else _coded(learning, text)
    counts = _table(word_counts(learned, "__text"), "words")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = counts.where(F.col("word") != F.lit(END_WORD)).orderBy(F.desc("c"), "word").limit(HEAD_WORDS).toArrow().combine_chunks()
    ends = (counts.where(F.col("word") == F.lit(END_WORD)).first() or {"c": 0})["c"]
    model = fitted(learned)
    shared = spark.sparkContext.broadcast((head.column("word").combine_chunks().cast(pa.large_binary()) if head.num_rows else pa.array([], pa.large_binary()), head.column("c").to_numpy(), model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, c, attention = shared.value
        logs = np.log10(c + 1.0)
        for batch in batches:
            texts = batch.column(0)
            raw, offsets = text_bytes(texts)
            for i, j in chunks(offsets):
                at = offsets[i : j + 1]
                own = split_words(raw[at[0] : at[-1]], at - at[0], SPACED)
                coded = own.array().dictionary_encode()
                place = pc.fill_null(pc.index_in(coded.dictionary, words), -1).to_numpy().astype(np.int64)
                number = coded.indices.to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(j - i), own.counts)
                known = place[number] >= 0 if len(number) else np.zeros(0, bool)
                base = np.bincount(doc[known], logs[place[number[known]]], j - i)
                seen = np.bincount(doc[known], minlength=j - i)
                base, seen = base + np.log10(ends + 1.0), seen + (ends > 0)
                # Each other word of a text once, with its occurrences.
                pair, times = np.unique(doc[~known] * max(1, len(coded.dictionary)) + number[~known], return_counts=True)
                rare = coded.dictionary.take(pa.array(pair % max(1, len(coded.dictionary)))).cast(pa.binary())
                cut = pa.array(np.searchsorted(pair, np.arange(j - i + 1) * max(1, len(coded.dictionary))).astype(np.int32))
                y, ptr = _sequences(batch.column(1).slice(i, j - i))
                rest = [batch.column(k).slice(i, j - i) for k in range(2, batch.num_columns)]
                yield pa.RecordBatch.from_arrays(
                    [*rest, pa.array(own.counts + 1, pa.int64()), pa.array(seen, pa.int64()), pa.array(base, pa.float64()), pa.array(attention.log10(y, ptr)), pa.ListArray.from_arrays(cut, rare), pa.ListArray.from_arrays(cut, pa.array(times, pa.int64()))],
                    [*batch.schema.names[2:], "n_tokens", "n_known", "base", "score", "rare", "times"],
                )
            pa.default_memory_pool().release_unused()

    types = ", ".join(f"`{c}` {dict(docs.dtypes)[c]}" for c in columns)
    done = coded.select("__text", "__ids", *columns).mapInArrow(scored, f"{types}, n_tokens long, n_known long, base double, score double, rare array<binary>, times array<long>")
    done = _table(done.withColumn("__row", F.monotonically_increasing_id()), "scored")
    pairs = done.where("size(rare) > 0").select("__row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("__row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    # A word that is not in the counts adds log10(0 + 1) = 0.
    found = pairs.join(counts, "word").groupBy("__row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("logs"))
    total = float(np.log10(n + v + 1))
    out = done.drop("rare", "times").join(found, "__row", "left")
    return out.select(
        *columns, "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(total)).alias("base_score"), "score"
    )
