"""Language identification: a byte convolutional network over fixed-length windows.

Bytes become small vectors; filters of several widths run over them; each filter's maximum over
a window goes into a softmax over the learned languages. The network is trained in numpy on a
bounded sample of labelled rows: per language at most ``PER_LANG`` rows, those with the smallest
hash of their id, of a repeated id the first text of each before any second one; of each row at
most ``WINDOWS_PER_TEXT`` windows, chosen by hash over its whole length. A text is judged by all its windows of ``WINDOW`` bytes: the mean of their
probabilities, weighted by their bytes.

Defined results: null text or text without a letter: ``und``, score 0. Labels that are null are
not learned from; without any label every text is ``und``. Rows are judged each for itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from flowlens.llm.common import mixed, text_bytes, with_results

WINDOW = 256
BATCH = 128
WIDTHS = (2, 3, 4, 5)
DIM = 8
FILTERS = 10
PARTS = 64
PER_LANG = 300
WINDOWS_PER_TEXT = 4
EPOCHS = 5
UNKNOWN = "und"
PAD = 256  # the symbol after a text's last byte


@dataclass
class Network:
    langs: list[str]
    table: np.ndarray  # symbol -> vector
    kernel: np.ndarray  # (widest * DIM, filters); narrower filters are zero beyond their width
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def features(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rectified maximum, its place) of each filter in each window."""
        n, size = windows.shape
        wide = len(self.kernel) // DIM
        flat = self.table[windows].reshape(n, size * DIM)
        strides = flat.strides
        seen = np.lib.stride_tricks.as_strided(flat, (n, size - wide + 1, wide * DIM), (strides[0], strides[1] * DIM, strides[1]))
        hidden = np.ascontiguousarray(seen).reshape(-1, wide * DIM) @ self.kernel
        hidden = hidden.reshape(n, size - wide + 1, -1)
        return hidden.max(axis=1) + self.bias, hidden.argmax(axis=1) if self.training else np.empty(0)

    training = False

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        top, _ = self.features(windows)
        z = np.maximum(top, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, bytes, text) of the windows that tile the texts; the last of a text may be shorter."""
    size = np.diff(offsets)
    count = -(-size // WINDOW)
    text = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    return offsets[:-1][text] + nth * WINDOW, np.minimum(WINDOW, size[text] - nth * WINDOW), text


def cut_windows(raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    place = np.arange(WINDOW)
    at = np.minimum(first[:, None] + place, max(len(raw) - 1, 0))
    return np.where(place < size[:, None], raw[at].astype(np.int16), PAD)


def train(texts: list[str], langs: list[str], seed: int = 5) -> Network:
    """A network fitted to windows of labelled texts."""
    cut = _training_windows(pa.array(texts, pa.string()))
    return train_windows([w for own in cut for w in own], [x for own, x in zip(cut, langs, strict=True) for _ in own], seed)


def train_windows(cut: list[bytes], langs: list[str], seed: int = 5) -> Network:
    """A network fitted to labelled windows, by Adam on the cross entropy."""
    names = sorted(set(langs))
    rng = np.random.default_rng(seed)
    raw, size = np.frombuffer(b"".join(cut), np.uint8), np.array([len(w) for w in cut])
    first = np.cumsum(size) - size
    target = np.array([names.index(x) for x in langs])
    wide, n_filters = max(WIDTHS), FILTERS * len(WIDTHS)
    mask = np.concatenate([np.repeat((np.arange(wide) < w).astype(np.float32), DIM)[:, None].repeat(FILTERS, 1) for w in WIDTHS], axis=1)
    net = Network(
        names,
        rng.normal(0, 0.5, (257, DIM)).astype(np.float32),
        rng.normal(0, 0.3, (wide * DIM, n_filters)).astype(np.float32) * mask,
        np.zeros(n_filters, np.float32),
        rng.normal(0, 0.3, (n_filters, len(names))).astype(np.float32),
        np.zeros(len(names), np.float32),
    )
    net.table[PAD] = 0
    net.training = True
    params = [net.table, net.kernel, net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    weight = 1 / np.bincount(target, minlength=len(names)).clip(1)
    weight = (weight / weight[target].mean()).astype(np.float32)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(target))
        for k in range(0, len(order), 64):
            own = order[k : k + 64]
            w = cut_windows(raw, first[own], size[own])
            top, place = net.features(w)
            act = np.maximum(top, 0)
            z = act @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            dz = p
            dz[np.arange(len(own)), target[own]] -= 1
            dz *= weight[target[own]][:, None] / len(own)
            da = (dz @ net.out.T) * (top > 0)
            # Only the window place of each maximum takes part.
            at = place[:, :, None] + np.arange(wide)
            symbols = w[np.arange(len(own))[:, None, None], at]
            seen = net.table[symbols].reshape(len(own), n_filters, wide * DIM)
            dk = np.einsum("bf,bfk->kf", da, seen) * mask
            ds = (da[:, :, None] * net.kernel.T[None]).reshape(len(own), n_filters, wide, DIM)
            dt = np.zeros_like(net.table)
            np.add.at(dt, symbols, ds)
            dt[PAD] = 0
            step += 1
            for param, (m, v), g in zip(params, moments, (dt, dk, da.sum(axis=0), act.T @ dz, dz.sum(axis=0)), strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                param -= (0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    net.training = False
    return net


def _training_windows(texts: pa.Array) -> list[list[bytes]]:
    """Of each text the windows of the whole text with the smallest hashes of place and content, ``WINDOWS_PER_TEXT`` at most."""
    out: list[list[bytes]] = []
    raw, offsets = text_bytes(texts)
    for i in range(len(texts)):
        own = raw[offsets[i] : offsets[i + 1]]
        seed = np.uint64(zlib.crc32(own.tobytes()))
        h = mixed(mixed(np.arange(-(-len(own) // WINDOW), dtype=np.uint64), 1) ^ seed, 2)
        out.append([own[k * WINDOW : (k + 1) * WINDOW].tobytes() for k in np.sort(np.argsort(h)[:WINDOWS_PER_TEXT]).tolist()])
    return out


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Network | None:
    """A network from at most ``per_lang`` rows of each language; None without labels."""
    text_, lang_ = F.col(text).cast("string"), F.col(lang).cast("string")
    rows = labelled.select(F.col(key).alias("id"), lang_.alias("lang"), text_.alias("text")).where("lang is not null and id is not null and text rlike '\\\\p{L}'")
    rows = rows.withColumn("h", F.xxhash64(F.col("id").cast("string"))).withColumn("t", F.xxhash64("text"))
    # A repeated id gives its second text when every id has given its first one. At most per_lang rows of a language leave a task.
    # A language's best rows are found among those of its parts, so that its rows are not one task's.
    of_id = Window.partitionBy("lang", "id").orderBy("t")
    of_part, of_lang = (Window.partitionBy("lang", *part).orderBy("again", "h", "id", "t") for part in (["part"], []))
    ids = rows.select("lang", "id", "h", "t").withColumn("again", F.row_number().over(of_id)).where(F.col("again") <= per_lang)
    ids = ids.withColumn("part", F.pmod("h", F.lit(PARTS))).withColumn("nth", F.row_number().over(of_part)).where(F.col("nth") <= per_lang)
    ids = ids.withColumn("nth", F.row_number().over(of_lang)).where(F.col("nth") <= per_lang).select("lang", "id", "t").distinct()

    @F.arrow_udf("array<binary>")
    def cut(texts: pa.Array) -> pa.Array:
        return pa.array(_training_windows(texts), pa.list_(pa.binary()))

    # Exact copies of a row leave a task once; the texts themselves stay there.
    chosen = rows.join(F.broadcast(ids), ["lang", "id", "t"], "left_semi").select("lang", "id", "t", cut(F.col("text")).alias("w"))
    sample = sorted(chosen.distinct().collect(), key=lambda r: (r["lang"], r["id"], r["t"]))
    return train_windows([w for r in sample for w in r["w"]], [r["lang"] for r in sample for _ in r["w"]]) if sample else None


def _predictor(broadcast) -> Callable[[Column], Column]:  # noqa: ANN001
    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        net = broadcast.value
        raw, offsets = text_bytes(texts)
        first, size, text = windows_of(raw, offsets)
        total = np.zeros((len(texts), len(net.langs)))
        for k in range(0, len(first), BATCH):
            own = slice(k, k + BATCH)
            np.add.at(total, text[own], net.probabilities(cut_windows(raw, first[own], size[own])) * size[own, None])
        score = total / np.maximum(np.diff(offsets), 1)[:, None]
        best = score.argmax(axis=1)
        return pa.StructArray.from_arrays([pa.array([net.langs[i] for i in best.tolist()]), pa.array(score[np.arange(len(best)), best].clip(0, 1))], ["lang", "score"])

    return predict.asNondeterministic()


def predict(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, score; a result replaces a column of its name."""
    letters = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    if net is None:
        return with_results(docs, {"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    run = _predictor(docs.sparkSession.sparkContext.broadcast(net))
    df = docs.withColumn("__lang", run(F.when(letters, F.col(text).cast("string"))))
    found = F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))
    return with_results(df, {"lang_pred": F.when(found, F.col("__lang.lang")).otherwise(UNKNOWN), "score": F.when(found, F.col("__lang.score")).otherwise(0.0)}).drop("__lang")


def known_language(docs: DataFrame, net: Network | None, least: float, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of at least ``least``; all rows without a network."""
    if net is None:
        return docs
    names = [F.col(f"`{c}`") for c in docs.columns]
    judged = predict(docs.select(F.struct(*names).alias("__row"), F.col(text).alias("__text")), net, "__text")
    return judged.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("__row.*")
