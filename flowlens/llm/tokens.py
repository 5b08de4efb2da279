"""Token ids of a public byte-level BPE file, for whole Arrow batches.

The ids equal those of ``tokenizers.Tokenizer.from_file(path)`` with ``encode_special_tokens``
and ``add_special_tokens=False``; they are computed from the same file's vocabulary with the
faster merge loop of ``tiktoken`` (a test compares both on all test documents).
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken

BYTE_BPE = "byte_bpe_50k.json"

#: First bytes of characters that are surely no white space: a space before one begins a token, whatever stands before it.
SOLID = np.zeros(256, dtype=bool)
SOLID[[*range(0x21, 0x7F), *range(0xC3, 0xE1), *range(0xE4, 0xF5)]] = True


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level BPE files write printable bytes as themselves and the others as letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def encoder(path: str) -> tiktoken.Encoding:
    """The encoder of one file, made once per Python worker."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    byte = _bytes_of_letters()
    special = {x["content"] for x in spec["added_tokens"]}
    ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_path(name: str = BYTE_BPE) -> str:
    return public_tokenizers.path(name)


def encoded(text: str | None, path: str) -> np.ndarray:
    """Ids of one text as uint32; a null is an empty text."""
    return encoder(path).encode_to_numpy(text, disallowed_special=()) if text else np.zeros(0, np.uint32)


@lru_cache(maxsize=2)
def _lengths(path: str) -> np.ndarray:
    """Bytes of each token."""
    e = encoder(path)
    return np.array([len(e.decode_single_token_bytes(i)) for i in range(e.max_token_value + 1)])


def encoded_texts(raw: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts back to back, their offsets) of texts that lie back to back in ``raw``.

    No token goes over a space that a visible character follows, so texts are cut there and each distinct piece
    is encoded once. The start of a text up to its first cut is encoded by itself.
    """
    space = np.flatnonzero(raw[:-1] == 0x20)
    cuts = space[SOLID[raw[space + 1]]]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    cuts = cuts[~(edge[cuts] | edge[cuts + 1])]
    n = len(offsets) - 1
    before = np.searchsorted(cuts, offsets)
    head = before[:-1] + np.arange(n)  # every text begins with a piece of its own, which may be empty
    starts = np.append(np.insert(cuts, before[:-1], offsets[:-1]), offsets[-1])
    heads = [encoded(raw[a:b].tobytes().decode(), path) for a, b in zip(starts[head], starts[head + 1])]
    later = np.ones(len(starts) - 1, bool)
    later[head] = False

    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(later), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(raw)])
    found = pieces.filter(pa.array(later)).dictionary_encode()
    _, ends, joined = found.dictionary.buffers()
    ends = np.frombuffer(ends, np.int64)[1 : len(found.dictionary) + 1] if len(found.dictionary) else np.zeros(0, np.int64)
    once = encoded(joined[: int(ends[-1])].to_pybytes().decode() if len(ends) else None, path)
    cut = np.searchsorted(np.cumsum(_lengths(path)[once]), ends) + 1

    number = np.empty(len(later), np.int64)
    number[later] = found.indices.to_numpy()
    number[head] = len(cut) + np.arange(n)
    at = np.concatenate([[0], cut, len(once) + np.cumsum([len(h) for h in heads], dtype=np.int64)])
    size = np.diff(at)[number]
    to = np.append(0, np.cumsum(size))
    return np.concatenate([once, *heads])[np.repeat(at[number] - to[:-1], size) + np.arange(to[-1])], to[np.append(head, len(later))]
