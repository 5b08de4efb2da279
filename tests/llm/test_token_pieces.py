"""Texts encoded by distinct pieces have the ids of whole texts, and each distinct piece is encoded once."""

import random

import numpy as np
import pyarrow as pa

from flowlens.llm import lm, tokens
from flowlens.llm.common import text_bytes

PATH = tokens.tokenizer_path()


def test_pieces_give_the_ids_of_whole_texts():
    rng = random.Random(4)
    letters = " \t\n 　 \u0085\x1c\x7fab'sTé9½漢😀.-<|   "
    for _ in range(3000):
        texts = [None if rng.random() < 0.05 else "".join(rng.choices(letters, k=rng.randrange(14))) for _ in range(rng.randrange(5))]
        ids, at = tokens.encoded_texts(*text_bytes(pa.array(texts, pa.string())), PATH)
        for i, text in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == tokens.encoded(text, PATH).tolist(), texts


def test_a_piece_is_encoded_once(monkeypatch):
    """Work grows with the distinct pieces of a chunk, not with its words."""
    seen = []
    whole = tokens.encoded
    monkeypatch.setattr(tokens, "encoded", lambda text, path: seen.append(text or "") or whole(text, path))
    ids, at = tokens.encoded_texts(*text_bytes(pa.array(["a wooden bridge over a river " * 500] * 3)), PATH)
    assert len(at) == 4 and len(ids) == 3 * (at[1] - at[0])
    assert sum(map(len, seen)) < 200


def test_the_coded_table_holds_all_texts(spark):
    texts = [None, "", " ", "One two", "ONE  two\nThree ", "é" * 9000, "word " * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = {r.doc_id: np.frombuffer(bytes(r["__ids"]), "<u2") for r in lm._coded(rows, "text", ("doc_id",)).collect()}
    for i, text in enumerate(texts):
        assert coded[i].tolist() == lm._ids(text, PATH).tolist()
