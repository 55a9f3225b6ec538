"""Ids of many texts at once: those of each text, with every distinct piece encoded once."""

import random
from array import array

import pyarrow as pa
import pytest

from fleetstate.llm import packing

PARTS = ["a", "B", "é", "\n", "\t", " ", "  ", "\xa0", "你", "99", "'s", "<|endoftext|>", "<|im_end|>", ".", "😀", "don't", "_", "word", "other"]


@pytest.mark.parametrize("ranked", [False, True])
def test_many_texts_have_the_ids_of_each(ranked):
    encode = packing.Encoder(packing.default_vocabulary(), packing.default_ranks() if ranked else None)
    r = random.Random(11)
    texts = ["".join(r.choices([*PARTS, *encode.special], k=r.randrange(25))) for _ in range(600)] + ["", None, " ", "a", "a b", " a", "a ", "a  b"]
    for some in (texts, texts[:1], []):
        blob, offs = encode.many(pa.array(some, pa.string()), b"\0\0")
        raw = blob.to_pybytes() if some else b""
        got = [raw[a:b] for a, b in zip(offs[:-1], offs[1:])]
        assert got == [array("H", encode.model.encode(x or "", add_special_tokens=False).ids).tobytes() + b"\0\0" for x in some]


def test_distinct_pieces_are_encoded_together():
    encode = packing.Encoder(packing.default_vocabulary(), packing.default_ranks())
    calls, fast = [], encode.fast
    encode.fast = lambda text: calls.append(text) or fast(text)
    texts = [f"head {' '.join(f'w{k}' for k in range(i, i + 400))}" for i in range(50)]
    blob, offs = encode.many(pa.array(texts), b"")
    assert len(calls) == 1 + len(texts)  # the new pieces in one call, and each text's head
    want = [encode.text(x) for x in texts]
    assert [blob.to_pybytes()[a:b] for a, b in zip(offs[:-1], offs[1:])] == want
