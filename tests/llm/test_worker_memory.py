"""What a Python worker holds, while it works and afterwards."""

import random
import re

import pyarrow as pa
from tokenizers import Tokenizer

from sievewell.llm import packing


def _anonymous_mb():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024


def _batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])


def test_words_known_are_bounded_and_those_that_come_again_stay():
    tok, rng, asked = packing._WordTokenizer(packing.default_vocabulary()), random.Random(4), []
    learn = tok._learn
    tok._learn = lambda words: (asked.extend(words & {"again,"}), learn(words))
    for _ in range(50):
        text = "again, " + " ".join(f"{rng.randrange(10**9)}x" for _ in range(9000))
        raw = tok.encode([text])[0]
        assert len(tok.known) + len(tok.before) <= 320_000
    plain = Tokenizer.from_file(packing.default_vocabulary())
    assert raw == tok._raw(plain.encode(text, add_special_tokens=False).ids)
    assert asked == ["again,"]


def test_a_task_gives_free_memory_back():
    run = packing._pieces(packing.default_vocabulary(), 2048, 0)
    list(run([_batch(["some words"])]))
    before = _anonymous_mb()
    held = [bytearray(b"x" * 100_000) for _ in range(3000)]  # below the size that the C library maps apart
    pin = held[-1]
    del held
    list(run([_batch(["some words", None])]))
    assert pin and _anonymous_mb() < before + 60
