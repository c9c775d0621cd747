import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tracelake.llm import tokens

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def words(text):
    return [] if text is None else [w.translate(bytes(range(65)) + b"abcdefghijklmnopqrstuvwxyz" + bytes(range(91, 256))) for w in WORD.findall(text.encode())]


def one(word):
    return tokens.hash_words(np.frombuffer(word, np.uint8))[0][0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.text(st.sampled_from("aB é\n\x0bZ😀\x00"), max_size=25), max_size=8), st.integers(1, 40))
def test_hashes_follow_the_words(texts, block):
    old, tokens.BLOCK = tokens.BLOCK, block
    try:
        array = pa.array(["skipped", *texts], pa.string()).slice(1)
        got = [[] for _ in texts]
        for hashes, index, _ in tokens.blocks(array):
            for h, i in zip(hashes, index, strict=True):
                got[i].append(h)
        want = [[one(w) for w in words(t)] for t in texts]
        assert got == want
        flat, counts = [], []
        for first, stop, hashes, n in tokens.per_text(array):
            assert stop > first == len(counts)
            flat += list(hashes)
            counts += list(n)
        assert flat == [h for w in want for h in w] and counts == [len(w) for w in want]
    finally:
        tokens.BLOCK = old


def test_distinct_words_differ():
    found = {one(f"{a}{b}".encode()) for a in range(300) for b in "abc"}
    assert len(found) == 900
    assert one(b"ABC") == one(b"abc") != one(b"acb")
