import random

import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelake.llm import tokens, wordpieces

PATH = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "aAbBzst ÉéßÀ×÷ź'’.,-!|<>01٣ \n\t\x1ć ńΣ漢"
ODD = ["", None, " \n ", "it's we'll 'tis x'S ''s ('t) 4's", "<|endoftext|> <|ENDOFTEXT|>x", "x" * 9000, "ab " * 3000, "!" * 200, "42.144.35.254 a-b_c@d.example ½² éÉ ſ K İ ΑΣ."]


def found(encoder, texts):
    out, ended = [[] for _ in texts], []
    for i, ids, end in encoder(pa.array(["skipped", *texts], pa.string()).slice(1)):
        out[i] += ids.tolist()
        ended += [i] * end
    assert ended == list(range(len(texts)))
    return out


@pytest.mark.parametrize("block", [7, 300, tokens.BLOCK])
def test_ids_are_the_tokenizers(monkeypatch, block):
    monkeypatch.setattr(tokens, "BLOCK", block)
    monkeypatch.setattr(wordpieces, "SLOTS", 64)  # most entries push out others
    monkeypatch.setattr(wordpieces, "POOL", 4000)
    rng = random.Random(block)
    texts = ODD + ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 50))) for _ in range(400)]
    plain = Tokenizer.from_file(PATH)
    encoder = wordpieces.Encoder(PATH)
    assert encoder.fast
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert found(encoder, texts) == want == found(encoder, texts)


def test_other_vocabularies_go_through_the_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, plain = wordpieces.Encoder(path), Tokenizer.from_file(path)
    assert not encoder.fast
    texts = ["a  b's c", None, "É"]
    assert found(encoder, texts) == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
