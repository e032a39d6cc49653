import hashlib
import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from listingflow.llm import bpe
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
SPEC = open(PATH, encoding="utf-8").read()  # noqa: SIM115
LIBRARY = Tokenizer.from_str(SPEC)


def ids(text):
    return np.array(LIBRARY.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_halves_join_to_what_the_library_gives():
    draw = random.Random(1)
    parts = ["a", "é", "'s", "'ll", " ", "  ", "\n", "\t", "1", "23", "!", "...", "漢", "<|endoftext|>", "<|endof", "text|>", " the", "ing", "²", "😀", "'LL"]
    coders = [bpe.Coder(SPEC), bpe.Coder(SPEC, leaf=5), bpe.Coder(SPEC, leaf=17)]
    for _ in range(2_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 60)))
        want = ids(text)
        for coder in coders:
            assert coder.encode(text) == want
            back = np.frombuffer(want, "<u4")
            assert coder.decode(back) == LIBRARY.decode(back.tolist(), skip_special_tokens=False) == text
    texts = ["", "one", "<|endoftext|>", "two " * 20]
    assert coders[1].encode_all(texts) == [ids(x) for x in texts]


def test_long_pieces_join_token_by_token(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_PIECE", 9)
    draw, coder = random.Random(2), bpe.Coder(SPEC, leaf=31)
    for i in range(1_000):
        text = "".join(draw.choice("abcdeinghst" if i % 2 else "ab") for _ in range(draw.randint(1, 300)))
        coder.cache.clear()
        assert coder.encode(text) == ids(text)


def test_a_full_cache_starts_anew():
    coder = bpe.Coder(SPEC, cache_rows=50)
    for i in range(60):
        text = f"word{i} and number {i * 7} of many other{i} things"
        assert coder.encode(text) == ids(text)


def test_every_character_splits_as_in_the_library():
    coder = bpe.Coder(SPEC)
    for point in [*range(0x3100), *range(0xF900, 0x10FFFF, 97)]:
        if not 0xD800 <= point < 0xE000:
            c = chr(point)
            text = f"a{c}b 1{c}2 {c}{c}\n{c}'s{c}"
            assert coder.encode(text) == ids(text), hex(point)


def test_documents_and_spread_texts(spark):
    docs = cases.docs(spark)
    want = sorted(
        (str(r.doc_id), len(ids(r.text or "")) // 4, hashlib.sha256(ids(r.text or "")).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in docs.collect()
    )
    for spread in (1 << 22, 4_000):
        found = bpe.round_trip(docs, PATH, leaf=1_000, spread=spread).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in found) == want
    assert bpe.round_trip(cases.no_docs(spark), PATH).count() == 0
