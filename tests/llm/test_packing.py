import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from listingflow.llm import packing
from listingflow.llm.common import ready
from tests.llm.cases import LONG, docs, no_docs

PATH = public_tokenizers.path("word_bpe_49k.json")
AWKWARD = [
    "", " ", "\n", "a\tb\r\nc\x0bd\x0ce", "a b c\u0085d\x1ce\x1ff", "Ünïcode É é ́x \ńy İstanbul ǅ ß ſ",
    "<|endoftext|>", "x<|endoftext|>y <|startoftext|>\n<|endof", "it's we'RE 12 345 ½ ²", "漢字 かな 😀👍🏽 ‍", "Σίσυφος ΌΣΟΣ ς",
    "a" * 5_000, "!?" * 3_000, "don't 'tis we'll'd 'sss ''s !'re O'Réilly's x'S'T <a|b> a<|b", "ÄÖÜ äöü Straße ÿŸ × ÷ªº", "'S 't", "    x", "한글 한", "ﬁ ŉ ﻿ ­-", "The the THE",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4").tobytes()


def check(library, rows, sequences, window):
    """Every document's ids are found whole, in order and once; sequences are as long as they should be."""
    wanted, got, sizes = defaultdict(int), defaultdict(int), []
    parts = defaultdict(list)
    for s in sorted(sequences, key=lambda s: s["sequence_id"]):
        at = 0
        for i, p in enumerate(s["pieces"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
            parts[p["doc_id"]].append((p["start"], p["doc_tokens"], bytes(s["ids"][4 * p["offset"] : 4 * at])))
            # Only a window's first piece may start inside a document, only its last may end inside one.
            assert i == 0 or p["start"] == 0
            assert i + 1 == len(s["pieces"]) or p["start"] + p["length"] == p["doc_tokens"]
        assert at == s["length"] == len(s["ids"]) // 4
        sizes.append(at)
    assert [s["sequence_id"] for s in sorted(sequences, key=lambda s: s["sequence_id"])] == list(range(len(sizes)))
    for doc_id, text in rows:
        wanted[doc_id, ids_of(library, text)] += 1
    for doc_id, found in parts.items():
        held = b""
        for start, total, ids in found:  # in stream order: a document's pieces follow each other
            assert start == len(held) // 4
            held += ids
            if len(held) // 4 == total:
                got[doc_id, held] += 1
                held = b""
        assert not held
    assert got == wanted
    total = sum(sizes)
    assert sizes[: total // window] == [window] * (total // window)
    assert all(x & (x - 1) == 0 for x in sizes[total // window :])


@pytest.mark.parametrize(("window", "chunk_ids", "tasks"), [(4_096, 1 << 18, 3), (16, 16, 1), (16, 50, 7), (64, 1_000, 4), (8, 9, 40)])
def test_packs_every_id_once(spark, library, window, chunk_ids, tasks):
    ready(spark)
    data = docs(spark).select("doc_id", "text").filter("doc_id is null or doc_id not in (7, 8)") if window < 4_096 else docs(spark)
    rows = [(r["doc_id"], r["text"]) for r in data.collect()]
    out = packing.pack(data.repartition(tasks), PATH, window=window, chunk_ids=chunk_ids).collect()
    check(library, rows, [r.asDict(recursive=True) for r in out], window)


def test_random_documents_against_the_library(spark, library):
    draw = random.Random(5)
    rows = [(f"d{i % 60}", " ".join(draw.choice(AWKWARD) for _ in range(draw.randint(0, 30)))) for i in range(90)]
    data = spark.createDataFrame(rows, "doc_id string, text string").repartition(6)
    out = packing.pack(data, PATH, window=32, chunk_ids=100).collect()
    check(library, rows, [r.asDict(recursive=True) for r in out], 32)


def test_words_encode_as_the_library_does(library, monkeypatch):
    with open(PATH, encoding="utf-8") as file:
        own = packing.Words(file.read(), cached=20)
    assert own.by_words
    plain = [t for t in AWKWARD if t.isascii() and "<" not in t]
    texts = [*AWKWARD, LONG, " ".join(plain), "\n".join(plain), " ".join(AWKWARD), "\n".join(AWKWARD), "".join(AWKWARD)]
    wanted = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert [own.encode(t) for t in texts] == wanted
    monkeypatch.setattr(packing, "STRETCH", 10)
    assert [own.encode(t) for t in texts] == wanted
    own.by_words = False
    assert [own.encode(t) for t in texts] == wanted
    for size in (1, 2, 7):
        assert all(" ".join(packing.stretches(t, size)) == t for t in texts)


def test_pieces_carry_checksums(spark, library):
    out = packing.describe(docs(spark), PATH).collect()
    texts = {r["doc_id"]: r["text"] for r in docs(spark).collect() if r["doc_id"] is not None}
    for r in out:
        if r["doc_id"] is not None:
            ids = ids_of(library, texts[r["doc_id"]])
            assert len(ids) == 4 * r["doc_tokens"]
            assert zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]
    assert out and {r["sequence_id"] for r in out} == set(range(1 + max(r["sequence_id"] for r in out)))


def test_empty_table(spark):
    found = packing.describe(no_docs(spark), PATH)
    assert found.collect() == []
    assert found.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
