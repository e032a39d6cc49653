import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from listingflow.llm import token_files
from listingflow.llm.common import shared_folder
from listingflow.llm.token_files import TokenFile, Writer
from tests.llm import cases

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()


class Sink(io.BytesIO):
    def close(self):
        self.kept = self.getvalue()
        super().close()


def file_of(rows, frame_bytes=64):
    sink = Sink()
    writer = Writer(sink, frame_bytes)
    for i, data in rows:
        writer.add(i, data)
    writer.close()
    return sink.kept


def test_a_file_gives_back_each_document_from_its_frame():
    rows = [(i if i % 5 else None, np.arange(i % 40, dtype="<u4").tobytes()) for i in range(100)]
    data = file_of(rows)
    source = TokenFile(io.BytesIO(data), len(data))
    assert len(source.entries) > 10
    assert [(source.doc_id(i), source.ids(i)) for i in range(100)] == rows
    assert list(source.find(7)) == [7] and list(source.find(1_000)) == list(source.find(0)) == []


def test_damage_is_noticed():
    data = bytearray(file_of([(1, bytes(range(200)) * 4)], 1 << 20))
    data[30] ^= 1
    with pytest.raises(Exception):  # noqa: B017 - the frame or its checksum
        TokenFile(io.BytesIO(bytes(data)), len(data)).ids(0)
    with pytest.raises(ValueError, match="seek table"):
        TokenFile(io.BytesIO(bytes(data[:-1])), len(data) - 1)


def test_documents(spark):
    docs = cases.docs(spark)
    rows = docs.collect()
    found = token_files.encode_to_files(docs, PATH).collect()
    want = sorted((str(r.doc_id), len(ids(r.text)) // 4, zlib.crc32(ids(r.text))) for r in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_crc32) for r in found) == want
    at = 0
    for r in sorted(found, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(found, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda i: (i is not None, i or 0))
    assert token_files.encode_to_files(cases.no_docs(spark), PATH).count() == 0


def test_only_documents_asked_for(spark):
    docs = cases.docs(spark)
    manifest = token_files.write(docs, PATH, shared_folder(spark), frame_bytes=256)
    asked = spark.createDataFrame([(3,), (11,), (99,)], "doc_id long")
    found = sorted((r.doc_id, bytes(r.ids)) for r in token_files.find(manifest, asked).collect())
    assert found == sorted((r.doc_id, ids(r.text)) for r in docs.collect() if r.doc_id in (3, 11))
    assert token_files.read(manifest).count() == docs.count()
