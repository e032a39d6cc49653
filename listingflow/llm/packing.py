"""Packing by concatenating and cutting: all documents' ids as one stream, cut into windows of equal length.

First pass: each task encodes its documents one after the other and writes their ids, each document's followed by the
end id, as chunks of the task's stream, with the pieces of documents in each chunk. Then two prefix sums: chunks carry
the ids before them in their task, and the tasks' totals (one number a task) are added up on the driver, so that
each chunk's place in the whole stream is known without moving any ids. Second pass: a chunk's full windows are
sequences as they are; what it has of the windows that cross its ends are boundary records, and only they are
shuffled, by window, and joined. A boundary window has at most as many records as ids.

The stream's rest, shorter than a window, is cut at powers of two, the largest first: no sequence needs padding.

Texts of ASCII and common Latin letters are lower-cased and split into pieces here, and the tokenizers library's model
encodes each distinct piece once while it stays in a bounded cache. In other texts the same goes for words between
blanks and line feeds, which no token of the vocabulary crosses (its normaliser makes every run of white space one
blank, its splitter removes blanks, and its added tokens hold none); words of other characters go through the whole
library. A vocabulary with another normaliser or splitter gets whole texts.

Defined results: null and empty texts are the end id alone. Repeated rows are packed one by one. Ids of documents may
have any type and may be null. An empty table gives an empty result. Other columns never clash: only id and text are
read. Which window a document falls into depends on the order in which tasks read the rows; a retried task changes
nothing, since the second pass reads what the first one committed.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.llm.bpe import byte_letters, vocabulary
from listingflow.llm.common import staged

WINDOW = 4_096
END_ID = 2
CHUNK_IDS = 1 << 16
STRETCH = 1 << 18
CACHED = 400_000
LONG_PIECE = 256
WORD = "\0"

# The normaliser and splitter of vocabularies whose texts are encoded word by word.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
# The same splitter for lower-cased texts whose characters' classes are all written out.
_PLAIN = re.compile(r"[\t-\r !-;=-~À-ÖØ-öø-ÿ]*")
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r 0-9a-zß-öø-ÿ]+")


class Words(dict):
    """Ids of pieces, and of words after a mark; what is looked up and missing is encoded. A full one starts anew."""

    def __init__(self, spec: str, cached: int = CACHED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        stated = json.loads(spec)
        added = self.library.get_added_tokens_decoder().values()
        # Added tokens must start with a character that makes a word go through the library.
        simple = not any(set(t.content) & set(" \n") or t.lstrip or t.rstrip or t.single_word for t in added)
        simple = simple and not any(_PLAIN.fullmatch(t.content[:1]) for t in added)
        self.by_words = simple and stated["normalizer"] == NORMALIZER and stated["pre_tokenizer"] == SPLITTER
        self.letters = byte_letters()
        self.cached = cached

    def __missing__(self, piece: str) -> bytes:
        if piece[0] == WORD:
            ids = self.library.encode(piece[1:], add_special_tokens=False).ids
        else:
            name = piece if piece.isascii() else "".join([self.letters[x] for x in piece.encode()])
            ids = [t.id for t in self.library.model.tokenize(name)]
        found = array("I", ids).tobytes()
        if len(piece) <= LONG_PIECE:
            if len(self) >= self.cached:
                self.clear()
            self[piece] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not self.by_words:
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join([b"".join(map(self.__getitem__, split(part))) for part in stretches(text)])


def split(text: str) -> list[str]:
    """The pieces of a text, and marked words where these need the library."""
    if _PLAIN.fullmatch(text):
        return _PIECES.findall(text.lower())
    out = []
    for word in text.replace("\n", " ").split(" "):
        if _PLAIN.fullmatch(word):
            out += _PIECES.findall(word.lower())
        else:
            out.append(WORD + word)
    return out


def stretches(text: str, size: int | None = None):
    """A text in parts of about ``size`` characters, cut at blanks."""
    at, size = 0, size or STRETCH
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


_WORDS: dict[bytes, Words] = {}


def words(spec: str) -> Words:
    """A worker's encoder for a vocabulary; kept from task to task."""
    key = hashlib.sha256(spec.encode()).digest()
    if key not in _WORDS:
        _WORDS.clear()
        _WORDS[key] = Words(spec)
    return _WORDS[key]


def _piece(kind: T.DataType) -> T.StructType:
    return T.StructType(
        [T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("length", T.IntegerType())]
        + [T.StructField("doc_tokens", T.LongType()), T.StructField("offset", T.IntegerType())]
    )


def _schema(ddl: str, kind: T.DataType) -> T.StructType:
    return T.StructType(T.StructType.fromDDL(ddl).fields + [T.StructField("pieces", T.ArrayType(_piece(kind)))])


_CHUNK = "part int, before long, n int, ids binary"
_SEQUENCE = "sequence_id long, offset int, length int, ids binary"
_KINDS = {"part": pa.int32(), "before": pa.int64(), "n": pa.int32(), "ids": pa.binary()}
_KINDS |= {"sequence_id": pa.int64(), "offset": pa.int32(), "length": pa.int32()}


def _pieces(id_kind: pa.DataType) -> pa.DataType:
    fields = [("doc_id", id_kind), ("start", pa.int64()), ("length", pa.int32()), ("doc_tokens", pa.int64()), ("offset", pa.int32())]
    return pa.list_(pa.struct(fields))


def _batch(rows: list[dict], ddl: str, id_kind: pa.DataType) -> pa.RecordBatch:
    names = [x.split()[0] for x in ddl.split(", ")]
    kinds = [_KINDS[x] for x in names] + [_pieces(id_kind)]
    return pa.RecordBatch.from_pylist(rows, pa.schema(list(zip([*names, "pieces"], kinds, strict=True))))


def _id_kind(column: pa.Array) -> pa.DataType:
    return column.type.value_type.field("doc_id").type


class _Stream:
    """A task's stream: documents in, chunks out."""

    def __init__(self, part: int, chunk_ids: int):
        self.part, self.chunk_ids, self.before = part, chunk_ids, 0
        self.ids, self.pieces, self.size = [], [], 0

    def add(self, doc_id, ids: bytes):
        total, start = len(ids) // 4, 0
        while start < total:
            n = min(total - start, self.chunk_ids - self.size)
            self.ids.append(ids[4 * start : 4 * (start + n)])
            self.pieces.append({"doc_id": doc_id, "start": start, "length": n, "doc_tokens": total, "offset": self.size})
            self.size, start = self.size + n, start + n
            if self.size == self.chunk_ids:
                yield self.chunk()

    def chunk(self) -> dict:
        row = {"part": self.part, "before": self.before, "n": self.size, "ids": b"".join(self.ids), "pieces": self.pieces}
        self.before += self.size
        self.ids, self.pieces, self.size = [], [], 0
        return row


def _encode(spec, end_id: int, chunk_ids: int):
    def work(batches):
        from pyspark import TaskContext

        own, end, id_kind = words(spec.value), end_id.to_bytes(4, "little"), None
        stream = _Stream(TaskContext.get().partitionId(), chunk_ids)
        for batch in batches:
            id_kind = batch.column("doc_id").type
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                for row in stream.add(doc_id, own.encode(text) + end):
                    yield _batch([row], _CHUNK, id_kind)
        if stream.size:
            yield _batch([stream.chunk()], _CHUNK, id_kind)

    return work


class _Cuts:
    """Where sequences start: every ``window`` ids, and the rest at its powers of two."""

    def __init__(self, total: int, window: int):
        self.window, self.full = window, total // window
        rest, at = total - self.full * window, self.full * window
        self.tail = [at]
        for bit in reversed(range(window.bit_length())):
            if rest >> bit & 1:
                at += 1 << bit
                self.tail.append(at)

    def sequence(self, place: int) -> tuple[int, int, int]:
        """Number, start and end of the sequence that holds a place of the stream."""
        number = place // self.window
        if number < self.full:
            return number, number * self.window, (number + 1) * self.window
        i = int(np.searchsorted(self.tail, place, "right")) - 1
        return self.full + i, self.tail[i], self.tail[i + 1]


def _cut(bases, total: int, window: int, whole: bool):
    """The full sequences of each chunk, or its parts of those that cross its ends."""

    def rows(first: int, ids: bytes, pieces: list[dict], cuts: _Cuts):
        n, at, p = len(ids) // 4, first, 0
        while at < first + n:
            number, low, high = cuts.sequence(at)
            end = min(high, first + n)
            if (at == low and end == high) == whole:
                held = []
                while p < len(pieces) and pieces[p]["offset"] + first < end:
                    piece = pieces[p]
                    a, b = max(first + piece["offset"], at), min(first + piece["offset"] + piece["length"], end)
                    if a < b:
                        start = piece["start"] + a - first - piece["offset"]
                        held.append(piece | {"start": start, "length": b - a, "offset": a - low})
                    if first + piece["offset"] + piece["length"] > end:
                        break
                    p += 1
                content = ids[4 * (at - first) : 4 * (end - first)]
                yield {"sequence_id": number, "offset": at - low, "length": end - at, "ids": content, "pieces": held}
            else:
                while p < len(pieces) and first + pieces[p]["offset"] + pieces[p]["length"] <= end:
                    p += 1
            at = end

    def work(batches):
        cuts = _Cuts(total, window)
        for batch in batches:
            id_kind = _id_kind(batch.column("pieces"))
            for row in batch.to_pylist():
                held, size = [], 0
                for one in rows(bases.value[row["part"]] + row["before"], row["ids"], row["pieces"], cuts):
                    held.append(one)
                    size += one["length"]
                    if size >= 1 << 20:
                        yield _batch(held, _SEQUENCE, id_kind)
                        held, size = [], 0
                if held:
                    yield _batch(held, _SEQUENCE, id_kind)

    return work


def _meet(records: pa.Table) -> pa.Table:
    """The boundary records of one window as its sequence."""
    rows = sorted(records.to_pylist(), key=lambda r: r["offset"])
    pieces: list[dict] = []
    for piece in chain.from_iterable(r["pieces"] for r in rows):
        # A piece that starts inside its document, but not at the window's start, goes on with the one before it.
        if pieces and piece["start"]:
            pieces[-1]["length"] += piece["length"]
        else:
            pieces.append(piece)
    row = {"sequence_id": rows[0]["sequence_id"], "offset": 0, "length": sum(r["length"] for r in rows)}
    row |= {"ids": b"".join(r["ids"] for r in rows), "pieces": pieces}
    return pa.Table.from_batches([_batch([row], _SEQUENCE, _id_kind(records.column("pieces")))])


def pack(
    docs: DataFrame,
    tokenizer: str,
    window: int = WINDOW,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk_ids: int = CHUNK_IDS,
) -> DataFrame:
    """Sequences of ``window`` ids: sequence_id, length, ids (little-endian unsigned 32-bit integers) and their pieces
    (doc_id, start, length, doc_tokens, offset) in order."""
    if chunk_ids < window:
        raise ValueError("a chunk must be as long as a window at least")
    spark = docs.sparkSession
    spec = vocabulary(spark, tokenizer)
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    kind = frame.schema["doc_id"].dataType
    chunks = staged(frame.mapInArrow(_encode(spec, end_id, chunk_ids), _schema(_CHUNK, kind)))
    sizes = sorted((r["part"], r["n"]) for r in chunks.groupBy("part").agg(F.sum("n").alias("n")).collect())  # one row a task
    ends = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    bases = spark.sparkContext.broadcast({part: at for (part, _), at in zip(sizes, ends, strict=False)})
    schema = _schema(_SEQUENCE, kind)
    whole = chunks.mapInArrow(_cut(bases, ends[-1], window, True), schema)
    crossing = chunks.mapInArrow(_cut(bases, ends[-1], window, False), schema)
    met = crossing.groupBy("sequence_id").applyInArrow(_meet, schema)
    return whole.unionByName(met).drop("offset")


def pieces(sequences: DataFrame) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    kind = sequences.schema["pieces"].dataType.elementType["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", kind)]
        + T.StructType.fromDDL("start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").fields
    )

    def work(batches):
        for batch in batches:
            listed = batch.column("pieces")
            flat = listed.flatten()
            owner = np.repeat(np.arange(batch.num_rows), listed.value_lengths().to_numpy(zero_copy_only=False))
            ids = batch.column("ids").to_pylist()
            low, n = (flat.field(x).to_numpy(zero_copy_only=False).tolist() for x in ("offset", "length"))
            sums = [zlib.crc32(ids[o][4 * a : 4 * (a + b)]) for o, a, b in zip(owner.tolist(), low, n, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    flat.field("doc_id"),
                    flat.field("start"),
                    flat.field("length").cast(pa.int64()),
                    pa.array(sums, pa.int64()),
                    flat.field("doc_tokens"),
                    batch.column("sequence_id").take(pa.array(owner, pa.int64())),
                    flat.field("offset").cast(pa.int64()),
                ],
                schema.names,
            )

    return sequences.select("sequence_id", "ids", "pieces").mapInArrow(work, schema)


def describe(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", **options) -> DataFrame:
    """Pack the documents and describe each piece."""
    found = pieces(pack(docs, tokenizer, id_col=id_col, **options))
    return found.withColumnRenamed("doc_id", id_col)
