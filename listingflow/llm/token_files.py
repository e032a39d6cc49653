"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum per frame.

A file holds, one after the other:

* data frames: the ids of whole documents as little-endian unsigned 32-bit integers, about ``FRAME_BYTES`` of them;
* index frames: one row a document of four little-endian signed 64-bit integers: id, 1 if it has an id, frame, ids;
* a seek table in a skippable frame: for each frame its compressed size, its size, and the low half of the XXH64
  of its content; then the number of frames, a byte of flags, and a number that marks the end of the file.

Readers find the frames from the file's end, and decompress only those they want (:class:`TokenFile`).

Documents are dealt to tasks by ranges of their ids (and of a hash, so that a repeated or missing id can't fill one
task), sorted there, encoded by the tokenizers library and written to the shared folder under a name of the attempt's
own. The names that count are in a manifest, itself a table that Spark commits: files of lost or repeated attempts
are never read. The running position of each file follows from the manifest's sums.

Defined results: null and empty texts are the end id alone. Ids are whole numbers, as the index holds them; others than
those, or texts of them, are an error. A null id comes first. Rows that repeat an id stand
side by side. An empty table gives no files. Other columns never clash: only id and text are read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingflow.llm.bpe import coder, vocabulary
from listingflow.llm.common import partitions, shared_folder, staged

FRAME_BYTES = 1 << 20
FILE_BYTES = 256 << 20
END_ID = 0
CACHED_PIECES = 600_000
LEVEL = 1
# Fixed values of the seekable zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80

MANIFEST = "file string, part int, place int, docs long, tokens long"


class Writer:
    """One file: documents in, frames out."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.press = zstandard.ZstdCompressor(level=LEVEL)
        self.held, self.size, self.entries, self.index = [], 0, [], []
        self.docs = self.tokens = self.written = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.size + len(ids) > self.frame_bytes:
            self._flush()
        self.index.append((doc_id or 0, doc_id is not None, len(self.entries), len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids)
        self.docs += 1
        self.tokens += len(ids) // 4

    def _flush(self) -> None:
        if self.held:
            self._frame(b"".join(self.held))
            self.held, self.size = [], 0

    def _frame(self, content: bytes) -> None:
        packed = self.press.compress(content)
        self.sink.write(packed)
        self.written += len(packed)
        self.entries.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def close(self) -> None:
        self._flush()
        self._frame(np.array(self.index, "<i8").reshape(-1, 4).tobytes())
        table = b"".join(struct.pack("<III", *e) for e in self.entries)
        table += struct.pack("<IBI", len(self.entries), CHECKSUMS, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.sink.close()


class TokenFile:
    """Random access to one file: frames are read and decompressed only when a document of theirs is asked for."""

    def __init__(self, source, size: int):
        self.source = source
        count, flags, mark = struct.unpack("<IBI", self._bytes(size - 9, 9))
        if mark != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        raw = self._bytes(size - 9 - 12 * count, 12 * count)
        self.entries = list(struct.iter_unpack("<III", raw))
        self.starts = np.cumsum([0, *(e[0] for e in self.entries)]).tolist()
        self.index = np.frombuffer(self.frame(count - 1), "<i8").reshape(-1, 4)
        frames, lengths = self.index[:, 2], self.index[:, 3]
        before = np.cumsum(lengths) - lengths
        first = np.searchsorted(frames, frames)
        self.at = before - before[first] if len(before) else before
        self.last = (None, b"")

    def _bytes(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, number: int) -> bytes:
        size, length, checksum = self.entries[number]
        content = zstandard.ZstdDecompressor().decompress(self._bytes(self.starts[number], size), max_output_size=length)
        if len(content) != length or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} doesn't fit its checksum")
        return content

    def doc_id(self, place: int) -> int | None:
        return int(self.index[place, 0]) if self.index[place, 1] else None

    def ids(self, place: int) -> bytes:
        """The ids of the document at a place of the file."""
        frame, n, at = int(self.index[place, 2]), int(self.index[place, 3]), int(self.at[place])
        if self.last[0] != frame:
            self.last = (frame, self.frame(frame))
        return self.last[1][4 * at : 4 * (at + n)]

    def find(self, doc_id: int) -> Iterator[int]:
        """The places of an id."""
        yield from np.flatnonzero((self.index[:, 0] == doc_id) & (self.index[:, 1] == 1)).tolist()


def _folder(uri: str):
    return pafs.FileSystem.from_uri(uri)


def open_file(uri: str) -> TokenFile:
    store, path = _folder(uri)
    return TokenFile(store.open_input_file(path), store.get_file_info(path).size)


def write(docs: DataFrame, tokenizer: str, folder: str, id_col: str = "doc_id", text_col: str = "text", frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write the files in ascending order of ids; the manifest (file, first_token, docs, tokens) in order."""
    spark = docs.sparkSession
    spec = vocabulary(spark, tokenizer)
    order = ["doc_id", "tie"]
    frame = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text_col}`").alias("tie"), F.col(f"`{text_col}`").alias("text")
    )
    dealt = frame.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    manifest = staged(dealt.mapInArrow(_write(spec, folder, frame_bytes), MANIFEST))
    before = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("first_token", F.coalesce(F.sum("tokens").over(before), F.lit(0).cast("long")))


def _write(spec, folder, frame_bytes):
    def work(batches):
        from pyspark import TaskContext

        part, place, out, name = TaskContext.get().partitionId(), 0, None, None
        own = coder(spec.value, cache_rows=CACHED_PIECES)
        store, path = _folder(folder)
        for batch in batches:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), own.encode_all(texts), strict=True):
                if out is None:
                    store.create_dir(path, recursive=True)
                    name = f"part-{part:06d}-{place:04d}-{uuid.uuid4().hex}.zst"
                    out = Writer(store.open_output_stream(f"{path}/{name}", compression=None), frame_bytes)
                out.add(doc_id, ids + END_ID.to_bytes(4, "little"))
                if out.written > FILE_BYTES:
                    out.close()
                    yield _row(f"{folder}/{name}", part, place, out)
                    place, out = place + 1, None
        if out is not None:
            out.close()
            yield _row(f"{folder}/{name}", part, place, out)

    return work


def _row(file, part, place, out):
    values = ([file], [part], [place], [out.docs], [out.tokens])
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays(
        [pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["file", "part", "place", "docs", "tokens"]
    )


def read(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, ids (with the end id)."""
    return _read(manifest, lambda ids: ids, "ids binary", pa.binary())


def digests(manifest: DataFrame) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    out = _read(manifest, zlib.crc32, "ids_crc32 long", pa.int64())
    return out.select("doc_id", "start", "n_tokens", "ids_crc32")


def _read(manifest, use, column, kind):
    def work(batches):
        for batch in batches:
            for file, first in zip(batch.column("file").to_pylist(), batch.column("first_token").to_pylist(), strict=True):
                source = open_file(file)
                starts = (first + np.cumsum(source.index[:, 3]) - source.index[:, 3]).tolist()
                held, size = [], 0
                for place, start in enumerate(starts):
                    ids = source.ids(place)
                    held.append((source.doc_id(place), start, len(ids) // 4, use(ids)))
                    size += len(ids)
                    if len(held) >= 2_000 or size > 8 << 20:
                        yield rows(held)
                        held, size = [], 0
                if held:
                    yield rows(held)

    def rows(held):
        kinds = (pa.int64(), pa.int64(), pa.int64(), kind)
        names = ["doc_id", "start", "n_tokens", column.split()[0]]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    # One task a few files: the manifest is dealt out again, since it is small and the files are not.
    spread = manifest.select("file", "first_token").repartition(partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(work, f"doc_id long, start long, n_tokens long, {column}")


def find(manifest: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """doc_id and ids of the documents asked for (``doc_ids``: doc_id); only the frames that hold them are decompressed."""

    def places(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                index = open_file(file).index
                known = index[:, 1] == 1
                for low in range(0, len(index), 10_000):
                    part = np.flatnonzero(known[low : low + 10_000]) + low
                    if len(part):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(index[part, 0]), pa.array([file] * len(part)), pa.array(part)], ["doc_id", "file", "place"]
                        )

    def fetch(batches):
        opened = (None, None)
        for batch in batches:
            rows = batch.to_pylist()
            ids = []
            for row in rows:
                if opened[0] != row["file"]:
                    opened = (row["file"], open_file(row["file"]))
                ids.append(opened[1].ids(row["place"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    n = partitions(manifest.sparkSession)
    known = manifest.select("file").repartition(n, "file").mapInArrow(places, "doc_id long, file string, place long")
    wanted = known.join(doc_ids.select("doc_id").distinct(), "doc_id").repartition(n, "file").sortWithinPartitions("file", "place")
    return wanted.mapInArrow(fetch, "doc_id long, ids binary")


def encode_to_files(docs: DataFrame, tokenizer: str, folder: str | None = None, **columns) -> DataFrame:
    """Write the files, read them back, and describe each document."""
    return digests(write(docs, tokenizer, folder or shared_folder(docs.sparkSession), **columns))
