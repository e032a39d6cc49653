"""Exact dedup by owner tasks that keep compressed radix tries (Patricia tries) of whole byte strings.

Normalised texts are dealt by length and content hash to owner partitions. An owner inserts the full byte
strings into a Patricia trie whose terminal nodes keep the row that stays and the group's size; when a trie
outgrows its memory, its largest subtree goes to the task's disk and is finished on its own. Equality is that
of the bytes; the hash only deals.

Every map task first merges equal texts of its own, so that a text with a third of all rows reaches its owner
as few rows. The documents are then joined to the owners' verdicts by digest with a sort-merge join, of which
Spark splits skewed partitions.

Defined results: a null text counts as empty, and empty texts are one group like any other. Ids may have any type
with an order (texts: that of their bytes). A null id loses every tie against an id. Rows that repeat id and text
alike are one document: all carry ``kept`` of that document in :func:`find_copies`; :func:`drop_copies` keeps one of
them, the first by text and then by the other columns written as JSON. An empty table gives an empty result.
Other columns never clash: they travel in a struct.
"""

from __future__ import annotations

import hashlib
import pickle
import struct
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from listingflow.llm.common import appended, one_each, partitions, utf8, with_row, without_row

BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
FLUSH_BYTES = 32 << 20
TRIE_BYTES = 64 << 20
NODE_BYTES = 300  # a node's own memory besides its label
HEAD = struct.Struct("<IIqqq")


class Owner:
    """The row that stays for one text: most code points, then the smallest id, null last."""

    __slots__ = ("count", "doc_id", "length", "ties")

    def __init__(self, length: int, doc_id, count: int = 1, ties: int = 1):
        self.length, self.doc_id, self.count, self.ties = length, doc_id, count, ties

    def rank(self):
        return (-self.length, self.doc_id is None, 0 if self.doc_id is None else self.doc_id)

    def merge(self, other: Owner) -> None:
        mine, its = self.rank(), other.rank()
        if its < mine:
            self.length, self.doc_id, self.ties = other.length, other.doc_id, other.ties
        elif its == mine:
            self.ties += other.ties
        self.count += other.count


class Node:
    __slots__ = ("children", "label", "owner", "size")

    def __init__(self, label: bytes, owner: Owner | None = None):
        self.label, self.owner, self.children, self.size = label, owner, {}, 0


def shared_length(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """A Patricia trie over byte strings that share their first ``depth`` bytes; large subtrees move to disk."""

    def __init__(self, limit: int = TRIE_BYTES, depth: int = 0, start: bytes = b""):
        self.limit, self.depth, self.start = limit, depth, start
        self.root, self.size, self.files = Node(b""), 0, {}

    def add(self, key: bytes, owner: Owner) -> None:
        if len(key) > self.depth and key[self.depth] in self.files:
            self._write(self.files[key[self.depth]], key, owner)
            return
        node, at, grown = self.root, self.depth, 0
        top = None
        while True:
            if at == len(key):
                if node.owner is None:
                    node.owner = owner
                else:
                    node.owner.merge(owner)
                break
            child = node.children.get(key[at])
            if child is None:
                child = node.children[key[at]] = Node(key[at:], owner)
                grown += len(child.label) + NODE_BYTES
                top = top or child
                break
            top = top or child
            if key.startswith(child.label, at):
                at += len(child.label)
                node = child
                continue
            cut = shared_length(child.label, key[at : at + len(child.label)])
            middle = Node(child.label[:cut])
            child.label = child.label[cut:]
            middle.children[child.label[0]] = child
            node.children[key[at]] = middle
            if node is self.root:
                middle.size, child.size, top = child.size, 0, middle
            grown += NODE_BYTES
            at += cut
            node = middle
        if top is not None:
            top.size += grown
        self.size += grown
        while self.size > self.limit and self._splits():
            self._spill()

    def _splits(self) -> bool:
        """Whether something would go to disk and something stay, now or at the next level."""
        tops = self.root.children
        return len(tops) > 1 or any(x.children for x in tops.values())

    def _spill(self) -> None:
        first, subtree = max(self.root.children.items(), key=lambda x: x[1].size)
        file = self.files[first] = tempfile.TemporaryFile()
        for key, owner in self._walk(subtree, self.start):
            self._write(file, key, owner)
        del self.root.children[first]
        self.size -= subtree.size

    @staticmethod
    def _write(file, key: bytes, owner: Owner) -> None:
        own_id = pickle.dumps(owner.doc_id)
        file.write(HEAD.pack(len(key), len(own_id), owner.length, owner.count, owner.ties))
        file.write(key)
        file.write(own_id)

    @staticmethod
    def _read(file) -> Iterator[tuple[bytes, Owner]]:
        file.seek(0)
        while head := file.read(HEAD.size):
            size, id_size, length, count, ties = HEAD.unpack(head)
            key = file.read(size)
            yield key, Owner(length, pickle.loads(file.read(id_size)), count, ties)

    @staticmethod
    def _walk(top: Node, start: bytes) -> Iterator[tuple[bytes, Owner]]:
        stack = [(top, start)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.owner is not None:
                yield key, node.owner
            stack.extend((child, key) for child in node.children.values())

    def items(self) -> Iterator[tuple[bytes, Owner]]:
        """Every text with its owner, once; spilled subtrees one after the other."""
        yield from self._walk(self.root, self.start)
        self.root, files = Node(b""), list(self.files.values())
        self.files = {}
        while files:
            file = files.pop()
            common = None
            for key, _ in self._read(file):
                common = key if common is None else key[: shared_length(common, key[: len(common)])]
            below = Trie(self.limit, len(common), common)
            for key, owner in self._read(file):
                below.add(key, owner)
            file.close()
            yield from below.items()


def normalised(text: bytes) -> bytes:
    return text.translate(None, BLANKS)


def code_points(text: bytes) -> int:
    return len(text.decode())


def _local_owners(batches):
    """A map task's distinct texts with their owners so far; sent on whenever they fill the memory."""
    found: dict[bytes, Owner] = {}
    size, kind = 0, None
    for batch in batches:
        kind = batch.column("doc_id").type
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), utf8(batch.column("text")), strict=True):
            key, owner = normalised(text), Owner(code_points(text), doc_id)
            if key in found:
                found[key].merge(owner)
            else:
                found[key] = owner
                size += len(key) + NODE_BYTES
                if size > FLUSH_BYTES:
                    yield from _owner_batches(found.items(), kind)
                    found, size = {}, 0
    yield from _owner_batches(found.items(), kind)


def _owner_batches(items, kind, rows: int = 500, limit: int = 8 << 20):
    part, size = [], 0
    for key, owner in items:
        part.append((len(key), hashlib.sha256(key).digest(), key, owner.length, owner.doc_id, owner.count, owner.ties))
        size += len(key)
        if len(part) >= rows or size > limit:
            yield _owner_batch(part, kind)
            part, size = [], 0
    if part:
        yield _owner_batch(part, kind)


def _owner_batch(part, kind):
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.int64(), kind, pa.int64(), pa.int64())
    names = ("size", "digest", "key", "length", "doc_id", "count", "ties")
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part, strict=True), kinds, strict=True)], names)


def _own(batches):
    """One owner partition: all its texts through the trie."""
    trie, kind = Trie(), None
    for batch in batches:
        kind = batch.column("doc_id").type
        columns = [batch.column(c).to_pylist() for c in ("key", "length", "doc_id", "count", "ties")]
        for key, length, doc_id, count, ties in zip(*columns, strict=True):
            trie.add(key, Owner(length, doc_id, count, ties))
    part: list[tuple] = []
    kinds = (pa.int64(), pa.binary(), kind, pa.int64(), pa.int64(), pa.int64())
    names = ("size", "digest", "keep_id", "keep_length", "group_size", "ties")

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for key, owner in trie.items():
        part.append((len(key), hashlib.sha256(key).digest(), owner.doc_id, owner.length, owner.count, owner.ties))
        if len(part) == 5_000:
            yield batch_of(part)
            part = []
    if part:
        yield batch_of(part)


def _keys():
    def columns(batch):
        texts = utf8(batch.column("text"))
        keys = [normalised(x) for x in texts]
        return [
            pa.array([len(k) for k in keys], pa.int64()),
            pa.array([hashlib.sha256(k).digest() for k in keys], pa.binary()),
            pa.array([code_points(x) for x in texts], pa.int64()),
        ]

    return columns


def _copies(frame: DataFrame, keep_text: bool) -> DataFrame:
    """``frame`` (doc_id, text, row) with size, digest, length and its group's keep_id, group_size, ties, kept."""
    spark = frame.sparkSession
    kind = frame.schema["doc_id"].dataType.simpleString()
    owners = (
        frame.select("doc_id", "text")
        .mapInArrow(_local_owners, f"size long, digest binary, key binary, length long, doc_id {kind}, count long, ties long")
        .repartition(partitions(spark), "size", "digest")
        .mapInArrow(_own, f"size long, digest binary, keep_id {kind}, keep_length long, group_size long, ties long")
    )
    # Rows meet their owner by digest, so no two texts may share one.
    facts = F.struct("keep_id", "keep_length", "group_size", "ties")
    owners = owners.groupBy("size", "digest").agg(F.any_value(facts).alias("own"), F.count("*").alias("texts"))
    single = F.assert_true(F.col("texts") == 1, F.lit("two different texts share a digest")).isNull()
    owners = owners.filter(single).select("size", "digest", "own.*")
    keyed = appended(frame, _keys, "size long, digest binary, length long")
    if not keep_text:
        keyed = keyed.drop("text", "row")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("length") == F.col("keep_length"))
    return keyed.join(owners.hint("merge"), ["size", "digest"]).withColumn("kept", kept)


def ordered_id(docs: DataFrame, id_col: str):
    """The id as ``doc_id``; whole numbers of any width as long."""
    own = F.col(f"`{id_col}`")
    return (own.cast("long") if isinstance(docs.schema[id_col].dataType, T.IntegralType) else own).alias("doc_id")


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 of the normalised text."""
    frame = docs.select(ordered_id(docs, id_col), F.col(f"`{text_col}`").alias("text"))
    return _copies(frame, keep_text=False).select(
        "doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns."""
    names = {"doc_id": id_col, "text": text_col}
    found = _copies(with_row(docs, **names), keep_text=True).filter("kept")
    single = found.filter("ties = 1")
    repeats = one_each(found.filter("ties > 1"), "size", "digest", "doc_id")
    both = single.select("doc_id", "text", "row").unionByName(repeats.select("doc_id", "text", "row"))
    return without_row(both, docs.columns, **names)
