"""SimHash near duplicates through a segment-popcount embedding.

A document's fingerprint is the 64-bit SimHash of its word shingles (XXH64, seed 42). A fingerprint is embedded
as the bit counts of its ``SEGMENT`` bit wide segments. The Manhattan distance of two embeddings never exceeds the
Hamming distance of the fingerprints, so a range join under it finds every pair within ``distance`` bits, and each
candidate is verified exactly on the fingerprints.

The grid: the segments form ``distance + 3`` groups. Within a Manhattan distance of ``distance`` at least three
groups agree in all their counts, so a fingerprint is dealt once for each choice of three groups to the cell of
their counts. In a cell the remaining counts are compared first, then the bits. A cell sends on a spanning forest
of its links, never all pairs; components are then closed over the forests by rounds of star contraction.

Only distinct fingerprints enter the join, so copies cost nothing. Cells hold 8 bytes a distinct fingerprint; a
large cell is cut further by its bits (of ``distance + 1`` parts of the bits, linked fingerprints agree in one).

Defined results: null, empty and blank texts have no shingle and the fingerprint zero, linked like any other. A text
of fewer words than a shingle is one shingle. Null ids are in their component but never its name unless it has
no other. Rows that repeat are judged alike. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import appended, one_each, partitions, staged, stretches, utf8, with_row, without_row

SHINGLE = 3
DISTANCE = 3
SEGMENT = 2
SMALL_CELL = 30_000
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is one if it is set in over half the shingles' hashes."""
    set_bits, count, held = np.zeros(64, np.int64), 0, []
    for part in stretches(text.translate(LOWER)):
        held += part.split()
        if len(held) >= shingle:
            set_bits += _set_bits(held, shingle)
            count += len(held) - shingle + 1
            held = held[len(held) - shingle + 1 :]
    if not count:
        if not held:
            return 0
        set_bits, count = _set_bits(held, len(held)), 1
    return int.from_bytes(np.packbits(set_bits * 2 > count, bitorder="little").tobytes(), "little")


def _set_bits(found: list[bytes], shingle: int) -> np.ndarray:
    """How many of the shingles' hashes have each bit."""
    joined = memoryview(b" ".join(found))
    ends = list(accumulate(map(len, found), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    digest, out = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    count = len(found) - shingle + 1
    for low in range(0, count, 65_536):
        places = range(low, min(low + 65_536, count))
        hashes = np.array([digest(joined[starts[i] : ends[i + shingle - 1]], 42) for i in places], "<u8")
        out += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def _fingerprints(shingle):
    def make():
        def columns(batch):
            found = np.array([fingerprint(x, shingle) for x in utf8(batch.column("text"))], np.uint64)
            return [pa.array(found.view(np.int64))]

        return columns

    return make


def bit_counts(prints: np.ndarray, segment: int = SEGMENT) -> np.ndarray:
    """The embedding: one row a fingerprint, one bit count a segment."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.reshape(len(prints), -1, segment).sum(2, dtype=np.uint8)


def _groups(segments: int, parts: int) -> list[np.ndarray]:
    return np.array_split(np.arange(segments), parts)


def cell_keys(prints: np.ndarray, distance: int = DISTANCE, segment: int = SEGMENT) -> np.ndarray:
    """One row a fingerprint: its cell for each choice of three groups, numbered apart."""
    counts = bit_counts(prints, segment).astype(np.uint64)
    groups = _groups(counts.shape[1], distance + 3)
    weights = np.uint64(segment + 1)
    packed = []
    for group in groups:
        number = np.zeros(len(prints), np.uint64)
        for column in group:
            number = number * weights + counts[:, column]
        packed.append(number)
    span = [np.uint64(int(weights) ** len(g)) for g in groups]
    chosen = list(combinations(range(len(groups)), 3))
    keys = np.empty((len(prints), len(chosen)), np.uint64)
    for i, (a, b, c) in enumerate(chosen):
        number = (packed[a] * span[b] + packed[b]) * span[c] + packed[c]  # below 3 ** 17 for segments of two bits
        keys[:, i] = number * np.uint64(len(chosen)) + np.uint64(i)
    return keys


class Sets:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.top = list(range(n))

    def find(self, x: int) -> int:
        while self.top[x] != x:
            self.top[x] = self.top[self.top[x]]
            x = self.top[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.top[max(a, b)] = min(a, b)
        return True


def forest(prints: np.ndarray, distance: int = DISTANCE, segment: int = SEGMENT) -> list[tuple[int, int]]:
    """Positions of linked pairs that connect all that links connect, without a circle."""
    sets, out = Sets(len(prints)), []
    counts = bit_counts(prints, segment).astype(np.int8)
    cells = [(np.arange(len(prints)), np.arange(64, dtype=np.uint64))]
    while cells:
        cell, bits = cells.pop()
        if len(cell) > SMALL_CELL and len(bits) > distance:
            cells.extend(_cut(prints, cell, distance, bits))
            continue
        for i in range(len(cell) - 1):
            mine, rest = cell[i], cell[i + 1 :]
            near = rest[np.bitwise_count(prints[rest] ^ prints[mine]) <= distance] if len(cell) > 64 else None
            if near is None:
                close = rest[np.abs(counts[rest] - counts[mine]).sum(1) <= distance]
                near = close[np.bitwise_count(prints[close] ^ prints[mine]) <= distance]
            out.extend((int(mine), int(x)) for x in near if sets.join(int(mine), int(x)))
    return out


def _cut(prints, cell, distance, bits):
    """Of distance + 1 parts of the given bits, linked fingerprints agree in one: a cell for each value of each
    part, with the bits that are left to differ."""
    out = []
    for part in np.array_split(bits, distance + 1):
        mask = np.bitwise_or.reduce(np.uint64(1) << part)
        order = np.argsort(prints[cell] & mask, kind="stable")
        values = (prints[cell] & mask)[order]
        cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
        left = np.setdiff1d(bits, part)
        out.extend((x, left) for x in np.split(cell[order], cuts) if len(x) > 1)
    return out


def links(prints: DataFrame, distance: int = DISTANCE, segment: int = SEGMENT) -> DataFrame:
    """Linked pairs (a, b) of the distinct ``fingerprint`` rows that connect all that links connect."""

    def deal(batches):
        for batch in batches:
            found = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            keys = cell_keys(found, distance, segment)
            for low in range(0, len(found), 2_000):
                part = keys[low : low + 2_000]
                repeated = np.repeat(found[low : low + 2_000], keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel().view(np.int64)), pa.array(repeated.view(np.int64))], ["cell", "fingerprint"])

    def join(batches):
        # The partition is sorted by cell: the cells of all batches come one after the other.
        cell, held = None, []
        for batch in batches:
            cells = batch.column(0).to_numpy()
            found = batch.column(1).to_numpy().view(np.uint64)
            cuts = np.flatnonzero(cells[1:] != cells[:-1]) + 1
            pairs = []
            for at, part in zip([0, *cuts.tolist()], np.split(found, cuts), strict=True):
                if not len(part):
                    continue
                if cells[at] != cell:
                    pairs.extend(close(held))
                    cell, held = cells[at], []
                held.append(part)
            yield from sent(pairs)
        yield from sent(close(held))

    def close(held):
        if sum(map(len, held)) < 2:
            return []
        found = np.concatenate(held)
        return [(int(found[a]), int(found[b])) for a, b in forest(found, distance, segment)]

    def sent(pairs):
        if pairs:
            both = np.array(pairs, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both.min(1)), pa.array(both.max(1))], ["a", "b"])

    n = partitions(prints.sparkSession)
    cells = prints.select("fingerprint").mapInArrow(deal, "cell long, fingerprint long")
    return cells.repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(join, "a long, b long").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root) of every node of ``pairs`` (a, b): root is the smallest node connected to it.

    Rounds of large and small stars: each round every node points its larger neighbours, then its smaller ones, to
    the smallest it sees; the number of rounds grows with the logarithm of the longest path. Every round is a
    few joins of pairs, and is written before the next.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges if not large else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if large:
            least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
            return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a < b").distinct()
        # b sees its smaller neighbours a and itself: all of them and b point to the smallest.
        least = both.groupBy("b").agg(F.min("a").alias("m"))
        return (
            both.join(least, "b")
            .select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
            .filter("a < b")
            .distinct()
            .select("a", "b")
        )

    edges = staged(pairs.select("a", "b").filter("a < b").distinct())
    if edges.isEmpty():
        return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    state = None
    while True:
        edges = staged(star(star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.count_distinct("b")).first()
        if tuple(now) == state and now[0] == now[2]:
            break
        state = tuple(now)
    nodes = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return nodes.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _named(frame: DataFrame, shingle: int, distance: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, tie, fingerprint) of ``frame`` (doc_id, text), and (fingerprint, root, component_id) of every fingerprint."""
    prints = appended(frame.withColumn("tie", F.xxhash64("text")), _fingerprints(shingle), "fingerprint long")
    narrow = staged(prints.select("doc_id", "tie", "fingerprint"))
    least = staged(narrow.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = components(links(least, distance))
    joined = least.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    names = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return narrow, joined.join(names, "root").select("fingerprint", "root", "component_id")


def find_near_copies(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id (smallest id reachable)."""
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    narrow, named = _named(frame, shingle, distance)
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint")
    return narrow.join(named.hint("merge"), "fingerprint").select("doc_id", digits, "component_id")


def drop_near_copies(
    docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents with all their columns, of each component the one of the smallest id (then fingerprint, then text hash)."""
    picked = {"doc_id": id_col, "text": text_col}
    frame = with_row(docs, **picked)
    narrow, named = _named(frame.select("doc_id", "text"), shingle, distance)
    own = F.struct(F.isnull("doc_id"), "doc_id", "fingerprint", "tie")
    member = narrow.join(named.hint("merge"), "fingerprint").select("root", "doc_id", "tie", "fingerprint", own.alias("own"))
    member = staged(member.groupBy("root", "doc_id", "tie", "fingerprint", "own").count())
    stays = member.groupBy("root").agg(F.min("own").alias("stays"))
    judged = member.join(stays, "root").select("doc_id", "tie", "fingerprint", "count", (F.col("own") == F.col("stays")).alias("kept"))

    def same(left, right):
        return (left["doc_id"].eqNullSafe(right["doc_id"])) & (left["tie"] == right["tie"])

    # A row is named by its id and text; what goes is usually little, so it is that which is looked up.
    gone = judged.filter("NOT kept").select("doc_id", "tie")
    keyed = frame.withColumn("tie", F.xxhash64("text"))
    left = keyed.join(gone, same(keyed, gone), "left_anti")
    repeated = judged.filter("kept AND count > 1").select("doc_id", "tie")
    if not repeated.isEmpty():  # rows that repeat id and text: one of them
        several = left.join(repeated, same(left, repeated), "left_semi")
        single = left.join(repeated, same(left, repeated), "left_anti")
        left = single.unionByName(one_each(several, "doc_id", "tie").select(*single.columns))
    return without_row(left, docs.columns, **picked)
