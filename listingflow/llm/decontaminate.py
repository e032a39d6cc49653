"""Benchmark decontamination by a broadcast hash set of the benchmark's word n-grams.

Words are the maximal runs of ASCII letters and digits and of all characters beyond ASCII, lower-cased in A-Z.
A window is ``n`` consecutive words of an item; an item of fewer words is one window. Tasks scan the documents'
windows against the set by a 64-bit number, verify every hit on the words themselves, and mark the words that
any occurrence covers. :func:`clean` then removes the marked spans or whole documents.

The set is broadcast in blocks of at most ``BLOCK_WINDOWS`` distinct windows: a benchmark below that is one
block; a larger one is scanned block after block, each pass adding its hits to those of the passes before
(the frame is written between passes). No window is left out at any size.

Defined results: null and empty texts have no words and are clean; an item without words has no window. Items
that repeat an id count once; a null item_id is named by the empty string. Rows of documents that repeat are judged
one by one. Empty tables on either side give no hits. Other columns never clash: they travel in a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import appended, staged, stretches, utf8, with_row, without_row

BLOCK_WINDOWS = 500_000
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
TABLE = bytes(
    c if c >= 0x80 or c in _KEPT else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)  # the same length as the text, so positions stay
MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def windows(words_of_item: list, n: int) -> Iterator[tuple]:
    if 0 < len(words_of_item) < n:
        yield tuple(words_of_item)
    for i in range(len(words_of_item) - n + 1):
        yield tuple(words_of_item[i : i + n])


class Block:
    """Windows of the benchmark with the items they come from, ready for scanning."""

    def __init__(self, grams: dict[tuple[bytes, ...], list[str]]):
        self.ids: dict[bytes, int] = {}
        self.grams: dict[tuple[int, ...], list[str]] = {}
        for gram, items in grams.items():
            key = tuple(self.ids.setdefault(w, len(self.ids) + 1) for w in gram)
            self.grams[key] = items
        self.sizes = sorted({len(g) for g in self.grams})
        self.numbers = {
            k: np.unique(_numbers(np.array([g for g in self.grams if len(g) == k], np.uint64).ravel(), k)[::k]) for k in self.sizes
        }

    def read(self, text: bytes) -> np.ndarray:
        """The numbers of a text's words, 0 for words that the benchmark doesn't have."""
        get, parts = self.ids.get, []
        for part in stretches(text.translate(TABLE)):
            found = part.split()
            parts.append(np.fromiter((get(w, 0) for w in found), np.uint64, len(found)))
        return np.concatenate(parts)

    def scan(self, ids: np.ndarray) -> list[tuple[int, int, list[str]]]:
        """(first word, number of words, items) of every occurrence of a window."""
        out = []
        for k in self.sizes:
            if len(ids) < k:
                continue
            numbers, known = _numbers(ids, k), self.numbers[k]
            at = np.minimum(np.searchsorted(known, numbers), len(known) - 1)
            for i in np.flatnonzero(known[at] == numbers).tolist():
                items = self.grams.get(tuple(ids[i : i + k].tolist()))
                if items is not None:  # verified on the words' own numbers
                    out.append((i, k, items))
        return out


def _numbers(ids: np.ndarray, k: int) -> np.ndarray:
    """A number for each k consecutive ids."""
    out = np.zeros(max(len(ids) - k + 1, 0), np.uint64)
    for j in range(k):
        out = out * MIX + ids[j : j + len(out)]
    return out ^ (out >> np.uint64(29))


def _grams(n: int):
    def work(batches):
        for batch in batches:
            rows = {
                (item or "", b" ".join(g))
                for item, text in zip(batch.column("item_id").to_pylist(), utf8(batch.column("text")), strict=True)
                for g in windows(words(text), n)
            }
            for part in [list(rows)[i : i + 5_000] for i in range(0, len(rows), 5_000)]:
                items, grams = zip(*part, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(items), pa.array(grams, pa.binary())], ["item_id", "gram"])

    return work


def blocks(benchmark: DataFrame, n: int, limit: int = BLOCK_WINDOWS) -> Iterator[dict]:
    """The benchmark's distinct windows with their items, at most about ``limit`` of them at a time."""
    grams = (
        benchmark.mapInArrow(_grams(n), "item_id string, gram binary")
        .groupBy("gram")
        .agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    )
    grams = staged(grams)
    parts = max(1, -(-grams.count() // limit))
    for part in range(parts):
        rows = grams.filter(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part).collect()
        if rows or part == 0:
            yield {tuple(bytes(r.gram).split(b" ")): r["items"] for r in rows}


def scanned(frame: DataFrame, benchmark: DataFrame, n: int, limit: int = BLOCK_WINDOWS) -> DataFrame:
    """``frame`` (with ``text``) with n_words, hits (ranges of words: first, end) and items."""
    spark = frame.sparkSession
    out = None
    for grams in blocks(benchmark, n, limit):
        shared = spark.sparkContext.broadcast(grams)
        if out is None:
            out = appended(frame, _first(shared), "n_words long, hits array<array<int>>, items array<string>")
        else:
            before = staged(out)
            names = before.columns
            added = appended(before, _next(shared), "hits_ array<array<int>>, items_ array<string>")
            out = added.drop("hits", "items").withColumnsRenamed({"hits_": "hits", "items_": "items"}).select(*names)
    return out


def _first(shared):
    def make():
        block = Block(shared.value)

        def columns(batch):
            counts, hits, items = [], [], []
            for text in utf8(batch.column("text")):
                found = block.read(text)
                counts.append(len(found))
                places, names = _merged(block.scan(found), [], [])
                hits.append(places)
                items.append(names)
            return [pa.array(counts, pa.int64()), pa.array(hits, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]

        return columns

    return make


def _next(shared):
    def make():
        block = Block(shared.value)

        def columns(batch):
            hits, items = [], []
            before = zip(utf8(batch.column("text")), batch.column("hits").to_pylist(), batch.column("items").to_pylist(), strict=True)
            for text, places, names in before:
                places, names = _merged(block.scan(block.read(text)), places, names)
                hits.append(places)
                items.append(names)
            return [pa.array(hits, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.string()))]

        return columns

    return make


def _merged(found, places, names):
    """Disjoint ranges of hit words in order, and all items hit in order."""
    if not found:
        return places, names
    out: list[list[int]] = []
    for first, end in sorted([*([i, i + k] for i, k, _ in found), *places]):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out, sorted({*names, *(x for _, _, items in found for x in items)})


def _benchmark(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), F.col(f"`{text_col}`").alias("text"))


def find_hits(
    docs: DataFrame, benchmark: DataFrame, n: int = 10, id_col="doc_id", text_col="text", item_col="item_id", limit=BLOCK_WINDOWS
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits, items."""
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    found = scanned(frame, _benchmark(benchmark, item_col, "text"), n, limit)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x[1] - x[0])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
        "hits",
        "items",
    )


def without_spans(text: str, hits: list) -> str:
    """The text without the words of the given ranges and what stands between them."""
    data = text.encode()
    mapped = data.translate(TABLE)
    bounds, at = [], 0
    for word in mapped.split():
        first = mapped.index(word, at)
        at = first + len(word)
        bounds.append((first, at))
    out, at = [], 0
    for first, end in hits:
        out.append(data[at : bounds[first][0]])
        at = bounds[end - 1][1]
    return b"".join([*out, data[at:]]).decode()


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    n: int = 10,
    remove: str = "documents",
    id_col="doc_id",
    text_col="text",
    item_col="item_id",
    limit=BLOCK_WINDOWS,
) -> DataFrame:
    """The documents with all their columns, without contaminated ones, or (``remove="spans"``) without the hit spans."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove documents or spans")
    names = {"text": text_col}
    found = scanned(with_row(docs, **names), _benchmark(benchmark, item_col, "text"), n, limit)
    if remove == "documents":
        return without_row(found.filter(F.size("hits") == 0), docs.columns, **names)

    def make():
        def columns(batch):
            pairs = zip(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), strict=True)
            return [pa.array([without_spans(t, h) if h else t for t, h in pairs], pa.string())]

        return columns

    kept = appended(found, make, "text_ string").drop("text").withColumnRenamed("text_", "text")
    return without_row(kept, docs.columns, **names)
