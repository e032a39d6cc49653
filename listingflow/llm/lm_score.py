"""Language-model scores by deleted interpolation of n-gram estimates (words and pairs of words).

p(w | v) = a2(b) c(v, w) / c(v) + a1(b) c(w) / N + a0(b) / (V + 1), where b is the bucket of the context's frequency
c(v) (its number of binary digits) and the weights a(b) are learned by expectation-maximisation: training documents are cut
in two by a hash, pairs are counted in the one part, and the weights are those that make the other part, the held-out counts,
likeliest. Scores then use the counts of both parts.

All counts are over all training documents. They are never in one place: a task turns its documents into blocks
with word numbers of their own; each block asks the owners of its words and pairs for their total counts, sorted keys
to a hash bucket, and sends its own counts with the question. The owner of a bucket adds up what all blocks sent and
answers each block in the order asked. A frequent pair is one key per block, so no owner gets more than its share. A block's token
numbers and answers then meet and give its documents' scores. Keys are 64-bit hashes of words and of pairs; two
that are alike by accident would share their counts (about one pair of keys in 10^10 keys).

Defined results: null and empty texts are the end token alone. Ids are whole numbers; others than those, or texts of
them, are an error. A null id counts as empty text in the crc (so it is held
out). Without training documents all weight is on the uniform part. Contexts never seen have only the lower orders.
Repeated rows are scored alike. Empty tables give empty results; other columns never clash.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import partitions, staged, stretches, utf8

BLOCK_TOKENS = 2_000_000
BUCKET_CHARS = 32_000_000
ROUNDS = 15
LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
FIRST, LAST = b"\t", b"\n"  # no words: a context before the first word, and the end token
COUNTED, HELD, TEST = range(3)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
TABLE = "target long, block long, held boolean, keys binary, counts binary, docs binary, tokens binary, hashes binary"
NAMES = ("target", "block", "held", "keys", "counts", "docs", "tokens", "hashes")


def pack(values: np.ndarray) -> bytes:
    """An array's bytes plane by plane, compressed: small numbers cost little whatever their type."""
    flat = np.ascontiguousarray(values)
    planes = flat.view(np.uint8).reshape(len(flat), flat.itemsize).T.tobytes()
    return len(flat).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind) -> np.ndarray:
    size, width = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = zstandard.ZstdDecompressor().decompress(data[8:], max_output_size=max(size * width, 1))
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(width, size).T).view(kind).reshape(-1)


class Block:
    """Documents as numbers: words 0 (before the first) and 1 (the end) and the block's own."""

    def __init__(self):
        self.words: dict[bytes, int] = defaultdict()
        self.words.default_factory = self.words.__len__
        self.words[FIRST], self.words[LAST]  # noqa: B018 - they take the first numbers
        self.tokens, self.docs, self.size = [], [], 0

    def add(self, doc_id, fold: int, text: bytes) -> None:
        parts = []
        for part in stretches(text.translate(LOWER)):
            found = part.split()
            parts.append(np.fromiter(map(self.words.__getitem__, found), np.int32, len(found)))
        ids = np.concatenate([*parts, np.ones(1, np.int32)])
        self.tokens.append(ids)
        self.docs.append((doc_id or 0, doc_id is not None, fold, len(ids)))
        self.size += len(ids)


def pairs_of(tokens: np.ndarray, width: int) -> np.ndarray:
    """Each token with the one before it, as one number."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[0] = 0
    before[before == 1] = 0  # after an end stands the next document's beginning
    return before.astype(np.int64) * width + tokens


def keys_of(hashes: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The keys of pairs, from their words' hashes."""
    x = hashes[pairs // len(hashes)] * MIX[0]
    x += (hashes ^ (hashes >> np.uint64(31)))[pairs % len(hashes)] * MIX[1]
    x ^= x >> np.uint64(29)
    x *= MIX[0]
    x ^= x >> np.uint64(32)
    return x


def questions(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the keys by bucket and key, and where each bucket starts."""
    bucket = (keys % np.uint64(buckets)).astype(np.int32)
    order = np.lexsort((keys, bucket)).astype(np.int32)
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _rows(block: Block, name: int, held: bool, buckets: int):
    """A block's questions, one for each bucket of words and of pairs, and its own row."""
    tokens, docs = np.concatenate(block.tokens), np.array(block.docs, np.int64).reshape(-1, 4)
    block.tokens = []
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in block.words], np.uint64)
    counted = np.repeat(docs[:, 2] != TEST, docs[:, 3])
    word_counts = np.bincount(tokens[counted], minlength=len(hashes))
    all_pairs = pairs_of(tokens, len(hashes))
    pairs = np.unique(all_pairs)
    known, found = np.unique(all_pairs[counted], return_counts=True)
    pair_counts = np.zeros(len(pairs), np.int64)
    pair_counts[np.searchsorted(pairs, known)] = found
    del all_pairs, known, found, counted
    for kind in (0, 1):
        keys, counts = (hashes, word_counts) if kind == 0 else (keys_of(hashes, pairs), pair_counts)
        order, starts = questions(keys, buckets)
        keys, counts = keys[order], counts[order].astype(np.int64)
        del order
        for b in range(buckets):
            low, high = starts[b], starts[b + 1]
            if low < high:
                steps = np.diff(keys[low:high], prepend=np.uint64(0))
                yield (kind * buckets + b, name, held, pack(steps), pack(counts[low:high]), None, None, None)
    own = -1 - name  # the block's own row goes to a group of its own
    yield (own, name, held, None, None, pack(docs.ravel()), pack(tokens), pack(hashes))


def _batch(row):
    schema = (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 5)
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, schema, strict=True)], list(NAMES))


def _ask(buckets: int, block_tokens: int):
    def work(batches):
        from pyspark import TaskContext

        start, made = TaskContext.get().partitionId() << 32, 0
        open_blocks = {False: Block(), True: Block()}
        for batch in batches:
            columns = [batch.column("doc_id").to_pylist(), batch.column("fold").to_pylist(), utf8(batch.column("text"))]
            for doc_id, fold, text in zip(*columns, strict=True):
                held = fold == HELD
                open_blocks[held].add(doc_id, fold, text)
                if open_blocks[held].size >= block_tokens:
                    block, open_blocks[held] = open_blocks[held], Block()
                    yield from map(_batch, _rows(block, start + made, held, buckets))
                    made += 1
        for held, block in open_blocks.items():
            if block.size:
                yield from map(_batch, _rows(block, start + made, held, buckets))
                made += 1

    return work


def _answer(buckets: int):
    """A bucket's owner: the sums of all blocks' counts, to each block in the order it asked. A block's own row passes."""

    def work(rows: pa.Table) -> pa.Table:
        target = rows["target"][0].as_py()
        if target < 0:
            return rows
        keys = [np.cumsum(unpack(k, np.uint64), dtype=np.uint64) for k in rows["keys"].to_pylist()]
        counts = [unpack(c, np.int64) for c in rows["counts"].to_pylist()]
        held = rows["held"].to_pylist()
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        part = np.concatenate([np.full(len(c), h) for c, h in zip(counts, held, strict=True)])
        flat = np.concatenate(counts)
        sums = [np.bincount(place[part == h], flat[part == h], len(every)).astype(np.int64) for h in (False, True)]
        out, at = [], 0
        for block, mine, c in zip(rows["block"].to_pylist(), held, counts, strict=True):
            own = place[at : at + len(c)]
            at += len(c)
            # In the fields of a block's own row: counts of the first part, then of the held-out one.
            out.append((target, block, mine, None, None, pack(sums[0][own]), pack(sums[1][own]), None))
        if target < buckets:  # words: distinct ones and tokens, of the first part and of both
            facts = [int((sums[0] > 0).sum()), int(sums[0].sum()), int((sums[0] + sums[1] > 0).sum()), int((sums[0] + sums[1]).sum())]
            out.append((target, -1, False, None, None, np.array(facts, np.int64).tobytes(), None, None))
        kinds = (pa.int64(), pa.int64(), pa.bool_(), *[pa.binary()] * 5)
        return pa.table([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], list(NAMES))

    return work


class Known:
    """A block with its answers: for each distinct pair of its tokens the counts, over the given parts."""

    def __init__(self, own: dict, answers: pa.Table, buckets: int, parts: tuple[int, ...]):
        self.docs = unpack(own["docs"], np.int64).reshape(-1, 4)
        hashes = unpack(own["hashes"], np.uint64)
        pairs, place = np.unique(pairs_of(unpack(own["tokens"], np.int32), len(hashes)), return_inverse=True)
        self.place = place.astype(np.int32)
        del place
        told = dict(zip(answers["target"].to_pylist(), zip(*(answers[c].to_pylist() for c in ("docs", "tokens")), strict=True), strict=True))
        words = self._counts(hashes, told, 0, buckets, parts)
        self.pair = self._counts(keys_of(hashes, pairs), told, buckets, buckets, parts)
        self.word = words[pairs % len(hashes)]
        words[0] = words[1]  # each document begins once and ends once
        self.context = words[pairs // len(hashes)]

    @staticmethod
    def _counts(keys, told, first, buckets, parts):
        order, starts = questions(keys, buckets)
        out = np.zeros(len(keys), np.int64)
        for b in range(buckets):
            low, high = starts[b], starts[b + 1]
            if low < high:
                out[order[low:high]] = sum(unpack(told[first + b][part], np.int64) for part in parts)
        return out


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, else its count's number of binary digits."""
    return np.frexp(context.astype(np.float64))[1].astype(np.int64)


def _held_counts(buckets: int):
    """The held-out tokens of a block by what their probability depends on."""

    def work(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({k: pa.array([], pa.int64()) for k in ("bucket", "pair", "context", "word", "n")})
        block = Known(own.to_pylist()[0], answers, buckets, (0,))
        pair, context, word = block.pair, block.context, block.word
        bucket = bucket_of(context)
        facts = np.stack([bucket, pair, np.where(pair > 0, context, 0), word], axis=1)
        every, place = np.unique(facts, axis=0, return_inverse=True)
        n = np.bincount(place.ravel(), np.bincount(block.place, minlength=len(pair)), len(every)).astype(np.int64)
        return pa.table([pa.array(x) for x in (*np.ascontiguousarray(every.T), n)], ["bucket", "pair", "context", "word", "n"])

    return work


def weights(held: DataFrame, distinct: int, total: int, rounds: int = ROUNDS) -> dict[int, tuple[float, float, float]]:
    """The weights (pairs, words, uniform) of each bucket, by expectation-maximisation over the held-out counts."""
    p2 = F.when(F.col("pair") > 0, F.col("pair") / F.col("context")).otherwise(0.0)
    table = staged(
        held.groupBy("bucket", "pair", "context", "word")
        .agg(F.sum("n").alias("n"))
        .select("bucket", "n", p2.alias("p2"), (F.col("word") / float(max(total, 1))).alias("p1"), F.lit(1.0 / (distinct + 1)).alias("p0"))
    )
    found = {r["bucket"]: (0.4, 0.4, 0.2) for r in table.select("bucket").distinct().collect()}
    for _ in range(rounds if found else 0):
        parts = [F.create_map(*[F.lit(x) for b, w in sorted(found.items()) for x in (b, w[i])])[F.col("bucket")] * F.col(f"p{2 - i}") for i in range(3)]
        whole = parts[0] + parts[1] + parts[2]
        shares = table.groupBy("bucket").agg(*[F.sum(F.col("n") * part / whole).alias(f"s{i}") for i, part in enumerate(parts)])
        # One count of each is added, so that no weight is zero.
        sums = {r["bucket"]: [r[f"s{i}"] + 1.0 for i in range(3)] for r in shares.collect()}
        found = {b: tuple(x / sum(s) for x in s) for b, s in sums.items()}
    return found


def _scores(buckets: int, found: dict, distinct: int, total: int):
    def work(own: pa.Table, answers: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not own.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names)
        block = Known(own.to_pylist()[0], answers, buckets, (0, 1))
        pair, context, word = block.pair, block.context, block.word
        bucket = bucket_of(context)
        table = np.empty((int(bucket.max()) + 1, 3))
        for b in range(len(table)):
            near = min(found, key=lambda x: (abs(x - b), x)) if found else None  # a bucket without held-out counts takes the next one's
            table[b] = found[near] if near is not None else (0.4, 0.4, 0.2)
        if not total:
            table[:] = (0.0, 0.0, 1.0)
        table[0] = (0.0, table[0, 0] + table[0, 1], table[0, 2])  # no context: the pairs' share goes to the words
        p = table[bucket, 0] * pair / np.maximum(context, 1)
        p += table[bucket, 1] * word / max(total, 1)
        p += table[bucket, 2] / (distinct + 1)
        base = np.log10((word + 0.1) / (total + 0.1 * (distinct + 1)))
        docs = block.docs
        starts = np.cumsum(docs[:, 3]) - docs[:, 3]
        sums = [np.add.reduceat(v[block.place], starts) for v in ((word > 0).astype(np.int64), base, np.log10(p, out=p))]
        values = (
            pa.array(docs[:, 0], pa.int64(), mask=docs[:, 1] == 0),
            pa.array(docs[:, 2] == TEST),
            pa.array(docs[:, 3]),
            pa.array(sums[0]),
            pa.array(np.full(len(docs), total)),
            pa.array(sums[1]),
            pa.array(sums[2]),
        )
        return pa.table(list(values), names)

    return work


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS, rounds: int = ROUNDS, buckets: int | None = None
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    crc = F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary"))
    fold = F.when(crc % 10 == 0, TEST).when(F.floor(crc / 10) % 10 == 0, HELD).otherwise(COUNTED)
    frame = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), fold.alias("fold"), F.col(f"`{text_col}`").alias("text"))
    if buckets is None:
        chars = frame.agg(F.sum(F.length("text"))).first()[0] or 0
        buckets = max(partitions(spark), -(-chars // BUCKET_CHARS))
    asked = frame.mapInArrow(_ask(buckets, block_tokens), TABLE)
    told = staged(asked.groupBy("target").applyInArrow(_answer(buckets), TABLE))
    facts = [np.frombuffer(bytes(r.docs), np.int64) for r in told.filter("block = -1").select("docs").collect()]  # a row a bucket
    counted_distinct, counted, distinct, total = (int(x) for x in np.sum(facts, axis=0)) if facts else (0, 0, 0, 0)
    told = told.filter("block >= 0")
    own = told.filter("target < 0").select("block", "held", "docs", "tokens", "hashes")
    answers = told.filter("target >= 0").select("block", "held", "target", "docs", "tokens")

    def met(left, right, work, schema):
        return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(work, schema)

    held = met(own.filter("held"), answers.filter("held"), _held_counts(buckets), "bucket long, pair long, context long, word long, n long")
    found = weights(held, counted_distinct, counted, rounds)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return met(own, answers, _scores(buckets, found, distinct, total), schema)
