"""Phrase collocations by Toivonen's sampling method.

Phrases are counted per language. First a sample of the documents (a fixed share, drawn by a hash of id and text)
proposes phrases: those frequent in it at a lowered threshold, found in three readings of the sample (words, pairs,
longer ones made of proposed pairs). Then one reading of all documents counts every proposed phrase together with the
negative border: phrases that weren't proposed, but whose first and last part (all words but one) were; of words, all.
A border phrase that turns out frequent is a failure: phrases that hold it may be frequent and uncounted.

These counts are by 64-bit hashes, so that the many rare phrases of the border cross the network as two numbers each;
two phrases under one hash can only make a count too high. The expansion reading counts by name, exactly, all phrases
whose hash is frequent, and ahead, whatever their hash, those that the first reading could not count: phrases with a
part that was neither proposed nor in the border of what was. A phrase counted ahead may be a part in its turn. So by
induction on the number of words every frequent phrase is counted by name, whatever the sample held: its parts are
frequent and were counted; either the first reading has counted it too, and its hash is frequent, or it is counted ahead.
One expansion therefore closes the border.

What is proposed or frequent reaches the tasks as a Bloom filter of 16 bits a phrase, at most ``filter_bits`` of them
in all; a phrase it lets through by mistake is counted like others and costs only work. Tasks count in blocks of
words by sorting pairs of codes, and Spark adds the blocks' counts up; no phrase, word or language is held in one place.
In the reading by name tasks first add up what they read themselves, and there are as many of them as cores.

Scores are exact integers (decimals of 38 digits in products). Joins of candidates with the counts of their parts and
the ranking (by language and a salt first, then by language) are Spark's.

Defined results: null and empty texts have no words; a null language is ``und``. A candidate's lowest-scoring cut
counts, ties to the shortest first part. Equal scores and counts rank by the phrase's bytes. Repeated rows count
each time. An empty table gives an empty result. Other columns never clash: only id, text and language are read.
"""

from __future__ import annotations

import re
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingflow.llm.common import staged, utf8

MIN_COUNT = 100
MAX_WORDS = 5
KEEP = 2_000
SHARE = 100
SAMPLE_EVERY = 8
FILTER_BITS = 1 << 31
BITS_A_PHRASE = 16
BLOCK_WORDS = 1_000_000
STRETCH_BYTES = 4 << 20
SALTS = 32
PROBES = 3
ROWS = 50_000
HELD = 2_000_000  # phrases whose counts a task keeps before it hands them on
PARCELS = 16
LEAST_BITS = 1 << 10

# Lower-cases A-Z, makes tabs blanks, and marks the ends of pieces by a byte that UTF-8 never has.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TO = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _ENDS, b"abcdefghijklmnopqrstuvwxyz " + b"\xff" * len(_ENDS))
_GAP = re.compile(rb"[ \xff]")
_MIX = 0x9E3779B97F4A7C15
_NAMED = pa.schema([("lang", pa.string()), ("k", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def tokens(text: bytes, context: int) -> list[tuple[list[bytes], int]]:
    """The text's words with marks between its pieces; a very long text in stretches.

    Each stretch starts with the last ``context`` tokens of the one before; the number says how many these are.
    """
    text = text.translate(_TO)
    out, at, before = [], 0, []
    while at < len(text):
        cut = len(text)
        if cut - at > STRETCH_BYTES:
            found = _GAP.search(text, at + STRETCH_BYTES)
            cut = found.start() if found else cut
        own = text[at:cut].replace(b"\xff", b" \xff ").split()
        out.append((before + own, len(before)))
        before = (before + own)[-context:] if context else []
        at = cut
    return out


class Filter:
    """A Bloom filter over phrases; without bits it holds nothing."""

    def __init__(self, bits: np.ndarray | None):
        self.bits = bits
        self.mask = None if bits is None else np.uint64(64 * len(bits) - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        if self.bits is None:
            return ~out
        for place in places(hashes, self.mask):
            out &= (self.bits[place >> np.uint64(6)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return out


def places(hashes: np.ndarray, mask: np.uint64) -> list[np.ndarray]:
    step = hashes >> np.uint64(33) | np.uint64(1)
    with np.errstate(over="ignore"):
        return [(hashes + np.uint64(i) * step) & mask for i in range(PROBES)]


def word_hash(lang: bytes, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang))


def mixed(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases with one more word."""
    with np.errstate(over="ignore"):
        return (hashes ^ hashes >> np.uint64(29)) * np.uint64(_MIX) + words


class Plan:
    """What one reading counts.

    ``known``, if given, are the phrases that may be parts, checked for those of up to ``checked`` words; longer ones
    whose own parts may be parts may be, too. A named reading counts only phrases that ``known`` holds, and those with
    a part that ``done`` lacks (counted ahead; they may be parts).
    """

    def __init__(self, low: int, high: int, checked: int, known: Filter, done: Filter | None = None):
        self.low, self.high, self.checked, self.known, self.done = low, high, checked, known, done


class Block:
    """Some documents' tokens of one language."""

    def __init__(self, lang: bytes):
        self.lang, self.ids, self.fresh, self.size = lang, [], [], 0
        self.code: dict[bytes, int] = {b"\xff": 0}

    def add(self, words: list[bytes], old: int) -> None:
        code = self.code
        for word in set(words).difference(code):
            code[word] = len(code)
        ids = np.fromiter(map(code.__getitem__, words), np.int64, len(words))
        fresh = np.ones(len(words) + 1, bool)
        fresh[:old] = False
        self.ids += [ids, np.zeros(1, np.int64)]
        self.fresh.append(fresh)
        self.size += len(words) + 1

    def count(self, plan: Plan):
        """(words in a phrase, hashes, phrases (none in a reading by hashes), counts), level by level.

        Level 0 of a named reading is the number of words, under no name.
        """
        names, named = list(self.code), plan.done is not None
        ids, fresh = np.concatenate(self.ids), np.concatenate(self.fresh)
        words = np.array([0, *(word_hash(self.lang, x) for x in names[1:])], np.uint64)
        # Per code: its hash, its last word, its text. Codes of words are their ids, 0 stands between pieces.
        hashes, last, texts = words, np.arange(len(names)), names
        at = np.flatnonzero(ids)
        code, ahead = ids[at], np.zeros(len(names), bool)
        if named:
            yield 0, None, [b""], np.array([fresh[at].sum()], np.int64)
        for k in range(1, plan.high + 1):
            alive = ahead | plan.known.holds(hashes) if k <= plan.checked else np.ones(len(hashes), bool)
            if k >= plan.low:
                n = np.bincount(code, fresh[at + k - 1], len(hashes)).astype(np.int64)
                some = np.flatnonzero((n > 0) & alive if named else n > 0)
                yield k, hashes[some], [texts[i] for i in some.tolist()] if named else None, n[some]
            if k == plan.high:
                return
            # Those that may be parts get new codes; two that overlap in all words but one make a phrase.
            here = alive[code]
            at, code = at[here], (np.cumsum(alive) - 1)[code[here]]
            keep = np.flatnonzero(alive)
            hashes, last = hashes[keep], last[keep]
            if named:
                texts = [texts[i] for i in keep.tolist()]
                done = plan.done.holds(hashes) & ~ahead[keep]  # the first reading had no part that it did not count
            pair = np.flatnonzero(np.diff(at) == 1)
            if not len(pair):
                return
            at, first, second = at[pair], code[pair], code[pair + 1]
            keys, where, code = np.unique(first * len(hashes) + second, return_index=True, return_inverse=True)
            first, second = first[where], second[where]
            hashes, last = mixed(hashes[first], words[last[second]]), last[second]
            ahead = np.zeros(len(keys), bool)
            if named:
                ahead = ~(done[first] & done[second])
                texts = [texts[a] + b" " + names[w] for a, w in zip(first.tolist(), last.tolist(), strict=True)]


def _blocks(batches, plan: Plan):
    """The batches' documents in blocks of about BLOCK_WORDS words, each of one language."""
    blocks: dict[bytes, Block] = {}
    held = 0
    for batch in batches:
        for lang, text in zip(utf8(batch.column("lang")), utf8(batch.column("text")), strict=True):
            for words, old in tokens(text, plan.high - 1):
                if lang not in blocks:
                    blocks[lang] = Block(lang)
                blocks[lang].add(words, old)
                held += len(words)
                if held >= BLOCK_WORDS:
                    yield from blocks.values()
                    blocks, held = {}, 0
    yield from blocks.values()


def by_hash(texts: DataFrame, low: int, high: int, checked: int, known=None) -> DataFrame:
    """hash, n: how often the phrases of ``low`` to ``high`` words occur whose two parts may be parts."""

    def work(batches):
        plan = Plan(low, high, checked, Filter(known.value if known else None))
        for block in _blocks(batches, plan):
            for _, hashes, _, n in block.count(plan):
                for at in range(0, len(n), ROWS):
                    arrays = [pa.array(hashes[at : at + ROWS].view(np.int64)), pa.array(n[at : at + ROWS])]
                    yield pa.RecordBatch.from_arrays(arrays, ["hash", "n"])

    found = texts.select("lang", "text").mapInArrow(work, "hash long, n long")
    return found.groupBy("hash").agg(F.sum("n").alias("n"))


def by_name(texts: DataFrame, high: int, known, done) -> DataFrame:
    """lang, k, phrase, n of the phrases that ``known`` holds or that have a part that ``done`` lacks; words in all as k = 0."""
    return handed_on(texts, high, known, done).groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n"))


def handed_on(texts: DataFrame, high: int, known, done) -> DataFrame:
    """Each task's share of the counts by name.

    Nearly every task meets nearly every frequent phrase. So there are as many tasks as cores, not more of them on a
    larger table: the rows grow as the frequent phrases do, not as these times the tasks.
    """

    def work(batches):
        plan = Plan(1, high, high, Filter(known.value), Filter(done.value))
        yield from summed(named(block, plan) for block in _blocks(batches, plan))

    few = texts.select("lang", "text").coalesce(texts.sparkSession.sparkContext.defaultParallelism)
    return few.mapInArrow(work, "lang string, k int, phrase string, n long")


def named(block: Block, plan: Plan):
    """(parcel, table) of a block's counts by name: the same phrase always goes to the same parcel."""
    parts = [[] for _ in range(PARCELS)]
    for k, hashes, found, n in block.count(plan):
        column = pa.array(found, pa.binary()).cast(pa.string())
        lang, words = pa.scalar(block.lang.decode(), pa.string()), pa.scalar(k, pa.int32())
        level = pa.table([pa.repeat(lang, len(n)), pa.repeat(words, len(n)), column, pa.array(n)], _NAMED)
        parcel = hashes % np.uint64(PARCELS) if k else np.zeros(1, np.uint64)
        for i in range(PARCELS):
            parts[i].append(level.take(np.flatnonzero(parcel == i)))
    return [(i, pa.concat_tables(part)) for i, part in enumerate(parts) if part]


def summed(blocks):
    """The blocks' counts added up by name, in batches: a phrase once, or anew when more than ``HELD`` are held.

    Adding up parcel by parcel takes little memory beside what is held.
    """
    held = [_NAMED.empty_table()] * PARCELS
    settled = [0] * PARCELS
    for block in blocks:
        for i, table in block:
            held[i] = pa.concat_tables([held[i], table])
            if held[i].num_rows > max(1.5 * settled[i], HELD / PARCELS / 4):
                held[i] = _added(held[i])
                settled[i] = held[i].num_rows
        if sum(settled) > HELD:
            for i in range(PARCELS):
                yield from _added(held[i]).to_batches(ROWS)
                held[i], settled[i] = _NAMED.empty_table(), 0
    for table in held:
        yield from _added(table).to_batches(ROWS)


def _added(table: pa.Table) -> pa.Table:
    keys = _NAMED.names[:3]
    return table.group_by(keys, use_threads=False).aggregate([("n", "sum")]).select([*keys, "n_sum"]).rename_columns(_NAMED.names)


def filter_of(hashes: DataFrame, most: int) -> np.ndarray:
    """The Bloom filter of a column ``hash``: a power of two of bits, put together by place."""
    size = max(hashes.count(), 1) * BITS_A_PHRASE
    size = min(max(1 << (size - 1).bit_length(), LEAST_BITS), 1 << (most.bit_length() - 1))

    def work(batches):
        for batch in batches:
            own = batch.column("hash").to_numpy(zero_copy_only=False).view(np.uint64)
            place = np.concatenate(places(own, np.uint64(size - 1)))
            bit = (np.uint64(1) << (place & np.uint64(63))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int32)), pa.array(bit)], ["slot", "bits"])

    parts = hashes.select("hash").mapInArrow(work, "slot int, bits long")
    found = parts.groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most size / 64 rows
    out = np.zeros(size // 64, np.uint64)
    out[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def proposed(texts: DataFrame, min_count: int, max_words: int, every: int, filter_bits: int) -> np.ndarray:
    """The filter of the phrases that a sample proposes."""
    send = texts.sparkSession.sparkContext.broadcast
    sample = texts.filter(F.pmod(F.xxhash64("id", "text"), F.lit(every)) == 0) if every > 1 else texts
    expected = min_count / every
    least = max(2, round(expected - 2 * expected**0.5)) if every > 1 else min_count
    often = F.col("n") >= least
    found = staged(by_hash(sample, 1, 1, 0).filter(often))
    bits = filter_of(found, filter_bits)
    found = found.unionByName(staged(by_hash(sample, 2, 2, 1, send(bits)).filter(often)))
    if max_words > 2:
        both = filter_of(found, filter_bits)
        found = found.unionByName(staged(by_hash(sample, 3, max_words, 2, send(both)).filter(often)))
    return filter_of(found, filter_bits)


def frequent(
    docs: DataFrame,
    min_count: int = MIN_COUNT,
    max_words: int = MAX_WORDS,
    every: int = SAMPLE_EVERY,
    filter_bits: int = FILTER_BITS,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``max_words`` words that occur ``min_count`` times in a language (lang, k, phrase, n), and
    the number of words of each language (lang, n)."""
    send = docs.sparkSession.sparkContext.broadcast
    texts = docs.select(
        F.col(f"`{id_col}`").cast("string").alias("id"),
        F.col(f"`{text_col}`").alias("text"),
        F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
    )
    proposals = send(proposed(texts, min_count, max_words, every, filter_bits))
    often = F.col("n") >= min_count
    hashes = staged(by_hash(texts, 1, max_words, max_words, proposals).filter(often))
    counts = by_name(texts, max_words, send(filter_of(hashes, filter_bits)), proposals)
    counts = staged(counts.filter(often | (F.col("k") == 0)))
    return counts.filter(F.col("k") > 0), counts.filter(F.col("k") == 0).select("lang", "n")


def collocations(docs: DataFrame, keep: int = KEEP, share: int = SHARE, **options) -> DataFrame:
    """Each language's first ``keep`` phrases by score: lang, rank, phrase, a, l, r, n, score."""
    found, totals = frequent(docs, **options)
    counts = found.select("lang", "phrase", F.col("n").alias("f"))
    candidates = found.filter(F.col("k") > 1).select("lang", "k", "phrase", F.col("n").alias("a"))
    cuts = candidates.select("*", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "*",
        F.expr("substring_index(phrase, ' ', cut)").alias("left"),
        F.expr("substring_index(phrase, ' ', cut - k)").alias("right"),
    )
    lefts = counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r"))
    # A language's cuts are dealt out: its total comes once for each salt.
    salt = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    dealt = totals.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    scored = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    scored = scored.withColumn("salt", salt).join(dealt, ["lang", "salt"]).drop("salt")
    wide = "cast({} as decimal(19,0))"
    product = f"cast(1000 as decimal(4,0)) * {wide.format('a')} * {wide.format('n')}"
    scored = scored.withColumn("score", F.expr(f"({product}) div ({wide.format('l')} * {wide.format('r')})"))
    best = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    # A longer phrase occurs no more often than what it holds, so the next longer ones decide for all.
    longer = candidates.filter(F.col("k") > 2).select(
        "lang",
        F.col("a").alias("f"),
        F.explode(F.array(F.expr("substring_index(phrase, ' ', k - 1)"), F.expr("substring_index(phrase, ' ', 1 - k)"))).alias("phrase"),
    )
    within = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    wide_f, wide_a = F.col("f").cast("decimal(19,0)"), F.col("a").cast("decimal(19,0)")
    kept = best.join(within, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (100 * wide_f < share * wide_a))
    rows = kept.select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")
    order = [F.desc("score"), F.desc("a"), "phrase"]
    salted = rows.withColumn("salt", salt)
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order)))
    few = few.filter(F.col("rank") <= keep).drop("rank", "salt")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.filter(F.col("rank") <= keep).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
