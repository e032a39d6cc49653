import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from listingflow.llm import phrases
from listingflow.llm.common import ready
from tests.llm.cases import docs, no_docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_count, max_words=5, keep=2_000, share=100):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, max_words + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    out = {}
    candidates = {p: a for p, a in f.items() if a >= min_count and len(p[1]) > 1}
    for (lang, words), a in candidates.items():
        longer = (
            b
            for (g, other), b in candidates.items()
            if g == lang and len(other) > len(words) and any(other[i : i + len(words)] == words for i in range(len(other)))
        )
        if any(100 * b >= share * a for b in longer):
            continue
        score, _, left, right = min(
            (1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k, f[lang, words[:k]], f[lang, words[k:]])
            for k in range(1, len(words))
        )
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, i + 1, p.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items()
        for i, (s, a, p, left, right) in enumerate(sorted(found)[:keep])
    )


def rows_of(frame):
    return sorted(tuple(r) for r in frame.collect())


def corpus(seed, n=300, words=40):
    draw = random.Random(seed)
    vocabulary = [draw.choice("abcdefgÉß漢") * draw.randint(1, 3) + str(draw.randint(0, 9)) for _ in range(words)]
    fixed = ["In the Beginning was", "one two Three four five six seven", "x x x x x x x"]

    def text():
        parts = []
        for _ in range(draw.randint(0, 40)):
            parts.append(draw.choice(fixed) if draw.random() < 0.1 else vocabulary[min(int(draw.expovariate(0.15)), words - 1)])
            parts.append(draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b", " ; "]))
        return "".join(parts)

    return [(i, text(), draw.choice(["en", "de", None, "und"])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, g, "c", 1) for i, t, g in rows], "doc_id long, text string, lang string, phrase string, n int")


@pytest.mark.parametrize("every", [1, 3, 1_000])
@pytest.mark.parametrize("filter_bits", [1 << 16, 1 << 31])
def test_like_brute_force(spark, every, filter_bits):
    """Also where the sample proposes nearly nothing, so that all comes from border failures, and the filter is small."""
    ready(spark)
    rows = corpus(every)
    wanted = brute(rows, 5)
    assert len(wanted) > 100
    assert rows_of(phrases.collocations(frame(spark, rows), min_count=5, every=every, filter_bits=filter_bits)) == wanted


def test_the_sample_makes_no_difference(spark):
    """Proposals of a sample without documents: everything is counted ahead."""
    ready(spark)
    data = frame(spark, corpus(7))
    full, _ = phrases.frequent(data, min_count=5, every=1)
    poor, _ = phrases.frequent(data, min_count=5, every=100_000)
    assert rows_of(full) == rows_of(poor)


def test_phrases_under_one_hash_are_told_apart(spark, monkeypatch):
    """A filter so small that it lets everything through."""
    ready(spark)
    rows = corpus(8)
    assert rows_of(phrases.collocations(frame(spark, rows), min_count=30, every=2, filter_bits=64)) == brute(rows, 30)


def test_ranks_cut_and_shares(spark):
    ready(spark)
    rows = corpus(9)
    got = rows_of(phrases.collocations(frame(spark, rows), min_count=4, keep=7, share=60, every=2, max_words=3))
    assert got == brute(rows, 4, 3, 7, 60)


def test_awkward_documents(spark):
    ready(spark)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs(spark).collect()]
    assert rows_of(phrases.collocations(docs(spark), min_count=3)) == brute(rows, 3)
    assert phrases.collocations(no_docs(spark)).collect() == []


def test_stretches_and_blocks_make_no_difference(monkeypatch):
    text = "One two three. one TWO three four, one two\tthree four five six " * 30

    def counted(stretch):
        monkeypatch.setattr(phrases, "STRETCH_BYTES", stretch)
        block = phrases.Block(b"en")
        for words, old in phrases.tokens(text.encode(), 4):
            block.add(words, old)
        everything = phrases.Filter(np.full(1, 2**64 - 1, np.uint64))
        found = block.count(phrases.Plan(1, 5, 5, everything, phrases.Filter(None)))
        return {(k, p): n for k, _, ps, ns in found for p, n in zip(ps, ns, strict=True)}

    whole = counted(1 << 20)
    assert whole[5, b"two three four five six"] == 30 and whole[0, b""] == 30 * 13
    for stretch in (1, 5, 17, 64):
        assert counted(stretch) == whole


def test_counts_by_hash_are_those_by_name():
    block = phrases.Block(b"en")
    for words, old in phrases.tokens("a b c a b, c a b d é é é é a b c".encode(), 4):
        block.add(words, old)
    everything, nothing = phrases.Filter(np.full(1, 2**64 - 1, np.uint64)), phrases.Filter(None)
    named = [(k, h.tolist(), n.tolist()) for k, h, _, n in block.count(phrases.Plan(1, 5, 5, everything, nothing)) if k]
    assert [(k, h.tolist(), n.tolist()) for k, h, _, n in block.count(phrases.Plan(1, 5, 0, nothing))] == named
    assert len({x for _, h, _ in named for x in h}) == sum(len(h) for _, h, _ in named)


class Listed:
    """A filter of the phrases it was given, among them one that stands for a mistake of a Bloom filter."""

    def __init__(self, *names):
        self.hashes = set()
        for name in names:
            first, *rest = (phrases.word_hash(b"en", x) for x in name.encode().split())
            code = np.array([first], np.uint64)
            for word in rest:
                code = phrases.mixed(code, np.array([word], np.uint64))
            self.hashes.add(int(code[0]))

    def holds(self, hashes):
        return np.array([int(h) in self.hashes for h in hashes], bool)


def test_a_proposed_phrase_whose_part_was_not_proposed_is_counted_ahead():
    """The filter of proposals holds "a b" by mistake: without "a" the first reading never made it, nor "a b c"."""
    block = phrases.Block(b"en")
    for words, old in phrases.tokens("a b c d. a b c d. a b c d".encode(), 4):
        block.add(words, old)
    proposed = Listed("b", "c", "d", "a b", "b c", "c d", "b c d")
    first = {h for _, hashes, _, n in block.count(phrases.Plan(1, 5, 5, proposed)) for h in hashes.tolist()}
    known = Listed()
    known.hashes = first
    named = {p: n for k, _, found, ns in block.count(phrases.Plan(1, 5, 5, known, proposed)) for p, n in zip(found, ns.tolist(), strict=True) if k}
    every = ["a", "b", "c", "d", "a b", "b c", "c d", "a b c", "b c d", "a b c d"]
    assert named == {p.encode(): 3 for p in every}


def test_names_are_handed_on_once_a_core_not_once_a_partition(spark):
    """Each of 96 partitions holds the same phrases."""
    ready(spark)
    cores = spark.sparkContext.defaultParallelism
    text, send = "one two three four. One two", spark.sparkContext.broadcast
    texts = spark.range(0, 96 * 5, 1, 96).selectExpr(f"'{text}' AS text", "'en' AS lang")
    everything, nothing = send(np.full(1, 2**64 - 1, np.uint64)), send(np.zeros(1, np.uint64))
    wanted = {"": 6, "one": 2, "two": 2, "one two": 2} | dict.fromkeys(["three", "four", "two three", "three four", "one two three"], 1)
    wanted |= dict.fromkeys(["two three four", "one two three four"], 1)
    rows = phrases.handed_on(texts, 5, everything, nothing).collect()
    assert len(rows) <= cores * len(wanted)
    total = Counter()
    for row in rows:
        total[row["lang"], row["k"], row["phrase"]] += row["n"]
    assert total == {("en", len(p.split()), p): n * 96 * 5 for p, n in wanted.items()}
    assert rows_of(phrases.by_name(texts, 5, everything, nothing)) == sorted((*key, n) for key, n in total.items())


@pytest.mark.parametrize("held", [1, 5, 40, 100_000])
def test_what_a_task_holds_makes_no_difference(monkeypatch, held):
    """A task names a phrase once, however many blocks hold it, or anew when it holds too many."""
    monkeypatch.setattr(phrases, "HELD", held)
    monkeypatch.setattr(phrases, "BLOCK_WORDS", 50)
    rows = [(t, "und" if g is None else g) for _, t, g in corpus(11, 60)]
    batch = pa.RecordBatch.from_arrays([pa.array([g for _, g in rows]), pa.array([t for t, _ in rows])], ["lang", "text"])
    everything = phrases.Filter(np.full(1, 2**64 - 1, np.uint64))
    plan = phrases.Plan(1, 5, 5, everything, everything)
    blocks = list(phrases._blocks([batch], plan))
    wanted = Counter()
    for block in blocks:
        for k, _, found, n in block.count(plan):
            wanted.update({(block.lang.decode(), k, p.decode()): c for p, c in zip(found, n.tolist(), strict=True)})
    got = [r for b in phrases.summed(phrases.named(block, plan) for block in blocks) for r in b.to_pylist()]
    total = Counter()
    for row in got:
        total[row["lang"], row["k"], row["phrase"]] += row["n"]
    assert len(blocks) > 10 and total == wanted
    if held == 100_000:
        assert len(got) == len(wanted)
    assert list(phrases.summed([])) == []


def test_a_languages_cuts_do_not_meet_in_one_task(spark, monkeypatch):
    """No join is dealt by language alone."""
    ready(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = phrases.collocations(frame(spark, corpus(12)), min_count=5, every=1)
        plan = scored._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    keys = [x.split("]")[0].split(", ") for x in plan.split("SortMergeJoin [")[1:]]
    assert len(keys) == 4 and all(len(x) > 1 for x in keys)


def test_large_products_are_exact(spark):
    a, n, left, right = 10**13 + 7, 10**14 + 3, 10**13 + 9, 10**13 + 21
    wide = "cast({}L as decimal(19,0))"
    got = spark.sql(
        f"select (cast(1000 as decimal(4,0)) * {wide.format(a)} * {wide.format(n)}) div ({wide.format(left)} * {wide.format(right)}) as s"
    ).first()["s"]
    assert got == 1000 * a * n // (left * right)
