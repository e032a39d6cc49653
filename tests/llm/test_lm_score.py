import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from listingflow.llm import lm_score
from tests.llm import cases


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def tokens(text):
    return [*(text or "").encode().translate(lm_score.LOWER).split(), None]


def plain(rows):
    """The model in one process: counts, weights by the same number of rounds, scores."""
    fold = {i: 2 if crc(i) % 10 == 0 else 1 if crc(i) // 10 % 10 == 0 else 0 for i, _ in rows}
    words = [Counter(), Counter()]
    pairs = [Counter(), Counter()]
    held = Counter()
    for i, text in rows:
        if fold[i] < 2:
            t = tokens(text)
            words[fold[i]].update(t)
            pairs[fold[i]].update(zip([""] + t, t, strict=False))
            if fold[i] == 1:
                held.update(zip([""] + t, t, strict=False))

    def model(w, p):
        n, v = sum(w.values()), len(w)
        context = lambda x: w[None] if x == "" else w[x]
        digits = lambda c: c.bit_length()
        parts = lambda a, b: (p[a, b] / context(a) if p[a, b] else 0.0, w[b] / max(n, 1), 1 / (v + 1))
        return n, v, context, digits, parts

    n, v, context, digits, parts = model(words[0], pairs[0])
    weights = {digits(context(a)): (0.4, 0.4, 0.2) for a, _ in held}
    for _ in range(lm_score.ROUNDS if weights else 0):
        sums = {b: [1.0, 1.0, 1.0] for b in weights}
        for (a, b), count in held.items():
            k = digits(context(a))
            each = [x * y for x, y in zip(weights[k], parts(a, b), strict=True)]
            for i in range(3):
                sums[k][i] += count * each[i] / sum(each)
        weights = {k: tuple(x / sum(s) for x in s) for k, s in sums.items()}
    both = words[0] + words[1]
    n, v, context, digits, parts = model(both, pairs[0] + pairs[1])

    def weight(k):
        if not n:
            a = (0.0, 0.0, 1.0)
        else:
            a = weights[min(weights, key=lambda x: (abs(x - k), x))] if weights else (0.4, 0.4, 0.2)
        return a if k else (0.0, a[0] + a[1], a[2])

    out = []
    for i, text in rows:
        t = tokens(text)
        score = sum(math.log10(sum(x * y for x, y in zip(weight(digits(context(a))), parts(a, b), strict=True))) for a, b in zip([""] + t, t, strict=False))
        base = sum(math.log10((both[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)
        out.append((i, fold[i] == 2, len(t), sum(both[x] > 0 for x in t), n, base, score))
    return out


def check(found, rows):
    key = lambda r: (r[0] is None, str(r[0]), r[2], round(r[6], 6))
    found, want = sorted(map(tuple, found.collect()), key=key), sorted(plain(rows), key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in found], [r[5:] for r in want], rtol=1e-9)


@pytest.mark.parametrize("block_tokens", [1 << 20, 200])
def test_scores_are_those_of_the_plain_model(spark, block_tokens):
    draw = random.Random(6)
    rows = [(i, " ".join(f"W{min(draw.randint(0, 60), draw.randint(0, 60))}" for _ in range(draw.randint(0, 50)))) for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    check(lm_score.score(docs, block_tokens=block_tokens), rows)


def test_awkward_documents(spark):
    docs = cases.docs(spark)
    check(lm_score.score(docs), [(r.doc_id, r.text) for r in docs.collect()])
    assert lm_score.score(cases.no_docs(spark)).count() == 0
    alone = spark.createDataFrame([(None, "only held out")], "doc_id long, text string")
    check(lm_score.score(alone), [(None, "only held out")])


def test_packing():
    for values in (np.array([], np.int64), np.array([3, -1, 1 << 60]), np.array([1, 2], np.uint64), np.arange(5, dtype=np.int32)):
        assert (lm_score.unpack(lm_score.pack(values), values.dtype) == values).all()
