import hashlib
import random
import re

import numpy as np
import pytest

from listingflow.llm import pii
from tests.llm import cases


def brute(text):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans_are_the_patterns():
    draw = random.Random(5)
    parts = ["a", "1", "23", "256", "@", ".", "-", "+", " ", "(", ")", "a@b.c", "x%", "_", "4111111111111111", "\n", "é"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 25)))
        assert pii.base_spans(text) == brute(text)


def test_very_long_runs_take_linear_time():
    for text in ("1" * 300_000, "1." * 150_000, "a" * 300_000 + "@", "a@" * 150_000, "+1 " * 100_000, "1 " * 150_000):
        pii.base_spans(text)
        pii.places_of(text)


def test_gradients():
    tagger = pii.Tagger(3)
    windows = pii.generated_windows(5)
    ids, tags = np.stack([w for w, _ in windows]), np.stack([t for _, t in windows])
    for k in tagger.p:
        tagger.p[k] = tagger.p[k].astype(np.float64)
    _, grad = tagger.step(ids, tags)
    draw = np.random.default_rng(1)
    for k, v in tagger.p.items():
        at = (2, 3) if k == "embed" else tuple(draw.integers(0, s) for s in v.shape)
        old, sides = v[at], []
        for gap in (1e-3, -1e-3):
            v[at] = old + gap
            sides.append(tagger.step(ids, tags)[0])
        v[at] = old
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(grad[k][at], rel=1e-3, abs=1e-4)


@pytest.fixture(scope="module")
def tagger():
    return pii.train(pii.generated_windows(1_500))


def test_held_out_accuracy(tagger):
    test = pii.generated_windows(400, seed=99)
    found = tagger.decode(np.stack([w for w, _ in test]))
    gold = np.stack([t for _, t in test])
    assert (found == gold).mean() > 0.98


def test_added_spans_stay_clear_of_base_spans(tagger):
    texts = [
        "call 212-555-0199 or +1 (415) 555-2671 now",
        "version 1.2.3 of 2024-01-02, 12,500 items at 10:30",
        "no signs at all",
        "x " * 200 + "reach me at 212-555-0199 please " + "y " * 200,
    ]
    bases = [pii.base_spans(t) for t in texts]
    added = pii.added_spans(tagger, texts, bases)
    assert added[1] == added[2] == []
    for base, new in zip(bases, added, strict=True):
        assert not any(a < y and x < b for _, a, b in base for _, x, y in new)
    assert [texts[3][a:b] for k, a, b in added[3] if k == "phone"] == ["212-555-0199"]


def test_windows_cover_every_sign_and_reconcile():
    draw = random.Random(1)
    for _ in range(300):
        text = "".join(draw.choice("ab 1@" if draw.random() < 0.2 else "ab ") for _ in range(draw.randint(0, 400)))
        places = pii.places_of(text)
        for m in pii.SIGN.finditer(text):
            assert any(p <= m.start() < p + pii.WINDOW for p in places)
        gold = np.array([1 if c in "1@" else 0 for c in text.ljust(len(text) + pii.WINDOW)])
        tags = np.array([gold[p : p + pii.WINDOW] for p in places]).reshape(-1, pii.WINDOW)
        found = pii.reconciled(len(text), places, tags)
        assert [a for _, a, _ in found] == [m.start() for m in re.finditer("[1@]", text)]


def test_awkward_documents(spark):
    docs = cases.docs(spark)
    found = pii.find(docs).collect()
    want = sorted((str(r.doc_id), hashlib.sha256(pii.written(brute(r.text or "")).encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r.doc_id), r.base_sha256) for r in found) == want
    assert pii.find(cases.no_docs(spark)).count() == 0
    private = spark.createDataFrame([(1, "é 😀 to a.b1@c.de, 10.0.0.1 and +1 (415) 555-2671"), (2, None), (2, "")], "doc_id long, text string")
    row = next(r for r in pii.find(private).collect() if r.doc_id == 1)
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 1, 0, 1)
    assert row.spans == pii.written(brute(private.first().text))
    assert cases.rows_of(pii.mask(private)) == cases.rows_of(
        spark.createDataFrame([(1, "é 😀 to [email], [ip] and [phone]"), (2, None), (2, "")], "doc_id long, text string")
    )


def test_spoken_emails_and_digits_of_any_script(tagger):
    arabic = "212-555-0199".translate({48 + i: 0x660 + i for i in range(10)})
    wide = "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in "212-555-0199")
    wanted = [("email", "jane at example dot com"), ("email", "jane AT example.com"), ("phone", arabic), ("phone", wide)]
    texts = [f"please write to me: {value} thank you very much" for _, value in wanted]
    prose = ["she looked at the river. a dot on the map and nothing at all", "we met at noon and were at home again", "x " * 50 + "look at this"]
    added = pii.added_spans(tagger, [*texts, *prose], [pii.base_spans(t) for t in [*texts, *prose]])
    assert [[(k, t[a:b]) for k, a, b in new] for t, new in zip(texts, added, strict=False)] == [[w] for w in wanted]
    assert added[len(texts) :] == [[], [], []]
    assert pii.checked("email", "jane at example dot com") and not pii.checked("email", "jane at example")
