import math
import random
from collections import Counter, defaultdict

import numpy as np

from listingflow.llm import language
from tests.llm import cases

TEXTS = {
    "en": "the cat and the dog were in the house when the rain came down over there with them",
    "de": "der hund und die katze waren in dem haus als der regen auf das dach gefallen ist",
    "fr": "le chien et le chat dans la maison quand la pluie est venue sur le toit avec eux",
}


def corpus(spark, n=240):
    draw = random.Random(5)
    rows = []
    for i in range(n):
        lang = ["en", "de", "fr"][i % 3]
        rows.append((i, " ".join(draw.choice(TEXTS[lang].split()) for _ in range(draw.randint(4, 30))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def plain_bits(texts, order, text):
    """Code length by walking the contexts one byte after the other."""
    counts = defaultdict(Counter)
    for t in texts:
        data = b"\0" * order + t
        for at in range(order, len(data)):
            for k in range(order + 1):
                counts[data[at - k : at]][data[at]] += 1
    bits, data = 0.0, b"\0" * order + text
    for at in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = counts.get(data[at - k : at])
            if not seen:
                continue
            total, different = sum(seen.values()), len(seen)
            if seen[data[at]]:
                bits -= math.log2(seen[data[at]] / (total + different))
                break
            bits -= math.log2(different / (total + different))
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact(spark):
    docs = corpus(spark)
    model = language.learn(docs, order=3, rows=10_000)
    own = defaultdict(list)
    for r in docs.collect():
        own[r.lang].append(r.text.encode())
    asked = [b"the rain", "größe über".encode(), b"", b"\x00\xff zzz", TEXTS["fr"].encode()]
    found = model.score_all(asked)
    for row, text in zip(found, asked, strict=True):
        want = [plain_bits(own[g], 3, text) for g in model.languages]
        assert np.allclose(row, want)


def test_stretches_carry_their_context(spark, monkeypatch):
    model = language.learn(corpus(spark), order=3)
    text = " ".join(TEXTS.values()).encode() * 5
    whole = model.score_all([text, b"a"])
    monkeypatch.setattr(language, "STRETCH", 37)
    assert np.allclose(model.score_all([text, b"a"]), whole)


def test_held_out_documents_are_told_apart(spark):
    docs = corpus(spark)
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = language.identify(docs).collect()
    held = [r for r in found if r.held_out]
    assert len(found) == 240 and 50 < len(held) < 110
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found)


def test_the_label_of_a_document_is_no_input(spark):
    docs = corpus(spark)
    other = docs.selectExpr("doc_id", "text", "if(pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1, 'xx', lang) AS lang")
    assert cases.rows_of(language.identify(docs)) == cases.rows_of(language.identify(other))


def test_awkward_documents(spark):
    docs = cases.docs(spark)
    found = language.identify(docs).collect()
    assert len(found) == docs.count()
    assert {r.lang_pred for r in found if r.doc_id in (4, 5, 6, 10)} == {"und"}
    assert all((r.lang_pred == "und") == (r.score == 0) for r in found)
    kept = language.keep_identified(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 2, 3, None, 7, 8, 9, 11, 12}
    assert language.identify(cases.no_docs(spark)).count() == language.keep_identified(cases.no_docs(spark)).count() == 0
    untaught = docs.selectExpr("doc_id", "text", "cast(null as string) AS lang")
    assert {r.lang_pred for r in language.identify(untaught).collect()} == {"und"}


def test_the_sample_is_bounded_whatever_the_ids(spark, monkeypatch):
    """Rows without ids, with few ids, and one row many times over; no language goes without a sample."""
    rows = [(None, f"english words number {i}", "en") for i in range(3_000)]
    rows += [(i % 5, f"deutsche wörter nummer {i}", "de") for i in range(3_000)]
    rows += [(7, "une seule phrase", "fr")] * 3_000
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    monkeypatch.setattr(language, "Model", lambda languages, order, grams: grams)
    grams = language.learn(docs, order=1, rows=300)
    # How many single bytes were counted tells how many texts were taken.
    taken = {lang: int(count.sum()) for (lang, n), (_, count) in grams.items() if n == 1}
    assert set(taken) == {"en", "de", "fr"}
    assert taken["en"] < 500 * 26 and taken["de"] < 500 * 28 and taken["fr"] < 20
    assert taken["en"] > 150 * 20 and taken["de"] > 150 * 20
