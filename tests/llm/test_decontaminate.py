import hashlib
import random
import re

import pytest

from listingflow.llm import decontaminate
from tests.llm import cases


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items, n):
    out = []
    for i, text in docs:
        w, hit, names = words(text), set(), set()
        for name, passage in items:
            p = words(passage)
            k = min(n, len(p))
            for at in range(len(p) - k + 1 if p else 0):
                for place in range(len(w) - k + 1):
                    if w[place : place + k] == p[at : at + k]:
                        hit.update(range(place, place + k))
                        names.add("" if name is None else str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


COLUMNS = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("limit", [1 << 20, 40, 7])
def test_random_texts_and_blocks(spark, limit):
    draw = random.Random(limit)
    text = lambda low, high: "".join(draw.choice(["Ab", "b", "c9", "é"]) + draw.choice([" ", "-", "\n", "! "]) for _ in range(draw.randint(low, high)))
    docs = [(i, text(0, 40)) for i in range(60)]
    items = [(i % 9, text(0, 9)) for i in range(12)] + [(None, "b c9 b c9"), (77, None), (78, "...")]
    found = decontaminate.find_hits(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), n=4, limit=limit
    )
    assert cases.rows_of(found.select(*COLUMNS)) == brute(docs, items, 4)


def test_awkward_documents(spark):
    docs = cases.docs(spark)
    items = spark.createDataFrame([(1, "brown FOX jumps over the lazy dog near the river bank the quick"), (2, None), (3, "x")], "item_id long, text string")
    found = decontaminate.find_hits(docs, items)
    assert cases.rows_of(found.select(*COLUMNS)) == brute([(r.doc_id, r.text) for r in docs.collect()], [(1, items.first().text), (3, "x")], 10)
    clean = decontaminate.clean(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {1, 2, 3, 4, 5, 6, 10, 11, 12, None}
    none = decontaminate.clean(docs, items.limit(0))
    assert none.count() == docs.count()
    assert decontaminate.find_hits(cases.no_docs(spark), items).count() == 0
    assert decontaminate.clean(cases.no_docs(spark), items, remove="spans").count() == 0


def test_spans_are_cut_out(spark):
    docs = spark.createDataFrame([(1, "Keep, this: a b c d. And that"), (2, "clean"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "A-b c D")], "item_id long, text string")
    assert cases.rows_of(decontaminate.clean(docs, items, n=4, remove="spans")) == [(1, "Keep, this: . And that"), (2, "clean"), (3, None)]
