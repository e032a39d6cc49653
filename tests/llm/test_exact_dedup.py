import hashlib
import random
import re
from collections import defaultdict

import pytest

from listingflow.llm import exact_dedup
from listingflow.llm.exact_dedup import Owner, Trie
from tests.llm import cases


def brute(rows):
    groups = defaultdict(list)
    for i, text in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", text or "")].append((i, text or ""))
    out = []
    for key, members in groups.items():
        best = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))
        for i, text in members:
            kept = i == best[0] and len(text) == len(best[1])
            out.append((i, best[0], len(members), kept, hashlib.sha256(key.encode()).hexdigest()))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("limit", [1 << 30, 3_000, 400])
def test_trie_spills_and_loses_nothing(limit):
    draw = random.Random(limit)
    trie, want = Trie(limit), {}
    for i in range(3_000):
        key = bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 9))) * draw.choice([1, 1, 30])
        length = draw.randint(1, 3)
        trie.add(key, Owner(length, i))
        want.setdefault(key, []).append((-length, i))
    found = {}
    for key, owner in trie.items():
        assert key not in found
        found[key] = (-owner.length, owner.doc_id, owner.count)
    assert found == {k: (*min(v), len(v)) for k, v in want.items()}


def test_awkward_documents(spark):
    docs = cases.docs(spark)
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert cases.rows_of(exact_dedup.find_copies(docs)) == want
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert len(rows) == len({w[4] for w in want})
    assert {(r.doc_id, r.kept, r.fingerprint, r.ids) for r in rows} >= {(2, True, "f", "i"), (7, True, "f", "i")}
    assert [r for r in rows if r.doc_id == 3] == []
    assert exact_dedup.find_copies(cases.no_docs(spark)).count() == exact_dedup.drop_copies(cases.no_docs(spark)).count() == 0


def test_exact_repeats_leave_one(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "ab"), (None, None), (None, None)], "doc_id long, text string")
    assert cases.rows_of(exact_dedup.drop_copies(docs)) == [(1, "a b"), (None, None)]


def test_ids_of_other_types(spark):
    rows = [("b", "x y"), ("a", "xy"), ("", "x\ty"), (None, "x  y"), ("10", ""), ("9", None), ("é", "z"), ("z", "z"), (None, "q"), ("", "q")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(3)
    found = {(r.doc_id, r.text_sha256): r for r in exact_dedup.find_copies(docs).collect()}
    assert len(found) == len(rows) and exact_dedup.find_copies(docs).schema["keep_id"].dataType.simpleString() == "string"
    xy, q = hashlib.sha256(b"xy").hexdigest(), hashlib.sha256(b"q").hexdigest()
    assert {(i, r.keep_id, r.kept) for (i, t), r in found.items() if t == xy} == {(i, None, i is None) for i in ("b", "a", "", None)}
    assert {(i, r.keep_id, r.kept) for (i, t), r in found.items() if t == q} == {("", "", True), (None, "", False)}
    assert {r.doc_id for r in exact_dedup.drop_copies(docs).collect()} == {None, "", "10", "z"}
    days = docs.selectExpr("date_add(date'2024-01-01', length(text)) AS doc_id", "text")
    assert exact_dedup.drop_copies(days).columns == ["doc_id", "text"] and exact_dedup.find_copies(days).count() == len(rows)


def test_the_order_of_rows_decides_nothing(spark):
    """Rows alike in id and text with other columns that differ, maps among them."""
    rows = [(1, "a b", "z", {"k": 2}), (1, "a b", "y", {"k": 1}), (1, "a\tb", "x", None), (2, "c", "b", None), (2, "c", None, None)]
    ddl = "doc_id long, text string, lang string, extra map<string,int>"
    kept = []
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        docs = spark.createDataFrame(order, ddl).coalesce(1)
        kept.append(sorted(map(str, exact_dedup.drop_copies(docs).collect())))
    assert kept[0] == kept[1] == kept[2] and len(kept[0]) == 2


def test_trie_spills_ids_of_any_kind():
    trie = Trie(300)
    for i in range(200):
        trie.add(bytes([i % 7, i % 5, i % 3]) * 20, Owner(1, None if i % 2 else f"é{i:03}"))
    found = dict(trie.items())
    assert len(found) == 105 and sum(o.count for o in found.values()) == 200
    want = {}
    for i in range(200):
        want.setdefault(bytes([i % 7, i % 5, i % 3]) * 20, []).append((bool(i % 2), "" if i % 2 else f"é{i:03}"))
    assert {k: (o.doc_id is None, o.doc_id or "") for k, o in found.items()} == {k: min(v) for k, v in want.items()}


def test_random_documents(spark):
    draw = random.Random(3)
    rows = [(draw.randint(0, 400), "".join(draw.choice("ab \n") for _ in range(draw.randint(0, 8)))) for _ in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert cases.rows_of(exact_dedup.find_copies(docs)) == brute(rows)
