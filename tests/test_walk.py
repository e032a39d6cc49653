"""Reading JSON of any depth, against the standard library where that can read it."""

import json
import random
import time
from html import parser

import pytest
from pyspark.sql import functions as F

from listingflow.functions import vocabulary as V
from listingflow.operators.gazetteer import Gazetteer
from listingflow.sources import walk
from listingflow.sources.dom import Outline, candidates
from listingflow.sources.collect import collect_source
from listingflow.sources.registry import extract_all
from listingflow.sources.specs import PORTAL, RAKUYA, SPECS

from .fixtures import gazetteer

DEEP = 200_000
TEXTS = [
    "", " ", "null", "1", "-0.5e3", '"a"', "[]", "{}", '{"a": {"b": [{"c": 1}, []]}, "d": 2}', '[1, "x\\u00e9\\n", true, null]',
    '{"a": 1, "b": {"c": 2}, "a": {"d": 3}, "e": 4}', "{bad", "[1,]", '{"a"}', '{"a":}', '{"a": 1,}', "[}", "{]", "1 2", "01", "1.",
    '"\t"', '"\\x"', "tru", "NaN", "-Infinity", '{"a": [1, 2}', "][", ",", '{"a": 1 "b": 2}', '{1: 2}', " []", '["a" "b"]', "[[]", "[]]",
]


def plain(value):
    return json.dumps(value, sort_keys=False)


def library(text):
    try:
        return json.loads(text)
    except ValueError:
        return ValueError


@pytest.mark.parametrize("text", TEXTS)
def test_reads_what_the_library_reads(text):
    found = walk.read(text)
    wanted = library(text)
    if wanted is ValueError:
        assert found is None
    else:
        assert plain(found.root) == plain(wanted)
        for number, (value, span) in enumerate(found.objects):
            assert json.loads(found.text(span)) == value and span == number


def test_random_texts():
    draw = random.Random(1)

    def value(depth):
        kind = draw.random()
        if depth < 5 and kind < 0.3:
            return "{" + ", ".join(f'"{draw.choice("abc")}" : {value(depth + 1)}' for _ in range(draw.randint(0, 4))) + "}"
        if depth < 5 and kind < 0.5:
            return "[" + ",".join(value(depth + 1) for _ in range(draw.randint(0, 4))) + " ]"
        return draw.choice(["1", "2.5", '"x"', '"\\"}"', "null", "true", '"[{"'])

    for _ in range(2_000):
        text = value(0)
        if draw.random() < 0.3:
            at = draw.randint(0, len(text))
            text = text[:at] + draw.choice(["", "{", "]", ",", ":", '"', "1"]) + text[at + draw.randint(0, 1) :]
        found, wanted = walk.read(text), library(text)
        assert (found is None) == (wanted is ValueError), text
        if found:
            assert plain(found.root) == plain(wanted)
            for content, span in found.objects:
                assert json.loads(found.text(span)) == content


def test_any_depth_in_linear_time():
    def seconds(depth):
        start = time.process_time()
        found = walk.read('{"a":[' * depth + "1" + "]}" * depth)
        assert len(found.objects) == depth and found.spans[1][2] == 0
        assert walk.read("[" * depth) is None
        assert list(walk.texts_under({"sex": found.root}, walk.re.compile("sex"))) == ["1"]
        page = Outline("<div><b>" * depth + "x")
        assert page.strings == ["x"]
        return time.process_time() - start

    seconds(1_000)
    assert seconds(100_000) < 30 * seconds(10_000)


def test_half_characters_become_replacement_characters():
    assert walk.read('{"a\\ud83d": "\\ude00 \\ud83d\\ude00"}').root == {"a�": "� 😀"}


def test_spans_are_cut_out_by_spark(spark):
    rows = [(1, '{"é😀": {"b": [{"c": "😀"}]}, "d": 2}'), (2, "{bad"), (3, None), (4, "[" * DEEP), (5, '{"a":' * 2_000 + "1" + "}" * 2_000)]
    df = spark.createDataFrame(rows, "k int, j string")
    got = walk.walk_objects(df, "k", "j")
    few = got.filter("k = 1").orderBy("pos").collect()
    assert [(r.pos, r.parent, r.object) for r in few] == [
        (0, None, rows[0][1]), (1, 0, '{"b": [{"c": "😀"}]}'), (2, 1, '{"c": "😀"}'),
    ]
    assert {r.k: r.n for r in got.groupBy("k").agg(F.count("*").alias("n")).collect()} == {1: 3, 5: 2_000}


BROKEN = [
    f'<script>window.__INITIAL_STATE__ = {"[" * DEEP}</script>',
    f'<script type="application/ld+json">{"[" * DEEP}</script>',
    '<script type="application/ld+json">' + '{"a":' * DEEP + "1" + "}" * DEEP + "</script>",
    '<script>JSON.parse("' + "[" * DEEP + '")</script>',
    "<div>" * DEEP,
    "<script>window.__INITIAL_STATE__ = " + '{"url":"/rent/1","x":' * 3_000 + '"\\ud800"' + "}" * 3_000 + "</script>",
]


def test_no_page_fails_a_run(spark):
    good = '<a href="https://rent.rakuya.com.tw/detail/77ab01">獨立套房 台北市大安區 8坪 9,000 元/月</a>'
    rows = [(i, RAKUYA.name, "https://rent.rakuya.com.tw/a", html) for i, html in enumerate([good, *BROKEN])]
    rows += [(100 + i, PORTAL.name, "https://rent.591.com.tw/list?kind=2", html) for i, html in enumerate(BROKEN)]
    found, refused = extract_all(spark.createDataFrame(rows, "page_id int, source string, url string, html string"), gazetteer(spark))
    assert ("rakuya", "77ab01") in {(r.source, r.listing_id) for r in found.collect()}
    got = refused.collect()
    assert len(got) == 2 * len(BROKEN) and {r.code for r in got} == {"EMPTY_RESULT"}


def test_values_under_gender_like_keys(spark):
    """Spark's fold against the walk over Python's objects."""
    draw = random.Random(2)
    words = ["限女", "女性", "男女不限", "female", "x", "", "a\"限女", "f"]

    def value(depth=0):
        kind = draw.random()
        if depth < 4 and kind < 0.4:
            return {draw.choice(["gender", "性別", "a", "b:{", "租客身分", "c"]): value(depth + 1) for _ in range(draw.randint(0, 3))}
        if depth < 4 and kind < 0.6:
            return [value(depth + 1) for _ in range(draw.randint(0, 3))]
        return draw.choice([*words, 1, None, True, 2.5])

    rows = [(i, json.dumps(value(), ensure_ascii=draw.random() < 0.3)) for i in range(600)]
    rows += [(900, "{bad 性別"), (901, None), (902, '{"gender": "' + "\\n" * 50_000 + '限女"}'), (903, '{"gender":["限女"]}')]
    df = spark.createDataFrame(rows, "i int, raw string")
    got = {r.i: r.v for r in df.select("i", walk.names_women_only(F.col("raw")).alias("v")).collect()}
    key = walk.re.compile(V.GENDER_KEY_PATTERN)
    texts = [(i, t) for i, raw in rows if raw and (found := walk.read(raw)) for t in walk.texts_under(found.root, key)]
    told = spark.createDataFrame(texts, "i int, t string").select("i", walk.female_only_value(F.col("t")).alias("v"))
    wanted = {r.i for r in told.collect() if r.v}
    assert {i for i, v in got.items() if v} == wanted and len(wanted) > 50 and None not in got.values()


def test_no_python_decides_who_may_rent(spark):
    df = spark.createDataFrame([("{}",)], "raw string").select(walk.names_women_only(F.col("raw")))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_details_of_the_portal(spark):
    """Gaps of the portal's records are filled from its detail pages, three a list page."""

    def card(n):
        return f'<p><a href="https://rent.591.com.tw/{n}">獨立套房 {n} 台北市大安區 {"好" * 240}</a></p>'

    list_url = "https://rent.591.com.tw/list?kind=2&region=1"
    html = "".join(card(204_801 + i) for i in range(5))
    rows = [(0, 0, 0, list_url, html), (1, 0, 1, list_url + "&page=2", "")]
    pages_ = spark.createDataFrame(rows, "page_id int, search int, page int, url string, html string")
    detail = '<script type="application/ld+json">{"name": "獨立套房", "description": "8坪 大安區", "offers": {"price": 12000}}</script>'
    details = spark.createDataFrame(
        [(100 + i, f"https://rent.591.com.tw/{204_801 + i}", detail) for i in range(5)], "page_id int, url string, html string"
    )
    book: Gazetteer = gazetteer(spark)
    found, refused, kept = collect_source(pages_, PORTAL, book, details)
    got = {r.listing_id: r.rent for r in found.collect()}
    assert got == {str(204_801 + i): 12_000 if i < PORTAL.detail_limit else None for i in range(5)}
    assert PORTAL in SPECS and PORTAL.detail_limit == 3
    assert [r.code for r in refused.collect()] == [] and kept.count() == 2


DEEP_TEXTS = ['{"a":' * DEEP + "1" + "}" * DEEP, "[" * DEEP, '{"t":"\\"[","x":[' * 6_000 + "]}" * 6_000, "[" * DEEP + "}" * DEEP]


@pytest.mark.parametrize("text", DEEP_TEXTS, ids=range(len(DEEP_TEXTS)))
def test_deep_text_is_not_read_sign_by_sign(monkeypatch, text):
    slow = walk.Reading._read
    monkeypatch.setattr(walk.Reading, "_read", lambda *_: pytest.fail("read sign by sign"))
    found = walk.read(text)
    monkeypatch.setattr(walk.Reading, "_read", slow)
    monkeypatch.setattr(walk.Reading, "_read_at_once", lambda self: None)
    wanted = walk.read(text)
    assert (found is None) == (wanted is None)
    if found:
        assert found.spans == wanted.spans and [found.text(i) for i in (0, 5_000)] == [wanted.text(i) for i in (0, 5_000)]


def test_texts_in_layers(monkeypatch):
    """Whatever the depth of a layer, what stands in it is what the library reads; repeated names and half characters too."""
    monkeypatch.setattr(walk, "LAYER", 2)
    for text in [*TEXTS, '{"a": [[[{"b": [0.01e0, "]", {}]}]], -1]}', "[[[[1]]]] ", '[-{"a": [[]]}]', "[1[[]]]", "[[[]5]]"]:
        text = text.strip(" \t\n\r")
        if text[:1] in ("[", "{"):
            wanted = library(text)
            try:
                value, end, _ = walk._scan_deep(text)
                got = value if end == len(text) else ValueError
            except (ValueError, StopIteration):
                got = ValueError
            assert (got is ValueError) == (wanted is ValueError) and (got is ValueError or plain(got) == plain(wanted)), text
    for raw in ['{"a": 1, "a": {"b": 2}}', '["\\ud800"]', '["\\ud83d\\ude00"]', '["\\\\ud83d\\ude00"]']:
        at_once = walk.read(raw)
        monkeypatch.setattr(walk.Reading, "_read_at_once", lambda self: None)
        assert (at_once.root, at_once.spans, at_once.repeated) == (walk.read(raw).root, walk.read(raw).spans, walk.read(raw).repeated)
        monkeypatch.undo()


MARKUP = [
    "<p>a &amp; b<br>c</p>", '<a href="/x?a=1&amp;b" title=q>t</a><img src=\'y\' /><li>1<li>2', "<!doctype html><title>a - b</title><!-- c --><b>&lt;</b",
    "<script>if (a<b) {}</script>x<style>p{}</STYLE >y", "<script>x</scr", "<title>a <b>c</title>", "<textarea><p></textarea>", "a < b <1>", "<div a=1/>z",
    "<!-- a -- b -->", "<?pi?>x", "</p x>y", "<script/>a", '<p a="1"b="2">', "<a href=x\ty>&copy", "<P CLASS='A B'>Q</p >", "&", "", "</ script>",
]


def test_plain_markup_is_read_as_the_library_reads(monkeypatch):
    parts = ("names", "attrs", "parents", "last", "text_from", "text_to", "strings", "owners", "hidden")
    texts = [*MARKUP, *(a + b for a in MARKUP for b in MARKUP)]
    found = [Outline(t) for t in texts]
    monkeypatch.setattr(Outline, "_read_plain", lambda *_: False)
    for text, page in zip(texts, found, strict=True):
        other = Outline(text)
        assert [getattr(page, p) for p in parts] == [getattr(other, p) for p in parts], text


def test_pages_that_tell_nothing_are_not_parsed(monkeypatch):
    """Only scripts, links and detail pages tell of records; plain markup needs no general parser."""
    rules = RAKUYA.page_rules()
    monkeypatch.setattr(parser.HTMLParser, "feed", lambda *_: pytest.fail("the library's parser was asked"))
    assert Outline("<p>a<b>c").names == ["", "p", "b"]
    monkeypatch.setattr("listingflow.sources.dom.Outline", lambda *_: pytest.fail("parsed"))
    assert list(candidates("https://x.example/list", "<div><b>" * 20_000, rules)) == []
