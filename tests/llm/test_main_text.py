from listingflow.llm import main_text
from tests.llm import cases

SCHEMA = "page_id long, url string, html string, tree string, host string"


def page(n, body, menu="<a href=/>Home</a>"):
    return (
        f"<!DOCTYPE html><html><head><title>T{n}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        f"<header>Site {n}</header><nav><ul><li>{menu}</li></ul></nav><!-- x --><div class='cookie-notice'>We use cookies {n}</div>"
        f"<div class=ad>Buy {n}</div>{body}<aside>More {n}</aside><form><input value=q>Search</form><footer>&copy; {n}</footer></body></html>"
    )


def texts(spark, rows):
    full = [(i, u, h, "t", "h") for i, u, h in rows]
    found = main_text.extract_text(spark.createDataFrame(full, SCHEMA)).collect()
    assert all(r.n_chars == len(r.text) for r in found)
    return sorted(((r.page_id, r.text) for r in found), key=lambda r: (r[0] is None, str(r)))


def test_an_article_without_its_surroundings(spark):
    rows = [
        (n, f"http://a.com/{n}", page(n, f"<article><h1>Head {n}</h1><p><b>Bold &amp; {n}<br><p>Two\n  words&nbsp;{n}<p>Last</article>"))
        for n in range(6)
    ]
    assert texts(spark, rows) == [(n, f"Head {n}\nBold & {n}\nTwo words {n}\nLast") for n in range(6)]


def test_same_text_on_all_pages_is_template(spark):
    body = "<article><h1>Head {n}</h1><div class=byline>By the editors</div><p>Body {n}</p><p>Note</p><div class=comments><p>me {n}</p></div></article>"
    rows = [(n, "http://a.com/", page(n, body.replace("{n}", str(n)))) for n in range(5)]
    assert texts(spark, rows) == [(n, f"Head {n}\nBody {n}\nNote") for n in range(5)]
    # Two pages of a host are too few to tell, and copies of one article aren't template.
    assert texts(spark, rows[:2]) == [(n, f"Head {n}\nBy the editors\nBody {n}\nNote") for n in range(2)]
    copies = [(n, "http://a.com/", rows[0][2]) for n in range(5)]
    assert texts(spark, copies) == [(n, "Head 0\nBy the editors\nBody 0\nNote") for n in range(5)]


def test_without_an_article_the_varying_text_is_found(spark):
    body = "<div id=wrap><div class=left>Menu words</div><div class=body><p>{n} is the first line of a long text</p><p>and {n} the second</p></div></div>"
    rows = [(n, "http://b.com/", page(n, body.replace("{n}", str(n)))) for n in range(5)]
    assert texts(spark, rows) == [(n, f"{n} is the first line of a long text\nand {n} the second") for n in range(5)]


def test_awkward_pages(spark):
    deep = "<article>" + "<div>" * 5_000 + "deep" + "</div>" * 5_000 + "<p>after</article>"
    rows = [
        (1, None, None),
        (2, "", ""),
        (3, "http://c.com/", "plain text, no tags"),
        (4, "http://c.com/", "<article><p>cut &am"),
        (5, "http://c.com/", deep),
        (6, "http://c.com/", "<article><p>" + "word " * 100_000 + "</article>"),
        (7, "http://c.com/", "<article><p>same</article>"),
        (7, "http://c.com/", "<article><p>same</article>"),
        (None, "http://c.com/", "<![if broken]><article><p>x<!-- open"),
    ]
    found = texts(spark, rows)
    assert [r for r in found if r[0] in (1, 2)] == [(1, ""), (2, "")]
    got = {i: t for i, t in found}
    assert got[4].startswith("cut") and got[5] == "deep\nafter" and got[6] == " ".join(["word"] * 100_000) and got[7] == "same"
    assert got[3] == "plain text, no tags" and got[None] == "x" and len(found) == len(rows)
    assert main_text.extract_text(spark.createDataFrame([], SCHEMA)).count() == 0


def test_trees_merge_alike_in_any_order():
    shapes = [main_text.tree_of(main_text.collapsed([main_text.parsed(h)])) for h in ("<div><p>a<ul><li>b</ul></div>", "<div><p>c</p></div><hr>", "<div><ul><li>b</ul></div>")]
    one = main_text.merged(main_text.merged(shapes[0], shapes[1]), shapes[2])
    two = main_text.merged(shapes[2], main_text.merged(shapes[1], shapes[0]))
    assert one == two and one[1] == 3
    assert main_text.weight(shapes[0], shapes[0], lambda t: t[5]) == main_text.size(shapes[0])


def test_declarations_and_comments_do_not_end_the_page():
    for odd, kept in [
        ("<![foo[x]]>", ""),
        ("<![ b>", ""),
        ("x <![0] y>", "x"),
        ("<![CDATA[z]]>", ""),
        ("<!-- x --!>", ""),
        ("<!-->", ""),
        ("<i title='<!--'>t</i>", "t"),
        ("<textarea><!-- </textarea>", ""),
        ("<style><!-- p{} </style>", ""),
    ]:
        found = main_text.extract(f"<article><p>one</p>{odd}<p>two</p></article>", None)
        assert found.split("\n") == ["one", *([kept] if kept else []), "two"], odd
    assert main_text.extract("<html><head><style><!-- p{} </style></head><body><article><p>body</article>", None) == "body"
    assert main_text.extract("<title>never closed<body><article><p>kept</article>", None) == "kept"


def test_nesting_of_any_depth():
    deep = "<div>" * 120 + "</div>" * 120
    assert main_text.extract(f"<div id=wrap><article>{deep}<p>rest</article></div>", None) == "rest"
    for tag in ("b", "font", "span"):
        unclosed = f"<{tag}>" * 20_000
        assert main_text.extract(f"<div><article>{unclosed}a<div>b</div><p>rest</article></div>", None) == "a\nb\nrest"
    hidden = "<article>" + "<div>" * 20_000 + "<script>no</script><nav>no</nav>yes" + "</div>" * 20_000 + "</article>"
    assert main_text.extract(hidden, None) == "yes"
    main_text.any_depth()
    tree = main_text.tree_of(main_text.collapsed([main_text.parsed(hidden)]))
    assert main_text.size(main_text.loaded(main_text.dumped(main_text.merged(tree, tree)))) == main_text.size(tree)


def test_repeated_blocks_in_articles_are_kept(spark):
    def body(n, more=""):
        return f"<article><h1 id=head-{'abcdefghij'[n % 10]}>Head {n}</h1><div class=byline>By the <a>editors</a></div><p>Body {n}</p>{more}</article>"

    slug = "<h2 id=conclusion>Conclusion</h2><p>End</p>"
    block = "<blockquote>Said once</blockquote><table><tr><td>cell</table><div class=quote>Classed</div><div class=sum>Total <b>{n}</b> items</div>"
    rows = [(n, "http://a.com/", page(n, body(n, slug if n % 10 == 3 else ""))) for n in range(30)]
    rows += [(100 + n, "http://a.com/", page(n, body(100, block.replace("{n}", "7")))) for n in range(4)]  # copies
    rows += [(200 + n, "http://d.com/", page(n, f"<article><h1>One head</h1><p>Near copy {n}</article>")) for n in range(3)]
    rows += [(300 + n, "http://e.com/", page(n, body(300, block))) for n in range(9)] + [(309, "http://e.com/", page(9, body(309)))]
    rows += [(400 + n, "http://f.com/", page(n, body(n, block.replace("{n}", str(n))))) for n in range(5)]
    got = dict(texts(spark, rows))
    end = "\nConclusion\nEnd"
    assert [got[n] for n in range(30)] == [f"Head {n}\nBody {n}" + (end if n % 10 == 3 else "") for n in range(30)]
    assert {got[100 + n] for n in range(4)} == {"Head 100\nBody 100\nSaid once\ncell\nClassed\nTotal 7 items"}
    assert [got[200 + n] for n in range(3)] == [f"One head\nNear copy {n}" for n in range(3)]
    # Nine copies and one other article are two pages that differ: too few to tell.
    assert got[300] == "Head 300\nBy the editors\nBody 300\nSaid once\ncell\nClassed\nTotal {n} items"
    assert got[403].startswith("Head 3\nBody 3") and got[403].endswith("Total 3 items")


def test_ids_and_classes_of_few_pages_are_not_layout(spark):
    rows = [(n, "h", f"<div id=content class='post p{chr(97 + n)}'>x</div><i title=\"id='{'no' * n}'\">") for n in range(20)]
    frame = spark.createDataFrame(rows, "id long, host string, html string")
    assert [tuple(r) for r in main_text.layout_words(frame).collect()] == [("h", ["content", "post"])]


def test_listed_names_around_the_text_do_not_drop_it(spark):
    article = "<article><h1>Head {n}</h1><p>Body {n}</p></article>"
    plain = "<div class=left>Menu words</div><div class=body><p>{n} is the first line of a long text</p><p>and {n} the second</p></div>"
    bodies = [
        f"<form id=aspnetForm><nav>Menu {{n}}</nav>{article}<div class=comments>me {{n}}</div></form>",
        *(f"<div {name}>{article}<aside>More {{n}}</aside></div>" for name in (
            "class=content-sidebar-wrap", "class=no-sidebar", "class=has-banner", "id=menu-page", "class='x sidebar'")),
        f"<div class=comments><article>me {{n}}</article></div><main>{article[9:-10]}</main>",
        "<article><div class=elementor-widget><h1>Head {n}</h1><p>Body {n}</p></div><div class=share>To {n}</div></article>",
        f"<form action=x>{plain}<input value=1></form>",
        f"<div class='page no-sidebar'>{plain}<div class=site-footer>Foot {{n}}</div></div>",
    ]
    hosts = range(len(bodies))
    rows = [(100 * h + n, f"http://h{h}.com/", f"<body>{bodies[h].replace('{n}', str(n))}</body>") for h in hosts for n in range(5)]
    got = dict(texts(spark, rows))
    for h in hosts:
        want = "Head 3\nBody 3" if "Head" in bodies[h] else "3 is the first line of a long text\nand 3 the second"
        assert got[100 * h + 3] == want, bodies[h]


def test_a_host_with_several_layouts(spark):
    menu = "<div><div>Menu words</div></div>"
    one = "<div class=a>" + menu + "<div class=body><p>{n} is the first line of a long text</p><p>and {n} the second</p></div></div>"
    two = "<section>" + menu + "<p>{n} is the first line of another text</p><p>and {n} the second</p></section>"
    other = "<article><p>Alone {n}</article>"
    rows = [(0, "http://b.com/", page(0, menu + other.replace("{n}", "0")))]
    rows += [(n, "http://b.com/", page(n, one.replace("{n}", str(n)))) for n in range(1, 9)]
    rows += [(n, "http://b.com/", page(n, two.replace("{n}", str(n)))) for n in range(9, 15)]
    rows += [(15, "http://b.com/", page(15, "<table><tr><td>15 stands in a layout of its own</table>"))]
    got = dict(texts(spark, rows))
    assert got[0] == "Alone 0" and got[15] == "15 stands in a layout of its own"
    assert [got[n] for n in range(1, 9)] == [f"{n} is the first line of a long text\nand {n} the second" for n in range(1, 9)]
    assert [got[n] for n in range(9, 15)] == [f"{n} is the first line of another text\nand {n} the second" for n in range(9, 15)]


def test_a_hot_hosts_tree_is_as_large_as_its_layout(spark):
    def name(n):
        return "".join("abcdefghij"[int(x)] for x in str(n))

    def body(n):
        own = f"<div id={name(n)} class='post {name(n)}-x'><{name(n)}>Own {n}</{name(n)}></div>"
        return f"<article><h1 id=h{name(n)}>Head {n}</h1><div class=byline>By the editors</div>{own}</article>"

    rows = [(n, "http://a.com/", page(n, body(n))) for n in range(400)]
    frame = spark.createDataFrame([("a.com", h) for _, _, h in rows], "host string, html string").coalesce(1)
    frame = frame.join(main_text.layout_words(frame), "host")
    trees = frame.mapInArrow(main_text._partial_trees, "host string, main boolean, salt int, tree string").collect()
    assert max(main_text.size(main_text.loaded(r.tree)) for r in trees) < 40
    known = main_text.wrappers(frame).collect()
    assert len(known) == 1 and known[0].plain is None and len(known[0].main) < 400
    got = dict(texts(spark, rows))
    assert all(got[n] == f"Head {n}\nOwn {n}" for n in range(400))


def test_trees_of_many_nodes_keep_those_of_most_pages(monkeypatch):
    monkeypatch.setattr(main_text, "TREE_NODES", 12)
    whole = None
    for n in range(30):
        page_tree = main_text.tree_of(main_text.collapsed([main_text.parsed(f"<article><p>{n}</p><div class=by>By</div><div class=o{n * 'x'}>{n}</div></article>")]))
        whole = page_tree if whole is None else main_text.pruned(main_text.merged(whole, page_tree))
    assert main_text.size(whole) <= 13
    frames = {True: main_text.wrapper(whole)}
    assert main_text.extract("<article><p>a</p><div class=by>By</div><div class=new>b</div></article>", frames) == "a\nb"


def test_comments_longer_than_the_article(spark):
    talk = "".join(f"<div class=comment><p>reader {n} says {{n}} " + "much more than was written above " * 6 + "</p></div>" for n in range(5))
    plain = "<div class=post><h1>Head {n}</h1><p>The {n} short text</p></div>"
    bodies = [
        f"<article><h1>Head {{n}}</h1><p>The {{n}} short text</p></article><div id=comments>{talk}</div>",
        f"<article><h1>Head {{n}}</h1><p>The {{n}} short text</p><section class=comments>{talk}</section></article>",
        f"{plain}<div id=comments>{talk}</div>",
        f"<div class='x widget'>{plain}</div><div id=comments>{talk}</div>",
        f"{plain}<ol class=comments><li><article>reader {{n}}</article><li><article>{talk}</article></ol>",
        f"<div class=comments>{plain}</div><footer>Foot {{n}}</footer>",
        "<nav>Menu {n}</nav><div class=comments><p>Head {n}</p><p>The {n} short text</p></div>",
        "<article><header class=entry-header><nav>Up</nav><h1>Head {n}</h1></header><p>The {n} short text</p><header>Part {n}</header></article>",
    ]
    hosts = range(len(bodies))
    rows = [(100 * h + n, f"http://h{h}.com/", f"<body>{bodies[h].replace('{n}', str(n))}</body>") for h in hosts for n in range(5)]
    got = dict(texts(spark, rows))
    for h in hosts:
        assert got[100 * h + 3] == "Head 3\nThe 3 short text", bodies[h]
        alone = main_text.extract(rows[5 * h + 3][2], None)
        assert alone == "Head 3\nThe 3 short text", bodies[h]
