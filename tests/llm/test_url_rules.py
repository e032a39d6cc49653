import random

from listingflow.llm import url_rules
from tests.llm import cases


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    stop = min((path.index(c) for c in "?#" if c in path), default=len(path))
    return host, path[:stop]


def brute(rows, rules, default="allow"):
    out = []
    for i, url in rows:
        host, path = parts(url)
        fits = [
            (len(h) + len(p or ""), len(h), h, p or "", v)
            for h, p, v in rules
            if h and (host == h or host.endswith("." + h)) and path.startswith(p or "")
        ]
        best = max(fits, key=lambda f: (f[0], f[1], f[4] == "allow"), default=None)
        out.append((i, host, path, best and best[2] + best[3], best[4] if best else default))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


RULES = "host string, path string, verdict string"


def test_random_urls(spark):
    draw = random.Random(8)
    host = lambda n: ".".join(draw.choice(["a", "b", "ab", "com", "x-y"]) for _ in range(draw.randint(1, n)))
    path = lambda: draw.choice(["", "/", "/a", "/a/b", "/ab", "/b/a/"])
    urls = [(i, f"{draw.choice(['http', 'HTTPS', ''])}://{host(4).upper() if i % 3 else host(4)}{path()}{draw.choice(['', '?u=http://b.com/a', '#/x'])}") for i in range(600)]
    urls += [(1000 + i, "https://hot.a.com/a/b") for i in range(400)]
    urls += [(2000, None), (2001, ""), (2002, "no scheme.com/a"), (2003, "://"), (2004, "x://a\x01b.com/a"), (2005, "x://a..com/"), (2005, "x://a..com/")]
    rules = list({(host(3), path(), draw.choice(["allow", "block"])) for _ in range(60)})
    rules += [(None, "/a", "block"), ("", "/", "block"), ("com", None, "block")]
    pages = spark.createDataFrame(urls, "page_id long, url string").repartition(4)
    found = url_rules.judge(pages, spark.createDataFrame(rules, RULES))
    assert cases.rows_of(found) == brute(urls, rules)


def test_awkward_pages(spark):
    rows = [(1, "http://a.com/x", "<p>", "r", "v"), (None, "http://b.com/", None, None, None), (2, None, "", "", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, row string, verdict string, host string")
    rules = spark.createDataFrame([("com", "/x", "block")], RULES)
    kept = url_rules.keep_allowed(pages, rules)
    assert kept.columns == pages.columns
    assert cases.rows_of(kept) == sorted(rows[1:], key=lambda r: tuple((x is None, str(x)) for x in r))
    assert url_rules.judge(pages.limit(0), rules).count() == 0
    assert cases.rows_of(url_rules.judge(pages, rules.limit(0), "block")) == brute([r[:2] for r in rows], [], "block")
