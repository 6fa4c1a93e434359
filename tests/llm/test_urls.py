import random
import re

import pytest

from crowdtrust.llm import url_filter as uf


def pages(spark, rows):
    return spark.createDataFrame([(*r, "own", "own", "own") for r in rows], "page_id long, url string, host string, rule string, verdict string")


def brute(url, rules=uf.RULES, strict=uf.STRICT, soft=uf.SOFT, several=uf.SEVERAL):
    lower = lambda s: re.sub("[A-Z]", lambda m: m[0].lower(), s)
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = lower(host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    alone = lambda t: re.search(f"(?<![a-z0-9\x80-\U0010ffff]){re.escape(t)}(?![a-z0-9\x80-\U0010ffff])", lower(url or ""))
    hard, mild = sorted(t for t in strict if alone(t)), sorted(t for t in soft if alone(t))
    own = "block" if hard or len(mild) >= several else "allow"
    return (host, path, max(fits)[3], max(fits)[4], hard, mild) if fits else (host, path, None, own, hard, mild)


def check(spark, urls, **kw):
    rows = [(i, u) for i, u in enumerate(urls)] + [(None, urls[0])] * 2
    out = sorted((tuple(r) for r in uf.judge(pages(spark, rows).repartition(3), **kw).collect()), key=repr)
    assert out == sorted(((i, *brute(u, **kw)) for i, u in rows), key=repr)


URLS = [
    None, "", "://", "no scheme casino", "http://", "http://net", "http://net/", "http://a.net/x", "http://planet/x", "HTTP://A.Example.NET/en/x", "http://example.net/EN/",
    "http://example.net/en", "http://example.net/en/?x=1", "http://xexample.net/en/", "http://example.com/de/", "https://b.a.example.com/de/x#y", "http://example.com/", "http://a.org/fr/",
    "http://a.org?/fr/", "http://a.org#/fr/", "http://a://b.net/", "x://casino.com/", "http://casinos.com/", "http://my-CASINO-win.com", "http://free.com/win", "http://free.com/free-free",
    "http://freewin.com/", "http://free_win.com/", "http://a.com/éfree/win", "http://a.com/free%20win", "http://user:pw@a.net:80/x", "http://a.net:80/", "a\nb://c.net/\nd?e", "http://.net/",
    "http://net./", "http://a.com/x?free#win", "http://a.com/pills.html?ref=x", "http://a.com/" + "free/" * 9, "http://a.com/" + "y" * 50_000 + "/casino", "http://ünï.net/ñ",
]


def test_judge(spark):
    check(spark, URLS)


def test_longest_rule_and_own_lists(spark):
    rules = [("allow", "a.b", "/"), ("block", "b", "/xyz"), ("allow", "b", "/xyz"), ("block", "a.b", "/x"), ("allow", "b", "/x"), ("block", "c", ""), ("allow", "", "/")]
    urls = [f"s://{h}{p}" for h in ("a.b", "z.a.b", "b", "ab", "c", "x.c", "", "d", "d.") for p in ("", "/", "/x", "/xyz", "/xyzz")]
    check(spark, urls, rules=rules, strict=["b-c", "n", "both"], soft=["both", "d", "x", "a.b", "z"], several=2)
    check(spark, URLS, rules=[], strict=[], soft=[])


def test_random_urls(spark):
    r = random.Random(7)
    parts = ["free", "win", "casino", "x", "-", ".", "/", "?", "#", "://", "net", "org", "example", "com", "é", "1", "en/", "de/", "fr/", "A"]
    check(spark, ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(3000)])


def test_empty_table_and_bad_lists(spark, monkeypatch):
    assert uf.judge(pages(spark, [])).collect() == []
    with pytest.raises(ValueError):
        uf.judge(pages(spark, []), rules=[("maybe", "a", "/")])
    with pytest.raises(ValueError):
        uf.judge(pages(spark, []), soft=[""])
    monkeypatch.setattr(uf, "MAX_RULES", 1)
    with pytest.raises(ValueError):
        uf.judge(pages(spark, []))
