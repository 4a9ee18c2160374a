from __future__ import annotations

import fnmatch
import random
import re

import pytest

from envtally.llm import url_filter

PAGES = "page_id long, url string, host string, rule string"
URLS = [
    None, "", "example.net/en/1", "http://example.net/en/1", "https://WWW.Example.NET/en/", "http://a.example.net/EN/1",
    "http://example.net", "http://example.net?x=/en/", "http://example.com/de/1", "http://x.example.com/de", "http://badexample.com/de/1",
    "http://example.org/fr/9#top", "ftp://org/fr/", "http://x.org/en/fr/", "http://a.net:80/x", "a://b://c.net/x", "http://net/",
    "http:///net/", "http://exa*mple.net/?en/", "http://É.NET/ü/😀", "http://example.net/en/" + "x" * 5000, "http://a\tb.net/\n",
]


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [
        (len(h + p), h + p, verdict)
        for verdict, h, p in url_filter.RULES
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    _, rule, verdict = max(fits, default=(0, None, "allow"))
    return host, path, rule, verdict


def test_verdicts_equal_brute_force(spark):
    rows = [(n, u, "clash", "clash") for n, u in enumerate(URLS)] + [(None, URLS[3], "", ""), (3, URLS[3], None, None)]
    pages = spark.createDataFrame(rows, PAGES)
    got = sorted(map(tuple, url_filter.judge(pages).collect()), key=str)
    assert got == sorted([(r[0], *brute(r[1])) for r in rows], key=str)
    assert url_filter.judge(pages.limit(0)).collect() == []


@pytest.mark.parametrize("count", [1, 7, 60])
def test_globs_equal_fnmatch(count):
    rng = random.Random(count)
    patterns = ["".join(rng.choice("ab*?c") for _ in range(rng.randint(0, 12))) for _ in range(count)] + ["", "*", "**a", "\\*a"]
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(300)] + ["", "*a", "😀a"]
    got = url_filter.Globs(patterns).matches(texts)
    for p, column in zip(patterns, got.T):
        wanted = [t == "*a" if p == "\\*a" else fnmatch.fnmatchcase(t, p) for t in texts]
        assert column.tolist() == wanted, p


def test_globs_decide_where_no_rule_fits(spark):
    pages = spark.createDataFrame([(1, "http://a.io/x.exe"), (2, "http://a.io/ok"), (3, "http://x.org/fr/a.exe")], "page_id long, url string")
    got = url_filter.judge(pages, globs=[("block", "*\t*.exe")]).select("page_id", "rule", "verdict").collect()
    assert sorted(map(tuple, got)) == [(1, None, "block"), (2, None, "allow"), (3, "org/fr/", "allow")]


def test_a_tab_is_no_border(spark):
    """No rule or glob takes a part of the path for the host, or a tab for what divides them."""
    urls = ["http://a.com/x.net\t/y", "http://a.com\t/x.net/", "http://b.net\t/", "http://a.io/x\ty.exe", "http://a\tio/z"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, globs=[("block", "*\t*\t?.exe"), ("block", "a\t*")]).orderBy("page_id").collect()
    assert [(r.rule, r.verdict) for r in got] == [(brute(u)[2], brute(u)[3] if i != 3 else "block") for i, u in enumerate(urls)]
    assert [r.rule for r in got] == [None] * 5


def test_the_globs_of_the_query(spark):
    """Inner ``*`` and ``?`` decide, and only where no rule fits."""
    urls = {
        "http://spam-farm.example.org/en/1": "block", "http://www.spam-farm.io/": "block", "http://spam-farms.io/": "allow",
        "http://spam-farm.io": "allow", "http://spam-farm.example.org/fr/1": "allow", "http://cheap-pills.example.com?x": "block",
        "http://cheap-pills.io/": "allow", "http://ads-track.example.org/en/7": "block", "http://ads-track.example.org/eng/7": "allow",
        "http://x.ads-track.org/en/7": "allow", "http://cheap-x.example.net/en/": "allow",
    }
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages, globs=url_filter.GLOBS).orderBy("page_id").collect()
    assert [r.verdict for r in got] == list(urls.values())
