"""The URL filter against a plain scan of its rules and list."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from opslens.llm import url_filter
from opslens.llm.store import prepared

SCHEMA = "page_id long, url string, html string, host string, row int, key string, verdict string"
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("a.net", "/", "allow"),
    ("org", "", "block"),
    ("org", "", "allow"),
    ("x.org", "/ab", "allow"),
    ("org", "/abc", "block"),
    (None, "/", "block"),
]
URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "http:///en/",
    "HTTP://WWW.Example.COM/en/1?x#y",
    "https://example.com/en",
    "https://example.com/en/",
    "https://badexample.com/en/2",
    "https://m.example.com/en/2",
    "https://b.a.net/es/",
    "https://a.net",
    "https://x.org/abcd",
    "https://y.x.org?q=://z/",
    "https://xorg/abc",
    "https://.org/",
    "https://com./",
    "ftp://other.de:443/a//?ref=1&b=2&utm_source=x&a=1#f",
    "http://Other.de/a?a=1&b=2",
    "http://other.de/a?a=1&b=3",
    "http://other.de/é\n/",
    "http://é.de/x://y",
    "x://" + "a." * 500 + "net/es/" + "p/" * 3000,
]


def split(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    query = rest.split("#")[0].partition("?")[2]
    params = sorted(p for p in query.split("&") if p and not re.match(r"(utm_[^=]*|ref|fbclid|gclid)(=|\Z)", p))
    plain = re.sub(r"\.\Z", "", re.sub(r":(80|443)\Z", "", host))
    return host, path, plain + re.sub(r"/+\Z", "", path) + ("?" + "&".join(params) if params else "")


def judged(pages, rules, listed):
    bad = {split(u)[2] for u in listed} - {None}
    for i, url in pages:
        host, path, address = split(url)
        fits = [
            (len(h + p), len(h), h + p, v)
            for h, p, v in rules
            if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        rule, verdict = max(fits)[2:] if fits else (None, "block" if address in bad else "allow")
        yield i, host, path, rule, verdict, address in bad


@pytest.fixture(scope="module")
def pages(spark):
    prepared(spark)
    draw = random.Random(4)
    urls = URLS + [f"http://{draw.choice('abc')}.{draw.choice(['com', 'net', 'de'])}/{draw.choice(['es/', 'en'])}" for _ in range(50)]
    rows = [*enumerate(urls), (0, URLS[5]), (None, URLS[9]), (3, URLS[17])]
    return rows, spark.createDataFrame([(*r, "x", "h", 1, "k", "v") for r in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("blocks", [1, url_filter.BLOCKS])
def test_filter(spark, pages, blocks):
    rows, df = pages
    listed = [URLS[17], URLS[20], "http://b.de/en", None, "nowhere", "https://a.com/en"]
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    urls = spark.createDataFrame([(u,) for u in listed], "url string")
    got = [tuple(r) for r in url_filter.url_filter(df, rules, urls, blocks).collect()]
    want = list(judged(rows, RULES, listed))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {v for *_, v, _ in want} == {"allow", "block"}


def test_nothing_listed_and_nothing_to_judge(spark, pages):
    rows, df = pages
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    urls = spark.createDataFrame([], "url string")
    got = url_filter.url_filter(df, rules, urls)
    assert got.where("verdict <> 'allow' or rule is not null").count() == 0 and got.count() == len(rows)
    assert url_filter.url_filter(df.limit(0), rules, urls).collect() == []


def test_bloom_has_no_false_negatives_and_few_false_hits(spark):
    prepared(spark)
    keys = spark.range(20_000).select(F.concat(F.lit("u:"), "id").alias("key"))
    others = spark.range(20_000, 60_000).select(F.col("id").alias("row"), F.concat(F.lit("u:"), "id").alias("key"))
    own = spark.range(20_000).select(F.col("id").alias("row"), F.concat(F.lit("u:"), "id").alias("key"))
    assert url_filter._possible(own, keys, url_filter.BLOCKS).count() == 20_000
    assert url_filter._possible(others, keys, url_filter.BLOCKS).count() < 0.02 * 40_000
    assert url_filter._possible(others, keys, 8).count() > 30_000  # a full filter passes all


def test_mirrors(spark):
    prepared(spark)
    rows = [(1, "a", "<p>"), (2, "b", "<p>"), (3, "c", None), (4, "d", ""), (5, "e", ""), (None, "f", "<p>"), (7, None, "<p>"), (8, "g", "<q>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert sorted(str(r.url) for r in url_filter.mirrored_urls(df).collect()) == ["None", "b"]
