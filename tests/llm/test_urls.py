import re

import pytest

from netsight.llm import urls

URLS = [
    "http://a.b.org/x", "https://EXAMPLE.org/es/1?x=/y", "http://sub.example.org/es/", "http://example.org/en/12", "http://example.org/en/2",
    "http://notexample.org/es/1", "http://x.com/fr/1", "http://x.com/de/1", "http://x.com/en/1", "http://xcom/de/1", "ftp://com/de/#a", "http://com/defr/",
    "no scheme", "", None, "://", "http://", "http://org", "http://org/", "http://Org?/", "x://y://org/es/", "http://cheap-casino.net/win",
    "http://library.net/en/5", "http://a.org\n/x", "http://example.org/es", "http://ÄB.example.net/ü?q#f",
]


def plainly(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
    return host, path, best


@pytest.fixture(scope="module")
def model(spark):
    return urls.train(urls.labelled_urls(spark))


def test_rules(spark, model):
    rows = [(i if i else None, u, "h", 1, "v") for i, u in enumerate(URLS)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, features int, rule string")
    found = urls.url_verdicts(pages, model).collect()
    assert len(found) == len(rows)
    expected = {i if i else None: plainly(u) for i, u in enumerate(URLS)}
    for r in found:
        host, path, rule = expected[r.page_id]
        assert (r.host, r.path) == (host, path)
        assert r.rule == (rule and rule[1] + rule[2])
        assert r.verdict == (rule[0] if rule else "block" if r.blocked_chance >= 0.5 else "allow")


def test_model_tells_its_table_apart(spark, model):
    """Held out: hosts that are in no row of the table."""
    known = urls.labelled_urls(spark).withColumnRenamed("url", "u").selectExpr("u AS page_id", "u AS url", "blocked")
    right = urls.url_verdicts(known, model, rules=()).join(known, "page_id")
    assert right.where("(verdict = 'block') != (blocked = 1)").count() == 0
    new = ["http://www.cheap-casino.net/en/4", "http://pills-online.com/x", "https://m.adult-bets.net/de/9", "http://ads-farm.net/fr/1"]
    fine = ["http://www.lantern.net/en/4", "http://morning-news.com/x", "https://m.brotherhood.net/de/9", "http://stone-river.net/fr/1"]
    pages = spark.createDataFrame([(u, u) for u in new + fine], "page_id string, url string")
    found = {r.page_id: r.verdict for r in urls.url_verdicts(pages, model, rules=()).collect()}
    assert [found[u] for u in new] == ["block"] * 4 and [found[u] for u in fine] == ["allow"] * 4


def test_empty_and_native(spark, model):
    pages = spark.createDataFrame([], "page_id long, url string")
    found = urls.url_verdicts(pages, model)
    assert found.count() == 0
    plan = found._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
