from pathlib import Path

from compare import connect, difference
from pyspark.sql import functions as F

from tallybook.llm.queries import ORACLE, QUERIES
from tallybook.llm.reputation import host_reputation, judge_urls, url_parts


def test_matches_sql(spark):
    sf = "/root/testdata/sf0.001"
    assert Path(sf).exists()
    assert difference(QUERIES["op2_url_reputation"](spark, sf), connect(sf), ORACLE["op2_url_reputation"]) is None


def test_url_parts(frame):
    urls = [None, "", "no scheme", "http://A.Example.COM", "x://h?q=/a", "s://h/p/q?r#t", "a://b://c/d", "http://É.x/P"]
    host, path = url_parts(F.col("url"))
    got = [tuple(r) for r in frame([(u,) for u in urls], "url string").select(host, path).collect()]
    assert got == [("", ""), ("", ""), ("", ""), ("a.example.com", ""), ("h", ""), ("h", "/p/q"), ("b:", "//c/d"), ("É.x", "/P")]


def test_rules_and_reputation(frame):
    urls = ["http://a.bad.info/", "http://ok.info/x", "http://m.example.net/en/1", "http://example.net/de/1", "http://net/", "http://xnet/",
            "http://example.com/de/2", "http://q.org/fr/", "http://q.org/fr", None]
    pages = [(i, u) for i, u in enumerate(urls)] + [(100 + i, "http://a.bad.info/p") for i in range(60)] + [(200 + i, "http://ok.info/y") for i in range(60)]
    outcomes = [(100 + i, 1) for i in range(60)] + [(200 + i, 0) for i in range(60)] + [(None, 1), (7, None)]
    out = judge_urls(frame(pages, "page_id long, url string").selectExpr("*", "1 as rule", "2 as lower"), frame(outcomes, "page_id long, bad int"))
    found = {r.page_id: (r.rule, r.verdict) for r in out.where("page_id < 100").collect()}
    assert found == {
        0: (None, "block"), 1: (None, "allow"), 2: ("example.net/en/", "allow"), 3: ("net/", "block"), 4: ("net/", "block"),
        5: (None, "allow"), 6: ("example.com/de/", "block"), 7: ("org/fr/", "allow"), 8: (None, "allow"), 9: (None, "allow"),
    }


def test_hosts_shrink_towards_their_domain(frame):
    pages = [(i, f"h{i % 4}.d.com") for i in range(400)] + [(1000 + i, f"h{i % 4}.e.com") for i in range(400)] + [(5000, "new.d.com"), (5001, None)]
    outcomes = [(i, int(i % 10 < 8)) for i in range(400)] + [(1000 + i, int(i % 10 < 1)) for i in range(400)]
    rows = {r.host: r for r in host_reputation(frame(pages, "page_id long, host string").fillna(""), frame(outcomes, "page_id long, bad int")).collect()}
    assert rows["new.d.com"].n == 0 and abs(rows["new.d.com"].rate - 0.8) < 0.1
    assert rows["h0.d.com"].lower > 0.5 > rows["h0.e.com"].upper and rows[""].n == 0


def test_empty(frame):
    out = judge_urls(frame([], "page_id long, url string"), frame([], "page_id long, bad int"))
    assert out.count() == 0
