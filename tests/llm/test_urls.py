import duckdb
import pytest

from scatterlake.llm import urls

ROWS = [
    (1, "http://a.example.com/en/1", "<a href='http://x.org/'>x</a>"),
    (2, "http://a.example.com/fr/1", None),
    (3, "https://www.example.com/en/x?y#z", ""),
    (4, "HTTP://sub.WWW.Example.COM/en/", "<A HREF=\"https://Good.Org/p\">g</A>"),
    (5, "http://bad.net/es/1", "<a href=//x.org>x</a>"),
    (6, "http://bad.net/fr/2", ""),
    (7, "http://bad.net/en/2", ""),
    (8, "http://friend.org/a", "<a class=k href='http://bad.net/es/1'>b</a><a href='http://bad.net/'>b</a>"),
    (9, "http://friend2.org/a", "<a href='http://friend.org/'>b</a>"),
    (10, "http://good.org/a", ""),
    (11, "http://x.org", "<a href='/local'>l</a>"),
    (12, "http://com/", ""),
    (13, "http://com", ""),
    (14, "notcom/", ""),
    (15, None, "<a href='http://bad.net/'>b</a>"),
    (16, "a://b://c/d", ""),
    (17, "http://net.example/es/", ""),
    (18, "://h/p/q/?a=://c", ""),
    (8, "http://friend.org/a", ""),
    (None, "http://mycom/en/", None),
]
WANT = {
    1: ("a.example.com", "/en/1", "example.com/en/", "block"), 2: ("a.example.com", "/fr/1", "com/", "allow"), 3: ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
    4: ("sub.www.example.com", "/en/", "www.example.com/en/", "allow"), 5: ("bad.net", "/es/1", "net/es/", "block"), 7: ("bad.net", "/en/2", None, "block"),
    8: ("friend.org", "/a", None, "block"), 9: ("friend2.org", "/a", None, "block"), 10: ("good.org", "/a", None, "allow"), 11: ("x.org", "", None, "allow"), 12: ("com", "/", "com/", "allow"), 13: ("com", "", None, "allow"),
    14: ("", "", None, "allow"), 15: ("", "", None, "allow"), 16: ("b:", "//c/d", None, "allow"), 17: ("net.example", "/es/", None, "allow"), 18: ("h", "/p/q/", None, "allow"), None: ("mycom", "/en/", None, "allow"),
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "extra", 1) for r in ROWS], "page_id long, url string, html string, host string, n int").repartition(3)


def test_rules_and_propagation(pages):
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judged(pages).collect()}
    assert {k: got[k] for k in WANT} == WANT
    assert urls.judged(pages).count() == len(ROWS)


def test_sql_agrees(pages):
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", ROWS)
    want = sorted(con.execute(urls.ORACLE).fetchall(), key=str)
    assert sorted((tuple(r)[:5] for r in urls.judged(pages).collect()), key=str) == want


def test_power_series_is_pagerank(spark):
    links = spark.createDataFrame([("a", "b", 1), ("a", "c", 3), ("b", "a", 1), ("c", "a", 1)], "src string, dst string, n long")
    got = {r.host: r.mass for r in urls.spread(links, spark.createDataFrame([("a",)], "host string"), "src", "dst").collect()}
    r = {"a": 1.0, "b": 0.0, "c": 0.0}
    for _ in range(400):
        r = {"a": 0.15 + 0.85 * (r["b"] + r["c"]), "b": 0.85 * r["a"] / 4, "c": 0.85 * r["a"] * 3 / 4}
    assert all(abs(got[k] - r[k]) < 0.85**urls.STEPS for k in r)


def test_empty(spark):
    assert urls.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
