from quillon.llm import url_filters as u
from quillon.llm.components import connected_components

SCHEMA = "page_id long, url string, html string, verdict int"


def judged(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA)
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(df).collect()}


def test_rules_and_edges(spark):
    link = '<head><LINK rel="canonical" href="%s"></head>'
    out = judged(
        spark,
        [
            (1, "http://A.Example.ORG/es/x?q#f", None),
            (2, "https://example.org/en/12", ""),
            (3, "https://x.org", "<p>"),
            (4, "http://a.net/1", link % "http://b.com/de/9"),  # alias of a blocked address
            (5, "http://a.net/2", '<meta http-equiv=refresh content="0; url=HTTP://A.net/1#x">'),  # by a chain
            (6, "http://c.net/1", link % "/2"),
            (7, "http://c.net/2", link % "http://d.com/de/1"),
            (8, "http://c.net/2#top", link % "http://d.com/fr/1"),  # allow in the group
            (9, None, None),
            (10, "no address", link % "x"),
            (11, "ftp://notorg/", None),
            (12, "http://a.net/other", "canonical refresh"),
        ],
    )
    assert out[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert out[2] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert out[3] == ("x.org", "", None, "allow")
    assert [out[i][3] for i in (4, 5, 6, 7, 8)] == ["block", "block", "allow", "allow", "allow"]
    assert out[9] == ("", "", None, "allow") and out[10] == ("", "", None, "allow")
    assert out[11][2] is None and out[12][3] == "allow"


def test_only_declared_links_count(spark):
    link = '<base href="%s"><link rel=canonical href="%s">'
    out = judged(
        spark,
        [
            (1, "http://a.net/x", '<link rel="canonical" href="http://b.com/de/1">'),
            (2, "https://www.a.net/x/?ref=z", None),
            (3, "https://a.net/x", ""),
            (4, "http://a.net/x", None),  # the same address as the first row's
            (5, "http://e.net/p/q", link % ("http://b.com/de/", "2")),  # seen from the base
            (6, "http://f.net/de/p", link % ("/other/", "2")),
            (7, "http://e.net/" + "long" * 3000, '<link rel="canonical" href="http://b.com/de/1">'),
            (7, "http://e.net/" + "long" * 3000, '<link rel="canonical" href="http://b.com/de/1">'),
        ],
    )
    assert {i: v[3] for i, v in out.items()} == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "block"}


def test_of_rules_as_long_the_allowing_one_goes_first(spark):
    df = spark.createDataFrame([(1, "http://a.net/xy", None)], "page_id long, url string, html string")
    rules = (("block", "a.net", "/x"), ("allow", "a.net", "/x"))
    assert [u.judge(df, r).first().verdict for r in (rules, rules[::-1])] == ["allow", "allow"]


def test_empty(spark):
    assert judged(spark, []) == {}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3), (1, 2), (2, 1), (5, 2)] + [(1000, k) for k in range(1001, 1100)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "x long, y long"), "x", "y").collect()}
    want = {i: 100 for i in range(100, 161)} | {1: 1, 2: 1, 5: 1} | {k: 1000 for k in range(1000, 1100)}
    assert got == want
