from fluorite.llm import url_filters as U

PAGE = "page_id long, url string, html string"


def judged(spark, pages, edges=None):
    e = spark.createDataFrame(edges, "a string, b string") if edges else None
    return {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(spark.createDataFrame(pages, PAGE), edges=e).collect()}


def test_hosts_paths_and_longest_rule(spark):
    got = judged(spark, [
        (1, "http://WWW.Example.com/en/1?x#y", ""), (2, "https://blog.example.com/en/7#top", None), (3, "http://a.net/es", ""),
        (4, "http://a.net/es/x", ""), (5, None, None), (6, "no scheme", ""), (7, "http://example.com", ""), (8, "http://xexample.com/en/", ""), (9, "http://net/fr/", ""),
    ])
    assert got == {
        1: ("www.example.com", "/en/1", "www.example.com/en/", "allow"), 2: ("blog.example.com", "/en/7", "example.com/en/", "block"),
        3: ("a.net", "/es", None, "allow"), 4: ("a.net", "/es/x", "net/es/", "block"), 5: ("", "", None, "allow"), 6: ("", "", None, "allow"),
        7: ("example.com", "", None, "allow"), 8: ("xexample.com", "/en/", "com/", "allow"), 9: ("net", "/fr/", "net/fr/", "block"),
    }


def test_block_spreads_over_links_and_allow_goes_first(spark):
    link = '<link rel="canonical" href="{}">'.format
    got = judged(spark, [
        (1, "http://a.org/1", link("http://b.org/2")), (2, "http://b.org/2", '<meta http-equiv="refresh" content="0; url=http://c.net/es/3">'),
        (3, "http://c.net/es/3", ""), (4, "http://d.org/", link("/alias")), (5, "http://d.org/alias", "<LINK HREF='http://x.com/' REL=canonical>"),
        (6, "http://e.net/fr/", link("http://d.org/")), (7, "http://f.org/", ""), (1, "http://a.org/1", link("http://b.org/2")),
    ])
    assert got[1][3] == got[2][3] == got[3][3] == "block"
    assert got[4][3] == got[5][3] == "allow"  # an allowed address is among them
    assert got[6][3] == "block" and got[7][3] == "allow"  # a page's own rule goes before all


def test_given_edges_chain_and_empty_table(spark):
    pages = [(i, f"http://p{i}.org/", "") for i in range(30)]
    edges = [(f"http://p{i}.org/", f"http://p{i + 1}.org/") for i in range(29)] + [("http://p29.org/", "http://z.net/fr/"), (None, "http://q.org/")]
    assert {v[3] for v in judged(spark, pages, edges).values()} == {"block"}
    assert judged(spark, [(1, "http://a.org/", "x")] * 0 or [(1, None, None)]) == {1: ("", "", None, "allow")}
    assert U.judge(spark.createDataFrame([], PAGE + ", host string, rule string")).count() == 0
