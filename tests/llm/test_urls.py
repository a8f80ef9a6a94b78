from bindery.llm import url_filter as uf

SCHEMA = "page_id long, url string, html string, host string, rule string, node string, label string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "x", "x", "x") for i, u, h in rows], SCHEMA)


def judged(spark, rows):
    return {r.page_id: r for r in uf.digest(pages(spark, rows)).collect()}


def test_hosts_paths_and_rules(spark):
    cases = [
        ("http://EXAMPLE.net/en/1?x#y", "example.net", "/en/1", "example.net/en/", "allow"),
        ("http://a.b.example.net/fr/1", "a.b.example.net", "/fr/1", "net/", "block"),
        ("http://notexample.net/en/1", "notexample.net", "/en/1", "net/", "block"),
        ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
        ("http://example.com/den", "example.com", "/den", None, "allow"),
        ("http://x.org/fr/#a", "x.org", "/fr/", "org/fr/", "allow"),
        ("http://example.net", "example.net", "", None, "allow"),
        ("http://example.net?/en/", "example.net", "", None, "allow"),
        ("http://example.net:80/en/", "example.net:80", "/en/", None, "allow"),
        ("a://b://c", "b:", "//c", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        ("://net/x", "net", "/x", "net/", "block"),
        ("http://ÄNET/Q", "Änet", "/Q", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("http:///net/", "", "/net/", None, "allow"),
        ("http://x\ny.net/a\nb?c", "x\ny.net", "/a\nb", "net/", "block"),
    ]
    got = judged(spark, [(i, c[0], None) for i, c in enumerate(cases)])
    for i, (_, host, path, rule, verdict) in enumerate(cases):
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), cases[i]


def canonical(to):
    return f'<head><LINK href="{to}" rel="canonical"></head>'


def refresh(to):
    return f"<meta http-equiv='refresh' content='0; URL={to}'>"


def test_blocks_pass_along_redirects(spark):
    rows = [
        (1, "https://alias.example/a", canonical("http://bad.net/x")),  # one step, to a blocked address
        (2, "https://alias.example/b/?utm_source=f", refresh("http://alias.example/a")),  # over an alias, other spelling
        (3, "https://good.org/fr/1", canonical("https://alias.example/z")),  # allowed by its own rule
        (4, "https://alias.example/z", canonical("http://worse.net/x")),  # blocked and allowed aliases: allow
        (5, "https://alone.example/", "<p>nothing</p>"),
        (6, "http://www.alias.example/b", None),  # the spelling of 2
        (7, "http://worse.net/x", None),  # its own rule stays
        (8, "https://self.example/a", canonical("/a")),
        (9, None, canonical("http://bad.net/x")),
        (9, None, None),
    ]
    got = judged(spark, rows)
    assert {i: r.verdict for i, r in got.items()} == {
        1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "block", 8: "allow", 9: "allow"
    }
    assert {i for i, r in got.items() if r.by_alias} == {1, 2, 4, 6}


def test_long_chain_and_hub(spark):
    rows = [(i, f"http://c.example/{i}", canonical(f"/{i + 1}")) for i in range(30)] + [(30, "http://c.example/30", refresh("http://z.net/"))]
    rows += [(100 + i, f"http://h.example/{i}", canonical("http://h.example/0")) for i in range(200)]
    rows += [(400, "http://h.example/0", canonical("http://q.example.com/de/"))]
    assert {r.verdict for r in judged(spark, rows).values()} == {"block"}


def test_repeated_rows_and_empty(spark):
    table = pages(spark, [(1, "http://a.net/", None)] * 3)
    assert [r.verdict for r in uf.digest(table).collect()] == ["block"] * 3
    assert uf.digest(table.limit(0)).collect() == []


RELATIVE = [
    (1, "http://s.example/a/b/page", canonical("next.html")),
    (2, "http://s.example/a/b/next.html", canonical("../x")),
    (3, "http://s.example/a/x", refresh("?id=2")),
    (4, "http://s.example/a/x?id=2", canonical("./q/../../y/./z#part")),
    (5, "http://s.example/y/z", refresh("http://s.example/end") + refresh("http://bad.net/")),  # the second of two
    (6, "http://s.example", canonical("page/..")),
    (7, "http://s.example/", "<link rel='alternate canonical nofollow' href=//bad.net/q>"),
    (8, "http://t.example/a", canonical("mailto:x@bad.net") + canonical("#top") + canonical("")),
    (9, "http://t.example/b", '<link rel="not-canonical" href="http://bad.net/">'),
    (10, "http://t.example/c", "<link rel=canonical href='../../../d'>"),
    (11, "http://t.example/d", "<LINK HREF=http://bad.net/9 REL=canonical>"),
    (12, "http://u.example/..", canonical("..")),
]


def test_relative_links_and_every_tag(spark):
    got = judged(spark, RELATIVE)
    assert {i for i, r in got.items() if r.verdict == "block"} == {1, 2, 3, 4, 5, 6, 7, 10, 11}


def test_relative_links_match_sql(spark):
    import duckdb
    import pandas as pd

    from bindery.llm.oracles import URLS

    pages_ = pd.DataFrame(RELATIVE + [(20, None, canonical("x")), (21, "no host", canonical("y"))], columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", pages_)
    want = con.sql(URLS)
    columns = want.columns
    got = uf.digest(pages(spark, list(pages_.itertuples(index=False, name=None)))).select(*columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
