import duckdb
import pytest

from siltstone.llm import components, urls

SCHEMA = "page_id long, url string, html string"


def verdicts(spark, rows):
    """What ``judge`` says of (page_id, url, html) rows, after a comparison with the SQL."""
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(str, (tuple(r) for r in urls.judge(df).collect())))
    c = duckdb.connect()
    c.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    c.executemany("INSERT INTO pages VALUES (?, ?, ?)", [list(r) for r in rows])
    assert got == sorted(map(str, c.execute(urls.ORACLE_SQL).fetchall()))
    return {r.page_id: r.verdict for r in urls.judge(df).collect()}


@pytest.mark.parametrize("html", [
    '<meta content="5; url=TARGET" http-equiv=refresh>',
    "<META HTTP-EQUIV='Refresh' CONTENT='0;URL=TARGET'/>",
    '<meta http-equiv="refresh" content="0; url=\'TARGET\'">',
    "<meta http-equiv=refresh content=0;url=TARGET>",
    '<link href="TARGET" title="a > b" rel="alternate CANONICAL">',
    "<link\n rel = canonical\n href = TARGET >",
    "<link rel=canonical href=/one><link rel=canonical href=TARGET>",
    '<meta http-equiv=refresh content="0;url=/two"><meta http-equiv=refresh content="0;url=TARGET">',
    "<script>var a = '<link rel=canonical href=/s>'</script><!-- no --><link rel=canonical href=TARGET>" + "x" * 300_000,
])
@pytest.mark.parametrize("target", ["http://b.com/de/1", "//b.com/de/x?y=1&amp;z=2#f"])
def test_every_form_of_a_link_counts(spark, html, target):
    assert verdicts(spark, [(1, "http://a.net/dir/page?q", html.replace("TARGET", target)), (2, "http://other.net", "")]) == {1: "block", 2: "allow"}


def test_what_is_no_link(spark):
    target = "http://b.com/de/1"
    rows = [
        (1, "http://a.net/1", f"<!-- <link rel=canonical href={target}> -->"), (2, "http://a.net/2", f"<script>'<link rel=canonical href={target}>'</script>"),
        (3, "http://a.net/3", f'<link rel=stylesheet href="{target}" title="rel=canonical">'), (4, "http://a.net/4", f"<a rel=canonical href={target}>refresh</a>"),
        (5, "http://a.net/5", "<link rel=canonical href=mailto:b@b.com/de/1><link rel=canonical><link rel=canonical href=''>"), (6, "http://a.net/6", "<link rel=canonical href='#de'>"),
        (7, "http://a.net/7", f'<meta name=refresh content="0;url={target}">'), (8, "http://a.net/8", f'<meta http-equiv=refresh content="{target}">'),
    ]
    assert set(verdicts(spark, rows).values()) == {"allow"}


@pytest.mark.parametrize("url, target, want", [
    ("http://a.com/x/y/z?q#f", "n", "http://a.com/x/y/n"), ("http://a.com/x/y/z", "../n", "http://a.com/x/n"), ("http://a.com/x/y/z", "../../../n", "http://a.com/n"),
    ("http://a.com/x/y/z", "./n/./m", "http://a.com/x/y/n/m"), ("http://a.com/x/y/z", "..", "http://a.com/x/"), ("http://a.com/x/y/z", "/p/../q/", "http://a.com/q/"),
    ("http://a.com", "n?u=/../v", "http://a.com/n?u=/../v"), ("http://a.com?x=/y/", "n", "http://a.com/n"), ("https://a.com/x", "//b.org/../n", "https://b.org/n"),
    ("http://a.com/x?y=1", "?z", "http://a.com/x?z"), ("http://a.com/x", "HTTP://B.com/a/b/../c", "HTTP://B.com/a/c"), ("http://a.com/x", "data:x", None), ("http://a.com/x", " n ", "http://a.com/n"),
    ("http://a.com/x/y/", "", None), ("http://a.com/x/y/", "a/.", "http://a.com/x/y/a/"), ("http://a.com/x/..b/y", ".c", "http://a.com/x/..b/.c"),
])
def test_relative_targets(spark, url, target, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(url, target)], "u string, t string").select(urls.resolved(F.col("u"), F.col("t"))).first()[0] == want


def test_base_tags_and_empty_paths(spark):
    rows = [
        (1, "http://a.net/x/1", "<base href='http://www.b.com/de/'><link rel=canonical href=9>"), (2, "http://a.net/x/2", "<base target=_top><base href=../de/><link rel=canonical href='//c.com/q'>"),
        (3, "http://d.net", "<link rel=canonical href=http://b.com/de/>"), (4, "http://D.net/", ""), (5, "http://e.net?x", "<link rel=canonical href='http://d.net'>"),
    ]
    assert verdicts(spark, rows) == {1: "block", 2: "allow", 3: "block", 4: "block", 5: "block"}


def test_generated_graph_against_union_find(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    hosts = ["a.net", "b.net", "www.c.com", "d.org", "example.org", "x.example.org"]
    at = [f"http://{hosts[rng.integers(6)]}/{('de', 'fr', 'en', 'es', 'x')[rng.integers(5)]}/{i}" for i in range(160)]
    at += [f"http://chain.net/{i}" for i in range(40)] + [f"http://hub.net/{i}" for i in range(40)] + ["http://z.com/de/end", "http://h.com/de/hub"]
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 160, (70, 2))] + [(160 + i, 161 + i) for i in range(39)] + [(199, 240)] + [(200 + i, 241) for i in range(40)]
    parent = list(range(len(at)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    html = [""] * len(at)
    for a, b in edges:
        html[a] += (redirect if rng.integers(2) else canonical)(at[b])
        parent[find(a)] = find(b)

    def rule(u):
        h, p = u[7:].split("/", 1)
        fits = [(len(rh + rp), v) for v, rh, rp in urls.RULES if (h == rh or h.endswith("." + rh)) and ("/" + p).startswith(rp)]
        return max(fits)[1] if fits else None

    blocked = {find(i) for i, u in enumerate(at) if rule(u) == "block"}
    want = {i: rule(u) or ("block" if find(i) in blocked else "allow") for i, u in enumerate(at)}
    got = verdicts(spark, [(i, u, html[i]) for i, u in enumerate(at)])
    assert got == want and got[160] == got[200] == "block" and len(set(want.values())) == 2


def test_kept_columns_with_names_of_results(spark):
    df = spark.createDataFrame([(1, "http://a.com/de/", None, "own", 7, 8)], "page_id long, url string, html string, Host string, node int, component int")
    got = urls.judge(df, keep=("page_id", "Host", "node", "component"))
    assert got.columns == ["page_id", "node", "component", "host", "path", "rule", "verdict"]
    assert tuple(got.first()) == (1, 7, 8, "a.com", "/de/", "com/de/", "block")


def test_components_equal_union_find(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 60)] + [(7, 7)] * 2
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "x long, y long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    assert got == {n: find(n) for n in parent}
    assert components.connected_components(df.where("false")).count() == 0


def canonical(url):
    return f"<html><head><link rel='canonical' href='{url}'></head>"


def redirect(url):
    return f'<META HTTP-EQUIV="refresh" content="0; URL={url}">'


def test_rules_and_aliases(spark):
    rows = [
        (1, "http://a.example.net/x", redirect("http://b.example.com/de/1")),  # no rule; its alias is blocked
        (2, "https://A.Example.NET/y#f", canonical("/x")),  # joins 1
        (3, "http://www.example.org/en/2", redirect("http://a.example.net/x")),  # an own allow wins over its component
        (4, "http://example.org/en/12?q=1", ""),
        (5, "http://example.org/es/", None),
        (6, None, None),
        (7, "no scheme", canonical("http://b.example.com/de/1")),
        (8, "http://badexample.org/es/", ""),  # not a subdomain of example.org
        (9, "http://x.com/fr/a?b=http://y", ""),
        (10, "http://lone.net", ""),
        (10, "http://lone.net", ""),
        (None, "http://h.net?x/y", ""),
    ]
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    want = [
        (1, "a.example.net", "/x", None, "block"), (2, "a.example.net", "/y", None, "block"), (3, "www.example.org", "/en/2", "org/", "allow"),
        (4, "example.org", "/en/12", "example.org/en/1", "block"), (5, "example.org", "/es/", "example.org/es/", "block"), (6, "", "", None, "allow"),
        (7, "", "", None, "allow"), (8, "badexample.org", "/es/", "org/", "allow"), (9, "x.com", "/fr/a", "com/fr/", "allow"),
        (10, "lone.net", "", None, "allow"), (10, "lone.net", "", None, "allow"), (None, "h.net", "", None, "allow"),
    ]
    assert sorted(map(str, got)) == sorted(map(str, want))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert urls.judge(empty).count() == 0
