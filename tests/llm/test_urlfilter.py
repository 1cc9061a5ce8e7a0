import random

from strataweave.llm.components import connected_components
from strataweave.llm.urlfilter import judge_urls, page_links

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "bad.com", "/"), ("allow", "bad.com", "/ok/")]
SCHEMA = "page_id long, url string, html string"


def judged(spark, pages, redirects=None):
    df = spark.createDataFrame(pages, SCHEMA + "")
    moved = spark.createDataFrame(redirects, "url string, target string") if redirects else None
    return {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(df, RULES, moved).collect()}


def test_hosts_paths_and_longest_rules(spark):
    found = judged(
        spark,
        [
            (1, "https://A.Example.ORG/es/x?q#f", ""),
            (2, "http://x.org", None),
            (3, "http://x.org/", ""),
            (4, None, "<p>"),
            (5, "no scheme", ""),
            (6, "http://notexample.org/es/", ""),
            (7, "http://bad.com/ok/1", ""),
            (8, "http://bad.com?x", ""),
            (9, "a://b://c/d", ""),
        ],
    )
    assert found == {
        1: ("a.example.org", "/es/x", "example.org/es/", "block"),
        2: ("x.org", "", None, "allow"),
        3: ("x.org", "/", "org/", "allow"),
        4: ("", "", None, "allow"),
        5: ("", "", None, "allow"),
        6: ("notexample.org", "/es/", "org/", "allow"),
        7: ("bad.com", "/ok/1", "bad.com/ok/", "allow"),
        8: ("bad.com", "", None, "allow"),
        9: ("b:", "//c/d", None, "allow"),
    }


def canonical(url):
    return f'<html><head><link href="{url}" rel="canonical"></head></html>'


def test_aliases_share_a_block_but_explicit_rules_stay(spark):
    pages = [
        (1, "http://a.net/1", canonical("http://b.net/1?x=1&amp;y=2")),
        (2, "https://b.net/1?x=1&y=2#top", '<meta http-equiv="refresh" content="0; url=http://bad.com/page">'),
        (3, "http://c.org/2", canonical("//a.net/1")),
        (4, "http://d.net/dir/3", canonical("../3")),
        (5, "http://e.net/", "<!-- " + canonical("http://bad.com/z") + " -->"),
        (6, "http://f.net/x", canonical("http://c.org/2")),
        (7, "http://bad.com/ok/x", canonical("http://bad.com/page")),
        (8, "http://g.net/", ""),
        (9, "http://h.net/", ""),
    ]
    found = judged(spark, pages, [("http://g.net/", "http://a.net/1"), ("http://h.net/", "http://i.net/"), (None, "http://a.net/1")])
    assert {k: v[3] for k, v in found.items()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow", 8: "block", 9: "allow"}
    assert found[1][2] is None and found[3][2] == "org/"


def test_relative_links_are_resolved(spark):
    df = spark.createDataFrame([(1, "http://a.net/x/y?q", canonical("/root")), (2, "http://a.net/x/y", canonical("z")), (3, "http://a.net", canonical("z"))], SCHEMA)
    assert sorted(r.target for r in page_links(df).collect()) == ["http://a.net/root", "http://a.net/x/z", "http://a.net/z"]


def test_components_of_chains_stars_and_loops(spark, rows):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (None, 3), (5, 4), (300, 301), (301, 302), (302, 300)]
    found = rows(connected_components(spark.createDataFrame(edges, "a long, b long")), "node", "component")
    expected = [(i, 1) for i in range(1, 41)] + [(i, 100) for i in range(100, 160)] + [(200, 200), (300, 300), (301, 300), (302, 300)]
    assert sorted(found) == sorted(expected)
    assert connected_components(spark.createDataFrame([], "a string, b string")).collect() == []


def test_empty_table_and_repeated_rows(spark):
    assert judge_urls(spark.createDataFrame([], SCHEMA + ", host string, own int, node string"), RULES).collect() == []
    df = spark.createDataFrame([(1, "http://bad.com/", None)] * 2, SCHEMA)
    assert [r.verdict for r in judge_urls(df, RULES).collect()] == ["block", "block"]


def brute_force(pages):
    """Verdicts of pages (page_id, host, path, address it links to or None) by a plain union-find and a loop over rules."""

    def rule(host, path):
        fits = [(len(h) + len(p), v == "allow", v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits)[2] if fits else None

    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for _, host, path, target in pages:
        find((host, path))
        if target is not None:
            parent[find((host, path))] = find(target)
    blocked = {find(n) for n in list(parent) if rule(*n) == "block"}
    return {i: rule(h, p) or ("block" if find((h, p)) in blocked else "allow") for i, h, p, _ in pages}


def test_aliases_against_brute_force(spark):
    draw = random.Random(7)
    hosts = ["bad.com", "x.bad.com", "example.org", "a.net", "b.net", "c.net", "d.io"]
    # a long chain and a hub besides random links; blocking addresses also occur as targets alone
    addresses = [(draw.choice(hosts), f"/{draw.choice(['ok', 'es', 'p'])}/{n}") for n in range(900)]
    pages = [(n, *a, draw.choice(addresses) if draw.random() < 0.35 else None) for n, a in enumerate(addresses[:700])]
    chain = [(1000 + n, "chain.net", f"/{n}", ("chain.net", f"/{n + 1}")) for n in range(60)] + [(1060, "chain.net", "/60", ("bad.com", "/end"))]
    hub = [(2000 + n, "spoke.net", f"/{n}", ("hub.net", "/")) for n in range(300)]
    every = pages + chain + hub
    rows = [(i, f"http://{h.upper()}{p}#x", canonical(f"https://{t[0]}{t[1]}") if t else "<p>") for i, h, p, t in every]
    expected = brute_force(every)
    found = {r.page_id: r.verdict for r in judge_urls(spark.createDataFrame(rows, SCHEMA), RULES).collect()}
    assert found == expected
    own = sum(1 for i, h, p, t in every if h not in ("bad.com", "x.bad.com", "example.org") and expected[i] == "block")
    assert own > 100  # decisions that come from aliases alone
