from collections import defaultdict

import pytest

from andamio.llm import url_trust

PAGES = "page_id long, url string, html string, host string, trust double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1.0) for r in rows], PAGES)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.com/en/7x?q#f", "a.example.com", "/en/7x", "example.com/en/7", "allow"),
        ("http://example.com/en/6", "example.com", "/en/6", "com/en/", "block"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("http://b.example.net/de/81", "b.example.net", "/de/81", "example.net/de/8", "block"),
        ("http://x.net/de/81", "x.net", "/de/81", "net/de/", "allow"),
        ("http://x.org/es/", "x.org", "/es/", "org/es/", "block"),
        ("http://x.org?es=/es/", "x.org", "", None, "allow"),
        ("x.org/es/", "", "", None, "allow"),
        ("a://b://c/d", "b:", "//c/d", None, "allow"),
        (None, "", "", None, "allow"),
        ("://", "", "", None, "allow"),
    ],
)
def test_one_url(spark, url, host, path, rule, verdict):
    (r,) = url_trust.judge(frame(spark, [(1, url, None)])).collect()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def brute_ranks(seeds, edges):
    out = defaultdict(float)
    for (s, _), n in edges.items():
        out[s] += n
    rank = {h: m * 0.15 for h, m in seeds.items()}
    for _ in range(400):
        new = defaultdict(float, {h: m * 0.15 for h, m in seeds.items()})
        for (s, t), n in edges.items():
            new[t] += 0.85 * rank.get(s, 0) * n / out[s]
        rank = new
    return rank


def test_trust_and_distrust_spread(spark):
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/x">' for h in hosts)
    rows = [
        (1, "http://good.net/de/1", link("mid.edu", "MID.edu", "far.edu")),
        (2, "http://mid.edu/", link("far.edu")),
        (3, "http://bad.org/es/1", ""),
        (4, "http://farm.edu/", link("bad.org")),
        (5, "http://farm2.edu/", link("farm.edu") + "<img src='//far.edu/i.png'>"),
        (6, "http://far.edu/", link("far.edu")),
        (7, "http://alone.edu/", None),
        (8, "http://sub.bad.org/", ""),
    ]
    out = {r.page_id: r for r in url_trust.judge(frame(spark, rows)).collect()}
    assert {i: r.verdict for i, r in out.items()} == {1: "allow", 2: "allow", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "block"}
    edges = {("good.net", "mid.edu"): 2, ("good.net", "far.edu"): 1, ("mid.edu", "far.edu"): 1, ("farm.edu", "bad.org"): 1, ("farm2.edu", "farm.edu"): 1, ("farm2.edu", "far.edu"): 1, ("sub.bad.org", "bad.org"): 1, ("bad.org", "sub.bad.org"): 1}
    trust, distrust = brute_ranks({"good.net": 1.0}, edges), brute_ranks({"bad.org": 1.0}, {(t, s): n for (s, t), n in edges.items()})
    for r in out.values():
        assert r.trust == pytest.approx(trust.get(r.host, 0), rel=0.06) and r.distrust == pytest.approx(distrust.get(r.host, 0), rel=0.06)


def test_hosts_with_few_ruled_pages_are_seeds(spark):
    pages = lambda host, allow, block, n: [f"http://{host}/de/1"] * allow + [f"http://{host}/de/8"] * block + [f"http://{host}/fr"] * (n - allow - block)
    urls = [*pages("most.example.net", 10, 5, 100), *pages("least.example.net", 5, 10, 100)]
    out = url_trust.judge(frame(spark, [(i, u, None) for i, u in enumerate(urls)])).collect()
    a, b, top = "most.example.net", "least.example.net", "example.net"
    edges = {(a, top): 1, (b, top): 1, (top, a): 1, (top, b): 1}
    trust, distrust = brute_ranks({a: 2 / 3, b: 1 / 3}, edges), brute_ranks({a: 1 / 3, b: 2 / 3}, edges)
    for host, verdict in ((a, "allow"), (b, "block")):
        got = [r for r in out if r.host == host]
        assert {r.verdict for r in got if r.rule is None} == {verdict} and len(got) == 100
        assert all(r.trust == pytest.approx(trust[host], rel=0.06) and r.distrust == pytest.approx(distrust[host], rel=0.06) for r in got)


def test_hot_host_repeats_and_empty(spark):
    rows = [(i % 50, "http://hot.com/en/1", "<a href='http://x.com/'>") for i in range(200)] + [(None, "http://x.com/fr", None)] * 2
    out = url_trust.judge(frame(spark, rows)).collect()
    assert len(out) == 202 and sum(r.verdict == "block" for r in out) == 200
    assert url_trust.judge(frame(spark, [])).collect() == []


def test_long_cycles_settle(spark, monkeypatch):
    monkeypatch.setattr(url_trust, "HUB", 3)
    # Seed, then a ring of thirty, each with a side link, so trust has to go far and round.
    hosts = ["seed.net", *(f"h{i}.x{i}.edu" for i in range(30))]
    edges = {(hosts[0], hosts[1]): 1} | {(hosts[1 + i], hosts[1 + (i + 1) % 30]): 1 for i in range(30)} | {(hosts[5], hosts[k]): 1 for k in range(10, 25)}
    out = defaultdict(list)
    for (a, b), n in edges.items():
        out[a] += [b] * n
    rows = [(i, f"http://{h}/de/1" if i == 0 else f"http://{h}/", "".join(f'<a href="//{t}/">' for t in out[h])) for i, h in enumerate(hosts)]
    virtual = {(f"h{i}.x{i}.edu", f"x{i}.edu"): 1 for i in range(30)}
    every = edges | virtual | {(b, a): 1 for a, b in virtual}
    want = brute_ranks({"seed.net": 1.0}, every)
    for r in url_trust.judge(frame(spark, rows)).collect():
        assert r.trust > 0 and r.trust == pytest.approx(want[r.host], rel=0.06)


def test_links_of_many_kinds(spark):
    html = """<BASE href='https://user@Base.org:8080/dir/'><a href="page.html"><a href='/root'><a href=#top><a href="mailto:x@y.z"><img src=//cdn.org/a.png>
        <link rel="canonical" href="HTTP://canon.org/x"><meta http-equiv=refresh content="5; url=https://moved.org/"> <a href="javascript:go()">"""
    rows = spark.createDataFrame([("a.b.own.org", html), ("own.org", None)], "host string, html string")
    got = {(r.source, r.target): r.n for r in url_trust.host_links(rows).collect()}
    own = "a.b.own.org"
    assert {t: n for (s, t), n in got.items() if s == own} == {"base.org": 3, "cdn.org": 1, "canon.org": 1, "moved.org": 1, "b.own.org": 1}
    assert {k for k in got if k[0] != own} == {("b.own.org", own), ("b.own.org", "own.org"), ("own.org", "b.own.org")}
