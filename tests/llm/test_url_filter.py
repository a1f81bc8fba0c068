import pytest

from rulesift.llm import queries, url_filter


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.find(c) for c in "?#" if c in tail], default=len(tail))
    return rest[:cut].translate({c: c + 32 for c in range(65, 91)}), tail[:end]


def rule_of(host, path, rules):
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return min(fit, key=lambda x: (-x[0], x[1]), default=(0, None, None))[1:]


def test_rules_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.op9_url_filter(spark, sf).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        host, path = parts(pages[r.page_id])
        rule, verdict = rule_of(host, path, queries.URL_RULES)
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and r.verdict == (verdict or r.verdict)
    assert {r.rule for r in got} >= {"org/", "example.org/es/", "com/de/", None}


def test_odd_urls_and_propagation(spark):
    rules = [("good.net", "/", "allow"), ("bad.net", "/", "block"), ("bad.net", "/ok/", "allow")]
    a = lambda *urls: "".join(f'<p><A class="x" HREF="{u}">t</a>' for u in urls)
    pages = [(1, "http://good.net/x", a("https://friend.net/1", "//friend.net/2", "/own")), (2, "http://BAD.net/x?y", a()), (3, "x://friend.net", a("http://far.net/")),
             (4, "http://farm.net/", a("http://bad.net/q", "http://bad.net/w")), (5, "http://far.net#top", None), (6, "http://alone.net/a", a("http://gone.net/")),
             (7, None, a()), (8, "no scheme", a("http://bad.net")), (9, "http://www.farm.net/p", ""), (10, "http://sub.bad.net/ok/z", ""), (10, "http://sub.bad.net/ok/z", ""), (11, "http://É.net/a b://c", "")]
    table = spark.createDataFrame([(*p, "k", 0.0) for p in pages], "page_id long, url string, html string, kind string, rank double")
    got = url_filter.judge(table, rules).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(pages)
    assert {i: (by[i].host, by[i].path) for i in (2, 3, 5, 7, 8, 11)} == {2: ("bad.net", "/x"), 3: ("friend.net", ""), 5: ("far.net", ""), 7: ("", ""), 8: ("", ""), 11: ("É.net", "/a b://c")}
    assert {i: by[i].verdict for i in by} == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block", 10: "allow", 11: "allow"}
    assert by[10].rule == "bad.net/ok/" and by[3].trust > by[5].trust > 0 == by[6].trust and min(by[4].distrust, by[9].distrust) > 0
    assert url_filter.judge(table.where("false"), rules).collect() == []
    assert {r.verdict for r in url_filter.judge(table, []).collect()} == {"allow"}


def test_ranks_equal_power_iteration(spark):
    edges = [("t", "a", "b", 1.0), ("t", "a", "c", 3.0), ("t", "b", "c", 1.0), ("t", "c", "a", 1.0), ("t", "c", "d", 1.0)]
    seeds = [("t", "a", 2.0), ("t", "b", 1.0)]
    got = {r.host: r["rank"] for r in url_filter.ranks(spark.createDataFrame(edges, "kind string, src string, dst string, weight double"), spark.createDataFrame(seeds, "kind string, host string, seed double")).collect()}
    start = {"a": 2 / 3, "b": 1 / 3}
    rank = dict(start)
    for _ in range(300):
        new = {}
        for _, s, d, w in edges:
            new[d] = new.get(d, 0) + url_filter.FOLLOW * rank.get(s, 0) * w / sum(x[3] for x in edges if x[1] == s)
        back = 1 - sum(new.values())
        rank = {h: new.get(h, 0) + back * start.get(h, 0) for h in {*new, *start}}
    assert got == pytest.approx(rank, abs=1e-5) and sum(got.values()) == pytest.approx(1)


def test_long_chains_and_hot_hosts(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "TARGETS", 7)
    monkeypatch.setattr(url_filter, "BROADCAST_HOSTS", 0)
    a = lambda *hosts: "".join(f'<a href="http://{h}/">t</a>' for h in hosts)
    pages = [(0, "http://good.net/x", a("c1.io"))] + [(k, f"http://c{k}.io/", a(f"c{k + 1}.io")) for k in range(1, 60)]
    pages += [(100, "http://bad.net/", a()), *((200 + k, "http://hub.org/", a(*(f"h{k}x{j}.com" for j in range(30)), "bad.net")) for k in range(20))]
    pages += [(300, "http://long.com/" + "p" * 3_000_000, a("c1.io") + " " * 3_000_000), (301, "http://none.com/", a())]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r for r in url_filter.judge(table, [("good.net", "/", "allow"), ("bad.net", "/", "block")]).collect()}
    assert len(got) == len(pages) and len(got[300].path) == 3_000_001
    trust = [got[k].trust for k in range(1, 60)]
    assert all(y == pytest.approx(url_filter.FOLLOW * x) and y > 0 for x, y in zip(trust, trust[1:]))  # a chain of 59 hosts
    assert {got[200 + k].verdict for k in range(20)} == {"block"} and got[301].verdict == "allow" and got[301].trust == 0
