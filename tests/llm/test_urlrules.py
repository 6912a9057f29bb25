import random

import pytest

from demandlens.llm import urlrules

URLS = [
    None, "", "no scheme", "https://", "http://net", "http://net/", "http://a.NET/x", "https://example.net/en/1?x#y", "https://www.example.net/en",
    "https://wexample.net/en/", "ftp://example.com/de/", "http://example.com/DE/", "http://x.org/fr/a", "http://x.org?/fr/", "http://org/fr/",
    "http://.net/", "http://a..net/", "http://example.com:80/de/", "http://u@example.com/de/", "a://b://c.net/", "http://Ünet.org/fr/é", "http://a.net#/b",
    "http://a\x01.net/x", "http://net\x00.b/x",
]


def _brute(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min((tail.find(c) for c in "?#" if c in tail), default=len(tail))]
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def _pages(llm, urls):
    rows = [(k, u, "<html>", "clash", "clash") for k, u in enumerate(urls)]
    return llm.createDataFrame(rows, "page_id long, url string, html string, rule string, key string").repartition(4)


def test_contract_rules(llm):
    got = {r.page_id: tuple(r)[1:] for r in urlrules.judge(_pages(llm, URLS), urlrules.rules_frame(llm)).collect()}
    assert got == {k: _brute(u, urlrules.RULES) for k, u in enumerate(URLS)}


@pytest.mark.parametrize("seed", [1, 2])
def test_nested_rules_equal_brute_force(llm, seed):
    rnd = random.Random(seed)
    hosts = ["a", "b.a", "c.b.a", "d.c.b.a", "ab.a", "b", "a.b"]
    rules = {(h, p): rnd.choice(["allow", "block"]) for h, p in ((rnd.choice(hosts), rnd.choice(["/", "/x", "/x/y", ""])) for _ in range(12))}
    rules = [(a, h, p) for (h, p), a in rules.items()]
    urls = [f"http://{rnd.choice(['', 'w.'])}{rnd.choice(hosts)}{rnd.choice(['', '/', '/x', '/x/y/z', '/q'])}" for _ in range(400)] + ["http://a/x"] * 200
    got = {r.page_id: tuple(r)[1:] for r in urlrules.judge(_pages(llm, urls), urlrules.rules_frame(llm, rules)).collect()}
    for k, u in enumerate(urls):
        host, path, rule, verdict = _brute(u, rules)
        fits = {(h + p): a for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)}
        assert got[k][:2] == (host, path) and len(got[k][2] or "") == len(rule or "")  # equal lengths: the deeper host's
        assert got[k][3] == fits.get(got[k][2], "allow")


def test_edges(llm):
    rules = urlrules.rules_frame(llm, [("allow", "net", "/"), ("block", "NET", "/"), (None, "x", "/"), ("block", None, "/"), ("block", "org", None)])
    assert urlrules.judge(_pages(llm, ["http://net/"] * 3), rules).where("verdict = 'block'").count() == 3
    assert urlrules.judge(_pages(llm, ["http://x/", "http://y.org/"]), rules).where("rule is null and verdict = 'allow'").count() == 2
    assert urlrules.judge(_pages(llm, []), rules).collect() == []
    assert urlrules.judge(_pages(llm, URLS), rules.limit(0), "block").where("verdict = 'block'").count() == len(URLS)
