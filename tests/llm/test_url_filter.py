"""URL filters: rules against plain code, components against a plain search."""

import random

import pytest

from lodestrata.llm import url_filter as uf


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:k], rest[k:]
    k = min([rest.find(c) for c in "?#" if c in rest], default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:k]


def rule_of(url, rules):
    host, path = parts(url)
    fits = []
    for v, r in rules:
        h, p = r.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((-len(r), r, v))
    return min(fits)[1:] if fits else (None, None)


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, rule string")


URLS = [None, "", "nothing", "http://a.org", "http://a.org/", "HTTP://A.ORG/x", "https://example.org/es/1", "https://m.Example.org/en/1?x", "https://example.org/en/2#f", "http://Ñ.com/de/",
        "http://x.com/fr/9?u=http://b.org/", "x://org/", "http://com/de/", "http://notcom/de/", "http://x.net?y/de/", "http://y.net#/", "a://b://c.org/", "http://\n.org/\n", "//org/"]


@pytest.mark.parametrize("inline", [200, 0])
def test_rules(spark, inline, monkeypatch):
    monkeypatch.setattr(uf, "MAX_INLINE", inline)
    rows = list(enumerate(URLS)) + [(3, URLS[3])]
    got = uf.filter_pages(frame(spark, [(i, u, "<p>no links</p>") for i, u in rows])).collect()
    assert len(got) == len(rows)
    for g in got:
        rule, verdict = rule_of(URLS[g["page_id"]], uf.RULES)
        assert (g["host"], g["path"]) == parts(URLS[g["page_id"]])
        assert (g["rule"], g["verdict"]) == (rule, verdict or "allow")


def test_blocks_reach_aliases(spark):
    r = random.Random(3)
    hosts = ["a.net", "b.net", "example.org", "x.com", "c.org"]
    urls = [f"http://{r.choice(hosts)}/{r.choice(['de', 'es', 'q'])}/{i}" for i in range(120)]
    rows, edges = [], []
    for i, u in enumerate(urls):
        html = "<html>"
        if r.random() < 0.6:
            v = r.choice(urls[max(0, i - 4) : i + 4])
            edges.append((u, v))
            form = r.randrange(4)
            html += [f'<link rel="canonical" href="{v}#frag">', f"<LINK href='{v}' data-x='1' REL=Canonical />", f'<meta http-equiv="refresh" content="0; URL={v}">', f"<meta content='3;url={v}' HTTP-EQUIV='Refresh'>"][form]
        rows.append((i, u + ("#top" if i % 5 == 0 else ""), html + '<link rel="stylesheet" href="http://x.com/de/style.css">'))
    rows += [(500, None, None), (501, "http://lone.net/", "<link rel=canonical href=/here>"), (502, "http://lone.net/here", None), (None, urls[0], None)]
    edges += [("http://lone.net/", "http://lone.net/here")]
    extra = [(urls[0], urls[77]), ("http://outside.com/de/1", urls[5]), (None, urls[3])]
    redirects = spark.createDataFrame(extra, "source string, target string")
    near = {}
    for a, b in edges + extra:
        if a and b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def reach(u):
        seen, todo = {u}, [u]
        while todo:
            for v in near.get(todo.pop(), ()):
                if v not in seen:
                    seen.add(v)
                    todo.append(v)
        return seen

    carried = 0
    for g in uf.filter_pages(frame(spark, rows), redirects=redirects).collect():
        u = (g["url"] or "").split("#")[0]
        rule, verdict = rule_of(g["url"], uf.RULES)
        want = verdict or ("block" if any(rule_of(v, uf.RULES)[1] == "block" for v in reach(u)) else "allow")
        assert (g["rule"], g["verdict"]) == (rule, want)
        assert g["alias_of"] == (min(reach(u)) if len(reach(u)) > 1 else None)
        carried += verdict is None and want == "block"
    assert carried > 5


def test_one_large_component(spark):
    rows = [(i, f"http://s{i}.net/", f'<link rel="canonical" href="http://s{max(0, i - 1) if i < 60 else 0}.net/">') for i in range(400)]
    rows.append((999, "http://hub.com/de/", '<link rel="canonical" href="http://s7.net/">'))
    assert {g["verdict"] for g in uf.filter_pages(frame(spark, rows)).collect()} == {"block"}


def test_empty(spark):
    assert uf.filter_pages(frame(spark, [])).collect() == []


@pytest.mark.parametrize("canonical", [False, True])
def test_relative_links_entities_and_rel_lists(spark, canonical):
    base = "http://a.net/x/y/p.html?q=1"
    cases = [("page.html", "http://a.net/x/y/page.html"), ("../z", "http://a.net/x/z"), ("./k?m=../1", "http://a.net/x/y/k?m=../1"), ("?page=2&amp;ref=x", "http://a.net/x/y/p.html?page=2&ref=x"),
             ("../../../t/", "http://a.net/t/"), ("..", "http://a.net/x/"), ("/a/./b/../c", "http://a.net/a/c"), ("http:&#x2F;/b.net/?u=1&amp;lt;", "http://b.net/?u=1&lt;"), ("mailto:x@y.z", None), ("#top", None)]
    form = '<link rel="nofollow Canonical" href="{}">' if canonical else '<meta http-equiv="refresh" content="0; url={}">'
    got = uf.links(frame(spark, [(i, f"{base}{i}", form.format(t)) for i, (t, _) in enumerate(cases)])).collect()
    assert {(g["u"], g["v"]) for g in got} == {(f"{base}{i}", w) for i, (_, w) in enumerate(cases) if w}
    pages = [(1, "http://com.net/de/a", form.format("../x.html")), (2, "http://com.net/x.html", form.format("http://x.com/de/1"))]
    assert {g["verdict"] for g in uf.filter_pages(frame(spark, pages)).collect()} == {"block"}
