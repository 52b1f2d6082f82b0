"""URL rules and score propagation."""

import re

from rainfold.llm import url_filter as u


def test_hosts_paths_and_rules(spark):
    cases = {  # url: (host, path, rule)
        "http://Example.ORG/es/1?x#y": ("example.org", "/es/1", "example.org/es/"),
        "https://a.example.org/en/12": ("a.example.org", "/en/12", "example.org/en/1"),
        "https://a.example.org/en/2": ("a.example.org", "/en/2", "org/"),
        "http://notexample.org/es/": ("notexample.org", "/es/", "org/"),
        "http://example.org": ("example.org", "", None), "http://x.com/fr/": ("x.com", "/fr/", "com/fr/"),
        "http://x.com/de/a": ("x.com", "/de/a", "com/de/"), "http://x.com/en": ("x.com", "/en", None),
        "http://xcom/fr/": ("xcom", "/fr/", None), "no scheme": ("", "", None), "": ("", "", None),
        "a://b?c://d": ("b", "", None), "x://ÄB.org/q": ("Äb.org", "/q", "org/"), "://org/": ("org", "/", "org/"),
        "http://h.org:80/a": ("h.org:80", "/a", None),
    }
    rows = [(i, k, None) for i, k in enumerate(cases)] + [(None, None, None), (0, "http://Example.ORG/es/1?x#y", "")]
    df = u.url_filter(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING"))
    got = {r.page_id: (r.host, r.path, r.rule) for r in df.collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values()) and got[None] == ("", "", None)
    assert df.count() == len(rows)


def test_trust_and_distrust(spark):
    rows = [(1, "http://good.org/a", '<a href="http://friend.net/">x</a>'),
            (2, "http://bad.example.org/es/1", ""),
            (3, "http://linker.net/x", '<A HREF="//bad.example.org/es/1">x</A> <a href="/own">y</a>'),
            (4, "http://friend.net/p", '<a href="https://bad.example.org/q">x</a>'),
            (5, "http://neutral.net/p", None),
            (6, "http://mixed.com/de/1", None), (7, "http://mixed.com/en/1", None)]
    df = u.url_filter(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING"))
    got = {r.page_id: r for r in df.collect()}
    assert [got[i].verdict for i in range(1, 8)] == ["allow", "block", "block", "allow", "allow", "block", "block"]
    p = u.Propagation()
    # friend.net is trusted by a link and, half as much, distrusted for its own link
    assert abs(got[4].trust - 0.15 * 0.85) < 1e-12 and got[4].distrust > 0
    # brute force of the same recursion
    hosts = {"bad.example.org": 1.0, "mixed.com": 0.5}
    links = {"bad.example.org": {"linker.net": 1, "friend.net": 1}, "friend.net": {"good.org": 1}}
    score = {h: (1 - p.damping) * s for h, s in hosts.items()}
    for _ in range(p.rounds):
        new = {h: (1 - p.damping) * s for h, s in hosts.items()}
        for a, out in links.items():
            for b, n in out.items():
                new[b] = new.get(b, 0) + p.damping * score.get(a, 0) * n / sum(out.values())
        score = new
    for k, h in ((1, "good.org"), (3, "linker.net"), (4, "friend.net"), (7, "mixed.com")):
        assert abs((got[k].distrust or 0) - score[h]) < 1e-12


def test_native_and_empty(spark):
    df = u.url_filter(spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING"))
    assert df.count() == 0
    assert not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())
