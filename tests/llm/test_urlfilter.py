import math

import numpy as np

from quillon.llm import urlfilter as u

CASES = [
    (None, "", "", None), ("example.com/en/", "", "", None), ("HTTP://A.Example.COM/en/1?x#y", "a.example.com", "/en/1", "com/en/"),
    ("http://example.com/en/72", "example.com", "/en/72", "example.com/en/7"), ("http://x.net/de/", "x.net", "/de/", "net/de/"), ("http://w.example.net/de/81", "w.example.net", "/de/81", "example.net/de/8"),
    ("http://badexample.net/de/8", "badexample.net", "/de/8", "net/de/"), ("http://é.org?/es/", "é.org", "", None), ("http://o.org/es/#", "o.org", "/es/", "org/es/"),
    ("a://b://c/d", "b:", "//c/d", None), ("http://h\nx/p\nq?z", "h\nx", "/p\nq", None), ("http://O.ORG/ES/", "o.org", "/ES/", None),
]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, c[0], 1) for i, c in enumerate(CASES)], "page_id long, url string, host int").drop("none")
    got = {r.page_id: r for r in u.judge(df).collect()}
    says = dict(u.RULES)
    for i, (_, host, path, rule) in enumerate(CASES):
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule), CASES[i]
        assert got[i].verdict == (says[rule] if rule else ("block" if got[i].p_block >= 0.5 else "allow"))
    assert u.judge(df.limit(0)).count() == 0


def judged(spark, urls, weights):
    p = u.parts(spark.createDataFrame([(i, x) for i, x in enumerate(urls)], "n int, url string")).orderBy("n").toArrow()
    return u.score(u.common.strings(p["host"]), u.common.strings(p["path"]), weights)


def test_the_table_shows_no_host_of_the_pages(spark):
    names = set(u.BLOCKED) | set(u.KEPT)
    hosts = {r.host for r in u.parts(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url")).select("host").distinct().collect()}
    assert not {h for h in hosts for part in h.split(".") if part in names}


def test_weights_follow_a_plain_regression(spark, monkeypatch):
    monkeypatch.setattr(u, "STEPS", 30)
    some = u.LABELLED[:6] + u.LABELLED[-6:]
    hosts, paths, y = u.table(spark, some)
    got = u.fit(hosts, paths, y)

    def features(host, path):
        out = {}
        for part, text in ((0, host), (1, path)):
            own = u.grams(u.pa.array([text]), part)[0].tolist()
            for b in own:
                out[b] = out.get(b, 0) + 1 / math.sqrt(len(own))
        return out

    rows, w, bias = [features(h, p) for h, p in zip(hosts.to_pylist(), paths.to_pylist())], {}, 0.0
    for _ in range(30):
        error = [(1 / (1 + math.exp(-bias - sum(w.get(b, 0) * x for b, x in r.items()))) - k) / len(y) for r, k in zip(rows, y)]
        step = {b: u.RIDGE * v for b, v in w.items()}
        for r, e in zip(rows, error):
            for b, x in r.items():
                step[b] = step.get(b, 0) + e * x
        bias -= u.RATE * sum(error)
        w = {b: w.get(b, 0) - u.RATE * g for b, g in step.items()}
    assert abs(got[-1] - bias) < 1e-9 and all(abs(got[b] - x) < 1e-9 for b, x in w.items())


def test_names_that_were_held_out(spark):
    """Ten folds of the table's names: precision and recall of the model on names that it wasn't shown."""
    hosts, paths, y = u.table(spark)
    p = np.zeros(len(y))
    for k in range(10):
        out = np.arange(len(y)) % 10 == k
        take = lambda a, m: a.filter(u.pa.array(m))
        p[out] = u.score(take(hosts, out), take(paths, out), u.fit(take(hosts, ~out), take(paths, ~out), y[~out]))
    said = p >= 0.5
    assert (y[said] == 1).mean() > 0.75 and said[y == 1].mean() > 0.65
    assert ((judged(spark, [x for x, _ in u.LABELLED], u.fit(hosts, paths, y)) >= 0.5) == (y == 1)).all()


def test_odd_rows(spark):
    rows = [(None, "http://a.b/c"), (1, "http://" + "a" * 200_000 + "/" + "b" * 200_000), (2, "http://x.y/z"), (2, "http://x.y/z")]
    got = u.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 4 and max(len(r.host) for r in got) == 200_000 and len({r.p_block for r in got if r.page_id == 2}) == 1


def test_whole_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    assert u.op4_url_filter(spark, sf).count() == pages.count()
