import re

import numpy as np
from pyspark.sql import functions as F

from lexis.llm import urls
from lexis.llm.common import least_hashed

from .data import CLASHES

SAMPLES = [
    "http://Shop.Example.ORG/es/1", "https://example.org/en/12?x=1", "http://example.org/en/2", "http://notexample.org/es/", "http://a.com/fr/", "http://com/fr/x", "http://b.com/de/q#z",
    "ftp://x.net?y", "nothing", "", None, "http://", "://h/p", "http://a.com/fr", "x://y://z.org/w", "http://ÄB.org/ä", "http://a.org\n/q", "HTTP://B.COM/DE/", "http://user@c.com:80/de/1",
]


def brute(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        m = re.match(r"([^/?#]*)([^?#]*)", rest)
        host, path = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in m[1]), m[2]
    fits = [(len(h) + len(p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[1:] if fits else None


def pages(spark, samples, extra=False):
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(samples)], "page_id long, url string, html string")
    return df.select("*", *[F.lit(1).alias(c) for c in (*CLASHES, "host", "path", "fit")]) if extra else df


def test_rules(spark):
    many = SAMPLES * 10 + [f"http://{'ads-' * (i % 2)}h{i}.com/{'de' if i % 2 else 'fr'}/{i}" for i in range(200)]
    got = {r.page_id: r for r in urls.url_verdicts(pages(spark, many, extra=True)).collect()}
    for i, u in enumerate(many):
        host, path, rule = brute(u)
        r = got[i]
        assert (r.host, r.path) == (host, path) and r.verdict in ("allow", "block") and 0 <= r.score <= 1
        assert (r.rule, r.verdict) == rule if rule else r.rule is None
    learned = [f"http://ads-x{i}.net/q" for i in range(20)] + [f"http://y{i}.net/q" for i in range(20)]
    again = {r.page_id: r for r in urls.url_verdicts(pages(spark, many + learned)).collect()}
    scores = [again[len(many) + i].score for i in range(40)]
    assert np.mean(scores[:20]) > np.mean(scores[20:])  # the rules' urls with ads- are blocked, and so the trees think


def test_empty(spark):
    assert urls.url_verdicts(pages(spark, [])).count() == 0
    assert {r.verdict for r in urls.url_verdicts(pages(spark, ["http://x.net/", None])).collect()} == {"allow"}


def test_trees_learn():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, len(urls.NAMES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 4] > 0)).astype(float)
    model = urls.boost(urls.Trees(3), x[:3000], y[:3000])
    assert ((model.margins(x[3000:]) > 0) == (y[3000:] > 0)).mean() > 0.95


def brute_margin(model, row):
    """One row down each tree, node by node."""
    out = model.base
    for feature, cut, leaf in model.trees:
        node = 0
        while node < len(feature):
            node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
        out += leaf[node - len(feature)]
    return out


def test_trees_against_a_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, len(urls.NAMES)))
    y = (x[:, 2] + x[:, 5] ** 2 > 1).astype(float)
    model = urls.boost(urls.Trees(3), x, y, rounds=6)
    assert np.allclose(model.margins(x), [brute_margin(model, row) for row in x])
    # the first split is the best of all: no other cut of any feature has a smaller loss
    p = y.mean()
    g, h = p - y, np.full(len(y), p * (1 - p))

    def gain(f, cut):
        left = x[:, f] <= cut
        return sum(g[m].sum() ** 2 / (h[m].sum() + 1) for m in (left, ~left)) - g.sum() ** 2 / (h.sum() + 1)

    feature, cut, _ = model.trees[0]
    best = max(gain(f, e) for f in range(x.shape[1]) for e in np.quantile(x[:, f], np.linspace(0, 1, urls.BINS + 1)[1:-1]))
    assert np.isclose(gain(feature[0], cut[0]), best)


def test_repeated_urls_change_nothing(spark):
    """A url that makes up nearly all rows neither empties the sample nor turns verdicts."""
    base = [f"http://{'ads-' * (i % 2)}h{i}.com/{'de' if i % 2 else 'fr'}/{i}" for i in range(120)] + ["http://zz.net/de/q", "http://ads-q.net/x"]
    alone = {r.url: r.score for r in scored(spark, base)}
    for hot in ("http://a.com/de/1", "http://b.com/fr/2"):
        crowded = {r.url: r.score for r in scored(spark, base + [hot] + base[:1])}
        many = {r.url: r.score for r in scored(spark, base + [hot] * 3000 + base[:1])}
        assert many == crowded and len(many) == len(alone) + 1


def scored(spark, samples):
    df = pages(spark, samples)
    return urls.url_verdicts(df, most=50).join(df.select("page_id", "url"), "page_id").select("url", "score").distinct().collect()


def test_sample_of_repeated_keys(spark):
    for key in range(4):
        rows = spark.createDataFrame([(f"http://{key}",)] * 1000 + [(f"http://x{i}",) for i in range(20)], "url string")
        assert least_hashed(rows, 50, "url").count() == 50
    assert least_hashed(rows.limit(0), 50, "url").count() == 0


def test_suffix_rates(spark):
    labelled = spark.createDataFrame([("a.com", 1.0), ("b.com", 0.0), ("x.b.com", 1.0), ("", 0.0), ("org", 1.0)], "host string, y double")
    rates = urls.suffix_rates(labelled, weight=2.0)
    prior = (1 + 0 + 1 + 1 + 0 + 1 + 0 + 1) / 8  # eight pairs of a url and one of its suffixes
    assert np.isclose(rates[urls.slot("com")], (2 + 2 * prior) / 5) and np.isclose(rates[urls.slot("b.com")], (1 + 2 * prior) / 4)


def test_features():
    f = urls.Trees(3).features(["https://a-b.c.org/x/y/1?p=1&q=2#f", None], ["a-b.c.org", ""], ["/x/y/1", ""])
    row = dict(zip(urls.NAMES, f[0]))
    assert row["length"] == 33 and row["depth"] == 3 and row["parameters"] == 2 and row["hyphens"] == 1 and row["labels"] == 3 and row["fragment"] == row["secure"] == 1
    assert f[1][0] == f[1][5] == 0
