"""URL filters against plain versions."""

import math

import numpy as np

from boxlake.llm import urls
from tests.llm.helpers import rows

RULES = urls.RULES
COLUMNS = ["page_id", "host", "path", "rule", "verdict"]


def plain_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path):
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fit, key=lambda r: len(r.name), default=None)


def plain_grams(url):
    out = []
    for kind, text in zip((1, 2), plain_split(url)):
        codes = [ord("0") if c in "0123456789" else ord(c) for c in urls.START + text + urls.END]
        for n in urls.SIZES:
            for i in range(len(codes) - n + 1):
                h = kind
                for c in codes[i : i + n]:
                    h = (h * urls.FACTOR + c) % urls.MODULUS
                out.append(h % urls.PLACES)
    return out


def plain_vector(url):
    g = plain_grams(url)
    return np.bincount(g, minlength=urls.PLACES) / math.sqrt(max(1, len(g)))


def plain_model(labelled):
    """Gradient descent on the weights themselves; the bias is the last."""
    x = np.column_stack([np.array([plain_vector(u) for u, _ in labelled]), np.ones(len(labelled))])
    y = np.array([b for _, b in labelled])
    w = np.zeros(x.shape[1])
    for _ in range(urls.STEPS):
        w = w * (1 - urls.RATE * urls.RIDGE) + urls.RATE / len(y) * x.T @ (y - 1 / (1 + np.exp(-x @ w)))
    return w


URLS = [
    None, "", "no scheme.org/es/", "https://Example.ORG/es/1", "https://a.example.org/en/1?x", "https://a.example.org/en/2#y",
    "http://notexample.org/es/", "https://org/", "https://org", "https://x.com/fr/", "https://x.com/de/#", "https://x.net/a/b?c=://d.org/",
    "ftp://casino-pills.example.net/en/3", "https://ünïcode.net/é", "x://" + "long-host." * 3000 + "org/" + "p" * 20000, "https://x.com\n/fr/", "://",
]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x", 0.5) for i, u in enumerate([*URLS, *URLS])], "page_id long, url string, rule string, score double")
    got = {r[0]: r[1:] for r in rows(urls.judge(pages, RULES), *COLUMNS)}
    assert len(got) == 2 * len(URLS)
    for i, url in enumerate([*URLS, *URLS]):
        host, path = plain_split(url)
        rule = plain_rule(host, path)
        assert got[i][:3] == (host, path, rule.name if rule else None), url
        assert got[i][3] == rule.verdict if rule else got[i][3] in ("allow", "block")


def test_scores_match_plain_descent(spark):
    labelled = [(u, 0) for u in urls.WANTED.split()] + [(u, 1) for u in urls.UNWANTED.split()]
    w = plain_model(labelled)
    pages = spark.createDataFrame(list(enumerate(URLS[:14])), "page_id long, url string")
    got = dict(rows(urls.judge(pages, RULES), "page_id", "score"))
    for i, url in enumerate(URLS[:14]):
        z = plain_vector(url) @ w[:-1] + w[-1]
        assert abs(got[i] - 1 / (1 + math.exp(-z))) < 2e-4, url


def test_unseen_urls(spark):
    """None of these is in the labelled table."""
    bad = ["https://www.casino-night.example.org/en/5", "http://cheap-pills-store.example.net/fr/8", "https://spam-lists.example.com/en/9", "https://bets-today.example.net/en/77"]
    good = ["https://www.gardening.example.net/en/5", "http://m.townmuseum.example.com/fr/8", "https://blog.weathering.example.net/en/9", "https://library-notes.example.com/en/77"]
    pages = spark.createDataFrame(list(enumerate(bad + good)), "page_id long, url string")
    got = dict(rows(urls.judge(pages, []), "page_id", "verdict"))
    assert [got[i] for i in range(8)] == ["block"] * 4 + ["allow"] * 4


def test_small_and_odd_label_tables(spark):
    pages = spark.createDataFrame([(1, "https://a.b/c")], "page_id long, url string")
    none = spark.createDataFrame([], urls.LABELLED_SCHEMA)
    assert rows(urls.judge(pages, [], none), "verdict", "score") == [("block", 0.5)]
    odd = spark.createDataFrame([("https://a.b/c", 0), ("https://a.b/c", 0), (None, 1), ("https://q.q/q", None)], urls.LABELLED_SCHEMA)
    assert rows(urls.judge(pages, [], odd), "verdict") == [("allow",)]
    assert urls.judge(spark.createDataFrame([], "page_id long, url string"), RULES).count() == 0
