import re

from pyspark.sql import functions as F

from sieveline.llm.queries import URL_RULES
from sieveline.llm.url_filter import BLOCK_SHARE, DAMPING, Rule, host_edges, judge_pages, propagate

RULES = [Rule(*r) for r in URL_RULES]
SCHEMA = "page_id long, url string, html string"


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fit = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def brute_scores(edges, seeds, steps=200):
    hosts = {h for e in edges for h in e[:2]} | set(seeds)
    t = {h: (1 - DAMPING) * seeds.get(h, (0, 0))[0] for h in hosts}
    d = {h: (1 - DAMPING) * seeds.get(h, (0, 0))[1] for h in hosts}
    for _ in range(steps):
        nt = {h: (1 - DAMPING) * seeds.get(h, (0, 0))[0] for h in hosts}
        nd = {h: (1 - DAMPING) * seeds.get(h, (0, 0))[1] for h in hosts}
        for a, b, n in edges:
            nt[b] += DAMPING * t[a] * n / sum(e[2] for e in edges if e[0] == a)
            nd[a] += DAMPING * d[b] * n / sum(e[2] for e in edges if e[1] == b)
        t, d = nt, nd
    return {h: (t[h], d[h]) for h in hosts}


PAGES = [
    (0, "http://A.Example.com/fr/8?page=2", '<a href="http://bad.org/es/1">x</a> <a href=\'//GOOD.example.com/en/7\'>y</a><a href="/rel">'),
    (1, "https://bad.org/es/1#top", '<a href="https://worse.net/x">'),
    (2, "https://worse.net/x", '<A HREF = "http://bad.org/es/2"> <a href="http://worse.net/self">'),
    (3, "https://good.example.com/en/77", '<a href="http://a.example.com/fr">'),
    (4, "https://good.example.com/other", None),
    (5, "https://worse.net/de/8", ""),
    (6, "http://sub.example.net/de/81", ""),
    (7, "http://com/en/x?y", ""), (8, None, '<a href="http://a.example.com">'), (9, "no scheme", ""), (10, "http://", ""), (11, "://x?y/z", ""),
    (12, "http://notexample.com/en/7", ""), (13, "http://a://b/c", ""), (13, "http://a://b/c", ""), (None, "ftp://org/es/", ""),
    (15, "http://h\n.org/es/", ""), (16, "http://\u0130x.com/en/", ""),
]


def test_every_verdict_against_a_plain_version(spark):
    df = spark.createDataFrame(PAGES, SCHEMA).withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1)).withColumn("verdict", F.lit(None).cast("int"))
    rows = judge_pages(df, RULES).collect()
    edges = [(r.src, r.dst, r.n) for r in host_edges(df).collect()]
    assert sorted(edges) == [("a.example.com", "bad.org", 1), ("a.example.com", "good.example.com", 1), ("bad.org", "worse.net", 1), ("good.example.com", "a.example.com", 1), ("worse.net", "bad.org", 1)]
    by_host = {}
    for _, url, _ in PAGES:
        h, p = split(url)
        if h:
            by_host.setdefault(h, []).append(rule(h, p)[1])
    seeds = {h: (v.count("allow") / len(v), v.count("block") / len(v)) for h, v in by_host.items()}
    scores = brute_scores(edges, seeds)
    want = []
    for i, url, _ in PAGES:
        h, p = split(url)
        name, verdict = rule(h, p)
        t, d = scores.get(h, (0, 0))
        want.append((i, h, p, name, verdict or ("block" if d - t > (1 - DAMPING) * BLOCK_SHARE else "allow")))
    assert sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in rows), key=str) == sorted(want, key=str)
    assert any(w[3] is None and w[4] == "block" for w in want)


def test_propagation_converges_to_the_plain_scores(spark):
    edges = [("a", "b", 3), ("a", "c", 1), ("b", "c", 2), ("c", "a", 5), ("d", "a", 1), ("b", "e", 1)]
    seeds = {"a": (1.0, 0.0), "e": (0.0, 0.7), "z": (0.2, 0.1)}
    got = propagate(spark.createDataFrame(edges, "src string, dst string, n long"), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust_seed double, distrust_seed double"), tolerance=1e-4)
    want = brute_scores(edges, seeds)
    rows = got.collect()
    assert {r.host for r in rows} == set(want)
    for r in rows:
        assert abs(r.trust - want[r.host][0]) < 1e-3 and abs(r.distrust - want[r.host][1]) < 1e-3


def test_empty_table_and_no_rules(spark):
    assert judge_pages(spark.createDataFrame([], SCHEMA), RULES).count() == 0
    assert {r.verdict for r in judge_pages(spark.createDataFrame(PAGES, SCHEMA), []).collect()} == {"allow"}
