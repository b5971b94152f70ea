from __future__ import annotations

import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from eventlake.llm import urlfilter
from eventlake.llm.queries import URL_RULES


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    fit = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, key=lambda x: len(x[0]), default=(None, None))


def brute(pages, rounds=400, d=0.85):
    """Dictionaries all the way; what reaches a host without edges goes back to the seeds in every round."""
    ruled = [(i, *parts(u), *rule(*parts(u))) for i, u, _ in pages]
    out, back = defaultdict(set), defaultdict(set)
    for _, u, html in pages:
        a = parts(u)[0]
        for x in re.findall(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:[a-z][a-z0-9+.-]*:)?//[^"'\s>]+)""", html or ""):
            b = parts("http:" + x if x.startswith("//") else x)[0]
            if a and b and a != b:
                out[a].add(b)
                back[b].add(a)
    scores = {}
    for kind, verdict, links in (("trust", "allow", out), ("distrust", "block", back)):
        seed = defaultdict(float)
        for h in {r[1] for r in ruled}:
            own = [r[4] for r in ruled if r[1] == h]
            seed[h] = own.count(verdict) / len(own)
        given = sum(seed.values())
        rank = dict(seed)
        for _ in range(rounds if given else 0):
            lost = sum(v for h, v in rank.items() if not links.get(h))
            new = defaultdict(float, {h: (1 - d + d * lost / given) * v for h, v in seed.items()})
            for a, bs in links.items():
                for b in bs:
                    new[b] += d * rank.get(a, 0) / len(bs)
            rank = new
        scores[kind] = rank
    for i, host, path, name, verdict in ruled:
        t, b = (round(scores[k].get(host, 0), 9) for k in ("trust", "distrust"))
        yield i, host, path, name, verdict or ("block" if b > t + urlfilter.MARGIN else "allow"), t, b


def check(spark, pages):
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    got = urlfilter.judge(df.repartition(3), urlfilter.rule_table(spark, URL_RULES)).collect()
    key = lambda r: (r[0], str(r))
    want = sorted(brute(pages), key=key)
    assert len(got) == len(want)
    for a, b in zip(sorted(map(tuple, got), key=key), want, strict=True):
        assert a[:4] == b[:4] and (a[4] == b[4] or abs(b[5] - b[6]) < 1e-4 and b[3] is None)
        assert abs(a[5] - b[5]) < 1e-4 and abs(a[6] - b[6]) < 1e-4


def test_rules_and_odd_urls(spark):
    urls = [
        None, "", "no scheme", "http://", "http://Example.ORG", "http://EXAMPLE.org/es/x", "https://a.example.org/en/12?x=/es/", "ftp://org/",
        "x://a.com?/fr/", "x://a.com#/de/", "x://a.com/de/ü", "x://notorg/", "x://b.org/://c.com/de/", "http://É.org/", "://net/a b\n/c", "http://.com/de/",
    ]
    check(spark, [(i, u, None) for i, u in enumerate(urls)] + [(0, None, "")])


def test_propagation_equals_brute_force(spark):
    rng = random.Random(2)
    hosts = [f"h{i}.{t}" for i in range(8) for t in ("com", "net", "example.org")]
    pages = []
    for i in range(120):
        links = "".join(rng.choice([f'<a class=x href="http://{rng.choice(hosts)}/q">', "<A HREF='/local'>", f"<a href=//{rng.choice(hosts)}/>", f'<link href="http://{rng.choice(hosts)}/">']) for _ in range(rng.randint(0, 4)))
        pages.append((i, f"http://{rng.choice(hosts)}/{rng.choice(['fr/', 'de/', 'en/1', 'x'])}", links))
    check(spark, pages)


def test_rank_sums_to_the_seeds(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")], "src string, dst string")
    seeds = spark.createDataFrame([("trust", "a", 1.0), ("trust", "c", 0.5), ("distrust", "d", 0.25)], "kind string, host string, value double")
    got = defaultdict(float)
    for r in urlfilter.propagate(edges, seeds).collect():
        got[r.kind] += r.value
    assert abs(got["trust"] - 1.5) < 1e-9 and abs(got["distrust"] - 0.25) < 1e-9


def test_empty_table_and_plan_without_python(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    out = urlfilter.judge(df, urlfilter.rule_table(spark, URL_RULES))
    assert out.count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())


def test_verdicts_do_not_depend_on_the_number_of_links(spark):
    for k in (1, 13, 200):
        pages = [(0, "http://bad.com/de/", None)] + [(i, f"http://h{i}.net/", '<a href="http://bad.com/de/">') for i in range(1, k + 1)]
        pages.append((k + 1, "http://clean.net/", None))
        df = spark.createDataFrame(pages, "page_id long, url string, html string")
        got = {r.page_id: r.verdict for r in urlfilter.judge(df, urlfilter.rule_table(spark, URL_RULES)).collect()}
        assert [got[i] for i in range(k + 2)] == ["block"] * (k + 1) + ["allow"]


def test_one_blocked_page_in_twenty_tells_without_trust(spark):
    pages = [(0, "http://h.com/de/", None)] + [(i, "http://h.com/x", None) for i in range(1, 21)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r.verdict for r in urlfilter.judge(df, urlfilter.rule_table(spark, URL_RULES)).collect()} == {"block"}
