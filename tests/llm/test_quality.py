from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from eventlake.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)




TEXTS = [
    None, "", " ", "\n\n", "one", "a b c d e", "a a a a a a", "a b c d e a b c d e", "a b c d e f a b c d e x a b c d e",
    "x\n x\nx\n\n\nx \ny\ty\v\f\r y", "é# *$ü%&|<> z 　", "w " * 3000 + "end", "l\nl\nl\nl", "1 2 3 4 5 6 1 2 3 4 5 7 2 3 4 5 6",
    "#" * 50_000, " ".join(str(i % 7) for i in range(500)), " ".join(str(i) for i in range(20_000)),
]


def test_counts_equal_brute_force(spark):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choice("ab \n\t#") for _ in range(rng.randint(0, 80))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", quality.statistics(df).alias("s")).select("doc_id", "s.*").collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(texts[r.doc_id]), texts[r.doc_id]


def reference_mcd(x, floors, share=0.75, prior=50.0):
    """The same search on one group, in plain arrays."""
    d = x.shape[1]
    floor = np.diag(np.square(floors))

    def estimate(near, factor):
        m = near.mean(0)
        return m, (factor * (near - m).T @ (near - m) + prior * floor) / (len(near) + prior) + floor

    def distances(m, scatter):
        return np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(scatter), x - m)

    def step(m, scatter):
        bins = np.floor(np.log1p(distances(m, scatter)) * quality.BINS)
        limit = next(b for b in np.unique(bins) if (bins <= b).sum() >= share * len(x))
        return estimate(x[bins <= limit], quality.consistency(share, d))

    rank = lambda q, i: np.sort(x[:, i])[max(math.ceil(q * len(x)), 1) - 1]
    m = np.array([rank(0.5, i) for i in range(d)])
    middle = np.array([max((rank(0.75, i) - rank(0.25, i)) / 1.349, floors[i]) for i in range(d)])
    found = []
    for start in ((m, floor), (m, np.diag(middle**2)), estimate(x, 1.0)):
        for _ in range(quality.START_STEPS):
            start = step(*start)
        found.append(start)
    best = min(found, key=lambda s: round(np.linalg.slogdet(s[1])[1], 9))
    for _ in range(quality.MOST_STEPS):
        best = step(*best)
    near = x[distances(*best) <= quality.chi2_quantile(0.975, d)]
    return estimate(near, quality.consistency(0.975, d))


def test_estimates_equal_plain_numpy(spark):
    rng = np.random.default_rng(3)
    floors = [0.3, 0.5, 0.1]
    parts = {"a": 400, "b": 37, "c": 1}
    data, rows = {}, []
    for g, n in parts.items():
        x = rng.normal([1, 5, -2], [1, 0.2, 3], (n, 3))
        x[: n // 6] += [9, 9, 9]
        data[g] = x
        rows += [(g, *map(float, v)) for v in x]
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(5)
    for r in quality.mcd(df, ["g"], ["x", "y", "z"], floors).collect():
        m, scatter = reference_mcd(data[r.g], floors)
        low = np.linalg.cholesky(scatter)
        assert np.allclose([r[f"m{i}"] for i in range(3)], m)
        assert np.allclose([[r[f"l{i}{j}"] if j <= i else 0 for j in range(3)] for i in range(3)], low)


def test_chi_square():
    assert abs(quality.chi2_quantile(0.95, 1) - 3.841459) < 1e-5
    assert abs(quality.chi2_quantile(0.99, 4) - 13.276704) < 1e-5
    assert abs(quality.chi2_quantile(0.9999, 7) - 29.8775) < 1e-3


def test_rejected_share_of_normal_data_is_the_stated_tail(spark):
    """Also with a fifth of far values among them, which the estimate does not see."""
    rng = np.random.default_rng(5)
    mix = np.array([[1, 0, 0, 0], [0.6, 0.8, 0, 0], [0, 0.3, 1, 0], [0.2, 0, 0.5, 0.4]])
    x = rng.normal(size=(30_000, 4)) @ mix.T + [1, 2, 3, 4]
    far = rng.normal(size=(7_000, 4)) * 0.1 + [9, -9, 9, 9]
    names = ["w", "x", "y", "z"]
    for rows in (x, np.concatenate([x, far])):
        df = spark.createDataFrame([("g", *map(float, v)) for v in rows], "g string, w double, x double, y double, z double")
        r = quality.mcd(df, ["g"], names, [1e-3] * 4).first()
        low = np.array([[r[f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        m = np.array([r[f"m{i}"] for i in range(4)])
        d2 = np.square(np.linalg.solve(low, (x - m).T)).sum(0)
        for tail in (0.1, 0.01, 0.001):
            share = (d2 > quality.chi2_quantile(1 - tail, 4)).mean()
            assert abs(share - tail) < 0.12 * tail + 4 * math.sqrt(tail / len(x)), (tail, share)
        assert (np.square(np.linalg.solve(low, (far - m).T)).sum(0) > quality.chi2_quantile(0.9999, 4)).all()


def test_rejections_agree_with_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = [r for r in quality.judge(docs).collect() if not r.base_failed and r.doc_id in labels]
    rejected = [labels[r.doc_id] for r in got if not r.kept]
    good = [r.kept for r in got if labels[r.doc_id] == 1]
    print("rejected", len(rejected), "of them labelled bad", rejected.count(0), "labelled bad in all", sum(labels[r.doc_id] == 0 for r in got))
    assert rejected.count(0) >= 0.95 * len(rejected) and len(rejected) >= 20
    assert sum(good) >= 0.98 * len(good)


def test_outliers_go_and_plain_text_stays(spark):
    rng = random.Random(1)
    syllables = "the an er on ti re ing ed".split()
    prose = lambda n: " ".join("".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n))
    rows = [(i, prose(rng.choice([12, 40, 300, 4000])), ["en", None][i % 2], "s", i) for i in range(200)]
    rows += [(1000 + i, " ".join(w + "%%%" for w in prose(100).split()), "en", "s", 0) for i in range(20)]
    rows += [(2000, None, "en", "s", 0), (2001, "too short", None, None, 0), (2002, prose(50), "xx", None, 0), (3, prose(60), "en", "s", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words int")
    got = quality.judge(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.base_failed == (r.doc_id in (2000, 2001))
        assert r.kept == (r.doc_id < 1000 or r.doc_id == 2002), r
        assert (r.d2 is None) == r.base_failed


def test_empty_table_and_plan_without_python(spark):
    df = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    out = quality.judge(df)
    assert out.count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    assert out.select(F.max("d2")).first()[0] is None
