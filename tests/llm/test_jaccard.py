from __future__ import annotations

import random
import re

import numpy as np
import pytest

from eventlake.llm import graph, jaccard

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, n, num, den):
    sets = [shingles(t, n) for _, t in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if both * den >= num * (len(sets[i]) + len(sets[j]) - both):
                    parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), d), d)
    return sorted((d, len(sets[i]), least[root(i)]) for i, (d, _) in enumerate(docs))


def corpus(rng):
    words = ["w%d" % i for i in range(400)]
    docs = [None, "", " \n", "a", "A", "a b c", "a b c d", "a b c d e", "ü Ü x y z", "Ü ü x y z"]
    docs += [" ".join("abcdefghijklmnop"[:k]) for k in range(5, 17)]
    for size in (4, 7, 9, 12, 20, 33, 60, 150, 400):
        for _ in range(3):
            base = rng.choices(words, k=size)
            docs.append(" ".join(base))
            for _ in range(rng.randint(1, 6)):
                copy = list(base)
                for _ in range(rng.randint(0, max(1, size // 30))):
                    what, at = rng.choice("rdit"), rng.randrange(len(copy))
                    if what == "r":
                        copy[at] = rng.choice(words).upper()
                    elif what == "d" and len(copy) > 1:
                        del copy[at]
                    elif what == "i":
                        copy.insert(at, rng.choice(words))
                    else:
                        copy = copy[: max(1, len(copy) - rng.randint(0, 3))]
                docs.append("\t".join(copy))
    passage = " ".join(rng.choices(words, k=50))
    docs += [passage + " " + " ".join(rng.choices(words, k=rng.randint(1, 30))) for _ in range(30)]
    docs += [docs[-1]] * 5
    rng.shuffle(docs)
    return [(i * 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("seed", "n", "num", "den"), [(1, 4, 85, 100), (2, 5, 80, 100), (3, 3, 55, 100)])
def test_classes_equal_brute_force(spark, seed, n, num, den):
    docs = corpus(random.Random(seed))
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "'x' AS fp").repartition(3)
    got = jaccard.classes(df, n, num, den).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(docs, n, num, den)


@pytest.mark.parametrize(("num", "den"), [(85, 100), (4, 5), (1, 2), (95, 100)])
def test_similar_sets_share_a_signature(num, den):
    rng = np.random.default_rng(5)
    bands = jaccard.Bands(num, den)
    for size in [*range(1, 40), 75, 200, 900]:
        for _ in range(6):
            slack = max(1, int(size * (1 - num / den))) + 1
            drop, add = int(rng.integers(0, slack)), int(rng.integers(0, slack))
            base = rng.choice(1 << 40, size, replace=False).astype(np.uint64)
            other = np.sort(np.concatenate([base[drop:], rng.choice(1 << 40, add, replace=False).astype(np.uint64) + np.uint64(1 << 41)]))
            if not (drop or add) or (size - drop) * den < num * (size + add):
                continue
            both = np.concatenate([np.sort(base), other])
            sig, which = jaccard.signatures(both, np.array([0, size, len(both)]), bands)
            assert set(sig[which == 0].tolist()) & set(sig[which == 1].tolist())


def test_repeated_ids_and_empty_table(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (2, "other words that are not alike"), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.classes(df).collect())
    assert got == [(1, 3, 1), (1, 3, 1), (2, 3, 1), (2, 3, 2), (3, 0, 3)]
    assert jaccard.classes(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    noise = [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(60)]
    edges = chain + star + noise + [(5, 5), (9000, 9000)]
    rng.shuffle(edges)
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if x != 9000}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("block", [256, 5])
def test_every_link_is_counted(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", block)
    rng = random.Random(9)
    base = rng.choices(["w%d" % i for i in range(500)], k=120)
    docs = corpus(rng) + [(5000 + i, " ".join([*base, *(f"own{i}x{k}" for k in range(i % 12))])) for i in range(40)]
    sets = {d: frozenset(shingles(t, 4)) for d, t in docs}
    distinct = set(sets.values()) - {frozenset()}
    links = {s: sum(s != o and len(s & o) * 100 >= 85 * len(s | o) for o in distinct) for s in distinct}
    got = jaccard.classes(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.n_links for r in got} == {d: links.get(s, 0) for d, s in sets.items()}
    assert max(links.values()) > 20
