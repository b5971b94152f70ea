from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eventlake.llm import katz

WORD = re.compile(r"[^\x20\x09-\x0d]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
K = katz.K


class Model:
    """The same model from dictionaries."""

    def __init__(self, docs):
        self.uni, self.bi, self.tri = Counter(), Counter(), Counter()
        for d, text in docs:
            if zlib.crc32(str(d).encode()) % 7 != 2:
                t = tokens(text)
                self.uni.update(t)
                self.bi.update(zip([None, *t], t))
                self.tri.update(zip([None, *t], t, t[1:]))
        self.tri = Counter({k: c for k, c in self.tri.items() if c >= 2})
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        of = lambda c: [sum(x == r for x in c.values()) for r in range(1, K + 2)]
        self.du, self.db = katz.discounts(of(self.uni)), katz.discounts(of(self.bi))
        self.dt = katz.trigram_discounts(of(self.tri))
        self.after_two = defaultdict(dict)
        for (u, v, w), c in self.tri.items():
            self.after_two[u, v][w] = c
        self.after = defaultdict(dict)
        for (u, v), c in self.bi.items():
            self.after[u][v] = c
        self.over = self.n + (not any(c <= K for c in self.uni.values()))
        self.unknown = 1 - sum(self.p1(v) for v in self.uni) if self.n else 1.0

    def p1(self, v):
        c = self.uni.get(v, 0)
        return (self.du[c] if c <= K else 1) * c / self.over if c else self.unknown

    def score(self, t):
        return sum(math.log10(self.p3(w, u, v)) for u, v, w in zip([0, None, *t], [None, *t], t))

    def p3(self, w, u, v):
        """After u, v; u is 0 where v begins the text."""
        over = self.bi.get((u, v), 0)
        own = self.after_two.get((u, v), {})
        if over < 2 or u == 0:
            return self.p(w, v)
        d = lambda c: self.dt[c] if c <= K else 1
        over += sum(own.values()) == over and all(c > K for c in own.values())
        seen = {x: d(c) * c / over for x, c in own.items()}
        if w in own:
            return seen[w]
        return (1 - sum(seen.values())) / (1 - sum(self.p(x, v) for x in own)) * self.p(w, v)

    def p(self, v, u):
        own = self.after.get(u)
        if not own:
            return self.p1(v)
        over = sum(own.values()) + all(c > K for c in own.values())
        seen = {w: (self.db[c] if c <= K else 1) * c / over for w, c in own.items()}
        if v in own:
            return seen[v]
        return (1 - sum(seen.values())) / (1 - sum(self.p1(w) for w in own)) * self.p1(v)


def tokens(text):
    return [*WORD.findall((text or "").translate(LOW)), "</s>"]


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        text = " ".join(words[min(int(rng.expovariate(0.12)), 59)].upper() if rng.random() < 0.1 else words[min(int(rng.expovariate(0.12)), 59)] for _ in range(rng.randint(0, 60)))
        out.append((i, text + (" rare%d" % i if i % 5 == 0 else "")))
    return [*out, (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "the " * 500), (3, "repeated id")]


@pytest.mark.parametrize("small", [False, True])
def test_scores_equal_dictionaries(spark, monkeypatch, small):
    docs = corpus(1, 300)
    if small:  # many blocks and parts, and words spread over the parts
        monkeypatch.setattr(katz, "PART_TOKENS", 900)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS block", "2 AS part").repartition(7 if small else 2)
    model = Model(docs)
    got = katz.scores(df).collect()
    want = defaultdict(list)
    for d, text in docs:
        t = tokens(text)
        want[d].append((
            zlib.crc32(str(d).encode()) % 7 == 2, len(t), sum(x in model.uni for x in t), model.n,
            sum(math.log10((model.uni[x] + 1) / (model.n + model.v + 1)) for x in t), model.score(t),
        ))
    assert len(got) == len(docs)
    for r in got:
        assert any(tuple(r)[1:5] == w[:4] and np.allclose(tuple(r)[5:], w[4:], rtol=1e-9) for w in want[r.doc_id]), (r, want[r.doc_id])
    for u in [None, "w0", "w7", "rare5", "the", "nowhere"]:
        assert abs(sum(model.p(v, u) for v in model.uni) + model.p("unknown word", u) - 1) < 1e-9
    contexts = [(None, "w0"), ("w0", "w1"), ("w1", "w0"), ("the", "the"), ("w2", "w2"), ("w0", "nowhere"), (0, None), *list(model.after_two)[:20]]
    for u, v in contexts:
        assert abs(sum(model.p3(w, u, v) for w in model.uni) + model.p3("unknown word", u, v) - 1) < 1e-9
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 1.2


def test_spread_words_and_small_corpora(spark):
    for docs in ([(2, "a b")], [(1, "a")], [(1, None)], [(1, "x y x y x y x y x y x y x y x y"), (9, "x y"), (11, "x x q")]):
        model = Model(docs)
        for r in katz.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect():
            t = tokens(dict(docs)[r.doc_id])
            assert math.isclose(r.score, model.score(t), abs_tol=1e-9)
    assert katz.scores(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing_of_arrays():
    rng = np.random.default_rng(1)
    for x in (np.sort(rng.integers(0, 2**63, 1000, dtype=np.uint64)), np.zeros(0, np.uint64)):
        assert (katz.unpack(katz.pack(x, True), np.uint64, True) == x).all()
        assert (katz.unpack(katz.pack(x.astype(np.int64)), np.int64) == x.astype(np.int64)).all()
