from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from eventlake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def content(bins):
    return Counter({k: sum(dict(b).get(k, 0) * n for b, n in bins.items()) for b in bins for k in dict(b)})


@pytest.mark.parametrize("seed", range(12))
def test_plan_keeps_every_piece_and_never_overfills(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 1024])
    histogram = {rng.randint(1, capacity): rng.randint(1, 50) for _ in range(rng.randint(1, 60))}
    first = packing.best_fit(histogram, capacity)
    better = packing.improve(first, capacity)
    for bins in (first, better):
        assert +content(bins) == +Counter(histogram)
        assert all(packing._fill(b) <= capacity for b in bins)
    assert sum(better.values()) <= sum(first.values())
    assert sum(better.values()) >= -(-sum(k * n for k, n in histogram.items()) // capacity)
    plan = packing.Plan(better)
    used = defaultdict(list)
    for length, n in histogram.items():
        seq, off = plan.place(np.full(n, length), np.arange(n))
        for s, o in zip(seq.tolist(), off.tolist(), strict=True):
            used[s].append((o, length))
    assert len(used) == plan.bins
    for parts in used.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= capacity


def test_local_search_empties_a_bin():
    # best fit in falling order needs three bins of 10 for sums that fit in two
    bins = Counter({((6, 1), (2, 1)): 1, ((5, 1), (3, 1)): 1, ((2, 2),): 1})
    assert sum(packing.improve(bins, 10).values()) == 2
    many = Counter({((6, 1), (2, 1)): 1000, ((5, 1), (3, 1)): 1000, ((2, 2),): 1000})
    assert sum(packing.improve(many, 10).values()) == 2000


def test_pack_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = ["", None, "one", "two  words\n", "a <|endoftext|> b", "x" * 9000, "wide　\n\nspace", "long text " * 3000, "same", "same", " \t\n"]
    rows = [(i, t, i, "z", 5) for i, t in enumerate(texts)] + [(3, "two  words\n", 1, "z", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, piece int, block string, length int").repartition(3)
    got = packing.pack(docs, PATH, capacity=1024).collect()
    reference = Tokenizer.from_file(PATH)
    by_doc = defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
    for i, text in enumerate(texts):
        ids = np.array([*reference.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(by_doc[i], key=lambda r: (r.piece, r.sequence_id))[:: 2 if i == 3 else 1]
        assert sum(r.length for r in own) == len(ids)
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length]) for r in own)
        assert all(r.length == 1024 for r in own[1:])
    assert len(by_doc[3]) == 2
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024
    assert len(bins) == -(-sum(r.length for r in got) // 1024)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(docs, PATH).count() == 0


def test_local_search_ends_only_when_nothing_helps():
    # many donors that nothing takes from come before those that exchange
    rng = random.Random(1)
    bins = Counter({((a, 1),): 1 for a in range(600, 800)})
    for _ in range(70):
        x, y = sorted((rng.randint(470, 495), rng.randint(470, 495)), reverse=True)
        bins[((x, 1), (y, 1)) if x != y else ((x, 2),)] += 1
    better = packing.improve(bins, 1000)
    types = sorted((b for b in better if packing._fill(b) < 1000), key=lambda b: (packing._fill(b), b))
    assert not any(packing._exchange(d, t, 1000) for i, d in enumerate(types) for t in [*types[i + 1 :], *([d] if better[d] > 1 else [])])


def optimum(pieces, capacity):
    """The least number of bins, by trying every assignment."""
    best = len(pieces)

    def put(i, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if i == len(pieces):
            best = len(fills)
            return
        for f in set(fills):
            if f + pieces[i] <= capacity:
                rest = list(fills)
                rest.remove(f)
                put(i + 1, [*rest, f + pieces[i]])
        put(i + 1, [*fills, pieces[i]])

    put(0, [])
    return best


def test_against_the_optimum_of_small_inputs():
    rng, met = random.Random(2), 0
    for _ in range(150):
        capacity = rng.choice([20, 100])
        pieces = sorted((rng.randint(1, capacity * 2 // 3) for _ in range(rng.randint(3, 9))), reverse=True)
        first = packing.best_fit(Counter(pieces), capacity)
        better = sum(packing.improve(first, capacity).values())
        assert optimum(pieces, capacity) <= better <= sum(first.values())
        met += better == optimum(pieces, capacity)
    assert met >= 145


def test_the_search_empties_bins_that_best_fit_leaves():
    # triples that fill bins exactly: best fit in falling order misses many of them
    rng, histogram = random.Random(4), Counter()
    for _ in range(400):
        a, b = rng.randint(260, 480), rng.randint(260, 480)
        histogram.update([a, b, 1000 - a - b] if 1000 - a - b > 0 else [a, b])
    first = packing.best_fit(histogram, 1000)
    better = packing.improve(first, 1000)
    assert +content(better) == +histogram
    assert sum(better.values()) < sum(first.values())


def test_two_of_the_donor_go_for_one_and_the_emptier_bin_can_become_the_fuller():
    assert packing._exchange(((5, 1), (4, 1)), ((8, 1), (1, 1)), 10) == ((5, 4), (8,))
    assert packing._exchange(((9, 1),), ((1, 1),), 10) is not None
