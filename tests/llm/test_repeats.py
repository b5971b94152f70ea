from __future__ import annotations

import os
import random
from collections import Counter

import numpy as np
import pytest

from eventlake.llm import repeats


def brute(texts, length):
    """Covered bytes of each text, from all strings of ``length`` bytes."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + length] for b in raw for i in range(len(b) - length + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((b, gone))
    return out


def runs(gone):
    out, start = [], None
    for i, g in enumerate([*gone, 0]):
        if g and start is None:
            start = i
        elif not g and start is not None:
            out.append((start, i))
            start = None
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    prose = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    passage = prose(length + length // 2)
    texts = [None, "", "short", "a" * (length - 1), "a" * length, "b" * (length + 1), "b" * (3 * length), "ab" * length, passage, passage]
    for _ in range(30):
        texts.append(prose(rng.randint(0, 2 * length)) + passage[rng.randint(0, 40) : len(passage) - rng.randint(0, 60)] + prose(rng.randint(0, length)))
    base = prose(5 * length)
    for _ in range(12):
        copy = list(base)
        for _ in range(rng.randint(0, 6)):
            copy[rng.randrange(len(copy))] = "X"
        texts.append("".join(copy)[rng.randint(0, 30) :])
    texts += [prose(rng.randint(1, 4 * length)) for _ in range(10)] + [texts[-1], "\0" * (length + 5), base[:length] + "\0" * 3, base[:length]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("length", "window", "hot", "seed", "report"), [(400, 128, 20_000, 1, 256), (60, 32, 20_000, 2, 45), (60, 32, 5, 3, 48), (40, 16, 0, 4, 30), (40, 16, 3, 5, 90)])
def test_removal_equals_brute_force(spark, monkeypatch, length, window, hot, seed, report):
    monkeypatch.setattr(repeats, "PART_BYTES", 6000)
    texts = corpus(seed, length)
    rows = [(i % 70, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int").repartition(4)
    got = repeats.remove_repeats(df, length, window, hot, report=report).collect()
    shorter = [sum(g) for _, g in brute(texts, min(report, length))]
    want = sorted((i % 70, len(b), runs(g), bytes(x for x, y in zip(b, g, strict=True) if not y), shorter[i]) for i, (b, g) in enumerate(brute(texts, length)))
    assert sorted((r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept), r.n_repeated) for r in got) == want
    assert report >= length or sum(shorter) > sum(s[1] - s[0] for w in want for s in w[2])
    assert sum(len(w[2]) for w in want) > 20


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", range(10))
def test_merge_equals_sorting(seed, monkeypatch):
    rng = random.Random(seed)
    n = rng.randint(1, 40)
    pool = [bytes(rng.choice(b"ab") for _ in range(n)) for _ in range(30)]
    pieces = [sorted(rng.choices(pool, k=rng.randint(0, 20))) for _ in range(rng.randint(1, 9))]
    common = lambda a, b: len(os.path.commonprefix([a, b]))
    given = [(p, [0, *(common(a, b) for a, b in zip(p, p[1:], strict=False))][: len(p)]) for p in pieces]
    read = Counter()
    real = repeats._first_unlike

    def counted(a, b, at):
        out = real(a, b, at)
        read["bytes"] += out - at + 1
        return out

    monkeypatch.setattr(repeats, "_first_unlike", counted)
    order, shared = repeats.merge(given)
    strings = [pieces[r][i] for r, i in order]
    assert strings == sorted(x for p in pieces for x in p)
    assert shared == [0, *(common(a, b) for a, b in zip(strings, strings[1:], strict=False))][: len(strings)]
    total = sum(map(len, pieces))
    # every read byte lengthens a known prefix: a string's prefix grows to n at most
    assert read["bytes"] <= total * (n + max(1, len(pieces)).bit_length() + 1)


def test_anchors_are_the_same_in_equal_strings():
    rng = np.random.default_rng(1)
    shape = repeats.Shape(100, 32)
    a = rng.integers(97, 100, 3000, dtype=np.uint8)
    b = np.concatenate([rng.integers(97, 100, 57, dtype=np.uint8), a[500:900], rng.integers(97, 100, 40, dtype=np.uint8)])
    at_a = repeats.anchors(a, np.array([0, len(a)]), shape)
    at_b = repeats.anchors(b, np.array([0, len(b)]), shape)
    assert set(at_b - 57 + 500) >= {x for x in at_a if 500 + 31 <= x <= 800}
