from __future__ import annotations

import random

import pytest

from eventlake.llm import decontaminate as D


def distance_in(pattern, text):
    """Least edit distance of ``pattern`` to any part of ``text``, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern):
        last, row = row, [i + 1]
        for j, t in enumerate(text):
            row.append(min(last[j] + (p != t), last[j + 1] + 1, row[j] + 1))
    return min(row)


def edited(rng, s, n):
    s = list(s)
    for _ in range(n):
        at, what = rng.randrange(len(s)), rng.choice("ird")
        if what == "d":
            del s[at]
        elif what == "i":
            s.insert(at, rng.choice("xyz"))
        else:
            s[at] = rng.choice("xyz")
    return "".join(s)


@pytest.mark.parametrize("seed", range(30))
def test_myers_equals_the_table(seed):
    rng = random.Random(seed)
    pattern = "".join(rng.choice("abü") for _ in range(rng.randint(1, 90)))
    text = "".join(rng.choice("abü") for _ in range(rng.randint(0, 150)))
    if seed % 2 and text:
        text = text[:20] + edited(rng, pattern, 4) + text[20:]
    want = distance_in(pattern, text)
    got = D.myers(pattern, text, len(pattern))
    if want == len(pattern):
        assert got is None or got[0] == want
    else:
        assert got[0] == want
        assert D.myers(pattern, text, want - 1) is None


def test_leaks_equal_brute_force(spark):
    rng = random.Random(7)
    words = "the an er on tion ing her".split()
    prose = lambda n: " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(n))
    items = [(i, prose(rng.randint(4, 30))) for i in range(12)] + [(12, None), (13, ""), (14, "the"), (3, "a repeated id with its own words")]
    items.append((15, items[0][1].upper()))
    docs = []
    for i in range(60):
        text = prose(rng.randint(1, 60))
        for _ in range(rng.randint(0, 2)):
            item = rng.choice(items[:12])[1]
            text += " " + edited(rng, item, rng.randint(0, len(item) // 12)).replace(" ", rng.choice([" ", "\n  "])) + " " + prose(3)
        docs.append((i, text, i))
    docs += [(100, None, 0), (101, "", 0), (102, items[1][1] * 400, 0), (5, docs[5][1], 0)]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id int").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for d, text, _ in docs:
        for i, item in items:
            a, b = D.normalise(item), D.normalise(text)
            if len(a) >= D.LEAST_CHARS and b and (n := distance_in(a, b)) <= len(a) // D.CHARS_PER_EDIT:
                want.append((d, i, n))
    for block in (D.BLOCK_CHARS, 300):
        got = D.leaks(df, bench, block_chars=block, least_chars=D.LEAST_CHARS).collect()
        assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == sorted(want)
        by_id = {d: D.normalise(t) for d, t, _ in docs}
        norm = [(i, D.normalise(t)) for i, t in items]
        for r in got:
            part = by_id[r.doc_id][r.start : r.stop]
            assert any(i == r.item_id and whole_distance(t, part) == r.distance for i, t in norm)
    assert len(want) > 20


def whole_distance(a, b):
    row = list(range(len(b) + 1))
    for i, p in enumerate(a):
        last, row = row, [i + 1]
        for j, t in enumerate(b):
            row.append(min(last[j] + (p != t), last[j + 1] + 1, row[j] + 1))
    return row[-1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "x" * 50)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "x" * 50)], "item_id long, text string")
    assert D.leaks(docs, bench.limit(0)).count() == 0
    assert D.leaks(docs.limit(0), bench).count() == 0
    assert D.leaks(docs, bench).count() == 1


def test_short_items_are_found_whole_and_on_word_boundaries(spark):
    items = [(1, "2+2=4"), (2, "Why?"), (3, "你是谁"), (4, "a cat"), (5, " "), (6, None)]
    docs = [(1, "so 2+2=4."), (2, "12+2=45"), (3, "and WHY? said"), (4, "他问你是谁吗"), (5, "a  cat"), (6, "a category, a cat"), (7, "beta cat"), (8, "a cut"), (9, None)]
    got = D.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.distance) for r in got) == [(1, 1, 0), (3, 2, 0), (4, 3, 0), (5, 4, 0), (6, 4, 0)]


def test_query_searches_short_items(spark, tmp_path):
    from eventlake.llm.queries import QUERIES

    spark.createDataFrame([(1, "so 2+2=4.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "2+2=4")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.item_id) for r in QUERIES["op4_benchmark_decontamination"](spark, str(tmp_path)).collect()] == [(1, 7)]
