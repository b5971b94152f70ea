"""The pipeline's stages against plain Python, and the contracts of the queries, on the smallest tables."""

from __future__ import annotations

import glob
import os
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest
import regex

import corpus_pipeline
from eventlake.llm import decontaminate, quality
from eventlake.llm.queries import ORACLES, QUERIES
from tests.llm.test_jaccard import brute as classes_of
from tests.llm.test_quality import counts, reference_mcd

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF)))
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "pii_surrogates", "best_fit_packing"]
    assert all(s.columns == corpus_pipeline.COLUMNS for s in stages[1:5])


def test_quality_stage(stages):
    before, after = stages[0].collect(), texts(stages[1])
    floors = [f[2] for f in quality.FEATURES]
    groups = defaultdict(list)
    for r in before:
        w, chars, symbols, dup, repeats = counts(r.text)
        if w >= 10 and 100 * repeats <= 20 * w:
            lines = sum(bool(re.search(r"[^\x20\x09-\x0d]", x)) for x in r.text.split("\n"))
            capitals, marks = len(regex.findall(r"\p{Lu}", r.text)), len(re.findall(r"[.,;:!?]", r.text))
            x = [
                np.log((chars + 100) / (w + 20)), np.log(1 + 1000 * symbols / (chars + 200)), np.log(1 + 100 * dup / (lines + 20)), np.log(1 + 100 * repeats / (w + 100)),
                np.log((100 * capitals + 600) / (chars + 400)), np.log((100 * marks + 1000) / (chars + 400)), np.log((w + 40) / (lines + 2)),
            ]
            groups[r.lang, r.source].append((r.doc_id, x))
    want = set()
    for rows in groups.values():
        x = np.array([v for _, v in rows])
        m, scatter = reference_mcd(x, floors)
        # less than usual of what counts upward only is as usual
        away = np.where([f[3] for f in quality.FEATURES], np.maximum(x - m, 0), x - m)
        d2 = np.einsum("ni,ij,nj->n", away, np.linalg.inv(scatter), away)
        want |= {d for (d, _), v in zip(rows, d2, strict=True) if v <= quality.chi2_quantile(1 - quality.TAIL, x.shape[1])}
    assert set(after) == want


def test_one_document_of_each_class_stays(stages):
    before = texts(stages[1])
    found = classes_of(sorted(before.items()), 5, 80, 100)
    assert set(texts(stages[2])) == {c for _, _, c in found}


def test_no_benchmark_item_is_left(spark, stages):
    before, after = texts(stages[2]), texts(stages[3])
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for d, t in before.items():
        t = decontaminate.normalise(t)
        hit = any(i in t for i in items) or any(decontaminate.myers(i, t, len(i) // 20) for i in items)
        assert (d not in after) == hit


def test_personal_data_is_replaced_and_the_rest_stays(stages):
    before, after = texts(stages[3]), texts(stages[4])
    assert set(before) == set(after)
    marks = re.compile(r"[\w.+-]+@[\w-]+\.[\w.]+|\+\d[\d ()-]{7,}\d|\b\d{1,3}(?:\.\d{1,3}){3}\b|\b\d{13,19}\b|\b[0-9a-fA-F]{32,}\b")
    for d, t in before.items():
        old = marks.findall(t)
        assert not set(old) & set(marks.findall(after[d]))
        if not old:
            assert after[d] == t
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())


def test_every_document_is_packed(stages):
    rows = stages[5].collect()
    assert {r.doc_id for r in rows} == set(texts(stages[4]))
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))]
        assert sum(n for _, n in parts) <= 1024


CONTRACT = {
    "op1": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint"},
    "op2": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op3": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"},
    "op4": {"doc_id": "bigint", "item_id": "bigint"},
    "op5": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op6": {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    "op7": {"doc_id": "bigint", "text": "string"},
    "op8": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op9": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op10": {"slot": "bigint", "sequence_id": "bigint", "doc_ids": "array<bigint>"},
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_its_columns(spark, name):
    df = QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    want = CONTRACT[name.split("_")[0]]
    assert {k: types.get(k) for k in want} == want
    rows = df.collect()
    if name != "op4_benchmark_decontamination":
        assert rows
    if name in ORACLES:
        con = duckdb.connect()
        for f in glob.glob(f"{SF}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
        result = con.execute(ORACLES[name])
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(df.columns)
        key = lambda r: tuple(map(str, r))
        assert sorted((tuple(r[c] for c in names) for r in rows), key=key) == sorted(result.fetchall(), key=key)


def test_rows_with_repeated_and_null_ids_are_judged_each(spark):
    prose = lambda k: " ".join(f"{k}{w}{i}" for i in range(30) for w in ("stone", "river", "light"))
    rows = [(1, prose("a"), "en", "s", 1), (1, prose("a"), "en", "s", 1), (1, prose("b"), "en", "s", 1), (1, "too short", "en", "s", 1)]
    rows += [(None, prose("c"), "en", "s", 1), (None, prose("c"), "en", "s", 1), (None, prose("d"), None, None, None), (None, "too short", "en", "s", 1), (5, prose("d"), "en", "s", 1), (5, None, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    assert sorted(r.text[:6] for r in good.collect()) == sorted(t[:6] for _, t, *_ in rows if t and t != "too short")
    one = corpus_pipeline.near_duplicates(spark, good, SF).collect()
    assert sorted((r.text[:6], str(r.doc_id)) for r in one) == [("astone", "1"), ("bstone", "1"), ("cstone", "None"), ("dstone", "5")]


def test_decontamination_drops_only_the_rows_that_leak(spark, tmp_path):
    item = "what is the capital of the country that lies north of the river"
    rows = [(1, f"x {item} y", "en", "s", 1), (1, "a clean text", "en", "s", 1), (None, f"x {item} y", "en", "s", 1), (None, "a clean text", "en", "s", 1), (2, "so 2+2=4", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item), (2, "2+2=4")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontamination(spark, docs, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in left) == ["1", "None"] and {r.text for r in left} == {"a clean text"}
