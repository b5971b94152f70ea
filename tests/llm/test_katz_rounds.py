"""Blocks are scored in rounds, each of which writes its share of the documents."""

from __future__ import annotations

from eventlake.llm import katz


def test_blocks_are_scored_in_rounds(spark, monkeypatch):
    tables, real = [], katz.written

    def written(df):
        tables.append(real(df))
        return tables[-1]

    monkeypatch.setattr(katz, "written", written)
    docs = [(i, f"w{i % 7} w{i % 5} w{i % 3} w{i}") for i in range(120)]
    got = katz.scores(spark.createDataFrame(docs, "doc_id long, text string").repartition(12))
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    shares = [t.count() for t in tables if t.columns[0] == "doc_id"]
    assert len(shares) == katz.ROUNDS and max(shares) < len(docs)
    assert sorted(r.doc_id for r in got.collect()) == list(range(120))
