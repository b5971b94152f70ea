"""What a block holds at once, since two workers stand beside each executor's heap."""

from __future__ import annotations

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from eventlake.llm import katz


def test_a_block_holds_few_bytes_a_token(monkeypatch):
    monkeypatch.setattr(katz, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{w}" for w in (rng.pareto(0.8, 3000) * 20).astype(np.int64) % 50_000) for _ in range(100)]
    (block,) = katz._blocks(iter([pa.RecordBatch.from_pydict({"doc_id": list(range(100)), "text": texts})]))
    block = pa.Table.from_batches([block])
    (asked,) = katz._ask_words(1)(block.to_batches())
    words = katz._sum_words(pa.Table.from_batches([asked]))
    total, distinct, *of_counts = words.column("stats")[1].as_py()
    unigrams = katz.Unigrams(total, distinct, tuple(katz.discounts(of_counts)), tuple(of_counts[: katz.K]))
    words = words.slice(0, 1)
    pairs = katz._sum_pairs(unigrams)(katz._ask_pairs(1, total)(block, words))
    model = katz.Bigrams(1, unigrams, tuple(katz.discounts(pairs.column("stats")[1].as_py())), 85, {})
    known = pa.concat_tables([words, pairs.slice(0, 1)])
    trigrams = [katz._sum_trigrams(model)(katz._ask_trigrams(model, 0)(block, known))]
    discount = katz.trigram_discounts(trigrams[0].column("stats")[1].as_py())
    tokens = block.column("tokens")[0].as_py()
    for run, right in ((katz._ask_trigrams(model, 0), known), (katz._score(model, discount), pa.concat_tables([known, trigrams[0].slice(0, 1)]))):
        tracemalloc.start()
        out = run(block, right)
        peak = tracemalloc.get_traced_memory()[1] / tokens
        tracemalloc.stop()
        assert out.num_rows and peak < 95, peak
