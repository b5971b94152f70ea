from __future__ import annotations

import numpy as np
import public_tokenizers
import pytest

from eventlake.llm import bytetext, jaccard, katz, repeats
from eventlake.llm.tokens import UnitEncoder

P = (1 << 61) - 1


def thue_morse(n, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


#: Words that any polynomial hash modulo a power of two confuses, and other regular ones.
ALIKE = [thue_morse(1024), thue_morse(1024, "ba"), thue_morse(4096), thue_morse(4096, "ba"), "ab" * 512, "ba" * 512, "a" * 1024, "a" * 1025, "\0", "\0\0"]


def raw(*texts):
    data = "".join(texts).encode()
    return np.frombuffer(data, np.uint8), np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])


def test_hash_is_the_polynomial():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 3000, dtype=np.uint8)
    start = rng.integers(0, 2000, 50)
    length = rng.integers(0, 1000, 50)
    got = bytetext.Spans(data).hashes(start, start + length)
    for s, n, h in zip(start.tolist(), length.tolist(), got, strict=True):
        value = sum((int(c) + 1) * pow(bytetext._BASE, k, P) for k, c in enumerate(data[s : s + n])) % P
        assert bytetext.mix(np.array([(value + n * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0] == h


def test_spans_longer_than_the_prefix_sums_hold(monkeypatch):
    monkeypatch.setattr(bytetext, "_LONGEST", 100)
    data, off = raw(thue_morse(512), "x", thue_morse(512), thue_morse(512, "ba"))
    h = bytetext.Spans(data).hashes(off[[0, 2, 3]], off[[1, 3, 4]])
    assert h[0] == h[1] != h[2]


def test_regular_words_have_hashes_of_their_own():
    data, off = raw(*ALIKE)
    assert len(set(bytetext.Spans(data).hashes(off[:-1], off[1:]).tolist())) == len(ALIKE)


def test_regular_words_are_different_shingles():
    data, off = raw(*ALIKE)
    sets, at = jaccard.shingle_sets(data, off, 4)
    assert len(set(jaccard.fingerprints(sets, at).tolist())) == len(ALIKE)


def test_regular_units_have_the_ids_of_their_bytes():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = UnitEncoder(path)
    texts = [w for w in ALIKE if "\0" not in w] + [" ".join(ALIKE[:8]), " ".join(ALIKE[7::-1])]
    for part in (texts, texts[::-1]):
        ids, at = encoder.encode(*raw(*part))
        for i, t in enumerate(part):
            assert ids[at[i] : at[i + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids


def test_regular_words_are_counted_apart(spark):
    docs = [(3, ALIKE[0]), (4, ALIKE[1]), (5, ALIKE[0])]  # all are trained on
    got = {r.doc_id: r for r in katz.scores(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[3].score > got[4].score  # two of one kind against one of the other


@pytest.mark.parametrize("hot", [0, 20_000])
def test_regular_strings_are_not_repeats_of_one_another(spark, hot):
    docs = [(1, thue_morse(512)), (2, thue_morse(512, "ba").replace("b", "c"))]
    got = repeats.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), hot=hot).collect()
    assert all(not r.spans for r in got)
