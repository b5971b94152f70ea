from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from eventlake.llm import scratch, trainorder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 17, 64, 1000, 4097])
def test_feistel_is_a_bijection(n):
    f = trainorder.Feistel(n, 7)
    slots = f.slot(np.arange(n))
    assert sorted(slots.tolist()) == list(range(n))
    assert f.index(slots).tolist() == list(range(n))
    if n == 1000:
        assert slots.tolist() != trainorder.Feistel(n, 8).slot(np.arange(n)).tolist()
        assert abs(np.corrcoef(np.arange(n), slots)[0, 1]) < 0.15


def test_round_trip(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(PATH)
    rng = random.Random(5)
    texts = [None, "", "one", "x y " * 700, "same", "same", "ü\n\n z"] + [" ".join(rng.choices("alpha beta gamma delta 12".split(), k=rng.randint(1, 90))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, i, 1) for i, t in enumerate(texts)], "doc_id long, text string, slot int, shard int").repartition(3).cache()
    length, per_shard = 64, 8
    path = scratch.shared_dir(spark) + "/s"
    index = trainorder.materialise(docs, path, PATH, length=length, per_shard=per_shard, key=9).collect()
    found = {r.slot: r for r in trainorder.read_shards(spark, path, length, per_shard).collect()}
    n = len(index)
    assert sorted(found) == sorted(r.slot for r in index) == list(range(n))
    assert sorted(r.sequence_id for r in index) == list(range(n))
    stride = 2 * length + 2
    bodies = {}
    for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).collect():
        bodies[int(r.path.rsplit("shard=", 1)[1].split("/")[0])] = bytes(r.content)
    stream, previous = {}, None
    for r in sorted(index, key=lambda r: r.sequence_id):
        assert (r.shard, r.byte_offset) == (r.slot // per_shard, r.slot % per_shard * stride)
        ids = np.frombuffer(bodies[r.shard][r.byte_offset : r.byte_offset + stride - 2], "<u2")
        assert zlib.crc32(ids.astype("<u4")) == found[r.slot].ids_crc32
        assert (ids[r.n_tokens :] == 50256).all()
        docs_here = list(r.doc_ids)
        at = 0
        for token in ids[: r.n_tokens].tolist():
            stream.setdefault(docs_here[at], []).append(token)
            at += token == 2 and at < len(docs_here) - 1
        previous = r
    assert previous is not None
    for i, t in enumerate(texts):
        assert stream[i] == [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_empty_and_bad_files(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    path = scratch.shared_dir(spark) + "/s"
    assert trainorder.materialise(docs, path, PATH).count() == 0
    assert trainorder.read_shards(spark, path).count() == 0
    (tmp_path / "shard=0").mkdir()
    (tmp_path / "shard=0" / "part").write_bytes(b"x" * 130 + b"y")
    with pytest.raises(Exception, match="cut off"):
        trainorder.read_shards(spark, f"file://{tmp_path}", 64, 8).collect()
    with pytest.raises(ValueError, match="cannot hold"):
        trainorder.materialise(docs, path, PATH, pad_id=70_000)


def test_reading_from_a_slot(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 9 + 1)) for i in range(120)], "doc_id long, text string").repartition(2).cache()
    path = scratch.shared_dir(spark) + "/s"
    n = trainorder.materialise(docs, path, PATH, length=16, per_shard=8).count()
    everything = {r.slot: r.ids for r in trainorder.read_from(spark, path, length=16, per_shard=8).collect()}
    assert sorted(everything) == list(range(n)) and all(len(ids) == 16 for ids in everything.values())
    crc = {r.slot: r.ids_crc32 for r in trainorder.read_shards(spark, path, 16, 8).collect()}
    assert all(zlib.crc32(np.array(ids, "<u4")) == crc[s] for s, ids in everything.items())
    for slot, until in ((0, 5), (3, None), (8, 16), (13, 30), (n - 1, None), (n, None)):
        got = {r.slot: r.ids for r in trainorder.read_from(spark, path, slot, until, 16, 8).collect()}
        assert got == {s: ids for s, ids in everything.items() if slot <= s < (n if until is None else until)}


def test_another_order_of_as_many_tokens_fails(spark, tmp_path, monkeypatch):
    path, real = f"file://{tmp_path}/docs", trainorder.written
    texts = ["one two three", "four five six", "one two three"]

    def swapped(df):
        out = real(df)
        spark.createDataFrame([(i, t) for i, t in enumerate(texts[1:] + texts[:1])], "doc_id long, text string").coalesce(1).write.mode("overwrite").parquet(path)
        spark.catalog.refreshByPath(path)
        return out

    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    monkeypatch.setattr(trainorder, "written", swapped)
    with pytest.raises(Exception, match="in another order|does not exist|FileNotFound"):
        trainorder.materialise(spark.read.parquet(path), scratch.shared_dir(spark) + "/s", PATH, length=8)
    # the checksum itself tells the order
    off = np.cumsum([0, 13, 13])
    a, b = (np.frombuffer("".join(t).encode(), np.uint8) for t in (texts[:2], texts[1::-1]))
    assert trainorder._checksum(0, a, off) != trainorder._checksum(0, b, off)
    half = trainorder._checksum(trainorder._checksum(0, a[:13], off[:2]), a[13:], off[:2])
    assert half == trainorder._checksum(0, a, off)
