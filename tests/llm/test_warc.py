from __future__ import annotations

import hashlib

import numpy as np
import pytest

from eventlake.llm import scratch, warc


def test_reachable_follows_only_the_chain():
    start = np.array([0, 10, 25, 40, 55])
    following = np.array([25, 30, 40, 70, 70])
    assert warc.reachable(start, following).tolist() == [True, False, True, True, False]
    assert warc.reachable(np.array([5]), np.array([9])).tolist() == [False]
    assert warc.reachable(np.array([], np.int64), np.array([], np.int64)).tolist() == []


def test_long_chain():
    start = np.arange(0, 5000, 5)
    rng = np.random.default_rng(1).permutation(len(start))
    assert warc.reachable(start[rng], start[rng] + 5).all()


def test_round_trip_with_forged_magic(spark):
    forged = "x" * 120 + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\ntail"
    same = "y" * 100
    rows = [
        (1, "http://a/", forged, 7), (2, None, None, 8), (3, "http://b/\r\nX: y", "", 9), (4, "u", same, 1),
        (9, "u", same, 1), (5, "u", "y" * 99, 1), (6, "u", "y" * 99, 1), (7, "é", "ü€" * 500_000, 1), (8, "u", same, 2),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type int").repartition(3)
    path = scratch.shared_dir(spark) + "/w"
    warc.write_archives(pages, path, file_bytes=2 * warc.CLASS_BYTES)
    found = warc.reached(spark, path).collect()
    assert sum(r.records for r in found) == 9 and sum(r.rejected for r in found) == 1
    assert all(r.reached == r.bytes and r.records <= 2 for r in found)
    got = {r.record_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == 9
    for i, _, html, _ in rows:
        r = got[f"<urn:page:{i}>"]
        body = (html or "").encode()
        assert r.declared_digest == "sha256:" + hashlib.sha256(body).hexdigest()
        assert r.declared_length == len(body)
        if i in (8, 9):
            assert (r.record_type, r.refers_to, r.payload_length) == ("revisit", "<urn:page:4>", 0)
        else:
            assert (r.record_type, r.refers_to, r.payload_length) == ("response", "", len(body))
            assert r.payload_digest == hashlib.sha256(body).hexdigest()
    assert got["<urn:page:3>"].target_uri == "http://b/  X: y"


@pytest.mark.parametrize("broadcast_rows", [0, 10])
def test_empty_and_repeated_rows(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast_rows)
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch.shared_dir(spark) + "/w"
    warc.write_archives(empty, path)
    assert warc.read_archives(spark, path).count() == 0
    twice = spark.createDataFrame([(1, "u", "z" * 200)] * 2 + [(2, "u", "z" * 200)], "page_id long, url string, html string")
    path = scratch.shared_dir(spark) + "/w"
    warc.write_archives(twice, path)
    got = warc.read_archives(spark, path).collect()
    assert sorted((r.record_id, r.record_type) for r in got) == [("<urn:page:1>", "response")] * 2 + [("<urn:page:2>", "revisit")]


def test_damaged_file_keeps_what_precedes_the_damage(spark, tmp_path):
    path = scratch.shared_dir(spark) + "/w"
    rows = spark.createDataFrame([(i, "u", f"page {i}") for i in range(5)], "page_id long, url string, html string")
    warc.write_archives(rows.coalesce(1), path)
    (content,) = [r.content for r in spark.read.format("binaryFile").load(path).collect() if r.length]
    whole = bytes(content)
    cut = tmp_path / "cut.warc"
    cut.write_bytes(whole[: len(whole) - 9])
    assert warc.read_archives(spark, f"file://{cut}").count() == 4
    r = warc.reached(spark, f"file://{cut}").first()
    assert r.records == 4 and 0 < r.reached < r.bytes == len(whole) - 9
    late = tmp_path / "late.warc"
    late.write_bytes(b"?" + whole)
    assert warc.read_archives(spark, f"file://{late}").count() == 0


def test_a_payload_full_of_forged_records_is_read_once(spark, monkeypatch):
    head = b"WARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    body = head * 3000
    data = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    hashed = []
    real = warc.hashlib.sha256
    monkeypatch.setattr(warc.hashlib, "sha256", lambda b: hashed.append(len(b)) or real(b))
    start, following = warc.links(data)
    chain = start[warc.reachable(start, following)].tolist()
    assert len(start) == 3001 and chain == [0]
    assert [warc.parse_record(data, at)["next"] for at in chain] == [len(data)] and len(hashed) == 1


def test_large_payloads_get_files_of_their_own(spark):
    rows = [(i, "u", chr(97 + i) * n) for i, n in enumerate([10, 40_000, 200_000, 3_000_000, 10, 200_000])]
    path = scratch.shared_dir(spark) + "/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, file_bytes=600_000)
    found = warc.reached(spark, path).collect()
    assert sum(r.records for r in found) == 6 and all(r.bytes < 610_000 or r.records == 1 for r in found)
    assert sorted(r.payload_length for r in warc.read_archives(spark, path).collect()) == [10, 10, 40_000, 200_000, 200_000, 3_000_000]
