"""Training-order materialisation of token sequences as fixed-stride binary shards.

Each task joins its documents' ids and cuts them into sequences of one length. Counts per task
give every sequence a global index; a keyed Feistel permutation of [0, n), by cycle-walking in
the power of four above n, turns the index into its slot in training order, without any table.
Ranges of slots are shards: slot s is at byte (s mod per_shard) * stride of shard s div per_shard,
so a reader seeks, reads forward and resumes by arithmetic alone.

A record is the sequence's ids, little-endian, and the mark ``00 0A``. Spark's text sink, whose
line feed is the end of the mark, writes the files, so they appear through the job's commit
protocol on any store, and a task that is run again leaves nothing behind.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlake.llm.bytetext import mix, slices
from eventlake.llm.scratch import written
from eventlake.llm.tokens import UnitEncoder

MARK = b"\x00\n"
#: Range partitions that write shards; beyond it each writes several.
MOST_TASKS = 20_000


class Feistel:
    """A keyed bijection of [0, n)."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.keys = [np.uint64((key * 0x9E3779B97F4A7C15 + (r + 1) * 0xD1B54A32D192ED03) % 2**64) for r in range(rounds)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half, mask = np.uint64(self.half), np.uint64((1 << self.half) - 1)
        left, right = x >> half, x & mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (mix(left + k) & mask), left
            else:
                left, right = right, left ^ (mix(right + k) & mask)
        return left << half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        away = out >= self.n
        while away.any():  # a value that left [0, n) follows its cycle until it is inside again
            out[away] = self._once(out[away], back)
            away = out >= self.n
        return out.astype(np.int64)

    def slot(self, index: np.ndarray) -> np.ndarray:
        return self._walk(index, False)

    def index(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, True)


def _checksum(sum_so_far: int, data: np.ndarray, off: np.ndarray) -> int:
    """The running checksum of a task's texts and of where they end."""
    ends = sum_so_far >> 32
    return zlib.crc32(data, sum_so_far & 0xFFFFFFFF) | zlib.crc32(np.diff(off).astype("<i8"), ends) << 32


def _outline(tokenizer: str, length: int):
    """Which documents each sequence of a task holds, from counts alone; last, as rank -1, the checksum of all its texts."""
    types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = UnitEncoder.at(tokenizer), TaskContext.get().partitionId()
        rank, size, docs, rows, checksum = 0, 0, [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "rank", "n_tokens", "doc_ids"])

        for batch in batches:
            for i, j, data, off in slices(batch.column(1)):
                checksum = _checksum(checksum, data, off)
                counts = (encoder.count(data, off) + 1).tolist()
                for doc, left in zip(batch.column(0).slice(i, j - i).to_pylist(), counts, strict=True):
                    while left:
                        part = min(left, length - size)
                        docs.append(doc)
                        size, left = size + part, left - part
                        if size == length:
                            rows.append((block, rank, size, docs))
                            rank, size, docs = rank + 1, 0, []
                if len(rows) >= 2000:
                    yield out()
                    rows.clear()
        if size:
            rows.append((block, rank, size, docs))
        if rank or size:
            rows.append((block, -1, checksum - (checksum >> 63 << 64), []))
            yield out()

    return run


def _records(tokenizer: str, length: int, end_id: int, pad_id: int, dtype: str, per_shard: int, first: dict[int, int], n_of: dict[int, tuple[int, int]], order: Feistel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block = UnitEncoder.at(tokenizer), TaskContext.get().partitionId()
        held, done, checksum = np.zeros(0, np.uint32), 0, 0

        def out(table: np.ndarray) -> pa.RecordBatch:
            slot = order.slot(first[block] + done + np.arange(len(table)))
            body = table.astype(dtype)
            return pa.RecordBatch.from_arrays([pa.array(slot // per_shard), pa.array(slot % per_shard, pa.int32()), pa.array([r.tobytes() for r in body], pa.binary())], names=["shard", "place", "ids"])

        for batch in batches:
            for _, _, data, off in slices(batch.column(1)):
                checksum = _checksum(checksum, data, off)
                ids, at = encoder.encode(data, off)
                held = np.concatenate([held, np.insert(ids, at[1:], np.uint32(end_id))])
                whole = len(held) // length
                if whole:
                    yield out(held[: whole * length].reshape(-1, length))
                    held, done = held[whole * length :], done + whole
        if len(held):
            yield out(np.concatenate([held, np.full(length - len(held), pad_id, np.uint32)]).reshape(1, -1))
            done += 1
        if (done, checksum - (checksum >> 63 << 64)) != n_of.get(block, (0, 0)):
            raise RuntimeError(f"task {block} read other texts than before, or in another order: the documents must be a stable scan")

    return run


def materialise(
    docs: DataFrame, path: str, tokenizer: str, length: int = 1024, per_shard: int = 4096, end_id: int = 2, pad_id: int = 50256,
    key: int = 42, dtype: str = "<u2", id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Writes the shards below ``path/shard=N`` and returns their index.

    The index has a row per sequence: sequence_id (the place before the permutation), slot, shard,
    byte_offset, n_tokens (without padding) and doc_ids, the documents whose ids it holds in order.
    Every document ends in ``end_id``; the last sequence of each task is padded. A null or empty
    text is the end id alone; repeated rows are repeated; an empty table writes nothing. Other
    columns are not read. The documents are read twice and must come in the same order, as a scan
    of files does; a task whose second reading has other counts or another checksum of its texts fails.
    """
    if np.iinfo(np.dtype(dtype)).max < pad_id:
        raise ValueError(f"{dtype} cannot hold the id {pad_id}")
    slim = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    outline = written(slim.mapInArrow(_outline(tokenizer, length), "block int, rank long, n_tokens long, doc_ids array<long>"))
    mark = F.col("rank") < 0
    tasks_of = outline.groupBy("block").agg(F.count_if(~mark).alias("n"), F.max(F.when(mark, F.col("n_tokens"))).alias("checksum"))
    n_of = {r["block"]: (r["n"], r["checksum"]) for r in tasks_of.collect()}  # two numbers per task
    first, total = {}, 0
    for block in sorted(n_of):
        first[block], total = total, total + n_of[block][0]
    order = Feistel(max(total, 1), key)
    records = slim.mapInArrow(_records(tokenizer, length, end_id, pad_id, dtype, per_shard, first, n_of, order), "shard long, place int, ids binary")
    shards = max(1, -(-total // per_shard))
    tasks = min(shards, MOST_TASKS)
    ranges = records.repartitionById(tasks, F.expr(f"shard * {tasks} div {shards}").cast("int")).sortWithinPartitions("shard", "place")
    line = F.concat("ids", F.lit(MARK[:-1])).cast("string").alias("value")
    ranges.select("shard", line).write.partitionBy("shard").option("compression", "none").text(path)

    stride = length * np.dtype(dtype).itemsize + len(MARK)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = np.array([first[b] for b in batch.column("block").to_pylist()], np.int64)
            sequence = start + batch.column("rank").to_numpy()
            slot = order.slot(sequence)
            columns = [pa.array(sequence), pa.array(slot), pa.array(slot // per_shard), pa.array(slot % per_shard * stride), batch.column("n_tokens").cast(pa.int32()), batch.column("doc_ids")]
            yield pa.RecordBatch.from_arrays(columns, names=["sequence_id", "slot", "shard", "byte_offset", "n_tokens", "doc_ids"])

    return outline.filter("rank >= 0").mapInArrow(placed, "sequence_id long, slot long, shard long, byte_offset long, n_tokens int, doc_ids array<long>")


def _table(name: str, content: pa.Scalar, stride: int) -> np.ndarray:
    """The records of a shard as rows of bytes, without their marks."""
    body = np.frombuffer(content.as_buffer(), np.uint8)
    if len(body) % stride:
        raise ValueError(f"{name} is cut off")
    table = body.reshape(-1, stride)
    if (table[:, -2:] != np.frombuffer(MARK, np.uint8)).any():
        raise ValueError(f"{name} has a record without its mark")
    return np.ascontiguousarray(table[:, : -len(MARK)])


def _shard_of(name: str) -> int:
    return int(name.rsplit("shard=", 1)[1].split("/", 1)[0])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0")


def read_shards(spark: SparkSession, path: str, length: int = 1024, per_shard: int = 4096, dtype: str = "<u2") -> DataFrame:
    """(slot, shard, byte_offset, ids_crc32) of every record found in the shards below ``path``.

    The checksum is of the ids as little-endian unsigned 32-bit numbers, padding included. A file
    that is no whole number of records, or a record without its mark, fails the reading.
    """
    stride = length * np.dtype(dtype).itemsize + len(MARK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                ids, shard = _table(name, content, stride).view(dtype).astype("<u4"), _shard_of(name)
                place = np.arange(len(ids))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(shard * per_shard + place), pa.array(np.full(len(ids), shard)), pa.array(place * stride), pa.array([zlib.crc32(r) for r in ids], pa.int64())],
                    names=["slot", "shard", "byte_offset", "ids_crc32"],
                )

    return _files(spark, path).select("path", "content").mapInArrow(run, "slot long, shard long, byte_offset long, ids_crc32 long")


def read_from(spark: SparkSession, path: str, slot: int = 0, until: int | None = None, length: int = 1024, per_shard: int = 4096, dtype: str = "<u2") -> DataFrame:
    """(slot, ids) of the sequences in slots ``slot`` to ``until`` - 1, or to the last: what a run that stopped at ``slot`` resumes with.

    Files of shards outside that range are not opened. Rows come in the order of slots within a file.
    """
    stride = length * np.dtype(dtype).itemsize + len(MARK)
    end = until if until is not None else 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                base = _shard_of(name) * per_shard
                ids = _table(name, content, stride).view(dtype)[max(slot - base, 0) : max(end - base, 0)].astype(np.int32)
                offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * length)
                yield pa.RecordBatch.from_arrays([pa.array(max(base, slot) + np.arange(len(ids))), pa.ListArray.from_arrays(offsets, pa.array(ids.ravel()))], names=["slot", "ids"])

    shard = F.regexp_extract("path", "shard=([0-9]+)", 1).cast("long")
    wanted = _files(spark, path).filter((shard >= slot // per_shard) & (shard * per_shard < end))
    return wanted.select("path", "content").mapInArrow(run, "slot long, ids array<int>")
