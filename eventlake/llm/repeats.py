"""Removal of byte strings that occur more than once, by a distributed sort of suffixes.

A string of ``LENGTH`` bytes that starts anywhere else, in any text, is removed. Sorting every
suffix of a corpus would move hundreds of times its size. What decides is moved instead:

1. Anchors. Of the ``WINDOW`` positions at which a string of LENGTH bytes begins, the one with
   the least hash of its next eight bytes is its anchor, so equal strings have their anchor at
   the same distance, and about one position in 65 is an anchor. LENGTH - WINDOW + 1 bytes behind
   an anchor belong to every string it stands for; texts are held in blocks, and blocks exchange
   the hashes of those bytes. Suffixes whose hash no other suffix has are out.
2. Runs. The suffixes that remain are cut behind LENGTH bytes, sorted in their block, dealt by
   that hash, front-coded (each with the length of the prefix it shares with its predecessor and
   the rest alone) and exchanged. What precedes the anchor travels along.
3. Merge. A loser tree combines the runs of a part. Its matches compare shared-prefix lengths
   first and read bytes only from there on, so no known prefix is read again; it yields the
   suffixes in order with the prefix that neighbours share. Strings around an anchor are equal
   if their suffixes share enough and what precedes the anchors does; both are ranges of a sorted
   order, so the distances at which a string occurs again are found by counting pairs of ranges.
4. Cover. Each anchor returns the first and last string around it that occurs again; blocks cover
   their texts with them.

An anchor whose suffix begins more than ``HOT`` different contexts (a passage in a large share of
all texts) is not merged in one part. Its strings are hashed one by one and exchanged by their
own hashes, which spreads them evenly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.bytetext import Spans, distinct_of, mix, slices
from eventlake.llm.katz import _join, _split, pack, part_of, unpack
from eventlake.llm.scratch import release, written

LENGTH = 400
#: Bytes of the shorter strings that are counted, not removed: passages of some fifty words.
REPORT = 256
WINDOW = 128
HOT = 20_000
BLOCK_BYTES = 8 << 20
#: Bytes of text for each part of the hash space.
PART_BYTES = 8 << 20
_NONE = 255


class Shape:
    """The lengths that belong together."""

    def __init__(self, length: int = LENGTH, window: int = WINDOW, report: int = REPORT):
        report = min(length, report)
        if window & (window - 1) or not 8 <= window <= 128 or report < window + 8:
            raise ValueError("the window must be a power of two from 8 to 128, and both lengths greater by 8 at least")
        self.length, self.window, self.report, self.sure = length, window, report, report - window + 1
        #: The lengths of strings that are looked for.
        self.lengths = (length, report) if report < length else (length,)


# --- blocks ---------------------------------------------------------------------------------

BLOCK = "block long, size long, ids array<long>, lengths array<long>, body binary"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base, n, size = TaskContext.get().partitionId() << 32, 0, 0
    bodies, ids, lengths = [], [], []

    def out() -> pa.RecordBatch:
        nonlocal n, size
        row = [base + n, size, list(ids), list(lengths), zstandard.ZstdCompressor(level=3).compress(b"".join(bodies))]
        n, size = n + 1, 0
        for x in (bodies, ids, lengths):
            x.clear()
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

    for batch in batches:
        for i, j, data, off in slices(batch.column(1)):
            bodies.append(data.tobytes())
            ids += batch.column(0).slice(i, j - i).to_pylist()
            lengths += np.diff(off).tolist()
            size += len(data)
            if size >= BLOCK_BYTES:
                yield out()
    if ids:
        yield out()


def _opened(row: dict) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["body"]), np.uint8)
    return data, np.concatenate([[0], np.cumsum(np.array(row["lengths"], np.int64))])


# --- anchors --------------------------------------------------------------------------------


def anchors(data: np.ndarray, off: np.ndarray, shape: Shape) -> np.ndarray:
    """The anchors of all strings of ``shape.report`` bytes in texts that lie one after another.

    Longer strings have theirs among them.
    """
    n = len(data)
    if n < shape.report:
        return np.zeros(0, np.int64)
    out, step = [], 1 << 20
    for first in range(0, n - shape.report + 1, step):
        stop = min(first + step, n - shape.report + 1)  # strings that start in first..stop-1
        part = data[first : stop + shape.window + 7]
        grams = np.zeros(len(part) - 7, np.uint64)
        for k in range(8):
            grams |= part[k : k + len(grams)].astype(np.uint64) << np.uint64(8 * k)
        least = mix(grams) & np.uint64(0xFFFFFFFF00000000) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width < shape.window:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        out.append((least[: stop - first] & np.uint64(0xFFFFFFFF)).astype(np.int64) + first)
    found = np.concatenate(out)
    valid = np.zeros(n + 1, np.int32)  # +1 where a text's strings begin, -1 behind their last
    long = np.diff(off) >= shape.report
    np.add.at(valid, off[:-1][long], 1)
    np.add.at(valid, off[1:][long] - shape.report + 1, -1)
    found = found[np.cumsum(valid[: len(found)]) > 0]
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def _matrix(data: np.ndarray, start: np.ndarray, width: np.ndarray, most: int, back: bool) -> np.ndarray:
    """Rows of ``width`` bytes from ``start`` on, or before it in reverse; zeros behind them."""
    column = np.arange(most)
    at = start[:, None] - 1 - column if back else start[:, None] + column
    return np.where(column < width[:, None], data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)


def _hashes(data: np.ndarray, start: np.ndarray, stop: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Hashes of spans that are short beside ``step``; prefix sums are held for one step at a time."""
    out = np.empty(len(start), np.uint64)
    chunk = start // step
    for c in np.unique(chunk):
        own = np.flatnonzero(chunk == c)
        first, last = int(start[own].min()), int(stop[own].max())
        out[own] = Spans(data[first:last]).hashes(start[own] - first, stop[own] - first)
    return out


class Anchored:
    """The anchors of a block, their hashes and how far their text reaches on both sides."""

    def __init__(self, data: np.ndarray, off: np.ndarray, shape: Shape):
        self.data, self.shape = data, shape
        self.at = anchors(data, off, shape)
        text = np.searchsorted(off, self.at, "right") - 1
        self.left = np.minimum(self.at - off[text], shape.window - 1)
        self.right = np.minimum(off[text + 1] - self.at, shape.length)
        self.hash = _hashes(data, self.at, self.at + shape.sure)
        self.context = mix(_hashes(data, self.at - self.left, self.at + self.right) + self.left.astype(np.uint64))


ASKED = "part int, block long, body binary"
_ASKED_TYPES = [pa.int32(), pa.int64(), pa.binary()]


def _asked(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _ASKED_TYPES, strict=True)], names=["part", "block", "body"])


def _counts_by_part(hashes: np.ndarray, counts: np.ndarray, block: int, parts: int) -> list[tuple]:
    cuts = np.searchsorted(part_of(hashes, parts), np.arange(parts + 1))
    return [
        (int(p), block, _join([pack(hashes[cuts[p] : cuts[p + 1]], True), pack(counts[cuts[p] : cuts[p + 1]].astype(np.uint32))]))
        for p in np.flatnonzero(np.diff(cuts))
    ]


def _ask_anchors(shape: Shape, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found = Anchored(*_opened(row), shape)
                distinct, _, place = distinct_of(found.hash)
                contexts, first, _ = distinct_of(found.context)
                # an even number: different contexts; an odd one: at least two of a context
                different = np.bincount(place[first], minlength=len(distinct))
                several = np.bincount(place, minlength=len(distinct)) > different
                yield from _asked(_counts_by_part(distinct, 2 * different + several, row["block"], parts)).to_batches()

    return run


def _sum_asked(table: pa.Table) -> pa.Table:
    """Answers every count with the sum over all blocks."""
    rows = [(r["block"], *_split(r["body"])) for r in table.to_pylist()]
    asked = [unpack(h, np.uint64, True) for _, h, _ in rows]
    distinct, _, place = distinct_of(np.concatenate(asked))
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, np.concatenate([unpack(c, np.uint32) for _, _, c in rows]).astype(np.int64))
    part, out, at = table.column("part")[0].as_py(), [], 0
    total = np.minimum(total, 2**32 - 1).astype(np.uint32)
    for (block, _, _), own in zip(rows, asked, strict=True):
        out.append((part, block, pack(total[place[at : at + len(own)]])))
        at += len(own)
    return _asked(out)


def _answers(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint32), *(unpack(r["body"], np.uint32) for r in sorted(table.to_pylist(), key=lambda r: r["part"]))])


def _state(found: Anchored, answers: np.ndarray, hot: int) -> np.ndarray:
    """0 for anchors that are alone, 1 for those to merge, 2 for hot ones."""
    _, _, place = distinct_of(found.hash)
    total = answers[place] if len(answers) else np.zeros(len(found.at), np.uint32)
    return np.where(total // 2 > hot, 2, (total > 2).astype(np.int64))


# --- runs -----------------------------------------------------------------------------------


def _shared(matrix: np.ndarray) -> np.ndarray:
    """The length of the prefix that each row shares with the row before it; 0 for the first."""
    if len(matrix) < 2:
        return np.zeros(len(matrix), np.int64)
    unlike = matrix[1:] != matrix[:-1]
    some = unlike.any(1)
    return np.concatenate([[0], np.where(some, unlike.argmax(1), matrix.shape[1])])


def _runs(found: Anchored, chosen: np.ndarray, block: int, parts: int) -> list[tuple]:
    """The front-coded sorted runs of the chosen anchors, one for each part."""
    if not len(chosen):
        return []
    shape, out = found.shape, []
    part = part_of(found.hash[chosen], parts)
    for p in np.unique(part):
        own = chosen[part == p]
        _, first, which = distinct_of(found.context[own])
        copies = np.bincount(which)
        rep = own[first]
        right = _matrix(found.data, found.at[rep], found.right[rep], shape.length, False)
        order = np.argsort(right.view(f"S{shape.length}").ravel(), kind="stable")
        right, rep, copies = right[order], rep[order], copies[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        shared = _shared(right)
        rest = right[np.arange(shape.length) >= shared[:, None]]
        left = _matrix(found.data, found.at[rep], found.left[rep], shape.window - 1, True)
        squeeze = zstandard.ZstdCompressor(level=3).compress
        body = [pack(shared.astype(np.uint16)), squeeze(rest.tobytes()), squeeze(left.tobytes()), pack(found.left[rep].astype(np.uint8)), pack(found.right[rep].astype(np.uint16)),
                pack((copies > 1).astype(np.uint8)), pack(found.at[own].astype(np.uint64), True), pack(rank[which].astype(np.uint32))]
        out.append((int(p), block, _join(body)))
    return out


def _cut(shape: Shape, parts: int, hot: int):
    """Runs for the merge (kind 0) and hashes of the strings around hot anchors (kind 1)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, rows = [], []
        for row in left.to_pylist():
            found = Anchored(*_opened(row), shape)
            state = _state(found, _answers(right), hot)
            own = _runs(found, np.flatnonzero(state == 1), row["block"], parts)
            if (state == 2).any():
                distinct, _, place = distinct_of(_strings_once(found, np.flatnonzero(state == 2))[2])
                strings = _counts_by_part(distinct, np.minimum(np.bincount(place), 2), row["block"], parts)
            else:
                strings = []
            rows += own + strings
            kinds += [0] * len(own) + [1] * len(strings)
        return _asked(rows).append_column("kind", pa.array(kinds, pa.int32()))

    return run


def _strings_once(found: Anchored, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, hash) of the strings of each length around hot anchors; a string is listed once."""
    shape, out = found.shape, []
    distance = np.arange(shape.window)
    for length in shape.lengths:
        fits = (distance <= found.left[hot, None]) & (length - distance <= found.right[hot, None])
        which, j = np.nonzero(fits)
        start = np.unique(found.at[hot[which]] - j)
        out.append((start, np.full(len(start), length), _hashes(found.data, start, start + length)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# --- merge ----------------------------------------------------------------------------------


def _first_unlike(a: bytes, b: bytes, at: int) -> int:
    """The first place from ``at`` on where two strings of one length differ, or that length."""
    while True:
        x, y = a[at : at + 32], b[at : at + 32]
        if x != y:
            unlike = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
            return at + len(x) - (unlike.bit_length() + 7) // 8
        if len(x) < 32:
            return at + len(x)
        at += 32


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merges sorted runs of strings of one length, each with its shared-prefix lengths.

    Returns the (run, place) of every string in order, and the length of the prefix that it
    shares with the one before. A loser tree: ``held[i]`` is the prefix that the head of run i
    shares with the last winner of its path. Of two heads the one that shares more is less;
    only heads that share the same are compared, from that length on.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    heads: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (size - k)
    held, place, losers = [0] * size, [0] * size, [0] * size
    order: list[tuple[int, int]] = []
    shared: list[int] = []

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None or held[a] > held[b]:
            return a, b
        if held[a] < held[b]:
            return b, a
        at = _first_unlike(x, y, held[a])
        if at == len(x) or x[at] < y[at]:
            held[b] = at
            return a, b
        held[a] = at
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        following = []
        for i in range(level):
            w, loser = play(winners[2 * i], winners[2 * i + 1])
            losers[level + i] = loser
            following.append(w)
        winners = following
    w = winners[0]
    while heads[w] is not None:
        strings, prefix = runs[w]
        i = place[w]
        order.append((w, i))
        shared.append(held[w])
        i += 1
        place[w] = i
        if i < len(strings):
            heads[w], held[w] = strings[i], prefix[i]
        else:
            heads[w] = None
        node = (w + size) >> 1
        while node:
            w, losers[node] = play(w, losers[node])
            node >>= 1
    return order, shared


def _ranges(shared: np.ndarray, deep: int) -> np.ndarray:
    """Numbers of the runs of rows that share ``deep`` bytes."""
    return np.cumsum(np.concatenate([[0], shared[1:] < deep])) if len(shared) else shared


def occurrences(shared: np.ndarray, left: np.ndarray, left_length: np.ndarray, right_length: np.ndarray, several: np.ndarray, shape: Shape) -> list[np.ndarray]:
    """The least and greatest distance at which a string around each anchor occurs again; 255 for none.

    Two arrays for each of ``shape.lengths``. Rows are anchors in the order of their suffixes. The
    string at distance j has j bytes before the anchor and length - j behind it.
    """
    n = len(shared)
    if not n:
        return [np.zeros(0, np.uint8)] * (2 * len(shape.lengths))
    by_left = np.argsort(left.view(f"S{left.shape[1]}").ravel(), kind="stable")
    left_shared = _shared(left[by_left])
    # rows of one context are alike at every distance: one of them stands for all
    whole = np.empty(n, np.int64)
    whole[by_left] = _ranges(left_shared, left.shape[1])
    key = _ranges(shared, shape.length) * np.int64(n) + whole
    _, first, which = distinct_of(((key * 512 + left_length) * 512 + right_length).astype(np.uint64))
    copies = np.bincount(which) + np.bincount(which, several)
    group = _ranges(shared, shape.sure)[first]
    rank, out = np.empty(n, np.int64), []
    for length in shape.lengths:
        nearest, farthest = np.maximum(length - right_length[first], 0), left_length[first]
        lo, hi = np.full(len(first), _NONE, np.int64), np.full(len(first), -1, np.int64)
        full = (copies > 1) & (nearest <= farthest)
        lo[full], hi[full] = nearest[full], farthest[full]
        # groups in which all are done, or which have one context, need no more
        open_groups = np.bincount(group, ~full & (nearest <= farthest), minlength=group.max() + 1) > 0
        open_groups &= np.bincount(group, minlength=group.max() + 1) > 1
        todo = np.flatnonzero(open_groups[group])
        for j in range(shape.window if len(todo) else 0):
            fits = (farthest[todo] >= j) & (nearest[todo] <= j)
            if not fits.any():
                continue
            rank[by_left] = _ranges(left_shared, j)
            own = todo[fits]
            rows = first[own]
            pair = _ranges(shared, length - j)[rows] * np.int64(n) + rank[rows]
            _, _, place = distinct_of(pair.astype(np.uint64))
            again = own[np.bincount(place)[place] > 1]
            lo[again], hi[again] = np.minimum(lo[again], j), np.maximum(hi[again], j)
        found = hi >= 0
        out += [np.where(found, lo, _NONE)[which].astype(np.uint8), np.where(found, hi, _NONE)[which].astype(np.uint8)]
    return out


def _merge_part(shape: Shape):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        bodies = [_split(r["body"]) for r in rows]
        runs = []
        for b in bodies:
            shared, rest = unpack(b[0], np.uint16).tolist(), zstandard.ZstdDecompressor().decompress(b[1])
            strings, at, last = [], 0, b""
            for s in shared:
                last = last[:s] + rest[at : at + shape.length - s]
                at += shape.length - s
                strings.append(last)
            runs.append((strings, shared))
        order, shared = merge(runs)
        sizes = np.array([len(r[0]) for r in runs])
        begin = np.cumsum(sizes) - sizes
        perm = np.array([begin[r] + i for r, i in order], np.int64)
        del runs
        left = np.concatenate([np.frombuffer(zstandard.ZstdDecompressor().decompress(b[2]), np.uint8).reshape(-1, shape.window - 1) for b in bodies])
        left_length = np.concatenate([unpack(b[3], np.uint8) for b in bodies]).astype(np.int64)
        right_length = np.concatenate([unpack(b[4], np.uint16) for b in bodies]).astype(np.int64)
        several = np.concatenate([unpack(b[5], np.uint8) for b in bodies])
        back = []
        for x in occurrences(np.array(shared, np.int64), np.ascontiguousarray(left[perm]), left_length[perm], right_length[perm], several[perm], shape):
            back.append(np.empty_like(x))
            back[-1][perm] = x
        out = [
            (r["part"], r["block"], _join([b[6], b[7], *(pack(x[a : a + n]) for x in back)]))
            for r, b, a, n in zip(rows, bodies, begin.tolist(), sizes.tolist(), strict=True)
        ]
        return _asked(out)

    return run


def _answer(shape: Shape):
    """Merges the runs (kind 0) or sums the strings (kind 1) of a part."""
    merged = _merge_part(shape)

    def run(table: pa.Table) -> pa.Table:
        kind, asked = table.column("kind")[0].as_py(), table.drop_columns(["kind"])
        out = _sum_asked(asked) if kind else merged(asked)
        return out.append_column("kind", pa.array([kind] * out.num_rows, pa.int32()))

    return run


# --- cover ----------------------------------------------------------------------------------

RESULT = "doc_id long, n_bytes long, spans array<struct<start: long, stop: long>>, kept binary, n_repeated long"


def _cover(shape: Shape, hot: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        types, names = [pa.int64(), pa.int64(), span, pa.binary(), pa.int64()], ["doc_id", "n_bytes", "spans", "kept", "n_repeated"]
        tables = []
        for row in left.to_pylist():
            data, off = _opened(row)
            change = {length: np.zeros(len(data) + 1, np.int32) for length in shape.lengths}
            replies = right.to_pylist()
            for r in replies:
                if r["kind"] == 0:
                    at, which, *ends = _split(r["body"])
                    at, which = unpack(at, np.uint64, True).astype(np.int64), unpack(which, np.uint32)
                    for i, length in enumerate(shape.lengths):
                        low, high = (unpack(x, np.uint8).astype(np.int64)[which] for x in ends[2 * i : 2 * i + 2])
                        again = low != _NONE
                        np.add.at(change[length], at[again] - high[again], 1)
                        np.add.at(change[length], at[again] - low[again] + length, -1)
            if any(r["kind"] == 1 for r in replies):
                found = Anchored(data, off, shape)
                answers = _answers(right.filter(pa.compute.equal(right.column("kind"), 2)))
                start, size, hashes = _strings_once(found, np.flatnonzero(_state(found, answers, hot) == 2))
                _, _, place = distinct_of(hashes)
                again = _answers(right.filter(pa.compute.equal(right.column("kind"), 1)))[place] > 1
                for length in shape.lengths:
                    own = start[again & (size == length)]
                    np.add.at(change[length], own, 1)
                    np.add.at(change[length], own + length, -1)
            gone = np.cumsum(change[shape.length][:-1]) > 0
            repeated = np.concatenate([[0], np.cumsum(np.cumsum(change[shape.report][:-1]) > 0)])[off]
            edge = np.zeros(len(data) + 1, bool)
            edge[off] = True
            before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
            begins = np.flatnonzero(gone & (~before | edge[:-1]))
            after = np.concatenate([gone[1:], [False]]) if len(gone) else gone
            stops = np.flatnonzero(gone & (~after | edge[1:])) + 1
            of = np.searchsorted(off, begins, "right") - 1
            values = pa.StructArray.from_arrays([pa.array(begins - off[of]), pa.array(stops - off[of])], names=["start", "stop"])
            cuts = np.searchsorted(begins, off)
            spans = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), values)
            kept_at = np.concatenate([[0], np.cumsum(~gone)])[off]
            kept = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(kept_at.astype(np.int64)), pa.py_buffer(data[~gone])]).cast(pa.binary())
            tables.append(pa.Table.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(np.diff(off)), spans.cast(span), kept, pa.array(np.diff(repeated).astype(np.int64))], names=names))
        return pa.concat_tables(tables) if tables else pa.Table.from_arrays([pa.array([], t) for t in types], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text", report: int = REPORT) -> DataFrame:
    """(doc_id, n_bytes, spans, kept, n_repeated) of every document.

    ``spans`` are the maximal runs of bytes covered by strings of ``length`` bytes that start
    anywhere else in the input too, in another text or, overlapping or not, in the same; ``kept`` is
    the rest of the UTF-8 bytes. ``n_repeated`` counts the bytes covered by the shorter strings of
    ``report`` bytes that start anywhere else too (``length`` if that is less); they are counted, and
    removed only where ``spans`` has them. Strings never cross texts. A null text is empty. Texts shorter
    than ``length`` lose nothing; rows that repeat, or repeat an id, are texts each. Other columns
    are not read; an empty table gives no rows.
    """
    shape = Shape(length, window, report)
    slim = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    blocks = written(slim.mapInArrow(_blocks, BLOCK))
    parts = max(1, -(-(blocks.agg(F.sum("size")).first()[0] or 0) // PART_BYTES))
    alike = written(blocks.mapInArrow(_ask_anchors(shape, parts), ASKED).groupBy("part").applyInArrow(_sum_asked, ASKED))
    release(docs.sparkSession)
    cut = blocks.groupBy("block").cogroup(alike.groupBy("block")).applyInArrow(_cut(shape, parts, hot), ASKED + ", kind int")
    # one exchange takes runs and strings to their parts; the answers on anchors are needed again beside strings
    replies = cut.groupBy("kind", "part").applyInArrow(_answer(shape), ASKED + ", kind int").unionByName(alike.withColumn("kind", F.lit(2)))
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_cover(shape, hot), RESULT)
