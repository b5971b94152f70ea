"""Best-fit packing of token sequences with a swap-based local search.

The plan is made for a histogram: pieces have lengths 1..capacity, so the driver holds
``capacity`` counts whatever the size of the corpus. A bin type is a multiset of lengths with the
number of bins that hold it. Best fit in falling order of length fills the bins; local search
then moves one or two pieces between underfull bins or exchanges one for one, one for two or two for
one, in either direction, each time raising the sum of squared fills, until a bin is empty or no exchange helps. One step treats all
bins of the two types at once. Documents find their bin by their rank among equal lengths, from
per-task counts, so no length is ever sorted or gathered in one place.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.bytetext import slices
from eventlake.llm.scratch import written
from eventlake.llm.tokens import UnitEncoder

Bin = tuple[tuple[int, int], ...]  # (length, how many of it), falling

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, rank long"


def best_fit(histogram: dict[int, int], capacity: int) -> Counter[Bin]:
    """Bins for ``histogram`` (length -> count): each length goes where least room would remain."""
    open_bins: dict[int, Counter[Bin]] = {capacity: Counter()}  # by room left
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = min((r for r, bins in open_bins.items() if r >= length and bins), default=None)
            if room is None:
                per_bin = capacity // length
                whole, rest = divmod(left, per_bin)
                if whole:
                    open_bins.setdefault(capacity - per_bin * length, Counter())[((length, per_bin),)] += whole
                if rest:
                    open_bins.setdefault(capacity - rest * length, Counter())[((length, rest),)] += 1
                left = 0
                continue
            bins = open_bins[room]
            content = next(iter(bins))
            n = min(left, bins[content])
            bins[content] -= n
            if not bins[content]:
                del bins[content]
            open_bins.setdefault(room - length, Counter())[_with(content, length)] += n
            left -= n
    out: Counter[Bin] = Counter()
    for bins in open_bins.values():
        out += bins
    return out


def _with(content: Bin, length: int, n: int = 1) -> Bin:
    held = dict(content)
    held[length] = held.get(length, 0) + n
    return tuple(sorted(((k, v) for k, v in held.items() if v), reverse=True))


def _fill(content: Bin) -> int:
    return sum(length * n for length, n in content)


def _ones(content: Bin) -> list[tuple[int, tuple[int, ...]]]:
    return [(x, (x,)) for x, _ in content]


@lru_cache(maxsize=100_000)
def _sides(content: Bin) -> tuple[list[tuple[int, tuple[int, ...]]], list[tuple[int, tuple[int, ...]]]]:
    """(total, pieces) of what can leave a bin as one piece, and as two; by rising total."""
    lengths = [x for x, n in content for _ in range(min(n, 2))]
    twos = {(x + y, (x, y)) for i, x in enumerate(lengths) for y in lengths[i + 1 :]}
    return sorted(_ones(content)), sorted(twos)


def _best(out: list[tuple[int, tuple[int, ...]]], back: list[tuple[int, tuple[int, ...]]], room: int) -> tuple[int, tuple[int, ...], tuple[int, ...]]:
    """The greatest net <= room that goes over when one of ``out`` leaves and one of ``back`` returns."""
    best, i = (0, (), ()), 0
    for total, pieces in out:  # as totals rise, the least return that still fits rises too
        while i < len(back) and total - back[i][0] > room:
            i += 1
        if i == len(back):
            break
        if total - back[i][0] > best[0]:
            best = total - back[i][0], pieces, back[i][1]
    return best


def _exchange(donor: Bin, taker: Bin, capacity: int) -> tuple[tuple[int, ...], tuple[int, ...]] | None:
    """(out, back): the pieces that leave ``donor`` and those that return; the best gain, if there is one.

    With ``lead`` the taker's fill above the donor's, a net transfer gains 2 * net * (net + lead),
    so the greatest net that fits is best.
    """
    room, lead = capacity - _fill(taker), _fill(taker) - _fill(donor)
    (one, two), (one_back, two_back) = _sides(donor), _sides(taker)
    nothing = [(0, ())]
    found = max((_best(out, back, room) for out, back in ((one, nothing), (two, nothing), (one, one_back), (one, two_back), (two, one_back))), key=lambda f: f[0])
    return found[1:] if found[0] > max(0, -lead) else None


def improve(bins: Counter[Bin], capacity: int) -> Counter[Bin]:
    """Local search until the bins are as few as their sum allows or no exchange helps.

    Every exchange raises the sum of squared fills, so the search ends, and never with more bins. An
    exchange depends on the two contents alone: pairs without one are remembered and not tried again.
    """
    bins = Counter({b: n for b, n in bins.items() if n})
    least = -(-sum(_fill(b) * n for b, n in bins.items()) // capacity)
    barren: dict[Bin, set[Bin]] = {}
    while sum(bins.values()) > least:
        types = sorted((b for b in bins if _fill(b) < capacity), key=lambda b: (_fill(b), b))
        for i, donor in enumerate(types):
            tried, step = barren.setdefault(donor, set()), None
            for taker in types[i + 1 :][::-1] + ([donor] if bins[donor] > 1 else []) + types[:i][::-1]:
                if taker in tried:
                    continue
                if e := _exchange(donor, taker, capacity):
                    step = taker, e
                    break
                tried.add(taker)
            if step:
                break
        else:
            return bins
        taker, (out, back) = step
        n = bins[donor] // 2 if taker == donor else min(bins[donor], bins[taker])
        giving, taking = donor, taker
        for a in out:
            giving, taking = _with(giving, a, -1), _with(taking, a)
        for b in back:
            giving, taking = _with(giving, b), _with(taking, b, -1)
        bins[donor] -= n
        bins[taker] -= n
        bins[giving] += n
        bins[taking] += n
        bins = Counter({b: m for b, m in bins.items() if b and m > 0})
    return bins


class Plan:
    """Where the r-th piece of each length goes, as sorted arrays."""

    def __init__(self, bins: Counter[Bin]):
        rows, used, first = [], Counter(), 0
        for content in sorted(bins, key=lambda b: (-_fill(b), b)):
            n, offset = bins[content], 0
            for length, per_bin in content:
                rows.append((length, used[length], first, per_bin, offset))
                used[length] += per_bin * n
                offset += length * per_bin
            first += n
        rows.sort()
        table = np.array(rows, np.int64).reshape(-1, 5)
        self.length, self.rank, self.first, self.per_bin, self.offset = table.T.copy()
        self.bins = first

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence ids, offsets) of the ``rank``-th pieces of ``length``."""
        wide = np.int64(1) << np.int64(45)
        at = np.searchsorted(self.length * wide + self.rank, length * wide + rank, "right") - 1
        nth = rank - self.rank[at]
        return self.first[at] + nth // self.per_bin[at], self.offset[at] + nth % self.per_bin[at] * length


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full, but the first, which takes the rest."""
    head = (total - 1) % capacity + 1
    return [(0, head), *((s, capacity) for s in range(head, total, capacity))]


def _pieces_of(tokenizer: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, block, seen = UnitEncoder.at(tokenizer), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4")
        for batch in batches:
            ids_of = batch.column("__id")
            for i, j, data, off in slices(batch.column("__text")):
                ids, at = encoder.encode(data, off)
                ids = ids.astype("<u4", copy=False)
                rows = []
                for k, doc in enumerate(ids_of.slice(i, j - i).to_pylist()):
                    own = np.concatenate([ids[at[k] : at[k + 1]], end])
                    for piece, (start, length) in enumerate(cut(len(own), capacity)):
                        rows.append((doc, piece, start, length, zlib.crc32(own[start : start + length]), block, seen[length]))
                        seen[length] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "block", "rank"],
                )

    return run


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its task (``block``) and its rank among equal lengths there."""
    slim = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    return slim.mapInArrow(_pieces_of(tokenizer, capacity, end_id), PIECES)


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Packs all documents into sequences of at most ``capacity`` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. A null or
    empty text is a document of the end token alone. Rows that repeat an id are packed each. Of
    equal lengths, order is by task and row. An empty table gives no rows; other columns are not
    read, whatever their names.
    """
    made = written(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    counts = made.groupBy("block", "length").agg(F.count("*").alias("n"))
    # at most ``capacity`` rows
    histogram = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = Plan(improve(best_fit(histogram, capacity), capacity))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("block", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(offsets, ["block", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("rank")).alias("rank")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.place(batch.column("length").to_numpy(), batch.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
