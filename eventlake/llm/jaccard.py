"""Exact Jaccard self-join on word shingles by partitioning the universe of shingles.

Two sets of x and y shingles that reach the threshold t differ in at most
H = (x + y)(1 - t)/(1 + t) shingles. Sets are grouped into size bands. In band k every shingle is
hashed to one of m segments; what a set has in a segment is hashed to one signature (a sum, so
that the signature without one shingle is a subtraction). The H differences of a similar pair
cannot reach more than H segments, so among any H + 1 segments one is alike in both.

Allocation by cost. Every set gives its segments thresholds 0, 1 or 2 that sum to H + 1 or more:
empty segments get 0; segments of threshold 1 are indexed as they are; where non-empty segments
are too few, all with two or more shingles get threshold 2 and are indexed with their
one-deletion neighbourhood too. The number of segments of a band is the one whose expected number
of index entries is least. A set indexes all its segments in its own band; for the partners of
the next band it indexes only the H + 1 segments with most shingles, the rarest signatures.

Candidates are verified by intersecting the sets. To avoid all pairs of a large group, every set is
first compared with one leader of a signature it shares. Of the pairs that are then not yet
connected, those are compared that the shingles they do not have to themselves could link. That
settles the classes. Every link lies inside one class, so the links of each set are then counted
over all pairs of its class, by blocks of a class whose shared shingles are one matrix product.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlake.llm.bytetext import LOWER, Spans, mix, slices, words
from eventlake.llm.graph import components
from eventlake.llm.scratch import release, written

#: Bits of a shingle's hash; sets of a thousand shingles meet by chance once in 10^8 pairs.
BITS = 48
_MASK = np.uint64((1 << BITS) - 1)
_ODD = [np.uint64(x | 1) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9E6C63D0676A9A99)]
_DELETED = np.uint64(0x5851F42D4C957F2D)
#: Rows of a batch that are handled together.
ROWS = 60_000
#: Bits of the filter that spares the reading of texts without candidates: 4 MB whatever the data.
FILTER_BITS = 1 << 25
#: Sets of a class in one block; every pair of a class's blocks is counted by itself.
BLOCK_SETS = 256
#: Shingles in one step of a block's matrix product.
STEP_SHINGLES = 8192
#: Fingerprints that are broadcast (8 bytes each); longer lists are joined by shuffle.
BROADCAST_ROWS = 1_000_000


@dataclass(frozen=True)
class Bands:
    """Size bands and segment counts for the threshold ``num / den``."""

    num: int
    den: int

    def differences(self, x: int, y: int) -> int:
        return (x + y) * (self.den - self.num) // (self.den + self.num)

    def largest_partner(self, x: int) -> int:
        return x * self.den // self.num

    @lru_cache(maxsize=None)  # noqa: B019
    def lows(self, most: int) -> tuple[int, ...]:
        """Least sizes of the bands up to the one above ``most``."""
        ratio = max(1.6, self.den / self.num + 1e-9)
        out = [1]
        while out[-1] <= most:
            out.append(max(out[-1] + 1, math.ceil(out[-1] * ratio)))
        return (*out, math.ceil(out[-1] * ratio) + 1)

    @lru_cache(maxsize=None)  # noqa: B019
    def segments(self, high: int) -> int:
        """Segments of a band whose largest sets have ``high`` shingles: least expected entries."""
        need = self.differences(high, high) + 1
        best = (math.inf, need)
        for m in range(max(need, 1), need + need // 4 + 4):
            empty = m * (1 - 1 / m) ** high if m > 1 else 0.0
            spare, term, fit = m - need, math.exp(-min(empty, 700)), 0.0
            for i in range(spare + 1):
                fit += term
                term *= empty / (i + 1)
            best = min(best, (m + max(0.0, 1 - fit) * (2 * m + high), m))
        return best[1]


def shingle_sets(data: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, sorted, and where each text's begin.

    A text with fewer than ``n`` words but at least one has its whole sequence as one shingle.
    """
    low = LOWER[data]
    starts, ends, at = words(low, off)
    hashed = Spans(low).hashes(starts, ends)
    count = np.diff(at)
    doc = np.repeat(np.arange(len(count), dtype=np.uint64), count)
    total = len(hashed)
    shingle = np.zeros(total, np.uint64)
    filled = np.zeros(total, np.int64)
    place = np.arange(total) - np.repeat(at[:-1], count)
    left = np.repeat(count, count) - place
    for k in range(n):
        has = np.flatnonzero(left[: total - k] > k) if k else np.arange(total)
        shingle[has] += hashed[has + k] * _ODD[k % len(_ODD)] + np.uint64(k)
        filled[has] += 1
    keep = (filled == n) | (place == 0)
    key = np.sort(doc[keep] << np.uint64(BITS) | mix(shingle[keep] + filled[keep].astype(np.uint64)) & _MASK)
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    return key & _MASK, np.searchsorted(key >> np.uint64(BITS), np.arange(len(count) + 1, dtype=np.uint64))


def fingerprints(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One hash for each whole set."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(sets + np.uint64(0x51ED2701)), dtype=np.uint64)])
    return mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64) * _ODD[0])


def signatures(sets: np.ndarray, at: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of its set) of every index entry."""
    sizes = np.diff(at)
    out_sig, out_set = [], []
    if not len(sizes) or not sizes.max():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lows = np.array(bands.lows(int(sizes.max())))
    home = np.searchsorted(lows, sizes, "right") - 1
    partner = sizes * bands.den // bands.num
    value = mix(sets ^ np.uint64(0x2545F4914F6CDD1D))
    for k in range(len(lows) - 1):
        own = home == k
        probing = (home == k - 1) & (partner >= lows[k]) & (sizes > 0)
        high = int(lows[k + 1]) - 1
        members = np.flatnonzero((own & (sizes > 0)) | probing)
        if not len(members) or not bands.differences(high, high):
            continue
        x, probe = sizes[members], probing[members]
        need = (x + np.where(probe, partner[members], np.minimum(partner[members], high))) * (bands.den - bands.num) // (bands.den + bands.num) + 1
        apart = need > 1  # else only equal sets are similar
        members, x, probe, need = members[apart], x[apart], probe[apart], need[apart]
        if not len(members):
            continue
        m = bands.segments(high)
        which = np.repeat(np.arange(len(members)), x)
        element = np.arange(len(which)) - np.repeat(np.cumsum(x) - x, x) + np.repeat(at[members], x)
        segment = ((mix(sets[element] + np.uint64((k + 1) * int(_ODD[1]) % 2**64)) >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        cell = which * m + segment
        held = np.bincount(cell, minlength=len(members) * m)
        sums = np.zeros(len(members) * m, np.uint64)
        np.add.at(sums, cell, value[element])
        salt = np.tile(np.arange(m, dtype=np.uint64) * _ODD[2] + np.uint64(k * int(_ODD[3]) % 2**64), len(members))

        def signed(total, n, salt):
            return mix(total + n.astype(np.uint64) * _ODD[4] + salt)

        some = held > 0
        whole = some.reshape(-1, m).sum(1)
        short = whole < need
        bare = np.minimum(held, 2).reshape(-1, m).sum(1) < need
        emit = some | np.repeat(bare, m)
        if probe.any():
            # of a probing set, only the fullest of its segments
            rank = np.argsort(np.argsort(-held.reshape(-1, m), axis=1, kind="stable"), axis=1)
            emit &= ((rank < need[:, None]) | ~probe[:, None] | short[:, None]).ravel()
        at_cell = np.flatnonzero(emit)
        out_sig.append(signed(sums[at_cell], held[at_cell], salt[at_cell]))
        out_set.append(members[at_cell // m])
        if short.any():
            at_cell = np.flatnonzero(some & np.repeat(short, m))
            out_sig.append(signed(sums[at_cell], held[at_cell], salt[at_cell]) ^ _DELETED)
            out_set.append(members[at_cell // m])
            gone = np.flatnonzero(short[which] & (held[cell] >= 2))
            c = cell[gone]
            out_sig.append(signed(sums[c] - value[element[gone]], held[c] - 1, salt[c]) ^ _DELETED)
            out_set.append(members[which[gone]])
    return (np.concatenate(out_sig), np.concatenate(out_set)) if out_sig else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def _batches(batches: Iterator[pa.RecordBatch], n: int):
    """(ids, sets, starts) of slices of (id, text) batches."""
    for batch in batches:
        for first in range(0, batch.num_rows, ROWS):
            part = batch.slice(first, ROWS)
            for i, j, data, off in slices(part.column(1)):
                yield part.column(0).slice(i, j - i), *shingle_sets(data, off, n)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x, pa.int64())


def _profiles(n: int):
    def run(batches):
        for ids, sets, at in _batches(batches, n):
            yield pa.RecordBatch.from_arrays([ids, _long(np.diff(at)), _long(fingerprints(sets, at))], names=["id", "n", "fp"])

    return run


def _entries(n: int, bands: Bands):
    def run(batches):
        for _, sets, at in _batches(batches, n):
            fp = fingerprints(sets, at)
            _, first = np.unique(fp, return_index=True)
            fresh = np.zeros(len(fp), bool)
            fresh[first] = True
            size = np.where(fresh, np.diff(at), 0)
            part = sets[np.repeat(fresh, np.diff(at))]
            sig, which = signatures(part, np.concatenate([[0], np.cumsum(size)]), bands)
            for a in range(0, len(sig), 200_000):
                yield pa.RecordBatch.from_arrays([_long(sig[a : a + 200_000]), _long(fp[which[a : a + 200_000]])], names=["sig", "fp"])

    return run


def _id_slot(ids: np.ndarray) -> np.ndarray:
    return (mix(ids.view(np.uint64)) >> np.uint64(39)).astype(np.int64)


def _sets(n: int, name: str, wanted: dict):
    def run(batches):
        bits = np.zeros(FILTER_BITS // 8, np.uint8)
        for bucket, bitmap in wanted[name].items():
            bits[bucket * 4096 : (bucket + 1) * 4096] = np.frombuffer(bitmap, np.uint8)
        for batch in batches:
            slot = _id_slot(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            batch = batch.filter(pa.array((bits[slot >> 3] >> (slot & 7) & 1).astype(bool)))
            for _, sets, at in _batches(iter([batch]), n):
                # an id may stand for several texts: the fingerprint of what was read decides
                columns = [_long(fingerprints(sets, at)), _long(np.diff(at)), pa.ListArray.from_arrays(pa.array(at, pa.int32()), _long(sets))]
                yield pa.RecordBatch.from_arrays(columns, names=["fp", "n", "set"])

    return run


def _only(sets: DataFrame, fps: DataFrame) -> DataFrame:
    """The rows of ``sets`` with one of the distinct ``fps``; the sets move only if the list is long."""
    few = fps.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return sets.join(F.broadcast(fps) if few else fps, "fp", "left_semi")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose sets reach the threshold."""
    pairs = written(pairs)
    sets = _only(sets, pairs.select(F.col("a").alias("fp")).union(pairs.select("b")).distinct())
    of = lambda x: sets.select(F.col("fp").alias(x), F.col("n").alias(f"n_{x}"), F.col("set").alias(f"set_{x}"))
    both = pairs.join(of("b"), "b").join(of("a"), "a")
    both = both.filter(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return both.filter(shared * den >= num * (F.col("n_a") + F.col("n_b") - shared)).select("a", "b")


def _contenders(open_rows: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The rows of ``open_rows`` that can still be of a link between two components.

    Shingles that no other open set has lie in no intersection. With k others a set of x can
    only link with sets of up to ``reach`` = k (1 + t) / t - x shingles.
    """
    own = _only(sets, open_rows.select("fp").distinct())
    alone = own.select("fp", F.explode("set").alias("e")).groupBy("e").agg(F.count("*").alias("c"), F.min("fp").alias("fp")).filter("c = 1").groupBy("fp").agg(F.count("*").alias("alone"))
    k = F.col("n") - F.coalesce("alone", F.lit(0))
    reach = own.select("fp", "n").join(alone, "fp", "left").select("fp", "n", (F.floor(k * (num + den) / F.lit(num)) - F.col("n")).alias("reach"))
    by_sig = Window.partitionBy("sig")
    rows = open_rows.select("sig", "fp", "root").join(reach, "fp")
    for name, column in (("lo", F.min("root")), ("hi", F.max("root")), ("least", F.min("n")), ("most", F.max("reach"))):
        rows = rows.withColumn(name, column.over(by_sig))
    return rows.filter("lo <> hi and reach >= least and n <= most").select("sig", "fp", "root", "n", "reach")


def _leads(rows: DataFrame) -> DataFrame:
    """(a, b), a < b: every set with the leader of another component that it shares most signatures with.

    The leader of a signature is the set whose signatures are shared by most others: a text that
    others derive from keeps what they change.
    """
    by_sig = Window.partitionBy("sig")
    sized = rows.select("sig", "fp", "root").withColumn("c", F.count("*").over(by_sig))
    weight = sized.groupBy("fp").agg(F.sum("c").alias("w"))
    led = sized.join(weight, "fp").withColumn("lead", F.max(F.struct("w", "fp", "root")).over(by_sig)).filter("root <> lead.root")
    best = led.groupBy("fp", F.col("lead.fp").alias("leader")).agg(F.count("*").alias("k")).groupBy("fp").agg(F.max(F.struct("k", "leader")).alias("best"))
    return best.select(F.least("fp", "best.leader").alias("a"), F.greatest("fp", "best.leader").alias("b")).distinct()


def _relabelled(rows: DataFrame, root: DataFrame) -> DataFrame:
    """``rows`` with the roots of ``root`` (node, root), where their signature still joins two of them."""
    by_sig = Window.partitionBy("sig")
    named = rows.join(root.withColumnsRenamed({"node": "fp", "root": "__r"}), "fp", "left").withColumn("root", F.coalesce("__r", "fp")).drop("__r")
    return named.withColumn("lo", F.min("root").over(by_sig)).withColumn("hi", F.max("root").over(by_sig)).filter("lo <> hi").drop("lo", "hi")


def _open_pairs(rows: DataFrame) -> DataFrame:
    """(a, b) of sets of different components that share a signature and can reach each other.

    A pair is made at the first of the signatures that both have.
    """
    of = rows.groupBy("fp").agg(F.sort_array(F.collect_set("sig")).alias("sigs"))
    full = rows.join(of, "fp")
    a, b = (full.select("sig", *(F.col(c).alias(f"{c}_{x}") for c in ("fp", "root", "n", "reach", "sigs"))) for x in "ab")
    made = a.join(b, "sig").filter("root_a < root_b and n_a <= reach_b and n_b <= reach_a and sig = array_min(array_intersect(sigs_a, sigs_b))")
    return made.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b"))


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two of ``sets`` share."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = held[column] > 1
    row, column = row[common], (np.cumsum(held > 1) - 1)[column[common]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, STEP_SHINGLES):
        a, b = np.searchsorted(column, [first, first + STEP_SHINGLES])
        holds = np.zeros((len(sets), STEP_SHINGLES), np.float32)
        holds[row[a:b], column[a:b] - first] = 1
        out += (holds @ holds.T).astype(np.int64)
    return out


def _count_links(num: int, den: int):
    """(fp, k) of a pair of blocks: the links of each set across it."""

    def run(table: pa.Table) -> pa.Table:
        block, lo, hi = (table.column(c).to_numpy() for c in ("block", "lo", "hi"))
        sets = [np.asarray(s) for s in table.column("set").combine_chunks().to_numpy(zero_copy_only=False)]
        n, shared = np.array([len(s) for s in sets]), _shared(sets)
        link = shared * den >= num * (n[:, None] + n[None, :] - shared)
        np.fill_diagonal(link, False)
        if lo[0] != hi[0]:
            link &= block[:, None] != block[None, :]
        return pa.table({"fp": table.column("fp"), "k": pa.array(link.sum(1), pa.int64())})

    return run


def _degrees(final: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(fp, n_links) of the sets of ``final`` (fp, class): the verified links to other sets, over all pairs of a class."""
    final = written(final)
    sizes = final.groupBy("class").agg(F.count("*").alias("m"))
    sized = final.join(sizes, "class")
    two = sized.filter("m = 2").select("fp", F.lit(1).cast("long").alias("k"))
    many = written(sized.filter("m > 2").withColumn("blocks", F.ceil(F.col("m") / BLOCK_SETS).cast("long")))
    held = _only(sets, many.select("fp")).join(many, "fp").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    dealt = held.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("fp", "set", "class", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    counted = dealt.groupBy("class", "lo", "hi").applyInArrow(_count_links(num, den), "fp long, k long")
    return two.unionByName(counted).groupBy("fp").agg(F.sum("k").alias("n_links"))


def _tree(root: DataFrame) -> DataFrame:
    return root.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def classes(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, id_col: str = "doc_id", text_col: str = "text", count_links: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    Documents link when the Jaccard similarity of their sets of ``n``-word shingles is at least
    ``num / den``; words are lower-cased (A-Z) and split at ASCII white space. component_id is the
    least doc_id that links reach. n_links counts all links of a document's set to other sets,
    each verified; copies are one set; without ``count_links`` it is null. A document without words, or with a
    null text, has no shingles and is linked with nothing, not even its like. Rows that repeat an
    id are documents each; a null id never becomes a component_id unless it stands alone. Other
    columns are not read; an empty table gives no rows.
    """
    bands = Bands(num, den)
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("__text"))
    profile = written(slim.mapInArrow(_profiles(n), "id long, n long, fp long"))

    # sets that share a signature; copies are one set
    by_sig = Window.partitionBy("sig")
    entries = slim.mapInArrow(_entries(n, bands), "sig long, fp long")
    met = entries.withColumn("first", F.min("fp").over(by_sig)).withColumn("last", F.max("fp").over(by_sig)).filter("first <> last")
    shared = written(met.select("sig", "fp", F.col("fp").alias("root")).distinct())

    release(docs.sparkSession)

    # the sets of candidates, read again from the texts that have them
    wanted = profile.filter("n > 0").groupBy("fp").agg(F.min("id").alias("id")).join(shared.select("fp").distinct(), "fp", "left_semi")
    wanted = written(wanted)
    slots = wanted.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array(_id_slot(b.column("id").fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)))], names=["slot"]) for b in it), "slot long")
    bitmaps = slots.groupBy(F.expr("slot div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.col("slot") % 32768).alias("bits"))
    name = uuid.uuid4().hex
    filter_bits = {name: {r["bucket"]: bytes(r["bits"]) for r in bitmaps.collect()}}  # 4 MB at most
    found = slim.mapInArrow(_sets(n, name, filter_bits), "fp long, n long, set array<long>")
    sets = written(found.join(wanted.select("fp"), "fp", "left_semi").dropDuplicates(["fp"]))

    release(docs.sparkSession)

    # every set is compared with one leader, then those that can still link with another
    star = written(_leads(shared))
    first = written(_links(star, sets, num, den))
    root = written(components(first))
    open_rows = written(_contenders(written(_relabelled(shared, root)), sets, num, den))
    again = written(_leads(open_rows).join(star, ["a", "b"], "left_anti"))
    second = written(_links(again, sets, num, den))
    root = written(components(_tree(root).unionByName(second)))
    open_rows = written(_contenders(written(_relabelled(open_rows.select("sig", "fp", "root"), root)), sets, num, den))
    release(docs.sparkSession)
    # and what is left, pair by pair
    rest = _open_pairs(open_rows).join(star.unionByName(again), ["a", "b"], "left_anti")
    third = written(_links(rest, sets, num, den))

    final = components(_tree(root).unionByName(third)).withColumnsRenamed({"node": "fp", "root": "class"})
    info = final.join(_degrees(final, sets, num, den), "fp", "left") if count_links else final.withColumn("n_links", F.lit(None).cast("long"))
    labelled = profile.filter("n > 0").join(info, "fp", "left").withColumn("class", F.coalesce("class", "fp"))
    least = labelled.groupBy("class").agg(F.min("id").alias("component_id"))
    full = labelled.join(least, "class").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", (F.coalesce("n_links", F.lit(0)) if count_links else F.lit(None)).cast("long").alias("n_links"))
    alone = profile.filter("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("id").alias("component_id"), F.lit(0 if count_links else None).cast("long").alias("n_links"))
    return full.unionByName(alone)

