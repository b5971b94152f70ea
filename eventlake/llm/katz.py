"""A word trigram model with Katz backoff, trained and applied over the whole corpus.

Probability of a word w after u v: d(c(uvw)) c(uvw) / c(uv) where the model has the trigram, with
Good-Turing discounts d for counts up to ``K``; else alpha(uv) P(w|v), alpha(uv) being what the
trigrams of uv leave, divided by what P(.|v) leaves of the words that follow u v; so the
probabilities after each u v sum to one exactly. P(w|v) is made likewise from bigrams and the
Good-Turing discounted unigram; all words that training lacks are one class, which gets what the
unigram's discounts leave. Every token is thus evaluated from the highest order down.

Trigrams that training has once are left to the backoff (``LEAST_TRIGRAM``), as is common for the
highest order: they are most of all trigrams and tell least. A trigram that occurs twice consists
of bigrams that do, so only such ones are counted, and the rule loses no other.

Counts never meet in one place. Documents are held in blocks of a few megabytes. A block sends
its distinct words, then its distinct bigrams, then its trigrams, to parts of the hash space as
packed sorted arrays, and gets the corpus counts back in the same order; the parts are written as
tables. A word that makes up a large share of a part has its bigrams dealt, by the second word,
over as many parts as its count needs; what alpha is made of is then summed over them. Pairs of
words are spread by their own hash.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlake.llm.bytetext import LOWER, Spans, distinct_of, forget, mix, slices, words
from eventlake.llm.scratch import release, written

#: Counts above K are not discounted.
K = 5
BLOCK_BYTES = 8 << 20
#: Tokens for each part of the hash space.
PART_TOKENS = 1_500_000
#: Trigrams are exchanged in so many rounds, each with its share of the parts, which divides the disk they take;
#: blocks are scored in as many.
ROUNDS = 3
#: Trigrams that training has less often are not in the model.
LEAST_TRIGRAM = 2
#: A word is spread if it is more than 1 / (SPREAD * parts) of the training tokens, and more than
#: LEAST_SHARE of them, so that there are at most a million such words in a corpus of any size.
SPREAD = 4
LEAST_SHARE = 1e-6
#: Bigrams and tokens of a block whose probabilities are made at once.
SLICE = 1 << 17
END, START = np.uint64(0xE4D0000000000001), np.uint64(0x57A2700000000001)


@cache
def lean() -> None:
    """From now on arrays of a megabyte and more go back to the system when this process frees them.

    The C library would keep such memory for the next task, and two workers stand beside each executor's heap.
    """
    c = ctypes.CDLL(None)
    if hasattr(c, "mallopt"):  # glibc
        c.mallopt(-3, 1 << 20)  # M_MMAP_THRESHOLD
        c.mallopt(-1, 1 << 20)  # M_TRIM_THRESHOLD
    pa.set_memory_pool(pa.system_memory_pool())


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """An integer array as compressed byte planes; differences if it is rising."""
    if rising and len(x):
        x = np.diff(x, prepend=x.dtype.type(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T) if len(x) else b""
    return zstandard.ZstdCompressor(level=1).compress(bytes(planes) if len(x) == 0 else planes.tobytes())


def unpack(blob: bytes, dtype, rising: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    width = np.dtype(dtype).itemsize
    x = np.ascontiguousarray(raw.reshape(width, -1).T).view(dtype).ravel() if len(raw) else np.zeros(0, dtype)
    return np.cumsum(x, dtype=dtype) if rising and len(x) else x


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash; parts are equal ranges, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int32)


def discounts(of_counts: list[int]) -> np.ndarray:
    """d[0..K] from the numbers of things that occur 1, 2, ... K + 1 times.

    Where Good-Turing has no valid value (a number is zero, or the result lies outside (0, 1)),
    half a count is taken off instead.
    """
    n = [0, *of_counts]
    d = np.array([1.0] + [(r - 0.5) / r for r in range(1, K + 1)])
    if n[1]:
        cut = (K + 1) * n[K + 1] / n[1]
        for r in range(1, K + 1):
            if n[r] and cut < 1:
                value = ((r + 1) * n[r + 1] / (r * n[r]) - cut) / (1 - cut)
                if 0 < value < 1:
                    d[r] = value
    return d


@dataclass(frozen=True)
class Unigrams:
    """What the driver knows of the unigrams: a few numbers."""

    total: int
    distinct: int
    discount: tuple[float, ...]
    low: tuple[int, ...]  # how many words occur 1..K times

    @property
    def over(self) -> float:
        """The denominator: one more than the tokens where discounts leave nothing."""
        return self.total + (0.0 if any(self.low) else 1.0)

    @property
    def unknown(self) -> float:
        """The probability of the class of unknown words."""
        if not self.total:
            return 1.0
        if not any(self.low):
            return 1.0 / self.over
        return sum(n * r * (1 - self.discount[r]) for r, n in enumerate(self.low, 1)) / self.total

    def probability(self, count: np.ndarray) -> np.ndarray:
        d = np.array([1.0, *self.discount[1:], 1.0])[np.minimum(count, K + 1)]
        return np.where(count > 0, d * count / max(self.over, 1.0), self.unknown)


# --- blocks ---------------------------------------------------------------------------------

BLOCK = "block long, tokens long, ids array<long>, held array<boolean>, lengths array<int>, vocabulary binary, sequence binary"


def _held_out(doc) -> bool:
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lean()
    base, n = TaskContext.get().partitionId() << 32, 0
    hashes, ids, lengths, size = [], [], [], 0

    def out() -> pa.RecordBatch:
        nonlocal n, size
        held = [_held_out(d) for d in ids]
        tokens = np.concatenate(hashes)
        vocabulary, _, sequence = distinct_of(np.concatenate([tokens, [START]]))
        row = [base + n, len(tokens), list(ids), held, list(lengths), pack(vocabulary, True), pack(sequence[:-1].astype(np.uint32))]
        n, size = n + 1, 0
        for x in (hashes, ids, lengths):
            x.clear()
        types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(row, types, strict=True)], names=[x.split()[0] for x in BLOCK.split(", ")])

    for batch in batches:
        for i, j, data, off in slices(batch.column(1)):
            low = LOWER[data]
            starts, ends, at = words(low, off)
            own = np.insert(Spans(low).hashes(starts, ends), at[1:], END)
            hashes.append(own)
            ids += batch.column(0).slice(i, j - i).to_pylist()
            lengths += (np.diff(at) + 1).tolist()
            size += len(data) + j - i
            if size >= BLOCK_BYTES:
                yield out()
    forget()
    if ids:
        yield out()


# --- words ----------------------------------------------------------------------------------


def _ask_words(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, sequence = unpack(row["vocabulary"], np.uint64, True), unpack(row["sequence"], np.uint32)
                train = np.bincount(sequence[np.repeat(~np.array(row["held"], bool), row["lengths"])], minlength=len(vocabulary)).astype(np.uint32)
                part = part_of(vocabulary, parts)
                cuts = np.searchsorted(part, np.arange(parts + 1))
                some = np.flatnonzero(np.diff(cuts))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some, pa.int32()), pa.array([row["block"]] * len(some), pa.int64()),
                     pa.array([pack(vocabulary[cuts[p] : cuts[p + 1]], True) for p in some], pa.binary()),
                     pa.array([pack(train[cuts[p] : cuts[p + 1]]) for p in some], pa.binary())],
                    names=["part", "block", "words", "train"],
                )

    return run


REPLY = "block long, part int, counts binary, needs binary, stats array<long>, word long, covered double"
_REPLY_TYPES = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.float64()]


def _reply(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * len(_REPLY_TYPES)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _REPLY_TYPES, strict=True)], names=[x.split()[0] for x in REPLY.split(", ")])


def _of_counts(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, K + 2), minlength=K + 3)[1 : K + 2].tolist()


def _sum_words(table: pa.Table) -> pa.Table:
    lean()
    rows = table.to_pylist()
    asked = [unpack(r["words"], np.uint64, True) for r in rows]
    distinct, _, place = distinct_of(np.concatenate(asked))
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, np.concatenate([unpack(r["train"], np.uint32) for r in rows]).astype(np.int64))
    out, at = [], 0
    for r, own in zip(rows, asked, strict=True):
        out.append((r["block"], r["part"], pack(total[place[at : at + len(own)]]), None, None, None, None))
        at += len(own)
    out.append((-1, rows[0]["part"], None, None, [int(total.sum()), int((total > 0).sum()), *_of_counts(total)], None, None))
    return _reply(out)


# --- bigrams --------------------------------------------------------------------------------


def _numbered(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and each value's place among them; a block has under 2^31 tokens."""
    distinct, _, place = distinct_of(x)
    return distinct, place.astype(np.int32)


def _pairs(block: dict, replies: list[dict], parts: int, train_tokens: int):
    """All a block knows of its bigrams, in the order in which it asks for them."""
    vocabulary, sequence = unpack(block["vocabulary"], np.uint64, True), unpack(block["sequence"], np.uint32).view(np.int32)
    counts = np.concatenate([unpack(r["counts"], np.int64) for r in sorted(replies, key=lambda r: r["part"])])
    lengths = np.array(block["lengths"], np.int64)
    begin = np.cumsum(lengths) - lengths
    pairs = np.empty(len(sequence), np.uint64)
    pairs[1:] = sequence[:-1]
    pairs[begin] = np.searchsorted(vocabulary, START)
    pairs *= np.uint64(len(vocabulary))
    pairs += sequence.view(np.uint32)
    key, place = _numbered(pairs)
    del pairs
    first, second = (x.astype(np.int32) for x in np.divmod(key, np.uint64(len(vocabulary))))
    del key
    part = part_of(vocabulary[first], parts)
    following = counts.copy()
    following[np.searchsorted(vocabulary, START)] = counts[np.searchsorted(vocabulary, END)]
    common = following > train_tokens * max(1 / (SPREAD * parts), LEAST_SHARE)
    reach = np.minimum(-(-following * parts * SPREAD // max(train_tokens, 1)), parts)
    spread = np.flatnonzero(common[first])
    u, v = first[spread], second[spread]
    shift = mix(vocabulary[v] + vocabulary[u]) % np.maximum(reach[u], 1).astype(np.uint64)
    part[spread] = (part[spread] + shift.astype(np.int32)) % parts
    order = np.argsort(part, kind="stable")
    return vocabulary, counts, sequence, lengths, first, second, place, part, order, common


def _ask_pairs(parts: int, train_tokens: int):
    names = ["part", "block", "first", "runs", "common", "second", "second_counts", "which", "train"]
    types = [pa.int32(), pa.int64()] + [pa.binary()] * 7

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        rows = []
        for block in left.to_pylist():
            vocabulary, counts, _, lengths, first, second, place, part, order, common = _pairs(block, right.to_pylist(), parts, train_tokens)
            train = np.bincount(place[np.repeat(~np.array(block["held"], bool), lengths)], minlength=len(first))
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            for p in np.flatnonzero(np.diff(cuts)):
                own = order[cuts[p] : cuts[p + 1]]
                u = first[own]
                new = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
                v, _, which = distinct_of(second[own])
                rows.append((p, block["block"], pack(vocabulary[u[new]], True), pack(np.diff(new, append=len(own)).astype(np.uint32)), pack(common[u[new]].astype(np.uint8)),
                             pack(vocabulary[v], True), pack(counts[v]), pack(which.astype(np.uint32)), pack(train[own].astype(np.uint32))))
        columns = list(zip(*rows, strict=True)) or [[]] * len(names)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


ASKED = "part int, block long, first binary, runs binary, common binary, second binary, second_counts binary, which binary, train binary"


def _sum_pairs(unigrams: Unigrams):
    """Corpus counts of bigrams; for each first word of a block that lacks some of its bigrams, and
    for the common words, the numbers that alpha is made of."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        rows = table.to_pylist()
        firsts = [unpack(r["first"], np.uint64, True) for r in rows]
        runs = [unpack(r["runs"], np.uint32).astype(np.int64) for r in rows]
        seconds = [unpack(r["second"], np.uint64, True) for r in rows]
        us, _, u_place = distinct_of(np.concatenate(firsts))
        vs, v_first, v_place = distinct_of(np.concatenate(seconds))
        v_count = np.concatenate([unpack(r["second_counts"], np.int64) for r in rows])[v_first]
        common = np.zeros(len(us), bool)
        common[u_place] = np.concatenate([unpack(r["common"], np.uint8) for r in rows]).astype(bool)
        u_at, v_at, keys, own_u = 0, 0, [], []
        for r, f, n, s in zip(rows, firsts, runs, seconds, strict=True):
            own_u.append(np.repeat(u_place[u_at : u_at + len(f)], n))
            which = unpack(r["which"], np.uint32).astype(np.int64)
            keys.append(own_u[-1] * len(vs) + v_place[v_at : v_at + len(s)][which])
            u_at, v_at = u_at + len(f), v_at + len(s)
        distinct, _, place = distinct_of(np.concatenate(keys).astype(np.uint64))
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate([unpack(r["train"], np.uint32) for r in rows]).astype(np.int64))
        u, v = np.divmod(distinct.astype(np.int64), len(vs))
        seen = total > 0
        low = np.zeros((len(us), K), np.int64)
        small = seen & (total <= K)
        np.add.at(low, (u[small], total[small] - 1), 1)
        covered = np.zeros(len(us))
        np.add.at(covered, u[seen], unigrams.probability(v_count[v[seen]]))
        out, at = [], 0
        for r, f, mine in zip(rows, firsts, own_u, strict=True):
            counts = total[place[at : at + len(mine)]]
            at += len(mine)
            edge = np.searchsorted(us, f)
            flat = ~low[edge].any(1)
            lacks = np.zeros(len(us), bool)
            lacks[mine[counts == 0]] = True
            wanted = lacks[edge] & ~common[edge]
            needs = [pack(np.packbits(flat)), pack(np.packbits(wanted)), *(pack(low[edge[wanted], i]) for i in range(K)), pack(covered[edge[wanted]].view(np.uint64))]
            out.append((r["block"], r["part"], pack(counts), _join(needs), None, None, None))
        out.append((-1, rows[0]["part"], None, None, _of_counts(total), None, None))
        for i in np.flatnonzero(common):
            out.append((-2, rows[0]["part"], None, None, low[i].tolist(), int(us[i].view(np.int64)), float(covered[i])))
        return _reply(out)

    return run


def _join(blobs: list[bytes]) -> bytes:
    return b"".join(len(b).to_bytes(8, "little") + b for b in blobs)


def _split(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


# --- trigrams -------------------------------------------------------------------------------


@dataclass(frozen=True)
class Bigrams:
    """What the driver knows beside the unigrams: a few numbers, and the spread words."""

    parts: int
    unigrams: Unigrams
    discount: tuple[float, ...]
    train_docs: int
    common: dict[int, tuple[list[int], float]]


def _damped(counts: np.ndarray, discount: tuple[float, ...]) -> np.ndarray:
    return np.array([1.0, *discount[1:], 1.0])[np.minimum(counts, K + 1)] * counts


class _Known:
    """A block with all that words' and bigrams' replies tell of it."""

    def __init__(self, block: dict, replies: list[dict], model: Bigrams):
        of_words, of_pairs = [r for r in replies if r["needs"] is None], sorted((r for r in replies if r["needs"] is not None), key=lambda r: r["part"])
        unigrams = model.unigrams
        self.vocabulary, self.counts, self.sequence, self.lengths, self.first, self.second, self.place, _, order, common = _pairs(block, of_words, model.parts, unigrams.total)
        context = self.counts.astype(np.float64)
        context[np.searchsorted(self.vocabulary, START)] = model.train_docs
        self.pair_count = np.empty(len(self.first), np.int64)
        taken = np.array([r * (1 - model.discount[r]) for r in range(1, K + 1)])
        flat, left_mass, rest = np.zeros(len(self.vocabulary), bool), np.ones(len(self.vocabulary)), np.ones(len(self.vocabulary))
        at = 0
        for r in of_pairs:
            blobs = _split(r["needs"])
            counts = unpack(r["counts"], np.int64)
            mine = order[at : at + len(counts)]
            at += len(counts)
            self.pair_count[mine] = counts
            own = self.first[mine]
            u = own[np.concatenate([[True], own[1:] != own[:-1]])]
            bits = [np.unpackbits(unpack(b, np.uint8))[: len(u)].astype(bool) for b in blobs[:2]]
            flat[u] = bits[0]
            need = u[bits[1]]
            low = np.stack([unpack(b, np.int64) for b in blobs[2 : 2 + K]], 1)
            left_mass[need] = (low * taken).sum(1)
            rest[need] = 1 - unpack(blobs[2 + K], np.uint64).view(np.float64)
        for i in np.flatnonzero(common):
            low, covered = model.common.get(int(self.vocabulary[i].view(np.int64)), ([0] * K, 0.0))
            flat[i] = not any(low)
            left_mass[i], rest[i] = (np.array(low) * taken).sum(), 1 - covered
        # where nothing is discounted, one more count is the mass of what was not seen
        self.over = context + flat
        left_mass = np.where(flat, 1.0, left_mass)
        p = unigrams.probability(self.counts)
        #: The probability of the second word of each bigram after its first.
        self.pair = p[self.second]
        with np.errstate(divide="ignore", invalid="ignore"):
            for seen in np.array_split(np.arange(len(self.first)), -(-len(self.first) // SLICE) or 1):
                u, v, n = self.first[seen], self.second[seen], self.pair_count[seen]
                known = _damped(n, model.discount) / self.over[u]
                backed = left_mass[u] / self.over[u] / rest[u] * p[v]
                self.pair[seen] = np.where(n > 0, known, np.where(context[u] > 0, backed, p[v]))
        del order, context, left_mass, rest, flat, p
        self._trigrams(model.parts)

    def _trigrams(self, parts: int) -> None:
        begin = np.cumsum(self.lengths) - self.lengths
        previous = np.empty(len(self.place), np.int32)
        previous[1:] = self.place[:-1]
        previous[begin] = 0
        often = self.pair_count >= LEAST_TRIGRAM
        #: Tokens behind a bigram that can begin a trigram of the model.
        self.behind = often[previous]
        self.behind[begin] = False
        tokens = np.flatnonzero(self.behind).astype(np.int32)
        pairs, which = _numbered(previous[tokens])
        del previous
        hashes = mix(mix(self.vocabulary[self.first[pairs]]) * np.uint64(0x9E3779B97F4A7C15) + self.vocabulary[self.second[pairs]])
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        #: The contexts, by their hashes, and the context of each token behind one.
        self.contexts, self.context_hash, self.context_of = pairs[order], hashes[order], rank[which]
        self.context_part = part_of(self.context_hash, parts)
        del pairs, which, hashes, order, rank
        able = often[self.place[tokens]]
        self.able = tokens[able]
        del tokens
        #: Distinct trigrams that can be of the model: (context, bigram of its last two words), by context.
        width = np.int64(max(len(self.first), 1))
        trigrams = self.context_of[able].astype(np.int64)
        trigrams *= width
        trigrams += self.place[self.able]
        key, self.trigram_of = _numbered(trigrams)
        del trigrams, able
        self.trigram_context, self.trigram_pair = (x.astype(np.int32) for x in np.divmod(key, width))


ASKED3 = "part int, block long, body binary"
_ASKED3_TYPES = [pa.int32(), pa.int64(), pa.binary()]


def _asked3(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, _ASKED3_TYPES, strict=True)], names=["part", "block", "body"])


def _ask_trigrams(model: Bigrams, turn: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        rows = []
        for block in left.to_pylist():
            x = _Known(block, right.to_pylist(), model)
            train = np.repeat(~np.array(block["held"], bool), x.lengths)[x.able]
            counts = np.bincount(x.trigram_of[train], minlength=len(x.trigram_context))
            runs = np.bincount(x.trigram_context, minlength=len(x.contexts))
            cuts = np.searchsorted(x.context_part, np.arange(model.parts + 1))
            ends = np.concatenate([[0], np.cumsum(runs)])
            for p in np.flatnonzero(np.diff(cuts)):
                if p % ROUNDS != turn:
                    continue
                c, t = slice(cuts[p], cuts[p + 1]), slice(ends[cuts[p]], ends[cuts[p + 1]])
                pairs = x.trigram_pair[t]
                words, first, which = distinct_of(x.vocabulary[x.second[pairs]])
                # c(vw) and the denominator of v make P(w|v) of every trigram that training has
                over = x.over[x.second[x.contexts[c]]]
                body = [pack(x.context_hash[c], True), pack(runs[c].astype(np.uint32)), pack(over.astype(np.int64)),
                        pack(words, True), pack(which.astype(np.uint32)), pack(counts[t].astype(np.uint32)), pack(x.pair_count[pairs])]
                rows.append((int(p), block["block"], _join(body)))
        return _asked3(rows)

    return run


def _sum_trigrams(model: Bigrams):
    """Corpus counts of trigrams, and for each context what alpha is made of: how many trigrams of
    the model occur so often, up to ``K`` and more often, and the mass that P(.|v) gives them."""

    def run(table: pa.Table) -> pa.Table:
        lean()
        rows = [(r["block"], _split(r["body"])) for r in table.to_pylist()]
        part = table.column("part")[0].as_py()
        contexts = [unpack(b[0], np.uint64, True) for _, b in rows]
        runs = [unpack(b[1], np.uint32).astype(np.int64) for _, b in rows]
        us, u_first, u_place = distinct_of(np.concatenate(contexts))
        over = np.concatenate([unpack(b[2], np.int64) for _, b in rows])[u_first]
        ws, _, w_place = distinct_of(np.concatenate([unpack(b[3], np.uint64, True) for _, b in rows]))
        u_at, w_at, keys = 0, 0, []
        for (_, b), f, n in zip(rows, contexts, runs, strict=True):
            words = len(unpack(b[3], np.uint64, True))
            keys.append(np.repeat(u_place[u_at : u_at + len(f)], n) * max(len(ws), 1) + w_place[w_at : w_at + words][unpack(b[4], np.uint32).astype(np.int64)])
            u_at, w_at = u_at + len(f), w_at + words
        distinct, first, place = distinct_of(np.concatenate(keys).astype(np.uint64))
        total = np.zeros(len(distinct), np.int64)
        np.add.at(total, place, np.concatenate([unpack(b[5], np.uint32) for _, b in rows]).astype(np.int64))
        total[total < LEAST_TRIGRAM] = 0
        u = distinct.astype(np.int64) // max(len(ws), 1)
        pair_count = np.concatenate([unpack(b[6], np.int64) for _, b in rows])[first]
        seen = total > 0
        low, more, covered = np.zeros((len(us), K), np.int64), np.zeros(len(us), np.int64), np.zeros(len(us))
        small = seen & (total <= K)
        np.add.at(low, (u[small], total[small] - 1), 1)
        np.add.at(more, u[total > K], total[total > K])
        with np.errstate(divide="ignore", invalid="ignore"):
            np.add.at(covered, u[seen], (_damped(pair_count, model.discount) / over[u])[seen])
        out, at, u_at = [], 0, 0
        for (block, _), f, n in zip(rows, contexts, runs, strict=True):
            mine, edge = place[at : at + int(n.sum())], u_place[u_at : u_at + len(f)]
            at, u_at = at + len(mine), u_at + len(f)
            needs = [*(pack(low[edge, i]) for i in range(LEAST_TRIGRAM - 1, K)), pack(more[edge]), pack(covered[edge].view(np.uint64))]
            out.append((block, part, pack(total[mine]), _join(needs), None, -3, None))
        out.append((-1, part, None, None, _of_counts(total), None, None))
        return _reply(out)

    return run


# --- scores ---------------------------------------------------------------------------------


def trigram_discounts(of_counts: list[int]) -> np.ndarray:
    """d[0..K] from how many trigrams occur 1, 2, ... K + 1 times: (r + 1) n(r + 1) / (r n(r)).

    The model has none that occur once, which leaves Katz's share of them undefined, so the plain
    Good-Turing ratio stands. Where it is not in (0, 1), half a count is taken off.
    """
    n = [0, *of_counts]
    d = np.array([1.0] + [(r - 0.5) / r for r in range(1, K + 1)])
    for r in range(LEAST_TRIGRAM, K + 1):
        if n[r] and 0 < (value := (r + 1) * n[r + 1] / (r * n[r])) < 1:
            d[r] = value
    return d


def _score(model: Bigrams, discount: np.ndarray):
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        blocks = left.to_pylist()
        if not blocks:
            return pa.Table.from_arrays([pa.array([], t) for t in types], names=names)
        (block,), unigrams = blocks, model.unigrams
        replies = right.to_pylist()
        x = _Known(block, [r for r in replies if r["word"] != -3], model)
        of_trigrams = sorted((r for r in replies if r["word"] == -3), key=lambda r: r["part"])
        found = [_split(r["needs"]) for r in of_trigrams]
        count = np.concatenate([np.zeros(0, np.int64), *(unpack(r["counts"], np.int64) for r in of_trigrams)])
        del replies, of_trigrams
        gather = lambda i, dtype: np.concatenate([np.zeros(0, dtype), *(unpack(b[i], dtype) for b in found)])
        more, covered = gather(K + 1 - LEAST_TRIGRAM, np.int64), gather(K + 2 - LEAST_TRIGRAM, np.uint64).view(np.float64)
        held, kept = np.zeros(len(more), np.int64), np.zeros(len(more))
        for r in range(LEAST_TRIGRAM, K + 1):
            low = gather(r - LEAST_TRIGRAM, np.int64)
            held += r * low
            kept += r * discount[r] * low
        del found, low
        held += more
        kept += more
        context = x.pair_count[x.contexts]
        # where the trigrams of a context leave nothing, one more count is the mass of what was not seen
        full = (held == context) & (kept == held)
        over = (context + full).astype(np.float64)
        p = x.pair[x.place]
        if len(x.contexts):
            alpha = (1 - kept / over) / (1 - covered)
            p[x.behind] *= alpha[x.context_of]
            damped = _damped(count, tuple(discount)) / over[x.trigram_context]
            hit = count[x.trigram_of] > 0
            p[x.able[hit]] = damped[x.trigram_of[hit]]
        np.log10(p, out=p)
        documents, lengths, sequence, counts = len(x.lengths), x.lengths, x.sequence, x.counts
        del x
        docs = np.repeat(np.arange(documents), lengths)
        base = np.log10((counts + 1) / (unigrams.total + unigrams.distinct + 1))
        columns = [
            block["ids"], block["held"], lengths, np.bincount(docs[(counts > 0)[sequence]], minlength=documents), np.full(documents, unigrams.total),
            np.bincount(docs, base[sequence], documents), np.bincount(docs, p, documents),
        ]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Training uses the documents whose crc32 of the id as text is not 2 modulo 7; the others are
    held out. Words are lower-cased (A-Z) and split at ASCII white space; every text ends in one
    end token, so a null or empty text is that token alone. ``base_score`` is the add-one
    unigram, ``score`` the Katz model; both are sums of log10 over the tokens. Rows that repeat an
    id count as documents each; a null id is trained on. Other columns are not read; an empty
    table gives no rows.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("__text"))
    blocks = written(slim.mapInArrow(_blocks, BLOCK))
    parts = max(1, -(-(blocks.agg(F.sum("tokens")).first()[0] or 0) // PART_TOKENS))

    asked = blocks.select("block", "held", "lengths", "vocabulary", "sequence").mapInArrow(_ask_words(parts), "part int, block long, words binary, train binary")
    of_words = written(asked.groupBy("part").applyInArrow(_sum_words, REPLY))
    release(docs.sparkSession)
    total, distinct, *of_counts = _totals(of_words, K + 3)
    unigrams = Unigrams(total, distinct, tuple(discounts(of_counts)), tuple(of_counts[:K]))

    replies = of_words.filter("block >= 0")
    pairs = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_ask_pairs(parts, total), ASKED)
    of_pairs = written(pairs.groupBy("part").applyInArrow(_sum_pairs(unigrams), REPLY))
    pair_discount = discounts(_totals(of_pairs, K + 1))
    train_docs = blocks.select(F.explode("held").alias("h")).agg(F.count_if(~F.col("h"))).first()[0]
    spread = of_pairs.filter("block = -2").groupBy("word").agg(F.array(*(F.sum(F.col("stats")[i]) for i in range(K))).alias("low"), F.sum("covered").alias("covered"))
    common = {r["word"]: (list(r["low"]), r["covered"]) for r in spread.toLocalIterator()}  # see LEAST_SHARE
    model = Bigrams(parts, unigrams, tuple(pair_discount), train_docs, common)
    release(docs.sparkSession)

    answers = replies.unionByName(of_pairs.filter("block >= 0"))
    rounds = []
    for turn in range(ROUNDS):
        trigrams = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_ask_trigrams(model, turn), ASKED3)
        rounds.append(written(trigrams.groupBy("part").applyInArrow(_sum_trigrams(model), REPLY)))
        del trigrams
        release(docs.sparkSession, times=3)
    of_trigrams = reduce(DataFrame.unionByName, rounds)
    discount = trigram_discounts(_totals(of_trigrams, K + 1))
    release(docs.sparkSession, times=5)
    answers = answers.unionByName(of_trigrams.filter("block >= 0"))
    result = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    # blocks are scored in as many rounds, so that only a share of all tables is in shuffle files beside them
    turns = []
    for turn in range(ROUNDS):
        own = F.pmod(F.xxhash64("block"), F.lit(ROUNDS)) == turn
        scored = blocks.filter(own).groupBy("block").cogroup(answers.filter(own).groupBy("block")).applyInArrow(_score(model, discount), result)
        turns.append(written(scored))
        del scored
        release(docs.sparkSession, times=3)
    return reduce(DataFrame.unionByName, turns)


def _totals(replies: DataFrame, n: int) -> list[int]:
    row = replies.filter("block = -1").agg(*(F.sum(F.col("stats")[i]) for i in range(n))).first()
    return [int(x or 0) for x in row]
