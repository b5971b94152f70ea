"""Token ids of whole texts with a published tokenizer, each distinct unit encoded once.

A byte-level BPE splits a text into pieces before it merges, and no piece reaches from a
non-space character over the ASCII space that follows it. So the ids of a text are those of its
units (a run of ASCII spaces and the word behind it) one after another. Units are found and
hashed with arrays, and only distinct ones go to the tokenizer. Texts for which that argument
would not hold (a word that ends in a non-ASCII space; a special token's string) are one unit.
"""

from __future__ import annotations

import json
import os

import numpy as np

from eventlake.llm.bytetext import Spans, distinct_of, words

#: Units that a worker remembers; about 30 bytes each.
REMEMBERED = 1_000_000
#: Units remembered lately, which join the others when they are so many.
LATELY = 100_000


class _Known:
    """Sorted hashes of units and where their ids lie in the pool."""

    def __init__(self):
        self.hashes, self.begin, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def add(self, hashes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.begin, self.length = np.insert(self.hashes, at, hashes), np.insert(self.begin, at, begin), np.insert(self.length, at, length)

    def look_up(self, hashes: np.ndarray, todo: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Fills in what is known of the places ``todo`` and returns the others."""
        if not len(self.hashes):
            return todo
        at = np.minimum(np.searchsorted(self.hashes, hashes[todo]), len(self.hashes) - 1)
        hit = self.hashes[at] == hashes[todo]
        begin[todo[hit]], length[todo[hit]] = self.begin[at[hit]], self.length[at[hit]]
        return todo[~hit]


class UnitEncoder:
    """Encodes slices of texts with the tokenizer file at ``path``; one per Python worker."""

    _own: dict[str, UnitEncoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        pre = spec.get("pre_tokenizer") or {}
        #: Only for this kind do units encode as they do within their text.
        self.by_unit = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        #: Bytes of each id: the vocabulary spells one character for every byte.
        self.width = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        for t in spec.get("added_tokens", []):
            self.width[t["id"]] = len(t["content"].encode())
        self.known, self.lately = _Known(), _Known()
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    @classmethod
    def at(cls, path: str) -> UnitEncoder:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def _whole(self, data: np.ndarray, off: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Texts to encode as one unit."""
        whole = np.zeros(len(off) - 1, bool)
        if not self.by_unit:
            whole[:] = True
            return whole
        pad = np.concatenate([np.zeros(3, np.uint8), data])
        a, b, c = pad[ends], pad[ends + 1], pad[ends + 2]  # the last three bytes of each word
        odd = (b == 0xC2) & ((c == 0x85) | (c == 0xA0))
        odd |= (a == 0xE2) & (b == 0x80) & ((c <= 0x8A) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF))
        odd |= (a == 0xE2) & (b == 0x81) & (c == 0x9F)
        odd |= ((a == 0xE1) & (b == 0x9A) | (a == 0xE3) & (b == 0x80)) & (c == 0x80)
        if odd.any():
            whole[np.searchsorted(at, np.flatnonzero(odd), "right") - 1] = True
        raw = None
        for s in self.special:
            raw = data.tobytes() if raw is None else raw
            p = raw.find(s)
            while p >= 0:
                whole[np.searchsorted(off, p, "right") - 1] = True
                p = raw.find(s, p + 1)
        return whole

    def units(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the units, and where each text's units begin."""
        _, ends, at = words(data, off)
        n = len(off) - 1
        cuts = [ends, off[1:]]
        whole = self._whole(data, off, ends, at)
        if whole.any():
            cuts[0] = ends[~np.repeat(whole, np.diff(at))]
        ends = np.sort(np.concatenate(cuts))
        starts = np.concatenate([[0], ends[:-1]])
        some = ends > starts
        starts, ends = starts[some], ends[some]
        return starts, ends, np.searchsorted(starts, off[: n + 1])

    def _encode_units(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all ``strings`` and how many each has, told apart by the bytes they spell."""
        if not self.by_unit:
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]
            return np.concatenate([np.array(x, np.uint32) for x in ids]), np.array([len(x) for x in ids], np.int64)
        calls = [strings[i : i + 1000] for i in range(0, len(strings), 1000)]
        found = self.tokenizer.encode_batch_fast(calls, is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        spelled = np.cumsum(self.width[ids])
        stops = np.searchsorted(spelled, np.cumsum([len(s.encode()) for s in strings])) + 1
        return ids, np.diff(stops, prepend=0)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's ids begin."""
        begin, lengths, pool, at = self._looked_up(data, off)
        stops = np.concatenate([[0], np.cumsum(lengths)])
        return pool[np.arange(stops[-1]) + np.repeat(begin - stops[:-1], lengths)], stops[at]

    def count(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """How many ids each text has."""
        _, lengths, _, at = self._looked_up(data, off)
        return np.diff(np.concatenate([[0], np.cumsum(lengths)])[at])

    def _looked_up(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where in a pool each unit's ids begin and how many there are, the pool, and where each text's units begin."""
        starts, ends, at = self.units(data, off)
        distinct, first, inverse = distinct_of(Spans(data).hashes(starts, ends))
        if not len(distinct):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        begin, length = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
        new = self.known.look_up(distinct, np.arange(len(distinct)), begin, length)
        new = self.lately.look_up(distinct, new, begin, length)
        if not len(new):
            return begin[inverse], length[inverse], self.pool, at
        raw = data.tobytes()
        strings = [raw[s:e].decode("utf-8", "replace") for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        ids, lengths = self._encode_units(strings)
        length[new] = lengths
        begin[new] = self.used + np.cumsum(lengths) - lengths
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(self.pool), len(ids)), np.uint32)])
        pool = self.pool
        pool[self.used : self.used + len(ids)] = ids
        if len(self.known.hashes) + len(self.lately.hashes) < REMEMBERED:
            self.used += len(ids)
            self.lately.add(distinct[new], begin[new], length[new])
            if len(self.lately.hashes) >= LATELY:
                self.known.add(self.lately.hashes, self.lately.begin, self.lately.length)
                self.lately = _Known()
        return begin[inverse], length[inverse], pool, at
