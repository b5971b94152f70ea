"""Benchmark items inside documents, up to an edit distance.

An item with an error budget of k edits is cut into k + 1 pieces; an occurrence within the budget
holds at least one piece unchanged (pigeonhole). One automaton finds all pieces of all items in
one pass over a text, and every stretch a piece points to is verified with the bit-parallel
edit distance of Myers. Items are the stated query set: they are handled in blocks of bounded
size, each against all documents, and documents are never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of items in one block, which bounds the driver's and each task's automaton.
BLOCK_CHARS = 8_000_000
#: Characters of an item for each edit it may suffer: 5 per cent.
CHARS_PER_EDIT = 20
#: Shorter items (normalised) are found only as they are and on word boundaries.
LEAST_CHARS = 16
#: Scripts that set no space between words: beside their characters any place is a boundary.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")

HITS = "doc_id long, item_id long, distance int, start long, stop long"


def normalise(text: str | None) -> str:
    """Lower case, each run of white space one space, none at the ends."""
    return " ".join(text.lower().split()) if text else ""


def _in_word(c: str) -> bool:
    """Whether a word may go on beside ``c``."""
    return c == "_" or unicodedata.category(c)[0] in "LNM" and not _UNSPACED.match(c)


def bounded(text: str, start: int, stop: int) -> bool:
    """Whether ``text[start:stop]`` begins and ends on word boundaries."""
    cuts = lambda at: 0 < at < len(text) and _in_word(text[at - 1]) and _in_word(text[at])
    return not cuts(start) and not cuts(stop)


def myers(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of ``pattern`` in ``text``, the first of equals; None beyond ``most``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    plus, minus, score = full, 0, m
    best, end = most + 1, 0
    for j, c in enumerate(text):
        same = masks.get(c, 0)
        down = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        rise = minus | ~(across | plus) & full
        fall = plus & across
        if rise & top:
            score += 1
        elif fall & top:
            score -= 1
            if score < best:
                best, end = score, j + 1
                if not best:
                    break
        rise, fall = rise << 1 & full, fall << 1 & full
        plus = fall | ~(down | rise) & full
        minus = rise & down
    return (best, end) if best <= most else None


class Finder:
    """The items of one block, ready to search."""

    def __init__(self, items: list[tuple[int, str]], chars_per_edit: int):
        self.items = [(i, text, len(text) // chars_per_edit if len(text) >= LEAST_CHARS else 0) for i, text in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for n, (_, text, budget) in enumerate(self.items):
            cuts = [len(text) * p // (budget + 1) for p in range(budget + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if b > a:
                    pieces.setdefault(text[a:b], []).append((n, a))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def hits(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, distance, start, stop) of the best occurrence of each item in a normalised text."""
        stretches: dict[int, list[list[int]]] = {}
        if len(text) == 0 or not self.items:
            return []
        for last, (length, places) in self.automaton.iter(text):
            for n, at in places:
                _, item, budget = self.items[n]
                begin = last + 1 - length - at
                if len(item) < LEAST_CHARS and not bounded(text, begin, begin + length):
                    continue
                low, high = max(0, begin - budget), min(len(text), begin + len(item) + budget)
                known = stretches.setdefault(n, [])
                if known and low <= known[-1][1] and high >= known[-1][0]:
                    known[-1] = [min(known[-1][0], low), max(known[-1][1], high)]
                else:
                    known.append([low, high])
        out = []
        for n, spans in stretches.items():
            item_id, item, budget = self.items[n]
            best = None
            for low, high in spans:
                at = text.find(item, low, high)
                found = (0, at + len(item) - low) if at >= 0 else myers(item, text[low:high], budget)
                if found and (best is None or found[0] < best[0]):
                    best = (found[0], low, low + found[1])
                    if not found[0]:
                        break
            if best:
                distance, low, stop = best
                # the same search backwards from the end tells where the occurrence starts
                back = myers(item[::-1], text[low:stop][::-1], distance) if distance else (0, len(item))
                out.append((item_id, distance, stop - back[1], stop))
        return out


def _search(items: list[tuple[int, str]], chars_per_edit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(items, chars_per_edit)
        names = [x.split()[0] for x in HITS.split(", ")]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            rows = [(doc.as_py(), *hit) for doc, text in zip(batch.column(0), batch.column(1), strict=True) for hit in finder.hits(normalise(text.as_py()))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", chars_per_edit: int = CHARS_PER_EDIT, least_chars: int = 1, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row (doc_id, item_id, distance, start, stop) per document and item within the budget.

    Texts are compared in lower case with white space collapsed, in which form ``start`` and
    ``stop`` count characters. An item of n characters may differ by n // chars_per_edit edits;
    its best occurrence is reported, of ties the first. Every block of items is one more pass over the
    documents. Null and empty texts and items match nothing, nor do items
    below ``least_chars``. Items of fewer than LEAST_CHARS characters count where they stand unchanged
    and on word boundaries. Repeated documents or items give repeated rows. Further columns are not
    read; either table may be empty.
    """
    items = benchmark.select(F.col(item_id_col).cast("long").alias("i"), F.coalesce(F.col(item_text_col).cast("string"), F.lit("")).alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    out = None
    for b in range(blocks):
        block = [(r["i"], text) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect() if len(text := normalise(r["t"])) >= least_chars]
        found = slim.mapInArrow(_search(sorted(block, key=str), chars_per_edit), HITS)
        out = found if out is None else out.unionAll(found)
    return out
