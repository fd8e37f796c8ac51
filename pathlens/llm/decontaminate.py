"""Benchmark decontamination by pigeonhole edit matching.

Item and text are normalised (lower-case words joined by single blanks). A
passage within ``k`` edits of an item of n characters must contain at least one
of the item's ``k + 1`` pieces unchanged. One automaton finds all pieces of all
items in a pass over each text; hits of an item on neighbouring diagonals give a
stretch of text, and Myers' bit-parallel algorithm computes the least edit
distance of the item to any passage there.

Items are a stated query set. They go to the tasks in blocks of at most
``BLOCK_CHARS`` characters, one automaton each and one block at a time, so what
the driver and a task hold is bounded however many items there are; every block
meets every text.

Defined cases: null texts and items count as empty; items whose normalised form
has fewer than ``LEAST_CHARS`` characters match without edits and as whole words
only; items without any word match nothing; equal items are matched each; null ids are kept; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowkit
from .work import Work, text_of

#: Edits allowed per character of an item.
BUDGET = 0.08
LEAST_CHARS = 24
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"\w+")


def normal(text: str) -> str:
    return " ".join(WORD.findall(text.lower()))


def pieces(item: str, budget: float = BUDGET) -> tuple[int, list[tuple[int, str]]]:
    """The edit budget of an item, and its pieces with their places."""
    k = int(len(item) * budget)
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return k, [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """An item for Myers' algorithm."""

    def __init__(self, item: str):
        self.item, self.n = item, len(item)
        self.bits: dict[str, int] = {}
        for i, c in enumerate(item):
            self.bits[c] = self.bits.get(c, 0) | 1 << i
        self.all, self.top = (1 << self.n) - 1, 1 << (self.n - 1)

    def best(self, text: str, anchored: bool = False) -> tuple[int, int]:
        """Least distance of the item to a passage of ``text``, and where the first such passage
        ends; if ``anchored``, of the passages that begin where ``text`` begins."""
        up, down, score = self.all, 0, self.n
        best, end = score, 0
        bits, full, top, step = self.bits, self.all, self.top, int(anchored)
        for at, c in enumerate(text, 1):
            eq = bits.get(c, 0)
            x = eq | down
            d0 = ((((eq & up) + up) ^ up) | x) & full
            right_up, right_down = (down | ~(d0 | up)) & full, up & d0
            if right_up & top:
                score += 1
            elif right_down & top:
                score -= 1
            right_up, right_down = (right_up << 1 | step) & full, right_down << 1 & full
            up, down = (right_down | ~(d0 | right_up)) & full, right_up & d0
            if score < best:
                best, end = score, at
        return best, end


class Matcher:
    """One block of items: (id, normalised text)."""

    def __init__(self, items: list[tuple[int, str]], budget: float):
        import ahocorasick

        self.items = [(i, t, *pieces(t, budget if len(t) >= LEAST_CHARS else 0.0)) for i, t in items if t]
        self.patterns: dict[int, Pattern] = {}
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for number, (_, _, _, parts) in enumerate(self.items):
            for place, piece in parts:
                where.setdefault(piece, []).append((number, place))
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item id, edits, start, end) of every item that the normalised text holds, its best passage."""
        if not self.items:
            return []
        spots: dict[int, list[int]] = {}
        for end, (n, places) in self.automaton.iter(text):
            for number, place in places:
                spots.setdefault(number, []).append(end + 1 - n - place)
        out = []
        for number, diagonals in spots.items():
            item_id, item, k, parts = self.items[number]
            if len(item) < LEAST_CHARS:
                # words are joined by single blanks
                at = next((d for d in diagonals if text[d - 1 : d] in ("", " ") and text[d + len(item) : d + len(item) + 1] in ("", " ")), None)
                if at is not None:
                    out.append((item_id, 0, at, at + len(item)))
                continue
            if item in text:
                at = text.index(item)
                out.append((item_id, 0, at, at + len(item)))
                continue
            diagonals.sort()
            best, first, last = (k + 1, 0), diagonals[0], diagonals[0]
            for d in [*diagonals[1:], None]:
                if d is not None and d - last <= 2 * k + 1:
                    last = d
                    continue
                low = max(0, first - k)
                if number not in self.patterns:
                    self.patterns[number] = Pattern(item)
                found, end = self.patterns[number].best(text[low : last + len(item) + k])
                best = min(best, (found, low + end))
                if d is not None:
                    first = last = d
            if best[0] <= k:
                # the same distance backwards from where the passage ends gives its start
                before = text[max(0, best[1] - len(item) - k) : best[1]]
                out.append((item_id, best[0], best[1] - Pattern(item[::-1]).best(before[::-1], anchored=True)[1], best[1]))
        return out


def _matches(batches, items, budget: float):
    matcher = Matcher(items.value, budget)
    for batch, texts in arrowkit.pieces(batches, "text"):
        rows: list[tuple] = []
        for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts):
            rows += [(doc_id, key, *hit) for hit in matcher.find(normal(text))]
        columns = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_key", "item_id", "edits", "start", "end"])


def _unleaked(batches, items, budget: float):
    matcher = Matcher(items.value, budget)
    for batch, texts in arrowkit.pieces(batches, "text"):
        yield batch.filter(pa.array([not matcher.find(normal(text)) for text in texts], pa.bool_()))


def item_blocks(benchmark: DataFrame):
    """Lists of (item_id, normalised text) of bounded size, one after the other, and whether it is the last."""
    held, size = [], 0
    for row in benchmark.select("item_id", text_of(benchmark).alias("text")).toLocalIterator():
        text = normal(row.text)
        if held and size + len(text) > BLOCK_CHARS:
            yield held, False
            held, size = [], 0
        held.append((row.item_id, text))
        size += len(text)
    yield held, True


def matches(documents: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """One row per document and item found in it: doc_id, text_key, item_id, edits, and the
    passage's start and end among the characters of the normalised text (of the passages with the
    fewest edits the one that ends first, and of these the shortest)."""
    spark = documents.sparkSession
    source = documents.select("doc_id", F.xxhash64(text_of(documents)).alias("text_key"), text_of(documents).alias("text"))
    found, work = None, Work(spark, "matches")
    for block, last in item_blocks(benchmark):
        items = spark.sparkContext.broadcast(block)
        part = source.mapInArrow(partial(_matches, items=items, budget=budget), "doc_id long, text_key long, item_id long, edits long, start long, end long")
        if not last:
            # so that driver and tasks hold one block at a time
            part = work.save(part, "block")
            items.destroy()
        found = part if found is None else found.unionByName(part)
    return found


def clean(documents: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The documents in which no item is found, columns as given; nothing is exchanged."""
    spark = documents.sparkSession
    kept, held, work = documents, None, Work(spark, "clean")
    for block, last in item_blocks(benchmark):
        items = spark.sparkContext.broadcast(block)
        kept = kept.mapInArrow(partial(_unleaked, items=items, budget=budget), documents.schema)
        if not last:
            kept = work.save(kept, "block")
            items.destroy()
            if held is not None:
                work.drop(held)
            held = kept
    return kept
