"""Benchmark decontamination by pigeonhole edit matching.

An item of m code points may differ by k = floor(m * max_error_rate) edits. Cut into k + 1 pieces, one piece at least
occurs unchanged wherever the item occurs within k edits. All pieces of a block of items go into one Aho-Corasick automaton, each
whole document runs through it once, and around every piece hit the item is verified with Myers' bit-parallel distance.
Items shorter than a bound have no budget and must stand on word boundaries. Items go out in blocks of bounded size, so nothing that is sent to the executors grows with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ..cluster import ship

SCHEMA = "doc_id long, item_id long, distance int, match_start long, match_end long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("match_start", pa.int64()), ("match_end", pa.int64())])
#: Code points of item text in one block.
BLOCK_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    """Lower case, white space runs as one space."""
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 pieces of nearly equal length that make up the item."""
    n, m = budget + 1, len(item)
    cuts = [m * j // n for j in range(n + 1)]
    return [(cuts[j], item[cuts[j] : cuts[j + 1]]) for j in range(n)]


def myers(peq: dict[str, int], m: int, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best occurrence of a pattern of length m in ``text``: the least distance, then the first end."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, None
    for at, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & mask
        mh = mh << 1 & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score <= budget and (best is None or score < best[0]):
            best = (score, at)
            if not score:
                break
    return best


def begin(item: str, text: str, end: int, distance: int) -> int:
    """Where an occurrence of ``item`` that ends at ``end`` with ``distance`` edits begins: the same, backwards from its end.

    Of several beginnings the one that makes the occurrence most nearly as long as the item, then the longer one.
    """
    m = len(item)
    peq, mask, top = masks(item[::-1]), (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, found = mask, 0, m, []
    for n, c in enumerate(text[max(0, end - m - distance) : end][::-1], 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        score += 1 if ph & top else -1 if mh & top else 0
        ph = (ph << 1 | 1) & mask  # the occurrence ends here: text before it is not free
        mh = mh << 1 & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score == distance:
            found.append(n)
    return end - min(found, key=lambda n: (abs(n - m), -n))


def masks(item: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def bounded(text: str, start: int, end: int) -> bool:
    """Whether no word of the text goes on over either edge of a stretch."""
    return not (start > 0 and text[start - 1].isalnum() and text[start].isalnum()) and not (end < len(text) and text[end - 1].isalnum() and text[end].isalnum())


class Matcher:
    """The automaton of one block of items: (item_id, normalised text)."""

    def __init__(self, items: list[tuple[int, str]], max_error_rate: float, min_chars: int):
        self.items, self.rate, self.min_chars = items, max_error_rate, min_chars
        self.built = None

    def __getstate__(self) -> dict:
        return {"items": self.items, "rate": self.rate, "min_chars": self.min_chars, "built": None}

    def build(self) -> None:
        where: dict[str, list[tuple[int, int]]] = {}
        self.budgets = [int(len(t) * self.rate) if len(t) >= self.min_chars else 0 for _, t in self.items]
        for i, (_, t) in enumerate(self.items):
            for offset, piece in pieces(t, self.budgets[i]):
                where.setdefault(piece, []).append((i, offset))
        self.built = ahocorasick.Automaton()
        for piece, at in where.items():
            self.built.add_word(piece, (len(piece), at))
        self.built.make_automaton()
        self.masks: dict[int, dict[str, int]] = {}

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item_id, distance, start, end) of the best occurrence of each item in a normalised text."""
        if self.built is None:
            self.build()
        hits: dict[int, set[int]] = {}
        for end, (size, at) in self.built.iter(text):
            for i, offset in at:
                hits.setdefault(i, set()).add(end + 1 - size - offset)
        out = []
        for i, starts in hits.items():
            item_id, item = self.items[i]
            m, k = len(item), self.budgets[i]
            short = m < self.min_chars
            exact = next((s for s in sorted(starts) if s >= 0 and text.startswith(item, s) and (not short or bounded(text, s, s + m))), None)
            if exact is not None:
                out.append((item_id, 0, exact, exact + m))
                continue
            if short:
                continue
            if i not in self.masks:
                self.masks[i] = masks(item)
            best, done = None, -1
            for s in sorted(starts):  # windows that overlap are searched once
                low, high = max(s - k, done, 0), min(s + m + 2 * k, len(text))
                if s + m + k <= done or low >= high:
                    continue
                low = max(0, s - k) if done < 0 else max(0, min(s - k, done - m - 2 * k))
                got = myers(self.masks[i], m, text[low:high], k)
                done = high
                if got and (best is None or got[0] < best[0]):
                    best = (got[0], low + got[1])
            if best:
                out.append((item_id, best[0], begin(item, text, best[1], best[0]), best[1]))
        return out


def _scan(batches: Iterator[pa.RecordBatch], matcher: Matcher) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            text = normalise(text.as_py())
            if text:
                rows += [(doc_id, *hit) for hit in matcher.find(text)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        item = normalise(row.text)
        if not item:
            continue
        block.append((row.item_id, item))
        size += len(item)
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, max_error_rate: float = 0.05, min_chars: int = 30, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, distance, match_start, match_end) for every document and item that occurs in it within its budget.

    Both texts are compared in lower case with white space runs as one space; positions are those of the document so
    normalised, of the best occurrence (least distance, then first). Items shorter than ``min_chars`` normalised code points match
    where they occur unchanged and no word goes on over their edges. Null and empty items and documents match nothing. Rows that repeat a doc_id or
    item_id each bring their matches; a null id is carried as null. Empty tables give no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    given, out = docs.select("doc_id", "text"), None
    for block in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Matcher(block, max_error_rate, min_chars))
        part = given.mapInArrow(lambda it, shared=shared: _scan(it, shared.value), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, max_error_rate: float = 0.05, min_chars: int = 30, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item occurs; see ``decontaminate``. Nothing is shuffled."""
    ship(docs.sparkSession)
    for block in blocks(benchmark, block_chars):
        shared = docs.sparkSession.sparkContext.broadcast(Matcher(block, max_error_rate, min_chars))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not shared.value.find(normalise(t.as_py())) for t in batch.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
