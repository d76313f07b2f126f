"""Packing of documents into token sequences by non-negative least squares over a histogram of lengths.

A document's ids are cut by length alone: whole windows, then a body of a multiple of ``unit`` ids, then a tail shorter than a unit.
Two histograms are solved, each small whatever the corpus: tails into units by combinations of up to ``shallow`` lengths, then bodies
and the units made of tails into windows by combinations of up to ``deep`` multiples. Every combination that fills its container
exactly is a column, its repeat count an unknown, the histogram the right-hand side; counts are rounded, and what they leave over is
packed greedily, longest first, cut where a window ends. Only the last window may stay open; it becomes sequences of powers of two.

Histograms and the plan made of them are all that the driver sees. Pieces find their places by their rank among those of
their length: a count per task and length, summed over tasks, and the place within the task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text
from .store import Workspace

#: Pieces of words whose ids a Python worker remembers between slices and tasks: a bound on its memory, not on what is encoded.
REMEMBERED = 400_000
_encoders: dict[str, Encoder] = {}

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
#: Marks at which a run of letters ends and begins whatever the tokenizer's rules for apostrophes and special tokens are.
_MARK = np.zeros(256, bool)
_MARK[list(b'!"#$%&()*+,-./:;=?@[\\]^_`{}~')] = True


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as ``text.words`` has them, cut further between letters (a-z, and those of Latin-1) and marks."""
    starts, ends, at = text.words(data, offsets)
    latin = (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # their two bytes; not the signs of times and division
    closes, opens = _LETTER[data], _LETTER[data]
    closes[1:] |= latin
    opens[:-1] |= latin
    mark = _MARK[data]
    inner = np.flatnonzero((closes[:-1] & mark[1:]) | (mark[:-1] & opens[1:])) + 1
    inner = inner[~np.isin(inner, offsets)]  # texts lie side by side
    starts, ends = np.sort(np.append(starts, inner)), np.sort(np.append(ends, inner))
    return starts, ends, np.searchsorted(starts, offsets)


class Known:
    """Ids of pieces by their bytes: hashes in order, each with where its bytes and its ids lie."""

    def __init__(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.place = np.zeros((0, 4), np.int64)  # start and length of the bytes, of the ids
        self.bytes, self.ids = np.zeros(0, np.uint8), np.zeros(0, np.uint32)

    def find(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Row of each piece, -1 where it is not known; bytes are compared."""
        if not len(self.hash) or not len(h):
            return np.full(len(h), -1)
        row = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        n = ends - starts
        hit = np.flatnonzero((self.hash[row] == h) & (self.place[row, 1] == n))
        both = np.concatenate([self.bytes, data])
        fine = hit[text.same_bytes(both, self.place[row[hit], 0], len(self.bytes) + starts[hit], n[hit])]
        out = np.full(len(h), -1)
        out[fine] = row[fine]
        return out

    def add(self, h: np.ndarray, raw: list[bytes], ids: list[list[int]]) -> None:
        """New pieces; of two with one hash the first is remembered."""
        size, many = np.array([len(w) for w in raw], np.int64), np.array([len(i) for i in ids], np.int64)
        place = np.stack([len(self.bytes) + np.cumsum(size) - size, size, len(self.ids) + np.cumsum(many) - many, many], 1)
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(raw), np.uint8)])
        self.ids = np.concatenate([self.ids, np.fromiter((x for i in ids for x in i), np.uint32, int(many.sum()))])
        self.hash, first = np.unique(np.concatenate([self.hash, h]), return_index=True)
        self.place = np.concatenate([self.place, place])[first]


class Encoder:
    """Ids of whole texts by a tokenizer that splits words at white space and letters from marks: each distinct piece is encoded once.

    What is assumed of the tokenizer is tried on a probe when it is loaded; where that fails texts are encoded one by one.
    """

    PROBE = "The quick\tbrown FOX's 12 tails,\n\n(and more)... Été&naïve! x-ray can't, 'tis a.b.c 3.14%of $5 don't!"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = Known()
        data = _LOWER[np.frombuffer(self.PROBE.encode(), np.uint8)]
        starts, ends, _ = pieces(data, np.array([0, len(data)]))
        cut = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
        self.plain_letters = all(self._letters(w) == self._plain(w) for w in cut if w.isalpha() and w.isascii())
        self.by_piece = self._plain(self.PROBE.encode()) == [i for w in cut for i in self._plain(w)]
        #: A special token between pieces keeps their ids apart in one call.
        specials = sorted(i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special)
        self.mark = (specials[0], self.tokenizer.id_to_token(specials[0])) if specials else None

    def _plain(self, raw: bytes) -> list[int]:
        return self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids

    def _letters(self, raw: bytes) -> list[int]:
        return [t.id for t in self.model.tokenize(raw.decode())]

    def encode_pieces(self, raw: list[bytes]) -> list[list[int]]:
        """Ids of each piece: letters by the model alone, others in calls of a thousand, those that could hold a special token alone."""
        out: list[list[int]] = [[]] * len(raw)
        rest = []
        for k, w in enumerate(raw):
            if self.plain_letters and w.isalpha() and w.isascii():
                out[k] = self._letters(w)
            elif self.mark is None or b"<" in w:
                out[k] = self._plain(w)
            else:
                rest.append(k)
        for a in range(0, len(rest), 1000):
            some = rest[a : a + 1000]
            for k in some:
                out[k] = []
            told = iter(some)
            now = out[next(told)]
            for i in self._plain(self.mark[1].encode().join(raw[k] for k in some)):
                if i == self.mark[0]:
                    now = out[next(told)]
                else:
                    now.append(i)
        return out

    def encode(self, column: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text of an Arrow column, in order; null counts as empty."""
        for _, _, data, offsets in text.slices(column):
            if self.by_piece:
                yield from self._slice(data, offsets)
            else:
                yield from (np.array(self._plain(data[a:b].tobytes()), np.uint32) for a, b in zip(offsets[:-1], offsets[1:], strict=True))

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
        folded = _LOWER[data]
        starts, ends, at = pieces(folded, offsets)
        if not len(starts):
            yield from (np.zeros(0, np.uint32) for _ in range(len(offsets) - 1))
            return
        angles = np.flatnonzero(data == ord("<"))
        for k in np.unique(np.searchsorted(starts, angles, "right") - 1):  # what may hold a special token keeps its case
            folded[starts[k] : ends[k]] = data[starts[k] : ends[k]]
        every, first, which = np.unique(text.hashes(folded, starts, ends, fold=False), return_index=True, return_inverse=True)
        n, like, which_hash = ends - starts, first[which], which.copy()
        equal = n == n[like]
        equal[equal] = text.same_bytes(folded, starts[equal], starts[like[equal]], n[equal])
        # pieces that only share a hash with another are their own
        odd = np.flatnonzero(~equal)
        which[odd] = len(first) + np.arange(len(odd))
        first, every = np.append(first, odd), np.append(every, every[which_hash[odd]])
        row = self.known.find(every, folded, starts[first], ends[first])
        new = np.flatnonzero(row < 0)
        raw = [folded[a:b].tobytes() for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
        ids = self.encode_pieces(raw)
        many, begin = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        old = np.flatnonzero(row >= 0)
        begin[old], many[old] = self.known.place[row[old], 2], self.known.place[row[old], 3]
        many[new] = [len(i) for i in ids]
        begin[new] = len(self.known.ids) + np.cumsum(many[new]) - many[new]
        flat = np.concatenate([self.known.ids, np.fromiter((x for i in ids for x in i), np.uint32, int(many[new].sum()))])
        if len(self.known.hash) < REMEMBERED:
            self.known.add(every[new], raw, ids)
        each = many[which]
        total = np.append(0, np.cumsum(each))
        shift = np.repeat(begin[which] - total[:-1], each)
        out = flat[np.arange(total[-1]) + shift]
        cuts = total[at]
        yield from (out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- the plan -----------------------------------------------------------------------------------------------------


def combinations(window: int, depth: int, lengths: list[int]) -> list[dict[int, int]]:
    """Multisets of up to ``depth`` of ``lengths`` that fill ``window`` exactly, as how often each length occurs."""
    found: list[dict[int, int]] = []
    lengths = sorted(lengths, reverse=True)

    def grow(chosen: dict[int, int], room: int, left: int, most: int) -> None:
        if room == 0:
            found.append(dict(chosen))
            return
        for k in range(most, len(lengths)):
            n = lengths[k]
            if n * left < room:
                return
            if n <= room:
                chosen[n] = chosen.get(n, 0) + 1
                grow(chosen, room - n, left - 1, k)
                chosen[n] -= 1
                if not chosen[n]:
                    del chosen[n]

    grow({}, window, depth, 0)
    return found


def nnls(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 with the least |a x - b|, by the active-set method of Lawson and Hanson."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(float(np.abs(b).max(initial=0)), 1e-300)
    b = b / scale
    for _ in range(3 * max(a.shape)):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        k = int(gradient.argmax()) if len(gradient) else 0
        if not len(gradient) or gradient[k] <= 1e-9:
            break
        active[k] = True
        while True:
            z = np.zeros_like(x)
            z[active] = np.linalg.lstsq(a[:, active], b, rcond=None)[0]
            bad = active & (z <= 1e-12)
            if not bad.any():
                x = z
                break
            step = float((x[bad] / np.maximum(x[bad] - z[bad], 1e-300)).min())
            x = x + step * (z - x)
            active &= x > 1e-12
            x[~active] = 0
    return x * scale


def solve(histogram: dict[int, int], window: int, depth: int) -> list[tuple[dict[int, int], int]]:
    """(combination, repeats) from the histogram of lengths; together they use no length more often than there is."""
    left = {n: c for n, c in histogram.items() if c > 0}
    columns = combinations(window, depth, list(left))
    if not columns:
        return []
    row = {n: k for k, n in enumerate(sorted(left))}
    a = np.zeros((len(row), len(columns)))
    for k, c in enumerate(columns):
        for n, times in c.items():
            a[row[n], k] = times
    x = nnls(a, np.array([left[n] for n in sorted(left)], float))
    plan = []
    for k in np.argsort(-x, kind="stable"):
        repeats = min(int(round(x[k])), *(left[n] // times for n, times in columns[k].items()))
        if repeats > 0:
            plan.append((columns[k], repeats))
            for n, times in columns[k].items():
                left[n] -= repeats * times
    return plan


class Places:
    """Where the pieces of each length go: ranges of their ranks, each in a combination or in the stream of what is left over."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # length, from rank, pieces a container, first container, offset there, 1 for the stream

    def combine(self, plan: list[tuple[dict[int, int], int]], first: int, used: dict[int, int], by: int = 1) -> int:
        """Containers numbered from ``first`` for each repeat of each combination; the next free number."""
        for combination, repeats in plan:
            offset = 0
            for n, times in sorted(combination.items(), reverse=True):
                self.rows.append((n * by, used.get(n, 0), times, first, offset, 0))
                used[n] = used.get(n, 0) + repeats * times
                offset += n * times * by
            first += repeats
        return first

    def stream(self, length: int, rank: int, position: int) -> None:
        self.rows.append((length, rank, 1, position, 0, 1))

    def arrays(self) -> np.ndarray:
        return np.array(sorted(self.rows), np.int64).reshape(-1, 6)


def find(places: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(container, offset in it, whether it is the stream, where offset is the position) of pieces."""
    at = np.searchsorted((places[:, 0] << 44) | places[:, 1], (length << 44) | rank, "right") - 1
    _, start, times, first, offset, streamed = places[at].T
    k = rank - start
    inside = np.where(streamed == 1, first + k * length, offset + k % times * length)
    return np.where(streamed == 1, 0, first + k // times), inside, streamed == 1


@dataclass
class Plan:
    """Places of tails in units, of bodies and units in windows, and the stream of the rest with its cuts."""

    window: int
    unit: int
    units: np.ndarray  # tails: container is a unit, or a place in the stream
    windows: np.ndarray  # whole windows, bodies, and units made of tails behind the bodies of one unit
    bodies_of_one: int
    first: int  # sequence of the stream's start
    open_at: int  # position in the stream where the last, open window starts
    ends: list[int]  # sequences of the open window end here, in positions of the stream

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, whether in the stream) of pieces; for the stream the offset is the position there."""
        out = [np.zeros(len(length), np.int64), np.zeros(len(length), np.int64), np.zeros(len(length), bool)]
        tail = length < self.unit
        inner = np.zeros(len(length), np.int64)
        ask, position = length.copy(), rank.copy()
        settled = np.zeros(len(length), bool)
        if tail.any():
            container, offset, streamed = find(self.units, length[tail], rank[tail])
            rows = np.flatnonzero(tail)
            out[1][rows[streamed]], out[2][rows[streamed]] = offset[streamed], True
            settled[rows[streamed]] = True
            ask[rows], position[rows], inner[rows] = self.unit, self.bodies_of_one + container, offset
        rows = np.flatnonzero(~settled)
        container, offset, streamed = find(self.windows, ask[rows], position[rows])
        out[0][rows], out[1][rows], out[2][rows] = container, offset + inner[rows], streamed
        return out[0], out[1], out[2]

    def cuts(self, position: int, length: int) -> list[tuple[int, int, int, int]]:
        """(sequence, offset, start in the piece, length) of what a piece at a position of the stream is cut into."""
        out, at, stop = [], position, position + length
        while at < stop:
            if at < self.open_at:
                sequence = at // self.window
                begin, end = sequence * self.window, (sequence + 1) * self.window
            else:
                k = next(k for k, e in enumerate(self.ends) if at < e)
                sequence, begin, end = self.open_at // self.window + k, self.ends[k - 1] if k else self.open_at, self.ends[k]
            n = min(stop, end) - at
            out.append((self.first + sequence, at - begin, at - position, n))
            at += n
        return out


def make_plan(histogram: dict[int, int], window: int, unit: int, shallow: int, deep: int) -> Plan:
    """The plan for pieces of these lengths: ``window``, multiples of ``unit`` below it, and lengths below ``unit``."""
    tails = {n: c for n, c in histogram.items() if n < unit}
    bodies = {n // unit: c for n, c in histogram.items() if unit <= n < window}
    inner, outer, used = Places(), Places(), {}
    made = inner.combine(solve(tails, unit, shallow), 0, used)
    rest_of_tails = {n: c - used.get(n, 0) for n, c in tails.items()}
    bodies_of_one = bodies.get(1, 0)
    bodies[1] = bodies_of_one + made
    outer.rows.append((window, 0, 1, 0, 0, 0))
    used = {}
    first = outer.combine(solve(bodies, window // unit, deep), histogram.get(window, 0), used, unit)
    position = 0
    for n in sorted(bodies, reverse=True):
        outer.stream(n * unit, used.get(n, 0), position)
        position += (bodies[n] - used.get(n, 0)) * n * unit
    for n in sorted(rest_of_tails, reverse=True):
        inner.stream(n, tails[n] - rest_of_tails[n], position)
        position += rest_of_tails[n] * n
    open_at = position // window * window
    ends, at = [], open_at
    while at < position:
        at += 1 << ((position - at).bit_length() - 1)
        ends.append(at)
    return Plan(window, unit, inner.arrays(), outer.arrays(), bodies_of_one, first, open_at, ends)


# --- the jobs -----------------------------------------------------------------------------------------------------

PIECES = "task int, length int, nth long, doc_id long, start long, doc_tokens long, crcs array<long>, ids array<int>"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, window: int, unit: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces with the checksum of the whole and of each unit of a body, so that a body can be cut between units later; tails keep their ids."""
    encode, task, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
    for batch in batches:
        out: dict[str, list] = {k.split()[0]: [] for k in PIECES.split(", ")}
        for doc_id, words in zip(batch.column("doc_id").to_pylist(), encode.encode(batch.column("text")), strict=True):
            ids = np.append(words, np.uint32(end_id)).astype("<u4")
            raw, whole = memoryview(ids.tobytes()), len(ids) // window * window
            body = whole + (len(ids) - whole) // unit * unit
            for a, b in (*((k, k + window) for k in range(0, whole, window)), (whole, body), (body, len(ids))):
                if a == b:
                    continue
                crcs = [zlib.crc32(raw[4 * a : 4 * b])]
                if unit <= b - a < window:
                    crcs += [zlib.crc32(raw[4 * k : 4 * (k + unit)]) for k in range(a, b, unit)]
                row = (task, b - a, int(seen[b - a]), doc_id, a, len(ids), crcs, ids[a:b].astype(np.int32) if with_ids or b - a < unit else None)
                for values, v in zip(out.values(), row, strict=True):
                    values.append(v)
                seen[b - a] += 1
            if len(out["task"]) >= 20_000:
                yield _batch(out, PIECES)
                out = {k: [] for k in out}
        yield _batch(out, PIECES)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}


def _batch(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(columns[n], _TYPES[t]) for n, t in zip(names, types, strict=True)], list(names))


def joined_crc(crcs: list[int], size: int) -> int:
    """Checksum of consecutive blocks, each behind the first of ``size`` bytes, from theirs."""
    zeros, total = bytes(size), crcs[0]
    for c in crcs[1:]:
        total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ c
    return total


PLACED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"


def _placed(batches: Iterator[pa.RecordBatch], plan: Plan) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
        sequence, offset, streamed = plan.place(length, rank)
        out: dict[str, list] = {k.split()[0]: [] for k in PLACED.split(", ")}
        rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "crcs", "ids")), length.tolist(), sequence.tolist(), offset.tolist(), streamed.tolist(), strict=True)
        for doc_id, start, tokens, crcs, ids, n, seq, off, loose in rows:
            for s, o, a, m in plan.cuts(off, n) if loose else [(seq, off, 0, n)]:
                if m == n:
                    crc = crcs[0]
                elif ids is not None:
                    crc = zlib.crc32(np.array(ids[a : a + m], "<u4").tobytes())
                else:
                    crc = joined_crc(crcs[1 + a // plan.unit : 1 + (a + m) // plan.unit], 4 * plan.unit)
                for values, v in zip(out.values(), (doc_id, start + a, m, crc, tokens, s, o, ids[a : a + m] if ids is not None else None), strict=True):
                    values.append(v)
        yield _batch(out, PLACED)


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, window: int = 4096, unit: int = 128, shallow: int = 3, deep: int = 8, with_ids: bool = False) -> DataFrame:
    """A row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, ``with_ids``, its ids.

    A document's ids are those of its text by the tokenizer file ``tokenizer``, without special tokens, then ``end_id``; a null text counts
    as empty and is that one id. Pieces of a sequence lie from 0 without gaps; sequences are numbered from 0 and are full, but for at
    most log2(window) of the last ones, whose lengths are powers of two. Rows are packed one by one, also those that are repeated or
    have no doc_id. Documents stay whole up to the rules of cutting in this module. An empty table gives no rows; other columns are not read.
    ``window`` is a multiple of ``unit``, at least twice it, both powers of two.
    """
    if window < 2 * unit or unit < 1 or window & (window - 1) or unit & (unit - 1):
        raise ValueError("window and unit must be powers of two, and window at least twice unit")
    with Workspace(docs.sparkSession) as ws:
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
        pieces = ws.table(given.mapInArrow(lambda it: _pieces(it, tokenizer, end_id, window, unit, with_ids), PIECES), "pieces")
        counts = ws.table(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
        histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most unit + window / unit rows
        plan = make_plan(histogram, window, unit, shallow, deep)
        before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
        starts = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
        ranked = pieces.join(starts, ["task", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
        out = ws.result(ranked.mapInArrow(lambda it: _placed(it, plan), PLACED))
        return out if with_ids else out.drop("ids")
