"""SentencePiece encoding and decoding as weighted finite-state transduction.

Compiled from a model file: a normaliser N (space to the mark, a mark before the text where the model adds one), a lexicon P (the
trie of pieces, each path leaving an id and a weight), byte fallback arcs for characters without a piece, and, for BPE models, an
adjacency acceptor A. An input is composed with them lazily and the shortest path in the tropical semiring is its encoding.

For a unigram model a piece weighs minus its score. For a BPE model the pieces weigh nothing and A gives a pair of neighbours weight
0 if the merges of their joined text leave exactly that pair, else infinity: a segmentation is what the merges make just when all its
pairs are such, and every prefix has one such segmentation, so one path has finite weight. No piece holds the mark after
another character, so words (a run of marks and what follows) are composed one at a time, and remembered.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from ..cluster import ship

MARK = "▁"
#: Where the public tokenizers are described to be; a parameter of every operator here.
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words whose encodings a worker remembers, and neighbour pairs; beyond that it starts anew.
REMEMBERED, REMEMBERED_PAIRS = 600_000, 2_000_000


class _Words(dict):
    """Ids, as bytes, of the words seen; others are composed when they are asked for."""

    def __init__(self, fst: Transducer):
        super().__init__()
        self.fst = fst

    def __missing__(self, word: str) -> bytes:
        ids = array("i", self.fst.shortest(word)).tobytes()
        if len(self) >= REMEMBERED:
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Transducer:
    """N, P, byte fallback and A of one model. Built on the driver from the model file; small enough to be sent (bounded by the vocabulary)."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.text: list[str] = [sp.id_to_piece(i) for i in range(n)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.id = {self.text[i]: i for i in plain}
        self.score = {i: sp.get_score(i) for i in plain}
        self.prefix = bool(sp.encode("a", out_type=str)[0].startswith(MARK))
        self.squeeze = sp.encode("a  b") == sp.encode("a b")
        self.floor = min(self.score.values(), default=0.0) - 10.0  # of a character without a piece
        # BPE models score pieces by minus their rank
        self.bpe = bool(plain) and all(float(s).is_integer() and s <= 0 for s in self.score.values())
        self.longest = max(map(len, self.id), default=1)
        self.whole_words = not any(MARK in t.lstrip(MARK) or "\n" in t for t in self.id)
        if self.bpe:
            self._spines()
        heads: dict[str, int] = {}
        for t, i in self.id.items():
            for k in range(1, len(t)):
                heads.setdefault(t[:k], -1)
            heads[t] = i
        if self.bpe:
            for t, i in self.id.items():
                if len(t) > 1 and i not in self.halves:
                    heads[t] = -1  # the merges never make this piece
        self.trie = heads  # states of the lexicon, by the text that leads to them; -1: not final
        self.bytes_of = [t.replace(MARK, " ").encode() for t in self.text]
        for b, i in self.byte.items():
            self.bytes_of[i] = bytes([b])
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i):
                self.bytes_of[i] = " ⁇ ".encode() if sp.is_unknown(i) else b""
        self.pairs: dict[int, bool] = {}
        self.words = _Words(self)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"words": None, "pairs": {}}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state | {"words": _Words(self)}

    # the adjacency acceptor ------------------------------------------------------------------------------------------

    def merges(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """What merging the best pair (score, then leftmost) makes of a text, and the last pair merged."""
        symbols, last = list(text), None
        while len(symbols) > 1:
            best = max(((self.score[self.id[a + b]], -k) for k, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if a + b in self.id), default=None)
            if best is None:
                break
            k = -best[1]
            last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = [symbols[k] + symbols[k + 1]]
        return symbols, last

    def _spines(self) -> None:
        """Of each piece that merges make: the pair it is last made of, and its outer parts with the rank at which they are merged away."""
        self.halves: dict[int, tuple[str, str]] = {}
        for t, i in self.id.items():
            if len(t) > 1:
                made, last = self.merges(t)
                if len(made) == 1:
                    self.halves[i] = last
        rank = {t: -self.score[i] for t, i in self.id.items()}
        self.rank = rank
        self.right: dict[int, list[tuple[str, float]]] = {}
        self.left: dict[int, list[tuple[str, float]]] = {}
        for side, out in ((1, self.right), (0, self.left)):
            for t, i in self.id.items():
                spine, part, death = [], t, math.inf
                while True:
                    spine.append((part, death))
                    half = self.halves.get(self.id.get(part, -1))
                    if half is None:
                        break
                    death, part = rank[part], half[side]
                out[i] = spine

    def adjacent(self, a: int, b: int) -> bool:
        """Whether no merge of the joined text of two pieces crosses from one into the other."""
        key = a << 20 | b
        known = self.pairs.get(key)
        if known is None:
            rank, known = self.rank, True
            for x, x_gone in self.right[a]:
                for y, y_gone in self.left[b]:
                    r = rank.get(x + y)
                    if r is not None and r < x_gone and r <= y_gone:
                        known = False
                        break
                if not known:
                    break
            if len(self.pairs) >= REMEMBERED_PAIRS:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    # composition and shortest path -----------------------------------------------------------------------------------

    def normalise(self, text: str) -> str:
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if not text:
            return ""
        return (MARK if self.prefix else "") + text.replace(" ", MARK)

    def _fallback(self, c: str) -> list[int]:
        return [self.byte[b] for b in c.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown]

    def shortest(self, text: str) -> list[int]:
        """Ids on the shortest path of a normalised text through the lexicon."""
        return self._only_path(text) if self.bpe else self._lightest_path(text)

    def _only_path(self, text: str) -> list[int]:
        """With the weights 0 and infinity any finite path is the shortest, and each position has one way to it: search depth first.

        Arcs are tried longest first. A position that leads nowhere once never will, so each is left at most once.
        """
        n, get, pairs, adjacent = len(text), self.trie.get, self.pairs, self.adjacent
        whole = get(text)
        if whole is not None and whole >= 0:
            return [whole]
        path: list[tuple[int, int | None, list[tuple[int, int | None]]]] = []  # (start, piece before it or None, arcs not yet tried)
        dead = bytearray(n + 1)
        s, before = 0, None
        while s < n:
            e, arcs = s + 1, []
            piece = get(text[s:e])
            if piece is None or piece < 0:
                arcs.append((e, None))
            while piece is not None:
                if piece >= 0:
                    arcs.append((e, piece))
                if e == n:
                    break
                e += 1
                piece = get(text[s:e])
            path.append((s, before, arcs))
            while True:
                start, before, arcs = path[-1]
                s = -1
                while arcs:
                    e, piece = arcs.pop()
                    if dead[e]:
                        continue
                    if before is None or piece is None:
                        s = e
                        break
                    ok = pairs.get(before << 20 | piece)
                    if adjacent(before, piece) if ok is None else ok:
                        s = e
                        break
                if s >= 0:
                    before = piece
                    break
                dead[start] = 1
                path.pop()
        out: list[int] = []
        for (start, before, _), (end, piece, _) in zip(path, [*path[1:], (n, before, [])], strict=True):
            out.extend(self._fallback(text[start:end]) if piece is None else (piece,))
        return out

    def _lightest_path(self, text: str) -> list[int]:
        n, trie, score = len(text), self.trie, self.score
        cost, back = [math.inf] * (n + 1), [None] * (n + 1)  # by position: weight, (start, id or None for a fallback arc)
        cost[0] = 0.0
        for s in range(n):
            base, known = cost[s], False
            for e in range(s + 1, min(n, s + self.longest) + 1):
                piece = trie.get(text[s:e])
                if piece is None:
                    break
                if piece < 0:
                    continue
                known |= e == s + 1
                if base - score[piece] < cost[e]:
                    cost[e], back[e] = base - score[piece], (s, piece)
            if not known and base - self.floor < cost[s + 1]:
                cost[s + 1], back[s + 1] = base - self.floor, (s, None)
        out: list[int] = []
        at = n
        while at:
            start, piece = back[at]
            out.extend(reversed(self._fallback(text[start:at])) if piece is None else (piece,))
            at = start
        return out[::-1]

    _CUT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n+")

    def encode_bytes(self, text: str) -> bytes:
        """Ids of a text as 32-bit integers."""
        text = self.normalise(text)
        if not self.whole_words:
            return np.array(self.shortest(text), np.int32).tobytes()
        return b"".join(map(self.words.__getitem__, self._CUT.findall(text)))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text or ""), np.int32).tolist()

    def decode_bytes(self, ids: list[int]) -> bytes:
        out = b"".join(map(self.bytes_of.__getitem__, ids))
        return out[1:] if self.prefix and out[:1] == b" " else out

    def decode(self, ids: list[int]) -> str:
        """The text that ids stand for; bytes that are no UTF-8 become replacement characters."""
        return self.decode_bytes(ids).decode("utf-8", "replace")


def _run(batches: Iterator[pa.RecordBatch], fst: Transducer) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        column = batch.column("text")
        for low, high, data, offsets in tx.slices(column):
            raw, parts, same = data.tobytes(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = fst.encode_bytes(raw[a:b].decode("utf-8", "replace"))
                parts.append(ids)
                back = fst.decode_bytes(np.frombuffer(ids, np.int32).tolist())
                same.append(back == raw[a:b] or back == raw[a:b].replace(MARK.encode(), b" "))
            sizes = np.array([len(p) // 4 for p in parts], np.int64)
            at = np.zeros(len(parts) + 1, np.int32)
            np.cumsum(sizes, out=at[1:])
            ids = np.frombuffer(b"".join(parts), np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low).cast(pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(pa.array(at), pa.array(ids)), pa.array(same, pa.bool_())],
                names=["doc_id", "n_tokens", "ids", "round_trip"],
            )


_LOADED: dict[str, Transducer] = {}


def transducer(model_file: str = DEFAULT_MODEL) -> Transducer:
    if model_file not in _LOADED:
        _LOADED[model_file] = Transducer(model_file)
    return _LOADED[model_file]


def encode(docs: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id, n_tokens, ids and round_trip of every row of ``docs``.

    ``model_file`` is read on the driver. round_trip: decoding the ids gives the text again (a mark U+2581 in it as the space
    that it stands for). Null and empty texts have no ids. Repeated rows are each encoded; a null doc_id is carried; an empty
    table gives no rows; other columns are not read.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(transducer(model_file))
    return docs.select("doc_id", "text").mapInArrow(lambda it: _run(it, shared.value), "doc_id long, n_tokens long, ids array<int>, round_trip boolean")


def decode(encoded: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """doc_id and text of rows with ids (array of int); null ids give a null text."""
    ship(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(transducer(model_file))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if ids is None else shared.value.decode(ids) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
