"""Toxicity: Levenshtein automata intersected with a lexicon trie, and context windows around what they catch.

The lexicon is a short list of fixed terms and what labelled rows teach: words and word beginnings (stems) that toxic documents
share and others lack. Terms and stems form a trie; the product of the trie with the Levenshtein automaton of distance one is
determinised once and run over all words of a slice of documents at the same time. Each hit is looked at in its window: between
quotation marks, or after a word of reporting, it is a quotation, else abuse. A logistic model weighs the kinds of hits.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .quality import labelled
from .store import Workspace, held_out

# English terms of abuse, and words that report speech.
TERMS = ("bastard", "clown", "creep", "disgusting", "dumb", "fool", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "stupid", "trash", "worthless")
REPORTING = ("called", "calls", "cites", "cited", "quote", "quoted", "quotes", "said", "says", "term", "word", "wrote")
#: Of these, the ones that what is reported follows at once, and words that lead up to it.
NAMING = ("called", "calls", "cites", "cited", "quote", "quoted", "quotes", "term")
ARTICLES = ("a", "an", "the", "him", "her", "them", "me", "us", "it")
#: Quotation marks, each with those that close it.
MARKS = {'"': '"', "“": "”", "„": "“”", "«": "»", "‘": "’", "'": "'", "「": "」"}

#: Labelled rows of each class that the lexicon and the weights are learnt from, at most.
SAMPLE = 20_000
#: Learnt lexicon entries are in this share of the toxic documents at least, which bounds their number by the length of those.
SHARE = 0.01
#: Code points on each side of a hit that are its context window.
WINDOW = 60

# Code points of scripts written without spaces (kana, Han). There a term may begin at every letter.
SPACELESS = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF))

_WORD = re.compile(r"[^\W\d_]+")
KINDS = 4  # exact and misspelled, each as abuse or quoted


class Automaton:
    """Deterministic automaton of all words within one edit of a term, or that begin with a stem or one edit of it.

    Edits are insertions, deletions and substitutions of a code point. Only terms of at least five and stems of at least six code points
    may be misspelled. A term in a script without spaces is a stem, since nothing marks its end. ``run`` gives 2 for an exact hit, 1 for a misspelled one, 0 for none.
    """

    def __init__(self, terms: list[str], stems: list[str], edits: int = 1):
        stems = [*stems, *(t for t in terms if t and _spaceless(np.array([ord(t[-1])]))[0])]
        trie: list[dict[str, int]] = [{}]
        ends: list[tuple[bool, bool]] = [(False, False)]  # (ends a term, ends a stem)
        depth = [0]
        for entry, is_stem in [(t, False) for t in terms] + [(s, True) for s in stems]:
            node = 0
            for c in entry:
                if c not in trie[node]:
                    trie[node][c] = len(trie)
                    trie.append({})
                    ends.append((False, False))
                    depth.append(depth[node] + 1)
                node = trie[node][c]
            ends[node] = (ends[node][0] or not is_stem, ends[node][1] or is_stem)
        alphabet = sorted({c for node in trie for c in node})
        self.classes = {c: i + 1 for i, c in enumerate(alphabet)}  # 0: any other code point

        def closed(states: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
            """With deletions: an edit passes to any child."""
            todo = list(states)
            while todo:
                node, e = todo.pop()
                if e < edits:
                    for child in trie[node].values():
                        if (child, e + 1) not in states:
                            states.add((child, e + 1))
                            todo.append((child, e + 1))
            return frozenset((node, e) for node, e in states if not any((node, less) in states for less in range(e)))

        def verdict(states: frozenset, stem: bool) -> int:
            found = [e for node, e in states if ends[node][stem] and (not e or depth[node] >= (6 if stem else 5))]
            return 2 if 0 in found else 1 if found else 0

        # states: (position sets of the product, best verdict of a stem so far)
        start = (closed({(0, 0)}), 0)
        number = {start: 1}
        self.delta, self.accept = [[0] * (len(alphabet) + 1)], [0]
        todo = [start]
        while todo:
            states, got = todo.pop(0)
            row = []
            for c in ["", *alphabet]:
                after: set[tuple[int, int]] = set()
                if got < 2:
                    for node, e in states:
                        if c in trie[node]:
                            after.add((trie[node][c], e))
                        if e < edits:
                            after.add((node, e + 1))
                            after.update((child, e + 1) for child in trie[node].values())
                to_states = closed(after)
                to = (to_states if max(got, verdict(to_states, True)) < 2 else frozenset(), max(got, verdict(to_states, True)))
                if not to[0] and not to[1]:
                    row.append(0)
                    continue
                if to not in number:
                    number[to] = len(number) + 1
                    todo.append(to)
                row.append(number[to])
            self.delta.append(row)
            self.accept.append(max(got, verdict(states, False)))
        self.delta, self.accept = np.array(self.delta, np.int32), np.array(self.accept, np.int8)
        self.table = np.zeros(max(map(ord, alphabet), default=0) + 2, np.int32)  # the last cell: all code points beyond
        for c, i in self.classes.items():
            self.table[ord(c)] = i

    def run(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The verdict of every word, all words a code point further at a time."""
        cls = self.table[np.minimum(codes, len(self.table) - 1)]
        out = np.zeros(len(starts), np.int8)
        active, state, at = np.arange(len(starts)), np.ones(len(starts), np.int32), starts.copy()
        while len(active):
            over = at >= ends[active]
            out[active[over]] = self.accept[state[over]]
            active, state, at = active[~over], state[~over], at[~over]
            state = self.delta[state, cls[at]] if len(active) else state
            alive = state > 0
            active, state, at = active[alive], state[alive], at[alive] + 1
        return out

    def one(self, word: str) -> int:
        codes = np.array([ord(c) for c in word], np.int64)
        return int(self.run(codes, np.zeros(1, np.int64), np.array([len(codes)]))[0])


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Of code points under 0x3000: whether it is a letter, and its lower case."""
    points = [chr(i) for i in range(0x3000)]
    return np.array([c.isalpha() for c in points]), np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in points], np.uint32)


_LETTER, _LOWER = _tables()


def _letters(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is a letter, and its lower case; those from 0x3000 up are asked once each."""
    small = np.minimum(codes, len(_LETTER) - 1)
    letter, lower, far = _LETTER[small], _LOWER[small], codes >= len(_LETTER)
    if far.any():
        points, which = np.unique(codes[far], return_inverse=True)
        chars = [chr(c) for c in points]
        letter[far] = np.array([c.isalpha() for c in chars])[which]
        lower[far] = np.array([ord(low) if len(low := c.lower()) == 1 else ord(c) for c in chars], np.uint32)[which]
    return letter, lower


def _spaceless(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), bool)
    if len(codes) and codes.max() >= SPACELESS[0][0]:
        for low, high in SPACELESS:
            out |= (codes >= low) & (codes <= high)
    return out


def _edge(text: str, at: int) -> bool:
    """Whether a place of a text is outside words, as its ends are."""
    return not (0 <= at < len(text) and (text[at].isalnum() or text[at] == "_"))


def _quoted(text: str, start: int, end: int) -> bool:
    """Whether a hit stands between marks of one pair, each of them outside words on its outer side, or right behind a word that reports speech.

    So apostrophes are no marks. A pair may hold several words but no end of a sentence before the hit, and a mark that is closed before the
    hit is none of its own. Between the reporting word and the hit only words may stand, three at most, one of them or the
    reporting word itself such as needs a what: a comma ends the report.
    """
    before, after = text[:start], text[end:]
    for opening, closing in MARKS.items():
        opened = next((k for k in range(len(before) - 1, -1, -1) if before[k] == opening and _edge(before, k - 1) and (k + 1 == len(before) or not before[k + 1].isspace())), -1)
        if opened < 0 or re.search(r"[.!?]\s", before[opened + 1 :]) or any(c in closing and _edge(text, k + 1) for k, c in enumerate(before[opened + 1 :], opened + 1)):
            continue
        if any(c in closing and _edge(after, k + 1) for k, c in enumerate(after)):
            return True
    near = re.search(r"(?:[^\W\d_]+ ){1,4}$", before)
    words = near[0].lower().split() if near else []
    return any(w in REPORTING and (w in NAMING or any(v in NAMING or v in ARTICLES for v in words[k + 1 :])) for k, w in enumerate(words))


def hits(data: np.ndarray, offsets: np.ndarray, automaton: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """(documents x kinds of hits, words of each document) of a slice; kinds: exact, exact quoted, misspelled, misspelled quoted."""
    n = len(offsets) - 1
    counts = np.zeros((n, KINDS))
    point = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=point[1:])
    at = point[offsets]
    text = data.tobytes().decode("utf-8", "replace")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return counts, np.zeros(n)
    letter, codes = _letters(codes)
    dense = _spaceless(codes)
    turn = np.flatnonzero(dense[1:] != dense[:-1]) + 1
    full = at[:-1][at[:-1] < at[1:]]
    edge = np.zeros(len(codes) + 1, bool)
    edge[full] = True
    edge[-1] = True
    cut = edge.copy()
    cut[turn] = True
    before = np.concatenate([[False], letter[:-1]])
    starts = np.flatnonzero(letter & (~before | cut[:-1] | dense))
    after = np.concatenate([letter[1:], [False]])
    over = np.flatnonzero(letter & (~after | cut[1:])) + 1
    ends = over[np.searchsorted(over, starts, "right")]
    verdict = automaton.run(codes, starts, ends)
    if len(starts) and dense.any():
        # an occurrence in dense script is met from its neighbours too: the exact one counts, else the first
        beside = (np.diff(starts) == 1) & dense[starts[1:]] & dense[starts[:-1]] & ~edge[starts[1:]]
        left, right = np.zeros_like(verdict), np.zeros_like(verdict)
        left[1:], right[:-1] = np.where(beside, verdict[:-1], 0), np.where(beside, verdict[1:], 0)
        verdict = np.where((verdict == 1) & ((left > 0) | (right == 2)), 0, verdict).astype(np.int8)
    where = np.flatnonzero(verdict)
    doc = np.searchsorted(at, starts[where], "right") - 1
    for i, d in zip(where, doc, strict=True):
        low, high = int(at[d]), int(at[d + 1])
        a, b = max(low, int(starts[i]) - WINDOW), min(high, int(ends[i]) + WINDOW)
        quoted = _quoted(text[a:b], int(starts[i]) - a, int(ends[i]) - a)
        counts[d, (0 if verdict[i] == 2 else 2) + quoted] += 1
    return counts, np.diff(np.searchsorted(starts, at)).astype(float)


def _features(batches: Iterator[pa.RecordBatch], automaton: Automaton) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in tx.slices(batch.column("text")):
            counts, n = hits(data, offsets, automaton)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low).cast(pa.int64()), pa.array(n), *(pa.array(counts[:, k].copy()) for k in range(KINDS))], names=["doc_id", "n_words", *(f"h{k}" for k in range(KINDS))]
            )


def learn_lexicon(texts: DataFrame, n_toxic: int) -> tuple[list[str], list[str]]:
    """(words, stems) that distinct labelled texts (text, y) teach, of Han and kana the runs of two to four letters: in ``SHARE`` of the toxic at least and in hardly any other."""
    spaced = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0))
    dense = (F.regexp_extract_all("text", F.lit(rf"(?=([\p{{IsHan}}\p{{IsHiragana}}\p{{IsKatakana}}]{{{k}}}))"), F.lit(1)) for k in (2, 3, 4))
    words = texts.select("text", "y").distinct().select("y", F.explode(F.array_distinct(F.concat(spaced, *dense))).alias("w"))
    words = words.where(F.length("w") <= 40).groupBy("w").agg(F.sum("y").cast("long").alias("a"), F.sum(1 - F.col("y")).cast("long").alias("b"))
    least = max(3, math.ceil(SHARE * n_toxic))
    good = words.where((F.col("a") >= least) & (F.col("a") >= 20 * F.col("b"))).orderBy(F.desc("a"), "w").collect()
    terms = [r.w for r in good]
    # stems: document counts of word beginnings, from distinct texts once more
    long_words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{5,}"), F.lit(0)))
    beginnings = F.array_distinct(F.flatten(F.transform(long_words, lambda w: F.array(*(F.substring(w, 1, k) for k in (4, 5, 6, 7))))))
    begins = texts.select("text", "y").distinct().select("y", F.explode(beginnings).alias("w"))
    begins = begins.groupBy("w").agg(F.sum("y").cast("long").alias("a"), F.sum(1 - F.col("y")).cast("long").alias("b"))
    found = begins.where((F.col("a") >= 2 * least) & (F.col("a") >= 50 * F.col("b"))).orderBy(F.desc("a"), F.desc(F.length("w")), "w").collect()
    stems: list[str] = []
    for r in found:
        if not any(r.w.startswith(s) or s.startswith(r.w) for s in stems) and not any(t.startswith(r.w) for t in [*TERMS, *(t for t in terms if next(x.a for x in good if x.w == t) >= 0.9 * r.a)]):
            stems.append(r.w)
    return terms, stems


class Weights:
    """Logistic model over hits of each kind among a text's words, fitted by Newton steps around stated weights.

    A hit counts by how many there are in so many words: ``PER`` words with one hit are as a text of a single hit, shorter texts count as
    that many words, so that a long text is not taken for abuse because of the odd hit that any long text has.
    """

    #: What hits of each kind weigh before anything is learnt, and the intercept.
    PRIOR = np.array([2.5, 0.3, 1.0, 0.1, -2.0])
    PER = 150

    def __init__(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0):
        self.w = self.PRIOR.copy()
        x = self.design(x)
        for _ in range(30 if len(y) else 0):
            p = 1 / (1 + np.exp(-np.clip(x @ self.w, -40, 40)))
            grad = x.T @ (p - y) + ridge * (self.w - self.PRIOR)
            hess = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(self.w))
            step = np.linalg.solve(hess, grad)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break

    @classmethod
    def design(cls, x: np.ndarray) -> np.ndarray:
        """Of rows of counts by kind and the number of words."""
        return np.column_stack([np.log2(1 + x[:, :KINDS] * cls.PER / np.maximum(x[:, KINDS:], cls.PER)), np.ones(len(x))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.w, -40, 40)))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted and n_hits of every row of ``docs``.

    Learnt from labels.toxic of at most ``sample`` rows a class, none with crc32(doc_id as text) mod 5 = 0. The score of a text comes
    from its words alone: null, empty and harmless texts all have the score of no hits. Without labels the fixed lexicon
    and weights score. Repeated rows are each scored; a null doc_id is scored and not held out; an empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    with Workspace(spark) as ws:
        given = docs.select("doc_id", "text")
        chosen = ws.table(labelled(labels, "toxic", 5, 0, sample), "chosen")
        texts = ws.table(given.where("text is not null").join(chosen, "doc_id"), "texts")
        n_toxic = texts.where("y = 1").select("text").distinct().count()
        terms, stems = learn_lexicon(texts, n_toxic)
        automaton = Automaton(sorted({*TERMS, *terms}), stems)
        shared = spark.sparkContext.broadcast(automaton)
        x = ws.table(given.mapInArrow(lambda it: _features(it, shared.value), "doc_id long, n_words double, " + ", ".join(f"h{k} double" for k in range(KINDS))), "hits")
        columns = [*(f"h{k}" for k in range(KINDS)), "n_words"]
        fit = x.join(chosen, "doc_id").select(*columns, "y").orderBy(*columns, "y").toPandas()  # at most ``sample`` documents a class
        model = Weights(fit[columns].to_numpy(float), fit["y"].to_numpy(float))
        rate = lambda k: F.col(f"h{k}") * float(Weights.PER) / F.greatest(F.col("n_words"), F.lit(float(Weights.PER)))
        z = sum((F.log2(1 + rate(k)) * float(model.w[k]) for k in range(KINDS)), F.lit(float(model.w[KINDS])))
        out = x.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), (1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))).alias("score"), sum(F.col(f"h{k}") for k in range(KINDS)).cast("long").alias("n_hits"))
        return ws.result(out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_hits"))
