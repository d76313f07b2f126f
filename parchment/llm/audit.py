"""Filter interaction audit: what each of five filters removes, in every order that they could be applied in.

Texts are scanned once, in Arrow's own buffers: byte classes by table lookup and prefix sums give words, capitals, code points and
symbols of each document; word hashes sorted within a document, equal neighbours compared byte for byte, give the distinct words.
A document then is a mask of the filters that it fails. Everything after works on counts by part, mask and label, from
which the report of all orders is a product with fixed matrices.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import text
from .store import Workspace

FILTERS = "ABCDE"
#: All orders, and the matrices over masks (bit k: fails the filter FILTERS[k]) that tell a step's counts.
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
_MASK = np.arange(1 << len(FILTERS))


@dataclass(frozen=True)
class Rules:
    """Thresholds: A fails under ``min_words``, B under ``min_distinct`` % distinct words, C over ``max_capitals`` % capitals, D with any of ``symbols``."""

    min_words: int = 50
    min_distinct: int = 65
    max_capitals: int = 5
    symbols: str = "#$%&*|"


def _within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set within each document, by a prefix sum."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Distinct words of each document. Equal neighbours in the order of hashes are compared; where hashes lie, words are counted as they are."""
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((h, doc))
    a, b = order[:-1], order[1:]
    again = (h[a] == h[b]) & (doc[a] == doc[b])
    a, b = a[again], b[again]
    n = ends[a] - starts[a]
    equal = n == ends[b] - starts[b]
    equal[equal] = text.same_bytes(data, starts[a[equal]], starts[b[equal]], n[equal])
    out = np.diff(at) - np.bincount(doc[a], minlength=len(at) - 1)
    for k in np.unique(doc[a[~equal]]):
        out[k] = len({data[i:j].tobytes() for i, j in zip(starts[at[k] : at[k + 1]], ends[at[k] : at[k + 1]], strict=True)})
    return out


def statistics(column: pa.Array, symbols: str = Rules.symbols) -> dict[str, np.ndarray]:
    """words, distinct, capitals, chars (code points) and symbols of each text of an Arrow column; null counts as empty."""
    capital, continued, symbol = (np.zeros(256, bool) for _ in range(3))
    capital[65:91] = True
    continued[0x80:0xC0] = True
    symbol[list(symbols.encode("ascii"))] = True
    parts: dict[str, list[np.ndarray]] = {k: [] for k in ("words", "distinct", "capitals", "chars", "symbols")}
    for _, _, data, offsets in text.slices(column):
        starts, ends, at = text.words(data, offsets)
        parts["words"].append(np.diff(at))
        parts["distinct"].append(_distinct(data, starts, ends, at, text.hashes(data, starts, ends, fold=False)))
        parts["capitals"].append(_within(capital[data], offsets))
        parts["chars"].append(np.diff(offsets) - _within(continued[data], offsets))
        parts["symbols"].append(_within(symbol[data], offsets))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in parts.items()}


def failed(s: dict[str, np.ndarray], rules: Rules) -> np.ndarray:
    """Masks of the filters A to D that each document fails."""
    tests = (s["words"] < rules.min_words, 100 * s["distinct"] < rules.min_distinct * s["words"], 100 * s["capitals"] > rules.max_capitals * s["chars"], s["symbols"] > 0)
    return sum((t.astype(np.int32) << k for k, t in enumerate(tests)), np.zeros(len(s["words"]), np.int32))


def _scan(batches: Iterator[pa.RecordBatch], rules: Rules) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        masks = failed(statistics(batch.column("text"), rules.symbols), rules)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("digest"), pa.array(masks, pa.int32())], ["doc_id", "part", "digest", "failed"])


def _matrices() -> dict[str, np.ndarray]:
    """For each order and step (rows) and each mask (columns): whether such a document is kept, removed there, redundant or the filter's alone; shapley sums orders."""
    rows: dict[str, list[np.ndarray]] = {k: [] for k in ("kept", "removed", "redundant", "unique_fails")}
    for order in ORDERS:
        before = 0
        for letter in order:
            own = 1 << FILTERS.index(letter)
            rows["kept"].append(_MASK & (before | own) == 0)
            rows["removed"].append((_MASK & own > 0) & (_MASK & before == 0))
            rows["redundant"].append((_MASK & own > 0) & (_MASK & before > 0))
            rows["unique_fails"].append(_MASK == own)
            before |= own
    out = {k: np.array(v, np.int64) for k, v in rows.items()}
    letters = np.array([FILTERS.index(x) for order in ORDERS for x in order])
    out["shapley"] = np.array([out["removed"][letters == k].sum(0) for k in range(len(FILTERS))])[letters]
    return out


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All orders of each part, from its counts by mask."""
    m = _matrices()
    orders, steps = [o for o in ORDERS for _ in o], [k + 1 for _ in ORDERS for k in range(len(FILTERS))]
    for batch in batches:
        for row in batch.to_pylist():
            n, good, toxic = np.zeros((3, len(_MASK)), np.int64)
            for c in row["counts"]:
                n[c["failed"]] += c["n"]
                good[c["failed"]] += c["n"] * c["good"]
                toxic[c["failed"]] += c["n"] * c["toxic"]
            told = {"kept": m["kept"] @ n, "removed": m["removed"] @ n, "redundant": m["redundant"] @ n, "unique_fails": m["unique_fails"] @ n, "good_lost": m["removed"] @ good, "toxic_lost": m["removed"] @ toxic, "shapley": m["shapley"] @ n}
            yield pa.RecordBatch.from_pydict({"part": [row["part"]] * len(orders), "filter_order": orders, "step": pa.array(steps, pa.int32()), **told})


REPORT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, rules: Rules = Rules(), part: str = "source") -> DataFrame:
    """One row for each part, order of the filters A to E, and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A part is a value of the column ``part``, null as the empty string. Null texts count as empty; an empty text has no words, so it fails
    A but not B. E fails for a document whose text a smaller doc_id has too, anywhere in the table (texts are equal by SHA-256); rows
    that are repeated with one doc_id all pass or fail it together. A row without a doc_id has no label, fails E never, and makes none
    fail. Of several labels of a doc_id one with 1 is enough; null labels are not 1. ``shapley`` is what the step's filter
    removes, summed over all orders. An empty table gives no rows; other columns are not read.
    """
    whole = F.coalesce(F.col("text"), F.lit(""))
    with Workspace(docs.sparkSession) as ws:
        given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"), whole.alias("text"))
        rows = ws.table(given.mapInArrow(lambda it: _scan(it, rules), "doc_id long, part string, digest binary, failed int"), "scan")
        marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
        known = rows.where("doc_id is not null").join(marks, "doc_id", "left").withColumns({k: F.coalesce(k, F.lit(False)) for k in ("good", "toxic")})
        # copies are counted before they meet: by document, then by text, part and label
        group = ["digest", "part", "failed", "good", "toxic"]
        each = known.groupBy("doc_id", *group).agg(F.count(F.lit(1)).alias("n"))
        alike = each.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
        alike = alike.withColumn("first_id", F.min("first.doc_id").over(Window.partitionBy("digest")))
        passed = F.when(F.col("first.doc_id") == F.col("first_id"), F.col("first.n")).otherwise(0)
        last = 1 << FILTERS.index("E")
        split = alike.select("part", "good", "toxic", F.explode(F.array(F.struct("failed", passed.alias("n")), F.struct((F.col("failed") + last).alias("failed"), (F.col("n") - passed).alias("n")))).alias("x"))
        loose = rows.where("doc_id is null").groupBy("part", "failed").agg(F.count(F.lit(1)).alias("n"))
        counts = split.select("part", "x.failed", "good", "toxic", "x.n").unionByName(loose.select("part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "n"))
        counts = counts.groupBy("part", "failed", "good", "toxic").agg(F.sum("n").alias("n"))
        # at most 128 counts a part
        of_part = counts.groupBy("part").agg(F.collect_list(F.struct("failed", "good", "toxic", "n")).alias("counts"))
        return ws.result(of_part.mapInArrow(_report, REPORT))
