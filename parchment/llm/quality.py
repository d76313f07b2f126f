"""Quality classifier: regularised quadratic discriminant analysis over transformed statistics of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import Workspace, held_out

#: Labelled rows of each class that the discriminant is fitted on, at most: those with the smallest id hashes.
SAMPLE = 20_000
#: Bytes of text whose statistics are computed at once: there are some twenty numbers for each byte.
SLICE = 1 << 20
#: Shrinkage of a class covariance towards the pooled one, and of that towards a multiple of the identity.
TO_POOLED, TO_IDENTITY = 0.15, 0.02

FEATURES = (
    "log_words", "mean_word", "sd_word", "upper", "digit", "symbol", "punct", "no_letter_words", "log_distinct", "top_word",
    "adjacent_repeat", "lines", "bang", "upper_words", "symbol_end_words", "runs",
)

# byte classes
_UPPER, _LOWER, _DIGIT, _SYMBOL, _PUNCT = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LOWER[97:123] = True
_LOWER[0xC3:0xE0] = True  # a lead byte of a letter; corrected for upper case below
_DIGIT[48:58] = True
_SYMBOL[[ord(c) for c in "#$%&*+<=>@[\\]^_`{|}~/"]] = True
_PUNCT[[ord(c) for c in "!\"'(),-.:;?"]] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The statistics of each document of a slice, one row each; an empty one has zeros."""
    n = len(offsets) - 1
    starts, ends, at = tx.words(data, offsets)
    n_words, n_bytes = np.diff(at).astype(float), np.diff(offsets).astype(float)

    def per_doc(flags: np.ndarray, where: np.ndarray = offsets) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.float64)
        np.cumsum(flags, out=total[1:])
        return total[where[1:]] - total[where[:-1]]

    if not len(data):
        return np.zeros((n, len(FEATURES)))
    lead = data == 0xC3
    follows = np.zeros(len(data), np.uint8)
    follows[:-1] = data[1:]
    accented_upper = lead & (follows < 0x9F)
    upper = _UPPER[data] | accented_upper
    letter = upper | (_LOWER[data] & ~accented_upper)
    letters, uppers = per_doc(letter), per_doc(upper)
    length = (ends - starts).astype(float)
    in_word = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[np.stack([starts, ends])], axis=0)[0] if len(starts) else np.zeros(0)
    w_letters, w_upper = in_word(letter), in_word(upper)
    h = tx.hashes(data, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(at))
    order = np.lexsort((h, doc))
    hs, ds = h[order], doc[order]
    new = np.ones(len(hs), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (ds[1:] != ds[:-1])
    first = np.flatnonzero(new)
    runs = np.diff(np.append(first, len(hs)))
    distinct = np.bincount(ds[first], minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, ds[first], runs)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    same_byte = np.zeros(len(data), bool)
    same_byte[2:] = (data[2:] == data[1:-1]) & (data[1:-1] == data[:-2])
    w = np.maximum(n_words, 1)
    by_word = lambda flags: per_doc(flags, at) / w
    mean = by_word(length)
    share = lambda x, of: x / (of + 10)
    soft = lambda x: np.log(x + 0.003)
    return np.stack(
        [
            np.log1p(n_words), mean, np.sqrt(np.maximum(by_word(length**2) - mean**2, 0)), soft(share(uppers, letters)), soft(share(per_doc(_DIGIT[data]), n_bytes)),
            soft(share(per_doc(_SYMBOL[data]), n_bytes)), soft(share(per_doc(_PUNCT[data]), n_bytes)), soft(by_word(w_letters == 0)), np.log1p(distinct) - np.log1p(n_words), soft(top / w),
            soft(by_word(again)), soft(share(per_doc(data == 10), n_words)), soft(share(per_doc(data == 33), n_words)), soft(by_word((w_upper > 1) & (w_upper == w_letters))),
            soft(by_word(_SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0))), soft(share(per_doc(same_byte), n_bytes)),
        ],
        axis=1,
    )


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in tx.slices(batch.column("text"), SLICE):
            x = np.ascontiguousarray(statistics(data, offsets))
            flat = pa.array(x.ravel())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(low, high - low).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(high - low + 1, dtype=np.int32) * x.shape[1]), flat)],
                names=["doc_id", "x"],
            )


class Discriminant:
    """Shrunken class covariances; their Cholesky factors are inverted once and kept."""

    def __init__(self, x: np.ndarray, y: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY):
        self.prior = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
        self.fitted = bool((y == 1).sum() > 1 and (y == 0).sum() > 1)
        if not self.fitted:
            return
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        z = self._scaled(x)
        parts = [z[y == c] for c in (0, 1)]
        within = [np.cov(p, rowvar=False, bias=True) for p in parts]
        pooled = sum(len(p) * s for p, s in zip(parts, within, strict=True)) / len(z)
        self.mean, self.inverse, self.log_det = [], [], []
        for p, s in zip(parts, within, strict=True):
            s = (1 - to_pooled) * s + to_pooled * pooled
            s = (1 - to_identity) * s + to_identity * (np.trace(s) / len(s)) * np.eye(len(s))
            factor = np.linalg.cholesky(s + 1e-9 * np.eye(len(s)))
            self.mean.append(p.mean(0))
            self.inverse.append(np.linalg.inv(factor).T)
            self.log_det.append(2 * np.log(np.diag(factor)).sum())

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.centre) / self.scale, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1: the difference of the Mahalanobis log densities with the log prior odds."""
        odds = np.full(len(x), np.log(self.prior / (1 - self.prior)))
        if self.fitted:
            z = self._scaled(x)
            for c, sign in ((0, -1), (1, 1)):
                odds += sign * -0.5 * ((((z - self.mean[c]) @ self.inverse[c]) ** 2).sum(1) + self.log_det[c])
        return 1 / (1 + np.exp(-np.clip(odds, -60, 60)))


def labelled(labels: DataFrame, column: str, of: int, remainder: int, sample: int) -> DataFrame:
    """(doc_id, y): at most ``sample`` rows of each class outside the held-out fold, by the smallest hashes of their ids."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("y")).where(~held_out("doc_id", of, remainder))
    part = lambda c: known.where(F.col("y") == c).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(sample)
    return part(0).unionByName(part(1))


def fit(statistics_: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Discriminant:
    """The discriminant of (doc_id, x) rows with labels.quality outside the held-out fold."""
    rows = statistics_.join(labelled(labels, "quality", 3, 1, sample), "doc_id").select("x", "y").toArrow()
    xs = np.asarray(rows.column("x").combine_chunks().flatten()).reshape(-1, len(FEATURES))
    y = rows.column("y").to_numpy()
    order = np.lexsort((y, *xs.T))
    return Discriminant(xs[order], y[order])


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the classifier does not reject; see ``quality``. Nothing is shuffled."""
    with Workspace(docs.sparkSession) as ws:
        model = fit(ws.table(docs.select("doc_id", "text").mapInArrow(_features, "doc_id long, x array<double>"), "statistics"), labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in tx.slices(batch.column("text"), SLICE):
                yield batch.slice(low, high - low).filter(pa.array(model.score(statistics(data, offsets)) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted of every row of ``docs``.

    Learnt from labels.quality of at most ``sample`` rows a class, none with crc32(doc_id as text) mod 3 = 1; the score of a
    text comes from its statistics alone. Null texts count as empty, and empty ones are scored as all-zero statistics. Rows
    with a null or other label than 0 and 1 are not learnt from; of several labels of a document the larger counts. Where a
    class has fewer than two labelled rows every score is the prior (0.5 without labels). Repeated rows are each scored; a
    null doc_id is scored and not held out; an empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    with Workspace(spark) as ws:
        x = ws.table(docs.select("doc_id", "text").mapInArrow(_features, "doc_id long, x array<double>"), "statistics")
        model = fit(x, labels, sample)

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = model.score(np.asarray(batch.column("x").flatten()).reshape(-1, len(FEATURES)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

        out = x.mapInArrow(scored, "doc_id long, score double")
        return ws.result(out.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
