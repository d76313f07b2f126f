"""Language-model scoring: a unigram base and a log-bilinear neural model trained by noise-contrastive estimation.

The model predicts over a vocabulary of the most frequent words and one word that stands for all others: a context of the two words
before predicts a feature vector r = C1 q(w-1) + C2 q(w-2). The vocabulary is dealt into about as many classes as a class has words; a
class and a word within its class have logits r . q + b, and both are normalised, so that a probability costs two short sums and not one
over the vocabulary. Other words have their smoothed relative frequency among themselves, so that the probabilities of all words sum to one.

What it is trained on is the whole training fold: counts of (w-2, w-1, w) are a sufficient statistic, gathered by a
distributed aggregation, and grow with the corpus. They are trained on in shards of bounded size, each by minibatch NCE in
numpy from the same start, whose parameters are then averaged (parameter mixing). Every counted n-gram is
used: one counted n times is visited ceil(n / WEIGHT) times, which weigh n together, so that the steps follow the counts. Scores are normalised: batched matrix
products give the logits of all classes for the distinct contexts of a slice of documents, and of all words of a class for its tokens.

Counts of all training words are aggregated and joined by the words' 64-bit hashes; those of the most frequent words go out as a
table of bounded size, so that no frequent word is ever a join key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .store import Workspace, held_out, small_batches

#: Words of the vocabulary, and words whose counts are sent out (8 + 8 bytes each).
VOCABULARY, SENT = 32_768, 131_072
DIM, NOISE, BATCH = 16, 5, 2048
#: Tokens of a shard, about; shards at least; and shards whose parameters meet in one task of the averaging.
SHARD, SHARDS, TOGETHER = 2_000_000, 4, 32
#: What one visit of an n-gram weighs at most.
WEIGHT = 16
#: Rows of counts that a task holds before it adds up and passes them on.
HELD = 750_000
#: Rows whose logits are held at once, few enough for a processor's cache.
ROWS_AT_ONCE = 1024
#: Bytes of text that are scored at once, and those of an Arrow batch.
SCORED, SENT_AT_ONCE = 1 << 20, 4 << 20
#: The identity of the end of a text.
END = np.uint64(0x0E0D)


def _fold_in(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in held])
    counts = np.concatenate([c for _, c in held])
    unique, inverse = np.unique(keys, return_inverse=True)
    return unique, np.bincount(inverse, weights=counts, minlength=len(unique)).astype(np.int64)


def _counted(parts: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """(key, n) with the keys of a task added up, as far as bounded memory allows."""
    held, size = [], 0
    batch = lambda k, c: pa.RecordBatch.from_arrays([pa.array(k.view(np.int64) if k.dtype == np.uint64 else k), pa.array(c)], names=["key", "n"])
    for keys in parts:
        unique, counts = np.unique(keys, return_counts=True)
        held.append((unique, counts))
        size += len(unique)
        if size >= HELD:
            held = [_fold_in(held)]
            size = len(held[0][0])
            if size >= HELD // 2:
                yield batch(*held[0])
                held, size = [], 0
    if held:
        yield batch(*_fold_in(held))


def _sequences(column: pa.Array, limit: int = tx.SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, word hashes with an end after each document, n + 1 positions) of each slice."""
    for low, high, data, offsets in tx.slices(column, limit):
        starts, ends, at = tx.words(data, offsets)
        n = high - low
        h = np.full(len(starts) + n, END, np.uint64)
        h[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(at))] = tx.hashes(data, starts, ends)
        yield low, high, h, at + np.arange(n + 1)


def _classes(h: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The class of each word: its place in the vocabulary, or that of others, len(keys)."""
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, ids[at], len(keys)).astype(np.int64)


def _contexts(c: np.ndarray, at: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Classes one and two places before; ``begin`` before a document's first word."""
    one, two = np.full(len(c), begin, np.int64), np.full(len(c), begin, np.int64)
    one[1:], two[2:] = c[:-1], c[:-2]
    first = at[:-1]
    one[first] = begin
    two[first] = begin
    second = first + 1
    two[second[second < at[1:]]] = begin
    return one, two


def _visits(n: np.ndarray, draws: int | None, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, weight) of minibatches of n-grams that are counted ``n`` times: one pass, or as many visits as ``draws`` says, pass after pass.

    In a pass an n-gram has ceil(n / WEIGHT) visits of equal weight, n together. The order is a walk over all visits by a stride
    without a common divisor, which needs no memory for them.
    """
    mixed = rng.permutation(len(n))
    times = -(-n[mixed].astype(np.int64) // WEIGHT)
    weights, ends = n[mixed] / np.maximum(times, 1), np.cumsum(times)
    total = int(ends[-1]) if len(ends) else 0
    if not total:
        return
    stride = max(1, int(total * 0.6180339887))
    while np.gcd(stride, total) != 1:
        stride += 1
    start, draws = int(rng.integers(total)), total if draws is None else draws
    for low in range(0, draws, BATCH):
        place = np.searchsorted(ends, (start + stride * (np.arange(low, min(low + BATCH, draws)) % total)) % total, "right")
        yield mixed[place], weights[place]


class LogBilinear:
    """Parameters: vectors of context words (C1 q and C2 q, kept as products), and vectors and biases of classes and words as targets.

    Word i is of class i // width. ``k`` words are predicted; the contexts have one more, for the beginning of a text.
    """

    def __init__(self, counts: np.ndarray, dim: int = DIM, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.k = len(counts)
        self.width = max(1, int(np.ceil(np.sqrt(self.k))))
        self.classes = -(-self.k // self.width)
        p = counts + 0.5
        of = np.add.reduceat(p, np.arange(0, self.k, self.width))
        self.class_noise = of / of.sum()
        self.noise = p / np.repeat(of, self.width)[: self.k]  # within the class
        self.ctx = rng.normal(0, 0.1, (2, self.k + 1, dim)).astype(np.float32)
        biased = lambda noise: np.concatenate([rng.normal(0, 0.1, (len(noise), dim)), np.log(noise)[:, None]], 1).astype(np.float32)
        self.out, self.class_out = biased(self.noise), biased(self.class_noise)  # the last column is the bias

    def _arrays(self) -> list[np.ndarray]:
        return [self.ctx[0], self.ctx[1], self.out, self.class_out]

    def parameters(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self._arrays()]).astype(np.float32)

    def load(self, flat: np.ndarray) -> LogBilinear:
        at = 0
        for x in self._arrays():
            x[...] = flat[at : at + x.size].reshape(x.shape)
            at += x.size
        return self

    def train(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, n: np.ndarray, steps: int | None, seed: int, rate: float = 0.25, noise: int = NOISE) -> None:
        """Minibatch NCE with Adagrad: ``n`` weighs an n-gram. No steps: one pass over all.

        An n-gram's class is told from ``noise`` classes drawn by their frequency, its word from as many of the class, drawn by theirs.
        """
        rng = np.random.default_rng(seed)
        ends, class_ends = np.cumsum(np.repeat(self.class_noise, self.width)[: self.k] * self.noise), np.cumsum(self.class_noise)
        log_noise, log_class_noise = (np.log(noise * x).astype(np.float32) for x in (self.noise, self.class_noise))
        mean = n.sum() / max(1, (-(-n.astype(np.int64) // WEIGHT)).sum())  # weight of a visit
        squares = [np.ones(p.shape, np.float32) for p in self._arrays()]

        def moved(p: np.ndarray, s: np.ndarray, at: np.ndarray, total: np.ndarray) -> None:
            square = np.take(s, at, axis=0) + total * total
            s[at] = square
            p[at] = np.take(p, at, axis=0) + rate * total / np.sqrt(square)

        def summed(at: np.ndarray, size: int, x: np.ndarray, of: np.ndarray | None = None, g: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
            """The rows that ``at`` names, and the sums of the gradients of each: rows of x, or g times the row of x that ``of`` names."""
            order = np.argsort(at.astype(np.uint16) if size <= 1 << 16 else at, kind="stable")  # 16 bits are sorted by radix
            at = at[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            rows = np.take(x, order if of is None else of[order], axis=0)
            return at[first], np.add.reduceat(rows if g is None else rows * g[order, None], first, axis=0)

        def residual(delta: np.ndarray, weight: np.ndarray) -> np.ndarray:
            """Gradients by the logits of the target (the first) and the noise, less their log noise probability."""
            g = -1 / (1 + np.exp(np.clip(-delta, -30, 30)))
            g[:, 0] += 1
            return (g * weight[:, None]).astype(np.float32)

        for pick, weight in _visits(n, None if steps is None else steps * BATCH, rng):
            m = len(pick)
            a, b, w, weight = one[pick], two[pick], word[pick], weight / mean
            r = np.concatenate([np.take(self.ctx[0], a, axis=0) + np.take(self.ctx[1], b, axis=0), np.ones((m, 1), np.float32)], 1)
            c = w // self.width
            classes = np.concatenate([c[:, None], np.minimum(np.searchsorted(class_ends, rng.random((m, noise))), self.classes - 1)], 1)
            low = np.where(c > 0, class_ends[c - 1], 0.0)
            drawn = np.searchsorted(ends, low[:, None] + rng.random((m, noise)) * self.class_noise[c][:, None], "right")
            words = np.concatenate([w[:, None], np.clip(drawn, (c * self.width)[:, None], np.minimum((c + 1) * self.width, self.k)[:, None] - 1)], 1)
            # the classes are few: their gradients as a matrix, so that sums are products
            g = residual(np.take_along_axis(r @ self.class_out.T, classes, 1) - log_class_noise[classes], weight)
            by_class = np.bincount((np.arange(m)[:, None] * self.classes + classes).ravel(), g.ravel(), m * self.classes).reshape(m, self.classes).astype(np.float32)
            q = np.take(self.out, words.ravel(), axis=0).reshape(m, noise + 1, -1)
            by_word = residual(np.einsum("mkd,md->mk", q, r) - log_noise[words], weight)
            dr = (by_class @ self.class_out + np.einsum("mk,mkd->md", by_word, q))[:, :-1]
            class_total = by_class.T @ r
            moved(self.ctx[0], squares[0], *summed(a, self.k + 1, dr))
            moved(self.ctx[1], squares[1], *summed(b, self.k + 1, dr))
            moved(self.out, squares[2], *summed(words.ravel(), self.k, r, np.repeat(np.arange(m), noise + 1), by_word.ravel()))
            moved(self.class_out, squares[3], np.arange(self.classes), class_total)

    @staticmethod
    def _log_sum(logits: np.ndarray) -> np.ndarray:
        """The logarithm of the sum of the exponentials of each row, which are overwritten."""
        top = logits.max(1)
        logits -= top[:, None]
        np.exp(logits, out=logits)
        return top + np.log(logits.sum(1))

    def log10(self, one: np.ndarray, two: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Normalised log10 probability of each word after its context."""
        code, inverse = np.unique(two * (self.k + 1) + one, return_inverse=True)
        r = np.take(self.ctx[0], code % (self.k + 1), axis=0) + np.take(self.ctx[1], code // (self.k + 1), axis=0)
        r = np.concatenate([r, np.ones((len(r), 1), np.float32)], 1)  # times the bias
        z = np.empty(len(code), np.float32)
        for low in range(0, len(code), ROWS_AT_ONCE):
            z[low : low + ROWS_AT_ONCE] = self._log_sum(r[low : low + ROWS_AT_ONCE] @ self.class_out.T)
        c = word // self.width
        order = np.argsort(c.astype(np.uint16) if self.classes <= 1 << 16 else c, kind="stable")
        out = np.empty(len(word))
        for at in np.split(order, np.flatnonzero(np.diff(c[order])) + 1) if len(order) else []:
            k = int(c[at[0]])
            start, end = k * self.width, min((k + 1) * self.width, self.k)
            vectors = np.ascontiguousarray(self.out[start:end].T)
            for low in range(0, len(at), ROWS_AT_ONCE):
                part = at[low : low + ROWS_AT_ONCE]
                x = np.take(r, inverse[part], axis=0)
                logits = x @ vectors
                mine = logits[np.arange(len(part)), word[part] - start]
                out[part] = mine - self._log_sum(logits) + x @ self.class_out[k] - z[inverse[part]]
        return out / np.log(10)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _counted(h for batch in batches for _, _, h, _ in _sequences(batch.column("text")))


def _ngrams(batches: Iterator[pa.RecordBatch], keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    k = len(keys) + 1

    def codes() -> Iterator[np.ndarray]:
        for batch in batches:
            for _, _, h, at in _sequences(batch.column("text")):
                c = _classes(h, keys, ids)
                one, two = _contexts(c, at, k)
                yield (two * (k + 1) + one) * k + c

    return _counted(codes())


def _train(batches: Iterator[pa.RecordBatch], model: LogBilinear, seed: int) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("key").to_numpy(), b.column("n").to_numpy()) for b in batches]
    if parts:
        key, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(key)
        key, n = key[order], n[order]
        word, rest = key % model.k, key // model.k
        model.train(rest % (model.k + 1), rest // (model.k + 1), word, n, None, seed)
        yield pa.RecordBatch.from_arrays([pa.array([int(n.sum())]), pa.array([model.parameters().tobytes()], pa.binary())], names=["n", "parameters"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all of a task: the parameters averaged by weight, one shard's at a time."""
    total, mean = 0, None
    for batch in batches:
        for n, flat in sorted(zip(batch.column("n").to_pylist(), batch.column("parameters").to_pylist(), strict=True)):
            flat = np.frombuffer(flat, np.float32).astype(np.float64)
            total += n
            mean = flat if mean is None else mean + (flat - mean) * (n / total)
    if total:
        yield pa.RecordBatch.from_arrays([pa.array([total]), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], names=["n", "parameters"])


ROWS = "row_id long, doc_id long, n_tokens long, model double, logs double, n_sent long, n_other long, other_logs double, rest array<long>, rest_n array<int>"


def _score(batches: Iterator[pa.RecordBatch], keys: np.ndarray, ids: np.ndarray, model: LogBilinear, sent: np.ndarray, sent_n: np.ndarray) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 40
    logs_of = np.log10(sent_n + 0.5)
    for batch in batches:
        for low, high, h, at in _sequences(batch.column("text"), SCORED):
            n = high - low
            doc = np.repeat(np.arange(n), np.diff(at))
            c = _classes(h, keys, ids)
            one, two = _contexts(c, at, model.k)
            add = lambda x: np.bincount(doc, weights=x, minlength=n)
            lbl = add(model.log10(one, two, c))
            place = np.minimum(np.searchsorted(sent, h), len(sent) - 1)
            known = sent[place] == h
            logs = np.where(known, logs_of[place], 0.0)
            other = c == len(keys)
            rare = np.flatnonzero(~known)
            order = rare[np.lexsort((h[rare], doc[rare]))]
            hr, dr = h[order], doc[order]
            new = np.ones(len(hr), bool)
            new[1:] = (hr[1:] != hr[:-1]) | (dr[1:] != dr[:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(hr))).astype(np.int32)
            cuts = np.searchsorted(dr[first], np.arange(n + 1)).astype(np.int32)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(cuts), pa.array(v))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row + np.arange(n)), batch.column("doc_id").slice(low, n).cast(pa.int64()), pa.array(np.diff(at)), pa.array(lbl), pa.array(add(logs)), pa.array(add(known).astype(np.int64)),
                    pa.array(add(other).astype(np.int64)), pa.array(add(np.where(other, logs, 0.0))), lists(hr[first].view(np.int64)), lists(times),
                ],
                names=["row_id", "doc_id", "n_tokens", "model", "logs", "n_sent", "n_other", "other_logs", "rest", "rest_n"],
            )
            row += n


def lm_scores(docs: DataFrame, vocabulary: int = VOCABULARY, sent: int = SENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Learnt from all rows whose crc32(doc_id as text) mod 5 is not 1 (rows without a doc_id among them). A-Z is lower-cased; tokens
    are the words ``[^\\x20\\x09-\\x0D]+`` and one end. base_score: smoothed unigram log10 probability of the whole text; score: that
    of the model. A null or empty text is one end. Repeated rows are each counted and scored. Without training rows every word
    is unknown, train_tokens is 0 and both scores are uniform. An empty table gives no rows; other columns are not read.
    Words are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    given = docs.select("doc_id", "text")
    with Workspace(spark) as ws, small_batches(spark, 10_000, SENT_AT_ONCE):
        train = given.where(~held_out("doc_id", 5, 1)).select("text")
        counts = ws.table(train.mapInArrow(_words, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "counts")
        total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        top = counts.orderBy(F.desc("n"), "key").limit(sent).toArrow()
        sent_keys, sent_n = top.column("key").to_numpy().astype(np.int64).view(np.uint64), top.column("n").to_numpy().astype(np.int64)
        rank = np.lexsort((sent_keys, -sent_n))
        rank = np.concatenate([np.flatnonzero(sent_keys == END), rank[sent_keys[rank] != END]])[: min(vocabulary, sent)]
        short = sent_keys[rank] if len(rank) else np.array([END])
        short_n = sent_n[rank] if len(rank) else np.zeros(1, np.int64)
        order = np.argsort(short)
        keys, ids = short[order], np.arange(len(short))[order]
        other_n, other_v = int(total - short_n.sum()), max(0, int(distinct - len(short_n)))
        if len(sent_keys) == 0:
            sent_keys, sent_n = np.array([END]), np.zeros(1, np.int64)
        by = np.argsort(sent_keys)
        sent_keys, sent_n = sent_keys[by], sent_n[by]

        model = LogBilinear(np.append(short_n, other_n).astype(float))
        if total:
            start, shards, made_of = spark.sparkContext.broadcast(model), max(SHARDS, -(-total // SHARD)), "n long, parameters binary"
            # counts meet by n-gram and are trained on at once; a shard is as many of the partitions as its size asks for, not one each
            grams = train.mapInArrow(lambda it: _ngrams(it, keys, ids), "key long, n long").repartition(shards, "key").groupBy("key").agg(F.sum("n").alias("n")).coalesce(shards)
            with small_batches(spark, 100_000):
                made = ws.table(grams.mapInArrow(lambda it: _train(it, start.value, 100), made_of), "made")
            while True:  # averages of averages, read as they lie in files and not shuffled, until one is left for the driver
                tasks = -(-made.count() // TOGETHER)
                with small_batches(spark, 1):
                    made = ws.table(made.coalesce(tasks).mapInArrow(_averaged, made_of), "made")
                if tasks == 1:
                    break
            model.load(np.frombuffer(made.first().parameters, np.float32))

        out = spark.sparkContext.broadcast((keys, ids, model, sent_keys, sent_n))
        rows = ws.table(given.mapInArrow(lambda it: _score(it, *out.value), ROWS), "rows")
        rest = rows.select("row_id", F.explode(F.arrays_zip("rest", "rest_n")).alias("x")).select("row_id", F.col("x.rest").alias("key"), F.col("x.rest_n").alias("times"))
        told = rest.join(counts, "key", "left").groupBy("row_id").agg(
            F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("rest_logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(F.lit(0))).alias("rest_known")
        )
        base_z = float(np.log10(total + 0.5 * (distinct + 1)))
        other_z = float(np.log10(other_n + 0.5 * (other_v + 1)))
        joined = rows.drop("rest", "rest_n").join(told, "row_id", "left")
        rest_logs = F.coalesce("rest_logs", F.lit(0.0))
        scores = joined.select(
            "doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens",
            (F.when(F.lit(total > 0), F.col("n_sent")).otherwise(F.lit(0)) + F.coalesce("rest_known", F.lit(0))).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
            (F.col("logs") + rest_logs - F.col("n_tokens") * base_z).alias("base_score"),
            (F.col("model") + F.col("other_logs") + rest_logs - F.col("n_other") * other_z).alias("score"),
        )
        return ws.result(scores)
