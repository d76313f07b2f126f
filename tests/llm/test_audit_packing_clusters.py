"""Filter audit, packing and ball k-means against brute force, and on the cases every operator must bear."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from parchment.llm import audit, clusters, packing
from parchment.llm import text as buffers
from parchment.llm.queries import tokenizer_file

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def made(rng, n=150):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(120)]
    out = []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.choice([3, 20, 49, 50, 51, 90, 200]))]
        if rng.random() < 0.3:
            w = [x.upper() if rng.random() < 0.1 else x for x in w]
        if rng.random() < 0.3:
            w = w[:1] * len(w)
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] += rng.choice("#$%&*|")
        out.append(rng.choice([" ", "\n", " \t"]).join(w))
    out += rng.choices(out, k=60)
    return [*out, None, "", " \n\x0b", "Ü ü é É", "日本 語 日本", "A" * 70_000, " ".join(["x" * 300] * 60), " ".join(map(str, range(30_000)))]


def audited(rows, labels):
    """The report by applying every order to every document."""
    lowest = {}
    for i, t, _, _, _ in rows:
        lowest[t or ""] = min(lowest.get(t or "", math.inf), i)
    good, toxic = ({i for i, q, x in labels if (q, x)[k] == 1} for k in (0, 1))
    parts = collections.defaultdict(list)
    for i, t, _, s, _ in rows:
        w = WORD.findall(t or "")
        fails = {
            "A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t or "")) > 5 * len(t or ""), "D": bool(re.search(r"[#$%&*|]", t or "")), "E": i > lowest[t or ""],
        }
        parts[s or ""].append((i, {k for k, v in fails.items() if v}))
    out = {}
    for part, docs in parts.items():
        shapley = collections.Counter()
        for order in map("".join, itertools.permutations("ABCDE")):
            gone = set()
            for step, letter in enumerate(order, 1):
                left = [(k, i, f) for k, (i, f) in enumerate(docs) if k not in gone]
                now = [(k, i) for k, i, f in left if letter in f]
                redundant = sum(letter in docs[k][1] for k in gone)
                gone |= {k for k, _ in now}
                shapley[letter] += len(now)
                out[part, order, step] = (len(docs) - len(gone), len(now), redundant, sum(f == {letter} for _, f in docs), sum(i in good for _, i in now), sum(i in toxic for _, i in now))
        for order, step in itertools.product(map("".join, itertools.permutations("ABCDE")), range(1, 6)):
            out[part, order, step] += (shapley[order[step - 1]],)
    return out


def told(frame):
    rows = [(r.part, r.filter_order, r.step, r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in frame.collect()]
    assert len({r[:3] for r in rows}) == len(rows)
    return {r[:3]: r[3:] for r in rows}


def test_audit(spark):
    rng = random.Random(4)
    rows = [(i * 3 % 1009, t, None, rng.choice(["s", "t", None, ""]), 0) for i, t in enumerate(made(rng))]
    labels = [(r[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for r in rows if rng.random() < 0.5]
    labels += labels[:10] + [(labels[0][0], 1, 0), (None, 1, 1)]
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert told(audit.audit(spark.createDataFrame(rows, DOCS).repartition(5), given)) == audited(rows, [x for x in labels if x[0] is not None])


def test_audit_bears(spark):
    """Empty tables, repeated rows, rows without an id, clashing columns, and texts that are all the same."""
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    rows = [(1, "a #", "x", "s"), (1, "a #", "x", "s"), (2, "a #", "x", "s"), (None, "a #", "x", "s"), (None, None, "x", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string, source string").selectExpr("*", "1 AS n", "2 AS good", "3 AS failed", "'p' AS part")
    got = told(audit.audit(frame, labels))
    assert got["s", "EABCD", 1] == (3, 1, 0, 0, 0, 0, 40)
    assert got["s", "AEBCD", 1] == (0, 4, 0, 0, 2, 0, 40 + 60 * 3)
    assert got["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)
    assert told(audit.audit(frame, labels.limit(0)))["s", "AEBCD", 1][4] == 0


def test_words_under_one_hash():
    """Words are told apart by their bytes where their hashes are equal."""
    texts = ["a b a b c", "x", None, "long" * 100 + " " + "long" * 99 + "lonh " + "long" * 100]
    data, offsets = buffers.strings(pa.array(texts))
    starts, ends, at = buffers.words(data, offsets)
    for h in (np.zeros(len(starts), np.uint64), (ends - starts).astype(np.uint64), buffers.hashes(data, starts, ends, fold=False)):
        assert audit._distinct(data, starts, ends, at, h).tolist() == [3, 1, 0, 2]


def test_statistics_over_slices(monkeypatch):
    rng = random.Random(9)
    texts = made(rng)
    whole = audit.statistics(pa.array(texts))
    monkeypatch.setattr(buffers.slices, "__defaults__", (500,))
    cut = audit.statistics(pa.array(texts))
    assert all((whole[k] == cut[k]).all() for k in whole)
    assert whole["distinct"].tolist() == [len(set(WORD.findall(t or ""))) for t in texts]
    assert whole["chars"].tolist() == [len(t or "") for t in texts]


# --- packing --------------------------------------------------------------------------------------------------------


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file())
    return [[*t.encode(x or "", add_special_tokens=False).ids, 2] for x in texts]


def check_packing(rows, texts, window, padding=0):
    """Every id of every document lies in one piece; sequences have no gaps, and are full or of a length that is a power of two."""
    ids, by_doc, by_sequence = plain_ids(texts), collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            part = ids[i][at : at + r.length]
            assert (r.start, r.doc_tokens) == (at, len(ids[i])) and r.length > 0
            assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            assert "ids" not in r or r.ids == part
            at += r.length
        assert at == len(ids[i])
    for sequence in by_sequence.values():
        at = 0
        for r in sorted(sequence, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == window or at & (at - 1) == 0
    assert set(by_sequence) == set(range(len(by_sequence)))


@pytest.mark.parametrize(("window", "unit", "with_ids"), [(4096, 128, False), (256, 32, True), (64, 32, False), (16, 4, True)])
def test_packing(spark, window, unit, with_ids):
    rng = random.Random(window)
    texts = [*made(rng, 60), "same words here " * 30, *["same words here " * 30] * 20, "it's <|endoftext|> <|ENDOFTEXT|> 'S x,y—z", "日本語" * 500]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    rows = packing.pack(frame, tokenizer_file(), window=window, unit=unit, with_ids=with_ids).collect()
    check_packing(rows, texts, window)


def test_packing_of_equal_lengths(spark):
    """Lengths of which no few fill a window are cut where one ends: nothing is padded."""
    texts = ["alpha " * (17 * 4 + 2)] * 50
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), tokenizer_file(), window=64, unit=4).collect()
    check_packing(rows, texts, 64)


def test_packing_bears(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), tokenizer_file()).count() == 0
    rows = spark.createDataFrame([(None, None), (7, "a"), (7, "a")], "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS task", "3 AS ids")
    got = sorted(packing.pack(rows, tokenizer_file()).collect(), key=lambda r: (r.sequence_id, r.offset))
    assert sorted((r.doc_id or 0, r.start, r.length, r.doc_tokens) for r in got) == [(0, 0, 1, 1), (7, 0, 2, 2), (7, 0, 2, 2)] or sum(r.length for r in got) == 5
    with pytest.raises(ValueError, match="powers of two"):
        packing.pack(rows, tokenizer_file(), window=100)


def test_least_squares():
    rng = np.random.default_rng(2)
    for _ in range(20):
        a, x = rng.integers(0, 3, (8, 20)).astype(float), np.maximum(rng.normal(size=20), 0)
        b = a @ x
        got = packing.nnls(a, b)
        assert (got >= 0).all() and np.allclose(a @ got, b, atol=1e-6)
    b = rng.normal(size=8)
    got = packing.nnls(a, b)
    gradient = a.T @ (b - a @ got)
    assert (gradient < 1e-6).all() and np.allclose(gradient[got > 0], 0, atol=1e-6)


def test_plan_uses_what_there_is():
    """Combinations fill their container, use no length more often than it occurs, and on a smooth histogram leave little over."""
    rng = np.random.default_rng(5)
    histogram = {n: int(c) for n, c in zip(range(1, 128), rng.integers(900, 1100, 127), strict=True)}
    plan, used = packing.solve(histogram, 128, 3), collections.Counter()
    for combination, repeats in plan:
        assert sum(n * k for n, k in combination.items()) == 128 and sum(combination.values()) <= 3 and repeats > 0
        for n, k in combination.items():
            used[n] += k * repeats
    assert all(used[n] <= histogram[n] for n in used)
    assert sum(used.values()) > 0.97 * sum(histogram.values())
    assert len(packing.combinations(32, 8, list(range(1, 33)))) == len({p for d in range(1, 9) for p in partitions(32, d, 32)})


def partitions(n, parts, most):
    if parts == 0:
        return [()] if n == 0 else []
    return [(k, *rest) for k in range(min(n, most), 0, -1) for rest in partitions(n - k, parts - 1, k)]


def test_encoder_with_lying_hashes(monkeypatch):
    """Pieces whose hashes are equal have their own ids; the memory of pieces may be full."""
    texts = ["one two, three one two; ONE", "four five one", None, "two"]
    monkeypatch.setattr(buffers, "hashes", lambda data, starts, ends, fold=True: (ends - starts).astype(np.uint64))
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    encoder = packing.Encoder(tokenizer_file())
    for _ in range(2):
        assert [[*x.tolist(), 2] for x in encoder.encode(pa.array(texts))] == plain_ids(texts)


def test_encoder_is_the_library():
    rng = random.Random(1)
    alphabet = ["a", "B", "'s", "'t", "'", ",", ".", "-", "<|endoftext|>", "<", "|", " ", "\n", " ", "́", "é", "×", "÷", "ß", "İ", "ſ", "日本", "1", "²", "—", "😀", "\x1c", "the", "ING"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    assert [[*x.tolist(), 2] for x in packing.Encoder(tokenizer_file()).encode(pa.array(texts))] == plain_ids(texts)


# --- clusters -------------------------------------------------------------------------------------------------------


def lloyd(rows, k=16, rounds=3):
    kept = [(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept)
    centroids = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in set(own):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            centroids[j] = tuple(sum(x) // len(members) for x in zip(*members, strict=True))
    told = [(i, *nearest(v)[::-1]) for i, v in kept]
    within = collections.Counter()
    for _, j, d in told:
        within[j] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((i, j, d, within[j], sum(within.values()), name[j]) for i, j, d in told)


EMBEDDINGS = "vec_id long, embedding array<float>, label int"


def vectors(n=300):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(9, 64))
    rows = [(i, [float(x) for x in np.float32(centres[i % 9] + 0.3 * rng.normal(size=64))], 0) for i in range(n)]
    rows += [(n + i, rows[3][1], 0) for i in range(120)]
    return [*rows, (9001, None, 0), (9002, [], 0), (9003, [1.0] * 63, 0), (9004, [1.0] * 65, 0), (9005, [None] + [1.0] * 63, 0), (9006, [math.nan] + [1.0] * 63, 0), (9007, [-math.inf] + [1.0] * 63, 0), rows[0], (9008, [-0.001] * 64, 0)]


def test_clusters(spark):
    rows = vectors()
    assigned, centroids = clusters.ball_kmeans(spark.createDataFrame(rows, EMBEDDINGS).repartition(5))
    got = sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in clusters.inertia(assigned, centroids).collect())
    assert got == lloyd([(i, v) for i, v, _ in rows])


def test_balls_are_all_comparisons():
    """The same clusters as by comparing with all centroids, whatever the clusters before; with close balls most vectors are stable."""
    rng = np.random.default_rng(6)
    for spread, scale in ((5, 1), (200, 1), (40, 1 << 20)):
        centres = rng.integers(-300, 300, (12, 8)) * scale
        centres[5] = centres[2]
        x = centres[rng.integers(0, 12, 2000)] + rng.integers(-spread, spread + 1, (2000, 8)) * scale
        own, dist = clusters.nearest(x, centres)
        work = clusters.Work()
        for before in (own, rng.integers(0, 12, 2000)):
            got = clusters.by_balls(x, before, centres, work)
            assert (got[0] == own).all() and (got[1] == dist).all()
        slow = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in centres] for v in x[:50]])
        assert (slow.argmin(1) == own[:50]).all() and (slow.min(1) == dist[:50]).all()
    work = clusters.Work()
    spaced = np.arange(16)[:, None] * 1000 + np.zeros((16, 4), np.int64)
    clusters.by_balls(np.repeat(spaced, 50, 0) + rng.integers(-9, 9, (800, 4)), np.repeat(np.arange(16), 50), spaced, work)
    assert work.stable == 800 and work.compared == 800


def test_ties_go_to_the_smaller_number():
    c = np.array([[0, 0], [4, 0], [0, 0], [2, 2]])
    x = np.array([[2, 0], [0, 0], [3, 1]])
    for before in itertools.product(range(4), repeat=3):
        assert clusters.by_balls(x, np.array(before), c)[0].tolist() == clusters.nearest(x, c)[0].tolist() == [0, 0, 1]


def test_clusters_bear(spark):
    none, centroids = clusters.ball_kmeans(spark.createDataFrame([], EMBEDDINGS))
    assert clusters.inertia(none, centroids).count() == 0
    few = spark.createDataFrame([(1, [1.0] * 64, 0), (None, [2.0] * 64, 0)], EMBEDDINGS).selectExpr("*", "1 AS cluster", "2 AS v", "3 AS distance")
    assigned, centroids = clusters.ball_kmeans(few)
    assert sorted((r.vec_id or 0, r.cluster, r.distance) for r in assigned.collect()) == [(0, 1, 0), (1, 0, 0)] and len(centroids) == 2
    large = spark.createDataFrame([(1, [2.0**21] * 64, 0)], EMBEDDINGS)
    with pytest.raises(Exception, match="too large"):
        clusters.ball_kmeans(large)
    fits = spark.createDataFrame([(1, [2.0**19] * 64, 0), (2, [-(2.0**19)] * 64, 0)], EMBEDDINGS)
    assert clusters.ball_kmeans(fits, k=1)[0].groupBy().max("distance").first()[0] == 64 * (64 * 2**19) ** 2
