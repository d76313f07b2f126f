"""Near-duplicate components by an inverted join over MinHash signature coordinates.

Each document is posted under its (coordinate, value) pairs. Two documents whose shingle sets have a Jaccard similarity of s
agree on a coordinate with probability s, so links are sought among pairs that collide on at least ``matches`` of ``coordinates``
(a T-occurrence join): values that one class alone has cannot collide and are skipped; a document with k shared values needs
``matches`` of them, so only its k - matches + 1 rarest are posted as a prefix. Lists of the prefix are merged by stars around
one pivot each, in rounds. What the stars leave apart within a list meets in blocks of bounded size, and only a spanning forest of the
links is emitted, never all pairs. Both count the collisions of a pair on whole signatures, and only pairs that reach the threshold
are confirmed, on full shingle sets: of the texts in the rounds, of 64-bit shingle hashes in the blocks.

Components are kept as labels of classes: links found later are contracted to pairs of components, so that each later step works on
the few that still merge and not on all links again.

With 64 coordinates and 36 matches a pair of similarity 0.8 exactly is missed with probability 3e-6; documents with equal
shingle sets are one class from the start, by digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx
from .components import components, merged
from .store import Workspace

COORDINATES = 64
MATCHES = 36
#: Rows of a list that meet in one block when pairs of a list are compared.
BLOCK = 512
ROUNDS = 2


def _signatures(batches: Iterator[pa.RecordBatch], size: int, coordinates: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(20240)
    a = rng.integers(1, 1 << 63, coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 1 << 63, coordinates, dtype=np.uint64)
    for batch in batches:
        for low, high, data, offsets in tx.slices(batch.column("text")):
            starts, ends, at = tx.words(data, offsets)
            sh, pos = tx.shingles(tx.hashes(data, starts, ends), at, size)
            n = np.diff(pos)
            full = np.flatnonzero(n)
            sig = np.zeros((high - low, coordinates), np.uint64)
            d1, d2 = np.zeros(high - low, np.uint64), np.zeros(high - low, np.uint64)
            if len(full):
                first = pos[full]
                for k in range(coordinates):
                    sig[full, k] = np.minimum.reduceat((sh ^ b[k]) * a[k], first)
                d1[full] = np.add.reduceat(tx.mix(sh), first)
                d2[full] = np.add.reduceat(tx.mix(sh ^ np.uint64(0x5851F42D4C957F2D)), first)
            width = coordinates * 8
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(low, high - low).cast(pa.int64()),
                    pa.array(n.astype(np.int64)),
                    pa.array(d1.view(np.int64)),
                    pa.array(d2.view(np.int64)),
                    pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), high - low, [None, pa.py_buffer(sig)]).cast(pa.binary()),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"],
            )


def _tokens(batches: Iterator[pa.RecordBatch], coordinates: int) -> Iterator[pa.RecordBatch]:
    """(token, class_id) for every coordinate: the value, with the coordinate in its last bits."""
    for batch in batches:
        for low in range(0, batch.num_rows, 4096):
            part = batch.slice(low, 4096)
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint64).reshape(-1, coordinates)
            k = np.arange(coordinates, dtype=np.uint64)[None, :]
            token = tx.mix(sig + k * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(COORDINATES - 1) | k
            ids = np.repeat(part.column("class_id").to_numpy(), coordinates)
            yield pa.RecordBatch.from_arrays([pa.array(token.ravel().view(np.int64)), pa.array(ids)], names=["token", "class_id"])


def _short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, n_shingles, sig) with 16 bits of every value: enough to count collisions of a given pair, and never too few."""
    for batch in batches:
        sig = [np.frombuffer(x, np.uint64).astype(np.uint16).tobytes() for x in batch.column("sig").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("class_id"), batch.column("n_shingles"), pa.array(sig, pa.binary())], names=["class_id", "n_shingles", "sig"])


def _collide(batches: Iterator[pa.RecordBatch], coordinates: int, matches: int) -> Iterator[pa.RecordBatch]:
    """The pairs (hub, other) whose signatures agree on enough coordinates."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, coordinates) for c in ("hub_sig", "other_sig"))
        mask = pa.array((a == b).sum(1) >= matches)
        yield pa.RecordBatch.from_arrays([batch.column("hub").filter(mask), batch.column("other").filter(mask)], names=["hub", "other"])


def _sets(text: str | None, size: int, trans=str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)}), space=" \t\n\x0b\x0c\r") -> set:
    s = (text or "").translate(trans)
    for c in space[1:]:
        s = s.replace(c, " ")
    w = [x for x in s.split(" ") if x]
    if len(w) < size:
        return {tuple(w)} if w else set()
    return set(zip(*(w[k:] for k in range(size)), strict=False))


def _confirm(batches: Iterator[pa.RecordBatch], size: int, percent: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose full sets meet the threshold."""
    last: tuple = (None, None)
    for batch in batches:
        u, v, ta, tb = (batch.column(c) for c in ("u", "v", "text_u", "text_v"))
        ok = np.zeros(batch.num_rows, bool)
        for i in range(batch.num_rows):
            key = u[i].as_py()
            if last[0] != key:
                last = (key, _sets(ta[i].as_py(), size))
            x, y = last[1], _sets(tb[i].as_py(), size)
            if min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)) and x:
                both = len(x & y)
                ok[i] = 100 * both >= percent * (len(x) + len(y) - both)
        mask = pa.array(ok)
        yield pa.RecordBatch.from_arrays([u.filter(mask), v.filter(mask)], names=["u", "v"])


def _hashed_sets(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """(class_id, set): the shingle hashes of each text, sorted."""
    for batch in batches:
        for low, high, data, offsets in tx.slices(batch.column("text")):
            starts, ends, at = tx.words(data, offsets)
            sh, pos = tx.shingles(tx.hashes(data, starts, ends), at, size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_id").slice(low, high - low), pa.array([sh[a:b].tobytes() for a, b in zip(pos[:-1], pos[1:], strict=True)], pa.binary())], names=["class_id", "set"]
            )


def _intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of all sets of two lists, by products of 0/1 matrices over ``width`` shared members at a time."""
    members = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(x) for x in (*left, *right)])
    values, column, count = np.unique(members, return_inverse=True, return_counts=True)
    place = np.cumsum(count > 1) - 1
    use = count[column] > 1
    column, owner = place[column[use]], owner[use]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((len(left), len(right)), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        dense = np.zeros((len(left) + len(right), width), np.float32)
        dense[owner[a:b], column[a:b] - low] = 1
        out += dense[: len(left)] @ dense[len(left) :].T
    return out


def _block_candidates(key: tuple, table: pa.Table, coordinates: int, matches: int, percent: int) -> pa.Table:
    """Documents of one pair of blocks of a list that have a possible link between different components there.

    A pair meets in every list that both were posted in; it counts only in that of the lowest coordinate.
    """
    table = table.combine_chunks()
    token, left, right = (k.as_py() for k in key)
    ids, comp, n, block, mask = (table.column(c).to_numpy() for c in ("class_id", "component", "n_shingles", "block", "mask"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, coordinates)
    below = [k for k in range(token & (COORDINATES - 1))]
    bits = (mask[:, None] >> np.arange(coordinates)) & 1 if below else None
    rows, others = np.flatnonzero(block == left), np.flatnonzero(block == right)
    has = np.zeros(table.num_rows, bool)
    for i in rows:
        may = (comp[others] != comp[i]) & (np.minimum(n[others], n[i]) * 100 >= percent * np.maximum(n[others], n[i]))
        if left == right:
            may &= ids[others] > ids[i]
        at = others[may]
        same = sig[at] == sig[i]
        good = same.sum(1) >= matches
        at, same = at[good], same[good]
        if below and len(at):
            at = at[~(same[:, below] & (bits[at][:, below] & bits[i][below]).astype(bool)).any(1)]
        if len(at):
            has[i] = True
            has[at] = True
    return table.filter(pa.array(has)).select(["token", "left", "right", "class_id", "component", "n_shingles", "block", "sig"])


def _block_links(key: tuple, table: pa.Table, coordinates: int, matches: int, percent: int) -> pa.Table:
    """Links of one pair of blocks of a list between different components: a spanning forest of them, at most a row for each document."""
    table = table.combine_chunks()
    left, right = key[1].as_py(), key[2].as_py()
    ids, comp, n, block = (table.column(c).to_numpy() for c in ("class_id", "component", "n_shingles", "block"))
    sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint16).reshape(-1, coordinates)
    rows, others = np.flatnonzero(block == left), np.flatnonzero(block == right)
    wanted = np.zeros((len(rows), len(others)), bool)
    for k, i in enumerate(rows):
        may = (comp[others] != comp[i]) & (np.minimum(n[others], n[i]) * 100 >= percent * np.maximum(n[others], n[i]))
        if left == right:
            may &= ids[others] > ids[i]
        at = np.flatnonzero(may)
        wanted[k, at] = (sig[others[at]] == sig[i]).sum(1) >= matches
    us, vs = [], []
    if wanted.any():
        rows, others, wanted = rows[wanted.any(1)], others[wanted.any(0)], wanted[wanted.any(1)][:, wanted.any(0)]
        sets = table.column("set")
        of = lambda at: [np.frombuffer(sets[int(i)].as_py(), np.uint64) for i in at]
        both = _intersections(of(rows), of(others))
        linked = wanted & (100 * both >= percent * (n[rows][:, None] + n[others][None, :] - both))
        root = {c: c for c in comp.tolist()}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
            a, b = find(int(comp[rows[i]])), find(int(comp[others[j]]))
            if a != b:
                root[a] = b
                us.append(int(ids[rows[i]]))
                vs.append(int(ids[others[j]]))
    return pa.table({"u": us, "v": vs}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))


def near_dedup(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = COORDINATES, matches: int = MATCHES, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Words are runs outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased; a document's set holds its distinct shingles of
    ``size`` words, or all its words as one shingle where it has fewer. Documents are linked where 100 * intersection >=
    ``percent`` * union. component_id is the smallest doc_id reachable, kept marks that document. Null, empty and blank
    texts have an empty set and are linked with nothing. Rows that repeat a doc_id are one document with several
    texts: each text brings its links. Rows without a doc_id are returned with a null component, unlinked and kept.
    An empty table gives no rows; columns besides doc_id and text are not read.
    """
    spark = docs.sparkSession
    with Workspace(spark) as ws:
        given = docs.select("doc_id", "text")
        base = ws.table(given.mapInArrow(lambda it: _signatures(it, size, coordinates), "doc_id long, n_shingles long, d1 long, d2 long, sig binary"), "signatures")
        # equal sets: one class each, named by its smallest document
        same = ["d1", "d2", "n_shingles"]
        sets = base.where("n_shingles > 0 and doc_id is not null")
        classes = ws.table(sets.groupBy(same).agg(F.min(F.struct("doc_id", "sig")).alias("m")).select(*same, F.col("m.doc_id").alias("class_id"), F.col("m.sig").alias("sig")), "classes")
        members = ws.table(base.select("doc_id", *same).join(classes.select(*same, "class_id"), same, "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id")), "members")
        # rows that repeat a doc_id with other texts link their classes
        several = members.where("class_id is not null").groupBy("doc_id").agg(F.min("class_id").alias("low"), F.max("class_id").alias("high")).where("low != high")
        spread = members.join(several.select("doc_id", "low"), "doc_id").where("class_id != low").select(F.col("class_id").alias("u"), F.col("low").alias("v"))
        labels = merged(None, spread, ws)
        prefix = _prefix(classes, coordinates, matches, ws)
        # what the candidates are compared by, moved once
        posted = prefix.select("class_id").distinct()
        short = classes.select("class_id", "n_shingles", "sig").mapInArrow(_short, "class_id long, n_shingles long, sig binary")
        short = ws.table(short.join(posted, "class_id", "left_semi"), "short", key="class_id")
        texts = ws.table(given.join(posted.withColumnRenamed("class_id", "doc_id"), "doc_id", "left_semi"), "texts", key="doc_id")
        for round_ in range(ROUNDS):
            pairs = _counted(_stars(prefix, labels, round_), short, coordinates, matches, percent)
            links = _confirmed(ws.table(pairs, "pairs"), texts, size, percent)
            labels = merged(labels, links, ws)
        # what is still apart within a list: in blocks
        at = _labelled(prefix, labels)
        apart = at.groupBy("token").agg(F.count(F.lit(1)).alias("f"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2 and f > 2").select("token", F.ceil(F.col("f") / block).cast("int").alias("g"))
        rest = at.join(apart.hint("merge"), "token").join(short.hint("merge"), "class_id")
        rest = rest.withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("g").cast("long")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        rest = rest.select("token", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "class_id", "component", "n_shingles", "block", "mask", "sig")
        keyed = "token long, left int, right int, class_id long, component long, n_shingles long, block int, sig binary"
        near = ws.table(rest.groupBy("token", "left", "right").applyInArrow(lambda k, t: _block_candidates(k, t, coordinates, matches, percent), keyed), "near")
        # only what has a possible link there is compared in full
        meant = texts.join(near.select(F.col("class_id").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("class_id"), "text")
        met = near.join(meant.mapInArrow(lambda it: _hashed_sets(it, size), "class_id long, set binary"), "class_id").where(F.length("set") == 8 * F.col("n_shingles"))
        labels = merged(labels, met.groupBy("token", "left", "right").applyInArrow(lambda k, t: _block_links(k, t, coordinates, matches, percent), "u long, v long"), ws)
        out = members.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left")
        out = out.select("doc_id", "n_shingles", F.coalesce("component", "class_id", "doc_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        return ws.result(out)


def _prefix(classes: DataFrame, coordinates: int, matches: int, ws: Workspace) -> DataFrame:
    """(class_id, central, mask, token): the k - matches + 1 rarest of the k shared values of each class.

    ``central`` sums how often the values of the class occur, ``mask`` has a bit for each coordinate of its prefix.
    """
    tokens = classes.select("class_id", "sig").mapInArrow(lambda it: _tokens(it, coordinates), "token long, class_id long")
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    lists = tokens.join(shared.hint("merge"), "token").groupBy("class_id").agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("t"), F.sum("f").alias("central")).where(F.size("t") >= matches)
    lists = lists.select("class_id", "central", F.slice("t", 1, F.size("t") - (matches - 1)).alias("t"))
    mask = F.expr(f"aggregate(t, 0L, (a, x) -> a | shiftleft(1L, int(x.token & {COORDINATES - 1})))")
    return ws.table(lists.select("class_id", "central", mask.alias("mask"), F.explode("t").alias("x")).select("class_id", "central", "mask", "x.token"), "prefix", key="class_id")


def _labelled(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    return prefix.join(labels.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))


def _stars(prefix: DataFrame, labels: DataFrame, round_: int) -> DataFrame:
    """(hub, other): in each list that spans several components, its pivot with all documents outside the pivot's component.

    The most central document of a list (by how often its values occur) is what the others are likeliest linked to; a later
    round takes the most central one outside the component of that.
    """
    at = _labelled(prefix, labels)
    rank = F.struct("central", F.xxhash64("class_id", F.lit(round_)))
    pivot = at.groupBy("token").agg(F.max_by(F.struct("class_id", "component"), rank).alias("p"), F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 != c2")
    if round_:
        others = at.join(pivot.select("token", F.col("p.component").alias("main")).hint("merge"), "token").where("component != main")
        pivot = others.groupBy("token").agg(F.max_by(F.struct("class_id", "component"), rank).alias("p"))
    pairs = at.join(pivot.select("token", "p").hint("merge"), "token").where("component != p.component")
    return pairs.select(F.col("p.class_id").alias("hub"), F.col("class_id").alias("other")).distinct()


def _counted(pairs: DataFrame, short: DataFrame, coordinates: int, matches: int, percent: int) -> DataFrame:
    """The pairs whose sizes allow a link and whose signatures collide on ``matches`` coordinates.

    A hub may be in very many pairs: the join on it is one of two shuffled sides, whose large partitions Spark splits.
    """
    hubs = short.select((F.col("class_id") + 0).alias("hub"), F.col("n_shingles").alias("nh"), F.col("sig").alias("hub_sig"))  # an expression, so that this side is shuffled
    others = short.select(F.col("class_id").alias("other"), F.col("n_shingles").alias("no"), F.col("sig").alias("other_sig"))
    met = pairs.join(others.hint("merge"), "other").join(hubs.hint("merge"), "hub").where(F.least("nh", "no") * 100 >= F.greatest("nh", "no") * percent)
    return met.select("hub", "other", "hub_sig", "other_sig").mapInArrow(lambda it: _collide(it, coordinates, matches), "hub long, other long")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(u, v): the pairs whose texts meet the threshold. The hub's text is shuffled, the other's stays in its bucket."""
    hubs = texts.join(pairs.select(F.col("hub").alias("doc_id")).distinct(), "doc_id", "left_semi")
    hubs = hubs.select((F.col("doc_id") + 0).alias("hub"), F.col("text").alias("text_v"))
    others = texts.select(F.col("doc_id").alias("other"), F.col("text").alias("text_u"))
    met = pairs.join(hubs, "hub").join(others, "other").select(F.col("other").alias("u"), F.col("hub").alias("v"), "text_u", "text_v")
    return met.mapInArrow(lambda it: _confirm(it, size, percent), "u long, v long")
