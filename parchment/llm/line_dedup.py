"""Line deduplication with levelled sorted runs.

Documents arrive in batches of ascending doc_id. A run is a table of line-key digests, sorted, with the document that first
had each; a batch merge-anti-joins all runs, adds the keys that are new as a run of level 0, and ``fanout`` runs of a level are
compacted into one of the next. A line goes when its key is in an older run, or new with another document of the batch first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, lower_ascii

#: Characters stripped at both ends of a line for its key.
EDGE = " \t\n\x0b\x0c\r"
#: Columns of the result; those of the same names in the input give way.
ADDED = ("kept_text", "n_lines", "n_dropped")


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(EDGE)))


class Runs:
    """The levels of sorted runs; each run has columns key (binary) and first_id (long), sorted by key within its parts."""

    def __init__(self, ws: Workspace, fanout: int = 2):
        self.ws, self.fanout, self.levels = ws, fanout, [[]]

    def all(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, keys: DataFrame) -> DataFrame:
        """The keys that no run has: a merge anti-join with each run in turn."""
        for run in self.all():
            keys = keys.join(run.select("key").hint("merge"), "key", "left_anti")
        return keys

    def add(self, new: DataFrame) -> DataFrame:
        run = self.ws.table(new.select("key", "first_id").sortWithinPartitions("key"), "run")
        self.levels[0].append(run)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged = self.levels[level][0]
            for other in self.levels[level][1:]:
                merged = merged.unionByName(other)
            merged = self.ws.table(merged.repartition("key").sortWithinPartitions("key"), "run")
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            level += 1
        return run


def dropped_lines(docs: DataFrame, ws: Workspace, min_chars: int, batches: int, fanout: int) -> tuple[DataFrame, DataFrame]:
    """(documents with their row key, one row per document that loses lines: row key and a flag for each of its lines)."""
    rows = docs.withColumn("_row", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    lines = rows.select("_id", "_row", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("at", "line")).select("_id", "_row", "at", line_key(F.col("line")).alias("key"))
    keyed = lines.where(F.length("key") >= min_chars).select("_id", "_row", "at", F.unhex(F.substring(F.sha2(F.col("key").cast("binary"), 256), 1, 32)).alias("key"))
    cuts = docs.select(F.col("doc_id").cast("long").alias("i")).agg(F.percentile_approx("i", [k / batches for k in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    batch = F.lit(0)
    for cut in sorted(set(cuts or [])):
        batch = batch + (F.col("_id") > cut).cast("int")
    keyed = ws.table(keyed.withColumn("batch", batch), "lines", by="batch")
    runs, drops = Runs(ws, fanout), []
    for k in range(len(set(cuts or [])) + 1):
        of = keyed.where(F.col("batch") == k)
        new = runs.add(runs.unseen(of.groupBy("key").agg(F.min("_id").alias("first_id"))))
        gone = of.join(new.hint("merge"), "key", "left").where("first_id is null or first_id != _id")
        drops.append(ws.table(gone.select("_id", "_row", "at").distinct(), "drop"))
    every = drops[0]
    for more in drops[1:]:
        every = every.unionByName(more)
    return rows, every.groupBy("_id", "_row").agg(F.array_sort(F.collect_list("at")).alias("gone"))


def line_dedup(docs: DataFrame, min_chars: int = 10, batches: int = 4, fanout: int = 2) -> DataFrame:
    """``docs`` with the columns kept_text, n_lines and n_dropped added.

    A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code
    points lose all their lines except in the smallest doc_id that has them (where repeats stay). Null and empty texts are
    one empty line. Rows with one doc_id count as one document; a null doc_id as the smallest. Other columns pass
    through, whatever their names. ``batches`` ascending id ranges are taken in turn.
    """
    own = {f"_{c}": f"_{c} of the input" for c in ("id", "row", "gid", "grow", "gone", "gaps", "flags") if f"_{c}" in docs.columns}
    if own:  # names that are used here
        return line_dedup(docs.withColumnsRenamed(own), min_chars, batches, fanout).withColumnsRenamed({v: k for k, v in own.items()})
    spark = docs.sparkSession
    with Workspace(spark) as ws:
        rows, gone = dropped_lines(docs, ws, min_chars, batches, fanout)
        gone = ws.result(gone)
        split = F.split(F.coalesce("text", F.lit("")), "\n", -1)
        joined = rows.join(gone.withColumnsRenamed({"_id": "_gid", "_row": "_grow", "gone": "_gone"}), (F.col("_id") == F.col("_gid")) & (F.col("_row") == F.col("_grow")), "left")
        # sorted positions of dropped lines as flags: one pass over the lines, whatever their number
        flags = F.split(F.array_join(F.transform("_gaps", lambda g: F.concat(F.repeat(F.lit("0,"), g), F.lit("1"))), ","), ",")
        before = F.transform(F.col("_gone"), lambda x, i: x - F.when(i == 0, F.lit(-1)).otherwise(F.col("_gone")[F.greatest(i - 1, F.lit(0))]) - 1)
        out = joined.withColumn("_gaps", before).withColumn("_flags", flags)
        kept = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
            F.array_join(F.filter(split, lambda x, i: F.coalesce(F.get("_flags", i), F.lit("0")) != "1"), "\n")
        )
        # a text that keeps nothing and one that keeps a single empty line are both empty
        out = out.select(*(c for c in docs.columns if c not in ADDED), kept.alias("kept_text"), F.size(split).cast("long").alias("n_lines"), F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"))
        return out
