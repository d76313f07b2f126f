"""Exact deduplication as a stateful stream.

A streaming aggregation over the documents keeps one state row per digest in a disk-backed (RocksDB) state store, without
watermark and so without expiry: the digest of the normalised text, the stable identifier of the row that stays, its content
locator (file and start of the block read, not the row in it; nothing here uses it) and the size of the group. The state is read back as a table; every hit (a row whose digest
is also another row's) is then compared, whole text against the whole text of the row that the state names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Workspace, shared_dir

#: Deleted before texts are compared: these six characters.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

#: Settings of the stream: state on disk, memory shared by all stores of an executor, no space set aside for empty files.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    """The text without white space of ASCII; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha256(body: Column) -> Column:
    """The digest of a normalised text, in lower-case hex."""
    return F.sha2(body.cast("binary"), 256)


def _as_glob(path: str) -> str:
    """The same path as a pattern: a stream can then also read a single file."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def learn_state(spark: SparkSession, path: str, state: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """Run the stream over all files at ``path`` that it has not seen; return its whole state.

    ``state`` is the stream's checkpoint folder. A later call with the same folder reads only new files and adds to the
    state, which never expires. Columns: digest, doc_id, n_code_points, locator, group_size.
    """
    before = {name: spark.conf.get(name, None) for name in STORE}
    for name, value in STORE.items():
        spark.conf.set(name, value)
    try:
        schema = spark.read.parquet(path).select("doc_id", "text").schema
        rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100_000).parquet(_as_glob(path))
        keyed = rows.select(
            digest(normalised(F.col("text"))).alias("digest"),
            F.struct(
                F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"),
                F.bitwise_not("doc_id").alias("not_id"),
                F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).alias("locator"),
            ).alias("row"),
        )
        state_rows = keyed.groupBy("digest").agg(F.max("row").alias("best"), F.count(F.lit(1)).alias("group_size"))
        query = state_rows.writeStream.format("noop").outputMode("update").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    stored = spark.read.format("statestore").load(state)
    best, size = (f"value.`{c}`" for c in stored.schema["value"].dataType.names)
    return stored.select(
        F.col("key.digest").alias("digest"),
        F.bitwise_not(f"{best}.not_id").alias("doc_id"),
        F.col(f"{best}.n").alias("n_code_points"),
        F.col(f"{best}.locator").alias("locator"),
        F.col(size).alias("group_size"),
    )


def exact_dedup(spark: SparkSession, path: str, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per document of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting ``[\\x20\\x09-\\x0D]``; null counts as empty, so null, empty and blank texts
    are one group. Of a group the row with the most code points, then the smallest doc_id, stays. Rows that are repeated
    with the same doc_id all point at it, and are all ``kept`` where their id and text are those of the row that stays.
    A null doc_id is never preferred to a number of the same length. An empty table gives no rows; other columns are
    not read. ``text_sha256`` is the digest. Should two different texts share a digest, each text of that digest becomes a
    group of its own.
    """
    with Workspace(spark) as ws:
        state = ws.table(learn_state(spark, path, f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", digest), "state")
        rows = spark.read.parquet(path).select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), normalised(F.col("text")).alias("body"))
        rows = rows.withColumn("digest", digest(F.col("body")))
        kept = (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n") == F.col("keep_n"))).alias("kept")
        out = ["doc_id", "keep_id", "group_size", kept, F.col("digest").alias("text_sha256")]
        grouped = ws.table(rows.drop("body").join(state.select("digest", F.col("doc_id").alias("keep_id"), F.col("n_code_points").alias("keep_n"), "group_size"), "digest"), "grouped")
        # the full bytes of every hit against those of the row that stays
        hits = state.where("group_size > 1").select("digest")
        one = rows.join(hits, "digest", "left_semi").groupBy("digest").agg(F.min("body").alias("low"), F.max("body").alias("high"))
        odd = ws.table(one.where("low != high").select("digest"), "odd")
        if odd.isEmpty():
            return ws.result(grouped.select(*out))
        # one digest, several texts: those few groups again, with the text itself as the key
        again = rows.join(odd, "digest", "left_semi")
        best = again.groupBy("digest", "body").agg(F.max(F.struct("n", F.bitwise_not("doc_id").alias("not_id"))).alias("best"), F.count(F.lit(1)).alias("group_size"))
        best = best.select("digest", "body", F.bitwise_not("best.not_id").alias("keep_id"), F.col("best.n").alias("keep_n"), "group_size")
        return ws.result(grouped.join(odd, "digest", "left_anti").select(*out).unionByName(again.join(best, ["digest", "body"]).select(*out)))
