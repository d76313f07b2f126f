"""Working tables of the operators in this subpackage.

Lineage is cut with tables in the folder that the cluster shares (``spark.checkpoint.dir``), so that a lost executor costs
a re-read and not a recomputation. A folder of our own is set only where the session names none, as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one is set where none is named and all runs in one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not named and not (spark.sparkContext.master + "[").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="parchment-"))
        current = spark.sparkContext.getCheckpointDir()
    return named or current


class Workspace:
    """Parquet tables that live as long as the ``with`` block; ``result`` outlives it.

    ``table`` writes a frame and reads it back. ``result`` checkpoints the (narrow) final frame: those files belong to the
    plan and go with it where the cluster cleans checkpoints. Nothing that is returned may depend on a ``table``. With ``key``
    a table is bucketed by that column, so that joins on it leave its rows where they are.
    """

    def __init__(self, spark: SparkSession):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
        self.named: list[str] = []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        for name in self.named:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.drop(self.root)

    def drop(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"

    def table(self, df: DataFrame, name: str = "t", by: str | None = None, key: str | None = None) -> DataFrame:
        at = self.path(name)
        if key:
            self.named.append(f"work_{uuid.uuid4().hex}")
            n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            df.repartition(n, key).write.format("parquet").bucketBy(n, key).option("path", at).saveAsTable(self.named[-1])
            return self.spark.table(self.named[-1])
        writer = df.write.partitionBy(by) if by else df.write
        writer.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def result(self, df: DataFrame) -> DataFrame:
        return df.checkpoint(eager=True)


@contextmanager
def small_batches(spark: SparkSession, rows: int, size: int | None = None) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows, and ``size`` bytes or a row more, for what is computed inside: for columns whose cells may be large."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows} | ({"spark.sql.execution.arrow.maxBytesPerBatch": size} if size else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, of: int) -> Column:
    """crc32 of the id's decimal text, modulo ``of``; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string").cast("binary")).cast("long") % of


def held_out(doc_id: str, of: int, remainder: int) -> Column:
    """Whether a row belongs to the fold that nothing is learnt from; rows without an id do not."""
    return F.coalesce(fold(doc_id, of) == remainder, F.lit(False))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
