"""JSON lines: plain, gzip and zip, fail-fast or tolerant, with the order of lines."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .archive import read_archive

_text = lambda *names: [T.StructField(n, T.StringType()) for n in names]
#: Loosely typed fields are read as strings and cast later, so that "10" and 10 are both a width.
GT_SCHEMA = T.StructType(_text("sample_id", "image_file", "image_name", "image_path", "mask_path", "label", "language_code", "report_text", "report", "width", "height", "image_width", "image_height"))
PRED_SCHEMA = T.StructType(_text("sample_id", "image_name", "image_path", "gold_label", "language_code", "model", "report", "raw_output", "raw_output_full", "api_raw_content", "thinking", "width", "height", "error"))


def _raw_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of all lines."""
    if path.endswith(".zip"):
        return read_archive(spark, path).select(F.struct("file", F.lit(0).cast("long").alias("block"), "at").alias("ord"), "value")
    return spark.read.text(path).select(F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("ord"), "value")


def _filled(value: Column) -> Column:
    return value.rlike(r"(?U)[^\s\x1c-\x1f]")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value) of the lines that are not blank: ord sorts by file, then by place in it."""
    return _raw_lines(spark, path).where(_filled(F.col("value")))


def numbered(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """``wanted`` (rows with the ord of lines of ``path``) with file and line, the 1-based number in the file, blank lines counted.

    Lines are counted by block of a file, and the counts of the blocks before are summed; a line's place in its block does the rest.
    """
    blocks = _raw_lines(spark, path).groupBy("ord.file", "ord.block").agg(F.min("ord.at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = blocks.select(F.col("file").alias("_file"), F.col("block").alias("_block"), "first", before.alias("before"))
    joined = wanted.join(known, (F.col("ord.file") == F.col("_file")) & (F.col("ord.block") == F.col("_block")))
    return joined.withColumns({"file": F.col("ord.file"), "line": F.col("before") + F.col("ord.at") - F.col("first") + 1}).drop("_file", "_block", "first", "before")


_CORRUPT = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST") -> DataFrame:
    """Rows of ``schema`` with ord. FAILFAST: a malformed line ends the job; DROPMALFORMED: it is left out.

    The job that a malformed line ends names its file; ``malformed`` and ``naming_lines`` tell its number.
    """
    if mode not in ("FAILFAST", "DROPMALFORMED"):
        raise ValueError(mode)
    rows = read_lines(spark, path).select("ord", F.from_json("value", _with_corrupt(schema), _CORRUPT).alias("r"))
    wrong = F.col("r._corrupt").isNotNull()
    if mode == "DROPMALFORMED":
        return rows.where(~wrong).select("ord", "r.*").drop("_corrupt")
    told = F.raise_error(F.concat(F.lit(f"{MALFORMED} in "), F.col("ord.file"), F.lit(": "), F.substring("r._corrupt", 1, 200)))
    # the error stands in every column, so that no pruning takes it away with the columns that are not asked for
    fine = lambda c: F.when(wrong, told.cast(schema[c].dataType)).otherwise(F.col("r")[c])
    return rows.select(F.when(wrong, told.cast(rows.schema["ord"].dataType)).otherwise(F.col("ord")).alias("ord"), *(fine(c).alias(c) for c in schema.names))


MALFORMED = "malformed JSON line"


def malformed(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line, value) of the lines that FAILFAST would stop at; line is the 1-based number in the file."""
    wrong = read_lines(spark, path).where(F.from_json("value", _with_corrupt(schema), _CORRUPT)["_corrupt"].isNotNull())
    return numbered(spark, path, wrong).select("file", "line", "value")


@contextmanager
def naming_lines(spark: SparkSession, inputs: dict[str, T.StructType]) -> Iterator[None]:
    """Where a job within stops at a malformed line of one of ``inputs`` (path: schema), the error names the first one's file and line.

    Lines are counted only then: a job whose input is right pays nothing.
    """
    try:
        yield
    except Exception as e:
        if MALFORMED not in str(e):
            raise
        for path, schema in inputs.items():
            first = malformed(spark, path, schema).orderBy("file", "line").first()
            if first is not None:
                raise ValueError(f"{first.file}:{first.line}: {MALFORMED}: {first.value[:200]}") from e
        raise


def head(df: DataFrame, n: int, order: str = "ord") -> DataFrame:
    """The first n rows in the order of the file; all for n <= 0."""
    return df.orderBy(order).limit(n) if n > 0 else df


def data_kind(path: Column) -> Column:
    """The head of an image's data URL; its type is told by its name, JPEG where that does not tell."""
    low = F.lower(path)
    mime = F.lit("image/jpeg")
    for ending, kind in ((r"\.png$", "image/png"), (r"\.gif$", "image/gif"), (r"\.webp$", "image/webp"), (r"\.bmp$", "image/bmp"), (r"\.tiff?$", "image/tiff")):
        mime = F.when(low.rlike(ending), kind).otherwise(mime)
    return F.concat(F.lit("data:"), mime, F.lit(";base64"))


def data_url(path: Column, content: Column) -> Column:
    """An image as a data URL."""
    return F.concat(data_kind(path), F.lit(","), F.regexp_replace(F.base64(content), r"\s", ""))
