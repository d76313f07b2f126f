"""Predicted boxes against masks kept as run lengths; pixels are only seen where an image file is turned into runs.

A mask is ``rows``: for each image row that has any set pixels, its number y and its runs [x1, x2). Overlap with boxes is an interval
sweep along each such row: the edges of runs and boxes in order, and how many of either cover what lies between two edges. Nothing grows
with the width of an image or the height of a box, nothing is exploded or shuffled, and joins move runs only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import geometry
from ..functions.pytext import let

ROWS = "array<struct<y:int,runs:array<struct<x1:int,x2:int>>>>"
MASKS = f"mask_path string, mask_width int, mask_height int, rows {ROWS}"


def grey(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """Luminance of pixels in the order blue, green, red, alpha."""
    x = np.frombuffer(data, np.uint8).reshape(height, width, channels).astype(np.int64)
    if channels == 1:
        return x[:, :, 0]
    return (19595 * x[:, :, 2] + 38470 * x[:, :, 1] + 7471 * x[:, :, 0] + 32768) >> 16


def encode(mask: np.ndarray) -> list[dict]:
    """Runs of the set pixels of each row that has any."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    y, starts = np.nonzero(edges == 1)
    _, ends = np.nonzero(edges == -1)
    rows: dict[int, list[dict]] = {}
    for a, b, c in zip(y.tolist(), starts.tolist(), ends.tolist(), strict=True):
        rows.setdefault(a, []).append({"x1": b, "x2": c})
    return [{"y": k, "runs": v} for k, v in rows.items()]


def _encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        rows = [encode(grey(*x) > 0) for x in zip(f["data"], f["height"], f["width"], f["nChannels"], strict=True)]
        yield pd.DataFrame({"mask_path": f["mask_path"], "mask_width": f["width"], "mask_height": f["height"], "rows": rows})


def plain_path(c: str | Column) -> Column:
    return F.regexp_replace(c, "^file:/*", "/")


def read_masks(spark: SparkSession, location: str) -> DataFrame:
    """(mask_path, mask_width, mask_height, rows) of the readable images at ``location``: Spark's image source decodes, one kernel encodes."""
    ship(spark)
    images = spark.read.format("image").option("dropInvalid", "true").load(location)
    return images.select(plain_path("image.origin").alias("mask_path"), "image.data", "image.height", "image.width", "image.nChannels").mapInPandas(_encode, MASKS)


def of_truth(gt: DataFrame, masks: DataFrame) -> DataFrame:
    """(image_name, mask_width, mask_height, rows) of the samples whose mask_path is among ``masks``."""
    named = gt.where(F.coalesce("mask_path", F.lit("")) != "").select("image_name", plain_path("mask_path").alias("mask_path"))
    return named.join(masks, "mask_path").drop("mask_path")


def resized(rows: Column, mask_width: Column, mask_height: Column, width: Column, height: Column) -> Column:
    """``rows`` of a mask as those of its nearest-neighbour resize to width x height.

    A target pixel t shows the source pixel at (t + 1/2) of/size, so the source pixels [a, b) are shown by the targets from the
    least whole number not under a size/of - 1/2 up to that of b.
    """
    start = lambda v, of, size: F.ceil((2.0 * v * size - of) / (2.0 * of)).cast("int")
    first = lambda y: F.greatest(F.lit(0), start(y, mask_height, height))
    end = lambda y: F.least(height, start(y + 1, mask_height, height))

    def runs(r: Column) -> Column:
        moved = F.transform(r["runs"], lambda x: F.struct(F.greatest(F.lit(0), start(x["x1"], mask_width, width)).alias("x1"), F.least(width, start(x["x2"], mask_width, width)).alias("x2")))
        return F.filter(moved, lambda x: x["x2"] > x["x1"])

    shown = F.filter(rows, lambda r: end(r["y"]) > first(r["y"]))
    moved = F.flatten(F.transform(shown, lambda r: F.transform(F.sequence(first(r["y"]), end(r["y"]) - 1), lambda y: F.struct(y.alias("y"), runs(r).alias("runs")))))
    return F.when((mask_width == width) & (mask_height == height), rows).when((mask_width > 0) & (mask_height > 0), moved)


def _sweep(runs: Column, boxes: Column) -> Column:
    """struct(both, mask): pixels of a row that runs and boxes cover, and that runs cover; either kind may overlap itself."""
    edge = lambda x, m, b: F.struct(x.alias("x"), F.lit(m).alias("m"), F.lit(b).alias("b"))
    edges = lambda spans, m, b: F.flatten(F.transform(spans, lambda s: F.array(edge(s["x1"], m, b), edge(s["x2"], -m, -b))))
    start = F.struct(F.lit(0).alias("x"), F.lit(0).alias("m"), F.lit(0).alias("b"), F.lit(0).cast("long").alias("both"), F.lit(0).cast("long").alias("mask"))

    def step(s: Column, e: Column) -> Column:
        gap = lambda covered: F.when(covered, e["x"] - s["x"]).otherwise(0).cast("long")
        return F.struct(
            e["x"].alias("x"), (s["m"] + e["m"]).alias("m"), (s["b"] + e["b"]).alias("b"),
            (s["both"] + gap((s["m"] > 0) & (s["b"] > 0))).alias("both"), (s["mask"] + gap(s["m"] > 0)).alias("mask"),
        )

    return F.aggregate(F.sort_array(F.concat(edges(runs, 1, 0), edges(boxes, 0, 1))), start, step)


def counts(rows: Column, boxes: Column) -> Column:
    """struct(tp, fp, fn) of the pixels of a mask against those of the union of whole-number boxes within the image.

    No rows, or no boxes, are counts of 0 of what they have none of; null rows give null. Boxes without area cover nothing.
    """
    solid = F.filter(boxes, lambda b: (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]))
    # rows and boxes are made once, not for each row
    return let(rows, lambda r: F.when(r.isNotNull(), let(solid, lambda b: _counts(r, b))))


def _counts(rows: Column, boxes: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("mask"))

    def add(s: Column, r: Column) -> Column:
        line = _sweep(r["runs"], F.filter(boxes, lambda b: (b["y1"] <= r["y"]) & (b["y2"] > r["y"])))
        # one sweep for both sums
        return let(line, lambda v: F.struct((s["tp"] + v["both"]).alias("tp"), (s["mask"] + v["mask"]).alias("mask")))

    drawn = geometry.union_area(boxes).cast("long")
    # one pass over the rows for all three
    return let(F.aggregate(rows, start, add), lambda t: F.struct(t["tp"].alias("tp"), (drawn - t["tp"]).alias("fp"), (t["mask"] - t["tp"]).alias("fn")))
