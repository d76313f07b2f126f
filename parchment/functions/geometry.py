"""Boxes as structs of x1, y1, x2, y2."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pytext import let

# The pixels and the patch of the model's image resize.
PIXELS, PATCH = 1003520, 14


def sized(width: Column, height: Column) -> Column:
    return (F.coalesce(width, F.lit(0)) != 0) & (F.coalesce(height, F.lit(0)) != 0)


def clamp_box(b: Column, width: Column, height: Column) -> Column:
    """Whole-number box within the image, null where nothing is left; rounding is half to even and comes after the test."""
    known = sized(width, height)
    inside = lambda v, most: F.when(known, F.greatest(F.lit(0.0), F.least(v, most.cast("double")))).otherwise(v)
    x1, y1, x2, y2 = inside(b["x1"], width), inside(b["y1"], height), inside(b["x2"], width), inside(b["y2"], height)
    return F.when((x2 > x1) & (y2 > y1), F.struct(*(F.rint(v).cast("int").alias(k) for k, v in (("x1", x1), ("y1", y1), ("x2", x2), ("y2", y2)))))


def valid_boxes(boxes: Column, width: Column, height: Column) -> Column:
    """The boxes that clamp to something, as they were."""
    return F.filter(boxes, lambda b: clamp_box(b, width, height).isNotNull())


def box_iou(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    area = lambda x: (x["x2"] - x["x1"]) * (x["y2"] - x["y1"])
    return F.when(w * h > 0, F.coalesce(F.try_divide(w * h, area(a) + area(b) - w * h), F.lit(0.0))).otherwise(0.0)


def mean_best_iou(gt: Column, pred: Column) -> Column:
    """Mean over the true boxes of the best IoU any predicted box has; null without true boxes."""
    best = F.transform(gt, lambda g: F.coalesce(F.array_max(F.transform(pred, lambda p: box_iou(g, p))), F.lit(0.0)))
    return F.when(F.size(gt) > 0, F.try_divide(F.aggregate(best, F.lit(0.0), lambda s, x: s + x), F.size(gt)))


def union_area(boxes: Column) -> Column:
    """Area of the union of boxes, by the cells that their edges cut; boxes with no area are fine."""
    return let(boxes, _union_area)


def _union_area(boxes: Column) -> Column:
    cuts = lambda a, b: F.sort_array(F.array_distinct(F.concat(F.transform(boxes, lambda x: x[a].cast("double")), F.transform(boxes, lambda x: x[b].cast("double")))))
    pairs = lambda c: F.zip_with(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    spans = lambda a, b: let(cuts(a, b), pairs)
    covered = lambda x, y: F.exists(boxes, lambda k: (k["x1"] <= x["a"]) & (k["x2"] >= x["b"]) & (k["y1"] <= y["a"]) & (k["y2"] >= y["b"]))
    column = lambda x, ys: F.aggregate(ys, F.lit(0.0), lambda s, y: s + F.when(covered(x, y), (x["b"] - x["a"]) * (y["b"] - y["a"])).otherwise(0.0))
    return let(spans("y1", "y2"), lambda ys: F.aggregate(spans("x1", "x2"), F.lit(0.0), lambda s, x: s + column(x, ys)))


def model_size(width: Column, height: Column) -> Column:
    """struct(w, h): the size an image is given to the model in."""
    scale = F.sqrt(F.try_divide(F.lit(float(PIXELS)), width.cast("double") * height))
    small = lambda v: F.when(scale < 1, F.floor(v * scale)).otherwise(v).cast("double")
    side = lambda v: F.greatest(F.lit(PATCH), (F.rint(small(v) / PATCH) * PATCH).cast("int"))
    return F.struct(side(width).alias("w"), side(height).alias("h"))


def to_original(b: Column, width: Column, height: Column) -> Column:
    """A box in model pixels as whole numbers in pixels of the original image, each clamped to it."""
    size = model_size(width, height)
    place = lambda v, to, of: F.greatest(F.lit(0), F.least(F.rint(v * (to.cast("double") / of)).cast("int"), to.cast("int")))
    return F.struct(*(place(b[k], width if k[0] == "x" else height, size["w" if k[0] == "x" else "h"]).alias(k) for k in ("x1", "y1", "x2", "y2")))


def object_count(gt_label: Column, gt: Column, pred: Column) -> Column:
    return (
        F.when(gt_label == "AUTHENTIC", F.when(F.size(pred) == 0, 1.0).otherwise(0.0)).when(F.size(gt) == 0, F.lit(None).cast("double"))
        .otherwise(F.when(F.size(gt) == F.size(pred), 1.0).otherwise(0.0))
    )
