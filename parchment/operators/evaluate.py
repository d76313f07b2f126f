"""Ground truth and predictions to one row for each sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import geometry, report, scoring
from ..functions.pytext import basename, nonempty
from . import masks as mask_ops

GT_FIELDS = ("image_file", "image_name", "sample_id", "language_code", "label", "report_text", "report", "image_path", "mask_path", "width", "height", "image_width", "image_height")
PRED_FIELDS = ("image_name", "image_path", "report", "raw_output", "api_raw_content", "raw_output_full")


def with_fields(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """``df`` with the missing ones of ``fields`` as null strings."""
    return df.withColumns({c: F.lit(None).cast("string") for c in fields if c not in df.columns})


def last_wins(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The last row of each key, by ``order``: a partial aggregation, so a frequent key costs no task more."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, *(F.col(f"_row.{c}").alias(c) for c in rest))


def prepare_predictions(df: DataFrame, raw: bool = False) -> DataFrame:
    """Keyed predictions: image_name, report (unwrapped), has_text and the other columns; rows without a key go."""
    df = with_fields(df, PRED_FIELDS)
    key = nonempty("image_name", basename(F.col("image_path")))
    text = nonempty("report", "raw_output", "api_raw_content", "raw_output_full") if raw else nonempty("report")
    return df.withColumn("image_name", key).where("image_name != ''").withColumn("_text", text).withColumns({"has_text": F.col("_text") != "", "report": report.unwrap(F.col("_text"))}).drop("_text")


def prepare_truth(df: DataFrame) -> DataFrame:
    """Keyed ground truth: image_name, sample_id, language_code, label, report, paths and size; rows without a key go."""
    df = with_fields(df, GT_FIELDS)
    number = lambda c: F.col(c).cast("string").try_cast("int")
    both = lambda w, h: geometry.sized(number(w), number(h))
    pick = lambda a, b: F.when(both("width", "height"), number(a)).when(both("image_width", "image_height"), number(b))
    out = df.select(
        nonempty("image_file", "image_name").alias("image_name"), nonempty("sample_id").alias("sample_id"), nonempty("language_code", F.lit("unknown")).alias("language_code"),
        F.col("label").cast("string").alias("label"), nonempty("report_text", "report").alias("report"), "image_path", "mask_path", pick("width", "image_width").alias("width"),
        pick("height", "image_height").alias("height"), *(["ord"] if "ord" in df.columns else []),
    )
    return out.where("image_name != ''")


class Watched:
    """Both inputs on their way into samples, with what a run is to say about them counted as the rows pass: no pass of its own.

    ``info`` is there once an action over what was made of ``gt`` and ``pred`` has ended.
    """

    def __init__(self, gt: DataFrame, pred: DataFrame):
        self.seen = {k: Observation() for k in ("gt", "rows", "keys", "common")}
        one = F.count(F.lit(1))
        self.gt = last_wins(gt.observe(self.seen["gt"], one.alias("num_gt"), F.bool_or(F.col("report") != "").alias("has_gt_reports")), "image_name")
        rows = pred.observe(self.seen["rows"], one.alias("rows"), F.count_if(~F.col("has_text")).alias("empty"))
        self.pred = last_wins(rows, "image_name").observe(self.seen["keys"], one.alias("num_pred"))

    def common(self, both: DataFrame) -> DataFrame:
        return both.observe(self.seen["common"], F.count(F.lit(1)).alias("num_common"))

    def info(self) -> dict:
        """num_gt, num_pred, num_common, duplicates, empty, has_gt_reports, coverage: what ``summary.diagnostics`` gives."""
        d = {k: v for o in self.seen.values() for k, v in o.get.items()}
        d["duplicates"] = d.pop("rows") - d["num_pred"]
        return d | {"has_gt_reports": bool(d["has_gt_reports"]), "coverage": d["num_common"] / max(1, d["num_gt"])}


def samples(gt: DataFrame, pred: DataFrame, masks: DataFrame | None = None, max_samples: int = 0, watch: Callable[[DataFrame], DataFrame] = lambda both: both) -> DataFrame:
    """One row for each image that both have (inputs keyed once): labels, localisation, counts, report quality, issues.

    ``masks``: image_name, mask_width, mask_height, rows (see masks) where a sample has one; keyed once. They count for forged samples of
    known size, resized to it.
    """
    a = gt.select("image_name", "sample_id", "language_code", "label", F.col("report").alias("gt_report"), "width", "height")
    both = watch(a.join(pred.select("image_name", F.col("report").alias("pred_report")), "image_name"))
    if max_samples > 0:
        both = both.orderBy("image_name").limit(max_samples)
    parsed = both.withColumns({"gt": report.parse_report(F.col("gt_report")), "pred": report.parse_report(F.col("pred_report"))})
    if masks is not None:
        parsed = parsed.join(masks.select("image_name", "mask_width", "mask_height", "rows"), "image_name", "left")
    w, h = F.col("width"), F.col("height")
    named = parsed.withColumns({
        "gt_label": report.norm_label(nonempty("label", F.col("gt.conclusion"))), "pred_label": F.col("pred.conclusion"),
        "gt_valid": geometry.valid_boxes(F.col("gt.boxes"), w, h), "pred_valid": geometry.valid_boxes(F.col("pred.boxes"), w, h),
        "expected_script": scoring.expected_script(F.col("language_code")), "pred_script": scoring.pred_script(F.col("pred.reasons"), F.col("pred.summary")),
    })
    forged, authentic = F.col("gt_label") == "FORGED", F.col("gt_label") == "AUTHENTIC"
    if masks is None:
        m = F.lit(None).cast("struct<tp:bigint,fp:bigint,fn:bigint>")
    else:
        clamped = F.transform("pred_valid", lambda b: geometry.clamp_box(b, w, h))
        rows = mask_ops.resized(F.col("rows"), F.col("mask_width"), F.col("mask_height"), w, h)
        m = F.when(forged & geometry.sized(w, h), mask_ops.counts(rows, clamped))
    named = named.withColumn("mask", m)
    m = F.col("mask")
    named = named.withColumns({
        "box_miou": F.when(forged, F.when((F.size("gt_valid") > 0) & (F.size("pred_valid") == 0), 0.0).otherwise(geometry.mean_best_iou(F.col("gt_valid"), F.col("pred_valid")))),
        "mask_iou": F.when(m.isNotNull(), F.coalesce(F.try_divide(m["tp"], m["tp"] + m["fp"] + m["fn"]), F.lit(0.0))),
        "mask_f1": F.when(m.isNotNull(), F.coalesce(F.try_divide(2.0 * m["tp"], 2 * m["tp"] + m["fp"] + m["fn"]), F.lit(0.0))),
        "count_score": geometry.object_count(F.col("gt_label"), F.col("gt_valid"), F.col("pred_valid")),
        "rep": scoring.report_quality(F.col("gt_label"), F.when(forged, F.size("gt_valid")).otherwise(0), F.col("pred"), w, h, F.col("expected_script"), F.col("pred_script")),
    })
    extra = F.array(F.when(authentic & (F.size("pred_valid") > 0), "authentic_predicted_with_boxes"), F.when(forged & (F.size("pred_valid") == 0), "forged_without_boxes"))
    return named.select(
        "image_name", "sample_id", "language_code", "expected_script", "pred_script", "gt_label", "pred_label", (F.col("gt_label") == F.col("pred_label")).alias("det_correct"),
        F.when(forged, F.coalesce("mask_f1", "box_miou")).alias("loc_score"),
        F.when(authentic, "skipped_authentic").when(~forged, "none").when(F.col("mask_f1").isNotNull(), "mask_f1").when(F.col("box_miou").isNotNull(), "box_miou").otherwise("no_gt_boxes").alias("loc_method"),
        "box_miou", "mask_iou", "mask_f1", "mask", "count_score", scoring.token_f1(F.col("gt_report"), F.col("pred_report")).alias("exp_score"), F.col("rep.score").alias("rep_score"),
        F.col("rep.breakdown").alias("rep_breakdown"), F.col("rep.status").alias("rep_status"), F.size("pred_valid").alias("pred_boxes"), F.size("gt_valid").alias("gt_boxes"),
        F.col("pred.report_len").alias("pred_report_len"), F.col("gt.report_len").alias("gt_report_len"), F.concat(F.col("pred.issues"), F.array_compact(extra)).alias("issues"),
    )
