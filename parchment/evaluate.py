"""Entry points: evaluate predictions against ground truth, from files to a summary."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .operators import evaluate as ev
from .operators import masks
from .sources import images as image_files
from .sources import jsonl, sinks


def run(spark: SparkSession, gt_path: str, pred_path: str, raw: bool = False, max_samples: int = 0, allow_empty_loc: bool = False, det_metric: str = "accuracy", loc_metric: str = "f1", calibrate: bool = False, include_samples: bool = False, images: str | None = None, mask_location: str | None = None, output: str | None = None, output_csv: str | None = None) -> dict:
    """The whole evaluation; returns the summary document. ``images``: where relative image paths lie; ``mask_location``: mask files.

    A malformed line of an input ends it with the line's file and number.
    """
    with jsonl.naming_lines(spark, {gt_path: jsonl.GT_SCHEMA, pred_path: jsonl.PRED_SCHEMA}):
        return _run(spark, gt_path, pred_path, raw, max_samples, allow_empty_loc, det_metric, loc_metric, calibrate, include_samples, images, mask_location, output, output_csv)


def _run(spark: SparkSession, gt_path: str, pred_path: str, raw: bool, max_samples: int, allow_empty_loc: bool, det_metric: str, loc_metric: str, calibrate: bool, include_samples: bool, images: str | None, mask_location: str | None, output: str | None, output_csv: str | None) -> dict:
    gt = ev.prepare_truth(jsonl.read_jsonl(spark, gt_path, jsonl.GT_SCHEMA))
    pred = ev.prepare_predictions(jsonl.read_jsonl(spark, pred_path, jsonl.PRED_SCHEMA), raw)
    if images:
        gt = image_files.with_sizes(gt, images)
    watched = ev.Watched(gt, pred)
    m = masks.of_truth(ev.last_wins(gt, "image_name"), masks.read_masks(spark, mask_location)) if mask_location else None
    samples = ev.samples(watched.gt, watched.pred, m, max_samples, watched.common)
    more = bool(output_csv or include_samples)  # samples are gone through again
    samples = samples.persist() if more else samples
    try:
        told = sinks.figures(samples, allow_empty_loc)
        if not told.get(None, {"n": 0})["n"]:
            raise SystemExit("no common image_name of ground truth and predictions")
        info = watched.info()
        for line in sinks.warnings(info):
            print(f"WARNING: {line}", file=sys.stderr)
        document = sinks.summary_document(told, info, det_metric, loc_metric, calibrate, allow_empty_loc, samples if include_samples else None)
        if output:
            sinks.write_summary(document, output)
        if output_csv:
            sinks.write_csv(samples, output_csv)
        return document
    finally:
        if more:
            samples.unpersist()


def main(argv: list[str] | None = None) -> None:
    a = argparse.ArgumentParser(description="Evaluate report predictions")
    a.add_argument("--gt-jsonl", required=True)
    source = a.add_mutually_exclusive_group(required=True)
    source.add_argument("--pred")
    source.add_argument("--raw-jsonl")
    a.add_argument("--output")
    a.add_argument("--output-csv")
    a.add_argument("--max-samples", type=int, default=0)
    a.add_argument("--det-metric", choices=("accuracy", "f1", "macro_f1"), default="accuracy")
    a.add_argument("--loc-metric", choices=("f1", "iou"), default="f1")
    for flag in ("allow-empty-loc", "calibrate", "include-samples"):
        a.add_argument(f"--{flag}", action="store_true")
    a.add_argument("--skip-bertscore", action="store_true", help="for command lines that have it: changes nothing, the explanation score is token F1 always")
    a.add_argument("--images")
    a.add_argument("--masks")
    o = a.parse_args(argv)
    spark = SparkSession.builder.appName("parchment-evaluate").getOrCreate()
    print(sinks.console(run(spark, o.gt_jsonl, o.pred or o.raw_jsonl, bool(o.raw_jsonl), o.max_samples, o.allow_empty_loc, o.det_metric, o.loc_metric, o.calibrate, o.include_samples, o.images, o.masks, o.output, o.output_csv)))


if __name__ == "__main__":
    main()
