"""Summary JSON, per-sample CSV, console and JSON lines."""

from __future__ import annotations

import csv
import io
import json
import os
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import scoring
from ..operators import summary

# The columns of the per-sample CSV; the keys of the summary below are fixed, too.
CSV_FIELDS = (
    "image_name", "sample_id", "language_code", "expected_script", "pred_script", "gt_label", "pred_label", "det_correct", "loc_score", "loc_method", "box_miou", "mask_iou", "mask_f1", "count_score", "exp_score",
    "rep_score", "rep_format", "rep_self_consistency", "rep_verdict_match", "rep_grounding", "rep_count_align", "rep_detail", "rep_length_align", "rep_language_factor", "pred_boxes", "gt_boxes", "pred_report_len",
    "gt_report_len", "issues",
)


BY_LANGUAGE = ("n", "n_forged", "n_scored", "accuracy", "f1", "macro_f1", "loc_f1", "loc_iou", "authentic_no_box_rate", "s_exp", "s_rep", "avg_pred_report_len", "avg_gt_report_len", "script_match_rate")


def csv_frame(samples: DataFrame) -> DataFrame:
    """The columns of the per-sample CSV, in order."""
    parts = {f"rep_{k}": F.col(f"rep_breakdown.{k}") for k in (*scoring.PARTS, "language_factor")}
    boolean = F.when(F.col("det_correct"), "True").otherwise("False")
    return samples.withColumns(parts | {"issues": F.array_join("issues", ";"), "det_correct": boolean}).select(*CSV_FIELDS)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows as lines of the stdlib's csv writer, which knows how numbers, quotes and line ends are to look."""
    for batch in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            cell = io.StringIO()
            csv.writer(cell, lineterminator="").writerow(row)
            out.append(cell.getvalue())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["value"])


def write_csv(samples: DataFrame, path: str) -> None:
    """One CSV file in the order of image names, the bytes that the stdlib's writer would give.

    The sort is by range and each part is formatted where it lies. The parts are then strung together by Hadoop's file system behind one
    header, a buffer at a time, and the file appears under its name when it is whole.
    """
    spark = samples.sparkSession
    ship(spark)
    frame = csv_frame(samples)
    parts, whole = f"{path}.{uuid.uuid4().hex}.parts", f"{path}.{uuid.uuid4().hex}.tmp"
    frame.orderBy("image_name", *CSV_FIELDS[1:]).mapInArrow(_lines, "value string").write.option("lineSep", "\r\n").text(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    at = lambda p: hadoop.fs.Path(p)
    store = at(path).getFileSystem(conf)
    out = store.create(at(whole), True)
    try:
        out.write(bytearray((",".join(CSV_FIELDS) + "\r\n").encode()))
        for name in sorted(f.getPath().getName() for f in store.listStatus(at(parts)) if f.getPath().getName().startswith("part-")):
            part = store.open(at(f"{parts}/{name}"))
            hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
            part.close()
    finally:
        out.close()
    store.delete(at(path), True)
    store.rename(at(whole), at(path))
    store.delete(at(parts), True)


def write_jsonl(df: DataFrame, path: str, append: bool = True) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", False).json(path)


def figures(samples: DataFrame, allow_empty: bool = False) -> dict[str | None, dict]:
    """All figures by language, and under None those over all: one job, of which a row for each language reaches the driver."""
    return {None if r["total"] else r["language_code"]: r for r in (row.asDict(True) for row in summary.everything(samples, allow_empty).collect())}


def summary_document(told: dict[str | None, dict], info: dict, det: str = "accuracy", loc: str = "f1", calibrate: bool = False, allow_empty: bool = False, samples: DataFrame | None = None) -> dict:
    """The summary as one document, from ``figures`` and what is known of the inputs; with every sample where ``samples`` are given."""
    s = dict(told[None])
    if not info["has_gt_reports"]:
        s["s_exp"] = 0.0
    final = summary.chosen_of(s, det, loc, calibrate)
    issues = sorted(((-v["n"], (v["first"]["image_name"], v["first"]["at"]), k) for k, v in s["issues"].items() if v["n"]))[:20]
    doc = {
        "num_gt": info["num_gt"], "num_pred": info["num_pred"], "num_common": s["n"], "num_forged": s["n_forged"], "num_forged_loc_scored": s["n_scored"], "weights": scoring.WEIGHTS,
        "selected_proxy_metrics": {"S_Det": det, "S_Loc": loc, "S_Exp_method": "token_f1_proxy" if info["has_gt_reports"] else "no_gt_reports", "allow_empty_loc": allow_empty},
        "scores": {
            "S_Det": final["S_Det"], "S_Det_accuracy": s["accuracy"], "S_Det_f1": s["f1"], "S_Det_macro_f1": s["macro_f1"], "S_Loc": final["S_Loc"], "S_Loc_mF1_proxy": s["loc_f1"], "mIoU_proxy": s["loc_iou"],
            "authentic_no_box_rate": s["authentic_no_box_rate"], "S_Exp": s["s_exp"], "S_Rep_proxy": s["s_rep"], "S_Rep_calibrated": final["S_Rep_calibrated"], "S_Fin_proxy": final["S_Fin"], "S_Fin_calibrated": final["S_Fin_calibrated"],
        },
        "calibration_anchors": [scoring.ANCHOR] if calibrate else None,
        "binary_confusion": {k.upper(): v for k, v in s["binary"].items()},
        "confusion": {k: v for k, v in sorted(s["confusion"].items()) if v},
        "loc_methods": {k: v for k, v in sorted(s["methods"].items()) if v},
        "rep_breakdown_avg": {k: v for k, v in sorted(s["parts"].items()) if v is not None},
        "top_issues": {k: -n for n, _, k in issues},
        "by_language": {k: {c: r[c] for c in BY_LANGUAGE} for k, r in sorted((k, r) for k, r in told.items() if k is not None)},
    }
    if samples is not None:
        doc["samples"] = [json.loads(r[0]) for r in samples.drop("mask").orderBy("image_name").select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).toLocalIterator()]
    return doc


def write_summary(document: dict, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as out:
        json.dump(document, out, ensure_ascii=False, indent=2)


def console(document: dict) -> str:
    lines = [f"samples: {document['num_common']} of {document['num_gt']}"]
    lines += [f"{k}: {v:.4f}" for k, v in document["scores"].items() if isinstance(v, float)]
    lines += [f"{k}: {v}" for k, v in list(document["top_issues"].items())[:8]]
    return "\n".join(lines)


def warnings(info: dict) -> list[str]:
    """What a run should be warned of."""
    out = []
    if info["duplicates"]:
        out.append(f"{info['duplicates']} duplicate image_name in predictions; the last one counts")
    if info["empty"]:
        out.append(f"{info['empty']} predictions have an empty report")
    if info["coverage"] < 0.95:
        out.append(f"predictions cover {info['coverage']:.1%} of the ground truth; the rest is in no mean")
    if not info["has_gt_reports"]:
        out.append("the ground truth has no reports; the explanation score is 0")
    return out
