"""Aggregates over samples; global and by language come from one pass over grouping sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring


def mean(c: Column) -> Column:
    """Mean of what is neither null nor NaN, 0 without any."""
    return F.coalesce(F.avg(F.nanvl(c.cast("double"), F.lit(None).cast("double"))), F.lit(0.0))


def binary(positive: str) -> dict[str, Column]:
    gt, pred = F.col("gt_label") == positive, F.col("pred_label") == positive
    return {"tp": F.count_if(gt & pred), "fp": F.count_if(~gt & pred), "fn": F.count_if(gt & ~pred), "tn": F.count_if(~gt & ~pred)}


def f1(positive: str = "FORGED") -> Column:
    b = binary(positive)
    return F.coalesce(F.try_divide(2.0 * b["tp"], 2 * b["tp"] + b["fp"] + b["fn"]), F.lit(0.0))


def macro_f1() -> Column:
    return (f1("FORGED") + f1("AUTHENTIC")) / 2


def localisation(allow_empty: bool) -> dict[str, Column]:
    """Means over forged samples; those that cannot be scored count as 0 with ``allow_empty``, else not at all."""
    last = [F.lit(0.0)] if allow_empty else []
    forged = F.col("gt_label") == "FORGED"
    scored = F.when(forged, F.coalesce("mask_f1", F.when(F.col("loc_method") != "no_gt_boxes", F.col("loc_score")), *last))
    return {"loc_f1": mean(scored), "loc_iou": mean(F.when(forged, F.coalesce("mask_iou", "box_miou", *last))), "n_scored": F.count(scored), "n_forged": F.count_if(forged)}


def measures(allow_empty: bool, exp: Column | None = None) -> list[Column]:
    loc = localisation(allow_empty)
    exp = F.col("exp_score") if exp is None else exp
    return [
        F.count(F.lit(1)).alias("n"), loc["n_forged"].alias("n_forged"), loc["n_scored"].alias("n_scored"), mean(F.col("det_correct").cast("int")).alias("accuracy"), f1().alias("f1"), macro_f1().alias("macro_f1"),
        loc["loc_f1"].alias("loc_f1"), loc["loc_iou"].alias("loc_iou"), mean(F.when(F.col("gt_label") == "AUTHENTIC", (F.col("pred_boxes") == 0).cast("int"))).alias("authentic_no_box_rate"),
        mean(exp).alias("s_exp"), mean(F.col("rep_score")).alias("s_rep"), mean(F.col("pred_report_len")).alias("avg_pred_report_len"), mean(F.col("gt_report_len")).alias("avg_gt_report_len"),
        mean((F.col("pred_script") == F.col("expected_script")).cast("int")).alias("script_match_rate"),
    ]


def by_language(samples: DataFrame, allow_empty: bool = False) -> DataFrame:
    return samples.groupBy("language_code").agg(*measures(allow_empty))


def rollup(samples: DataFrame, allow_empty: bool = False) -> DataFrame:
    """By language, and over all (language_code null, total true), in one pass."""
    return samples.rollup("language_code").agg(F.grouping("language_code").cast("boolean").alias("total"), *measures(allow_empty))


def chosen_of(s: dict, det: str = "accuracy", loc: str = "f1", calibrate: bool = False) -> dict:
    """S_Det, S_Loc and the final scores, of measures by name: columns, or the numbers themselves; calibrated ones are None without ``calibrate``."""
    if det not in ("accuracy", "f1", "macro_f1") or loc not in ("f1", "iou"):
        raise ValueError(f"no such metric: {det}, {loc}")
    own = {"S_Det": s[det], "S_Loc": s[f"loc_{loc}"], "S_Exp": s["s_exp"]}
    final = lambda rep: scoring.WEIGHTS["S_Det"] * own["S_Det"] + scoring.WEIGHTS["S_Loc"] * own["S_Loc"] + scoring.WEIGHTS["S_Exp"] * own["S_Exp"] + scoring.WEIGHTS["S_Rep"] * rep
    rep = scoring.calibrated(s["s_rep"]) if calibrate else None
    return {"S_Det": own["S_Det"], "S_Loc": own["S_Loc"], "S_Fin": final(s["s_rep"]), "S_Rep_calibrated": rep, "S_Fin_calibrated": final(rep) if calibrate else None}


def chosen(det: str = "accuracy", loc: str = "f1", calibrate: bool = False) -> dict[str, Column]:
    """``chosen_of`` over a row of measures."""
    names = ("accuracy", "f1", "macro_f1", "loc_f1", "loc_iou", "s_exp", "s_rep")
    return {k: F.lit(None).cast("double") if v is None else v for k, v in chosen_of({n: F.col(n) for n in names}, det, loc, calibrate).items()}


def scores(samples: DataFrame, det: str = "accuracy", loc: str = "f1", allow_empty: bool = False, calibrate: bool = False, has_gt_reports: bool = True) -> DataFrame:
    """One row: the measures over all samples with S_Det, S_Loc, S_Exp, S_Rep and the final scores."""
    return samples.agg(*measures(allow_empty, None if has_gt_reports else F.lit(0.0))).withColumns(chosen(det, loc, calibrate))


def confusion(samples: DataFrame) -> DataFrame:
    return samples.groupBy("gt_label", "pred_label").agg(F.count(F.lit(1)).alias("n")).orderBy("gt_label", "pred_label")


def loc_methods(samples: DataFrame) -> DataFrame:
    return samples.groupBy("loc_method").agg(F.count(F.lit(1)).alias("n")).orderBy("loc_method")


# What labels, methods and issues can be.
LABELS = ("FORGED", "AUTHENTIC", "UNKNOWN")
METHODS = ("mask_f1", "box_miou", "no_gt_boxes", "skipped_authentic", "none")
ISSUES = (
    "empty_report", "missing_or_invalid_conclusion", "missing_risk_score", "malformed_grounding", "invalid_box_order", "missing_summary", "missing_header", "missing_detail_section", "missing_end_marker",
    "authentic_predicted_with_boxes", "forged_without_boxes",
)


def everything(samples: DataFrame, allow_empty: bool = False) -> DataFrame:
    """All figures of a summary in one pass: by language, and over all (language_code null, total true).

    measures, binary (tp, fp, fn, tn), confusion (counts by "true->predicted"), methods, parts (means of report quality) and issues (by name: n, and
    where the issue came first in the order of image names).
    """
    pairs = {f"{g}->{p}": F.count_if((F.col("gt_label") == g) & (F.col("pred_label") == p)) for g in LABELS for p in LABELS}
    named = lambda values: F.struct(*(c.alias(k) for k, c in values.items()))
    at = lambda k: F.array_position("issues", F.lit(k))
    issues = {k: F.struct(F.sum(F.size("issues") - F.size(F.array_remove("issues", k))).alias("n"), F.min(F.when(at(k) > 0, F.struct(F.col("image_name").alias("image_name"), at(k).alias("at")))).alias("first")) for k in ISSUES}
    return samples.rollup("language_code").agg(
        F.grouping("language_code").cast("boolean").alias("total"), *measures(allow_empty), named(binary("FORGED")).alias("binary"), named(pairs).alias("confusion"),
        named({k: F.count_if(F.col("loc_method") == k) for k in METHODS}).alias("methods"), named({k: F.avg(f"rep_breakdown.{k}") for k in (*scoring.PARTS, "language_factor")}).alias("parts"), named(issues).alias("issues"),
    )


def top_issues(samples: DataFrame, k: int = 20) -> DataFrame:
    """The k most frequent issues, every occurrence counted; among equals the one seen first in the order of image names."""
    each = samples.select("image_name", F.posexplode("issues").alias("at", "issue"))
    return each.groupBy("issue").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("image_name", "at")).alias("first")).orderBy(F.desc("n"), "first").limit(k).select("issue", "n")


def breakdown(samples: DataFrame) -> DataFrame:
    """One row: the mean of each report-quality part over the reports that are not empty."""
    return samples.agg(*(F.avg(f"rep_breakdown.{k}").alias(k) for k in (*scoring.PARTS, "language_factor")))


def diagnostics(gt: DataFrame, pred: DataFrame) -> DataFrame:
    """One row over keyed rows before deduplication: counts, duplicates, empty reports, coverage, whether ground truth has reports."""
    g = gt.agg(F.count(F.lit(1)).alias("num_gt"), F.coalesce(F.bool_or(F.col("report") != ""), F.lit(False)).alias("has_gt_reports"))
    p = pred.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("image_name").alias("num_pred"), F.count_if(~F.col("has_text")).alias("empty"))
    c = gt.select("image_name").distinct().join(pred.select("image_name"), "image_name", "left_semi").agg(F.count(F.lit(1)).alias("num_common"))
    one = g.crossJoin(p).crossJoin(c)  # one row each
    return one.select("num_gt", "num_pred", "num_common", (F.col("rows") - F.col("num_pred")).alias("duplicates"), "empty", "has_gt_reports", (F.col("num_common") / F.greatest(F.lit(1), "num_gt")).alias("coverage"))


def profile(gt: DataFrame) -> DataFrame:
    """Counts by label and language, with those that have a mask."""
    return gt.groupBy("gt_label", "language_code").agg(F.count(F.lit(1)).alias("n"), F.count("mask_path").alias("n_masks"))
