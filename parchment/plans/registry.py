"""All queries of the evaluation engine by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, report, scoring
from ..operators import evaluate as ev
from ..operators import summary
from ..sources import sinks
from ..streaming import inference
from . import synthetic as syn

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its name; ``sql`` selects from the tables of ``_WITH`` below."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"{_WITH} {sql}"
        return f

    return keep


def _iou(g: int, p: int) -> str:
    w, h = (f"greatest(0.0, least(g{a}2_{g}, p{a}2_{p}) - greatest(g{a}1_{g}, p{a}1_{p}))" for a in "xy")
    area = lambda s, j: f"({s}x2_{j} - {s}x1_{j}) * ({s}y2_{j} - {s}y1_{j})"
    return f"({w} * {h}) / ({area('g', g)} + {area('p', p)} - {w} * {h})"


def _best(g: int) -> str:
    return "greatest(" + ", ".join(f"CASE WHEN n_boxes >= {p} THEN {_iou(g, p)} ELSE 0.0 END" for p in syn.BOXES) + ")"


_LANG = "CASE language_code WHEN 'th' THEN 'th' WHEN 'ar' THEN 'ar' WHEN 'zh' THEN 'zh' ELSE 'latin' END"
_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"

# What a sample should come to, from the columns of the spec.
_WITH = (
    f"""
WITH spec AS ({syn.SPEC.format(**syn.DUCKDB)}), p AS (
    SELECT *, CASE WHEN gt_word = 'UNSURE' THEN 'UNKNOWN' ELSE gt_word END AS gt_label, CASE WHEN is_empty OR no_verdict THEN 'UNKNOWN' ELSE verdict END AS pred_label,
           CASE WHEN is_empty THEN NULL WHEN risk_word > 100 THEN 100 ELSE risk_word END AS risk, CASE WHEN is_empty OR i % 11 = 0 OR i % 13 = 0 THEN 0 ELSE n_boxes END AS n_parsed,
           CASE WHEN is_empty THEN 0 ELSE n_boxes END AS n_reasons, CASE WHEN is_empty THEN 'other' ELSE script END AS pred_script, {_LANG} AS expected_script,
           CASE WHEN is_empty THEN '' ELSE pred_summary END AS summary, length(pred_report) AS pred_len, length(gt_report) AS gt_len
    FROM spec
), q AS (
    SELECT *, CASE WHEN i % 17 = 0 AND width IS NOT NULL THEN 0 ELSE n_parsed END AS n_valid FROM p
), s0 AS (
    SELECT *, CASE WHEN gt_label <> 'FORGED' OR n_boxes = 0 THEN NULL WHEN n_valid = 0 THEN 0.0
                   ELSE ({" + ".join(f"CASE WHEN n_boxes >= {g} THEN {_best(g)} ELSE 0.0 END" for g in syn.BOXES)}) / n_boxes END AS box_miou,
           CASE WHEN gt_label = 'AUTHENTIC' THEN CASE WHEN n_valid = 0 THEN 1.0 ELSE 0.0 END WHEN n_boxes = 0 THEN NULL WHEN n_boxes = n_valid THEN 1.0 ELSE 0.0 END AS count_score,
           CASE WHEN is_empty THEN NULL ELSE 0.45 + CASE WHEN pred_label <> 'UNKNOWN' THEN 0.2 ELSE 0 END + CASE WHEN risk IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN summary <> '' THEN 0.2 ELSE 0 END END AS format,
           CASE WHEN is_empty THEN NULL WHEN pred_label = 'UNKNOWN' OR risk IS NULL THEN 0.0 WHEN pred_label = 'AUTHENTIC' THEN CASE WHEN risk <= 10 THEN 0.5 ELSE 0 END + CASE WHEN n_parsed = 0 THEN 0.5 ELSE 0 END
                ELSE CASE WHEN risk >= 20 THEN 0.5 ELSE 0 END + CASE WHEN n_parsed > 0 THEN 0.5 ELSE 0 END END AS self_consistency,
           CASE WHEN is_empty THEN NULL WHEN pred_label = gt_label AND gt_label <> 'UNKNOWN' THEN 1.0 ELSE 0.0 END AS verdict_match,
           CASE WHEN is_empty THEN NULL WHEN pred_label = 'AUTHENTIC' THEN CASE WHEN n_parsed = 0 THEN 1.0 ELSE 0.0 END WHEN n_parsed = 0 THEN 0.0 ELSE 0.5 * n_valid / n_parsed + 0.5 * least(1.0, n_reasons / n_parsed) END AS grounding,
           CASE WHEN is_empty THEN NULL WHEN gt_label = 'FORGED' AND n_boxes > 0 THEN greatest(0.0, 1 - abs(n_parsed - n_boxes) / n_boxes) WHEN gt_label = 'AUTHENTIC' THEN CASE WHEN n_parsed = 0 THEN 1.0 ELSE 0.0 END ELSE 0.5 END AS count_align,
           CASE WHEN is_empty THEN NULL WHEN gt_label = 'AUTHENTIC' THEN least(1.0, length(summary) / 600.0) WHEN n_reasons = 0 THEN 0.5 * least(1.0, length(summary) / 220.0)
                ELSE 0.5 * least(1.0, length(pred_reason) / 200.0) + 0.5 * least(1.0, length(summary) / 220.0) END AS detail,
           pred_len / CASE WHEN gt_label = 'AUTHENTIC' THEN 1281.0 ELSE 3453.0 END AS ratio,
           CASE WHEN is_empty THEN NULL WHEN expected_script = 'latin' THEN CASE WHEN pred_script IN ('latin', 'other') THEN 1.0 ELSE 0.85 END WHEN pred_script = expected_script THEN 1.0 WHEN pred_script = 'other' THEN 0.75 ELSE 0.6 END AS language_factor
    FROM q WHERE has_gt AND has_pred
), s1 AS (
    SELECT *, CASE WHEN is_empty THEN NULL WHEN ratio >= 0.5 AND ratio <= 1.5 THEN 1.0 WHEN ratio < 0.5 THEN greatest(0.0, (ratio - 0.2) / 0.3) ELSE greatest(0.0, (3 - ratio) / 1.5) END AS length_align,
           CASE WHEN gt_label = 'AUTHENTIC' THEN 'skipped_authentic' WHEN gt_label <> 'FORGED' THEN 'none' WHEN box_miou IS NOT NULL THEN 'box_miou' ELSE 'no_gt_boxes' END AS loc_method, gt_label = pred_label AS det_correct
    FROM s0
), tok AS (
    SELECT i, 'g' AS side, unnest({_TOKENS.format('gt_report')}) AS w FROM s1 UNION ALL SELECT i, 'p', unnest({_TOKENS.format('pred_report')}) FROM s1
), tf AS (
    SELECT i, w, count(*) FILTER (WHERE side = 'g') AS a, count(*) FILTER (WHERE side = 'p') AS b FROM tok GROUP BY i, w
), te AS (
    SELECT i, 2.0 * sum(least(a, b)) / (sum(a) + sum(b)) AS exp_score FROM tf GROUP BY i
), s AS (
    SELECT s1.*, te.exp_score, CASE WHEN is_empty THEN 0.0 ELSE """
    + "least(1.0, ("
    + " + ".join(f"{w} * {k}" for k, w in scoring.PARTS.items())
    + """) * language_factor) END AS rep_score FROM s1 JOIN te ON s1.i = te.i
), issues AS (
    SELECT i, image_name, 0 AS at, 'empty_report' AS issue FROM s WHERE is_empty
    UNION ALL SELECT i, image_name, 0, 'missing_or_invalid_conclusion' FROM s WHERE no_verdict AND NOT is_empty
    UNION ALL SELECT i, image_name, 1, 'missing_risk_score' FROM s WHERE risk_word IS NULL AND NOT is_empty
    UNION ALL SELECT i, image_name, 1 + j, CASE WHEN i % 11 = 0 THEN 'malformed_grounding' ELSE 'invalid_box_order' END FROM s, (VALUES (1), (2), (3)) v(j) WHERE j <= n_boxes AND (i % 11 = 0 OR i % 13 = 0) AND NOT is_empty
    UNION ALL SELECT i, image_name, 9, 'authentic_predicted_with_boxes' FROM s WHERE gt_label = 'AUTHENTIC' AND n_valid > 0
    UNION ALL SELECT i, image_name, 9, 'forged_without_boxes' FROM s WHERE gt_label = 'FORGED' AND n_valid = 0
)"""
)


def _r(c: Column | str, name: str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name)


def gt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.last_wins(ev.prepare_truth(syn.ground_truth(spark, sf_dir)), "image_name")


def pred_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.last_wins(ev.prepare_predictions(syn.predictions(spark, sf_dir), raw=True), "image_name")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.samples(gt_rows(spark, sf_dir), pred_rows(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pred_rows(spark, sf_dir).select("image_name", report.parse_report(F.col("report")).alias("p"))


_PREDS = "FROM q WHERE has_pred"


@query(f"SELECT image_name, pred_label AS conclusion {_PREDS}")
def q_parse_conclusion(spark, sf_dir):
    return parsed(spark, sf_dir).select("image_name", "p.conclusion")


@query(f"SELECT image_name, risk AS risk_score {_PREDS}")
def q_parse_risk(spark, sf_dir):
    return parsed(spark, sf_dir).select("image_name", "p.risk_score")


@query(f"SELECT image_name, j AS k, CAST(CASE j " + " ".join(f"WHEN {j} THEN px1_{j}" for j in syn.BOXES) + " END AS DOUBLE) AS x1, CAST(CASE j " + " ".join(f"WHEN {j} THEN py2_{j}" for j in syn.BOXES) + " END AS DOUBLE) AS y2 FROM q, (VALUES (1), (2), (3)) v(j) WHERE has_pred AND j <= n_parsed")
def q_parse_boxes(spark, sf_dir):
    return parsed(spark, sf_dir).select("image_name", F.posexplode("p.boxes").alias("k", "b")).select("image_name", (F.col("k") + 1).alias("k"), "b.x1", "b.y2")


@query(f"SELECT image_name, n_reasons, CASE WHEN n_reasons > 0 THEN pred_reason END AS first_reason {_PREDS}")
def q_parse_reasons(spark, sf_dir):
    return parsed(spark, sf_dir).select("image_name", F.size("p.reasons").alias("n_reasons"), F.get("p.reasons", F.lit(0)).alias("first_reason"))


@query(f"SELECT image_name, summary, CAST(pred_len AS INT) AS report_len {_PREDS}")
def q_parse_summary(spark, sf_dir):
    return parsed(spark, sf_dir).select("image_name", "p.summary", "p.report_len")


@query("SELECT image_name, issue FROM issues")
def q_parse_issues(spark, sf_dir):
    return samples(spark, sf_dir).select("image_name", F.explode("issues").alias("issue"))


@query("SELECT gt_label, pred_label, count(*) AS n FROM s GROUP BY ALL")
def q_detect_confusion(spark, sf_dir):
    return summary.confusion(samples(spark, sf_dir))


_F1 = "coalesce(2.0 * count(*) FILTER (WHERE gt_label = '{0}' AND pred_label = '{0}') / nullif(count(*) FILTER (WHERE gt_label = '{0}') + count(*) FILTER (WHERE pred_label = '{0}'), 0), 0)"
_F, _A = _F1.format("FORGED"), _F1.format("AUTHENTIC")


@query("SELECT count(*) FILTER (WHERE gt_label = 'FORGED' AND pred_label = 'FORGED') AS tp, count(*) FILTER (WHERE gt_label <> 'FORGED' AND pred_label = 'FORGED') AS fp, count(*) FILTER (WHERE gt_label = 'FORGED' AND pred_label <> 'FORGED') AS fn, count(*) FILTER (WHERE gt_label <> 'FORGED' AND pred_label <> 'FORGED') AS tn, " + f"round({_F}, 6) AS f1 FROM s")
def q_detect_f1(spark, sf_dir):
    return samples(spark, sf_dir).agg(*(c.alias(k) for k, c in summary.binary("FORGED").items()), _r(summary.f1(), "f1"))


@query(f"SELECT round(({_F} + {_A}) / 2, 6) AS macro_f1 FROM s")
def q_detect_macro(spark, sf_dir):
    return samples(spark, sf_dir).agg(_r(summary.macro_f1(), "macro_f1"))


@query("SELECT round(avg(CAST(det_correct AS INT)), 6) AS accuracy FROM s")
def q_accuracy(spark, sf_dir):
    return samples(spark, sf_dir).agg(_r(summary.mean(F.col("det_correct").cast("int")), "accuracy"))


def _gt_box(j: int, side: str):
    return F.struct(*(F.col(f"{side}{k}_{j}").cast("double").alias(k) for k in ("x1", "y1", "x2", "y2")))


@query("SELECT i, round(" + _iou(1, 1) + ", 6) AS iou FROM spec")
def q_box_iou(spark, sf_dir):
    return syn.spec(spark, sf_dir).select("i", _r(geometry.box_iou(_gt_box(1, "g"), _gt_box(1, "p")), "iou"))


@query("SELECT image_name, round(box_miou, 6) AS box_miou FROM s")
def q_best_iou(spark, sf_dir):
    return samples(spark, sf_dir).select("image_name", _r("box_miou", "box_miou"))


@query("SELECT image_name, CAST(count_score AS DOUBLE) AS count_score, n_valid AS pred_boxes, n_boxes AS gt_boxes FROM s")
def q_object_count(spark, sf_dir):
    return samples(spark, sf_dir).select("image_name", "count_score", "pred_boxes", "gt_boxes")


@query("SELECT i, CAST(round_even(least(width, greatest(0, px1_1 / 7.0 * 8)), 0) AS INT) AS x1, CAST(round_even(least(width, greatest(0, px2_1 / 7.0 * 8)), 0) AS INT) AS x2 FROM spec WHERE width IS NOT NULL AND least(width, px2_1 / 7.0 * 8) > least(width, px1_1 / 7.0 * 8) AND least(height, py2_1) > least(height, py1_1)")
def q_clamp(spark, sf_dir):
    b = F.struct((F.col("px1_1") / 7.0 * 8).alias("x1"), F.col("py1_1").cast("double").alias("y1"), (F.col("px2_1") / 7.0 * 8).alias("x2"), F.col("py2_1").cast("double").alias("y2"))
    kept = syn.spec(spark, sf_dir).where("width is not null").select("i", geometry.clamp_box(b, F.col("width"), F.col("height")).alias("c"))
    return kept.where("c is not null").select("i", "c.x1", "c.x2")


_SIDE = "CAST(greatest(14, round_even((CASE WHEN sqrt(1003520.0 / (2.0 * width * 3 * height)) < 1 THEN floor({0} * sqrt(1003520.0 / (2.0 * width * 3 * height))) ELSE {0} END) / 14.0, 0) * 14) AS INT)"
_W, _H = _SIDE.format("2.0 * width"), _SIDE.format("3.0 * height")


@query(f"SELECT i, {_W} AS w, {_H} AS h, CAST(greatest(0, least(2 * width, round_even(gx1_1 * (2.0 * width / {_W}), 0))) AS INT) AS x1, CAST(greatest(0, least(3 * height, round_even(gy2_1 * (3.0 * height / {_H}), 0))) AS INT) AS y2 FROM spec WHERE width IS NOT NULL")
def q_rescale(spark, sf_dir):
    w, h = F.col("width") * 2, F.col("height") * 3
    rows = syn.spec(spark, sf_dir).where("width is not null").select("i", geometry.model_size(w, h).alias("m"), geometry.to_original(_gt_box(1, "g"), w, h).alias("b"))
    return rows.select("i", "m.w", "m.h", "b.x1", "b.y2")


def _inter(a: str, b: str) -> str:
    x1, x2 = f"greatest({a.format('x1')}, {b.format('x1')})", f"least({a.format('x2')}, {b.format('x2')})"
    y1, y2 = f"greatest({a.format('y1')}, {b.format('y1')})", f"least({a.format('y2')}, {b.format('y2')})"
    return f"greatest(0, {x2} - {x1}) * greatest(0, {y2} - {y1})"


_G, _P = "g{}_1", "p{}_1"


@query(f"SELECT i, CAST((gx2_1 - gx1_1) * (gy2_1 - gy1_1) + (px2_1 - px1_1) * (py2_1 - py1_1) - {_inter(_G, _P)} AS DOUBLE) AS area FROM spec")
def q_union_area(spark, sf_dir):
    return syn.spec(spark, sf_dir).select("i", geometry.union_area(F.array(_gt_box(1, "g"), _gt_box(1, "p"))).alias("area"))


@query("SELECT image_name, loc_method, round(box_miou, 6) AS loc_score FROM s")
def q_loc_cascade(spark, sf_dir):
    return samples(spark, sf_dir).select("image_name", "loc_method", _r("loc_score", "loc_score"))


# Pixel by pixel: those of the masks, and those of the predicted boxes, by image.
_PIXELS = f"""
    , sides AS (
        SELECT i, CAST(width AS BIGINT) AS w, CAST(height AS BIGINT) AS h, n_valid > 0 AS boxed, unnest([{", ".join(f"{{'j': {j}, 'gx1': gx1_{j}, 'gy1': gy1_{j}, 'gx2': gx2_{j}, 'gy2': gy2_{j}, 'px1': px1_{j}, 'py1': py1_{j}, 'px2': px2_{j}, 'py2': py2_{j}}}" for j in syn.BOXES)}]) AS b, n_boxes
        FROM s WHERE {syn.HAS_MASK}
    ), lines AS (
        SELECT DISTINCT i, 'g' AS side, w, y, b.gx1 + y % 5 AS x1, b.gx2 - y % 3 AS x2 FROM (SELECT *, unnest(range(b.gy1, least(b.gy2, h))) AS y FROM sides WHERE b.j <= n_boxes) WHERE {syn.IN_MASK}
        UNION ALL SELECT i, 'p', w, y, b.px1, b.px2 FROM (SELECT *, unnest(range(b.py1, least(b.py2, h))) AS y FROM sides WHERE b.j <= n_boxes AND boxed)
    ), pixels AS (
        SELECT DISTINCT i, side, y, unnest(range(x1, least(x2, w))) AS x FROM lines
    ), met AS (
        SELECT i, y, x, count(*) FILTER (WHERE side = 'g') AS g, count(*) FILTER (WHERE side = 'p') AS p FROM pixels GROUP BY i, y, x
    ), masked AS (
        SELECT i, count(*) FILTER (WHERE g > 0 AND p > 0) AS tp, count(*) FILTER (WHERE g = 0) AS fp, count(*) FILTER (WHERE p = 0) AS fn FROM met GROUP BY i
    )"""


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.samples(gt_rows(spark, sf_dir), pred_rows(spark, sf_dir), syn.masks(spark, sf_dir))


@query(f"{_PIXELS} SELECT image_name, tp, fp, fn, round(tp / (tp + fp + fn), 6) AS mask_iou, round(2.0 * tp / (2 * tp + fp + fn), 6) AS mask_f1 FROM masked JOIN s ON masked.i = s.i")
def q_mask_f1(spark, sf_dir):
    return masked(spark, sf_dir).where("mask is not null").select("image_name", "mask.tp", "mask.fp", "mask.fn", _r("mask_iou", "mask_iou"), _r("mask_f1", "mask_f1"))


@query(f"{_PIXELS} SELECT image_name, CASE WHEN tp IS NOT NULL THEN 'mask_f1' ELSE loc_method END AS loc_method, round(coalesce(2.0 * tp / (2 * tp + fp + fn), box_miou), 6) AS loc_score, round(box_miou, 6) AS box_miou FROM s LEFT JOIN masked ON masked.i = s.i")
def q_loc_cascade_mask(spark, sf_dir):
    return masked(spark, sf_dir).select("image_name", "loc_method", _r("loc_score", "loc_score"), _r("box_miou", "box_miou"))


@query(f"{_PIXELS} SELECT true AS allow_empty, count(*) AS n_scored, round(avg(coalesce(2.0 * tp / (2 * tp + fp + fn), box_miou, 0)), 6) AS loc_f1, round(avg(coalesce(tp / (tp + fp + fn), box_miou, 0)), 6) AS loc_iou FROM s LEFT JOIN masked ON masked.i = s.i WHERE gt_label = 'FORGED' UNION ALL SELECT false, count(coalesce(2.0 * tp / (2 * tp + fp + fn), box_miou)), round(avg(coalesce(2.0 * tp / (2 * tp + fp + fn), box_miou)), 6), round(avg(coalesce(tp / (tp + fp + fn), box_miou)), 6) FROM s LEFT JOIN masked ON masked.i = s.i WHERE gt_label = 'FORGED'")
def q_loc_agg_mask(spark, sf_dir):
    told = {allow: summary.localisation(allow) for allow in (True, False)}
    one = masked(spark, sf_dir).agg(*(F.struct(F.lit(allow).alias("allow_empty"), m["n_scored"].alias("n_scored"), _r(m["loc_f1"], "loc_f1"), _r(m["loc_iou"], "loc_iou")).alias(f"_{allow}") for allow, m in told.items()))
    return one.select(F.inline(F.array("_True", "_False")))


@query("SELECT round(avg(coalesce(box_miou, 0)), 6) AS with_empty, round(avg(box_miou), 6) AS without, count(box_miou) AS n_scored, count(*) AS n_forged FROM s WHERE gt_label = 'FORGED'")
def q_loc_agg(spark, sf_dir):
    a, b = summary.localisation(True), summary.localisation(False)
    return samples(spark, sf_dir).agg(_r(a["loc_f1"], "with_empty"), _r(b["loc_iou"], "without"), b["n_scored"].alias("n_scored"), b["n_forged"].alias("n_forged"))


def _part(name: str) -> None:
    def f(spark: SparkSession, sf_dir: str) -> DataFrame:
        return samples(spark, sf_dir).select("image_name", _r(f"rep_breakdown.{name}", "value"))

    f.__name__ = f"q_{name}"
    query(f"SELECT image_name, round(CAST({name} AS DOUBLE), 6) AS value FROM s")(f)


for _name in (*scoring.PARTS, "language_factor"):
    _part(_name)


@query("SELECT image_name, round(CAST(rep_score AS DOUBLE), 6) AS rep_score FROM s")
def q_report_quality(spark, sf_dir):
    return samples(spark, sf_dir).select("image_name", _r("rep_score", "rep_score"))


@query("SELECT image_name, pred_script, expected_script FROM s")
def q_script_bucket(spark, sf_dir):
    return samples(spark, sf_dir).select("image_name", "pred_script", "expected_script")


def _script_sql() -> str:
    """Each script's characters and minus the length of what precedes the first, the greatest of them all."""
    found = ", ".join(f"{{'n': length(regexp_replace(t, '[^{p[1:-1]}]', '', 'g')), 'first': -length(regexp_extract(t, '^[^{p[1:-1]}]*')), 'script': '{name}'}}" for name, p in scoring.SCRIPTS.items())
    return f"SELECT doc_id, CASE WHEN best.n > 0 THEN best.script ELSE 'other' END AS script, best.n AS n FROM (SELECT doc_id, list_max([{found}]) AS best FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"


@query(_script_sql())
def q_script_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = docs.select("doc_id", scoring.best_script(F.col("text")).alias("best"))
    return found.select("doc_id", F.when(F.col("best.n") > 0, F.col("best.script")).otherwise("other").alias("script"), F.col("best.n").cast("long").alias("n"))


@query("SELECT image_name, round(exp_score, 6) AS exp_score FROM s")
def q_token_f1(spark, sf_dir):
    return samples(spark, sf_dir).select("image_name", _r("exp_score", "exp_score"))


@query("SELECT language_code, round(avg(exp_score), 6) AS s_exp FROM s GROUP BY ALL")
def q_token_f1_by_lang(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("language_code").agg(_r(summary.mean(F.col("exp_score")), "s_exp"))


_FINAL = "0.30 * avg(CAST(det_correct AS INT)) + 0.20 * coalesce(avg(box_miou), 0) + 0.15 * avg(exp_score) + 0.35 * avg(rep_score)"


@query(f"SELECT round({_FINAL}, 6) AS s_fin FROM s")
def q_final_score(spark, sf_dir):
    return summary.scores(samples(spark, sf_dir)).select(_r("S_Fin", "s_fin"))


_CAL = "((0.2409 - 0.30 * 0.63 - 0.20 * 0.0186 - 0.15 * 0.1381) / 0.35 / 0.5342)"


@query(f"SELECT round(avg(rep_score) * {_CAL}, 6) AS s_rep_calibrated, round({_FINAL} - 0.35 * avg(rep_score) * (1 - {_CAL}), 6) AS s_fin_calibrated FROM s")
def q_calibrated(spark, sf_dir):
    return summary.scores(samples(spark, sf_dir), calibrate=True).select(_r("S_Rep_calibrated", "s_rep_calibrated"), _r("S_Fin_calibrated", "s_fin_calibrated"))


_LANG_AGG = f"""count(*) AS n, count(*) FILTER (WHERE gt_label = 'FORGED') AS n_forged, round(avg(CAST(det_correct AS INT)), 6) AS accuracy, round({_F}, 6) AS f1, round(coalesce(avg(box_miou), 0), 6) AS loc_f1,
    round(avg(rep_score), 6) AS s_rep, round(avg(exp_score), 6) AS s_exp, round(avg(pred_len), 6) AS avg_pred_report_len, round(avg(gt_len), 6) AS avg_gt_report_len, round(avg(CAST(pred_script = expected_script AS INT)), 6) AS script_match_rate"""
_LANG_COLUMNS = ("accuracy", "f1", "loc_f1", "s_rep", "s_exp", "avg_pred_report_len", "avg_gt_report_len", "script_match_rate")


@query(f"SELECT language_code, {_LANG_AGG} FROM s GROUP BY language_code")
def q_by_language(spark, sf_dir):
    return summary.by_language(samples(spark, sf_dir)).select("language_code", "n", "n_forged", *(_r(c, c) for c in _LANG_COLUMNS))


@query(f"SELECT language_code, grouping(language_code) = 1 AS total, {_LANG_AGG} FROM s GROUP BY ROLLUP (language_code)")
def q_rollup(spark, sf_dir):
    return summary.rollup(samples(spark, sf_dir)).select("language_code", "total", "n", "n_forged", *(_r(c, c) for c in _LANG_COLUMNS))


@query("SELECT issue, count(*) AS n FROM issues GROUP BY issue ORDER BY n DESC, min(image_name) LIMIT 20")
def q_issue_top20(spark, sf_dir):
    return summary.top_issues(samples(spark, sf_dir))


@query("SELECT loc_method, count(*) AS n FROM s GROUP BY ALL")
def q_loc_methods(spark, sf_dir):
    return summary.loc_methods(samples(spark, sf_dir))


@query("SELECT " + ", ".join(f"round(avg(CAST({k} AS DOUBLE)), 6) AS {k}" for k in (*scoring.PARTS, "language_factor")) + " FROM s")
def q_breakdown_avg(spark, sf_dir):
    rows = summary.breakdown(samples(spark, sf_dir))
    return rows.select(*(_r(c, c) for c in rows.columns))


@query("SELECT round(coalesce(avg(CASE WHEN n_valid = 0 THEN 1.0 ELSE 0.0 END), 0), 6) AS rate FROM s WHERE gt_label = 'AUTHENTIC'")
def q_no_box_rate(spark, sf_dir):
    return summary.scores(samples(spark, sf_dir)).select(_r("authentic_no_box_rate", "rate"))


@query("SELECT image_name, length(pred_report) AS n, NOT is_empty AS has_text FROM spec WHERE has_pred")
def q_dedupe_last(spark, sf_dir):
    return pred_rows(spark, sf_dir).select("image_name", F.length("report").cast("long").alias("n"), "has_text")


@query("SELECT count(*) FILTER (WHERE has_gt) AS num_gt, count(*) FILTER (WHERE has_pred) AS num_pred, count(*) FILTER (WHERE has_gt AND has_pred) AS num_common, count(*) FILTER (WHERE has_pred AND is_doubled) AS duplicates, count(*) FILTER (WHERE has_pred AND is_empty) AS empty, true AS has_gt_reports, round(count(*) FILTER (WHERE has_gt AND has_pred) / count(*) FILTER (WHERE has_gt), 6) AS coverage FROM spec")
def q_coverage(spark, sf_dir):
    d = summary.diagnostics(ev.prepare_truth(syn.ground_truth(spark, sf_dir)), ev.prepare_predictions(syn.predictions(spark, sf_dir), raw=True))
    return d.withColumn("coverage", F.round("coverage", 6))


@query("SELECT image_name, CASE WHEN i % 3 = 0 THEN pred_report WHEN i % 3 = 1 THEN pred_reason ELSE CASE WHEN is_empty THEN '' ELSE pred_summary END END AS report FROM spec")
def q_coalesce_report(spark, sf_dir):
    rows = syn.spec(spark, sf_dir).selectExpr("image_name", "CASE WHEN i % 3 = 0 THEN pred_report ELSE '' END AS report", "CASE WHEN i % 3 = 1 THEN pred_reason END AS raw_output", "CASE WHEN i % 3 = 2 AND NOT is_empty THEN pred_summary END AS api_raw_content")
    return ev.prepare_predictions(rows, raw=True).select("image_name", "report")


@query("SELECT sample_id FROM (SELECT CAST(i AS VARCHAR) AS sample_id, i, has_gt FROM spec) WHERE has_gt AND i % 3 <> 0")
def q_resume_anti(spark, sf_dir):
    gt = syn.ground_truth(spark, sf_dir)
    done = gt.where("ord % 3 = 0").selectExpr("sample_id", "CAST(NULL AS STRING) AS image_name")
    return inference.todo(gt.withColumn("image_path", F.lit(None).cast("string")), done).select("sample_id")


@query("SELECT i, CASE i % 4 WHEN 0 THEN 'why ' || pred_summary WHEN 1 THEN 'a' ELSE '' END AS thinking, i % 4 < 2 AS has_think_tag, i % 2 = 1 AS has_report_tag, CASE WHEN is_empty THEN -1 ELSE length(pred_report) END AS n FROM spec WHERE has_pred")
def q_split_output(spark, sf_dir):
    rows = syn.raw_outputs(spark, sf_dir).select("i", "is_empty", report.split_output(F.col("raw")).alias("s"))
    return rows.select("i", "s.thinking", "s.has_think_tag", "s.has_report_tag", F.when(F.col("is_empty"), -1).otherwise(F.length("s.report")).cast("long").alias("n"))


@query("SELECT i, CASE WHEN n_boxes > 0 AND i % 11 <> 0 AND NOT is_empty THEN CAST(greatest(0, least(2 * width, round_even(CASE WHEN i % 13 = 0 THEN px2_1 ELSE px1_1 END * (2.0 * width / " + _W + "), 0))) AS INT) END AS x1 FROM spec WHERE has_pred AND width IS NOT NULL")
def q_rewrite_boxes(spark, sf_dir):
    rows = syn.raw_outputs(spark, sf_dir).where("width is not null").select("i", report.rescale_report(F.col("pred_report"), F.col("width") * 2, F.col("height") * 3).alias("r"))
    first = F.regexp_extract("r", r"\[GROUNDING\]: \[([0-9]+), [0-9]+, [0-9]+, [0-9]+\]", 1)
    return rows.select("i", F.when(first != "", first.try_cast("int")).alias("x1"))


@query("SELECT i, CASE WHEN i % 59 = 0 THEN 'TimeoutError()' END AS error, CASE WHEN i % 59 = 0 THEN NULL WHEN is_empty OR no_verdict THEN 'UNKNOWN' ELSE verdict END AS conclusion, CASE WHEN i % 59 = 0 THEN NULL WHEN is_empty THEN 0 WHEN risk_word IS NULL THEN CASE WHEN NOT no_verdict AND verdict = 'FORGED' THEN 80 ELSE 0 END ELSE least(100, risk_word) END AS risk_score, CASE WHEN i % 59 = 0 THEN NULL WHEN is_empty THEN 0 ELSE n_boxes END AS n_anomalies FROM spec WHERE has_pred")
def q_record(spark, sf_dir):
    rows = syn.raw_outputs(spark, sf_dir).select("i", report.record(F.col("raw"), F.col("error"), F.col("width"), F.col("height")).alias("r"))
    return rows.select("i", "r.error", "r.parsed.conclusion", "r.parsed.risk_score", F.when(F.col("r.parsed").isNotNull(), F.size("r.parsed.anomalies")).alias("n_anomalies"))


@query("SELECT gt_word AS gt_label, language_code, count(*) AS n, CAST(0 AS BIGINT) AS n_masks FROM spec WHERE has_gt GROUP BY ALL")
def q_dataset_profile(spark, sf_dir):
    return summary.profile(gt_rows(spark, sf_dir).withColumn("gt_label", F.col("label")))


_CSV_PARTS = ", ".join(f"round(CAST({k} AS DOUBLE), 6) AS rep_{k}" for k in (*scoring.PARTS, "language_factor"))


@query(f"""SELECT s.image_name, CAST(s.i AS VARCHAR) AS sample_id, language_code, expected_script, pred_script, gt_label, pred_label, CASE WHEN det_correct THEN 'True' ELSE 'False' END AS det_correct,
    round(box_miou, 6) AS loc_score, loc_method, round(box_miou, 6) AS box_miou, CAST(NULL AS DOUBLE) AS mask_iou, CAST(NULL AS DOUBLE) AS mask_f1, CAST(count_score AS DOUBLE) AS count_score, round(exp_score, 6) AS exp_score,
    round(CAST(rep_score AS DOUBLE), 6) AS rep_score, {_CSV_PARTS}, n_valid AS pred_boxes, n_boxes AS gt_boxes, CAST(pred_len AS INT) AS pred_report_len, CAST(gt_len AS INT) AS gt_report_len, coalesce(told, '') AS issues
    FROM s LEFT JOIN (SELECT i, string_agg(issue, ';' ORDER BY issues."at") AS told FROM issues GROUP BY i) t ON s.i = t.i""")
def q_samples_csv(spark, sf_dir):
    rows = sinks.csv_frame(samples(spark, sf_dir))
    return rows.select(*(F.round(f.name, 6).alias(f.name) if f.dataType.typeName() == "double" else f.name for f in rows.schema))


_CHOICES = {(det, loc): (d, m) for det, d in (("accuracy", "avg(CAST(det_correct AS INT))"), ("f1", _F), ("macro_f1", f"(({_F}) + ({_A})) / 2")) for loc, m in (("f1", "coalesce(avg(mask_f1), 0)"), ("iou", "coalesce(avg(mask_iou), 0)"))}


@query(f"{_PIXELS}, scored AS (SELECT s.*, coalesce(2.0 * tp / (2 * tp + fp + fn), box_miou) AS mask_f1, coalesce(tp / (tp + fp + fn), box_miou) AS mask_iou FROM s LEFT JOIN masked ON masked.i = s.i) " + " UNION ALL ".join(f"SELECT '{det}' AS det, '{loc}' AS loc, round({d}, 6) AS s_det, round({m}, 6) AS s_loc, round(0.30 * {d} + 0.20 * {m} + 0.15 * avg(exp_score) + 0.35 * avg(rep_score), 6) AS s_fin FROM scored" for (det, loc), (d, m) in _CHOICES.items()))
def q_score_choices(spark, sf_dir):
    one = masked(spark, sf_dir).agg(*summary.measures(False))
    told = []
    for det, loc in _CHOICES:
        c = summary.chosen(det, loc)
        told.append(F.struct(F.lit(det).alias("det"), F.lit(loc).alias("loc"), _r(c["S_Det"], "s_det"), _r(c["S_Loc"], "s_loc"), _r(c["S_Fin"], "s_fin")))
    return one.select(F.inline(F.array(*told)))


@query()
def q_infer_stub(spark, sf_dir):
    rows = syn.ground_truth(spark, sf_dir).select("sample_id", "image_file", F.lit("/none.png").alias("image_path"), "label", "language_code", "width", "height", F.encode("image_file", "UTF-8").alias("content"))
    return inference.infer(rows, inference.Options("stub"), inference.stub_client).drop("elapsed_sec")


_STUB = inference.stub_client(inference.messages("data:image/png;base64," + "A" * 24))
_PLACED = {k: f"CAST(greatest(0, least({of}, round_even({v} * ({of} / greatest(14, round_even({of} / 14.0, 0) * 14)), 0))) AS INT)" for k, v, of in (("x1", 10, "width"), ("y1", 20, "height"), ("x2", 30, "width"), ("y2", 40, "height"))}
_FINE = "width IS NOT NULL"


@query(f"""SELECT CAST(i AS VARCHAR) AS sample_id, image_name, gt_word AS gold_label, language_code, 'stub' AS model, CASE WHEN {_FINE} THEN width END AS width, CASE WHEN {_FINE} THEN height END AS height,
    CASE WHEN {_FINE} THEN 't' END AS thinking, CASE WHEN {_FINE} THEN true END AS has_report_tag, CASE WHEN {_FINE} THEN 'FORGED' END AS conclusion, CASE WHEN {_FINE} THEN {_STUB[1]["total_tokens"]} END AS risk_score,
    CASE WHEN {_FINE} THEN {" || ', ' || ".join(f"CAST({v} AS VARCHAR)" for v in _PLACED.values())} END AS box, CASE WHEN {_FINE} THEN '{{"total_tokens": {_STUB[1]["total_tokens"]}}}' END AS usage,
    CASE WHEN NOT ({_FINE}) THEN 'ValueError(''no image: /none.png'')' END AS error FROM spec WHERE has_gt""")
def q_infer_records(spark, sf_dir):
    r = q_infer_stub(spark, sf_dir)
    box = F.array_join(F.get("parsed.anomalies", F.lit(0))["grounding"].cast("array<string>"), ", ")
    return r.select("sample_id", "image_name", "gold_label", "language_code", "model", "width", "height", "thinking", "has_report_tag", "parsed.conclusion", "parsed.risk_score", box.alias("box"), "usage", "error")
