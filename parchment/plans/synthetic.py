"""Ground truth and predictions derived from the ``documents`` table, by one SQL text that Spark and DuckDB both run.

``SPEC`` has what every report should say, and the report texts made of it. Queries parse the texts; their oracles compute from
the other columns, so a fault of the parser cannot hide in both. Summaries hold a document's whole text, reasons the beginning of it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOXES = (1, 2, 3)
_NL = "chr(10)"


def _gt(j: int) -> dict[str, str]:
    x, y = f"((37 * i + {101 * j}) % 500)", f"((53 * i + {67 * j}) % 300)"
    return {"x1": x, "y1": y, "x2": f"({x} + 20 + (i + {j}) % 60)", "y2": f"({y} + 10 + (3 * i + {j}) % 40)"}


def _pred(j: int) -> dict[str, str]:
    far = "(i % 7) * 5 + CASE WHEN i % 17 = 0 THEN 100000 ELSE 0 END"
    return {k: f"({v} + {far})" for k, v in _gt(j).items()}


def _str(x: str) -> str:
    return f"CAST({x} AS {{str}})"


def _list(b: dict[str, str], keys: tuple[str, ...]) -> str:
    return "'[' || " + " || ', ' || ".join(_str(b[k]) for k in keys) + " || ']'"


def _report(verdict: str, risk: str, n: str, boxes: dict[int, str], reason: str, summary: str) -> str:
    found = " || ".join(f"CASE WHEN {n} >= {j} THEN '### ANOMALY_00{j}' || {_NL} || '[GROUNDING]: ' || {boxes[j]} || {_NL} || '[REASON]: ' || {reason} || {_NL} ELSE '' END" for j in BOXES)
    parts = ["'# FORGERY ANALYSIS REPORT'", verdict, risk, "'---'", "'## DETAILED ANOMALY ANALYSIS'"]
    end = ["'---'", "'## SUMMARY'", summary, "'---'", "'**END OF REPORT**'"]
    joined = f" || {_NL} || "
    return f"{joined.join(parts)} || {_NL} || {found} || {joined.join(end)}"


_ALL = ("x1", "y1", "x2", "y2")
_PRED_BOX = {j: f"CASE WHEN i % 11 = 0 THEN {_list(_pred(j), ('x1', 'y1', 'x2'))} WHEN i % 13 = 0 THEN {_list(_pred(j), ('x2', 'y2', 'x1', 'y1'))} ELSE {_list(_pred(j), _ALL)} END" for j in BOXES}

SPEC = f"""
WITH d AS (
    SELECT doc_id AS i, lang, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[^{{letters}} ]', ''{{g}}), '{{spaces}}', ' '{{g}})) AS body
    FROM {{documents}} WHERE doc_id IS NOT NULL
), b AS (
    SELECT i, 'img_' || lpad({_str('i')}, 8, '0') || '.png' AS image_name,
           CASE WHEN i % 41 = 0 THEN 'UNSURE' WHEN i % 2 = 0 THEN 'FORGED' ELSE 'AUTHENTIC' END AS gt_word,
           CASE (i {{div}} 2) % 10 WHEN 7 THEN 'th' WHEN 8 THEN 'ar' WHEN 9 THEN 'zh' ELSE lang END AS language_code,
           CASE WHEN i % 29 = 0 THEN NULL ELSE CAST(600 + (i % 5) * 100 AS INT) END AS width,
           CASE WHEN i % 29 = 0 THEN NULL ELSE CAST(400 + (i % 7) * 50 AS INT) END AS height,
           CAST(CASE WHEN i % 2 = 0 THEN (i {{div}} 2) % 4 ELSE 0 END AS INT) AS n_boxes,
           CASE WHEN (i % 2 = 0) <> (i % 5 = 0) THEN 'FORGED' ELSE 'AUTHENTIC' END AS verdict,
           i % 23 = 0 AS is_empty, i % 19 = 0 AS no_verdict,
           CAST(CASE WHEN i % 31 = 0 THEN NULL WHEN i % 37 = 0 THEN 250 WHEN (i % 2 = 0) <> (i % 5 = 0) THEN 80 + i % 21 ELSE i % 9 END AS INT) AS risk_word,
           CASE WHEN (i {{div}} 2) % 10 = 7 AND i % 3 <> 0 THEN 'th' WHEN (i {{div}} 2) % 10 = 8 AND i % 3 <> 0 THEN 'ar' WHEN (i {{div}} 2) % 10 = 9 AND i % 3 <> 0 THEN 'zh' ELSE 'latin' END AS script,
           CASE WHEN body = '' THEN 'plain words' ELSE trim(substr(body, 1, 250)) END AS gt_reason,
           CASE WHEN body = '' THEN 'plain words' ELSE body END AS gt_summary,
           CASE WHEN length(body) < 40 THEN 'other words' ELSE trim(substr(body, 11, 250)) END AS latin_reason,
           CASE WHEN length(body) < 40 THEN 'other words' ELSE trim(substr(body, 21)) END AS latin_summary,
           i % 53 <> 0 AS has_gt, i % 47 <> 0 AND i % 53 <> 1 AS has_pred, i % 43 = 0 AS is_doubled
    FROM d
), t AS (
    SELECT *, CASE script WHEN 'th' THEN 'ข้อความ ถูกแก้ไข' WHEN 'ar' THEN 'تم تعديل هذا النص' WHEN 'zh' THEN '这段文字 被修改过' ELSE latin_reason END AS pred_reason,
           CASE script WHEN 'th' THEN 'ตัวเลข ไม่ตรง' WHEN 'ar' THEN 'الأرقام غير متطابقة' WHEN 'zh' THEN '数字 不一致' ELSE latin_summary END AS pred_summary
    FROM b
)
SELECT *,
       {_report("'**[Conclusion]:** ' || gt_word", "'**[RISK_SCORE]:** 50'", "n_boxes", {j: _list(_gt(j), _ALL) for j in BOXES}, "gt_reason", "gt_summary")} AS gt_report,
       CASE WHEN is_empty THEN '' ELSE {_report("CASE WHEN no_verdict THEN '**Verdict pending**' ELSE '**[Conclusion]:** ' || verdict END", "CASE WHEN risk_word IS NULL THEN 'no score' ELSE '**[RISK_SCORE]:** ' || " + _str("risk_word") + " END", "n_boxes", _PRED_BOX, "pred_reason", "pred_summary")} END AS pred_report,
       {", ".join(f"{v} AS {side}{k}_{j}" for j in BOXES for side, f in (("g", _gt), ("p", _pred)) for k, v in f(j).items())}
FROM t
"""

# Java tries the ranges of a class one after another, and is much faster where its Latin characters are named one by one. Single blanks need no replacing.
_LETTERS = "".join(map(chr, (*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(ord("À"), ord("ÿ") + 1))))
SPARK = {"str": "STRING", "div": "DIV", "g": "", "documents": "{documents}", "letters": _LETTERS, "spaces": "  +"}
DUCKDB = {"str": "VARCHAR", "div": "//", "g": ", 'g'", "documents": "documents", "letters": "A-Za-zÀ-ÿ", "spaces": " +"}


def spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return spark.sql(SPEC.format(**SPARK), documents=docs)


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spec(spark, sf_dir).where("has_gt").selectExpr("image_name AS image_file", "CAST(i AS STRING) AS sample_id", "language_code", "gt_word AS label", "gt_report AS report_text", "width", "height", "i AS ord")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw predictions; some names come twice, and the earlier row is stale."""
    rows = spec(spark, sf_dir).where("has_pred")
    fresh = rows.selectExpr("CAST(NULL AS STRING) AS image_name", "'/data/' || image_name AS image_path", "pred_report AS raw_output", "2 * i + 1 AS ord")
    stale = rows.where("is_doubled").selectExpr("image_name", "CAST(NULL AS STRING) AS image_path", "'<report>stale</report>' AS raw_output", "2 * i AS ord")
    return fresh.unionByName(stale)


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model outputs: the predicted report wrapped in four ways, and some errors."""
    return spec(spark, sf_dir).where("has_pred").selectExpr(
        "i", "image_name", "width", "height", "n_boxes", "is_empty", "no_verdict", "verdict", "risk_word", "pred_report",
        "CASE i % 4 WHEN 0 THEN '<think>why ' || pred_summary || '</think>' || pred_report WHEN 1 THEN '<think>a</think><report> ' || pred_report || ' </report>' WHEN 2 THEN pred_report ELSE '<REPORT>' || pred_report || '</REPORT>' END AS raw",
        "CASE WHEN i % 59 = 0 THEN 'TimeoutError()' END AS error",
    )


#: Forged images of known size have a mask unless i % 6 = 4; every fourth is kept at twice the size of its image.
HAS_MASK = "gt_word = 'FORGED' AND n_boxes > 0 AND width IS NOT NULL AND i % 6 <> 4"
#: A slanted run in three of four rows of each box.
IN_MASK = "(y + i) % 4 <> 3"


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_name, mask_width, mask_height, rows) by arithmetic; runs of boxes that share rows may overlap."""
    sides = ("x1", "y1", "x2", "y2")
    boxes = F.slice(F.array(*(F.struct(*(F.col(f"g{c}_{j}").cast("int").alias(c) for c in sides)) for j in BOXES)), 1, F.col("n_boxes"))
    # an image has its mask once, however many documents have its name
    kept = spec(spark, sf_dir).where(HAS_MASK).select("i", "image_name", F.when(F.col("i") % 4 == 0, 2).otherwise(1).alias("k"), "width", "height", boxes.alias("boxes")).dropDuplicates(["image_name"])
    i, k, width, height = (F.col(c) for c in ("i", "k", "width", "height"))
    ys = F.sort_array(F.array_distinct(F.flatten(F.transform("boxes", lambda b: F.sequence(b["y1"], b["y2"] - 1)))))
    ys = F.filter(ys, lambda y: ((y + i) % 4 != 3) & (y < height))  # IN_MASK
    span = lambda b, y: F.struct((b["x1"] + y % 5).alias("x1"), F.least(b["x2"] - y % 3, width).alias("x2"))
    spans = lambda y: F.transform(F.filter("boxes", lambda b: (b["y1"] <= y) & (y < b["y2"])), lambda b: span(b, y))
    runs = lambda y: F.sort_array(F.transform(F.filter(spans(y), lambda r: r["x2"] > r["x1"]), lambda r: F.struct((r["x1"] * k).alias("x1"), (r["x2"] * k).alias("x2"))))
    lines = F.filter(F.transform(ys, lambda y: F.struct(y.alias("y"), runs(y).alias("runs"))), lambda r: F.size(r["runs"]) > 0)
    # at twice the size a row stands twice
    rows = F.flatten(F.transform(lines, lambda r: F.transform(F.sequence(r["y"] * k, r["y"] * k + k - 1), lambda y: F.struct(y.cast("int").alias("y"), r["runs"].alias("runs")))))
    return kept.select("image_name", (width * k).alias("mask_width"), (height * k).alias("mask_height"), rows.alias("rows")).where(F.size("rows") > 0)
