"""Scores of a parsed report against its ground truth, as expressions."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import clamp_box
from .pytext import filled, let, spaced_words

# Weights, target lengths, anchors, scripts and languages.
WEIGHTS = {"S_Det": 0.30, "S_Loc": 0.20, "S_Exp": 0.15, "S_Rep": 0.35}
TARGET = {"FORGED": 3453, "AUTHENTIC": 1281}
PARTS = {"format": 0.15, "self_consistency": 0.10, "verdict_match": 0.20, "grounding": 0.15, "count_align": 0.10, "detail": 0.15, "length_align": 0.15}
ANCHOR = {"S_Det": 0.6300, "S_Loc": 0.0186, "S_Exp": 0.1381, "S_Rep_proxy": 0.5342, "leaderboard": 0.2409}
SCRIPTS = {
    "ar": r"[؀-ۿݐ-ݿﭐ-﷿ﹰ-﻿]",
    "th": r"[฀-๿]",
    "zh": r"[一-鿿㐀-䶿豈-﫿぀-ヿ가-힯]",
    "latin": r"[A-zÀ-ɏ]",
}
LANGUAGES = {"zh": ("zh", "ja", "ko"), "th": ("th",), "ar": ("ar",)}

#: Any character after the last of the Latin ones.
BEYOND_LATIN = r"[ɐ-\x{10ffff}]"

VALID = ("FORGED", "AUTHENTIC")


def _beyond_latin(text: Column) -> Column:
    return F.when(F.octet_length(text) == F.length(text), False).otherwise(text.rlike(BEYOND_LATIN))


def best_script(text: Column) -> Column:
    """struct(n, first, script): the script with most characters, the first to occur among equals; n is 0 without any.

    Whole runs of a script are taken out at once. Only texts with a character beyond Latin are searched for the other scripts.
    """

    def count(name: str, p: str, among: Column) -> Column:
        n, first = F.length(text) - F.length(F.regexp_replace(text, f"{p}+", "")), -F.regexp_instr(text, F.lit(p))
        if name != "latin":
            n, first = (F.when(among, c).otherwise(0) for c in (n, first))
        return F.struct(n.alias("n"), first.alias("first"), F.lit(name).alias("script"))

    return let(_beyond_latin(text), lambda among: F.array_max(F.array(*(count(name, p, among) for name, p in SCRIPTS.items()))))


def script_of(text: Column) -> Column:
    """The script of ``best_script``; other without any. Texts without a character beyond Latin need no counting."""
    counted = let(best_script(text), lambda best: F.when(best["n"] > 0, best["script"]).otherwise("other"))
    return F.when(_beyond_latin(text), counted).when(text.rlike(SCRIPTS["latin"]), "latin").otherwise("other")


def expected_script(language: Column) -> Column:
    out = F.lit("latin")
    for script, codes in LANGUAGES.items():
        out = F.when(language.isin(*codes), script).otherwise(out)
    return out


def pred_script(reasons: Column, summary: Column) -> Column:
    body = F.concat(F.array_join(reasons, " "), F.lit(" "), summary)
    return let(body, lambda t: F.when(filled(t), script_of(t)).otherwise("other"))


def language_factor(expected: Column, script: Column) -> Column:
    return (
        F.when(expected == "latin", F.when(script.isin("latin", "other"), 1.0).otherwise(0.85)).when(script == expected, 1.0).when(script == "other", 0.75).otherwise(0.6)
    )


def length_align(n: Column, target: Column) -> Column:
    r = n / target
    return F.when((n <= 0) | (target <= 0), 0.0).when((r >= 0.5) & (r <= 1.5), 1.0).when(r < 0.5, F.greatest(F.lit(0.0), (r - 0.2) / 0.3)).otherwise(F.greatest(F.lit(0.0), (3.0 - r) / 1.5))


def target_length(gt_label: Column) -> Column:
    return F.when(gt_label == "AUTHENTIC", TARGET["AUTHENTIC"]).otherwise(TARGET["FORGED"])


def self_consistency(p: Column) -> Column:
    half = lambda c: F.when(c, 0.5).otherwise(0.0)
    return (
        F.when(~p["conclusion"].isin(*VALID) | p["risk_score"].isNull(), 0.0).when(p["conclusion"] == "AUTHENTIC", half(p["risk_score"] <= 10) + half(F.size(p["boxes"]) == 0))
        .otherwise(half(p["risk_score"] >= 20) + half(F.size(p["boxes"]) > 0))
    )


def format_compliance(p: Column) -> Column:
    has = lambda issue: ~F.array_contains(p["issues"], issue)
    checks = ((p["conclusion"].isin(*VALID), 0.20), (p["risk_score"].isNotNull(), 0.15), (has("missing_header"), 0.15), (has("missing_detail_section"), 0.15), (p["summary"] != "", 0.20), (has("missing_end_marker"), 0.15))
    return F.when(p["report_len"] == 0, 0.0).otherwise(sum((F.when(c, w).otherwise(0.0) for c, w in checks), F.lit(0.0)))


def grounding_quality(p: Column, width: Column, height: Column) -> Column:
    n = F.size(p["boxes"])
    valid = F.size(F.filter(p["boxes"], lambda b: clamp_box(b, width, height).isNotNull()))
    return F.when(n == 0, 0.0).otherwise(0.5 * F.try_divide(valid, n) + 0.5 * F.least(F.lit(1.0), F.try_divide(F.size(p["reasons"]), n)))


def detail(p: Column, gt_label: Column) -> Column:
    upto = lambda x, most: F.least(F.lit(1.0), x / most)
    mean = F.try_divide(F.aggregate(p["reasons"], F.lit(0), lambda s, r: s + F.length(r)), F.size(p["reasons"]))
    shown = F.length(p["summary"])
    return (
        F.when(gt_label == "AUTHENTIC", upto(shown, 600.0)).when(F.size(p["reasons"]) == 0, 0.5 * upto(shown, 220.0)).otherwise(0.5 * upto(mean, 200.0) + 0.5 * upto(shown, 220.0))
    )


def count_align(gt_label: Column, n_gt: Column, p: Column) -> Column:
    n = F.size(p["boxes"])
    return (
        F.when((gt_label == "FORGED") & (n_gt > 0), F.greatest(F.lit(0.0), 1.0 - F.try_divide(F.abs(n - n_gt), n_gt))).when(gt_label == "AUTHENTIC", F.when(n == 0, 1.0).otherwise(0.0)).otherwise(0.5)
    )


def report_quality(gt_label: Column, n_gt: Column, p: Column, width: Column, height: Column, expected: Column, script: Column) -> Column:
    """struct(score, breakdown, status): an empty report scores 0 with a null breakdown and the status empty_report."""
    parts = {
        "format": format_compliance(p),
        "self_consistency": self_consistency(p),
        "verdict_match": F.when((p["conclusion"] == gt_label) & gt_label.isin(*VALID), 1.0).otherwise(0.0),
        "grounding": F.when(p["conclusion"] == "AUTHENTIC", F.when(F.size(p["boxes"]) == 0, 1.0).otherwise(0.0)).otherwise(grounding_quality(p, width, height)),
        "count_align": count_align(gt_label, n_gt, p),
        "detail": detail(p, gt_label),
        "length_align": length_align(p["report_len"], target_length(gt_label)),
        "language_factor": language_factor(expected, script),
    }
    some = p["report_len"] > 0
    score = sum((w * parts[k] for k, w in PARTS.items()), F.lit(0.0)) * parts["language_factor"]
    return F.struct(
        F.when(some, F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))).otherwise(0.0).alias("score"),
        F.struct(*(F.when(some, v).alias(k) for k, v in parts.items())).alias("breakdown"),
        F.when(~some, "empty_report").alias("status"),
    )


def token_f1(a: Column, b: Column) -> Column:
    """F1 of the word multisets. Spark tells what is a word; a kernel counts the words of two texts, a few at a time."""
    met = shared_words()(spaced_words(F.coalesce(a, F.lit(""))), spaced_words(F.coalesce(b, F.lit(""))))
    return F.when(met["n"] == 0, 1.0).otherwise(F.coalesce(F.try_divide(2.0 * met["common"], met["n"]), F.lit(0.0)))


@cache
def shared_words() -> Callable[[Column, Column], Column]:
    """struct(common, n) of two texts of words between blanks: size of the multiset intersection, and of both multisets."""

    def count(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = []
        for s, t in zip(x, y, strict=True):
            p, q = s.split(), t.split()
            c, d = Counter(p), Counter(q)
            rows.append((sum(min(c[w], d[w]) for w in c.keys() & d.keys()), len(p) + len(q)))
        return pd.DataFrame(rows, columns=["common", "n"])

    # annotations as types: Spark reads them; a nested function goes to the executors whole
    count.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(count, "common long, n long")


def calibration_factor() -> float:
    known = sum(WEIGHTS[k] * ANCHOR[k] for k in ("S_Det", "S_Loc", "S_Exp"))
    return max(0.0, min(1.0, max(0.0, ANCHOR["leaderboard"] - known) / WEIGHTS["S_Rep"] / ANCHOR["S_Rep_proxy"]))


def calibrated(rep: Column) -> Column:
    return rep * calibration_factor()
