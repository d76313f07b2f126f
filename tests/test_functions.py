"""Hand-derived unit rows of the evaluation engine."""

import collections
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from parchment.functions import geometry as g
from parchment.functions import pytext
from parchment.functions import report as r
from parchment.functions import scoring as s
from parchment.functions.pytext import spaced_words
from parchment.plans import registry
from parchment.plans import synthetic as syn


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def box(*v):
    return F.struct(*(F.lit(float(x)).alias(k) for x, k in zip(v, ("x1", "y1", "x2", "y2"), strict=True)))


@pytest.mark.parametrize(("text", "a", "b"), [("tampered", "FORGED", "FORGED"), ("really fake", "FORGED", "FORGED"), ("black", "FORGED", "UNKNOWN"), ("white", "AUTHENTIC", "UNKNOWN"), ("Pristine", "AUTHENTIC", "AUTHENTIC"), ("", "UNKNOWN", "UNKNOWN"), (None, "UNKNOWN", "UNKNOWN"), ("n/a", "UNKNOWN", "UNKNOWN")])
def test_labels(spark, text, a, b):
    c = F.lit(text).cast("string")
    assert (one(spark, r.norm_label(c)), one(spark, r.output_label(c))) == (a, b)


@pytest.mark.parametrize(
    ("text", "field", "value"),
    [
        ("**[Conclusion]:** pristine", "conclusion", "AUTHENTIC"),
        ("[Conclusion] - FORGED", "conclusion", "UNKNOWN"),
        ("**[RISK_SCORE]:** 85", "risk_score", 85),
        ("[RISK_SCORE]: 1000", "risk_score", 100),
        ("RISK SCORE 250", "risk_score", 100),
        ("[RISK_SCORE]: ٨٥", "risk_score", 85),
        ("a fraud risk score of 40.", "risk_score", 40),
        ("[REASON]: a  b\nc\n### ANOMALY_002", "reasons", ["a b c"]),
        ("## SUMMARY\n\n---\n**END OF REPORT**", "summary", "---"),
        ("[GROUNDING]:[[1,2,3,4]]", "boxes", []),
        (" \n ", "issues", ["empty_report"]),
        ("<report> ## SUMMARY\nx y </report> z", "summary", "x y"),
    ],
)
def test_parse(spark, text, field, value):
    assert one(spark, r.parse_report(F.lit(text)))[field] == value


@pytest.mark.parametrize(
    ("text", "box_", "issue"),
    [("[GROUNDING]:[1,2,3,4,5,6]", (1, 2, 3, 4), None), ("[GROUNDING]:[1,2,3]", None, "malformed_grounding"), ("[GROUNDING]:[30,40,10,20]", None, "invalid_box_order"), ("[GROUNDING]:[x1=10, y1=20, x2=30, y2=40]", None, "invalid_box_order")],
)
def test_groundings(spark, text, box_, issue):
    p = one(spark, r.parse_report(F.lit(text)))
    assert [tuple(b) for b in p.boxes] == ([box_] if box_ else [])
    assert not issue or issue in p.issues


@pytest.mark.parametrize(
    ("text", "want"),
    [("<think>t</think> rest", ("t", "rest", True, False)), ("<think>t</think>", ("t", "<think>t</think>", True, False)), ("<report> r </report>", ("", "r", False, True)), (None, ("", "", False, False))],
)
def test_split(spark, text, want):
    p = one(spark, r.split_output(F.lit(text).cast("string")))
    assert (p.thinking, p.report, p.has_think_tag, p.has_report_tag) == want


@pytest.mark.parametrize(("w", "h", "want"), [(1000, 500, (994, 504)), (7, 7, (14, 14)), (21, 35, (28, 28))])
def test_model_size(spark, w, h, want):
    assert tuple(one(spark, g.model_size(F.lit(w), F.lit(h)))) == want


def test_rescale(spark):
    assert tuple(one(spark, g.to_original(box(100, 100, 200, 200), F.lit(1000), F.lit(500)))) == (101, 99, 201, 198)
    text = "a [GROUNDING]: [100,100,200,200,7] b [grounding]:[1,2] c"
    assert one(spark, r.rescale_report(F.lit(text), F.lit(1000), F.lit(500))) == "a [GROUNDING]: [101, 99, 201, 198] b [grounding]:[1,2] c"
    assert one(spark, r.rescale_report(F.lit("none"), F.lit(10), F.lit(10))) == "none"


def test_light_parse(spark):
    p = one(spark, r.parse_output(F.lit("[Conclusion]: forged [GROUNDING]:[9,8,1.5,2.5] [GROUNDING]:[1]")))
    assert (p.conclusion, p.risk_score, [a.grounding for a in p.anomalies]) == ("FORGED", 80, [[9, 8, 2, 2], None])
    assert one(spark, r.parse_output(F.lit("[RISK_SCORE]: 99999999999")))["risk_score"] == 100


def test_iou(spark):
    assert one(spark, g.box_iou(box(0, 0, 10, 10), box(5, 5, 15, 15))) == pytest.approx(25 / 175)
    assert one(spark, g.box_iou(box(0, 0, 1, 1), box(1, 0, 2, 1))) == 0
    none = F.array().cast("array<struct<x1:double,y1:double,x2:double,y2:double>>")
    assert one(spark, g.mean_best_iou(F.array(box(0, 0, 10, 10), box(100, 100, 110, 110)), F.array(box(0, 0, 10, 10)))) == 0.5
    assert one(spark, g.mean_best_iou(none, F.array(box(0, 0, 1, 1)))) is None
    assert one(spark, g.mean_best_iou(F.array(box(0, 0, 1, 1)), none)) == 0


@pytest.mark.parametrize(("b", "w", "want"), [((2.5, 0, 3.5, 1), 10, (2, 0, 4, 1)), ((0.4, 0, 0.49, 5), 10, (0, 0, 0, 5)), ((-5, -5, 0, 3), 10, None), ((-5, -5, 0, 3), None, (-5, -5, 0, 3))])
def test_clamp(spark, b, w, want):
    got = one(spark, g.clamp_box(box(*b), F.lit(w).cast("int"), F.lit(w).cast("int")))
    assert (got and tuple(got)) == want


def test_union_counts_overlaps_once(spark):
    assert one(spark, g.union_area(F.array(box(0, 0, 2, 2), box(1, 1, 3, 3), box(0, 0, 2, 2)))) == 7


@pytest.mark.parametrize(("n", "want"), [(0, 0), (200, 0), (350, 0.5), (500, 1), (1500, 1), (2250, 0.5), (3000, 0)])
def test_length_align(spark, n, want):
    assert one(spark, s.length_align(F.lit(n), F.lit(1000))) == pytest.approx(want)


@pytest.mark.parametrize(("text", "want"), [("ab中文", "latin"), ("中文ab", "zh"), ("123", "other"), ("[]", "latin"), ("", "other"), ("a نص نص", "ar")])
def test_script(spark, text, want):
    assert one(spark, s.script_of(F.lit(text))) == want


@pytest.mark.parametrize(("code", "script", "want"), [("zh", "zh", 1), ("zh", "latin", 0.6), ("zh", "other", 0.75), ("en", "th", 0.85), ("xx", "latin", 1)])
def test_language_factor(spark, code, script, want):
    assert one(spark, s.language_factor(s.expected_script(F.lit(code)), F.lit(script))) == want


@pytest.mark.parametrize(("a", "b", "want"), [("a b b c", "b b b d", 0.5), ("", "", 1), ("a", "", 0), ("x", "y", 0), ("A_1 é", "a_1 É", 1), (None, None, 1)])
def test_token_f1(spark, a, b, want):
    assert one(spark, s.token_f1(F.lit(a).cast("string"), F.lit(b).cast("string"))) == pytest.approx(want)


def test_token_f1_counts_multisets(spark):
    rng = random.Random(4)
    pairs = [tuple(" ".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) for _ in range(2)) for _ in range(60)]
    for r in spark.createDataFrame(pairs, "a string, b string").select("a", "b", s.token_f1(F.col("a"), F.col("b")).alias("f")).collect():
        x, y = (collections.Counter(t.split()) for t in (r.a, r.b))
        n = x.total() + y.total()
        assert r.f == pytest.approx(2 * (x & y).total() / n if n else 1)


def test_token_f1_of_long_texts_takes_linear_time(spark):
    texts = spark.range(200).select(F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(8000)), lambda i: F.concat(F.lit("w"), i % 500))).alias("t"))
    began = time.time()
    assert texts.agg(F.min(s.token_f1(F.col("t"), F.col("t")))).first()[0] == 1
    assert time.time() - began < 60


def test_script_searches_a_text_once_for_each_script(spark, tmp_path):
    """Runs of characters count as their characters, and no count is made twice: each script has one regular expression that takes out and one that finds."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab [_^éɏɐ中文かㄱ가ขأ1 €😀") for _ in range(rng.randint(0, 12))) for _ in range(400)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = registry.QUERIES["q_script_of_documents"](spark, str(tmp_path))
    for row in out.collect():
        found = {name: [at for at, c in enumerate(texts[row.doc_id]) if re.match(p, c)] for name, p in s.SCRIPTS.items()}
        best = max(found, key=lambda k: (len(found[k]), -min(found[k], default=99)))
        assert (row.script, row.n) == (best if found[best] else "other", len(found[best])), texts[row.doc_id]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= len(s.SCRIPTS) and plan.count("regexp_instr(") <= len(s.SCRIPTS)


def test_words_are_counted_in_a_kernel(spark):
    """What lies between blanks are the words, and no expression goes through them one by one."""
    rng = random.Random(9)
    texts = [("".join(rng.choice("aB1_é中٣Ⅷ²İſ ̈\u200b\x1c\u2028.-😀\n\t ") for _ in range(rng.randint(0, 20))),) for _ in range(400)]
    frame = spark.createDataFrame(texts, "t string")
    words = F.regexp_extract_all(F.lower("t"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    for row in frame.select(words.alias("words"), spaced_words(F.col("t")).alias("spaced")).collect():
        assert row.spaced.split() == row.words
    plan = frame.select(s.token_f1(F.col("t"), F.lit("a b")))._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "aggregate(" not in plan and "array_sort(" not in plan


def test_marks_are_tried_only_where_one_can_begin():
    first = re.match(r"\(\?iU\)\(\?=(\[.*?[^\\]\])\)\(\?=", r.MARKS)
    assert first, r.MARKS
    for mark in ("[conclusion]", "Risk_score", "\n---", "\n### anomaly", "##summary", "# forgery analysis", "Detailed anomaly analysis", "End of report"):
        assert re.match(first[1], mark[0].lower()), mark


def test_letters_of_the_derived_view(spark):
    """Spark's spelling of the view's two patterns keeps what DuckDB's keeps, with no range for Java to try."""
    frame = spark.createDataFrame([("".join(map(chr, range(1, 0x250))),), (" a  b c   dé×÷ ",), ("x \n y",)], "t string")
    told = lambda d: F.regexp_replace(F.regexp_replace("t", f"[^{d['letters']} ]", ""), d["spaces"], " ")
    assert all(a == b for a, b in frame.select(told(syn.SPARK), told(syn.DUCKDB)).collect())
    assert "-" not in syn.SPARK["letters"] and "[^A-Za-zÀ-ÿ ]" in syn.SPEC.format(**syn.DUCKDB)


def test_calibration():
    assert 0.5342 * s.calibration_factor() == pytest.approx(0.078471, abs=1e-6)


def test_white_space_and_words_as_in_plain_python(spark):
    rng = random.Random(11)
    signs = ["a", "Z", "é", "ÿ", "ª", "²", "_", "-", "×", "字", "ไ", "٣", "~", "!", "\x7f", "𝒳", "  ", " ", *pytext.BLANKS]
    texts = ["", *("".join(rng.choice(signs) for _ in range(rng.randint(1, 14))) for _ in range(3000)), *("ab cd" + b + "e" for b in pytext.BLANKS), *(b + "x" + b for b in pytext.BLANKS)]
    t = F.col("t")
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", pytext.strip(t).alias("s"), pytext.collapse(t).alias("c"), pytext.filled(t).alias("f"), pytext.spaced_words(t).alias("w")).collect()
    blank = re.compile(f"[{re.escape(pytext.BLANKS)}]+")
    for r in got:
        assert r.s == r.t.strip(pytext.BLANKS)
        assert r.c == blank.sub(" ", r.t).strip(" ")
        assert r.f == (r.s != "")
        assert r.w.split(" ") == re.sub("\0+", " ", "".join(c if c in " _" or unicodedata.category(c)[0] in "LN" else "\0" for c in r.t.lower())).split(" ")


def test_even_text_is_not_rewritten(spark):
    texts = spark.range(40).coalesce(1).select(F.repeat(F.concat(F.lit(" uninterrupted"), F.col("id").cast("string")), 50_000).alias("t"))
    kept = texts.localCheckpoint()

    def took(c):
        began = time.perf_counter()
        kept.agg(F.max(F.octet_length(c))).collect()
        return time.perf_counter() - began

    plain, quick = (min(took(c) for _ in range(3)) for c in (F.btrim(F.regexp_replace("t", rf"(?U)[{pytext.WS}]+", " "), F.lit(pytext.BLANKS)), pytext.collapse(F.col("t"))))
    assert quick < 0.7 * plain
    # a script is counted only where there is more than one to choose from
    assert kept.limit(1).select(s.script_of(F.col("t"))).first()[0] == "latin"


def test_script_of_is_that_of_best_script(spark):
    texts = ["", "12 3", "abc", "é", "ɏ", "ɐ", "字", "a字", "字a", "ab字", "ไทa", "12ء", "Σ", "a Σ", "[", "`1"]
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", s.script_of(F.col("t")).alias("s"), s.best_script(F.col("t")).alias("b")).collect()
    assert all(r.s == (r.b.script if r.b.n > 0 else "other") for r in rows)
