"""The report machine against searching each text for each mark alone."""

import random
import re

import pytest
from pyspark.sql import functions as F

from parchment.functions import report

I, S = re.IGNORECASE, re.DOTALL
ALONE = {
    "conclusion": re.compile(r"\[conclusion\][:*\s]*(forged|authentic|pristine)", I),
    "risk": re.compile(r"\[?risk[_\s]?score\]?\D{0,12}(\d{1,3})", I),
    "box": re.compile(r"\[grounding\]\s*:\s*\[([^\[\]]+)\]", I),
    "reason": re.compile(r"\[reason\]\s*:\s*(.*?)(?=\n\s*###\s*anomaly|\n\s*---|\n\s*##\s*summary|\Z)", I | S),
    "summary": re.compile(r"##\s*summary\s*\n(.*?)(?=\n\s*---|\n\s*\*\*end of report\*\*|\Z)", I | S),
}
SECTIONS = {"missing_header": r"#\s*forgery\s+analysis\b", "missing_detail_section": r"detailed\s+anomaly\s+analysis", "missing_end_marker": r"end\s+of\s+report"}
FRAGMENTS = [
    "[CONCLUSION]", ":** ", "[conclusion]:\n", "FORGED", "authentic", "Pristine", "[RISK_SCORE]", "risk score", "Risk_Score]: ", "7", "123", "4567", "٣٤", " twelve chars ", "[GROUNDING]", "[GROUNDING]: [", "1, 2, 3, 4", "5.5,-6",
    "]", "[", ", ", "[REASON]:", "[reason] : ", "[REASON]", "some text", "\n", "\n\n", " ", "\t", "---", "\n---", "\n  ---\n", "### ANOMALY_001", "\n### anomaly", "## SUMMARY", "\n## SUMMARY\n", "##summary\n", "### summary\n", "##\nSummary",
    "**END OF REPORT**", "\n**END OF REPORT**", "\n **end of report**", "end  of report", "# FORGERY ANALYSIS", "#forgery analysis report", "# FORGERY ANALYSISx", "DETAILED ANOMALY ANALYSIS", "detailed\nanomaly analysis", "<report>", "</report>", ":", " ",
]


def alone(text):
    wrapped = re.search(r"<report>(.*?)</report>", text or "", I | S)
    text = (wrapped.group(1) if wrapped else text or "").strip()
    if not text:
        return ("UNKNOWN", None, [], [], "", 0, ["empty_report"])
    issues, boxes = [], []
    c, r, s = (ALONE[k].search(text) for k in ("conclusion", "risk", "summary"))
    label = "UNKNOWN" if c is None else "FORGED" if c.group(1).lower() == "forged" else "AUTHENTIC"
    issues += [] if c else ["missing_or_invalid_conclusion"]
    issues += [] if r else ["missing_risk_score"]
    for m in ALONE["box"].finditer(text):
        n = [float(x) for x in re.findall(r"-?\d+(?:\.\d+)?", m.group(1))][:4]
        if len(n) < 4:
            issues.append("malformed_grounding")
        elif n[2] <= n[0] or n[3] <= n[1]:
            issues.append("invalid_box_order")
        else:
            boxes.append(n)
    issues += [] if s else ["missing_summary"]
    issues += [k for k, p in SECTIONS.items() if not re.search(p, text, I)]
    reasons = [" ".join(m.group(1).split()) for m in ALONE["reason"].finditer(text)]
    return (label, min(100, int(r.group(1))) if r else None, boxes, reasons, " ".join(s.group(1).split()) if s else "", len(text), issues)


def made():
    rng = random.Random(11)
    out = [None, "", " \n", "[REASON]:\n---\nmore\n---", "[REASON]: a\n\n\n---", "## SUMMARY\n\n---\nx\n---", "## SUMMARY\n\n**END OF REPORT**", "risk score risk score: 5", "[GROUNDING]: [1,\n---\n2, 3, 4]", "# FORGERY ANALYSISDETAILED ANOMALY ANALYSIS"]
    out += ["".join(rng.choice(FRAGMENTS) for _ in range(rng.randint(1, 30))) for _ in range(6000)]
    return out


def test_fold_is_searching(spark):
    texts = made()
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", report.parse_report(F.col("t")).alias("p"))
    for r in frame.collect():
        p = r.p
        got = (p.conclusion, p.risk_score, [[b.x1, b.y1, b.x2, b.y2] for b in p.boxes], list(p.reasons), p.summary, p.report_len, list(p.issues))
        assert got == alone(texts[r.i]), repr(texts[r.i])


def test_pieces_are_the_text(spark):
    texts = [t for t in made()[:500] if t]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", report.lex(F.col("t")).alias("x")).collect()
    assert all("".join(x.s for x in r.x) == r.t for r in rows)


@pytest.mark.parametrize("unit", ["word ", "\n", "[REASON]: a\n", "[GROUNDING]: [1, 2, 3, 4]\n", "## summary", "\n \n"])
def test_long_texts(spark, unit):
    """Long texts of one kind end, and give what they should."""
    n = 2_000 if "[" in unit or "#" in unit else 200_000
    p = spark.createDataFrame([("x" + unit * n,)], "t string").select(report.parse_report(F.col("t")).alias("p")).first().p
    assert p.report_len == len(("x" + unit * n).strip())
    assert len(p.boxes) == (n if "GROUND" in unit else 0)


def test_one_scan_a_text(spark):
    """The plan of a parse cuts each text once, and searches whole texts for nothing but the tags around a report."""
    frame = spark.createDataFrame([("a", "b")], "t string, u string").select(report.parse_report(F.col("t")).alias("p"), report.parse_report(F.col("u")).alias("q"))
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 2
    assert plan.count("</report>") == 2


def output_alone(raw, error):
    """A record without sizes, each tag and mark searched for alone."""
    if error:
        return (None, None, None, None, None, error)
    raw = raw or ""
    think, wrapped = (re.search(rf"<{t}>(.*?)</{t}>", raw, I | S) for t in ("think", "report"))
    report = (wrapped.group(1) if wrapped else raw[think.end() :] if think else raw).strip() or raw.strip()
    label, risk = ALONE["conclusion"].search(report), re.search(r"\[risk[_\s]?score\][:*\s]*([0-9]+)", report, I)
    label = "UNKNOWN" if label is None else "FORGED" if label.group(1).lower() == "forged" else "AUTHENTIC"
    risk = min(100, int(risk.group(1))) if risk else 80 if label == "FORGED" else 0
    boxes = [[round(float(x)) for x in re.findall(r"-?\d+(?:\.\d+)?", m.group(1))][:4] for m in ALONE["box"].finditer(report)]
    return (report, think.group(1).strip() if think else "", bool(think), bool(wrapped), (label, risk, [b if len(b) >= 4 else None for b in boxes]), None)


TAGS = ["<think>", "</think>", "<report>", "</report>", "<THINK>", "</Thınk>", "<REPORT>", "</Report>", "<", "</", ">", "</thin", "think>", "　", "é ", "[Risk score]: 007", "[risk_score]:** 250", "[grounding]: [9, 8, -1.5, 2.4, 7]"]


def test_record_is_searching(spark):
    rng = random.Random(12)
    texts = [None, "", "<think></think>", "<report> </report> ", "<think>a</think> \n", "</think><think>", "<report><think>a</report>b</think>c"]
    texts += ["".join(rng.choice(TAGS if rng.random() < 0.6 else FRAGMENTS) for _ in range(rng.randint(1, 16))) for _ in range(4000)]
    rows = [(i, t, "late" if i % 50 == 49 else "" if i % 2 else None) for i, t in enumerate(texts)]
    none = F.lit(None).cast("int")
    frame = spark.createDataFrame(rows, "i int, t string, e string").select("i", "e", report.record(F.col("t"), F.col("e"), none, none).alias("r"))
    for i, e, r in frame.collect():
        told = r.parsed and (r.parsed.conclusion, r.parsed.risk_score, [a.grounding for a in r.parsed.anomalies])
        assert (r.raw_output, r.thinking, r.has_think_tag, r.has_report_tag, told, r.error) == output_alone(texts[i], e), repr(texts[i])
        assert r.raw_output_full == (None if r.error else texts[i] or "")


def test_record_takes_each_step_once(spark):
    """The plan of a record has each search of a whole text once: pairs of tags, verdict and score, and groundings as tags, gaps and anomalies."""
    frame = spark.createDataFrame([("a", "b", 1, 2)], "t string, e string, w int, h int").select(report.record(F.col("t"), F.col("e"), F.col("w"), F.col("h")).alias("r")).select("r.error", "r.parsed.conclusion", "r.raw_output")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(p) for p in (report.WRAPPED, report.THINKING, report.CONCLUSION, report.RISK_BRACKETED, report.GROUNDING)] == [1, 2, 1, 1, 3]


@pytest.mark.parametrize("unit", ["<", "word <", "</", "<think"])
def test_long_outputs(spark, unit):
    """Long outputs of opening signs end, and give what stands between the tags."""
    n = 100_000
    p = spark.createDataFrame([("<think>" + unit * n + "</think><report>" + unit * n + "x</report>",)], "t string").select(report.split_output(F.col("t")).alias("p")).first().p
    assert (p.thinking, p.report) == (unit * n, unit * n + "x")
