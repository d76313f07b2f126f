"""Semi-structured Markdown reports to structs, and the normalisation of raw model output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import geometry
from .pytext import WS, ascii_digits, collapse, filled, let, strip

# The marks of the report format. (?U) gives Unicode classes and case.
# The first sign of a mark stands before the flags: without case it is looked for at once, and between tags only at such signs.
WRAPPED, THINKING = (rf"<(?iU)(?:{tag}>)[^<]*+(?:<(?!/{tag}>)[^<]*+)*+</{tag}>" for tag in ("report", "think"))
CONCLUSION = rf"\[(?iU)conclusion\][:*{WS}]*(forged|authentic|pristine)"
RISK = rf"(?iU)risk[_{WS}]?score\]?[^0-9]{{0,12}}([0-9]{{1,3}})"
RISK_BRACKETED = rf"\[(?iU)risk[_{WS}]?score\][:*{WS}]*([0-9]+)"
GROUNDING = rf"\[(?iU)grounding\][{WS}]*:[{WS}]*\[([^\[\]]+)\]"
NUMBER = r"-?[0-9]+(?:\.[0-9]+)?"
REASON = rf"(?iU)\A\[reason\][{WS}]*:[{WS}]*"
SUMMARY = rf"(?iU)\A##[{WS}]*summary[{WS}]*\n"
_MARKS = (
    rf"\[(?:conclusion|grounding|reason)\]|risk[_{WS}]?score|\n[{WS}]*---|\n[{WS}]*###[{WS}]*anomaly|##[{WS}]*summary|#[{WS}]*forgery[{WS}]+analysis{{0}}"
    rf"|detailed[{WS}]+anomaly[{WS}]+analysis|end[{WS}]+of[{WS}]+report"
)
#: What a report is cut before: every place where a mark begins. White space before a summary's heading and stars before the end mark stay
#: with what precedes, and are looked for there. Then a mark at the start of a piece, and what may still be open at the end of one.
#: The first class has all characters that a mark can begin with, and of letters three are looked at next, so that marks are not tried one by one elsewhere.
MARKS = rf"(?iU)(?=[\[\nrde#])(?=[\[\n#]|[de][en][td]|[r]is)(?={_MARKS.replace('{0}', r'\b')})"
BEGINS = rf"(?iU)\A(?:{_MARKS.replace('{0}', '')})"
GROUNDING_OPEN = rf"(?iU)\A\[grounding\][{WS}]*(?::[{WS}]*(?:\[[^\[\]]*)?)?\z"
SUMMARY_OPEN = rf"(?iU)\A##[{WS}]*summary[{WS}]*\z"
NEW_LINE = rf"(?U)\n[{WS}]*\z"
STARRED = rf"(?U)\n[{WS}]*\*\*\z"
END_MARK = r"(?iU)\Aend of report\*\*"
SECTIONS = (("missing_header", "h"), ("missing_detail_section", "d"), ("missing_end_marker", "e"))

PARSED = "struct<conclusion:string,risk_score:int,anomalies:array<struct<grounding:array<int>>>>"


def _label(c: Column, forged: str, authentic: str) -> Column:
    up = F.upper(F.coalesce(c, F.lit("")))
    return F.when(up.rlike(forged), "FORGED").when(up.rlike(authentic), "AUTHENTIC").otherwise("UNKNOWN")


def norm_label(c: Column) -> Column:
    """Label of ground truth and evaluation; words of forgery win."""
    return _label(c, "FORGED|BLACK|TAMPER|FAKE", "AUTHENTIC|PRISTINE|WHITE|REAL")


def output_label(c: Column) -> Column:
    """Label of the output normaliser, which does not know the colours."""
    return _label(c, "FORGED|TAMPER|FAKE", "AUTHENTIC|PRISTINE|REAL")


def unwrap(c: Column) -> Column:
    """What is within the first pair of report tags, else all, without white space at the ends: one pass over the text."""
    text = F.coalesce(c, F.lit(""))
    return strip(F.when(F.contains(text, F.lit("</")), F.regexp_replace(text, rf"(?isU)\A.*?<report>(.*?)</report>.*\z", "$1")).otherwise(text))


def _numbers(body: Column) -> Column:
    return F.slice(F.transform(F.regexp_extract_all(ascii_digits(body), F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double")), 1, 4)


def _four(n: Column) -> Column:
    return F.struct(*(F.get(n, i).alias(k) for i, k in enumerate(("x1", "y1", "x2", "y2"))))


def lex(text: Column) -> Column:
    """Pieces of a report, array<struct<k, s>>: the text cut before every mark, each piece with the kind of the mark it begins with.

    The piece before the first mark, empty where a text begins with one, has the kind "". Pieces in order are the text.
    """
    cut = F.split(F.concat(F.lit("\0"), text), MARKS, -1)  # behind another character a mark at the start is cut before, too
    begun = F.transform(cut, lambda s, i: F.struct(F.when(i > 0, F.lower(F.regexp_extract(s, BEGINS, 0))).otherwise("").alias("m"), F.when(i > 0, s).otherwise(F.substring(s, 2, 1 << 30)).alias("s")))

    def kind(m: Column) -> Column:
        one, last = F.substring(m, 1, 1), F.right(m, F.lit(1))
        return F.when(one == "[", F.substring(m, 2, 1)).when(one == "\n", F.when(last == "-", "-").otherwise("a")).when(one == "#", F.when(last == "y", "s").otherwise("h")).when(one == "r", "k").otherwise(one)

    return F.transform(begun, lambda x: F.struct(kind(x["m"]).alias("k"), x["s"].alias("s")))


_STATE = {
    "n": "int", "verdict": "string", "risk": "string", "risk_open": "string", "bodies": "array<string>", "body_open": "string", "reasons": "array<string>", "reason_open": "string", "head_open": "string",
    "summary": "string", "summary_done": "boolean", "h": "boolean", "d": "boolean", "e": "boolean",
}


def _step(s: Column, x: Column) -> Column:
    """The state after one more piece. A mark whose value may go on in the next piece stays open, as the text since it."""
    kind, piece, none = x["k"], x["s"], F.lit(None).cast("string")
    matched = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    more = lambda name, k, ok=True: F.when(F.lit(ok) & (kind == k), piece).when(s[name].isNotNull(), F.concat(s[name], piece))

    verdict = F.coalesce(s["verdict"], F.when(kind == "c", matched(piece, rf"\A{CONCLUSION}")))

    score = F.when(s["risk"].isNull(), F.when(s["risk_open"].isNotNull(), F.concat(s["risk_open"], piece)).when(kind == "k", piece))
    risk = F.coalesce(s["risk"], F.when(score.isNotNull(), matched(ascii_digits(score), RISK)))
    risk_open = F.when(risk.isNull() & (F.length(piece) < 30), F.right(score, F.lit(60)))  # a score is within 26 characters of its mark

    box = more("body_open", "g")
    body = F.when(box.isNotNull(), matched(box, rf"\A{GROUNDING}"))
    body_open = F.when(body.isNull() & box.rlike(GROUNDING_OPEN), box)

    # nothing ends a reason or a summary that has no text yet: the white space before its end belongs to the mark
    within, some = s["reason_open"], filled
    ends = within.isNotNull() & (kind.isin("-", "a") | ((kind == "s") & within.rlike(NEW_LINE))) & some(within)
    ends = F.coalesce(ends, F.lit(False))
    reason_open = F.when(ends, none).when(within.isNotNull(), F.concat(within, piece)).when((kind == "r") & piece.rlike(REASON), F.regexp_replace(piece, REASON, ""))

    told, done = s["summary"], s["summary_done"]
    head = F.when(told.isNull(), more("head_open", "s"))
    marked = (kind == "e") & piece.rlike(END_MARK) & told.rlike(STARRED)
    over = told.isNotNull() & ~done & (((kind == "-") & some(told)) | marked)
    summary = (
        F.when(done, told).when(told.isNotNull() & marked, F.regexp_replace(told, STARRED, "")).when(told.isNotNull() & ~over, F.concat(told, piece)).when(told.isNotNull(), told)
        .otherwise(let(head, lambda t: let(F.regexp_replace(t, SUMMARY, ""), lambda r: F.when(r != t, r))))
    )
    head_open = F.when(told.isNull() & head.rlike(SUMMARY_OPEN), head)
    new = {
        "n": s["n"] + F.length(piece), "verdict": verdict, "risk": risk, "risk_open": risk_open, "bodies": F.when(body.isNotNull(), F.array_append(s["bodies"], body)).otherwise(s["bodies"]), "body_open": body_open,
        "reasons": F.when(ends, F.array_append(s["reasons"], within)).otherwise(s["reasons"]), "reason_open": reason_open, "head_open": head_open, "summary": summary,
        "summary_done": F.coalesce(done | over, F.lit(False)), **{k: s[k] | (kind == k) for k in "hde"},
    }
    return F.struct(*(new[k].cast(t).alias(k) for k, t in _STATE.items()))


def parse_report(c: Column) -> Column:
    """struct(conclusion, risk_score, boxes, reasons, summary, report_len, issues) of a report.

    One pass cuts the text at its marks, and a fold over the pieces, a machine whose state is what is open, gives all fields. They are
    what searching the text for each mark alone would give: marks may lie in each other's values.
    """
    empty = {k: F.lit(0) if t == "int" else F.lit(False) if t == "boolean" else F.array() if t[0] == "a" else F.lit(None) for k, t in _STATE.items()}
    start = F.struct(*(empty[k].cast(t).alias(k) for k, t in _STATE.items()))
    return F.aggregate(lex(unwrap(c)), start, _step, lambda s: let(F.transform(s["bodies"], _numbers), lambda found: _told(s, found)))


def _told(s: Column, found: Column) -> Column:
    wrong = lambda n: F.when(F.size(n) < 4, "malformed_grounding").when((F.get(n, 2) <= F.get(n, 0)) | (F.get(n, 3) <= F.get(n, 1)), "invalid_box_order")
    lacks = lambda c, name: F.when(c, name).otherwise(F.lit(None).cast("string"))
    issues = F.array_compact(
        F.concat(
            F.array(lacks(s["verdict"].isNull(), "missing_or_invalid_conclusion"), lacks(s["risk"].isNull(), "missing_risk_score")), F.transform(found, wrong),
            F.array(lacks(s["summary"].isNull(), "missing_summary"), *(lacks(~s[k], name) for name, k in SECTIONS)),
        )
    )
    none = s["n"] == 0
    reasons = F.when(s["reason_open"].isNotNull(), F.array_append(s["reasons"], s["reason_open"])).otherwise(s["reasons"])
    return F.struct(
        F.when(s["verdict"].isNotNull(), norm_label(s["verdict"])).otherwise("UNKNOWN").alias("conclusion"),
        F.least(F.when(s["risk"].isNotNull(), F.lit(100)), s["risk"].try_cast("int")).alias("risk_score"),
        F.transform(F.filter(found, lambda n: wrong(n).isNull()), _four).alias("boxes"),
        F.transform(reasons, collapse).alias("reasons"),
        F.coalesce(collapse(s["summary"]), F.lit("")).alias("summary"),
        s["n"].alias("report_len"),
        F.when(none, F.array(F.lit("empty_report"))).otherwise(issues).alias("issues"),
    )


def split_output(c: Column) -> Column:
    """struct(thinking, report, raw, has_think_tag, has_report_tag) of raw model output; each pair of tags is looked for once."""

    def within(pair: Column, tag: str) -> Column:
        return strip(F.substring(pair, F.lit(len(tag) + 3), F.length(pair) - (2 * len(tag) + 5)))

    def told(raw: Column, x: Column) -> Column:
        think, wrapped = x["think"] != "", x["wrapped"] != ""
        after = strip(F.regexp_extract(raw, rf"{THINKING}((?s).*)", 1))
        report = F.when(wrapped, within(x["wrapped"], "report")).when(think, after).otherwise("")
        return F.struct(
            F.when(think, within(x["think"], "think")).otherwise("").alias("thinking"),
            let(report, lambda r: F.when(r == "", strip(raw)).otherwise(r)).alias("report"),
            raw.alias("raw"), think.alias("has_think_tag"), wrapped.alias("has_report_tag"),
        )

    pair = lambda raw, p: F.when(F.contains(raw, F.lit("</")), F.regexp_extract(raw, p, 0)).otherwise("")
    return let(F.coalesce(c, F.lit("")), lambda raw: let(F.struct(pair(raw, THINKING).alias("think"), pair(raw, WRAPPED).alias("wrapped")), lambda x: told(raw, x)))


def parse_output(c: Column) -> Column:
    """struct(conclusion, risk_score, anomalies) of a report: the light parse of the output normaliser."""
    rounded = lambda n: F.when(F.size(n) >= 4, F.transform(n, lambda x: F.rint(x).cast("int")))

    def told(x: Column) -> Column:
        shown = F.regexp_replace(x["digits"], "^0+(?=[0-9])", "")
        risk = F.when(x["digits"] == "", F.when(x["label"] == "FORGED", 80).otherwise(0)).when(F.length(shown) > 3, 100).otherwise(F.least(F.lit(100), shown.try_cast("int")))
        anomalies = F.transform(F.transform(x["bodies"], _numbers), lambda n: F.struct(rounded(n).alias("grounding")))
        return F.struct(x["label"].alias("conclusion"), risk.cast("int").alias("risk_score"), anomalies.alias("anomalies"))

    def found(text: Column) -> Column:
        label = let(F.regexp_extract(text, CONCLUSION, 1), output_label)
        return F.struct(label.alias("label"), F.regexp_extract(text, RISK_BRACKETED, 1).alias("digits"), F.regexp_extract_all(text, F.lit(GROUNDING), F.lit(1)).alias("bodies"))

    return let(F.coalesce(c, F.lit("")), lambda text: let(found(text), told))


def rescale_report(c: Column, width: Column, height: Column) -> Column:
    """The report with every grounding in pixels of the original image; lists of fewer than four numbers stay."""
    tags = F.regexp_extract_all(c, F.lit(GROUNDING), F.lit(0))
    gaps = F.split(c, GROUNDING, -1)

    def placed(tag: Column, b: Column) -> Column:
        numbers = F.concat_ws(", ", *(b[k].cast("string") for k in ("x1", "y1", "x2", "y2")))
        return F.concat(F.regexp_extract(tag, r"(?s)^(.*)\[[^\[\]]*\]\z", 1), F.lit("["), numbers, F.lit("]"))

    def rewritten(tag: Column) -> Column:
        n = let(F.regexp_extract(tag, r"(?s)\[([^\[\]]*)\]\z", 1), _numbers)
        return let(n, lambda n: F.when(F.size(n) >= 4, let(geometry.to_original(_four(n), width, height), lambda b: placed(tag, b))).otherwise(tag))

    return F.array_join(F.zip_with(gaps, F.transform(tags, rewritten), lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")


def record(raw: Column, error: Column, width: Column, height: Column) -> Column:
    """struct of the normalised output: split, rescaled where both sizes are known, then parsed; all null beside ``error``. Every step is done once."""
    known = (F.coalesce(width, F.lit(0)) > 0) & (F.coalesce(height, F.lit(0)) > 0)
    fine = F.coalesce(error, F.lit("")) == ""

    def told(split: Column, report: Column) -> Column:
        parts = {"raw_output": report, "raw_output_full": split["raw"], "thinking": split["thinking"], "has_think_tag": split["has_think_tag"], "has_report_tag": split["has_report_tag"], "parsed": parse_output(report).cast(PARSED)}
        return F.struct(*(v.alias(k) for k, v in parts.items()))

    def rescaled(split: Column) -> Column:
        return let(F.when(known, rescale_report(split["report"], width, height)).otherwise(split["report"]), lambda report: told(split, report))

    names = ("raw_output", "raw_output_full", "thinking", "has_think_tag", "has_report_tag", "parsed")
    return let(F.when(fine, let(split_output(raw), rescaled)), lambda t: F.struct(*(t[k].alias(k) for k in names), F.when(~fine, error).alias("error")))
