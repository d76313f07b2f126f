"""Files to summary, masks, inference and the registry."""

import csv
import gzip
import io
import json
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from parchment import evaluate, infer
from parchment.operators import evaluate as ev
from parchment.operators import masks, summary
from parchment.sources import jsonl, sinks
from parchment.streaming import inference

FORGED = "# FORGERY ANALYSIS\n[Conclusion]: FORGED\n[RISK_SCORE]: 90\nDETAILED ANOMALY ANALYSIS\n[GROUNDING]: [1, 0, 3, 4]\n[REASON]: why\n## SUMMARY\nsum\n---\n**END OF REPORT**"
AUTHENTIC = "# FORGERY ANALYSIS\n[Conclusion]: AUTHENTIC\n[RISK_SCORE]: 5\nDETAILED ANOMALY ANALYSIS\n## SUMMARY\nfine\n---\n**END OF REPORT**"


def lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows)


def png(path, rows):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b""))


def test_sources(spark, tmp_path):
    text = lines([{"image_name": "a", "report": "1"}, {"image_name": "b", "width": 3}]) + "\n  \n"
    (tmp_path / "p.jsonl").write_text(text)
    with gzip.open(tmp_path / "q.jsonl.gz", "wt") as f:
        f.write(text)
    with zipfile.ZipFile(tmp_path / "r.zip", "w") as z:
        z.writestr("other.jsonl", "{}")
        z.writestr("prediction.jsonl.gz", gzip.compress(text.encode()))
    for name in ("p.jsonl", "q.jsonl.gz", "r.zip"):
        rows = jsonl.read_jsonl(spark, str(tmp_path / name), jsonl.PRED_SCHEMA).orderBy("ord").collect()
        assert [(r.image_name, r.report, r.width) for r in rows] == [("a", "1", None), ("b", None, "3")], name
    (tmp_path / "bad.jsonl").write_text('{"image_name": "a"}\n{oops\n')
    with pytest.raises(Exception, match="malformed JSON line in .*bad.jsonl"):
        jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), jsonl.PRED_SCHEMA).collect()
    assert jsonl.read_jsonl(spark, str(tmp_path / "bad.jsonl"), jsonl.PRED_SCHEMA, "DROPMALFORMED").count() == 1
    assert jsonl.malformed(spark, str(tmp_path / "bad.jsonl"), jsonl.PRED_SCHEMA).count() == 1


def test_run(spark, tmp_path):
    png(tmp_path / "m.png", [[9, 9, 0, 0]] * 4)
    gt = [
        {"image_file": "a.png", "label": "fake", "report_text": FORGED, "width": 4, "height": "4", "mask_path": str(tmp_path / "m.png"), "language_code": "en"},
        {"image_file": "a.png", "label": "fake", "report_text": FORGED, "width": 4, "height": "4", "mask_path": str(tmp_path / "m.png"), "language_code": "en", "sample_id": "last"},
        {"image_file": "b.png", "label": "real", "report_text": AUTHENTIC, "language_code": "zh"},
        {"image_file": "c.png", "label": "real"},
    ]
    pred = [{"image_name": "a.png", "report": "old"}, {"image_path": "/x/a.png", "raw_output": FORGED}, {"image_name": "b.png", "raw_output": ""}, {"image_name": "z.png", "raw_output": "-"}]
    (tmp_path / "gt.jsonl").write_text(lines(gt))
    (tmp_path / "pred.jsonl").write_text(lines(pred))
    out = evaluate.run(spark, str(tmp_path / "gt.jsonl"), str(tmp_path / "pred.jsonl"), raw=True, include_samples=True, calibrate=True, mask_location=str(tmp_path / "m.png"), output=str(tmp_path / "o/s.json"), output_csv=str(tmp_path / "csv"))
    assert (out["num_gt"], out["num_pred"], out["num_common"]) == (4, 3, 2)
    assert out["scores"]["S_Det_accuracy"] == 0.5
    assert out["scores"]["S_Loc_mF1_proxy"] == 0.5 and out["scores"]["mIoU_proxy"] == pytest.approx(1 / 3)
    assert out["loc_methods"] == {"mask_f1": 1, "skipped_authentic": 1}
    assert out["samples"][0]["sample_id"] == "last" and out["samples"][0]["exp_score"] == 1
    assert out["top_issues"] == {"empty_report": 1} and out["by_language"]["zh"]["s_rep"] == 0
    assert json.loads((tmp_path / "o/s.json").read_text())["num_common"] == 2
    with open(tmp_path / "csv", newline="") as f:
        written = list(csv.DictReader(f))
    assert [r["image_name"] for r in written] == ["a.png", "b.png"] and list(written[0]) == list(sinks.CSV_FIELDS)
    assert (written[0]["sample_id"], written[0]["mask_f1"], written[1]["issues"]) == ("last", "0.5", "empty_report")
    assert "S_Fin_proxy" in sinks.console(out)


def test_csv_is_one_ordered_file(spark, tmp_path):
    """The bytes of Python's writer, in the order of names, whatever the number of parts; an earlier file is replaced."""
    rng = np.random.default_rng(1)
    names = ["a", "B", "é", "日本", 'quo"te', "com,ma", "new\nline", "cr\rx", "crlf\r\n", " lead", "😀", "\uffff", ""] + [f"n{k:04d}" for k in range(300)]
    rng.shuffle(names)
    values = [0.0, -0.0, 1.0, 1e-3, 1e-4, 1.5e-5, 2e-3, 1e16, 1e23, 123456789.125, 1 / 3, None, 2.0**-44, 5e-324]
    parts = (*sinks.scoring.PARTS, "language_factor")
    rows = []
    for k, name in enumerate(names):
        v = lambda j, k=k: values[(k + j) % len(values)] if k % 2 else float(rng.random() * 10.0 ** int(rng.integers(-9, 3)))
        rows.append((name, None if k % 3 else str(k), "en", "latin", "zh", "FORGED", "AUTHENTIC", k % 2 == 0, v(0), "none", v(1), v(2), v(3), v(4), v(5), v(6), tuple(v(7 + j) for j in range(len(parts))), k, -k, k * 10**6, 0, ["x", 'y"', "z,"][: k % 4]))
    kinds = {"det_correct": "boolean", "rep_breakdown": "struct<" + ",".join(f"{p}:double" for p in parts) + ">", "issues": "array<string>", **dict.fromkeys(("pred_boxes", "gt_boxes", "pred_report_len", "gt_report_len"), "int")}
    texts = ("image_name", "sample_id", "language_code", "expected_script", "pred_script", "gt_label", "pred_label", "loc_method")
    columns = [c for c in sinks.CSV_FIELDS if not c.startswith("rep_") or c == "rep_score"]
    columns.insert(columns.index("rep_score") + 1, "rep_breakdown")
    schema = ", ".join(f"{c} {'string' if c in texts else kinds.get(c, 'double')}" for c in columns)
    expected = io.StringIO(newline="")
    writer = csv.writer(expected)
    writer.writerow(sinks.CSV_FIELDS)
    for r in sorted(rows, key=lambda r: r[0]):
        d = dict(zip(columns, r, strict=True))
        d |= {f"rep_{p}": x for p, x in zip(parts, d["rep_breakdown"], strict=True)} | {"issues": ";".join(d["issues"])}
        writer.writerow([d[c] for c in sinks.CSV_FIELDS])
    at = tmp_path / "o.csv"
    at.write_text("old")
    sinks.write_csv(spark.createDataFrame(rows, schema).repartition(7), str(at))
    assert at.read_bytes() == expected.getvalue().encode()
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["o.csv"]


def pixels(rows, width, height):
    out = np.zeros((height, width), bool)
    for r in rows:
        for x in r["runs"]:
            out[r["y"], x["x1"] : x["x2"]] = True
    return out


def nearest(x, width, height):
    """Pixel by pixel: the source pixel in which the centre of the target pixel lies."""
    return np.array([[x[(2 * j + 1) * x.shape[0] // (2 * height), (2 * i + 1) * x.shape[1] // (2 * width)] for i in range(width)] for j in range(height)])


def test_masks_by_runs_and_by_pixels(spark):
    """Sweeps over runs give what pixels give, for masks of other sizes, boxes that overlap or have no area, and masks without a pixel."""
    rng = np.random.default_rng(3)
    given, expected = [], {}
    for k in range(60):
        h, w, mh, mw = (int(v) for v in rng.integers(3, 20, 4))
        if k % 3 == 0:
            mh, mw = h, w
        mask = rng.random((mh, mw)) < (0 if k % 10 == 9 else 0.4)
        boxes = []
        for _ in range(int(rng.integers(0, 5))):
            x1, x2 = sorted(int(v) for v in rng.integers(0, w + 1, 2))
            y1, y2 = sorted(int(v) for v in rng.integers(0, h + 1, 2))
            boxes.append({"x1": x1, "y1": y1, "x2": x2, "y2": y2})
        drawn = np.zeros((h, w), bool)
        for b in boxes:
            drawn[b["y1"] : b["y2"], b["x1"] : b["x2"]] = True
        rows = masks.encode(mask)
        assert (pixels(rows, mw, mh) == mask).all()
        target = nearest(mask, w, h)
        given.append((k, rows, mw, mh, w, h, boxes))
        expected[k] = (int((target & drawn).sum()), int((~target & drawn).sum()), int((target & ~drawn).sum()))
    frame = spark.createDataFrame(given, f"k int, rows {masks.ROWS}, mw int, mh int, w int, h int, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    out = frame.select("k", masks.counts(masks.resized(F.col("rows"), F.col("mw"), F.col("mh"), F.col("w"), F.col("h")), F.col("boxes")).alias("c")).collect()
    assert {r.k: tuple(r.c) for r in out} == expected


def test_runs_may_overlap_and_rows_may_be_unknown(spark):
    rows = [{"y": 1, "runs": [{"x1": 0, "x2": 5}, {"x1": 3, "x2": 8}, {"x1": 9, "x2": 9}]}]
    frame = spark.createDataFrame([(rows, [{"x1": 4, "y1": 0, "x2": 6, "y2": 9}]), (None, []), ([], [{"x1": 0, "y1": 0, "x2": 2, "y2": 2}])], f"rows {masks.ROWS}, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>")
    assert [r[0] and tuple(r[0]) for r in frame.select(masks.counts(F.col("rows"), F.col("boxes"))).collect()] == [(2, 16, 6), None, (0, 4, 0)]


def test_masks_of_files(spark, tmp_path):
    """Image files to runs: greyscale values over 0 are set, what is no image is left out, and pixels never meet a shuffle."""
    png(tmp_path / "a.png", [[0, 7, 7, 0, 255], [0, 0, 0, 0, 0], [1, 0, 0, 0, 1]])
    png(tmp_path / "b.png", [[0, 0], [0, 0]])
    (tmp_path / "c.png").write_bytes(b"no image")
    got = {r.mask_path.rsplit("/", 1)[1]: r for r in masks.read_masks(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.png", "b.png"} and got["b.png"].rows == []
    assert (got["a.png"].mask_width, got["a.png"].mask_height) == (5, 3)
    assert [(r.y, [(x.x1, x.x2) for x in r.runs]) for r in got["a.png"].rows] == [(0, [(1, 3), (4, 5)]), (2, [(0, 1), (4, 5)])]
    gt = spark.createDataFrame([("a", f"file:{tmp_path}/a.png"), ("b", None), ("c", str(tmp_path / "c.png")), ("d", "")], "image_name string, mask_path string")
    named = masks.of_truth(gt, masks.read_masks(spark, str(tmp_path)))
    assert [(r.image_name, len(r.rows)) for r in named.collect()] == [("a", 2)]
    assert masks.grey(bytes([0, 0, 255]), 1, 1, 3).tolist() == [[76]]


def test_unmatched_and_order_change_nothing(spark):
    rows = [("a", FORGED, 1), ("b", AUTHENTIC, 2)]
    gt = ev.prepare_truth(spark.createDataFrame([(n, "fake", t, o) for n, t, o in rows], "image_file string, label string, report string, ord int"))
    scored = lambda p: summary.scores(ev.samples(gt, ev.last_wins(ev.prepare_predictions(spark.createDataFrame(p, "image_name string, report string, ord int")), "image_name"))).first()
    assert scored(rows) == scored([("zz", "x", 9), *reversed(rows)])


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "image_name string, report string, ord int")
    s = ev.samples(ev.prepare_truth(none), ev.prepare_predictions(none))
    assert s.count() == 0
    assert summary.scores(s).first()["S_Fin"] == 0


def test_inference(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a.png", "/d/a.png", "fake", "en", 1000, 500, b"x"), ("2", None, "/d/b.png", "real", "en", None, None, None)], "sample_id string, image_file string, image_path string, label string, language_code string, width int, height int, content binary")
    done = inference.infer(rows, inference.Options("stub", workers=2), inference.stub_client)
    a, b = done.orderBy("sample_id").collect()
    assert a.parsed.conclusion == "FORGED" and a.parsed.anomalies[0].grounding == [10, 20, 30, 40] and a.error is None
    assert b.error and b.parsed is None and b.image_name == "b.png"
    assert inference.counters(done).first().asDict() == {"written": 2, "errors": 1}
    assert inference.todo(rows, done).count() == 0
    assert [r.sample_id for r in inference.todo(rows, done, retry_errors=True).collect()] == ["2"]
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    for _ in range(2):
        inference.run_incremental(stream, str(tmp_path / "out"), str(tmp_path / "cp"), inference.Options("stub"), inference.stub_client)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert [m["role"] for m in inference.messages("data:", "cct")] == ["system", "user"] and len(inference.messages("data:", "simple")) == 1
    url = spark.createDataFrame([("x.PNG", b"ab")], "p string, c binary").select(jsonl.data_url(F.col("p"), F.col("c"))).first()[0]
    assert url == "data:image/png;base64,YWI="


def test_inference_job(spark, tmp_path):
    (tmp_path / "im").mkdir()
    for name in ("a.png", "b.JPG", "c"):
        (tmp_path / "im" / name).write_bytes(b"x")
    split, out = tmp_path / "split.jsonl", str(tmp_path / "out")
    rows = [{"sample_id": str(i), "image_path": str(tmp_path / "im" / n), "width": 10, "height": 20, "label": "fake"} for i, n in enumerate(("a.png", "b.JPG", "c", "missing.png"))]
    split.write_text("\n".join(map(json.dumps, rows)))
    told = lambda chat: (chat[-1]["content"][0]["image_url"]["url"], {})
    job = lambda **k: infer.run(spark, str(split), str(tmp_path / "im"), out, inference.Options("stub", workers=2), told, **k)
    assert job(max_samples=2) == {"written": 2, "errors": 0}
    assert job(resume=True) == {"written": 2, "errors": 1}
    assert job(resume=True) == {"written": 0, "errors": 0}
    assert job(resume=True, retry_errors=True) == {"written": 1, "errors": 1}
    got = {(r.sample_id, (r.api_raw_content or "").split(";")[0]) for r in spark.read.json(out).collect()}
    assert got == {("0", "data:image/png"), ("1", "data:image/jpeg"), ("2", "data:image/jpeg"), ("3", "")}
    assert job() == {"written": 4, "errors": 1} and spark.read.json(out).count() == 4


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_mask_counts_make_rows_and_boxes_once(spark):
    """No expression of the counts stands in the plan more than once: nested passes would make it again for each row."""
    frame = spark.createDataFrame([([], [], 1, 1, 1, 1)], f"rows {masks.ROWS}, boxes array<struct<x1:int,y1:int,x2:int,y2:int>>, mw int, mh int, w int, h int")
    out = frame.select(masks.counts(masks.resized(F.col("rows"), F.col("mw"), F.col("mh"), F.col("w"), F.col("h")), F.col("boxes")).alias("c"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("flatten(transform(filter(rows") == 1 and plan.count("filter(boxes") == 1 and "array_sort(" not in plan
