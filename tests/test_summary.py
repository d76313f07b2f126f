"""The one-pass summary against each figure by itself."""

import json

import pytest

from parchment import evaluate
from parchment.operators import evaluate as ev
from parchment.operators import summary
from parchment.plans import synthetic as syn
from parchment.sources import sinks

SF = "/root/testdata/sf0.001"


def inputs(spark):
    return ev.prepare_truth(syn.ground_truth(spark, SF)), ev.prepare_predictions(syn.predictions(spark, SF), raw=True)


def nearly(a, b):
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(nearly(a[k], b[k]) for k in a)
    return a == pytest.approx(b, abs=1e-12) if isinstance(a, float) else a == b


def test_one_pass_is_each_by_itself(spark):
    gt, pred = (d.persist() for d in inputs(spark))
    watched = ev.Watched(gt, pred)
    seen = ev.samples(watched.gt, watched.pred, syn.masks(spark, SF), watch=watched.common)
    told = sinks.figures(seen)
    plain = ev.samples(ev.last_wins(gt, "image_name"), ev.last_wins(pred, "image_name"), syn.masks(spark, SF)).persist()
    info = watched.info()
    assert nearly(info, summary.diagnostics(gt, pred).first().asDict())
    doc = sinks.summary_document(told, info, "macro_f1", "iou", calibrate=True)
    s = summary.scores(plain, "macro_f1", "iou", calibrate=True).first().asDict()
    assert nearly({k: doc["scores"][k] for k in ("S_Det", "S_Loc", "S_Exp", "S_Rep_proxy", "S_Fin_proxy", "S_Fin_calibrated", "S_Rep_calibrated")}, {"S_Det": s["S_Det"], "S_Loc": s["S_Loc"], "S_Exp": s["s_exp"], "S_Rep_proxy": s["s_rep"], "S_Fin_proxy": s["S_Fin"], "S_Fin_calibrated": s["S_Fin_calibrated"], "S_Rep_calibrated": s["S_Rep_calibrated"]})
    assert doc["confusion"] == {f"{r.gt_label}->{r.pred_label}": r.n for r in summary.confusion(plain).collect()}
    assert doc["loc_methods"] == {r.loc_method: r.n for r in summary.loc_methods(plain).collect()} and "mask_f1" in doc["loc_methods"]
    assert list(doc["top_issues"].items()) == [(r.issue, r.n) for r in summary.top_issues(plain).collect()]
    assert nearly(doc["rep_breakdown_avg"], summary.breakdown(plain).first().asDict())
    assert nearly(doc["by_language"], {r.language_code: {k: v for k, v in r.asDict().items() if k != "language_code"} for r in summary.by_language(plain).collect()})
    assert doc["binary_confusion"] == {k.upper(): v for k, v in plain.agg(*(c.alias(k) for k, c in summary.binary("FORGED").items())).first().asDict().items()}
    assert {r.issue for r in summary.top_issues(plain, 99).collect()} <= set(summary.ISSUES)


def test_each_input_is_read_once(spark, tmp_path):
    """The plan that gives all figures, counts of the inputs among them, holds one scan of each input and parses each report once."""
    for name in ("gt", "pred"):
        (tmp_path / name).write_text("{}\n")
    from parchment.sources import jsonl

    gt = ev.prepare_truth(jsonl.read_jsonl(spark, str(tmp_path / "gt"), jsonl.GT_SCHEMA))
    pred = ev.prepare_predictions(jsonl.read_jsonl(spark, str(tmp_path / "pred"), jsonl.PRED_SCHEMA))
    watched = ev.Watched(gt, pred)
    plan = summary.everything(ev.samples(watched.gt, watched.pred, watch=watched.common))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 2 and plan.count("CollectMetrics") == 4
    assert plan.count("split(") == 2


def test_ground_truth_without_reports(spark, tmp_path, capsys):
    rows = [{"image_file": f"{k}.png", "label": "fake" if k % 2 else "real"} for k in range(4)]
    (tmp_path / "gt").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "pred").write_text("\n".join(json.dumps({"image_name": f"{k}.png", "report": "[Conclusion]: FORGED"}) for k in (0, 1, 1, 7)))
    doc = evaluate.run(spark, str(tmp_path / "gt"), str(tmp_path / "pred"))
    assert doc["scores"]["S_Exp"] == 0 and doc["selected_proxy_metrics"]["S_Exp_method"] == "no_gt_reports" and doc["scores"]["S_Fin_calibrated"] is None
    assert (doc["num_gt"], doc["num_pred"], doc["num_common"]) == (4, 3, 2)
    said = capsys.readouterr().err
    assert "1 duplicate" in said and "50.0%" in said and "no reports" in said
    (tmp_path / "other").write_text(json.dumps({"image_name": "zz", "report": "x"}))
    with pytest.raises(SystemExit):
        evaluate.run(spark, str(tmp_path / "gt"), str(tmp_path / "other"))
    with pytest.raises(ValueError, match="no such metric"):
        evaluate.run(spark, str(tmp_path / "gt"), str(tmp_path / "pred"), det_metric="recall")
