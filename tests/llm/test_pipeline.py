"""All stages of corpus_pipeline one after another against a chain of brute-force ones, and on what every stage must bear."""

import importlib.util
import random
import sys
from pathlib import Path

import pytest

import corpus_pipeline
from parchment.llm import decontam
from parchment.llm import sentencepiece_fst as sp

# the brute-force twins of the operators' own tests
_SPEC = importlib.util.spec_from_file_location("operator_tests", Path(__file__).with_name("test_operators.py"))
ops = importlib.util.module_from_spec(_SPEC)
sys.modules["operator_tests"] = ops
_SPEC.loader.exec_module(ops)

ITEMS = {1: ops.prose(18, random.Random(1)), 2: ops.prose(16, random.Random(2)), 3: None, 4: "zq"}


def corpus():
    """(rows, ids of good documents): prose and shouting, with shared lines, near copies and passages of the benchmark at prose."""
    rng = random.Random(6)
    shared = [ops.prose(9, rng) for _ in range(5)]
    rows, good = [], set()
    for i in range(240):
        if i % 4 == 3:
            rows.append((i, " ".join(w.upper() + "!!" for w in ops.prose(40, rng).split())))
            continue
        good.add(i)
        lines = [ops.prose(rng.randint(8, 20), rng) for _ in range(5)]
        if i % 5 == 0:
            lines.insert(2, rng.choice(shared))
        if i % 16 == 1:
            lines[3] += " " + (ITEMS[1 + i % 32 // 16].replace(" ", "  ").upper() if i % 3 else ITEMS[2].replace("e", "", 1))
        rows.append((i, "\n".join(lines)))
        if i % 10 == 4:  # a near copy, whose words stand in other lines
            words = rows[-1][1].split()
            words[rng.randrange(len(words))] = "changed"
            rows.append((1000 + i, " ".join(words)))
            good.add(1000 + i)
    return rows, good


def chain(rows, good):
    kept = {i: t for i, t in rows if i in good}
    kept = {i: told[0] for i, told in ops.brute_lines(sorted(kept.items())).items()}
    groups = ops.brute_components(sorted(kept.items()), 5)
    kept = {i: t for i, t in kept.items() if groups[i][1] == i}
    items = [t for t in map(decontam.normalise, ITEMS.values()) if len(t) >= 30]
    return {i: t for i, t in kept.items() if not any(ops.edit_distance_within(x, decontam.normalise(t)) <= int(len(x) * 0.05) for x in items)}


def tables(spark, at, rows, labels):
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], ops.SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(list(ITEMS.items()), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")


def test_all_stages(spark, tmp_path):
    import sentencepiece

    rows, good = corpus()
    tables(spark, tmp_path, rows, [(i, int(i in good), 0) for i, _ in rows])
    expected = chain(rows, good)
    library = sentencepiece.SentencePieceProcessor(model_file=sp.DEFAULT_MODEL)
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == set(expected) and 100 < len(got) < len(good) - 25
    assert all(got[i] == library.encode(t) for i, t in expected.items())


@pytest.mark.parametrize("kind", ["empty", "odd"])
def test_stages_bear(spark, tmp_path, kind):
    """An empty table, and null ids and texts, repeated rows, a long text and other columns of names that operators use."""
    rows = [] if kind == "empty" else [(None, None), (1, ""), (1, ""), (2, "a b c"), (2, "a b c"), (3, None), (4, ops.prose(20_000)), (None, "words of a row without an id")]
    tables(spark, tmp_path, rows, [])
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "1 AS kept", "2 AS kept_text", "3 AS gone", "'x' AS score", "5 AS component_id", "6 AS _row", "7 AS y")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "sentencepiece":
            assert sorted(out.columns) == sorted(docs.columns), name
            docs = out.persist()
        else:
            assert out.count() == docs.count()
    assert docs.count() == 0 if kind == "empty" else docs.where("doc_id = 4 or doc_id is null").count() >= 1
