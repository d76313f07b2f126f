"""Entry point: inference over a split, from files to records."""

from __future__ import annotations

import argparse
import dataclasses
import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .sources import jsonl
from .streaming import inference

SPLIT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("sample_id", "image_file", "image_path", "label", "language_code", "width", "height")])


def _done(spark: SparkSession, out: str) -> DataFrame | None:
    """Keys of the records at ``out``, lines that do not parse left out; None where nothing was written yet."""
    try:
        return spark.read.schema("sample_id string, image_name string, error string").json(out)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def unfinished(spark: SparkSession, out: str) -> list[str]:
    """Runs under ``out`` whose plan was written and that did not come to their end."""
    store, at = _file(spark, f"{out}/_progress")
    names = [f.getPath().getName() for f in store.listStatus(at)] if store.exists(at) else []
    has = lambda name, file: store.exists(_file(spark, f"{out}/_progress/{name}/{file}")[1])
    return sorted(n for n in names if has(n, "plan/_SUCCESS") and not has(n, "_DONE"))


def plan(spark: SparkSession, rows: DataFrame, out: str, batch_rows: int) -> str:
    """Write what a run is to do, in files of about ``batch_rows`` rows, each of which will be a batch; the run's name."""
    this, n = uuid.uuid4().hex, rows.count()
    rows.repartition(max(1, -(-n // batch_rows))).write.parquet(f"{out}/_progress/{this}/plan")
    return this


def work(spark: SparkSession, out: str, this: str, images: str, options: inference.Options, client: inference.Client) -> None:
    """Do what is left of a planned run, a batch at a time.

    The checkpoint holds which file of the plan is which batch, and which batches are done. A batch is written to a folder of its own
    number, replacing what a failed attempt left, so that a run that is taken up again repeats the one batch it was in.
    """
    base = f"{out}/_progress/{this}"
    schema = spark.read.parquet(f"{base}/plan").schema

    def batch(rows: DataFrame, number: int) -> None:
        inference.infer(rows, options, client, images).write.mode("overwrite").json(f"{out}/run={this}/batch={number}")

    planned = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/plan")
    planned.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    store, at = _file(spark, f"{base}/_DONE")
    store.create(at, True).close()


def run(spark: SparkSession, split: str, images: str, out: str, options: inference.Options, client: inference.Client, max_samples: int = 0, resume: bool = False, retry_errors: bool = False, batch_rows: int = 1000) -> dict[str, int]:
    """Load, cap, leave out what is done (``resume``), infer, write JSON lines under ``out``, and tally what was written.

    Each run writes a folder of its own under ``out``, in batches of about ``batch_rows`` rows that are kept as soon as they are done.
    With ``resume`` a run that was broken off is first brought to its end; without it earlier records are replaced. The tally
    reads what was written, so that the client is called once for each row.
    """
    store, at = _file(spark, out)
    if not resume:
        store.delete(at, True)
    runs = unfinished(spark, out) if resume else []
    for this in runs:
        work(spark, out, this, images, options, client)
    rows = jsonl.head(jsonl.read_jsonl(spark, split, SPLIT_SCHEMA), max_samples).drop("ord")
    with jsonl.naming_lines(spark, {split: SPLIT_SCHEMA}):
        runs.append(plan(spark, inference.todo(rows, _done(spark, out) if resume else None, retry_errors), out, batch_rows))
    work(spark, out, runs[-1], images, options, client)
    tally = {"written": 0, "errors": 0}
    for this in runs:
        try:
            one = inference.counters(spark.read.schema("error string").json(f"{out}/run={this}")).first().asDict()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":  # no row, no folder
                raise
            continue
        tally = {k: v + one[k] for k, v in tally.items()}
    return tally


def main(argv: list[str] | None = None) -> None:
    """Options default to MODEL, PROMPT_MODE, NUM_WORKERS, MAX_TOKENS, API_KEY_FILE and ENDPOINT of the environment."""
    told = inference.Options.from_env()
    a = argparse.ArgumentParser(description="Run a vision model over a split")
    a.add_argument("--model", default=told.model)
    a.add_argument("--prompt-mode", default=told.prompt_mode, choices=("simple", "cct"))
    a.add_argument("--input-jsonl", required=True)
    a.add_argument("--images", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--endpoint", default=os.environ.get("ENDPOINT"))
    a.add_argument("--api-key-file", default=os.environ.get("API_KEY_FILE", ""))
    a.add_argument("--max-tokens", type=int, default=told.max_tokens)
    a.add_argument("--max-samples", type=int, default=0)
    a.add_argument("--num-workers", type=int, default=told.workers)
    a.add_argument("--timeout", type=int, default=told.timeout)
    a.add_argument("--batch-rows", type=int, default=1000, help="rows that are kept together; a broken run repeats so many calls at most")
    for flag in ("enable-thinking", "resume", "retry-errors"):
        a.add_argument(f"--{flag}", action="store_true")
    o = a.parse_args(argv)
    if not o.model or not o.endpoint:
        a.error("give --model and --endpoint, or set MODEL and ENDPOINT")
    options = dataclasses.replace(told, model=o.model, prompt_mode=o.prompt_mode, workers=o.num_workers, max_tokens=o.max_tokens, timeout=o.timeout, thinking=o.enable_thinking)
    client = inference.http_client(o.endpoint, inference.credential(o.api_key_file), options)
    spark = SparkSession.builder.appName("parchment-infer").getOrCreate()
    tally = run(spark, o.input_jsonl, o.images, o.output, options, client, o.max_samples, o.resume, o.retry_errors, o.batch_rows)
    print(f"{tally['written']} records written, {tally['errors']} errors")


if __name__ == "__main__":
    main()
