"""Batch and incremental inference with a pluggable client; any failure of a row becomes its error record."""

from __future__ import annotations

import base64
import json
import os
import time
import urllib.request
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..cluster import ship
from ..functions import report
from ..functions.pytext import basename, nonempty
from ..sources import files
from ..sources import images as image_files
from ..sources.jsonl import data_kind

# Own wording of the prompts; the marks in them are those that reports are parsed by.
SIMPLE_PROMPT = "Decide whether the document in the image was tampered with. Answer with a report: [Conclusion]: FORGED or AUTHENTIC, [RISK_SCORE]: 0-100, [GROUNDING]: [x1, y1, x2, y2] and [REASON]: for every anomaly, then ## SUMMARY."
SYSTEM_PROMPT = "You are a document examiner. Look at layout, fonts, figures, edges, noise and meaning in turn, think within <think></think>, then write one Markdown report within <report></report>."
USER_PROMPT = (
    "Write the report in the document's language, in this order: # FORGERY ANALYSIS REPORT; **[Conclusion]:** FORGED or AUTHENTIC; **[RISK_SCORE]:** a number; ---; ## DETAILED ANOMALY ANALYSIS; for each anomaly "
    "### ANOMALY_001, [GROUNDING]: [x1, y1, x2, y2], [REASON]: why; ---; ## SUMMARY and its text; ---; **END OF REPORT**."
)

Client = Callable[[list[dict]], tuple[str, dict]]
DEFAULTS = {"MODEL": "", "PROMPT_MODE": "cct", "NUM_WORKERS": "4", "MAX_TOKENS": "8192", "API_KEY_FILE": ""}


@dataclass(frozen=True)
class Options:
    """Configuration of a run; ``timeout`` is honoured. from_env reads MODEL, PROMPT_MODE, NUM_WORKERS, MAX_TOKENS."""

    model: str
    prompt_mode: str = "cct"
    workers: int = 4
    max_tokens: int = 8192
    timeout: int = 180
    thinking: bool = False

    @classmethod
    def from_env(cls) -> Options:
        get = lambda k: os.environ.get(k, DEFAULTS[k])
        return cls(get("MODEL"), get("PROMPT_MODE"), int(get("NUM_WORKERS")), int(get("MAX_TOKENS")))


def credential(key_file: str = "", fallback_file: str = "", variable: str = "API_KEY") -> str:
    """The key from the named file, else the fallback file, else the environment. Driver side only."""
    for name in (key_file, fallback_file):
        if name and Path(name).is_file():
            return Path(name).read_text().strip()
    if key := os.environ.get(variable, "").strip():
        return key
    raise SystemExit("no credential: give a key file or set the environment variable")


def prompts() -> tuple[str, str]:
    return SYSTEM_PROMPT, USER_PROMPT


def messages(url: str, mode: str = "cct") -> list[dict]:
    """Chat messages for an image URL (data, file or http), in the staged (cct) or the simple mode."""
    part = lambda text: [{"type": "image_url", "image_url": {"url": url}}, {"type": "text", "text": text}]
    if mode == "cct":
        return [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": part(USER_PROMPT)}]
    return [{"role": "user", "content": part(SIMPLE_PROMPT)}]


def file_messages(path: str, max_pixels: int | None = None) -> list[dict]:
    """Chat messages that name the image file, with a pixel budget where given."""
    image: dict = {"type": "image", "image": path if "://" in path else Path(path).absolute().as_uri()}
    if max_pixels:
        image["max_pixels"] = max_pixels
    return [{"role": "system", "content": SYSTEM_PROMPT}, {"role": "user", "content": [image, {"type": "text", "text": USER_PROMPT}]}]


def http_client(endpoint: str, key: str, options: Options) -> Client:
    """A client of a chat-completions endpoint; one attempt, temperature 0."""

    def call(chat: list[dict]) -> tuple[str, dict]:
        body: dict = {"model": options.model, "messages": chat, "max_tokens": options.max_tokens, "temperature": 0}
        if not options.thinking:
            body["enable_thinking"] = False
        request = urllib.request.Request(endpoint, json.dumps(body, ensure_ascii=False).encode(), {"Authorization": f"Bearer {key}", "Content-Type": "application/json"}, method="POST")
        with urllib.request.urlopen(request, timeout=options.timeout) as answer:
            result = json.loads(answer.read().decode())
        return result["choices"][0]["message"]["content"], result.get("usage", {})

    return call


def stub_client(chat: list[dict]) -> tuple[str, dict]:
    """A deterministic answer, for tests."""
    n = len(json.dumps(chat)) % 100
    return f"<think>t</think><report># FORGERY ANALYSIS\n**[Conclusion]:** FORGED\n**[RISK_SCORE]:** {n}\n[GROUNDING]: [10, 20, 30, 40]\n[REASON]: r\n## SUMMARY\ns\n---\n**END OF REPORT**</report>", {"total_tokens": n}


def todo(split: DataFrame, done: DataFrame | None, retry_errors: bool = False, compat: bool = False) -> DataFrame:
    """The rows of ``split`` whose key is not among those done; rows without a key always run.

    One key on both sides: sample_id, else the image's name. ``compat`` keys the split by sample_id, image_file or the whole
    image_path instead. Error records count as done unless ``retry_errors``.
    """
    if done is None:
        return split
    if retry_errors and "error" in done.columns:
        done = done.where("error is null")
    kept = done.select(nonempty("sample_id", "image_name").alias("_key")).where("_key != ''").distinct()
    own = nonempty("sample_id", "image_file", F.col("image_path") if compat else basename(F.col("image_path")))
    return split.withColumn("_key", own).join(kept, "_key", "left_anti").drop("_key")


RAW = "sample_id string, image_name string, image_path string, gold_label string, language_code string, model string, width int, height int, raw string, usage string, elapsed_sec double, error string"


def in_flight(rows: Iterable, call: Callable, most: int) -> Iterator:
    """Results of ``call`` of each row as they come, in any order, with up to ``most`` calls under way.

    A row is only drawn when a call may begin, so what feeds the rows is held back while calls are slow.
    """
    pool, running = ThreadPoolExecutor(most), set()
    try:
        for row in rows:
            running.add(pool.submit(call, row))
            if len(running) >= most:
                done, running = wait(running, return_when=FIRST_COMPLETED)
                yield from (f.result() for f in done)
        while running:
            done, running = wait(running, return_when=FIRST_COMPLETED)
            yield from (f.result() for f in done)
    finally:  # also where the task ends early: what has not begun does not
        pool.shutdown(wait=True, cancel_futures=True)


#: Finished records that a task holds before they go on.
HELD = 16


def infer(rows: DataFrame, options: Options, client: Client, images: str = "") -> DataFrame:
    """Records of ``rows`` (sample_id, image_file, image_path, label, language_code, width, height and, where it is at hand, content).

    The image is ``content``, or else the file at image_path (a relative one below ``images``), opened in the task that makes the call. Its
    size is the one in its header; the row's where the header tells none. ``options.workers`` calls are under way at once, however many
    cores there are: they are shared among as many partitions as can run. Any failure is its row's error record.
    """
    spark = rows.sparkSession
    ship(spark)
    tasks = max(1, min(options.workers, spark.sparkContext.defaultParallelism))
    each = -(-options.workers // tasks)
    columns = [c.split()[0] for c in RAW.split(", ")]

    def one(r: dict) -> dict:
        began, width, height, raw, usage, error = time.time(), None, None, None, None, None
        try:
            data = r["content"]
            if data is None:
                if not r["image_path"]:
                    raise FileNotFoundError("no image_path")
                data = files.read(files.below(r["image_path"], images))
            width, height = image_files.size_of_bytes(data) or (r["width"], r["height"])
            if width is None or height is None:
                raise ValueError(f"no image: {r['image_path']}")
            raw, told = client(messages(f"{r['kind']},{base64.b64encode(data).decode()}", options.prompt_mode))
            usage = json.dumps(told)
        except Exception as e:  # every failure is a record
            width = height = raw = None
            error = repr(e)
        return {**r, "gold_label": r["label"], "model": options.model, "width": width, "height": height, "raw": raw, "usage": usage, "elapsed_sec": round(time.time() - began, 3), "error": error}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for record in in_flight((r for b in batches for r in b.to_pylist()), one, each):
            held.append(record)
            if len(held) == HELD:
                yield _records(held, columns)
                held = []
        if held:
            yield _records(held, columns)

    content = F.col("content") if "content" in rows.columns else F.lit(None).cast("binary")
    named = rows.select("sample_id", nonempty("image_file", basename(F.col("image_path"))).alias("image_name"), "image_path", "label", "language_code", F.col("width").try_cast("int").alias("width"), F.col("height").try_cast("int").alias("height"), data_kind(F.col("image_path")).alias("kind"), content.alias("content"))
    done = named.repartition(tasks).mapInArrow(run, RAW)
    told = done.withColumn("r", report.record(F.col("raw"), F.col("error"), F.col("width"), F.col("height")))
    return told.select("sample_id", "image_name", "image_path", "gold_label", "language_code", "model", "width", "height", "r.raw_output", "r.raw_output_full", "r.thinking", "r.has_think_tag", "r.has_report_tag", "r.parsed", "elapsed_sec", "usage", F.col("raw").alias("api_raw_content"), "error")


_ARROW = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}


def _records(held: list[dict], columns: list[str]) -> pa.RecordBatch:
    types = [_ARROW[c.split()[1]] for c in RAW.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in held], t) for c, t in zip(columns, types, strict=True)], columns)


def counters(records: DataFrame) -> DataFrame:
    """One row: records written, and errors among them."""
    return records.agg(F.count(F.lit(1)).alias("written"), F.count("error").alias("errors"))


def run_incremental(split_stream: DataFrame, out: str, checkpoint: str, options: Options, client: Client) -> None:
    """Infer what a stream of split rows brings, a micro-batch at a time; the checkpoint remembers what is done."""

    def batch(rows: DataFrame, number: int) -> None:
        infer(rows, options, client).write.mode("overwrite").json(f"{out}/batch={number}")

    split_stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
