"""Line numbers of malformed input, sizes out of image headers, and the inference job: calls under way, and a run that is broken off."""

import collections
import gzip
import json
import os
import struct
import threading
import time
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from parchment import evaluate, infer
from parchment.sources import archive, files, images, jsonl
from parchment.streaming import inference

# --- lines ----------------------------------------------------------------------------------------------------------

GOOD, BAD = '{"image_name": "a", "report": "some text"}', '{"image_name": oops'


def content(n, wrong):
    return "".join((BAD if k in wrong else "" if k % 7 == 0 else GOOD) + "\n" for k in range(1, n + 1))


def test_lines_are_named(spark, tmp_path):
    """The number of a malformed line counts blank ones, in every kind of file, and over splits of one file and several files of one folder."""
    wrong = {"a.jsonl": {3, 444, 999}, "b.jsonl": {1, 1000}, "c.jsonl": set(), "d.jsonl.gz": {5, 800}}
    (tmp_path / "in").mkdir()
    for name, lines in wrong.items():
        text = content(1000, lines)
        (gzip.open(tmp_path / "in" / name, "wt") if name.endswith("gz") else open(tmp_path / "in" / name, "w")).write(text)
    with zipfile.ZipFile(tmp_path / "z.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("prediction.jsonl", content(9000, {2, 8999}))
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", 5000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        assert jsonl.read_lines(spark, str(tmp_path / "in")).rdd.getNumPartitions() > 12
        got = collections.defaultdict(set)
        for r in jsonl.malformed(spark, str(tmp_path / "in"), jsonl.PRED_SCHEMA).collect():
            got[r.file.rsplit("/", 1)[1]].add(r.line)
            assert r.value == BAD
        assert got == {k: v for k, v in wrong.items() if v}
        assert {r.line for r in jsonl.malformed(spark, str(tmp_path / "z.zip"), jsonl.PRED_SCHEMA).collect()} == {2, 8999}
        for path, line in ((tmp_path / "in" / "b.jsonl", 1), (tmp_path / "in" / "d.jsonl.gz", 5), (tmp_path / "z.zip", 2)):
            with pytest.raises(ValueError, match=rf"{path.name}:{line}: malformed JSON line"):
                evaluate.run(spark, str(path), str(tmp_path / "in" / "c.jsonl"))
        with pytest.raises(ZeroDivisionError), jsonl.naming_lines(spark, {}):
            raise ZeroDivisionError
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)


# --- archives -------------------------------------------------------------------------------------------------------


def zipped(path, members, kind=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", kind) as z:
        for name, text in members.items():
            z.writestr(name, gzip.compress(text) if name.endswith(".gz") else text)


def test_archives(spark, tmp_path):
    """The member of the predictions by its name, else the first of lines; all members, each a partition of its own; folders of archives."""
    (tmp_path / "f").mkdir()
    zipped(tmp_path / "f" / "a.zip", {"x.jsonl": b"1\n2", "prediction.jsonl": b"3\n", "prediction.jsonl.gz": "4\n\n\u00e95\r\n6".encode()})
    zipped(tmp_path / "f" / "b.zip", {"readme": b"no", "d/y.jsonl": b"7\n8\n", "z.jsonl.gz": b""})
    lines = lambda path, **k: sorted((r.file.rsplit("/", 1)[1], r.member, r.at, r.value) for r in archive.read_archive(spark, str(path), **k).collect())
    a = [("a.zip", "prediction.jsonl.gz", 0, "4"), ("a.zip", "prediction.jsonl.gz", 1, ""), ("a.zip", "prediction.jsonl.gz", 2, "\u00e95"), ("a.zip", "prediction.jsonl.gz", 3, "6")]
    b = [("b.zip", "d/y.jsonl", 0, "7"), ("b.zip", "d/y.jsonl", 1, "8")]
    assert lines(tmp_path / "f" / "a.zip") == lines(f"file://{tmp_path}/f/a.zip") == a
    assert lines(tmp_path / "f") == a + b
    every = archive.read_archive(spark, str(tmp_path / "f"), members="all")
    assert every.rdd.getNumPartitions() == 5 and every.count() == 9
    assert spark.read.format("parchment_jsonl").load(str(tmp_path / "f")).count() == 6


def test_broken_archives(spark, tmp_path):
    """What is wrong with an archive is told with its name: no member, no archive, cut off, changed bytes, broken text."""
    zipped(tmp_path / "none.zip", {"a.txt": b"x"})
    (tmp_path / "text.zip").write_bytes(b"not an archive")
    zipped(tmp_path / "utf.zip", {"a.jsonl": b'{"a": 1}\n\xff\xfe\n'})
    zipped(tmp_path / "whole.zip", {"a.jsonl": b"".join(b"%d\n" % (k * k) for k in range(50_000))}, zipfile.ZIP_STORED)
    data = bytearray((tmp_path / "whole.zip").read_bytes())
    (tmp_path / "cut.zip").write_bytes(data[:1000])
    data[20_000] ^= 1
    (tmp_path / "changed.zip").write_bytes(data)
    with zipfile.ZipFile(tmp_path / "gz.zip", "w") as z:
        z.writestr("a.jsonl.gz", gzip.compress(b"1\n" * 1000)[:-9])
    for name, why in {"none": "no .jsonl", "text": "not an archive", "utf": "broken at line 1", "cut": "not an archive", "changed": "Bad CRC-32", "gz": "broken at line", "missing": "missing.zip"}.items():
        with pytest.raises(Exception, match=rf"(?s){name}\.zip.*{why}" if name != "missing" else why):
            archive.read_archive(spark, str(tmp_path / f"{name}.zip")).collect()


def test_archives_are_streamed(tmp_path):
    """A member of 200 MB in an archive of 200 MB takes a few batches of memory."""
    import tracemalloc

    line = os.urandom(5000).hex().encode() + b"\n"
    with zipfile.ZipFile(tmp_path / "big.zip", "w", zipfile.ZIP_STORED) as z, z.open("a.jsonl", "w", force_zip64=True) as f:
        for _ in range(20_000):
            f.write(line)
    assert (tmp_path / "big.zip").stat().st_size > 200_000_000
    reader = archive.ArchiveReader(str(tmp_path / "big.zip"), "one")
    tracemalloc.start()
    try:
        assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 20_000
        assert tracemalloc.get_traced_memory()[1] < 60_000_000
    finally:
        tracemalloc.stop()


# --- headers --------------------------------------------------------------------------------------------------------


def jpeg(w, h, before=b""):
    return b"\xff\xd8" + before + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, h, w, 1) + b"\x01\x11\x00\xff\xda"


def segment(kind, n):
    return bytes([0xFF, kind]) + struct.pack(">H", n + 2) + b"\xff\xc0" * (n // 2) + b"x" * (n % 2)


SIZED = {
    "a.png": (b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 70000, 3) + b"\x08", (70000, 3)),
    "a.gif": (b"GIF89a" + struct.pack("<HH", 640, 481), (640, 481)),
    "b.gif": (b"GIF87a" + struct.pack("<HH", 1, 2) + b"rest", (1, 2)),
    "a.bmp": (b"BM" + bytes(12) + struct.pack("<Iii", 40, 33, -44), (33, 44)),
    "b.bmp": (b"BM" + bytes(12) + struct.pack("<IHH", 12, 5, 6) + bytes(4), (5, 6)),
    "a.webp": (b"RIFF\0\0\0\0WEBPVP8 " + bytes(7) + b"\x9d\x01\x2a" + struct.pack("<HH", 300 | 0x4000, 200), (300, 200)),
    "b.webp": (b"RIFF\0\0\0\0WEBPVP8L" + bytes(4) + b"\x2f" + struct.pack("<I", 299 | 199 << 14), (300, 200)),
    "c.webp": (b"RIFF\0\0\0\0WEBPVP8X" + bytes(8) + (299).to_bytes(3, "little") + (99999).to_bytes(3, "little"), (300, 100000)),
    "a.jpg": (jpeg(1920, 1080), (1920, 1080)),
    "b.jpg": (jpeg(8, 9, segment(0xE0, 14) + b"\xff\xd0" + segment(0xE1, 60_001) + segment(0xC4, 20)), (8, 9)),
}
BROKEN = {
    "empty": b"", "text": b"not an image at all, but long enough", "cut.png": SIZED["a.png"][0][:20], "no-area.png": SIZED["a.png"][0][:16] + bytes(8), "cut.jpg": SIZED["b.jpg"][0][:500], "no-frame.jpg": b"\xff\xd8" + segment(0xE0, 4) + b"\xff\xda",
    "loop.jpg": b"\xff\xd8\xff\xe0\x00\x00\xff\xe0", "cut.webp": SIZED["a.webp"][0][:28], "other.webp": b"RIFF\0\0\0\0WEBPVP8Z" + bytes(20), "cut.bmp": b"BM" + bytes(10), "cut.gif": b"GIF89a\x01",
}


def test_headers():
    for name, (data, size) in SIZED.items():
        asked = []

        def read(at, n, data=data, asked=asked):
            asked.append(n)
            return data[at : at + n]

        assert images.size(read) == images.size_of_bytes(data) == size, name
        assert sum(asked) < 120, name
    for name, data in BROKEN.items():
        assert images.size_of_bytes(data) is None, name


def test_headers_agree_with_an_encoder(spark, tmp_path):
    """Files written by Java's encoders have the sizes that they were made with."""
    jvm = spark._jvm
    for kind in ("png", "jpg", "gif", "bmp"):
        picture = jvm.java.awt.image.BufferedImage(37, 21, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
        at = str(tmp_path / f"x.{kind}")
        assert jvm.javax.imageio.ImageIO.write(picture, kind, jvm.java.io.File(at))
        assert images.size_of_file(at) == images.size_of_file(f"file://{at}") == (37, 21)


def test_sizes_of_rows(spark, tmp_path):
    for name, data in {**{k: v[0] for k, v in SIZED.items()}, **BROKEN}.items():
        (tmp_path / name).write_bytes(data)
    rows = [("1", str(tmp_path / "a.png"), None, None), ("2", "a.gif", None, 7), ("3", "a.gif", 1, 2), ("4", "none.gif", None, None), ("5", None, None, None), ("6", f"file://{tmp_path}/cut.jpg", None, None), ("7", "a.gif", None, None), ("8", "", None, None)]
    gt = spark.createDataFrame(rows, "k string, image_path string, width int, height int")
    got = {r.k: (r.width, r.height) for r in images.with_sizes(gt, str(tmp_path)).collect()}
    assert got == {"1": (70000, 3), "2": (640, 481), "3": (1, 2), "4": (None, None), "5": (None, None), "6": (None, None), "7": (640, 481), "8": (None, None)}


# --- inference ------------------------------------------------------------------------------------------------------


class Model(BaseHTTPRequestHandler):
    """A chat-completions endpoint that answers slowly and knows how many calls are under way."""

    lock, now, most, bodies = threading.Lock(), 0, 0, []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        with Model.lock:
            Model.now += 1
            Model.most = max(Model.most, Model.now)
            Model.bodies.append((self.headers["Authorization"], body))
        time.sleep(0.6)
        with Model.lock:
            Model.now -= 1
        wrong = body["messages"][-1]["content"][0]["image_url"]["url"].endswith("ZmFpbA==")
        answer = b"no" if wrong else json.dumps({"choices": [{"message": {"content": "<report>[Conclusion]: FORGED</report>"}}], "usage": {"total_tokens": 3}}).encode()
        self.send_response(500 if wrong else 200)
        self.send_header("Content-Length", str(len(answer)))
        self.end_headers()
        self.wfile.write(answer)

    def log_message(self, *_):
        pass


def test_calls_under_way(spark, tmp_path):
    """32 calls are under way on four cores, over HTTP; a refused call and a missing image are error records."""
    server = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    server.request_queue_size = 64
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        rows = [(str(k), f"{k}.png", b"fail" if k == 5 else SIZED["a.png"][0], 10, 20) for k in range(240)] + [("none", "missing.png", None, 10, 20)]
        frame = spark.createDataFrame(rows, "sample_id string, image_path string, content binary, width int, height int").selectExpr("*", "CAST(NULL AS STRING) AS image_file", "'fake' AS label", "'en' AS language_code")
        options = inference.Options("m", workers=32, max_tokens=9)
        client = inference.http_client(f"http://127.0.0.1:{server.server_port}/v1", "secret", options)
        got = {r.sample_id: r for r in inference.infer(frame, options, client, str(tmp_path)).collect()}
    finally:
        server.shutdown()
    assert len(got) == 241 and Model.most == 32
    assert got["5"].error.startswith("<HTTPError 500") and got["none"].error.startswith("FileNotFoundError") and got["5"].parsed is None
    assert all(r.error is None and r.parsed.conclusion == "FORGED" and (r.width, r.height) == (70000, 3) and json.loads(r.usage) == {"total_tokens": 3} for k, r in got.items() if k not in ("5", "none"))
    key, body = Model.bodies[0]
    assert key == "Bearer secret" and body["model"] == "m" and body["max_tokens"] == 9 and body["temperature"] == 0 and body["enable_thinking"] is False


def test_rows_are_drawn_as_calls_end():
    drawn, gate = [], threading.Semaphore(0)

    def rows():
        for k in range(10):
            drawn.append(k)
            yield k

    results = inference.in_flight(rows(), lambda k: gate.acquire() and k, 3)
    threading.Timer(0.2, lambda: gate.release(1)).start()
    next(results)
    assert len(drawn) == 3
    gate.release(20)
    assert len(list(results)) == 9
    broken = inference.in_flight(iter(range(5)), lambda k: 1 // k, 2)
    with pytest.raises(ZeroDivisionError):
        list(broken)


def test_a_broken_run_is_taken_up(spark, tmp_path):
    """A worker dies half way. Records of finished batches stay; taken up again the job calls for one batch's rows twice at most."""
    (tmp_path / "im").mkdir()
    (tmp_path / "im" / "a.png").write_bytes(SIZED["a.png"][0])
    split, out, calls, deadly = (str(tmp_path / x) for x in ("split.jsonl", "out", "calls", "deadly"))
    rows = [{"sample_id": str(k), "image_path": "a.png", "label": "fake", "language_code": f"n{k}"} for k in range(60)]
    with open(split, "w") as f:
        f.write("\n".join(map(json.dumps, rows)))
    open(deadly, "w").close()

    def client(chat):
        with open(calls, "a") as f:
            f.write("x\n")
        if os.path.exists(deadly) and sum(1 for _ in open(calls)) > 35:
            os._exit(1)
        return "<report>[Conclusion]: FORGED</report>", {}

    job = lambda **k: infer.run(spark, split, str(tmp_path / "im"), out, inference.Options("stub", workers=2), client, batch_rows=10, **k)
    with pytest.raises(Exception):  # noqa: B017
        job()
    kept = [r.sample_id for r in spark.read.json(out).collect()]
    assert len(kept) == len(set(kept)) >= 20 and len(infer.unfinished(spark, out)) == 1
    os.remove(deadly)
    made = sum(1 for _ in open(calls))
    assert job(resume=True) == {"written": 60, "errors": 0}
    ids = [r.sample_id for r in spark.read.json(out).collect()]
    assert sorted(ids, key=int) == [str(k) for k in range(60)]
    assert sum(1 for _ in open(calls)) - made == 60 - len(kept) and infer.unfinished(spark, out) == []
    assert made - len(kept) <= 12
    assert job(resume=True) == {"written": 0, "errors": 0}
    with open(split, "a") as f:
        f.write("\n" + json.dumps({"sample_id": "new", "image_path": "gone.png"}))
    assert job(resume=True) == {"written": 1, "errors": 1}
    with open(split, "a") as f:
        f.write("\n{broken")
    with pytest.raises(ValueError, match=r"split.jsonl:62: malformed JSON line"):
        job(resume=True)


def test_paths(tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    assert files.read(str(tmp_path / "x")) == files.read(f"file:{tmp_path}/x") == files.read(f"file://{tmp_path}/x") == b"abc"
    assert files.below("a/b", "/r") == "/r/a/b" and files.below("/a", "/r") == "/a" and files.below("a", "s3://b/c/") == "s3://b/c/a" and files.below("hdfs://n/a", "/r") == "hdfs://n/a"
