import hashlib
import hmac
import io
import json
import struct
import types

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import cli
from spanloom.operators import replace
from spanloom.operators.detect import RedactionFailed
from spanloom.plans.config import ConfigError, extend, load, of_regions, preferences, shipped
from spanloom.sources import files, images, sinks

CONFIG = shipped()


def put(path, pixels):
    path.write_bytes(images.png(pixels))
    return str(path)


def test_images_round_trip_and_paint(spark, tmp_path):
    x = np.random.RandomState(0).randint(0, 256, (40, 30, 3)).astype(np.uint8)
    put(tmp_path / "a.png", x)
    put(tmp_path / "white.png", np.full((8, 9, 3), 250, np.uint8))
    got = {r.path.rpartition("/")[2]: r for r in images.with_blank(images.images(spark, str(tmp_path))).collect()}
    assert (np.frombuffer(got["a.png"].rgb, np.uint8).reshape(40, 30, 3) == x).all() and (got["a.png"].height, got["a.png"].width) == (40, 30)
    assert got["white.png"].blank and not got["a.png"].blank
    pages = images.images(spark, str(tmp_path / "a.png"))
    boxes = pages.select("path", F.lit(20).alias("x1"), F.lit(5).alias("y1"), F.lit(10).alias("x2"), F.lit(99).alias("y2"))
    want = x.copy()
    want[5:, 10:21] = 0
    assert bytes(images.as_png(images.paint(pages, boxes)).first().png) == images.png(want)


def test_orientation():
    tiff = b"MM\0*" + struct.pack(">IHHHIHH", 8, 1, 0x0112, 3, 1, 6, 0)
    assert images.orientation(b"\xff\xd8\xff\xe1\0\x20Exif\0\0" + tiff) == 6 and images.orientation(b"\xff\xd8rest") == 1 == images.orientation(b"\xff\xd8Exif\0\0MM")
    x = np.arange(6).reshape(2, 3, 1)
    assert images.upright(x, 6)[:, :, 0].tolist() == [[3, 0], [4, 1], [5, 2]] and images.upright(x, 8)[:, :, 0].tolist() == [[2, 5], [1, 4], [0, 3]]
    assert all(sorted(images.upright(x, k).ravel().tolist()) == list(range(6)) for k in range(1, 9))


def test_files(spark, tmp_path):
    note = tmp_path / "note.md"
    note.write_text("mail a@x.com or b@x.com")
    out = files.redact_file(spark, str(note), config=CONFIG)
    assert out == str(tmp_path / "note.redacted.md") and open(out).read() == "mail [EMAIL_1] or [EMAIL_2]"
    with pytest.raises(sinks.WouldOverwrite):
        files.redact_file(spark, str(note), config=CONFIG)
    files.redact_file(spark, str(note), config=CONFIG, force=True, who="mine", me={"emails": ["B@x.com"]})
    assert open(out).read() == "mail a@x.com or [EMAIL_1]"
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe a@x.com")
    for bad, said in (("bad.txt", RedactionFailed), ("x.pdf", RedactionFailed), ("a.png", RedactionFailed)):
        with pytest.raises(said):
            files.redact_file(spark, str(tmp_path / bad), config=CONFIG)
    assert not [p for p in tmp_path.iterdir() if "bad.redacted" in p.name or ".tmp." in p.name]
    assert [files.default_target(x) for x in ("a/b.tar.gz", "b", "/x/.env")] == ["a/b.tar.redacted.gz", "b.redacted", "/x/.env.redacted"]
    got = {r.path.rpartition("/")[2]: r for r in files.redact_folder(spark, str(tmp_path), CONFIG).collect()}
    assert got["note.md"].redacted == "mail [EMAIL_1] or [EMAIL_2]" and got["note.md"].target.endswith("/note.redacted.md") and got["bad.txt"].error and got["bad.txt"].redacted is None


def test_image_file(spark, tmp_path):
    x = np.random.RandomState(1).randint(1, 256, (200, 300, 3)).astype(np.uint8)
    path = put(tmp_path / "scan.png", x)

    def reader(pages):
        box = "struct<x1:int,y1:int,x2:int,y2:int>"
        rows = [("alpha beta gamma delta words here", (60, 60, 120, 70)), ("mail a@x.com", (150, 150, 200, 160))]
        lines = F.array(*[F.struct(F.lit(k).alias("line_no"), F.lit(t).alias("text"), F.lit(0.9).alias("score"), F.struct(*[F.lit(v).alias(n) for v, n in zip(b, ("x1", "y1", "x2", "y2"), strict=True)]).cast(box).alias("box"), F.lit(None).cast("string").alias("words")) for k, (t, b) in enumerate(rows)])
        return pages.select(F.col("path").alias("page_id"), F.explode(lines).alias("l")).select("page_id", "l.*")

    out = files.redact_file(spark, path, config=CONFIG, read_lines=reader)
    got = np.frombuffer(images.images(spark, out).first().rgb, np.uint8).reshape(200, 300, 3)
    assert (got[150:161, 150:201] == 0).all() and (got[60:71, 60:121] == x[60:71, 60:121]).all() and (got[:100] == x[:100]).all()
    with pytest.raises(RedactionFailed):
        files.redact_file(spark, path, str(tmp_path / "other.png"), config=CONFIG, read_lines=lambda p: reader(p).where("line_no = 1"))
    assert not (tmp_path / "other.png").exists()


def test_put_whole_and_sweep(spark, tmp_path):
    (tmp_path / ".x.tmp.1").write_text("left")
    sinks.put_whole(spark, str(tmp_path / "a.txt"), "héllo")
    assert (tmp_path / "a.txt").read_text() == "héllo" and sinks.sweep(spark, str(tmp_path)) == [".x.tmp.1"]
    with pytest.raises(sinks.WouldOverwrite):
        sinks.put_whole(spark, str(tmp_path / "a.txt"), b"b")


def test_strategy_of_ones_own_and_keyed_hash(spark):
    replace.register("initial", lambda text, spans, config: F.transform(replace.values(text, spans), lambda v: F.concat(F.left(v.value, F.lit(1)), F.lit("..."))))
    more = extend(CONFIG, contexts={"short": {"entities": ["EMAIL"], "strategy": "initial"}})
    df = spark.createDataFrame([("mail abc@x.com", 7)], "text string, found int")
    assert replace.redact(df, more, "short").first().redacted == "mail a..."
    with pytest.raises(ValueError):
        replace.register("mask", None)
    for salt in ("pepper salt", "long" * 40):
        got = replace.redact(df, CONFIG, "default", strategy="hash", salt=salt)
        assert got.first().redacted == f"mail [EMAIL_{hmac.new(salt.encode(), b'abc@x.com', hashlib.sha256).hexdigest()[:12]}]" and got.columns == ["text", "found", "spans", "receipt", "redacted"]
        assert salt not in got._jdf.queryExecution().toString()


def test_yaml_formats(tmp_path):
    (tmp_path / "taxonomy.yaml").write_text('entities:\n  - {name: A_KEY, description: a key, detect_with: [both], region: secrets, replacement: "[A]"}\n  - {name: UK_NHS, description: n, detect_with: presidio, region: uk}\n')
    (tmp_path / "patterns.yaml").write_text("A_KEY:\n  - {name: a, regex: 'a{3}', score: 0.9}\n")
    (tmp_path / "rules.yaml").write_text("contexts:\n  default: {regions: [secrets, custom]}\n  all: {inherits: default, entities: [+UK_NHS]}\n  uk: {inherits: default, regions: uk}\n")
    c = load(str(tmp_path))
    assert c.entities["A_KEY"].replacement == "A" and set(c.entities["A_KEY"].detect_with) == {"regex", "model"} and c.context("uk").entities == ("UK_NHS",) and [x[0] for x in c.checked] == ["UK_NHS"]
    (tmp_path / "taxonomy.yaml").write_text("entities:\n  - {name: UNHEARD_OF, description: n, detect_with: [presidio]}\n")
    (tmp_path / "patterns.yaml").write_text("{}\n")
    (tmp_path / "rules.yaml").write_text("contexts: {default: {entities: [UNHEARD_OF]}}\n")
    with pytest.raises(ConfigError):
        load(str(tmp_path))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    args = lambda **x: types.SimpleNamespace(**{"entities": None, "context": None, "preferences": str(tmp_path / "p.yaml")} | x)
    assert cli.chosen(args(entities="EMAIL,PHONE"), CONFIG) == ("everything", ["EMAIL", "PHONE"]) and cli.chosen(args(entities="EMAIL", context="default"), CONFIG) == ("default", ["EMAIL"])
    assert cli.chosen(args(context="notes"), CONFIG) == ("notes", None) and cli.chosen(args(), CONFIG) == ("default", None)
    assert cli.chosen(args(), CONFIG, lambda _: "1, 3") == ("everything", of_regions(CONFIG, ["secrets", "india"])) and cli.chosen(args(), CONFIG, lambda _: "9") == ("default", None)
    (tmp_path / "p.yaml").write_text("entities: [EMAIL]\n")
    assert cli.chosen(args(), CONFIG, lambda _: "1") == ("everything", ["EMAIL"]) and preferences(str(tmp_path / "none.yaml")) == {"entities": None, "ocr_langs": []}
    assert cli.main(["check"]) == 0 and "51 entities" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("mail a@x.com"))
    monkeypatch.setattr(cli, "session", lambda: spark)
    assert cli.main(["text", "--context", "default"]) == 0 and capsys.readouterr().out == "mail [EMAIL_1]"
    assert cli.main(["text", "--context", "nope", "x"]) == 1 and "nope" in capsys.readouterr().err
    (tmp_path / "l.jsonl").write_text('{"text": "mail a@x.com", "spans": [{"entity": "EMAIL", "start": 5, "end": 12}]}\n')
    assert cli.main(["eval", "--context", "default", str(tmp_path)]) == 0 and "| EMAIL | 1 | 0 | 0 |" in capsys.readouterr().out
    assert cli.main(["file", "--context", "default", str(tmp_path / "none.txt")]) == 1 and not (tmp_path / "none.redacted.txt").exists()


def test_requests(spark, tmp_path):
    from spanloom.streaming import helper

    (tmp_path / "a.txt").write_text("mail a@x.com, Asha Rao")
    (tmp_path / "b.bin").write_bytes(b"\0\1")
    ask = lambda **x: json.dumps({"id": "1", "op": "redact", "input": str(tmp_path / "a.txt"), "output": str(tmp_path / "out.txt")} | x)
    said = []
    helper.serve(spark, CONFIG, ["", "{", "[]", ask(op="status"), ask(categories=["global"], extra_terms=["asha rao"]), ask(), ask(force=True, categories=["secrets"]), ask(input=str(tmp_path / "no")), ask(input=str(tmp_path / "b.bin")), ask(input=None), ask(op="quit"), ask()], lambda x: said.append(json.loads(x)))
    told = [(x["event"], x.get("kind") or x.get("stage")) for x in said]
    steps = [("stage", "reading"), ("stage", "hiding")]
    assert told == [("ready", None), ("error", "request"), ("error", "request"), ("status", None), *steps, ("done", "text"), *steps, ("error", "exists"), *steps, ("done", "text"), ("error", "missing"), ("error", "unsupported"), ("error", "request")]
    assert said[6]["counts"] == {"EMAIL": 1, "PERSON": 1} and said[12]["counts"] == {}
    assert (tmp_path / "out.txt").read_text() == "mail a@x.com, Asha Rao"
