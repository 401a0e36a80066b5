"""Streams: redaction carries no state between rows, so the batch plan is the streaming plan."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.detect import RedactionFailed
from spanloom.operators.replace import redact
from spanloom.plans.config import Config, models_needed, of_regions
from spanloom.sources.files import redact_file
from spanloom.sources.readers import kind_of
from spanloom.sources.sinks import WouldOverwrite, event

REQUEST = "id string, op string, input string, categories array<string>"


def redact_stream(stream: DataFrame, config: Config, context: str = "default", text: str = "text") -> DataFrame:
    return redact(stream, config, context, text)


def answers(requests: DataFrame, config: Config, context: str = "everything") -> DataFrame:
    """JSON request lines (column ``value``) to JSON event lines: done with counts, or error; a bad line never stops the stream."""
    lines = requests.where(F.trim("value") != "").select(F.from_json("value", REQUEST, {"mode": "PERMISSIVE"}).alias("r")).select("r.*")
    bad = F.col("op").isNull() | ~F.col("op").isin("redact", "quit") | ((F.col("op") == "redact") & F.col("input").isNull())
    done = redact(lines, config, context, "input")
    asked = F.when(F.col("categories").isNull(), F.col("receipt")).otherwise(F.map_filter("receipt", lambda k, v: F.array_contains("categories", k)))
    return done.where((F.col("op") != "quit") | bad).select(F.when(bad, event(F.col("id"), "error", message=F.lit("the request cannot be read"))).otherwise(event(F.col("id"), "done", output=F.col("redacted"), counts=asked)).alias("value"))


def handled(spark: SparkSession, config: Config, request: dict, read_lines=None) -> Iterator[dict]:
    """The events of one request for a file: ``stage`` as it goes, then ``done`` or ``error``; a failure is told by its kind and never by content.

    ``categories`` are regions; their entities are taken from the context ``everything``. Operations: ``redact``, ``status``.
    """
    say = lambda what, **more: {"id": request.get("id"), "event": what, **more}
    if request.get("op") == "status":
        yield say("status", entities=len(config.entities), contexts=sorted(config.contexts), models=sorted(models_needed(config, list(config.entities))))
        return
    if request.get("op") != "redact" or not request.get("input") or not request.get("output"):
        yield say("error", kind="request", message="the request cannot be read")
        return
    from pyspark.errors import PySparkException

    counts: dict[str, int] = {}
    try:
        source = spark._jvm.org.apache.hadoop.fs.Path(request["input"])
        if not source.getFileSystem(spark._jsc.hadoopConfiguration()).exists(source):
            yield say("error", kind="missing", message="the file is not there")
            return
        kind = spark.read.format("binaryFile").load(request["input"]).select(kind_of(F.col("path"), F.col("content")).alias("k")).first().k
        if kind is None:
            yield say("error", kind="unsupported", message="this kind of file cannot be read")
            return
        yield say("stage", stage="reading")
        entities = of_regions(config, request["categories"]) if request.get("categories") is not None else None
        yield say("stage", stage="hiding")
        out = redact_file(spark, request["input"], request["output"], config=config, context="everything", force=bool(request.get("force")), entities=entities, read_lines=read_lines, terms=tuple(request.get("extra_terms") or ()), receipt=counts)
        yield say("done", kind=kind, output=out, counts=counts)
    except WouldOverwrite:
        yield say("error", kind="exists", message="there is a redacted copy already")
    except RedactionFailed as e:
        yield say("error", kind="refused", message=str(e))
    except (PySparkException, OSError, ValueError) as e:
        yield say("error", kind="failed", message=type(e).__name__)


def serve(spark: SparkSession, config: Config, lines: Iterable[str], say: Callable[[str], object], read_lines=None) -> None:
    """Answers JSON request lines with JSON event lines, from ``ready`` until ``quit`` or the end; a bad line is an error event."""
    say(json.dumps({"id": None, "event": "ready"}))
    for line in lines:
        if not line.strip():
            continue
        try:
            request = json.loads(line)
            if not isinstance(request, dict):
                raise ValueError
        except ValueError:
            say(json.dumps({"id": None, "event": "error", "kind": "request", "message": "the request cannot be read"}))
            continue
        if request.get("op") == "quit":
            return
        for x in handled(spark, config, request, read_lines):
            say(json.dumps(x))
