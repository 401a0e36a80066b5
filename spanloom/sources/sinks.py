"""Sinks: tables and files that appear whole or not at all, JSON lines, and logs without values."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.plans.catalogue import DISPLAY


class WouldOverwrite(FileExistsError):
    pass


def write(df: DataFrame, path: str, kind: str = "parquet", force: bool = False) -> None:
    """By Spark's commit protocol; an existing target is refused unless forced."""
    from pyspark.errors import AnalysisException

    try:
        df.write.format(kind).mode("overwrite" if force else "errorifexists").save(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_ALREADY_EXISTS":
            raise WouldOverwrite(path) from e
        raise


def labelled_lines(df: DataFrame, path: str, force: bool = False) -> None:
    write(df.select("text", "spans"), path, "json", force)


def event(request_id: Column, kind: str, **more: Column) -> Column:
    """A JSON event line."""
    return F.to_json(F.struct(request_id.alias("id"), F.lit(kind).alias("event"), *(v.alias(k) for k, v in more.items())))


def loggable(spans: Column) -> Column:
    """Entity, offsets and score: what may be logged."""
    return F.transform(spans, lambda s: F.struct(s.entity.alias("entity"), s.start.alias("start"), s.end.alias("end"), s.score.alias("score")))


def receipt_line(receipt: Column) -> Column:
    """``EMAIL 2, PHONE 1``"""
    return F.array_join(F.transform(F.array_sort(F.map_entries(receipt)), lambda e: F.concat(e.key, F.lit(" "), e.value.cast("string"))), ", ")


def display_name(entity: Column) -> Column:
    """What people are shown for an entity: its fixed name, Secret for keys and tokens, or its words without the country."""
    known = F.create_map(*[F.lit(x) for kv in DISPLAY.items() for x in kv])
    words = F.split(F.regexp_replace(entity, "^(IN|US|UK)_", ""), "_")
    made = F.array_join(F.transform(words, lambda w: F.when(F.char_length(w) <= 6, w).otherwise(F.concat(F.left(w, F.lit(1)), F.lower(F.substring(w, 2, 1 << 30))))), " ")
    return F.coalesce(known[entity], F.when(entity.rlike("_(KEY|TOKEN)$"), "Secret").otherwise(made))


def shown(receipt: Column) -> Column:
    """A receipt by display names, summed."""
    named = F.transform(F.map_entries(receipt), lambda e: F.struct(display_name(e.key).alias("k"), e.value.alias("v")))
    names = F.array_sort(F.array_distinct(F.transform(named, lambda e: e.k)))
    return F.map_from_entries(F.transform(names, lambda n: F.struct(n.alias("key"), F.aggregate(F.filter(named, lambda e: e.k == n), F.lit(0), lambda s, e: s + e.v).alias("value"))))


def receipt_text(receipt: Column) -> Column:
    """``Email \u00d72   Phone \u00d71``"""
    return F.array_join(F.transform(F.array_sort(F.map_entries(shown(receipt))), lambda e: F.concat(e.key, F.lit(" \u00d7"), e.value.cast("string"))), "   ")


def put_whole(spark: SparkSession, path: str, content: bytes | str, force: bool = False) -> None:
    """A single file of the driver's making, on any file system Spark knows: written aside, then renamed; it is there whole or not at all."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target) and not force:
        raise WouldOverwrite(path)
    aside = jvm.org.apache.hadoop.fs.Path(target.getParent() or jvm.org.apache.hadoop.fs.Path("."), f".{target.getName()}.tmp.{uuid.uuid4().hex}")
    try:
        out = fs.create(aside, False)
        try:
            out.write(bytearray(content.encode() if isinstance(content, str) else content))
        finally:
            out.close()
        if fs.exists(target):
            fs.delete(target, False)
        if not fs.rename(aside, target):
            raise OSError(f"{path} cannot be written")
    finally:
        if fs.exists(aside):
            fs.delete(aside, False)


def sweep(spark: SparkSession, folder: str) -> list[str]:
    """Deletes what interrupted writers left aside in a folder; returns the names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    left = [s.getPath() for s in fs.listStatus(path) if s.isFile() and ".tmp." in s.getPath().getName()]
    for p in left:
        fs.delete(p, False)
    return sorted(p.getName() for p in left)


def steps(request_id: Column, kind: Column, stages: list[str]) -> Column:
    """The events of a request that is under way: ``ready``, then a ``stage`` each, then ``status``."""
    first = [event(request_id, "ready")]
    return F.array(*first, *[event(request_id, "stage", kind=kind, stage=F.lit(s)) for s in stages], event(request_id, "status", kind=kind))
