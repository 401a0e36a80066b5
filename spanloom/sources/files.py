"""File to file: what kind a file is decides the way; the result appears whole or not at all."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import boxes, detect, identity
from spanloom.operators.detect import RedactionFailed
from spanloom.operators.replace import redact
from spanloom.plans.config import Config
from spanloom.sources import images
from spanloom.sources.readers import IMAGES, folder
from spanloom.sources.sinks import put_whole


def default_target(path: str, suffix: str | None = None) -> str:
    """``<stem>.redacted<suffix>`` beside the file."""
    head, _, name = path.rpartition("/")
    stem, dot, own = name.rpartition(".")
    stem, own = (stem, dot + own) if stem else (name, "")
    return f"{head}/{stem}.redacted{suffix or own}" if head else f"{stem}.redacted{suffix or own}"


def kind_of_name(path: str) -> str:
    suffix = path.rpartition(".")[2].lower()
    return "pdf" if suffix == "pdf" else "image" if suffix in IMAGES else "text"


def _mine(spark: SparkSession, df: DataFrame, me: dict | None):
    """The table with the person's details, and the filter that keeps their own findings."""
    if me is None:
        return df, None
    return identity.with_identity(df, me), lambda spans: identity.filter_mine(spans, F.col("text"), F.col("me"))


def redact_file(spark: SparkSession, path: str, target: str | None = None, *, config: Config, context: str = "default", who: str = "everyone", me: dict | None = None, force: bool = False, entities: list[str] | None = None, salt: str | None = None, read_lines: Callable[[DataFrame], DataFrame] | None = None, terms: tuple[str, ...] = (), receipt: dict | None = None) -> str:
    """Redacts one file to a new one and returns its path.

    Text must be valid UTF-8. Images need ``read_lines``: pages ``path, height, width, rgb`` to lines ``page_id`` (the
    path), ``line_no, text, score, box, words``; the result is a PNG. PDF files need a renderer, which is not here.
    Nothing is written when anything fails, or when the target is there and ``force`` is not set. ``terms`` are hidden
    too; ``receipt`` is filled with the places found by entity.
    """
    if who not in ("everyone", "mine"):
        raise ValueError("who is everyone or mine")
    if who == "mine" and me is None:
        raise ValueError("whose data is mine? give the details")
    kind = kind_of_name(path)
    if kind == "pdf":
        raise RedactionFailed("PDF pages need a renderer, which is not here; nothing was written")
    if kind == "image":
        if who == "mine":
            raise ValueError("images are always redacted for everyone")
        return _redact_image(spark, path, target or default_target(path, ".png"), config, context, force, entities, read_lines, terms, receipt)
    row = spark.read.format("binaryFile").load(path).select(F.call_function("try_validate_utf8", F.col("content")).cast("string").alias("text"))
    read, keep = _mine(spark, row, me if who == "mine" else None)
    got = redact(read, config, context, entities=entities, salt=salt, keep=keep, extra=detect.terms(F.col("text"), terms) if terms else None).select("redacted", "receipt").first()
    if got is None or got.redacted is None:
        raise RedactionFailed(f"{path} is not a text; nothing was written")
    target = target or default_target(path)
    put_whole(spark, target, got.redacted, force)
    if receipt is not None:
        receipt.update(got.receipt or {})
    return target


def _redact_image(spark, path, target, config, context, force, entities, read_lines, terms, receipt) -> str:
    if read_lines is None:
        raise RedactionFailed("images need a reader of lines; nothing was written")
    pages = images.with_blank(images.images(spark, path)).cache()
    try:
        page = pages.select("height", "width", "blank").first()
        if page is None:
            raise RedactionFailed(f"{path} cannot be decoded; nothing was written")
        cover = spark.createDataFrame([], "path string, x1 int, y1 int, x2 int, y2 int")
        if not page.blank:
            lines = read_lines(pages.drop("blank")).cache()
            told = boxes.quality(lines).first()
            if told is None or not told.readable:
                raise RedactionFailed(f"{path} is too hard to read; nothing was written")
            order = F.array_sort(F.collect_list(F.struct("line_no", "text")))
            text = lines.groupBy("page_id").agg(F.array_join(F.transform(order, lambda x: x.text), "\n").alias("text"))
            done = redact(text, config, context, entities=entities, extra=detect.terms(F.col("text"), terms) if terms else None)
            if receipt is not None:
                receipt.update(done.first().receipt or {})
            found = done.select("page_id", F.explode("spans").alias("s")).select("page_id", "s.*")
            met = boxes.on_lines(found, lines)
            one = met.select(F.col("page_id").alias("path"), boxes.photo_box(F.col("box"), F.lit(page.width - 1), F.lit(page.height - 1)).alias("b"))
            cover = one.select("path", *(F.col(f"b.{c}").cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))
        put_whole(spark, target, bytes(images.as_png(images.paint(pages.drop("blank"), cover)).first().png), force)
        return target
    finally:
        pages.unpersist()


def redact_folder(spark: SparkSession, path: str, config: Config, context: str = "default", **more) -> DataFrame:
    """``path, target, redacted, receipt, error`` of all files below a folder: texts redacted, others with the reason why not."""
    files = folder(spark, path)
    done = redact(files, config, context, **more)
    target = F.concat(F.regexp_extract("path", r"^(.*/[^/]+?)(\.[^./]+)?$", 1), F.lit(".redacted"), F.regexp_extract("path", r"^(.*/[^/]+?)(\.[^./]+)?$", 2))
    why = F.when(F.col("kind") == "pdf", "PDF pages need a renderer").when(F.col("kind") == "image", "images need a reader of lines").when(F.col("kind").isNull(), "neither text nor image")
    text = F.col("kind") == "text"
    return done.select("path", F.when(text, target).alias("target"), F.when(text, F.col("redacted")).alias("redacted"), F.when(text, F.col("receipt")).alias("receipt"), why.alias("error"))
