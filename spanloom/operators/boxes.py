"""Geometry of scanned pages: quality gate, spans to lines and words, and what to paint over. Rows, no pixels.

Lines are ``page_id, line_no, text, score, box, words`` as told in the fixtures; scanning and painting
themselves need libraries that are not here and plug in before and after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.text import is_garbage, let


def quality(lines: DataFrame, least_words: int = 5, least_mean: float = 0.5) -> DataFrame:
    """``page_id, words, mean, readable``: kept words and their lines' mean score; unreadable pages are to be refused."""
    word = F.explode(F.split("text", r"\s+"))
    kept = lines.select("page_id", "score", word.alias("w")).withColumn("good", ~is_garbage(F.col("w")))
    got = kept.groupBy("page_id").agg(F.count_if("good").alias("words"), F.avg(F.when(F.col("good"), F.col("score"))).alias("mean"))
    return got.withColumn("readable", (F.col("words") >= least_words) & (F.coalesce("mean", F.lit(0.0)) >= least_mean))


def is_blank(grey: Column, least: float = 2.0) -> Column:
    """Whether a page (its luminances) has no ink: they spread less than ``least``. Such pages pass unread."""
    n, real = F.size(grey), F.transform(grey, lambda x: x.cast("double"))
    mean = F.aggregate(real, F.lit(0.0), lambda s, x: s + x) / n
    spread = let(mean, lambda m: F.sqrt(F.aggregate(real, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / n))
    return F.when(n > 0, spread < least).otherwise(True)


def passes(first: DataFrame, more: DataFrame) -> DataFrame:
    """The lines of a page's first reading, then those of further ones, numbered on."""
    both = first.withColumn("pass__", F.lit(0)).unionByName(more.withColumn("pass__", F.lit(1)))
    order = Window.partitionBy("page_id").orderBy("pass__", "line_no")
    return both.withColumn("line_no", F.row_number().over(order) - 1).drop("pass__")


def line_starts(lines: DataFrame) -> DataFrame:
    """Adds ``at``: each line's offset in the page's text, lines joined by line breaks."""
    order = Window.partitionBy("page_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("at", F.coalesce(F.sum(F.char_length("text") + 1).over(order), F.lit(0)))


def on_lines(spans: DataFrame, lines: DataFrame) -> DataFrame:
    """A row for each line that a span touches, with the span clipped to it (``from``, ``to`` in the line)."""
    s, t = spans.alias("s"), line_starts(lines).alias("t")
    end = F.col("t.at") + F.char_length("t.text")
    met = s.join(t, (F.col("s.page_id") == F.col("t.page_id")) & (F.col("s.start") < end) & (F.col("t.at") < F.col("s.end")))
    return met.select("t.page_id", "t.line_no", "s.entity", (F.greatest("s.start", "t.at") - F.col("t.at")).alias("from"), (F.least("s.end", end) - F.col("t.at")).alias("to"), "t.box", "t.words")


def _clamp(x: Column, top: Column) -> Column:
    return F.greatest(F.lit(0), F.least(x.cast("int"), top))


def _ordered(box: Column) -> tuple[Column, Column, Column, Column]:
    return F.least(box.x1, box.x2), F.least(box.y1, box.y2), F.greatest(box.x1, box.x2), F.greatest(box.y1, box.y2)


def photo_box(box: Column, width: Column, height: Column) -> Column:
    """The whole line with wide margins, within the page; whole numbers."""
    x1, y1, x2, y2 = _ordered(box)
    w, h = x2 - x1, y2 - y1
    side, top, bottom = F.greatest(F.lit(10), F.floor(w / 6)), F.greatest(F.lit(20), 2 * h), F.greatest(F.lit(15), h)
    return F.struct(_clamp(x1 - side, width).alias("x1"), _clamp(y1 - top, height).alias("y1"), _clamp(x2 + side, width).alias("x2"), _clamp(y2 + bottom, height).alias("y2"))


def tight_boxes(met: DataFrame, width: int, height: int) -> DataFrame:
    """One box a clipped span over the words it touches, with a small margin."""
    w = met.withColumn("word", F.explode("words")).where((F.col("word.start") < F.col("to")) & (F.col("from") < F.col("word.end")))
    got = w.groupBy("page_id", "line_no", "entity", "from", "to").agg(F.min("word.box.x1").alias("x1"), F.min("word.box.y1").alias("y1"), F.max("word.box.x2").alias("x2"), F.max("word.box.y2").alias("y2"))
    pad = F.greatest(F.lit(3), F.floor((F.col("y2") - F.col("y1")) / 8))
    grown = [_clamp(F.col(c) + s * pad, F.lit(m)).alias(c) for c, s, m in (("x1", -1, width), ("y1", -1, height), ("x2", 1, width), ("y2", 1, height))]
    return got.select("page_id", "line_no", "entity", "from", "to", *grown)


def page_totals(pages: DataFrame) -> DataFrame:
    """Receipts of pages to receipts of files."""
    return pages.select("doc_id", F.explode("receipt").alias("entity", "n")).groupBy("doc_id", "entity").agg(F.sum("n").alias("places"))
