"""Settling overlaps: in a row (arrays) and between rows (interval joins, gaps and islands)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.checks import pincode
from spanloom.functions.text import let
from spanloom.plans.config import Config


def overlap(a, b) -> Column:
    return (a.start < b.end) & (b.start < a.end)


def prefer_specific(spans: Column, config: Config) -> Column:
    """Spans of model entities that overlap one of a deterministic entity go; the others keep their order, deterministic ones first."""
    hard = [e.name for e in config.entities.values() if e.deterministic]
    firm = lambda all_: F.filter(all_, lambda s: s.entity.isin(hard))
    rest = lambda all_, f: F.filter(all_, lambda s: ~s.entity.isin(hard) & ~F.exists(f, lambda h: overlap(s, h)))
    return let(spans, lambda all_: let(firm(all_), lambda f: F.concat(f, rest(all_, f))))


def prefer_specific_rows(spans: DataFrame, hard: list[str], key: str = "doc_id") -> DataFrame:
    """The same on span rows: a left anti join on the key and the overlap."""
    firm, soft = spans.where(F.col("entity").isin(hard)), spans.where(~F.col("entity").isin(hard))
    a, b = soft.alias("a"), firm.alias("b")
    met = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end"))
    return firm.unionByName(a.join(b, met, "left_anti"))


def settle(spans: Column) -> Column:
    """Spans in order without overlaps, so that each character is replaced once.

    From left to right: a span inside what is taken goes; of spans with the same place the better scored stays;
    one that starts inside a taken span and ends after it loses the part that is taken, so no detected character
    survives.
    """
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("a"), (-s.end).alias("b"), (-s.score).alias("c"), s.entity.alias("d"), s.alias("s"))))

    def step(acc, x):
        s = x.s
        cut = F.struct(s.entity.alias("entity"), s.pattern.alias("pattern"), F.greatest(s.start, acc.at).alias("start"), s.end.alias("end"), s.score.alias("score"))
        return F.when(s.end <= acc.at, acc).otherwise(F.struct(s.end.alias("at"), F.concat(acc.out, F.array(cut)).alias("out")))

    from spanloom.operators.detect import empty

    return F.aggregate(keyed, F.struct(F.lit(0).alias("at"), empty().alias("out")), step, lambda acc: acc.out)


def islands(spans: DataFrame, key: str = "doc_id", gap: int | None = None) -> DataFrame:
    """Adds ``island``: spans that overlap in a chain share it; with a gap, also those at most so far apart."""
    order = Window.partitionBy(key).orderBy("start", F.col("end").desc())
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("start") >= reach if gap is None else F.col("start") > reach + gap
    return spans.withColumn("new__", F.coalesce(new, F.lit(True)).cast("int")).withColumn("island", F.sum("new__").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new__")


def places(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct places by entity: each island counts once, for its best scored entity (the first one on ties)."""
    at = F.struct("score", (-F.col("start")).alias("s"), F.col("end").alias("e"))
    named = islands(spans, key).groupBy(key, "island").agg(F.max_by("entity", at).alias("entity"))
    return named.groupBy(key, "entity").agg(F.count("*").alias("places"))


def places_in_row(spans: Column) -> Column:
    """The same as a map in the row, in the way of the long form."""
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s.start.alias("a"), (-s.end).alias("b"), s.entity.alias("entity"), s.score.alias("score"))))
    none = F.array().cast("array<struct<entity:string,score:double>>")

    def step(acc, x):
        top = F.struct(x.entity.alias("entity"), x.score.alias("score"))
        last = F.element_at(acc.out, -1)
        inside = (F.size(acc.out) > 0) & (x.a < acc.at)
        better = F.concat(F.slice(acc.out, 1, F.greatest(F.size(acc.out) - 1, F.lit(0))), F.array(F.when(x.score > last.score, top).otherwise(last)))
        return F.struct(F.greatest(acc.at, -x.b).alias("at"), F.when(inside, F.when(F.size(acc.out) > 0, better).otherwise(acc.out)).otherwise(F.concat(acc.out, F.array(top))).alias("out"))

    found = F.transform(F.aggregate(keyed, F.struct(F.lit(-1).alias("at"), none.alias("out")), step, lambda acc: acc.out), lambda x: x.entity)
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(found)), lambda e: F.struct(e, F.size(F.filter(found, lambda y: y == e)))))


#: Parts of an address that tell a specific place. Fixed values.
SPECIFIC = ["road", "locality", "sub_locality", "city", "state"]


def merge_addresses(parts: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Address parts ``(key, start, end, score, label)`` to ADDRESS spans.

    Parts at most three characters apart join. A group stays if a part labelled pincode holds a valid one, or
    it has both city and state, or three labels of which one is specific and scores 0.5 or more.
    """
    read = islands(parts, key, gap=3).join(texts.select(key, "text"), key)
    value = F.expr("substring(text, start + 1, end - start)")
    got = read.groupBy(key, "island").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max("score").alias("score"),
        F.collect_set("label").alias("labels"),
        F.bool_or((F.col("label") == "pincode") & pincode(value)).alias("pin"),
        F.bool_or(F.col("label").isin(SPECIFIC) & (F.col("score") >= 0.5)).alias("specific"),
    )
    both = F.array_contains("labels", "city") & F.array_contains("labels", "state")
    return got.where(F.col("pin") | both | ((F.size("labels") >= 3) & F.col("specific"))).select(key, F.lit("ADDRESS").alias("entity"), "start", "end", "score")


def merge_near(spans: DataFrame, key: str = "doc_id", gap: int = 3) -> DataFrame:
    return islands(spans, key, gap).groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def add_rescan(spans: DataFrame, more: DataFrame, key: str = "doc_id") -> DataFrame:
    """Spans plus those of a second scan that no span of the same entity contains."""
    a, b = more.alias("a"), spans.alias("b")
    inside = (F.col(f"a.{key}") == F.col(f"b.{key}")) & (F.col("a.entity") == F.col("b.entity")) & (F.col("b.start") <= F.col("a.start")) & (F.col("a.end") <= F.col("b.end"))
    return spans.unionByName(a.join(b, inside, "left_anti"))


#: Lines of this many characters are scanned again, alone, at this cut-off; only these entities may be added. Fixed values.
RESCAN_LENGTH, RESCAN_CUT, RESCANNED = 12, 0.31, ("PERSON", "ADDRESS")


def rescan(spans: DataFrame, lines: DataFrame, find, key: str = "page_id") -> DataFrame:
    """``add_rescan`` of what ``find`` sees in the lines (``key, line_no, text, at``) one by one.

    ``find(text, cut)`` is a column function to an array of spans; what it finds counts if three letters stand together in it.
    """
    wanted = lines.where(F.char_length(F.trim("text")) >= RESCAN_LENGTH)
    hit = wanted.select(key, "text", "at", F.explode(find(F.col("text"), RESCAN_CUT)).alias("s")).where(F.col("s.entity").isin(*RESCANNED) & (F.col("s.score") >= RESCAN_CUT))
    value = F.substring(F.col("text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start"))
    hit = hit.where(value.rlike(r"\p{L}{3}")).select(key, "s.entity", (F.col("s.start") + F.col("at")).alias("start"), (F.col("s.end") + F.col("at")).alias("end"), "s.score")
    return add_rescan(spans.select(key, "entity", "start", "end", "score"), hit, key)
