"""Evaluation of spans against labelled ones: greedy matching in reading order, counts, metrics, kill rule, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.resolve import overlap


class EvalError(ValueError):
    pass


def match(gold: Column, found: Column) -> Column:
    """``array<struct<entity, outcome, start, end>>``: each gold span takes the first unused found one of its entity that overlaps."""
    goal = F.array_sort(F.transform(gold, lambda g: F.struct(g.start.alias("start"), g.end.alias("end"), g.entity.alias("entity"))))
    have = F.transform(found, lambda f, i: F.struct(f.start.alias("start"), f.end.alias("end"), f.entity.alias("entity"), i.alias("i")))
    entry = lambda s, outcome: F.struct(s.entity.alias("entity"), F.lit(outcome).alias("outcome"), s.start.alias("start"), s.end.alias("end"))

    def step(acc, g):
        hit = F.get(F.filter(have, lambda f: (f.entity == g.entity) & overlap(g, f) & ~F.array_contains(acc.used, f.i)), 0)
        return F.struct(F.when(hit.isNull(), acc.used).otherwise(F.concat(acc.used, F.array(hit.i))).alias("used"), F.concat(acc.out, F.array(F.when(hit.isNull(), entry(g, "fn")).otherwise(entry(g, "tp")))).alias("out"))

    start = F.struct(F.array().cast("array<int>").alias("used"), F.array().cast("array<struct<entity:string,outcome:string,start:int,end:int>>").alias("out"))
    finish = lambda acc: F.concat(acc.out, F.transform(F.filter(have, lambda f: ~F.array_contains(acc.used, f.i)), lambda f: entry(f, "fp")))
    return F.aggregate(goal, start, step, finish)


def metrics(outcomes: DataFrame) -> DataFrame:
    """Rows ``entity, outcome`` to counts, precision, recall and F1 by entity and overall (entity ``ALL``), to three places, half to even."""
    n = lambda o: F.count_if(F.col("outcome") == o).alias(o)
    got = outcomes.rollup("entity").agg(n("tp"), n("fp"), n("fn"), F.grouping("entity").alias("all__"))
    got = got.select(F.when(F.col("all__") == 1, "ALL").otherwise(F.col("entity")).alias("entity"), "tp", "fp", "fn")
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), b.cast("double")), F.lit(0.0))
    p, r = share("tp", F.col("tp") + F.col("fp")), share("tp", F.col("tp") + F.col("fn"))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    return got.select("entity", "tp", "fp", "fn", *(F.bround(x, 3).alias(name) for x, name in ((p, "precision"), (r, "recall"), (f1, "f1"))))


def score(examples: DataFrame, gold: str = "gold", found: str = "found") -> DataFrame:
    return metrics(examples.select(F.explode(match(F.col(gold), F.col(found))).alias("m")).select("m.entity", "m.outcome"))


def kill_rule(baseline: DataFrame, full: DataFrame, needed: float = 0.10) -> DataFrame:
    """Whether the model layer earns its place: KEEP if overall recall grows by ``needed``."""
    a, b = (m.where("entity = 'ALL'").select(F.col("recall").alias(n)) for m, n in ((baseline, "before"), (full, "after")))
    gain = F.bround(F.col("after") - F.col("before"), 3)
    return a.crossJoin(F.broadcast(b)).select("before", "after", gain.alias("gain"), F.when(gain >= needed, "KEEP").otherwise("REMOVE").alias("verdict"))  # one row each


def misses(examples: DataFrame, gold: str = "gold", found: str = "found", outcome: str = "fn") -> DataFrame:
    """Where and how long, never what: no value is shown."""
    m = examples.select("source", F.explode(match(F.col(gold), F.col(found))).alias("m")).where(F.col("m.outcome") == outcome)
    return m.select("source", "m.entity", "m.start", (F.col("m.end") - F.col("m.start")).alias("length"))


def report(examples: DataFrame, most: int = 100) -> str:
    """Markdown from the aggregates: metrics, misses, and at most ``most`` false alarms (a report's limit)."""
    rows = sorted(score(examples).collect(), key=lambda r: (r.entity == "ALL", r.entity))
    out = ["| entity | tp | fp | fn | precision | recall | F1 |", "|-|-:|-:|-:|-:|-:|-:|"]
    out += [f"| {r.entity} | {r.tp} | {r.fp} | {r.fn} | {r.precision:.3f} | {r.recall:.3f} | {r.f1:.3f} |" for r in rows]
    for title, outcome in (("Missed", "fn"), ("False alarms", "fp")):
        got = misses(examples, outcome=outcome).orderBy("source", "start").limit(most).collect()
        out += ["", f"## {title}", *(f"- {r.source}: {r.entity}, {r.length} characters" for r in got)]
    return "\n".join(out) + "\n"


def label_stats(examples: DataFrame) -> DataFrame:
    """Labels by entity, and how many examples have some or none."""
    some = F.size("spans") > 0
    by = examples.select(F.explode("spans").alias("s")).groupBy(F.col("s.entity").alias("entity")).agg(F.count("*").alias("n"))
    sides = examples.agg(F.count_if(some).alias("positive"), F.count_if(~some).alias("negative"))
    return by.unionByName(sides.select(F.lit("POSITIVE").alias("entity"), F.col("positive").alias("n"))).unionByName(sides.select(F.lit("NEGATIVE").alias("entity"), F.col("negative").alias("n")))
