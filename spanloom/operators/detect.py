"""Detection: text to an array of spans, as one native column per context.

A span is ``struct<entity, pattern, start, end, score>`` with half-open code-point offsets. Offsets come from
the gaps between matches, so no Python and no UTF-16 positions are involved. A pattern's expression runs only
on rows that pass its guard: literals and digits without which it cannot match.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.checks import CHECKS
from spanloom.functions.text import is_form_label, let, mask_blobs
from spanloom.plans.catalogue import CHECKED, NEEDS, NO_DIGIT, PATTERNS, PHRASES
from spanloom.plans.config import Config, active

SPAN = "struct<entity:string,pattern:string,start:int,end:int,score:double>"
EPSILON = 1e-9
#: What a phrase before a finding adds, and the least that it then scores. Fixed values.
BOOST, LEAST_BOOSTED = 0.35, 0.4
_LABELLED = ("PERSON", "DOB", "ADDRESS", "CUSTOMER_ID")


class RedactionFailed(RuntimeError):
    pass


def empty() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def find_all(text: Column, regex: str, entity: str, pattern: str, score: float, check=None, flags: str = "(?iU)", guard: Column | None = None, phrases: Iterable[str] = ()) -> Column:
    """All leftmost matches as spans; ``check`` is a predicate on the matched text, ``guard`` what the text must be like for any match.

    A text without a match is searched once. Where one of ``phrases`` stands in the five words before a match, its
    score grows by ``BOOST``, to ``LEAST_BOOSTED`` at least.
    """
    rx = flags + regex

    def spans(hits):
        pairs = F.zip_with(hits, F.slice(F.split(text, rx, -1), 1, F.size(hits)), lambda h, g: F.struct(h.alias("h"), F.char_length(g).alias("g")))

        def step(s, x):
            start = s.at + x.g
            end = start + F.char_length(x.h)
            told = F.lit(float(score))
            if phrases:
                before = F.lower(F.regexp_extract(F.substring(text, F.greatest(start - 120, F.lit(0)) + 1, F.least(start, F.lit(120))), r"(?:\S+\s+){0,5}\S*$", 0))
                told = F.when(_holds(before, phrases), F.lit(float(min(1.0, max(score + BOOST, LEAST_BOOSTED))))).otherwise(told)
            span = F.struct(F.lit(entity).alias("entity"), F.lit(pattern).alias("pattern"), start.alias("start"), end.alias("end"), told.alias("score"))
            kept = F.concat(s.out, F.array(span))
            return F.struct(end.alias("at"), (F.when(check(x.h), kept).otherwise(s.out) if check else kept).alias("out"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty().alias("out")), step, lambda s: s.out)

    found = let(F.regexp_extract_all(text, F.lit(rx), F.lit(0)), lambda hits: F.when(F.size(hits) > 0, spans(hits)).otherwise(empty()))
    return found if guard is None else F.when(guard, found).otherwise(empty())


def _holds(text: Column, words: Iterable[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def _guard(entity: str, low: Column, digit: Column) -> Column | None:
    """Whether a text can hold a match of the entity's shipped patterns at all."""
    need = _holds(low, NEEDS[entity]) if entity in NEEDS else None
    if entity in NO_DIGIT:
        return need
    return digit if need is None else digit & need


def terms(text: Column, words: Iterable[str]) -> Column:
    """Given terms as PERSON spans of score 1.0: any blanks between words, any case; empty terms are skipped."""
    out = empty()
    for term in words:
        if parts := term.split():
            body = r"\s+".join(re.sub(r"([^\w\s])", r"\\\1", p) for p in parts)
            out = F.concat(out, find_all(text, body, "PERSON", "term", 1.0))
    return out


def drop_contained(spans: Column) -> Column:
    """Of one entity's spans, those inside another that scores no less go (of equal ones the first stays)."""
    beaten = lambda x, y: (x.s.entity == y.s.entity) & (y.i != x.i) & (y.s.start <= x.s.start) & (x.s.end <= y.s.end) & ((y.s.score > x.s.score) | ((y.s.score == x.s.score) & ((y.s.start != x.s.start) | (y.s.end != x.s.end) | (y.i < x.i))))
    kept = lambda at: F.transform(F.filter(at, lambda x: ~F.exists(at, lambda y: beaten(x, y))), lambda x: x.s)
    return let(F.transform(spans, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), kept)


def in_order(spans: Column) -> Column:
    """By start, then the longer one, then entity and pattern."""
    keyed = F.transform(spans, lambda s: F.struct(s.start.alias("a"), (-s.end).alias("b"), s.entity.alias("c"), s.pattern.alias("d"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda x: x.s)


def detect(text: Column, config: Config, context: str = "default", entities: list[str] | None = None, threshold: float | None = None, extra: Column | None = None) -> Column:
    """All spans of a context before overlaps are settled: patterns, checked patterns and ``extra`` spans (of models).

    Null text gives null. The cut-off is inclusive; an entity's own floor holds on top of it; spans of entities
    that are not declared go, and so do model spans whose value is a form's label.
    """
    rule = config.context(context)
    wanted = active(config, context, entities)
    cut = rule.threshold if threshold is None else threshold
    able = [(p.regex, p.entity, p.name, p.score, None) for p in config.patterns if p.entity in wanted]
    able += [(regex, entity, check or "format", score, CHECKS.get(check)) for entity, regex, score, check in config.checked if entity in wanted]
    shipped = {(e, rx) for e, _, rx, _ in PATTERNS} | {(e, rx) for e, rx, _, _ in CHECKED}

    def found(at):
        out = empty()
        for regex, entity, name, score, check in able:
            phrases = PHRASES.get(entity, ())
            if max(score, min(1.0, max(score + BOOST, LEAST_BOOSTED)) if phrases else score) < cut:
                continue
            guard = _guard(entity, at.low, at.digit) if (entity, regex) in shipped else None
            one = find_all(at.text, regex, entity, name, score, check, guard=guard, phrases=phrases)
            out = F.concat(out, F.filter(one, lambda s: s.score >= cut) if phrases else one)
        return out

    # folded as matching without case folds them
    read = lambda masked: F.struct(masked.alias("text"), F.lower(F.translate(masked, "\u017f\u0131\u0130", "sii")).alias("low"), masked.rlike(r"(?U)\d").alias("digit"))
    out = let(mask_blobs(text), lambda masked: let(read(masked), found))
    if extra is not None:
        known = [e for e in wanted if e in config.entities]
        value = lambda s: F.substring(text, s.start + 1, s.end - s.start)
        out = F.concat(out, F.filter(extra, lambda s: s.entity.isin([*known, "PERSON"]) & (s.score >= cut) & ~(s.entity.isin(*_LABELLED) & is_form_label(value(s)))))
    floors = {e: config.entities[e].min_score for e in wanted if config.entities[e].min_score}
    if floors:
        held = F.create_map(*[F.lit(x) for kv in floors.items() for x in kv])
        out = F.filter(out, lambda s: s.score >= F.coalesce(held[s.entity], F.lit(0.0)) - EPSILON)
    return F.when(text.isNotNull(), in_order(drop_contained(out)))


def rows(df: DataFrame, key: str, spans: str) -> DataFrame:
    """The long form: one row a span."""
    return df.select(key, F.explode(spans).alias("s")).select(key, "s.*")
