"""Replacement: text and spans to text, without any state between rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.text import let
from spanloom.operators.detect import RedactionFailed, detect
from spanloom.operators.resolve import places_in_row, prefer_specific, settle
from spanloom.plans.config import STRATEGIES, Config


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def labels(config: Config) -> dict[str, str]:
    return {e.name: f"[{e.replacement}]" if e.replacement else f"<{e.name}>" for e in config.entities.values()} | {"PERSON": "<PERSON>"}


def bases(config: Config) -> dict[str, str]:
    """The part of a numbered placeholder before its number."""
    return {e.name: e.replacement or e.name for e in config.entities.values()} | {"PERSON": "PERSON"}


def values(text: Column, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s.entity.alias("entity"), F.substring(text, s.start + 1, s.end - s.start).alias("value")))


def put(text: Column, spans: Column, new: Column) -> Column:
    """The text with span k replaced by new[k]; spans are in order and apart."""
    pairs = F.zip_with(spans, new, lambda s, n: F.struct(s.start.alias("a"), s.end.alias("b"), n.alias("n")))
    step = lambda acc, x: F.struct(x.b.alias("at"), F.concat(acc.out, F.array(F.substring(text, acc.at + 1, x.a - acc.at), x.n)).alias("out"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(pairs, none, step, lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, acc.at + 1, F.char_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def numbered(text: Column, spans: Column, config: Config) -> Column:
    """[BASE_n]: n counts an entity's distinct values in reading order."""
    base = _map(bases(config))

    def one(v, distinct):
        own = F.filter(distinct, lambda d: d.entity == v.entity)
        return F.concat(F.lit("["), F.coalesce(base[v.entity], v.entity), F.lit("_"), F.array_position(own, v).cast("string"), F.lit("]"))

    return let(values(text, spans), lambda named: let(F.array_distinct(named), lambda distinct: F.transform(named, lambda v: one(v, distinct))))


def labelled(text: Column, spans: Column, config: Config) -> Column:
    told = _map(labels(config))
    return F.transform(spans, lambda s: F.coalesce(told[s.entity], F.concat(F.lit("<"), s.entity, F.lit(">"))))


def masked(text: Column, spans: Column) -> Column:
    """Stars over the whole value, also beyond 100 characters (a shorter mask would leave a readable tail)."""
    return F.transform(spans, lambda s: F.repeat(F.lit("*"), s.end - s.start))


def pads(df: DataFrame, salt: str | None) -> DataFrame:
    """One row ``inner, outer``: the keyed hash's padded keys. The salt travels as data, so no plan text shows it."""
    if not salt:
        raise RedactionFailed("the hash strategy needs a salt")
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    row = [tuple(bytearray(x ^ pad for x in key) for pad in (0x36, 0x5C))]
    return df.sparkSession.createDataFrame(row, "inner__ binary, outer__ binary")


def hashed(text: Column, spans: Column, inner: Column, outer: Column) -> Column:
    """[ENTITY_digest]: 12 hex digits of the keyed sha256 of the value (HMAC), from the two padded keys."""
    digest = lambda v: F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(v, "UTF-8")), 256))), 256)
    return F.transform(values(text, spans), lambda v: F.concat(F.lit("["), v.entity, F.lit("_"), F.left(digest(v.value), F.lit(12)), F.lit("]")))


#: name: (text, spans, config) to an array of new values, one a span.
_OWN: dict[str, Callable[[Column, Column, Config], Column]] = {"consistent": lambda t, s, c: numbered(t, s, c), "label": lambda t, s, c: labelled(t, s, c), "mask": lambda t, s, c: masked(t, s)}


def register(name: str, new: Callable[[Column, Column, Config], Column]) -> None:
    """A strategy of one's own: contexts may name it from here on. ``new`` gives an array of strings, one a span."""
    if name in ("hash", "consistent", "label", "mask"):
        raise ValueError(f"{name} is a shipped strategy")
    _OWN[name] = new
    STRATEGIES.add(name)


def anonymize(text: Column, spans: Column, config: Config, strategy: str, keys: tuple[Column, Column] | None = None) -> Column:
    """The text with all spans replaced; spans must be settled. Null text stays null. ``keys`` are the hash strategy's."""
    if strategy == "hash":
        if keys is None:
            raise RedactionFailed("the hash strategy needs a salt")
        return put(text, spans, hashed(text, spans, *keys))
    if strategy not in _OWN:
        raise RedactionFailed(f"unknown strategy {strategy!r}")
    return put(text, spans, _OWN[strategy](text, spans, config))


def redact(df: DataFrame, config: Config, context: str = "default", text: str = "text", entities: list[str] | None = None, strategy: str | None = None, salt: str | None = None, extra: Column | None = None, keep=None) -> DataFrame:
    """df with ``spans`` (settled), ``redacted`` and ``receipt`` (distinct places by entity); columns of df that have
    one of these names are replaced.

    ``keep`` is a function of the spans column, such as an identity filter. A failing detector fails the task, so
    nothing half redacted is published. The same works on a streaming DataFrame.
    """
    how, names = strategy or config.context(context).strategy, [*df.columns, *(c for c in ("spans", "receipt", "redacted") if c not in df.columns)]
    found = prefer_specific(detect(F.col(text), config, context, entities, extra=extra), config)
    out, keys = df, None
    if how == "hash":
        out, keys = df.crossJoin(F.broadcast(pads(df, salt))), (F.col("inner__"), F.col("outer__"))  # one row
    out = out.withColumn("found__", keep(found) if keep else found)
    out = out.withColumn("spans", settle(F.col("found__"))).withColumn("receipt", places_in_row(F.col("found__")))
    return out.withColumn("redacted", anonymize(F.col(text), F.col("spans"), config, how, keys)).select(*names)


def quarantine(df: DataFrame, config: Config, context: str = "default", text: str = "text") -> DataFrame:
    """Like redact, for inputs that may hold broken rows: a row whose text is null or not valid UTF-8 (binary input)
    gets an ``error`` and a null ``redacted``, never its raw text."""
    kind = dict(df.dtypes)[text]
    good = F.call_function("try_validate_utf8", F.col(text)) if kind == "binary" else F.col(text)
    read = df.withColumn("clean__", good.cast("string"))
    done = redact(read, config, context, "clean__")
    return done.withColumn("error", F.when(F.col("clean__").isNull(), "the text cannot be read")).drop("clean__", text)
