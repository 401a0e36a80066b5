"""Only my data: which findings match a person's own details. The details travel in a broadcast row, never in literals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions.checks import digits
from spanloom.functions.text import plain

FIELDS = ("names", "emails", "phones", "addresses", "ids")
#: entity: field. Fixed values; other entities always count as mine.
FIELD_OF = {"PERSON": "names", "EMAIL": "emails", "PHONE": "phones", "IN_PHONE": "phones", "ADDRESS": "addresses"} | {
    e: "ids" for e in ("IN_PAN", "IN_AADHAAR", "IN_GSTIN", "IN_VOTER", "IN_PASSPORT", "IN_DRIVING_LICENCE", "IN_VEHICLE_REGISTRATION", "IN_UPI", "IN_IFSC", "US_SSN", "US_ITIN", "US_PASSPORT", "US_DRIVER_LICENSE", "US_BANK_NUMBER", "IBAN_CODE", "CREDIT_CARD")
}


def load(path: str) -> dict[str, list[str]]:
    """The details that a YAML file on the driver holds; absent fields are empty."""
    import yaml

    with open(path, encoding="utf-8") as f:
        said = yaml.safe_load(f) or {}
    return {x: list(said.get(x) or []) for x in FIELDS}


def frame(spark: SparkSession, identity: dict[str, list[str]]) -> DataFrame:
    """A single row; absent fields are empty."""
    row = [[list(identity.get(f) or []) for f in FIELDS]]
    return spark.createDataFrame(row, ", ".join(f"{f} array<string>" for f in FIELDS))


def _either(found: Column, own: Column, form) -> Column:
    f = form(found)
    return F.exists(own, lambda v: (form(v) != "") & (f != "") & (f.contains(form(v)) | form(v).contains(f)))


def is_mine(entity: Column, value: Column, me: Column) -> Column:
    """Names without dots and addresses: either holds the other; phones: the last ten digits; ids: all digits, or
    either holds the other without separators; emails: equal. An entity without a field is mine; an empty field matches nothing."""
    dots = lambda c: plain(F.regexp_replace(c, r"\.", ""))
    bare = lambda c: plain(F.regexp_replace(c, "[ -]", ""))
    tail = lambda c, n: F.right(digits(c), F.lit(n))
    ways = {
        "names": _either(value, me.names, dots),
        "addresses": _either(value, me.addresses, plain),
        "emails": F.exists(me.emails, lambda v: plain(v) == plain(value)),
        "phones": F.exists(me.phones, lambda v: (tail(v, 10) == tail(value, 10)) & (tail(v, 10) != "")),
        "ids": F.exists(me.ids, lambda v: (digits(v) != "") & (tail(v, 32) == tail(value, 32))) | _either(value, me.ids, bare),
    }
    out = F.lit(True)
    for name, way in ways.items():
        out = F.when(entity.isin([e for e, f in FIELD_OF.items() if f == name]), F.coalesce(way, F.lit(False))).otherwise(out)
    return out


def filter_mine(spans: Column, text: Column, me: Column) -> Column:
    return F.filter(spans, lambda s: is_mine(s.entity, F.substring(text, s.start + 1, s.end - s.start), me))


def with_identity(df: DataFrame, identity: dict[str, list[str]]) -> DataFrame:
    """df with the column ``me``; one row is sent."""
    return df.crossJoin(F.broadcast(frame(df.sparkSession, identity).select(F.struct(*FIELDS).alias("me"))))
