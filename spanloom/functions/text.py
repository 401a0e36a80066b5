"""Text expressions that keep offsets, and small normal forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spanloom.plans.catalogue import FORM_LABELS


def let(value: Column, f) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), lambda v: f(v)), 0)


_BLOB = "(?<=base64,)[A-Za-z0-9+/=]{100,}"


def mask_blobs(text: Column) -> Column:
    """Long base64 runs become zeros of the same length, so every offset stays."""
    runs = F.regexp_extract_all(text, F.lit(_BLOB), F.lit(0))
    gaps = F.split(text, _BLOB, -1)
    zeros = F.transform(runs, lambda x: F.repeat(F.lit("0"), F.char_length(x)))
    joined = F.array_join(F.flatten(F.zip_with(gaps, F.concat(zeros, F.array(F.lit(""))), lambda g, z: F.array(g, z))), "")
    return F.when(text.contains("base64,") & (F.size(runs) > 0), joined).otherwise(text)


def split_pincodes(text: Column) -> Column:
    """A hyphen before five or six digits becomes a blank."""
    return F.regexp_replace(text, r"-(?=\d{5,6}\b)", " ")


def plain(value: Column) -> Column:
    """Trimmed, lower case, blanks collapsed."""
    return F.regexp_replace(F.lower(F.trim(value)), r"\s+", " ")


def is_form_label(value: Column) -> Column:
    return plain(value).isin(FORM_LABELS)


def is_garbage(token: Column) -> Column:
    """Scanner noise: empty, too few letters, or a character four times in a row; numbers of three or more digits pass."""
    letters = F.char_length(F.regexp_replace(token, r"[^\p{L}]", ""))
    numeric = F.char_length(F.regexp_replace(token, "[^0-9]", "")) >= 3
    return (token == "") | (~numeric & ((letters / F.char_length(token) < 0.6) | token.rlike(r"(.)\1{3}")))
