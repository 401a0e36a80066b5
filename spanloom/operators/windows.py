"""Windows of long texts for model detectors, and the seam where such detectors plug in."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import accumulate
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.detect import SPAN


def budget(max_len: int, labels: int) -> int:
    """Tokens left for text beside the labels and a margin."""
    return max_len - (2 * labels + 1) - 32


def token_windows(n: Column, size: int, overlap: int = 48) -> Column:
    """``array<struct<first, last>>`` (0-based, last exclusive) of windows that cover n tokens."""
    if size <= overlap:
        raise ValueError("a window must be longer than the overlap")
    starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap)), lambda s: (s == 0) | (s + overlap < n))
    return F.when(n > 0, F.transform(starts, lambda s: F.struct(s.alias("first"), F.least(s + size, n).alias("last")))).otherwise(F.array().cast("array<struct<first:int,last:int>>"))


def line_chunks(text: str, goal: int = 200, hard: int = 800) -> list[tuple[str, int]]:
    """(chunk, offset): whole lines until ``goal`` characters are reached, the last line again in the next chunk; a line over ``hard`` stands alone, cut."""
    lines = text.split("\n")
    at = [0, *accumulate(len(x) + 1 for x in lines)]
    out, first = [], 0
    while first < len(lines):
        if len(lines[first]) > hard:
            out += [(lines[first][k : k + hard], at[first] + k) for k in range(0, len(lines[first]), hard)]
            first += 1
            continue
        end = next((k for k in range(first + 1, len(lines)) if len(lines[k]) > hard or at[k] - at[first] >= goal), len(lines))
        out.append((text[at[first] : at[end] - 1], at[first]))
        first = len(lines) if end == len(lines) else max(first + 1, end - 1)
    return out


def chunked(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, chunk, start`` rows."""

    @F.pandas_udf("array<struct<chunk:string,start:int>>")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda t: [{"chunk": c, "start": a} for c, a in line_chunks(t or "")])

    return df.select(key, F.explode(run(text)).alias("w")).select(key, "w.chunk", "w.start")


class Detector(Protocol):
    """A model: built once a worker, given texts, gives (entity, start, end, score) lists."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]: ...


def model_spans(build: Callable[[], Detector], name: str):
    """A column function text -> spans for a model that ``build`` makes. An error in the model fails the task."""

    @F.pandas_udf(f"array<{SPAN}>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = build()
        for batch in batches:
            found = model([t or "" for t in batch])
            yield pd.Series([[{"entity": e, "pattern": name, "start": a, "end": b, "score": s} for e, a, b, s in row] for row in found])

    return run


def best_of_windows(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hits ``key, start (of the window), entity, from, to, score`` to spans of the text, each once at its best score."""
    at = hits.select(key, "entity", (F.col("start") + F.col("from")).alias("start"), (F.col("start") + F.col("to")).alias("end"), "score")
    return at.groupBy(key, "entity", "start", "end").agg(F.max("score").alias("score"))
