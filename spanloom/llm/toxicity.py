"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on windows of ordinary text, one on windows of toxic text that toxic
documents hold well beyond ordinary ones. A window is the text between two blanks, marks and all, cut after ``LONGEST``
bytes. Each is compressed against the ordinary dictionary and against both, so the difference of the two lengths is
what toxic text tells beyond ordinary text. How a window's length and its two compressed lengths split labelled toxic
from ordinary windows, measured on labelled documents that no dictionary saw, gives it a log likelihood ratio; a
document's ratios, by length and beyond fixed thresholds, go through a calibrated logistic curve.

Learning uses at most ``SAMPLE`` labelled ids (by their hash order) outside the held-out fold; two thirds of them make
the dictionaries, from about ``WINDOWS`` windows a side, spread over all of their documents, one third the curve.
Everything else covers all rows and whole texts.

Defined results: null or empty text gets the score of a text without windows; without labels of both kinds every
score is the share of toxic labels (0.0 without labels); equal texts get equal scores; an empty table gives no
rows; other input columns are ignored; of repeated labels the largest counts; of repeated documents with one id
each counts in learning as often as it is there.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import Recent, docs_of, fold, stash
from spanloom.llm.logistic import fit, sigmoid

#: Bounds of the labelled ids and, a side, of the windows that the dictionaries are trained on (at least one a document).
SAMPLE, WINDOWS = 20_000, 60_000
#: Bytes of the trained dictionaries: zstandard advises a hundredth of the training text at least.
TOXIC_BYTES, ORDINARY_BYTES, LEVEL, FOLDS = 16_384, 32_768, 6, 5
LONGEST = 64
#: Follows every window and is in both dictionaries: a block that matches anyway has paid its fixed cost, so
#: a match in the window itself shows, and the compressor looks for matches only up to eight bytes before the end.
_PAD = bytes(range(1, 33))


def windows(text: str) -> list[bytes]:
    """The whole text, but for its blanks."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    return [w[k : k + LONGEST] for w in words for k in range(0, len(w), LONGEST)]


def dictionary(samples: list[bytes], size: int) -> bytes:
    """What zstandard's trainer makes of the samples; too few of them serve as they are."""
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(samples)[-size:]


class Lengths:
    """A window's cell: its length and its compressed lengths without and with the toxic dictionary."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        make = lambda raw: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(_PAD + raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False)
        self.both, self.ordinary = make(toxic + ordinary).compress, make(ordinary).compress

    def cell(self, window: bytes) -> int:
        x = b" " + window + b" " + _PAD
        return (len(window) * 256 + len(self.ordinary(x))) * 256 + len(self.both(x))


def features(values: np.ndarray) -> list[float]:
    n = len(values) + 30
    return [float(values.sum()) / n, float(np.maximum(values - 0.5, 0).sum()) / n, float(np.maximum(values - 1, 0).sum()) / n, float(np.minimum(np.maximum(values - 1, 0).sum(), 20)), float(max(values.max(initial=0), 0))]


def _document_counts(batches):
    """Window, and in how many toxic and ordinary documents of a batch it is."""
    for batch in batches:
        held: dict[bytes, list[int]] = {}
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            for w in set(windows(text)):
                held.setdefault(w, [0, 0])[toxic] += 1
        yield pa.record_batch([pa.array(list(held), pa.binary()), pa.array([x[1] for x in held.values()], pa.int64()), pa.array([x[0] for x in held.values()], pa.int64())], names=["window", "toxic", "ordinary"])


def _samples(each: dict[int, int], telling: set[bytes]):
    """Windows to train on, ``each[side]`` a document at most: of ordinary documents any, of toxic ones the telling."""

    def run(batches):
        for batch in batches:
            sides, at, out = [], [], []
            for doc_id, text, toxic in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "text", "toxic")), strict=True):
                own = [w for w in windows(text) if not toxic or w in telling]
                step = max(1, -(-len(own) // each[toxic]))
                for k in range(0, len(own), step):
                    sides.append(toxic)
                    at.append(zlib.crc32(f"{doc_id} {k}".encode()))
                    out.append(own[k])
            yield pa.record_batch([pa.array(sides, pa.int32()), pa.array(at, pa.int64()), pa.array(out, pa.binary())], names=["toxic", "at", "window"])

    return run


class Model:
    def __init__(self, toxic: bytes, ordinary: bytes, ratios: dict[int, float], curve, share: float):
        self.toxic, self.ordinary, self.ratios, self.curve, self.share = toxic, ordinary, ratios, curve, share

    def scorer(self):
        lengths, ratios = Lengths(self.toxic, self.ordinary), self.ratios
        memo = Recent(lambda w: ratios.get(lengths.cell(w), 0.0), 1_000_000)
        return lambda text: features(np.array(list(map(memo.__getitem__, windows(text))), np.float64))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model | float:
    """The model, or a constant score where there is nothing to tell apart."""
    known = labels.where("toxic is not null and doc_id is not null").where(fold(F.col("doc_id"), FOLDS) != 0).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    seen = stash(docs_of(docs).join(F.broadcast(known), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(3))))  # at most `sample` ids are sent
    sides = {r.toxic: r.n for r in seen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(sides.values())
    share = sides.get(1, 0) / total if total else 0.0
    if len(sides) < 2:
        return share
    first = seen.where("part > 0")
    n = {r.toxic: r.n for r in first.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    nt, no = n.get(1, 0), n.get(0, 0)
    if not nt or not no:
        return share
    counts = first.select("text", "toxic").mapInArrow(_document_counts, "window binary, toxic bigint, ordinary bigint").groupBy("window").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))
    beyond = (F.col("toxic") >= 3) & (F.col("toxic") / nt > 4 * (F.col("ordinary") + 0.5) / no)
    # a window is in three toxic documents of a bounded sample at least; no more than the windows to train on can matter
    telling = {bytes(r.window) for r in counts.where(beyond).orderBy(F.col("toxic").desc(), "window").limit(WINDOWS).collect()}
    each = {0: max(1, WINDOWS // no), 1: max(1, WINDOWS // nt)}
    got = first.select("doc_id", "text", "toxic").mapInArrow(_samples(each, telling), "toxic int, at bigint, window binary").collect()  # `each` a document of the sample
    sides = ([], [])
    for r in sorted(got, key=lambda r: (r.at, bytes(r.window))):
        sides[r.toxic].append(bytes(r.window))
    toxic, ordinary = dictionary(sides[1], TOXIC_BYTES), dictionary(sides[0], ORDINARY_BYTES)

    def cells(batches):
        memo = Recent(Lengths(toxic, ordinary).cell, 500_000)
        for batch in batches:
            held: dict[tuple[int, int], int] = {}
            for text, kind in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                for c in map(memo.__getitem__, windows(text)):
                    held[c, kind] = held.get((c, kind), 0) + 1
            yield pa.record_batch([pa.array([k[0] for k in held], pa.int64()), pa.array([k[1] for k in held], pa.int64()), pa.array(list(held.values()), pa.int64())], names=["cell", "toxic", "n"])

    second = seen.where("part = 0").select("doc_id", "text", "toxic")
    table = second.select("text", "toxic").mapInArrow(cells, "cell bigint, toxic bigint, n bigint").groupBy("cell", "toxic").agg(F.sum("n").alias("n")).collect()  # cells are bounded by the longest window and what it compresses to
    each = ({}, {})
    for r in table:
        each[r.toxic][r.cell] = r.n
    n1, n0 = sum(each[1].values()) or 1, sum(each[0].values()) or 1
    low = 10 / n0
    ratios = {c: float(np.log((each[1].get(c, 0) / n1 + low) / (each[0].get(c, 0) / n0 + low))) for c in each[0].keys() | each[1].keys()}
    model = Model(toxic, ordinary, ratios, None, share)

    def rows(batches):
        score = model.scorer()
        for batch in batches:
            yield pa.record_batch([batch.column("toxic").cast(pa.int64()), pa.array([score(x) for x in batch.column("text").to_pylist()], pa.list_(pa.float64()))], names=["toxic", "x"])

    got = second.mapInArrow(rows, "toxic bigint, x array<double>").collect()
    y = np.array([r.toxic for r in got], np.float64)
    if not 0 < y.sum() < len(y):
        return share
    order = np.lexsort(np.array([r.x for r in got]).T)
    model.curve = fit(np.array([r.x for r in got])[order], y[order])
    return model


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    docs = docs_of(docs)
    model = train(docs, labels, sample)

    def run(batches):
        of = None if isinstance(model, float) else model.scorer()
        for batch in batches:
            if of is None:
                p = np.full(batch.num_rows, model)
            else:
                p = sigmoid(model.curve(np.array([of(x) for x in batch.column(1).to_pylist()], np.float64).reshape(-1, 5)))
            yield pa.record_batch([batch.column(0), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id bigint, score double, predicted int").select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "score", "predicted")
