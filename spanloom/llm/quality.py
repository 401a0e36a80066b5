"""Quality by co-training: a text view and a page-metadata view teach each other.

Each view has a logistic classifier. In every round each one scores every document outside the sample, and the ones
it is surest of, for either label, join the other's training rows with that label, beside those of earlier rounds; of
documents with equal features one joins. Their number grows with the corpus: a ``SHARE`` of it a round, view and label,
between ``EXCHANGE`` and ``POOL``. The two final logits are calibrated together on the labelled rows that neither view was
trained on (a fifth), and score all documents.

The labelled ids that are learned from are bounded by ``SAMPLE`` (by their hash order); candidates for the exchange
are all documents, and whole texts are read.

Defined results: null or empty text, and null source, language or length, have features of their own (zero or
"none"); without labels of both kinds every score is the share of good labels, or 1.0 without any label, so
nothing is rejected; of repeated labels the smallest counts, of repeated documents with a label one; equal rows get equal scores; an empty table gives
no rows; other input columns are ignored (a missing metadata column counts as null).
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import small, stash, unstash, without
from spanloom.llm.logistic import fit, sigmoid

SAMPLE, ROUNDS = 20_000, 3
#: Documents that a view gives the other a round and label: a share of all, at least and at most so many.
SHARE, EXCHANGE, POOL = 1 / 500, 200, 5_000
#: A pseudo-label counts as this part of a given one.
TRUST = 0.5
_TEXT, _SOURCES, _LANGS = 16, 32, 8
_META = _SOURCES + _LANGS + 2


def text_view(text: str) -> np.ndarray:
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    k = len(words)
    kinds: dict[bytes, int] = {}
    for w in words:
        kinds[w] = kinds.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    share = lambda part: float(np.log((part + 0.5) / (n + 50.0)))
    digits, upper = count[48:58].sum(), count[65:91].sum()
    calm = count[[39, 40, 41, 44, 45, 46, 58, 59, 63]].sum()
    marks = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum() - calm
    wordy = lambda part: float(np.log((part + 0.5) / (k + 5.0)))
    return np.array(
        [
            np.log1p(n),
            np.log1p(k),
            share(upper),
            share(digits),
            share(calm),
            share(marks),
            share(count[33]),
            share(count[124]),
            share(count[10]),
            share(count[128:].sum()),
            n / (k + 1.0) if k else 0.0,
            wordy(len(kinds)),
            wordy(same),
            wordy(max(kinds.values(), default=0)),
            float(upper > 0.5 * (count[97:123].sum() + upper + 1)),
            float(k == 0),
        ]
    )


def meta_view(source, lang, chars) -> np.ndarray:
    out = np.zeros(_META)
    out[zlib.crc32(str(source).encode()) % _SOURCES] = 1
    out[_SOURCES + zlib.crc32(str(lang).encode()) % _LANGS] = 1
    size = np.log1p(max(chars or 0, 0))
    out[-2:] = size, size * size
    return out


def _features(batches):
    for batch in small(batches):
        x = [np.concatenate([text_view(t or ""), meta_view(s, g, c)]) for t, s, g, c in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True)]
        yield pa.record_batch([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64).reshape(-1, _TEXT + _META)


def features(docs: DataFrame) -> DataFrame:
    has = set(docs.columns)
    meta = [(F.col(c) if c in has else F.lit(None)).cast(t).alias(c) for c, t in (("source", "string"), ("lang", "string"), ("n_chars", "bigint"))]
    return docs.select("doc_id", "text", *meta).mapInArrow(_features, "doc_id bigint, x array<double>")


def _sure(views, most: int):
    """Of a task's rows the surest of each view for each label; a global top-k follows."""

    def run(batches):
        held: list[dict] = [{} for _ in range(4)]  # by features, so that equal documents are one
        for batch in batches:
            x, ids = _matrix(batch.column("x")), batch.column("doc_id").to_pylist()
            order = np.array([-1 if i is None else i for i in ids])
            for v, part in enumerate((x[:, :_TEXT], x[:, _TEXT:])):
                logit = views[v](part)
                for label in (0, 1):
                    lean, kept = logit if label else -logit, held[2 * v + label]
                    for i in np.lexsort((order, -lean))[: 4 * most]:
                        kept.setdefault(x[i].tobytes(), (float(lean[i]), ids[i]))
                    if len(kept) > most:
                        held[2 * v + label] = dict(sorted(kept.items(), key=lambda r: (-r[1][0], r[0]))[:most])
        rows = [(k, *r, key) for k, kept in enumerate(held) for key, r in kept.items()]
        if rows:
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.float64()), pa.array([np.frombuffer(r[3]) for r in rows], pa.list_(pa.float64()))], names=["kind", "lean", "x"])

    return run


def train(feats: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, exchange: int = EXCHANGE):
    """The two views and their joint calibration, or a constant where labels tell nothing apart."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # at most `sample` ids are sent, and so many rows come back
    got = feats.join(F.broadcast(known), "doc_id").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(5)) == 0).toArrow()
    y, apart = np.array(got.column("quality").to_pylist(), np.float64), np.array(got.column("apart").to_pylist(), bool)
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 1.0
    x = _matrix(got.column("x"))
    order = np.lexsort(np.column_stack([x, y]).T)
    x, y, apart = x[order], y[order], apart[order]
    if not (0 < y[apart].sum() < apart.sum() and 0 < y[~apart].sum() < (~apart).sum()):
        apart = np.zeros(len(y), bool)  # too few to keep some apart
    seen, last = ~apart, apart if apart.any() else ~apart
    most = max(exchange, min(POOL, int(SHARE * feats.count())))
    rest = feats.join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti")

    def taught(pools):
        views = []
        for v, part in enumerate((slice(0, _TEXT), slice(_TEXT, None))):
            more = np.array([np.frombuffer(k) for k in pools[v]]).reshape(-1, _TEXT + _META)[:, part]
            views.append(fit(np.vstack([x[seen][:, part], more]), np.concatenate([y[seen], list(pools[v].values())]), weight=np.concatenate([np.ones(seen.sum()), np.full(len(more), TRUST)])))
        return views

    pools: list[dict[bytes, int]] = [{}, {}]  # features to label, told by the other view
    views = taught(pools)
    for _ in range(rounds):
        sure = stash(rest.mapInArrow(_sure(views, most), "kind int, lean double, x array<double>").groupBy("kind", "x").agg(F.max("lean").alias("lean")))
        for v in (0, 1):
            for label in (0, 1):
                for r in sure.where(F.col("kind") == 2 * v + label).orderBy(F.col("lean").desc(), "x").limit(most).collect():
                    pools[1 - v][np.array(r.x, np.float64).tobytes()] = label
        unstash(sure)
        views = taught([dict(sorted(p.items())) for p in pools])
    joint = fit(np.column_stack([views[0](x[last][:, :_TEXT]), views[1](x[last][:, _TEXT:])]), y[last])
    return views[0], views[1], joint


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = ROUNDS, exchange: int = EXCHANGE) -> DataFrame:
    """``doc_id, score, text_score, meta_score, predicted`` of every row; score is P(quality = 1)."""
    feats = stash(features(docs))
    model = train(feats, labels, sample, rounds, exchange)

    def run(batches):
        for batch in batches:
            if isinstance(model, float):
                a = b = p = np.full(batch.num_rows, model)
            else:
                x = _matrix(batch.column("x"))
                a, b = model[0](x[:, :_TEXT]), model[1](x[:, _TEXT:])
                a, b, p = sigmoid(a), sigmoid(b), sigmoid(model[2](np.column_stack([a, b])))
            yield pa.record_batch([batch.column("doc_id"), pa.array(p), pa.array(a), pa.array(b), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "text_score", "meta_score", "predicted"])

    return feats.mapInArrow(run, "doc_id bigint, score double, text_score double, meta_score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents, all columns, without those scored under ``least``. Ids scored both ways (repeated ids) stay."""
    scored = score(docs, labels).where("doc_id is not null").groupBy("doc_id").agg(F.max("score").alias("top"))
    return without(docs, stash(scored.where(F.col("top") < least).select("doc_id")))
