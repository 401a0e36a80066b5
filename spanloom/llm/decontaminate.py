"""Benchmark decontamination by the q-gram lemma.

Two strings of length m within k edits share at least m - q + 1 - k*q of the first one's q-grams, on
diagonals that differ by k at most. All q-grams of a document that some item holds are counted by item and
overlapping diagonal band; bands that reach the bound are kept and verified by banded alignment. k is
``RATE`` of the item's length. q is ``Q``, and ``SMALL_Q`` for items that ``Q`` would leave without a bound; items without any
bound are searched for exactly. Texts are compared as UTF-8 bytes with A-Z lowered and every ASCII blank as a space.

A benchmark of at most ``BLOCK`` bytes is sent to the tasks and meets the documents in one pass. A larger one stays a
table: documents tell their q-grams that pass a fixed bitmap of the benchmark's, those are joined with the items'
q-grams and counted by document, item and band, and only the bands that reach the bound fetch the two texts. Both
ways verify alike and give the same rows.

Defined results: null or empty texts and items match nothing; equal items count once; repeated rows each
match; rows with a null ``doc_id`` are reported with it; an empty table on either side gives no rows; other input
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import docs_of, small, stash, without

Q, SMALL_Q, RATE, BLOCK = 8, 4, 0.08, 8 << 20
_BITS = 22
_BLANKS = bytes.maketrans(b"\t\n\r\x0b\x0c", b"     ")
_SCHEMA = "doc_id bigint, item_id bigint, start bigint, stop bigint, edits int"


def norm(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower().translate(_BLANKS)


def grams(raw: np.ndarray, q: int = Q) -> np.ndarray:
    n = len(raw) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    rows = np.lib.stride_tricks.sliding_window_view(raw, q)
    if q == 8:
        return rows.copy().view(">u8").reshape(-1).astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(q):
        out = out << np.uint64(8) | rows[:, k]
    return out


def slots(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)


def budget(m: int, rate: float = RATE) -> tuple[int, int, int]:
    """Edits allowed for an item of m bytes, the q to look for it by, and the shared q-grams that the edits leave; q is 0 where it is searched for exactly."""
    k = int(m * rate)
    for q in (Q, SMALL_Q):
        if m - q + 1 - k * q > 0:
            return k, q, m - q + 1 - k * q
    return 0, 0, 0


def align(item: bytes, text: bytes, k: int):
    """Fewest edits between the item and any part of text within the band, with that part: (edits, start, stop) or None."""
    a, m, n = np.frombuffer(item, np.uint8), len(item), len(text)
    width = n - m + 2 * k + 1  # diagonals from -k to n - m + k: start free on the text's side
    if width <= 0:
        return None
    big = 1 << 20
    b = np.full(n + 2 * k + width + m + 1, 256, np.int16)
    b[k : k + n] = np.frombuffer(text, np.uint8)
    j = np.arange(width)
    row = np.where((j >= k) & (j <= k + n), 0, big).astype(np.int64)  # cell j of row i is text offset i + j - k
    begin = np.clip(j - k, 0, n)
    for i in range(1, m + 1):
        cost = (b[i - 1 + j] != a[i - 1]).astype(np.int64)
        diag = row + cost
        up = np.append(row[1:] + 1, big)
        take = up < diag
        new = np.where(take, up, diag)
        start = np.where(take, np.append(begin[1:], 0), begin)
        outside = (i + j - k < 0) | (i + j - k > n)
        new[outside] = big
        run = np.minimum.accumulate(new - j)  # gaps on the item's side
        better = run + j < new
        if better.any():
            source = np.maximum.accumulate(np.where(new - j == run, j, 0))
            start = np.where(better, start[source], start)
            new = np.minimum(new, run + j)
            new[outside] = big
        row, begin = new, start
    best = int(np.argmin(row))
    if row[best] > k:
        return None
    return int(row[best]), int(begin[best]), m + best - k


def _hits(key: int, item_id, raw: bytes, k: int, text: bytes):
    """The best place of an item in the part of text that a band (number * 2 + shift) covers."""
    band, shift = key >> 1, key & 1
    low = band * 2 * (k + 1) - shift * (k + 1)
    start = max(0, low - k)
    part = text[start : low + 2 * (k + 1) + len(raw) + k]
    exact = part.find(raw)
    got = (0, exact, exact + len(raw)) if exact >= 0 else align(raw, part, k) if k else None
    return (item_id, start + got[1], start + got[2], got[0]) if got else None


def bands(diagonal: np.ndarray, k: np.ndarray):
    """The two overlapping bands of 2(k+1) diagonals that a diagonal is in; any k+1 neighbouring diagonals lie in one of them."""
    for shift in (0, 1):
        yield (diagonal + shift * (k + 1)) // (2 * (k + 1)) * 2 + shift


def best_of(hits: list[tuple]) -> list[tuple]:
    """Of the overlapping hits of an item the best, in order."""
    best: list[tuple] = []
    for x in sorted(set(hits), key=lambda x: (x[3], x[1], x[2])):
        if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in best):
            best.append(x)
    return sorted(best, key=lambda x: (x[1], x[2], x[0]))


_ZERO = 1 << 32


class Items:
    """A block of the benchmark, indexed by q-gram."""

    def __init__(self, rows: list[tuple[int, str]], rate: float = RATE):
        self.ids, self.raw, self.k, self.least, self.exact, made = [], [], [], [], [], {Q: [], SMALL_Q: []}
        for item_id, text in rows:
            raw = norm(text or "").strip()
            if not raw:
                continue
            k, q, left = budget(len(raw), rate)
            if not q:
                self.exact.append((item_id, raw))
                continue
            made[q].append((len(self.ids), grams(np.frombuffer(raw, np.uint8), q)))
            self.ids.append(item_id)
            self.raw.append(raw)
            self.k.append(k)
            self.least.append(left)
        self.kk, self.ll = np.array(self.k, np.int64), np.array(self.least, np.int64)
        self.index = []
        for q, found in made.items():
            if found:
                codes = np.concatenate([g for _, g in found])
                order = np.argsort(codes, kind="stable")
                owner, place = np.concatenate([np.full(len(g), i) for i, g in found]), np.concatenate([np.arange(len(g)) for _, g in found])
                mark = np.zeros(1 << _BITS, bool)
                mark[slots(codes)] = True
                self.index.append((q, codes[order], owner[order], place[order], mark, min(self.least[i] for i, _ in found)))

    def find(self, text: bytes) -> list[tuple]:
        """Hits ``(item_id, start, stop, edits)`` in bytes; of the overlapping ones of an item the best."""
        out = []
        for item_id, raw in self.exact:
            at = text.find(raw)
            while at >= 0:
                out.append((item_id, at, at + len(raw), 0))
                at = text.find(raw, at + len(raw))
        for q, codes, owner, place, mark, lowest in self.index:
            here = grams(np.frombuffer(text, np.uint8), q)
            spots = np.flatnonzero(mark[slots(here)])
            if len(spots) < lowest:
                continue
            a = np.searchsorted(codes, here[spots], "left")
            n = np.searchsorted(codes, here[spots], "right") - a
            spots, a, n = spots[n > 0], a[n > 0], n[n > 0]
            if int(n.sum()) < lowest:
                continue
            into = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            hit = np.repeat(a, n) + into
            item = owner[hit]
            for band in bands(np.repeat(spots, n) - place[hit], self.kk[item]):
                keys, counts = np.unique(item << 40 | (band + _ZERO), return_counts=True)
                for key in keys[counts >= self.ll[keys >> 40]].tolist():
                    i = key >> 40
                    got = _hits((key & ((1 << 40) - 1)) - _ZERO, self.ids[i], self.raw[i], self.k[i], text)
                    if got:
                        out.append(got)
        return best_of(out)


def _search(block: list[tuple[int, str]], rate: float):
    def run(batches):
        items = Items(block, rate)
        for batch in small(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = norm(text)
                rows += [(doc_id, *_in_points(raw, hit)) for hit in items.find(raw)]
            if rows:
                yield pa.record_batch([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "start", "stop", "edits"])

    return run


_ITEM = "item_id bigint, raw binary, k int, q int, least int"


def _items(rate: float):
    """Items in their normal form with their budgets, as rows."""

    def run(batches):
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = norm(text).strip()
                if raw:
                    rows.append((item_id, raw, *budget(len(raw), rate)))
            yield pa.record_batch([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int32()))], names=["item_id", "raw", "k", "q", "least"])

    return run


def _item_grams(batches):
    for batch in batches:
        for item, raw, q in zip(*(batch.column(c).to_pylist() for c in ("item", "raw", "q")), strict=True):
            # items without a bound go by their first bytes: a document that holds them holds those
            code = grams(np.frombuffer(raw, np.uint8), q) if q else grams(np.frombuffer(raw, np.uint8), min(len(raw), SMALL_Q))[:1]
            n, by = len(code), q or min(len(raw), SMALL_Q)
            yield pa.record_batch([pa.array(np.full(n, item)), pa.array(code.view(np.int64)), pa.array(np.full(n, by, np.int32)), pa.array(np.arange(n))], names=["item", "code", "by", "place"])


def _held_grams(marks):
    """A document's q-grams that pass the benchmark's bitmaps."""

    def run(batches):
        mark = marks.value
        for batch in small(batches):
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = np.frombuffer(norm(text), np.uint8)
                for by, bits in mark.items():
                    code = grams(raw, by)
                    spots = np.flatnonzero(bits[slots(code)])
                    if len(spots):
                        yield pa.record_batch([pa.array(np.full(len(spots), rid)), pa.array(code[spots].view(np.int64)), pa.array(np.full(len(spots), by, np.int32)), pa.array(spots.astype(np.int64))], names=["rid", "code", "by", "at"])

    return run


def _marks(codes: DataFrame) -> dict[int, np.ndarray]:
    """A bitmap of ``1 << _BITS`` slots for each q: a fixed size, whatever the benchmark."""

    def run(batches):
        out: dict[int, np.ndarray] = {}
        for batch in batches:
            by, code = batch.column("by").to_numpy(), batch.column("code").to_numpy().view(np.uint64)
            for q in np.unique(by).tolist():
                out.setdefault(q, np.zeros(1 << _BITS, bool))[slots(code[by == q])] = True
        if out:
            yield pa.record_batch([pa.array(list(out), pa.int32()), pa.array([zlib.compress(np.packbits(x).tobytes(), 1) for x in out.values()], pa.binary())], names=["by", "bits"])

    held: dict[int, np.ndarray] = {}
    for r in codes.mapInArrow(run, "by int, bits binary").toLocalIterator():  # one a task is held
        got = np.unpackbits(np.frombuffer(zlib.decompress(r.bits), np.uint8)).astype(bool)
        held[r.by] = held[r.by] | got if r.by in held else got
    return held


def _verified(batches):
    """Candidates of one document, grouped: best hits in code points."""
    for batch in batches:
        out = []
        for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found")), strict=True):
            raw, hits = norm(text), []
            for c in found:
                if c["q"]:
                    got = _hits(c["band"], c["item_id"], c["raw"], c["k"], raw)
                    hits += [got] if got else []
                else:
                    at = raw.find(c["raw"])
                    while at >= 0:
                        hits.append((c["item_id"], at, at + len(c["raw"]), 0))
                        at = raw.find(c["raw"], at + len(c["raw"]))
            out += [(doc_id, *_in_points(raw, h)) for h in best_of(hits)]
        if out:
            yield pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["doc_id", "item_id", "start", "stop", "edits"])



def _in_points(raw: bytes, hit: tuple) -> tuple:
    points = lambda at: len(raw[:at].decode("utf-8", "ignore"))
    return hit[0], points(hit[1]), points(hit[2]), hit[3]


def _leaks_of_many(docs: DataFrame, benchmark: DataFrame, rate: float) -> DataFrame:
    """``leaks`` for a benchmark of any size: nothing of it but bitmaps of fixed size leaves the cluster's tables."""
    spark = docs.sparkSession
    items = benchmark.mapInArrow(_items(rate), _ITEM).distinct()
    items = stash(items.withColumn("item", F.monotonically_increasing_id()))
    codes = stash(items.select("item", "raw", "q").mapInArrow(_item_grams, "item bigint, code bigint, by int, place bigint"))
    told = spark.sparkContext.broadcast(_marks(codes))
    numbered = stash(docs.withColumn("rid", F.monotonically_increasing_id()))
    held = numbered.select("rid", "text").mapInArrow(_held_grams(told), "rid bigint, code bigint, by int, at bigint")
    met = held.join(codes, ["code", "by"]).join(items.select("item", "k", "q", "least"), "item")
    width, diagonal = 2 * (F.col("k") + 1), F.col("at") - F.col("place")
    both = F.array(*[F.floor((diagonal + s * (F.col("k") + 1)) / width) * 2 + s for s in (0, 1)])
    near = met.select("rid", "item", "least", F.explode(F.when(F.col("q") > 0, both).otherwise(F.array(F.lit(0).cast("bigint")))).alias("band"))
    near = near.groupBy("rid", "item", "least", "band").count().where(F.col("count") >= F.col("least")).select("rid", "item", "band")
    found = near.join(items, "item").groupBy("rid").agg(F.collect_set(F.struct("item_id", "raw", "k", "q", "band")).alias("found"))
    return found.join(numbered, "rid").select("doc_id", "text", "found").mapInArrow(_verified, _SCHEMA)


def leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, most: int = BLOCK) -> DataFrame:
    """``doc_id, item_id, start, stop, edits``: each benchmark passage found, in code points. A benchmark of over ``most`` bytes is joined, see above."""
    docs = docs_of(docs)
    rows = benchmark.select("item_id", "text").where("text is not null")
    if (rows.agg(F.sum(F.octet_length("text").cast("bigint") + 16)).first()[0] or 0) > most:
        return _leaks_of_many(docs, rows, rate)
    block = [(r.item_id, r.text) for r in rows.distinct().orderBy("item_id", "text").collect()]  # `most` bytes
    if not block:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    return docs.mapInArrow(_search(block, rate), _SCHEMA)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The documents, all columns, without those that hold a benchmark passage."""
    return without(docs, stash(leaks(docs, benchmark, rate).select("doc_id").where("doc_id is not null").distinct()))
