"""Brown class-based bigrams.

Exchange clustering assigns words to classes so that the classes' transitions tell most. The ``WORDS`` most
frequent words are exchanged jointly; meanwhile all rarer words stand in groups by their last two bytes. Then every
other training word, however rare, gets its class by its own transitions: those to the classes of its neighbours,
counted over the training documents, choose the class that gains most (to first order, as one word weighs little in
a class). In that count a neighbour outside the ``WORDS`` stands by its group's class; afterwards the groups only
serve words that no training document has. Class transitions are counted anew with every word's own class.

A word's probability after a class mixes the class transition times the word's emission in its class with the
corpus' smoothed unigram:  (c+1) * (m * P(class|class) / norm + (1-m) / (N+V+1)), norm being the sum of c+1 over the
class and 1 for unseen words where the class has a group.  Every document starts and ends at the end token. m is
fitted to the training tokens, each left out of its own counts, by expectation maximisation over a histogram of how
much likelier the class model makes a token than the unigram.

The ``KNOWN`` most frequent words' counts and classes are sent to the tasks (a fixed bound); rarer words meet
theirs in a join.

Defined results: null or empty text is one end token; rows with a null ``doc_id`` count as training rows (the id's
text is empty); repeated rows count as often as they appear; without training rows N = V = 0 and base scores are 0;
an empty table gives no rows; other input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import docs_of, fold, stash, unstash

WORDS, ENDINGS, CLASSES, KNOWN, SWEEPS, FOLDS = 1024, 256, 64, 131_072, 4, 7
#: Bins of the histogram, a bin a twentieth of a power of e.
_BINS = 1_200
END = WORDS + ENDINGS
ITEMS = END + 1
_FLUSH = 400_000


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def ending(word: bytes) -> int:
    return WORDS + zlib.crc32(word[-2:]) % ENDINGS


def _count_words(batches):
    held: Counter = Counter()

    def flush():
        return pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            held.update(words_of(text))
            if len(held) > _FLUSH:
                yield flush()
                held = Counter()
    if held:
        yield flush()


def exchange(pairs: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of items from their transition counts: items move one by one to the class that helps most."""
    m = pairs.astype(np.float64)
    n = len(m)
    total = m.sum(0) + m.sum(1)
    order = np.argsort(-total, kind="stable")
    of = np.empty(n, np.int64)
    of[order] = np.arange(n) % classes
    of[order[classes:]] = classes - 1 - np.arange(n - classes) % classes if n > classes else []

    def xlog(x):
        return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)

    onehot = np.zeros((n, classes))
    onehot[np.arange(n), of] = 1
    out, into = m @ onehot, m.T @ onehot  # item to class, class to item
    grid = onehot.T @ out
    for _ in range(sweeps):
        moved = 0
        for w in order:
            if not total[w]:
                continue
            a, own = of[w], m[w, w]
            r, l = out[w].copy(), into[w].copy()  # noqa: E741
            r[a] -= own
            l[a] -= own
            grid[a] -= r
            grid[:, a] -= l
            grid[a, a] -= own
            rows, cols = grid.sum(1), grid.sum(0)
            gain = (xlog(grid + r) - xlog(grid)).sum(1) + (xlog(grid + l[:, None]) - xlog(grid)).sum(0)
            diag = np.diagonal(grid)
            gain += xlog(diag + r + l + own) - xlog(diag + r) - xlog(diag + l) + xlog(diag)
            gain -= xlog(rows + r.sum() + own) - xlog(rows) + xlog(cols + l.sum() + own) - xlog(cols)
            b = int(np.argmax(gain))
            if gain[b] <= gain[a] + 1e-9:
                b = a
            grid[b] += r
            grid[:, b] += l
            grid[b, b] += own
            if b != a:
                moved += 1
                of[w] = b
                out[:, a] -= m[:, w]
                out[:, b] += m[:, w]
                into[:, a] -= m[w]
                into[:, b] += m[w]
        if not moved:
            break
    return of


class Model:
    """What scoring needs, of fixed size: the most frequent words' counts and classes, class tables.

    Items are the ``WORDS`` first words, the groups, the end token and the other listed words, in this order.
    """

    def __init__(self, words: list[bytes], counts: list[int], n: int, v: int, ends: int, of: np.ndarray):
        self.place = {w: i for i, w in enumerate(words)}
        self.n, self.v = n, v
        c = np.array([*counts, ends], np.float64)
        self.log_count = np.log10(c + 1)
        self.known = c > 0
        self.item = np.array([i if i < WORDS else ITEMS + i - WORDS for i in range(len(words))] + [END], np.int64)
        self.of = of
        self.kind = of[self.item]
        self.flat, self.mix = 1.0 / (n + v + 1), 0.5

    def weigh(self, grid: np.ndarray, norm: np.ndarray) -> None:
        """Class transitions, and each class's sum of c+1."""
        self.grid, self.norm = grid, norm
        self.step = (grid + 0.1) / (grid.sum(1, keepdims=True) + 0.1 * len(grid))
        self.each = 1 / np.maximum(norm, 1)
        self.emit = self.each[self.of]

    def places(self, text: str):
        """Places of the tokens (-1: unlisted), the unlisted words."""
        words = words_of(text)
        at = np.fromiter((self.place.get(w, -1) for w in words), np.int32, len(words))
        at = np.append(at, np.int32(len(self.place)))
        return at, [words[i] for i in np.flatnonzero(at < 0).tolist()]

    def fall(self, rest: list[bytes]) -> np.ndarray:
        """The classes of words that were never met."""
        return self.of[[ending(w) for w in rest]].astype(np.uint8) if rest else np.zeros(0, np.uint8)

    def kinds(self, at: np.ndarray, far: np.ndarray) -> np.ndarray:
        kind = self.kind[at]
        kind[at < 0] = far
        return kind

    def sums(self, at: np.ndarray):
        near = at[at >= 0]
        return int(self.known[near].sum()), float(self.log_count[near].sum())

    def context(self, kind: np.ndarray) -> float:
        before = np.concatenate([[self.of[END]], kind[:-1]])
        return float(np.log10(self.mix * self.step[before, kind] * self.each[kind] + (1 - self.mix) * self.flat).sum())

    def ratios(self, kind: np.ndarray) -> np.ndarray:
        """Bins of the training tokens: log of class model over unigram, each token left out of its counts."""
        before = np.concatenate([[self.of[END]], kind[:-1]])
        step = (np.maximum(self.grid[before, kind] - 1, 0) + 0.1) / (np.maximum(self.grid.sum(1)[before] - 1, 0) + 0.1 * len(self.grid))
        # the counts' own part, c of c + 1, is the same on both sides
        log = np.log(step / np.maximum(self.norm[kind] - 1, 1) / self.flat)
        return np.clip(np.rint(log * 20) + _BINS // 2, 0, _BINS - 1).astype(np.int64)

    def fit_mix(self, bins: np.ndarray, steps: int = 200) -> None:
        if not bins.sum():
            return
        ratio, m = np.exp((np.arange(_BINS) - _BINS // 2) / 20), 0.5
        for _ in range(steps):
            m = float((bins * (m * ratio / (m * ratio + 1 - m))).sum() / bins.sum())
        self.mix = min(max(m, 0.01), 0.99)

    def read(self, text: str):
        """Tokens, known ones, sum of log10(c+1) of listed words, sum of log10 of what the context gives, unlisted words."""
        at, rest = self.places(text)
        return len(at), *self.sums(at), self.context(self.kinds(at, self.fall(rest))), rest


def _table(table: np.ndarray, name: str):
    spots = np.flatnonzero(table)
    if len(spots):
        yield pa.record_batch([pa.array(spots), pa.array(table[spots])], names=[name, "n"])


def _own_transitions(first: dict[bytes, int], of: np.ndarray):
    """Each word outside ``first`` with its transitions to the classes of its neighbours: code + (n << 8), 4 bytes each."""

    def run(batches):
        ids, kinds, texts, size = {}, [int(of[END])], [], 0

        def flush():
            seq = np.concatenate(texts)
            kind = np.array(kinds, np.int64)
            listed = np.zeros(len(kind), bool)
            listed[0] = True
            words = [b"", *ids]
            listed[1:] = np.fromiter((w in first for w in ids), bool, len(ids))
            p = np.flatnonzero(~listed[seq])
            code, n = np.unique(np.concatenate([seq[p] * (2 * CLASSES) + kind[seq[p + 1]], seq[p] * (2 * CLASSES) + CLASSES + kind[seq[p - 1]]]), return_counts=True)
            who, start = np.unique(code // (2 * CLASSES), return_index=True)
            packed = (code % (2 * CLASSES) + (n << 8)).astype("<u4")
            offsets = np.append(start, len(packed)).astype(np.int32) * 4
            told = pa.Array.from_buffers(pa.binary(), len(who), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
            return pa.record_batch([pa.array([words[i] for i in who.tolist()], pa.binary()), told], names=["word", "told"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                seq = [0]
                for w in words_of(text):
                    i = ids.get(w)
                    if i is None:
                        i = ids[w] = len(ids) + 1
                        k = first.get(w)
                        kinds.append(int(of[ending(w) if k is None else k]))
                    seq.append(i)
                seq.append(0)
                texts.append(np.array(seq, np.int64))
                size += len(seq)
                if size > 2_000_000 or len(ids) > _FLUSH:
                    yield flush()
                    ids, kinds, texts, size = {}, [int(of[END])], [], 0
        if texts:
            yield flush()

    return run


def choose(told: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The class of each row of ``told`` (transitions to classes, then from classes) that gains most to first order."""
    g, rows, cols = np.log(grid + 0.1), np.log(grid.sum(1) + 0.1), np.log(grid.sum(0) + 0.1)
    weights = np.concatenate([g.T - rows, g - cols])  # by neighbour's class, then by own class
    return np.argmax(told @ weights, axis=1)


def _classes(grid: np.ndarray):
    def run(batches):
        for batch in batches:
            lists, row = batch.column(1), len(batch)
            packs = lists.flatten()
            sizes = np.array([len(x) // 4 for x in packs.to_pylist()], np.int64)
            of_pack = np.repeat(np.arange(row), np.diff(lists.offsets.to_numpy()))
            codes = np.frombuffer(b"".join(packs.to_pylist()), "<u4").astype(np.int64)
            at = np.repeat(of_pack, sizes) * (2 * CLASSES) + codes % 256
            told = np.bincount(at, weights=codes >> 8, minlength=row * 2 * CLASSES).reshape(row, 2 * CLASSES)
            n = told[:, :CLASSES].sum(1).astype(np.int64)  # every occurrence has one word after it
            yield pa.record_batch([batch.column(0), pa.array(n), pa.array(choose(told, grid).astype(np.int32))], names=["word", "n", "kind"])

    return run


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model and the table of all training words' counts and classes."""
    return _learn(docs)[:2]


def _learn(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """What train() gives, and the documents' tokens as places, with the counts and classes of unlisted words."""
    spark = docs.sparkSession
    learn = docs.where(~F.col("held_out")).select("text")
    counts = stash(learn.mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    ends = learn.count()
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total.n + ends, total.v + (ends > 0)
    top = counts.orderBy(F.col("n").desc(), "word").limit(WORDS).collect()
    unstash(counts)
    first = {bytes(r.word): i for i, r in enumerate(top)}

    def transitions(batches):
        table, codes, size = np.zeros(ITEMS * ITEMS, np.int64), [], 0
        tails: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                item = [END]
                for w in words_of(text):
                    i = first.get(w)
                    if i is None:
                        t = w[-2:]
                        i = tails.get(t)
                        if i is None:
                            i = tails[t] = ending(w)
                    item.append(i)
                item.append(END)
                x = np.array(item, np.int64)
                codes.append(x[:-1] * ITEMS + x[1:])
                size += len(x)
                if size > 2_000_000:
                    table += np.bincount(np.concatenate(codes), minlength=len(table))
                    codes, size = [], 0
        if codes:
            table += np.bincount(np.concatenate(codes), minlength=len(table))
        yield from _table(table, "code")

    pairs = np.zeros(ITEMS * ITEMS, np.int64)
    # at most ITEMS squared rows, whatever the corpus
    got = learn.mapInArrow(transitions, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    pairs[got.column("code").to_numpy()] = got.column("n").to_numpy()
    pairs = pairs.reshape(ITEMS, ITEMS)
    of = exchange(pairs)
    onehot = np.zeros((ITEMS, CLASSES))
    onehot[np.arange(ITEMS), of] = 1

    # all other words, one by one
    own = learn.mapInArrow(_own_transitions(first, of), "word binary, told binary").groupBy("word").agg(F.collect_list("told").alias("told"))
    rest = stash(own.mapInArrow(_classes(onehot.T @ pairs @ onehot), "word binary, n bigint, kind int"))
    more = rest.orderBy(F.col("n").desc(), "word").limit(KNOWN - WORDS).collect()
    listed = [*((bytes(r.word), r.n, int(of[i])) for i, r in enumerate(top)), *((bytes(r.word), r.n, r.kind) for r in more)]
    of = np.concatenate([of, np.array([r.kind for r in more], np.int64)])
    model = Model([w for w, _, _ in listed], [c for _, c, _ in listed], n, v, ends, of)
    read = _placed(docs, model, rest)

    def steps(batches):
        m, table = told.value, np.zeros(CLASSES * CLASSES, np.int64)
        for batch in batches:
            for at, far, _ in _rows(batch):
                kind = m.kinds(at, far)
                table += np.bincount(np.concatenate([[m.of[END]], kind[:-1]]) * CLASSES + kind, minlength=len(table))
        yield from _table(table, "code")

    told = spark.sparkContext.broadcast(model)
    grid = np.zeros(CLASSES * CLASSES)
    for r in read.where(~F.col("held_out")).select("at", "fall", "tail").mapInArrow(steps, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        grid[r.code] = r.n
    norm = np.zeros(CLASSES)
    for r in rest.groupBy("kind").agg(F.sum(F.col("n") + 1).alias("n")).collect():
        norm[r.kind] = r.n
    for _, c, kind in listed[: len(top)]:
        norm[kind] += c + 1
    norm[of[END]] += ends + 1
    norm[np.unique(of[WORDS:END])] += 1  # where words go that were never met
    model.weigh(grid.reshape(CLASSES, CLASSES), norm)
    weighed = spark.sparkContext.broadcast(model)

    def ratios(batches):
        m, table = weighed.value, np.zeros(_BINS, np.int64)
        for batch in batches:
            for at, far, _ in _rows(batch):
                table += np.bincount(m.ratios(m.kinds(at, far)), minlength=_BINS)
        yield from _table(table, "code")

    bins = np.zeros(_BINS)
    for r in read.where(~F.col("held_out")).select("at", "fall", "tail").mapInArrow(ratios, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n")).collect():
        bins[r.code] = r.n
    model.fit_mix(bins)
    tops = spark.createDataFrame(listed[: len(top)], "word binary, n bigint, kind int")
    return model, rest.union(tops), read


def _placed(docs: DataFrame, model: Model, rest: DataFrame) -> DataFrame:
    told = docs.sparkSession.sparkContext.broadcast(model)  # KNOWN words: a fixed bound

    def run(batches):
        from pyspark import TaskContext

        m, row = told.value, TaskContext.get().partitionId() << 34
        for batch in batches:
            got = [m.places(x) for x in batch.column(1).to_pylist()]
            rid = pa.array(range(row, row + len(got)), pa.int64())
            row += len(got)
            at = pa.array([x.tobytes() for x, _ in got], pa.binary())
            fall = pa.array([m.fall(x).tobytes() for _, x in got], pa.binary())
            yield pa.record_batch([rid, batch.column(0), batch.column(2), at, fall, pa.array([x for _, x in got], pa.list_(pa.binary()))], names=["rid", "doc_id", "held_out", "at", "fall", "rest"])

    read = stash(docs.select("doc_id", "text", "held_out").mapInArrow(run, "rid bigint, doc_id bigint, held_out boolean, at binary, fall binary, rest array<binary>"))
    far = read.select("rid", F.posexplode("rest").alias("k", "word")).join(rest, "word")
    far = far.groupBy("rid").agg(F.collect_list(F.struct("k", "n", "kind")).alias("tail"))
    out = stash(read.drop("rest").join(far, "rid", "left"))
    unstash(read)
    return out


def _rows(batch: pa.RecordBatch):
    """Places, classes of unlisted words, and the counts of those that were met in training."""
    lists = batch.column("tail")
    offsets, values = lists.offsets.to_numpy(), lists.values
    k, n, kind = (values.field(c).to_numpy(zero_copy_only=False) for c in ("k", "n", "kind"))
    for i, (at, fall) in enumerate(zip(batch.column("at").to_pylist(), batch.column("fall").to_pylist(), strict=True)):
        some = slice(offsets[i], offsets[i + 1])
        far = np.frombuffer(fall, np.uint8).copy()
        far[k[some]] = kind[some]
        yield np.frombuffer(at, np.int32), far, n[some]


def score(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every row."""
    spark = docs.sparkSession
    docs = docs_of(docs).withColumn("held_out", fold(F.col("doc_id"), FOLDS) == 2)
    model, _, read = _learn(docs)
    told = spark.sparkContext.broadcast(model)

    def run(batches):
        m = told.value
        for batch in batches:
            got = []
            for at, far, n in _rows(batch):
                known, logs = m.sums(at)
                got.append((len(at), known + len(n), logs + float(np.log10(n + 1.0).sum()), m.context(m.kinds(at, far))))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), *(pa.array([x[k] for x in got], t) for k, t in enumerate(kinds))], names=["doc_id", "held_out", "n", "known", "logs", "context"])

    out = read.mapInArrow(run, "doc_id bigint, held_out boolean, n bigint, known bigint, logs double, context double")
    return out.select(
        "doc_id",
        "held_out",
        F.col("n").alias("n_tokens"),
        F.col("known").alias("n_known"),
        F.lit(model.n).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n") * float(np.log10(model.n + model.v + 1))).alias("base_score"),
        (F.col("logs") + F.col("context")).alias("score"),
        F.pow(F.lit(10.0), -(F.col("logs") + F.col("context")) / F.col("n")).alias("perplexity"),
    )
