"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct ``width``-word shingles (64-bit hashes). Documents with equal sets
form one class at once, so exact copies never meet as pairs. Shingles are put in one global order, rare
first, by a counting sketch of fixed size over all documents; the order only steers cost, any order
gives the same links. The rarest shingles of each class - enough that two linked classes must share
one - are joined with the shingle that comes before each in its class's order.

In a shingle's bucket every two classes that pass the length and the positional filter are a candidate pair, unless
both have the same shingle before this one: then they met in that one's bucket already, so a run of shared shingles
gives its pair once. In buckets with more than ``NEAR`` members, and in those that the sketch shows to be large and
that are dealt to several tasks, each member meets the first one and the one before it, in the order of how few rarer
shingles they have, and is compared with those it meets most. What is in one component after that is settled, and classes outside a bucket's largest component are then compared with all others
of the bucket. That stays small because the order is rare first: a passage that many documents share comes last in
each, so the positional filter only passes documents that consist of it for the most part, and those link.

Candidates pass the suffix filter - sizes and parities of the parts of both sets that lie in the same parts of the
hash space bound their distance - and each is verified once on its whole sets.

Defined results: null or empty text has an empty set, ``n_shingles`` 0, and links with nothing; a text
with fewer than ``width`` words has its whole sequence as one shingle; equal rows link; rows with a
null ``doc_id`` are returned unlinked with a null ``component_id``; an empty table gives no rows; other
input columns are ignored, so clashing names are harmless.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.common import components, docs_of, only, small, stash, unstash, without

WIDTH, PERCENT = 5, 80
#: Counters of the rare-first sketch (16 MB), whatever the input's size; sent in slices.
SKETCH, SLICE = 1 << 22, 1 << 14
#: Parts of the hash space whose set sizes bound the distance of two sets (the suffix filter).
PARTS = 16
#: Finer parts of which only the parity is kept, as bits: those that differ are a bound too, and cheap to count.
PARITY = 512
#: In buckets up to this size all members meet.
NEAR = 32
#: A bucket that is longer than this is worked off in pieces.
_PIECE = 1 << 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes, sorted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 7)], np.uint64)
    ids = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = len(ids) - width + 1
    out = ids[:n].copy()
    for k in range(1, width):  # every step is a bijection of the 64-bit state for a given word
        out ^= out >> np.uint64(29)
        out *= _MIX
        out += ids[k : k + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def class_of(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes(), 11) - (1 << 63)


def rare_first(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return found[np.lexsort((found, counts[(found & np.uint64(SKETCH - 1)).astype(np.int64)]))]


def need(n: int, percent: int = PERCENT) -> int:
    """Shingles that a partner of a set of n must share with it at least."""
    return -(-n * percent // 100)


_FIRST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("parts", pa.list_(pa.int32())), ("parity", pa.list_(pa.int64())), ("slot", pa.int32()), ("block", pa.binary())])


def _read_sets(width: int):
    def run(batches):
        counts = np.zeros(SKETCH, np.int32)
        for batch in small(batches):
            ids, n, cls, parts, parity = batch.column(0).to_pylist(), [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width)
                n.append(len(found))
                cls.append(class_of(found))
                parts.append(np.bincount((found >> np.uint64(60)).astype(np.int64), minlength=PARTS).astype(np.int32))
                parity.append(np.packbits(np.bincount(((found >> np.uint64(32)) & np.uint64(PARITY - 1)).astype(np.int64), minlength=PARITY).astype(np.uint8) & 1).view(np.int64))
                np.add.at(counts, (found & np.uint64(SKETCH - 1)).astype(np.int64), 1)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(parts, pa.list_(pa.int32())), pa.array(parity, pa.list_(pa.int64())), pa.nulls(len(ids), pa.int32()), pa.nulls(len(ids), pa.binary())], schema=_FIRST)
        if counts.any():
            import zlib

            slots = list(range(SKETCH // SLICE))
            blocks = [zlib.compress(counts[s * SLICE : (s + 1) * SLICE].astype(np.int64).tobytes(), 1) for s in slots]
            yield pa.record_batch([pa.nulls(len(slots), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))] + [pa.array(slots, pa.int32()), pa.array(blocks, pa.binary())], schema=_FIRST)

    return run


def _sum_blocks(batches):
    """Sum the blocks of each slot as they come: rows arrive dealt by slot, one array a slot is held."""
    import zlib

    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for slot, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            got = np.frombuffer(zlib.decompress(block), np.int64)
            held[slot] = held[slot] + got if slot in held else got
    if held:
        yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in held.values()], pa.binary())], names=["slot", "block"])


def _sketch(first: DataFrame) -> np.ndarray:
    """The summed sketch: SKETCH counters, a fixed size, whatever the corpus."""
    import zlib

    blocks = first.where("slot is not null").select("slot", "block")
    part = blocks.repartition(SKETCH // SLICE, "slot").mapInArrow(_sum_blocks, "slot int, block binary")
    out = np.zeros(SKETCH, np.int64)
    for row in part.collect():
        out[row.slot * SLICE : (row.slot + 1) * SLICE] += np.frombuffer(zlib.decompress(row.block), np.int64)
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def _prefixes(width: int, percent: int, told):
    def run(batches):
        counts, seen = told.value, set()
        least = -(-percent // (100 - percent)) if percent < 100 else 1 << 60  # smaller sets only link with equal ones
        light = 1000 + 16 * int(counts.mean())  # a shingle counted oftener is dealt to several tasks
        for batch in small(batches):
            gram, salt, cls, size, pos, prior = [], [], [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, width)
                n = len(found)
                if n < least or (key := class_of(found)) in seen:
                    continue
                if len(seen) < 200_000:  # a copy in the same task sends nothing; beyond this it is harmless
                    seen.add(key)
                k = n - need(n, percent) + 1
                rare = rare_first(found, counts)[:k]
                gram.append(rare.view(np.int64))
                parts = counts[(rare & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.int64) // light
                salt.append(np.where(parts > 0, 1 + key % (parts + 1), 0))
                cls.append(np.full(k, key, np.int64))
                size.append(np.full(k, n, np.int64))
                pos.append(np.arange(k, dtype=np.int64))
                prior.append(np.concatenate([[0], rare[:-1].view(np.int64)]))
            if gram:
                yield pa.record_batch([np.concatenate(x) for x in (gram, salt, cls, size, pos, prior)], names=["gram", "salt", "cls", "n", "pos", "prior"])

    return run


_MET = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("times", pa.int64()), ("gram", pa.int64()), ("n", pa.int64()), ("pos", pa.int64())])
#: Kinds of what _meet tells.
_PAIR, _HUB, _LAST, _MEMBER = range(4)


def _meet(percent: int):
    """Rows in the order of gram, salt, pos and cls to candidate pairs of small buckets, and to the members of large
    ones, with how often each meets the first one and the one before it there."""

    def told(kind, a, b=None, times=None, gram=None, n=None, pos=None):
        if len(a):
            cols = [np.full(len(a), kind), a, b, times, gram, n, pos]
            yield pa.record_batch([pa.nulls(len(a), f.type) if x is None else pa.array(x, f.type) for x, f in zip(cols, _MET, strict=True)], schema=_MET)

    def once(a, b):
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(a), 1), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return a[starts], b[starts], np.diff(starts, append=len(a))

    def out(rows, whole=False):
        gram, salt, cls, n, pos, prior = rows
        starts = np.flatnonzero(np.concatenate([np.ones(min(len(gram), 1), bool), (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])]))
        sizes = np.diff(starts, append=len(gram))
        hub = np.repeat(starts, sizes)
        large = np.repeat(sizes > NEAR, sizes) | (salt > 0) | whole
        rank = np.arange(len(gram)) - hub

        def fits(x, y):
            left, right = n[x], n[y]
            least = np.minimum(left - pos[x], right - pos[y])
            return (100 * np.minimum(left, right) >= percent * np.maximum(left, right)) & ((100 + percent) * least >= percent * (left + right)) & (cls[x] != cls[y])

        found, y = [], np.flatnonzero((rank > 0) & ~large)
        for back in range(1, NEAR):
            if not len(y):
                break
            x = y - back
            met = fits(x, y) & ((prior[x] != prior[y]) | (pos[x] == 0) | (pos[y] == 0))
            found.append((np.minimum(cls[x], cls[y])[met], np.maximum(cls[x], cls[y])[met]))
            y = y[rank[y] > back]
        if found:
            a, b, _ = once(*(np.concatenate(x) for x in zip(*found, strict=True)))
            yield from told(_PAIR, a, b)
        y = np.flatnonzero((rank > 0) & large)
        for kind, x in ((_HUB, hub[y]), (_LAST, y - 1)):
            met = fits(x, y)
            yield from told(kind, *once(cls[y][met], cls[x][met]))
        at = np.flatnonzero(large)
        yield from told(_MEMBER, cls[at], gram=gram[at], n=n[at], pos=pos[at])

    def run(batches):
        held, piece = None, False  # the last bucket, which may go on; whether a piece of it is done already
        for batch in batches:
            rows = [batch.column(k).to_numpy() for k in range(6)]
            if not len(rows[0]):
                continue
            if held is not None:
                if piece and (held[0][0] != rows[0][0] or held[1][0] != rows[1][0]):
                    yield from out(held, True)
                    held, piece = None, False
                else:
                    rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
            same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
            last = int(np.argmax(same))
            if last:
                if piece:  # the end of a bucket that came in pieces, then others
                    end = int(np.argmax((rows[0] != rows[0][0]) | (rows[1] != rows[1][0])))
                    yield from out([x[:end] for x in rows], True)
                    rows, last, piece = [x[end:] for x in rows], last - end, False
                if last:
                    yield from out([x[:last] for x in rows])
            held = [x[last:] for x in rows]
            if len(held[0]) > _PIECE:
                yield from out(held, True)
                held, piece = [x[-1:] for x in held], True
        if held is not None:
            yield from out(held, piece)

    return run


def _whole_sets(width: int):
    def run(batches):
        for batch in batches:
            found = [shingles(x, width) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([pa.array([class_of(x) for x in found], pa.int64()), pa.array([x.view(np.int64) for x in found], pa.list_(pa.int64()))], names=["cls", "grams"])

    return run


def _might_link(percent: int):
    """Length and positional filters, as a condition on rows x and y of one bucket."""
    n, m = F.col("x.n"), F.col("y.n")
    least = F.least(n - F.col("x.pos"), m - F.col("y.pos"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * least >= percent * (n + m))


def _parity_fits(x: str, y: str, n, m, percent: int):
    """Parities that differ are at most what the sets of two linked classes differ in."""
    apart = sum((F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(PARITY // 64)), F.lit(0))
    return (100 + percent) * apart <= (100 - percent) * (n + m)


def _bands(percent: int):
    """Bands of set sizes: those of two linked classes are the same or neighbours."""
    step = math.log(max(100 / percent, 1.01)) * 1.001
    return F.floor(F.log(F.col("n").cast("double")) / step).cast("int")


def _verify(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``pairs(a, b)``, each once, to those that link: suffix filter on set sizes by part, then whole sets."""
    of = lambda s: classes.select(F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("parts").alias(f"parts_{s}"), F.col("parity").alias(f"parity_{s}"), F.col("rep").alias(f"rep_{s}"))
    apart = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    near = pairs.join(of("a"), "a").join(of("b"), "b").where((100 + percent) * (F.col("n_a") + F.col("n_b") - apart) >= 2 * percent * (F.col("n_a") + F.col("n_b")))
    near = near.where(_parity_fits("parity_a", "parity_b", F.col("n_a"), F.col("n_b"), percent))
    near = stash(near.select("a", "b", "rep_a", "rep_b"))
    wanted = near.select(F.col("rep_a").alias("doc_id")).union(near.select("rep_b")).distinct()
    sets = stash(only(docs.select("doc_id", "text"), wanted).mapInArrow(_whole_sets(width), "cls bigint, grams array<bigint>"))
    one = sets.dropDuplicates(["cls"])
    a, b = one.select(F.col("cls").alias("a"), F.col("grams").alias("set_a")), one.select(F.col("cls").alias("b"), F.col("grams").alias("set_b"))
    both = near.select("a", "b").join(a, "a").join(b, "b").withColumn("same", F.size(F.array_intersect("set_a", "set_b")))
    out = stash(both.where(100 * F.col("same") >= percent * (F.size("set_a") + F.size("set_b") - F.col("same"))).select("a", "b"))
    unstash(near, sets)
    return out


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of docs; see the module's text."""
    spark, docs = docs.sparkSession, docs_of(docs)
    first = stash(docs.mapInArrow(_read_sets(width), "doc_id bigint, n bigint, cls bigint, parts array<int>, parity array<bigint>, slot int, block binary"))
    rows = first.where("slot is null").select("doc_id", "n", "cls")
    usable = docs.where("doc_id is not null")
    classes = stash(first.where("slot is null and n > 0 and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n"), F.max("parts").alias("parts"), F.max("parity").alias("parity")))
    told = spark.sparkContext.broadcast(_sketch(first))  # SKETCH counters: a fixed size
    prefixes = usable.mapInArrow(_prefixes(width, percent, told), "gram bigint, salt bigint, cls bigint, n bigint, pos bigint, prior bigint")
    dealt = prefixes.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "pos", "cls")
    met = stash(dealt.mapInArrow(_meet(percent), "kind int, a bigint, b bigint, times bigint, gram bigint, n bigint, pos bigint"))
    # in large buckets, of each kind the partner that a class meets in most of them; the others are compared below, if that is not enough
    tries = met.where(F.col("kind").isin(_HUB, _LAST)).groupBy("kind", "a", "b").agg(F.sum("times").alias("times"))
    best = tries.groupBy("kind", "a").agg(F.max_by("b", F.struct("times", "b")).alias("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = _verify(met.where(F.col("kind") == _PAIR).select("a", "b").union(best).distinct(), classes, usable, width, percent)
    comp = components(links)

    # large buckets: members outside the largest component against all
    big = met.where(F.col("kind") == _MEMBER).select("gram", F.col("a").alias("cls"), "n", "pos").distinct()
    big = stash(big.join(comp, F.col("cls") == comp.node, "left").select("gram", "cls", "n", "pos", F.coalesce("comp", "cls").alias("comp")))
    unstash(met, comp)
    tops = big.groupBy("gram", "comp").count().groupBy("gram").agg(F.max_by("comp", F.struct("count", "comp")).alias("top"), F.count("*").alias("comps")).where("comps > 1")
    tops = stash(tops.select("gram", "top"))
    mixed = big.join(tops, "gram")
    mixed = stash(mixed.join(classes.select("cls", "parity"), "cls").withColumn("band", _bands(percent)))
    y = mixed.where("comp <> top").withColumn("band", F.explode(F.array(*[F.col("band") + k for k in (-1, 0, 1)])))
    apart = (F.col("x.comp") != F.col("y.comp")) & ((F.col("x.comp") == F.col("y.top")) | (F.col("x.cls") < F.col("y.cls")))
    fits = _might_link(percent) & _parity_fits("x.parity", "y.parity", F.col("x.n"), F.col("y.n"), percent)
    pairs = mixed.alias("x").join(y.alias("y"), (F.col("x.gram") == F.col("y.gram")) & (F.col("x.band") == F.col("y.band")) & apart & fits)
    pairs = pairs.select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b")).distinct()
    more = _verify(pairs, classes, usable, width, percent)
    comp = components(links.union(more))
    unstash(big, tops, mixed, links, more)
    label = comp.join(classes, comp.node == classes.cls).select("cls", "comp", "rep")
    label = label.join(label.groupBy("comp").agg(F.min("rep").alias("least")), "comp").select("cls", "least")
    ids = classes.join(label, "cls", "left").select("cls", F.coalesce("least", "rep").alias("least"))
    linked = rows.where("n > 0 and doc_id is not null").join(ids, "cls").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return linked.union(rows.where("n = 0 or doc_id is null").select("doc_id", "n", "doc_id"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, without those that link to a smaller ``doc_id`` by any path."""
    gone = near_duplicates(docs, width, percent).where("component_id <> doc_id").select("doc_id").distinct()
    return without(docs, stash(gone))
