"""Merkle fingerprints of documents, in DataFrame functions only.

The tree of a text: paragraphs end with a run of line breaks; the phrases of a paragraph are the leaves - a phrase ends
after a mark (no letter, no digit) or a word of eight letters or more and the blank that follows, so an edit moves
no border outside its own phrase; a section is a run of paragraphs up to one whose node is divisible by ``GROUP``. A leaf is
the sha256 of its text, a paragraph's node the sha256 over its leaves, a section's node over its paragraphs, and the
root over the sections and the text's length. Equal roots mean equal texts; unequal nodes locate edits.

A fingerprint is ``root:leaves:nodes``. The leaves are told by the first 8 hexadecimal digits of their hashes, with
commas between those of a paragraph, points between paragraphs and slashes between sections; the nodes of sections
and their paragraphs by 16 digits, a section's first, with the same points and slashes. ``likeness`` and ``differing`` take
two fingerprints and nothing else.

The next document by ``doc_id`` is found without a global sort in one task: documents are dealt into ranges
of ``doc_id`` - an id with many rows, or none, into several by the hash of the text -, the first document of each range is
also sent to the range before it, and a window within each range looks one row ahead.

Defined results: null or empty text has one section with one paragraph with one leaf, the empty one; of equal ids the
order is by the text's hash, then by text; rows with a null ``doc_id`` come first in the order; the only document is its
own next one; other input columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import docs_of

GROUP = 4
#: Ranges of doc_id: a multiple of the shuffle partitions, so that several ranges share a task and even out.
RANGES_A_TASK = 4
_PARAGRAPH = r"(?<=\n)(?!\n|\z)"
_PHRASE = r"(?<= )(?=\S)(?<=[^\p{L}\p{N}\s] |[\p{L}\p{N}]{8} )"
_TREE = "array<struct<node:string,paragraphs:array<struct<node:string,leaves:array<string>>>>>"
#: Last digits of nodes that are divisible by GROUP.
_LAST = [f"{k:x}" for k in range(0, 16, GROUP)]


def _once(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), 0)


def _over(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, ""), 256)


def _short(hashes: Column, n: int) -> Column:
    return F.transform(hashes, lambda x: F.left(x, F.lit(n)))


def fingerprint(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    hashed = lambda p: F.transform(F.split(p, _PHRASE), lambda x: F.sha2(x, 256))
    paragraph = lambda p: _once(hashed(p), lambda own: F.struct(_over(own).alias("node"), F.array_join(_short(own, 8), ",").alias("told")))

    def sections(ps):
        ends = F.filter(F.sequence(F.lit(1), F.size(ps)), lambda k: (k == F.size(ps)) | F.right(F.get(ps, k - 1).node, F.lit(1)).isin(*_LAST))
        return _once(ends, lambda e: F.transform(e, lambda end, k: _once(F.coalesce(F.get(e, k - 1), F.lit(0)), lambda start: section(F.slice(ps, start + 1, end - start)))))

    def section(own):
        nodes = F.transform(own, lambda p: p.node)
        return _once(nodes, lambda n: _once(_over(n), lambda node: F.struct(node.alias("node"), F.array_join(F.transform(own, lambda p: p.told), ".").alias("told"), F.concat(F.left(node, F.lit(16)), F.lit("."), F.array_join(_short(n, 16), ".")).alias("nodes"))))

    def whole(t):
        root = F.sha2(F.concat(F.array_join(F.transform(t, lambda s: s.node), ""), F.lit(":"), F.char_length(text).cast("string")), 256)
        return F.concat_ws(":", root, F.array_join(F.transform(t, lambda s: s.told), "/"), F.array_join(F.transform(t, lambda s: s.nodes), "/"))

    return _once(_once(F.transform(F.split(text, _PARAGRAPH), paragraph), sections), whole)


def parsed(print_: Column) -> Column:
    """The tree that a fingerprint tells."""
    paragraph = lambda p, n: F.struct(n.alias("node"), F.split(p, ",").alias("leaves"))
    section = lambda s, n: _once(F.split(n, r"\."), lambda nodes: F.struct(F.get(nodes, 0).alias("node"), F.zip_with(F.split(s, r"\."), F.slice(nodes, 2, F.size(nodes) - 1), paragraph).alias("paragraphs")))
    return _once(F.split(print_, ":"), lambda x: F.zip_with(F.split(F.get(x, 1), "/"), F.split(F.get(x, 2), "/"), section)).cast(_TREE)


def leaves_of(print_: Column) -> Column:
    """All leaves that a fingerprint tells, in order."""
    return F.split(F.translate(F.split_part(print_, F.lit(":"), F.lit(2)), "./", ",,"), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard index of the distinct leaves that two fingerprints tell, 0 to 1."""
    both = F.struct(F.array_distinct(leaves_of(a)).alias("a"), F.array_distinct(leaves_of(b)).alias("b"))
    return _once(both, lambda x: _once(F.size(F.array_intersect(x.a, x.b)), lambda n: n / (F.size(x.a) + F.size(x.b) - n)))


def _ends(a: Column, b: Column) -> Column:
    """Of two lists of nodes, how many are equal from the front, and from the back of what is left."""
    n = F.least(F.size(a), F.size(b))
    front = F.coalesce(F.get(F.filter(F.sequence(F.lit(0), n), lambda k: (k == n) | (F.get(a, k) != F.get(b, k))), 0), n)
    told = lambda f: F.struct(f.alias("front"), F.get(F.filter(F.sequence(F.lit(0), n - f), lambda k: (k == n - f) | (F.get(a, F.size(a) - 1 - k) != F.get(b, F.size(b) - 1 - k))), 0).alias("back"))
    return F.get(F.transform(F.array(front), told), 0)


def differing(a: Column, b: Column) -> Column:
    """Where two fingerprints' texts differ, from the root down: only branches whose nodes differ are opened.

    ``struct<section, paragraph, leaf, last_leaf_a, last_leaf_b>``, 1-based in the whole text: where the difference begins
    (in a), and the last leaf of it in a and in b (one before ``leaf`` where nothing stands against what the other has).
    Null if the roots are equal.
    """
    once = _once
    inner = lambda x, e: F.slice(x, e.front + 1, F.size(x) - e.front - e.back)
    nodes = lambda x: F.transform(x, lambda s: s.node)
    count = lambda x: F.aggregate(x, F.lit(0), lambda s, p: s + F.size(p.leaves))

    def in_leaves(sa, pa, pb, es, ep, before):
        la, lb = (F.flatten(F.transform(inner(p, ep), lambda q: q.leaves)) for p in (pa, pb))
        skipped = before.leaves + count(F.slice(pa, 1, ep.front))
        return once(F.struct(la.alias("a"), lb.alias("b")), lambda x: once(_ends(x.a, x.b), lambda el: F.struct((es.front + 1).alias("section"), (before.paragraphs + ep.front + 1).alias("paragraph"), (skipped + el.front + 1).alias("leaf"), (skipped + F.size(x.a) - el.back).alias("last_leaf_a"), (skipped + F.size(x.b) - el.back).alias("last_leaf_b"))))

    def in_paragraphs(t, es):
        head = F.flatten(F.transform(F.slice(t.a, 1, es.front), lambda s: s.paragraphs))
        before = F.struct(F.size(head).alias("paragraphs"), count(head).alias("leaves"))
        pa, pb = (F.flatten(F.transform(inner(x, es), lambda s: s.paragraphs)) for x in (t.a, t.b))
        return once(F.struct(pa.alias("a"), pb.alias("b"), before.alias("before")), lambda p: once(_ends(nodes(p.a), nodes(p.b)), lambda ep: in_leaves(t.a, p.a, p.b, es, ep, p.before)))

    both = F.struct(parsed(a).alias("a"), parsed(b).alias("b"))
    return F.when(F.left(a, F.lit(64)) != F.left(b, F.lit(64)), once(both, lambda t: once(_ends(nodes(t.a), nodes(t.b)), lambda es: in_paragraphs(t, es))))


#: Stands for a null id: below all others.
_NONE = -(1 << 63) - 1


def _key(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("decimal(20,0)"), F.lit(str(_NONE)).cast("decimal(20,0)"))


def _edges(cuts: list, nulls: int, n: int) -> list[tuple[int, int]]:
    """Where ranges begin, as (id, hash): an id that is several cuts has several ranges."""
    times: dict[int, int] = {_NONE: nulls} if nulls > 1 else {}
    for c in cuts:
        times[c] = times.get(c, 0) + 1
    return sorted((i, -(1 << 63) + (k << 64) // t) for i, t in times.items() for k in range(t))


def _bucket(key: Column, h: Column, edges: list[tuple[int, int]]) -> Column:
    """How many edges are at or below (key, hash), by a table of tables."""
    if not edges:
        return F.lit(0)
    width = max(1, int(len(edges) ** 0.5))
    rows = [[{"i": i, "h": x} for i, x in edges[k : k + width]] for k in range(0, len(edges), width)]
    kind = "array<struct<i:decimal(20,0),h:bigint>>"
    heads = F.from_json(F.lit(json.dumps([r[0] for r in rows])), kind)
    table = F.from_json(F.lit(json.dumps(rows)), f"array<{kind}>")
    under = lambda x: (x.i < key) | ((x.i == key) & (x.h <= h))
    row = F.size(F.filter(heads, under))
    return F.when(row == 0, 0).otherwise((row - 1) * width + F.size(F.filter(F.get(table, row - 1), under)))


def with_next(docs: DataFrame, **made) -> DataFrame:
    """``doc_id, text`` and what is ``made`` of the text (name=function), and the same of the next row by doc_id as ``next_text`` ...; the last one's next is the first one."""
    spark, own = docs.sparkSession, ["text", *made]
    docs = docs_of(docs).withColumn("h", F.xxhash64("text"))
    n = RANGES_A_TASK * int(spark.conf.get("spark.sql.shuffle.partitions"))
    got = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 20 * n).alias("e"), F.count_if(F.col("doc_id").isNull()).alias("null"), F.count("*").alias("all")).first()
    edges = _edges(got.e or [], got.null * n // max(got["all"], 1), n)
    placed = docs.withColumn("range", _bucket(_key(F.col("doc_id")), F.col("h"), edges))
    # a row for each range: as many as the cluster's settings say, not the corpus
    first = F.min(F.struct(_key(F.col("doc_id")).alias("key"), "h")).alias("first")
    firsts = sorted(placed.groupBy("range").agg(first).collect(), key=lambda r: r["range"])
    if not firsts:
        return docs.select("doc_id", "text", *(F.lit(None).cast("string").alias(c) for c in [*made, *(f"next_{c}" for c in own)]))
    targets = [(r["range"], r["first"].key, r["first"].h, firsts[k - 1]["range"]) for k, r in enumerate(firsts)]
    told = spark.createDataFrame(targets, "range int, first_key decimal(20,0), first_h bigint, target int")
    heads = placed.join(F.broadcast(told), "range").where((_key(F.col("doc_id")) == F.col("first_key")) & (F.col("h") == F.col("first_h")))
    # rows that share the first place: one will do, the first by text
    heads = heads.groupBy("target").agg(F.min_by(F.struct("doc_id", "text", "h"), "text").alias("x")).select("x.*", "target", F.lit(1).alias("tail"))
    both = placed.select("doc_id", "text", "h", "range", F.lit(0).alias("tail")).union(heads)
    both = both.withColumns({c: f(F.col("text")) for c, f in made.items()}) if made else both
    order = Window.partitionBy("range").orderBy("tail", F.col("doc_id").asc_nulls_first(), "h", "text")
    return both.withColumns({f"next_{c}": F.lead(c).over(order) for c in own}).where("tail = 0").select("doc_id", *own, *(f"next_{c}" for c in own))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint`` of every row."""
    return docs_of(docs).select("doc_id", fingerprint(F.col("text")).alias("fingerprint"))


def compared(docs: DataFrame) -> DataFrame:
    """Every row's fingerprint, its edited text's, their likeness, that to the next text's, and where the edit begins; the edit is the contract's, see the query."""
    d = with_next(docs, own=fingerprint).withColumn("n_chars", F.char_length("text").cast("bigint")).withColumn("cut", F.expr("cast(n_chars div 4 as int)"))
    d = d.withColumn("edited", F.expr("concat(left(text, cast(n_chars - cut as int)), left(next_text, cut))"))
    prints = F.array(F.struct("own", fingerprint(F.col("edited")).alias("edited"), F.col("next_own").alias("next")))
    d = d.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.explode(prints).alias("p"))  # bound once: what follows reads them often
    told = F.array(F.struct(likeness(F.col("p.own"), F.col("p.edited")).alias("near_edited"), likeness(F.col("p.own"), F.col("p.next")).alias("near_next"), differing(F.col("p.own"), F.col("p.edited")).alias("edit")))
    d = d.select("doc_id", "n_chars", "edited_sha256", F.col("p.own").alias("fingerprint"), F.col("p.edited").alias("edited_fingerprint"), F.explode(told).alias("t"))
    return d.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "t.near_edited", "t.near_next", "t.edit.paragraph", "t.edit.leaf")
