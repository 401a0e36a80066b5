"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

Lines are compared by their words (A-Z lowered, ASCII blanks apart); the edit bound is one word put in, left out
or replaced in a line of at least ``SHORTEST`` words, none in a shorter one, where a word is a good part of the line. A
line is dropped when an earlier line - by (doc_id, line number) - is equal or within the bound; of each set of equal
lines only the earliest can stay. Lines under ``least`` words always stay (by default ``SHORTEST``; the queries take 1, so
blank lines).

Equal lines are found by a 128-bit hash. Of the distinct lines, those within the bound must share their first or
last half with their partner (no pair is lost by this), so only lines with a shared half emit their variants:
for every word left out, two hashed sums over the remaining words and their new places. Equal variants meet: lines
with the same variant at the same place differ in that word alone, so each is linked to the earliest of its bucket,
without any pairs; a line equal to another's variant is linked to it. Links are verified on the words.

Defined results: null or empty text has one empty line and stays as it is; rows with a null ``doc_id`` stay
untouched and count for nothing; rows with the same ``doc_id`` are one document, so a line at the same place in
both is no repeat; ties cannot occur beyond that; other input columns are kept, whatever their names (the count has
underscores added to its name until no input column has it); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.llm.common import UPPER, fresh, maybe_in, stash, unstash

SHORTEST = 5
#: Word hashes are summed; this many bits keep the sum of a million words within a bigint.
_MASK = (1 << 42) - 1
_KEY = ["h1", "h2"]
_KEYS = ["key0", "key1", "key2", "key3"]


def words_of(line: Column) -> Column:
    """A-Z lowered; a line of ASCII alone takes the quicker function for it."""
    plain = line
    for blank in "\t\r\x0b\x0c":
        plain = F.replace(plain, F.lit(blank), F.lit(" "))
    lowered = F.when(F.octet_length(line) == F.char_length(line), F.lower(plain)).otherwise(F.translate(plain, UPPER, UPPER.lower()))
    return F.array_remove(F.split(lowered, " "), "")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _read(lines: DataFrame, shortest: int, least: int) -> DataFrame:
    """doc_id, line_no, 128-bit hash and four keys of halves (null under ``shortest`` words)."""
    # explode() binds the words once: a filter on them isn't pushed below, where they would be made again
    read = lines.select("doc_id", "line_no", F.explode(F.array(words_of(F.col("line")))).alias("words")).withColumn("n", F.size("words")).where(F.col("n") >= least)

    def halves(m: Column) -> list[Column]:  # for partners of which the shorter one has m words
        h = F.floor(m / 2).cast("int")
        return [F.xxhash64(m, F.lit("first"), F.slice("words", F.lit(1), h)), F.xxhash64(m, F.lit("last"), F.slice("words", F.col("n") - (m - h) + 1, m - h))]

    keys = [F.when(F.col("n") >= shortest, k).alias(f"key{i}") for i, k in enumerate([*halves(F.col("n")), *halves(F.col("n") - 1)])]
    return read.select("doc_id", "line_no", F.xxhash64("words").alias("h1"), F.xxhash64(F.lit("second"), "words").alias("h2"), *keys)


def _place() -> Column:
    """(doc_id, line_no) as one number of the same order, so that sums by hash can hold it."""
    return F.col("doc_id").cast("decimal(19,0)") * F.lit(1 << 31).cast("decimal(10,0)") + F.col("line_no").cast("decimal(10,0)")


def within_one(a: Column, b: Column) -> Column:
    """Whether two word arrays are within one edit."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y))
    p = F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)), F.greatest(F.size(a), F.size(b)) + 1)  # the first place that differs
    rest = lambda x, at: F.slice(x, at.cast("int"), F.greatest(F.size(x) - at.cast("int") + 1, F.lit(0)))
    return F.when(F.size(a) == F.size(b), rest(a, p + 1) == rest(b, p + 1)).when(F.size(a) + 1 == F.size(b), rest(a, p) == rest(b, p + 1)).when(F.size(a) == F.size(b) + 1, rest(a, p + 1) == rest(b, p)).otherwise(False)


def _able(distinct: DataFrame) -> DataFrame:
    """The distinct lines that share a half with another one, with their first places, numbered in that order."""
    keys = distinct.where("key0 is not null").select("h1", "h2", F.explode(F.array(*_KEYS)).alias("key"))
    shared = keys.groupBy("key").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("key")
    able = keys.join(shared, "key").select(*_KEY).distinct().join(distinct, _KEY)
    line_no = F.pmod("first", F.lit(1 << 31).cast("decimal(10,0)"))
    able = able.select(*_KEY, line_no.cast("int").alias("line_no"), ((F.col("first") - line_no) / F.lit(1 << 31).cast("decimal(10,0)")).cast("bigint").alias("doc_id"))
    # numbers in the order of the lines: ranges are in order, and so are the rows of each
    return stash(able.repartitionByRange("doc_id", "line_no").sortWithinPartitions("doc_id", "line_no").withColumn("id", F.monotonically_increasing_id()))


def _near(docs: DataFrame, able: DataFrame) -> DataFrame:
    """Hashes of the distinct lines that have an earlier one within one edit."""
    # their words again, from the documents of their first places
    kept = docs.where("text is not null").where(maybe_in(able, "doc_id")(F.col("doc_id"))).select("doc_id", "text")
    texts = able.groupBy("doc_id").agg(F.collect_list(F.struct("line_no", "h1", "h2", "id")).alias("wanted")).join(kept, "doc_id")
    lined = texts.withColumn("lines", F.split("text", "\n")).select("lines", F.explode("wanted").alias("w"))
    worded = lined.select("w.h1", "w.h2", "w.id", F.explode(F.array(words_of(F.get("lines", F.col("w.line_no"))))).alias("words"))
    worded = stash(worded.where((F.xxhash64("words") == F.col("h1")) & (F.xxhash64(F.lit("second"), "words") == F.col("h2"))).dropDuplicates(["id"]))

    # dealt by line before the words are told apart: the sums below need no further shuffle
    at = worded.select("id", "words").repartition("id").select("id", F.size("words").alias("n"), F.posexplode("words").alias("pos", "word"))
    for s in ("a", "b"):
        for name, pos in (("own", F.col("pos")), ("moved", F.col("pos") - 1)):
            at = at.withColumn(f"{name}_{s}", F.xxhash64(F.lit(s), "word", pos).bitwiseAND(F.lit(_MASK)))
    all_, so_far = Window.partitionBy("id"), Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    cols = [F.sum(f"own_{s}").over(so_far).alias(f"own_before_{s}") for s in "ab"] + [F.sum(f"moved_{s}").over(so_far).alias(f"moved_before_{s}") for s in "ab"]
    cols += [F.sum(f"own_{s}").over(all_).alias(f"full_{s}") for s in "ab"] + [F.sum(f"moved_{s}").over(all_).alias(f"moved_all_{s}") for s in "ab"]
    summed = at.select("*", *cols)
    variant = lambda s: F.col(f"own_before_{s}") - F.col(f"own_{s}") + F.col(f"moved_all_{s}") - F.col(f"moved_before_{s}")
    one = lambda n, pos, a, b: F.struct(pos.alias("pos"), F.xxhash64(n, a, b).alias("va"), b.alias("vb"))
    own = one(F.col("n") - 1, F.col("pos"), variant("a"), variant("b"))
    # the whole line, once, at place -1
    whole = F.when(F.col("pos") == 0, F.array(own, one(F.col("n"), F.lit(-1), F.col("full_a"), F.col("full_b")))).otherwise(F.array(own))
    variants = stash(summed.select("id", F.inline(whole)))

    parts = variants.where("pos >= 0")
    bucket = parts.groupBy("va", "vb", "pos").agg(F.min("id").alias("top"), F.count("*").alias("lines")).where("lines > 1")
    hubs = bucket.select("va", "vb", F.col("pos").alias("at"), "top").union(variants.where("pos = -1").select("va", "vb", "pos", "id"))
    # a replaced word: the earliest of those with this variant at this place; a word more: the line equal to the variant
    met = parts.join(hubs, ["va", "vb"]).where(((F.col("at") - F.col("pos") == 0) | (F.col("at") < 0)) & (F.col("id") != F.col("top")))
    links = met.select(F.greatest("id", "top").alias("id"), F.least("id", "top").alias("early")).distinct()
    words = worded.select("id", "words")
    checked = links.join(worded, "id").join(words.toDF("early", "early_words"), "early").where(within_one(F.col("words"), F.col("early_words")))
    near = stash(checked.select(*_KEY).distinct())
    unstash(able, worded, variants)
    return near


def removed(docs: DataFrame, shortest: int = SHORTEST, least: int | None = None) -> DataFrame:
    """``doc_id, line_no`` of every line to drop."""
    docs = docs.select("doc_id", "text")
    read = stash(_read(_lines(docs), shortest, shortest if least is None else min(least, shortest)))
    distinct = stash(read.groupBy(*_KEY).agg(F.min(_place()).alias("first"), *[F.max(k).alias(k) for k in _KEYS], F.count("*").alias("times")))
    able = _able(distinct)
    # only lines that lose an occurrence go on
    again = stash(distinct.where("times > 1").select(*_KEY, "first", F.lit(False).alias("near")))
    unstash(distinct)
    near = _near(docs, able).select(*_KEY, F.lit(None).cast(again.schema["first"].dataType).alias("first"), F.lit(True).alias("near"))
    # written, so that both sides of the join come from an exchange of their own and a frequent line can be split
    verdict = stash(again.union(near).groupBy(*_KEY).agg(F.max("first").alias("first"), F.max("near").alias("near")))
    met = read.select("doc_id", "line_no", *_KEY).join(verdict, _KEY)
    out = stash(met.where(F.col("near") | (_place() != F.col("first"))).select("doc_id", "line_no"))
    unstash(read, again, verdict)
    return out


def drop_lines(docs: DataFrame, shortest: int = SHORTEST, least: int | None = None, count: str = "lines_removed") -> DataFrame:
    """The documents, all columns, with the repeated lines cut from ``text``, and how many as the last column (``count``, see above)."""
    lines = removed(docs, shortest, least)
    gone = stash(lines.groupBy("doc_id").agg(F.sort_array(F.collect_set("line_no")).alias("lines")))
    unstash(lines)
    count, key, held = (fresh(x, *docs.columns) for x in (count, "gone_id", "gone_lines"))
    touched = F.col("doc_id").isNotNull() & maybe_in(gone, "doc_id")(F.col("doc_id"))
    cut = docs.where(touched).join(gone.toDF(key, held), F.col("doc_id") == F.col(key), "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains(F.col(held), i))
    text = F.when(F.col(held).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    done = cut.withColumn("text", text).select(*docs.columns, F.coalesce(F.size(held), F.lit(0)).alias(count))
    return docs.where(~touched).select(*docs.columns, F.lit(0).alias(count)).union(done)
