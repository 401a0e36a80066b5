"""Shared pieces: input projection, the work folder, skew-safe components.

Intermediate tables go to the folder named by ``spark.checkpoint.dir`` as Parquet, so a lost executor
costs a re-read and not a recomputation. The setting is only filled in when it is unset (tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs_of(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null becomes empty) and nothing else that the input may carry."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


def work_folder(spark: SparkSession) -> str:
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = spark.sparkContext.getCheckpointDir()
        if not held and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = held.rsplit("/", 1)[0] if held else "file://" + tempfile.mkdtemp(prefix="spanloom-")
        if not held:  # a single process, as in tests and bench: its own disk is shared
            spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/spanloom-{uuid.uuid4().hex}"


#: Shuffle files go when the execution that made them ends; what it wrote stays.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stash(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Write df to the shared work folder and read it back: cuts lineage, survives lost executors.

    The session's setting for shuffle files is left on: it changes no result, and a query of another thread never
    finds it switched back in the middle.
    """
    spark, path = df.sparkSession, work_folder(df.sparkSession)
    if spark.conf.get(_CLEANUP, None) != "true":
        spark.conf.set(_CLEANUP, "true")
    writer = df.write
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def unstash(*dfs: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in dfs:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stashed_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fold(doc_id, mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % mod


#: Rows of a batch that a worker turns into Python objects at a time.
ROWS = 500


def small(batches, rows: int = ROWS):
    """The rows of the batches in their order, few at a time; an empty batch gives none."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: So many ids (bigint) are sent to all tasks at most; a longer list meets the documents in a shuffle.
SENT = 1_000_000


def _sendable(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose ``doc_id`` is among ids (distinct, not null)."""
    return docs.join(_sendable(ids), "doc_id", "left_semi").select(docs.columns)


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose ``doc_id`` is not among ids (not null); a null id stays."""
    return docs.join(_sendable(ids), "doc_id", "left_anti").select(docs.columns)


def fresh(name: str, *taken: str) -> str:
    """A column name that none of taken equals in any case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` to ``(node, comp)``, comp being the smallest node that can be reached.

    Minimum labels travel along edges and then jump to their label's label, so the rounds grow with
    the logarithm of the longest path. Every round aggregates before it shuffles and is written to the
    shared folder. A hub's edges meet a single label row, so an uneven join can be split.
    """
    both = stash(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("comp"))
    labels, new = stash(labels), None
    for _ in range(rounds):
        told = both.join(labels, both.a == labels.node).groupBy(F.col("b").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(told, "node").select("node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        step = stash(step)
        at = step.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        old, new = new or labels, stash(step.join(at, "comp").select("node", F.least("comp", "root").alias("comp"), (F.least("comp", "root") != F.col("old")).alias("moved")))
        labels = new.select("node", "comp")
        unstash(old, step)
        if not new.where("moved").limit(1).count():
            break
    else:
        raise RuntimeError("components did not settle")
    unstash(both)
    labels.stashed_at = new.stashed_at
    return labels


class Recent(dict):
    """A bounded memo: when full, what was used lately stays for one more round. ``make(key)`` fills it."""

    def __init__(self, make, cap: int, longest: int = 64):
        super().__init__()
        self.make, self.cap, self.longest, self.old = make, cap // 2, longest, {}

    def __missing__(self, key):
        got = self.old.get(key)
        if got is None:
            got = self.make(key)
            if len(key) > self.longest:
                return got
        self.put(key, got)
        return got

    def put(self, key, got) -> None:
        if len(self) >= self.cap:
            self.old = dict(self)
            self.clear()
        self[key] = got


#: A filter's bitmap has eight bits an id, up to this many bits (1 MB in the plan).
BITS = 1 << 23


def maybe_in(ids: DataFrame, column: str):
    """A native filter that passes every value of ``ids[column]`` and few others: a bitmap sized by the count of ids.

    It only saves shuffling rows that a following join would drop; beyond some millions of ids it passes more and more.
    """
    bits = min(BITS, 1 << max(12, (8 * ids.count()).bit_length()))
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)).cast("int")
    at = slot(F.col(column))
    rows = ids.select((at / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("bigint"), at % 64).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).collect()  # bits / 64 rows at most
    words = [0] * (bits // 64)
    for r in rows:
        words[r.word] = r.bits
    table = F.from_json(F.lit("[" + ",".join(map(str, words)) + "]"), "array<bigint>")
    return lambda c: F.call_function("shiftright", F.get(table, (slot(c) / 64).cast("int")), slot(c) % 64).bitwiseAND(F.lit(1)) == 1
