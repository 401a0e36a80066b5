"""Sources: files of text, mixed folders, labelled examples, markdown and marked-up notes, JSON requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators.evaluate import EvalError

IMAGES = ("png", "jpg", "jpeg", "webp", "bmp", "tif", "tiff")
LABELLED = "text string, spans array<struct<entity:string,start:int,end:int>>"


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: a whole file a row."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def kind_of(path: Column, content: Column) -> Column:
    """pdf, image or text; null for what is none of them. Text is valid UTF-8 without a zero byte."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    text = F.is_valid_utf8(content) & ~F.contains(content, F.lit(b"\x00"))
    return F.when(suffix == "pdf", "pdf").when(suffix.isin(*IMAGES), "image").when(text, "text")


def folder(spark: SparkSession, path: str) -> DataFrame:
    """``path, length, kind, text`` of all files below a folder; hidden files are skipped by the reader."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    kind = kind_of(F.col("path"), F.col("content"))
    return got.select("path", "length", kind.alias("kind"), F.when(kind == "text", F.col("content").cast("string")).alias("text"))


def folder_bytes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def examples(spark: SparkSession, path: str) -> DataFrame:
    """``text, spans, source`` of labelled JSON lines; blank lines and // lines are skipped; a bad line fails with its place."""
    files = spark.read.option("pathGlobFilter", "*.jsonl").text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    lines = files.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("no", "line")).where("trim(line) <> '' and not ltrim(line) like '//%'")
    place = F.concat("file", F.lit(":"), F.col("no") + 1)
    read = lines.select(place.alias("source"), F.from_json("line", LABELLED).alias("j"))
    bad = F.col("j").isNull() | F.col("j.text").isNull()
    said = F.raise_error(F.concat(F.lit("not a labelled example: "), F.col("source")))
    return read.select(F.when(bad, said.cast("string")).otherwise(F.col("j.text")).alias("text"), F.coalesce("j.spans", F.array().cast("array<struct<entity:string,start:int,end:int>>")).alias("spans"), "source")


def checked_examples(spark: SparkSession, path: str) -> DataFrame:
    got = examples(spark, path)
    if not got.limit(1).count():
        raise EvalError(f"no labelled examples in {path}")
    return got


def snippets(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = 30, longest: int = 300) -> DataFrame:
    """Markdown paragraphs and table rows of a fitting length, each once a document regardless of case (the first)."""
    block = docs.select(key, F.posexplode(F.split(text, r"\n\s*\n")).alias("b", "block"))
    table = F.col("block").rlike(r"^\s*\|")
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    cells = lambda line: F.array_join(F.filter(F.transform(F.split(F.regexp_replace(F.trim(line), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)), lambda c: c != ""), " | ")
    rows = F.transform(F.filter(lines, lambda x: ~x.rlike(r"^[\s|:-]+$")), cells)
    some = block.select(key, "b", F.posexplode(F.when(table, rows).otherwise(F.array(F.array_join(F.transform(lines, lambda x: F.trim(x)), " ")))).alias("r", "snippet"))
    fit = some.where(F.char_length("snippet").between(shortest, longest) & F.col("snippet").rlike("[A-Za-z0-9]"))
    return fit.groupBy(key, F.lower("snippet").alias("low__")).agg(F.min_by("snippet", F.struct("b", "r")).alias("snippet"), F.min(F.struct("b", "r")).alias("at")).select(key, "at", "snippet")


def sample_each(rows: DataFrame, key: str, n: int = 6, seed: int = 0, text: str = "snippet") -> DataFrame:
    """n rows of each key by the order of a seeded hash (a sampling operator)."""
    from pyspark.sql import Window

    order = Window.partitionBy(key).orderBy(F.xxhash64(text, F.lit(seed)), text)
    return rows.withColumn("rank__", F.row_number().over(order)).where(F.col("rank__") <= n).drop("rank__")


_MARK = r"\{\{([A-Z][A-Z0-9_]*):([^{}]*)\}\}"


def marked(text: Column) -> Column:
    """``struct<text, spans>`` of a note with {{ENTITY:value}} marks: marks removed, offsets in what is left."""
    kinds, values = F.regexp_extract_all(text, F.lit(_MARK), F.lit(1)), F.regexp_extract_all(text, F.lit(_MARK), F.lit(2))
    gaps = F.split(text, _MARK, -1)
    parts = F.zip_with(F.slice(gaps, 1, F.size(kinds)), F.arrays_zip(kinds.alias("k"), values.alias("v")), lambda g, m: F.struct(g.alias("g"), m.k.alias("k"), m.v.alias("v")))
    none = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<entity:string,start:int,end:int>>").alias("spans"))

    def step(acc, x):
        start = F.char_length(acc.text) + F.char_length(x.g)
        span = F.struct(x.k.alias("entity"), start.alias("start"), (start + F.char_length(x.v)).alias("end"))
        return F.struct(F.concat(acc.text, x.g, x.v).alias("text"), F.concat(acc.spans, F.array(span)).alias("spans"))

    return F.aggregate(parts, none, step, lambda acc: F.struct(F.concat(acc.text, F.element_at(gaps, -1)).alias("text"), acc.spans.alias("spans")))


def notes(docs: DataFrame, entities: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """Labelled rows of the list items of notes; an unknown entity or a mark that cannot be read fails the whole read."""
    item = docs.select(key, F.posexplode(F.split(text, "\n")).alias("no", "line")).where(F.col("line").startswith("- "))
    got = item.select(key, "no", marked(F.substring("line", 3, 1 << 30)).alias("m"))
    wrong = F.exists("m.spans", lambda s: ~s.entity.isin(entities)) | F.col("m.text").contains("{{") | F.col("m.text").contains("}}")
    said = F.raise_error(F.concat(F.lit("line "), F.col("no") + 1, F.lit(": unknown entity or broken mark")))
    return got.select(key, "no", F.when(wrong, said.cast("string")).otherwise(F.col("m.text")).alias("text"), F.col("m.spans").alias("spans"))
