"""More registered queries: single operators over the driver's tables or inline rows, each with SQL that computes the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import checks, text as texts
from spanloom.operators import boxes, detect, evaluate, resolve, windows
from spanloom.plans import catalogue
from spanloom.plans.config import active
from spanloom.plans.registry import _ALL, _CONFIG, _IP, _PHONE, _RX, _THREE, _docs, _found, _sql_spans, query
from spanloom.sources import readers, sinks

_PLAIN10 = _sql_spans("documents", "doc_id", "text", "PHONE", "plain_10", 0.4)
_MOBILE = _sql_spans("documents", "doc_id", "text", "IN_PHONE", "in_mobile", 0.6)
_DIGITS = _sql_spans("documents", "doc_id", "text", "IN_PINCODE", "pincode", 0.3)
_MIXED = f"{_PHONE} UNION ALL {_PLAIN10} UNION ALL {_MOBILE} UNION ALL {_IP} UNION ALL {_DIGITS}"
_MIXED_PATTERNS = {("PHONE", "intl"), ("PHONE", "plain_10"), ("IN_PHONE", "in_mobile"), ("IP_ADDRESS", "ipv4"), ("IN_PINCODE", "pincode")}


def _mixed(spark, sf_dir):
    """Overlapping spans of five patterns, as one array a document."""
    out = detect.empty()
    for p in _CONFIG.patterns:
        if (p.entity, p.name) in _MIXED_PATTERNS:
            out = F.concat(out, detect.find_all(F.col("text"), p.regex, p.entity, p.name, p.score))
    return _docs(spark, sf_dir).select("doc_id", "text", out.alias("spans"))


@query(f"""WITH s AS ({_MIXED}), f AS (SELECT *, CASE pattern WHEN 'intl' THEN 1 WHEN 'plain_10' THEN 2 ELSE 3 END AS o FROM s)
    SELECT doc_id, entity, pattern, start, "end", score FROM f x WHERE NOT EXISTS (SELECT 1 FROM f y WHERE y.doc_id = x.doc_id AND y.entity = x.entity AND y.start <= x.start AND x."end" <= y."end"
      AND (y.score > x.score OR (y.score = x.score AND (y.start <> x.start OR y."end" <> x."end" OR y.o < x.o))))""")
def contained_spans(spark, sf_dir):
    return detect.rows(_mixed(spark, sf_dir).select("doc_id", detect.drop_contained(F.col("spans")).alias("spans")), "doc_id", "spans")


@query(f"""WITH s AS ({_MIXED}), r AS (SELECT *, COALESCE(MAX("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, score DESC, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach FROM s)
    SELECT doc_id, entity, pattern, CAST(GREATEST(start, reach) AS INTEGER) AS start, "end", score FROM r WHERE "end" > reach""")
def settled_spans(spark, sf_dir):
    return detect.rows(_mixed(spark, sf_dir).select("doc_id", resolve.settle(F.col("spans")).alias("spans")), "doc_id", "spans")


@query(f"""SELECT doc_id, string_agg(entity || '@' || start, ',' ORDER BY start, "end" DESC, entity, pattern) AS told FROM ({_MIXED}) GROUP BY doc_id""")
def spans_in_order(spark, sf_dir):
    got = _mixed(spark, sf_dir).where(F.size("spans") > 0)
    return got.select("doc_id", F.array_join(F.transform(detect.in_order(F.col("spans")), lambda s: F.concat(s.entity, F.lit("@"), s.start.cast("string"))), ",").alias("told"))


@query(f"""SELECT * FROM ({_MIXED}) WHERE score >= 0.3 AND entity IN ('IN_PHONE', 'IN_PINCODE', 'IP_ADDRESS')""")
def context_threshold(spark, sf_dir):
    """The cut-off of a context, inclusive, and the entities that are asked for."""
    some = _docs(spark, sf_dir).select("doc_id", "text")
    found = detect.detect(F.col("text"), _CONFIG, "everything", ["IN_PHONE", "IN_PINCODE", "IP_ADDRESS", "NOTHING"])
    return detect.rows(some.select("doc_id", found.alias("spans")), "doc_id", "spans")


_GUESSES = [(1, "PERSON", 0, 4, 0.9), (1, "PERSON", 5, 15, 0.9), (1, "DATE", 0, 4, 0.9), (1, "IN_PAN", 0, 10, 0.44), (1, "IN_PAN", 0, 10, 0.45), (1, "DOB", 16, 29, 0.3), (1, "ADDRESS", 16, 29, 0.29), (1, "CUSTOMER_ID", 0, 4, 0.8), (2, "PERSON", 0, 10, 0.9), (2, "PERSON", 11, 15, 0.9), (2, "EMAIL", 0, 4, 0.1)]
_TEXTS = [(1, "Asha Father's   Name born in May 1982"), (2, "FIRST NAME Ravi")]


@query(f"""WITH g(doc_id, entity, start, "end", score) AS (VALUES {", ".join(f"({d}, '{e}', {a}, {b}, CAST({s} AS DOUBLE))" for d, e, a, b, s in _GUESSES)}), t(doc_id, text) AS (VALUES {", ".join(f"({d}, '{x.replace(chr(39), chr(39) * 2)}')" for d, x in _TEXTS)}),
    f AS (SELECT g.*, lower(trim(regexp_replace(substring(text, start + 1, "end" - start), '\\s+', ' ', 'g'))) AS v FROM g JOIN t USING (doc_id))
    SELECT doc_id, entity, start, "end", score FROM f WHERE entity <> 'DATE' AND score >= 0.3 AND (entity <> 'IN_PAN' OR score >= 0.45 - 1e-9) AND NOT (entity IN ('PERSON', 'DOB', 'ADDRESS', 'CUSTOMER_ID') AND v IN ({", ".join("'" + x.replace("'", "''") + "'" for x in catalogue.FORM_LABELS)}))""")
def model_findings(spark, sf_dir):
    """Cut-off, floors, undeclared entities and form labels, on spans as a model gives them."""
    g = spark.createDataFrame(_GUESSES, "doc_id int, entity string, start int, end int, score double").groupBy("doc_id").agg(F.collect_list(F.struct("entity", F.lit("model").alias("pattern"), "start", "end", "score")).alias("extra"))
    t = spark.createDataFrame(_TEXTS, "doc_id int, text string").join(g, "doc_id")
    found = detect.detect(F.col("text"), _CONFIG, "everything", extra=F.col("extra"))
    return detect.rows(t.select("doc_id", F.filter(found, lambda s: s.pattern == "model").alias("spans")), "doc_id", "spans").drop("pattern")


@query(f"""SELECT c.name AS context, e.entity FROM (VALUES {", ".join(f"('{c.name}', '{e}')" for c in _CONFIG.contexts.values() for e in c.entities)}) c(name, e) JOIN (VALUES ('EMAIL'), ('IN_PAN'), ('NOTHING')) e(entity) ON c.e = e.entity""")
def active_entities(spark, sf_dir):
    rows = [(c, e) for c in _CONFIG.contexts for e in active(_CONFIG, c, ["EMAIL", "IN_PAN", "NOTHING"])]
    return spark.createDataFrame(rows, "context string, entity string")


@query("SELECT doc_id, CAST(len(w) AS INTEGER) AS tokens, CAST(len(list_filter(w, lambda t: t = '' OR (length(regexp_replace(t, '[^0-9]', '', 'g')) < 3 AND (length(regexp_replace(t, '[^\\p{L}]', '', 'g')) * 1.0 / length(t) < 0.6 OR len(list_filter(range(1, length(t) - 2), lambda i: t[i] = t[i + 1] AND t[i] = t[i + 2] AND t[i] = t[i + 3])) > 0)))) AS INTEGER) AS garbage FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents)")
def scanner_noise(spark, sf_dir):
    w = _docs(spark, sf_dir).select("doc_id", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("w"))
    return w.select("doc_id", F.size("w").alias("tokens"), F.size(F.filter("w", texts.is_garbage)).alias("garbage"))


@query("SELECT doc_id, regexp_matches(regexp_replace(v, '[^0-9]', '', 'g'), '^[1-9][0-9]{5}$') AS ok, v FROM (SELECT doc_id, CAST(n_chars * 37 + doc_id * 1009 AS VARCHAR) AS v FROM documents)")
def pincode_shape(spark, sf_dir):
    v = _docs(spark, sf_dir).select("doc_id", (F.col("n_chars") * 37 + F.col("doc_id") * 1009).cast("string").alias("v"))
    return v.select("doc_id", checks.pincode(F.col("v")).alias("ok"), "v")


@query("SELECT doc_id, regexp_replace(text, '-([0-9]{5,6})\\b', ' \\1', 'g') AS split FROM documents")
def pincode_hyphens(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", texts.split_pincodes(F.col("text")).alias("split"))


@query(f"""WITH a AS (SELECT doc_id, entity, start, "end", score FROM ({_IP})), b AS (SELECT doc_id, 'IP_ADDRESS' AS entity, start + 1 AS start, "end" - 1 AS "end", CAST(0.5 AS DOUBLE) AS score FROM ({_IP}) UNION ALL SELECT doc_id, entity, start, "end", score FROM ({_PHONE}))
    SELECT * FROM a UNION ALL SELECT * FROM b x WHERE NOT EXISTS (SELECT 1 FROM a y WHERE y.doc_id = x.doc_id AND y.entity = x.entity AND y.start <= x.start AND x."end" <= y."end")""")
def second_scan(spark, sf_dir):
    """What a second scan adds: all that no span of the same entity contains."""
    cols = ("doc_id", "entity", "start", "end", "score")
    a = _found(spark, sf_dir, ("ipv4",)).select(*cols)
    b = a.select("doc_id", "entity", (F.col("start") + 1).alias("start"), (F.col("end") - 1).alias("end"), F.lit(0.5).alias("score"))
    return resolve.add_rescan(a, b.union(_found(spark, sf_dir, ("intl",)).select(*cols)))


_LINE = "SELECT doc_id AS page_id, CAST(k - 1 AS INTEGER) AS line_no, x[k] AS text, CAST(COALESCE(list_sum(list_transform(x[1:k - 1], lambda v: length(v) + 1)), 0) AS BIGINT) AS off FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text IS NOT NULL))"


def _page_lines(spark, sf_dir):
    return _docs(spark, sf_dir).where("text is not null").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))


@query(f"SELECT page_id, line_no, off AS at FROM ({_LINE})")
def line_offsets(spark, sf_dir):
    return boxes.line_starts(_page_lines(spark, sf_dir)).select("page_id", "line_no", F.col("at").cast("bigint").alias("at"))


@query(f"""WITH l AS ({_LINE}), s AS ({_ALL}) SELECT l.page_id, line_no, entity, CAST(GREATEST(start, off) - off AS BIGINT) AS "from", CAST(LEAST("end", off + length(text)) - off AS BIGINT) AS "to" FROM s JOIN l ON s.doc_id = l.page_id AND s.start < off + length(text) AND off < s."end" """)
def spans_on_lines(spark, sf_dir):
    lines = _page_lines(spark, sf_dir).withColumns({"box": F.lit(None).cast("string"), "words": F.lit(None).cast("string")})
    met = boxes.on_lines(_found(spark, sf_dir, _THREE).withColumnRenamed("doc_id", "page_id"), lines)
    return met.select("page_id", "line_no", "entity", F.col("from").cast("bigint").alias("from"), F.col("to").cast("bigint").alias("to"))


_CUTS = [(1, 0, "EMAIL", 2, 9), (1, 0, "EMAIL", 30, 31), (1, 1, "PERSON", 0, 3)]
_WORDS = [(1, 0, 0, 4, 10, 10, 50, 40), (1, 0, 5, 9, 55, 12, 95, 44), (1, 0, 10, 12, 100, 10, 120, 40), (1, 1, 0, 2, 1, 1, 9, 90), (1, 1, 3, 5, 12, 1, 20, 9)]


@query(f"""WITH c(page_id, line_no, entity, a, b) AS (VALUES {", ".join(str(x) for x in _CUTS)}), w(page_id, line_no, s, e, x1, y1, x2, y2) AS (VALUES {", ".join(str(x) for x in _WORDS)}),
    g AS (SELECT page_id, line_no, entity, a, b, MIN(x1) AS x1, MIN(y1) AS y1, MAX(x2) AS x2, MAX(y2) AS y2 FROM c JOIN w USING (page_id, line_no) WHERE s < b AND a < e GROUP BY ALL), p AS (SELECT *, GREATEST(3, (y2 - y1) // 8) AS pad FROM g)
    SELECT page_id, line_no, entity, a AS "from", b AS "to", GREATEST(0, x1 - pad) AS x1, GREATEST(0, y1 - pad) AS y1, LEAST(110, x2 + pad) AS x2, LEAST(60, y2 + pad) AS y2 FROM p""")
def word_boxes(spark, sf_dir):
    w = spark.createDataFrame([(p, n, {"start": s, "end": e, "box": {"x1": a, "y1": b, "x2": c, "y2": d}}) for p, n, s, e, a, b, c, d in _WORDS], "page_id int, line_no int, w struct<start:int,end:int,box:struct<x1:int,y1:int,x2:int,y2:int>>")
    met = spark.createDataFrame(_CUTS, "page_id int, line_no int, entity string, from int, to int").join(w.groupBy("page_id", "line_no").agg(F.collect_list("w").alias("words")), ["page_id", "line_no"])
    got = boxes.tight_boxes(met, 110, 60)
    return got.select("page_id", "line_no", "entity", "from", "to", *(F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query(f"""WITH s AS ({_ALL}), o AS (SELECT *, MAX("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    i AS (SELECT *, SUM(CASE WHEN reach IS NULL OR start > reach + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT doc_id, MIN(start) AS start, MAX("end") AS "end" FROM i GROUP BY doc_id, island""")
def near_spans(spark, sf_dir):
    return resolve.merge_near(_found(spark, sf_dir, _THREE), gap=300)


@query(f"""WITH s AS (SELECT doc_id, entity, start, "end", score, unnest([0, 7, 11]) AS w FROM ({_ALL})) SELECT doc_id, entity, start, "end", MAX(score - w / 100.0) AS score FROM s GROUP BY doc_id, entity, start, "end" """)
def window_hits(spark, sf_dir):
    """The same hit seen in several windows, at different scores."""
    s = _found(spark, sf_dir, _THREE).withColumn("w", F.explode(F.array(F.lit(0), F.lit(7), F.lit(11))))
    hits = s.select("doc_id", F.col("w").alias("start"), "entity", (F.col("start") - F.col("w")).alias("from"), (F.col("end") - F.col("w")).alias("to"), (F.col("score") - F.col("w") / 100).alias("score"))
    return windows.best_of_windows(hits)


_SUMS = f"""WITH s AS ({_ALL}), o AS (SELECT *, MAX("end") OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, entity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), i AS (SELECT *, SUM(CASE WHEN reach IS NULL OR start >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start, "end" DESC, entity ROWS UNBOUNDED PRECEDING) AS island FROM o),
    b AS (SELECT doc_id, island, arg_max(entity, score) AS entity FROM i GROUP BY doc_id, island)"""


@query(f"{_SUMS} SELECT CAST(doc_id % 10 AS BIGINT) AS doc_id, entity, COUNT(*) AS places FROM b GROUP BY ALL")
def file_receipts(spark, sf_dir):
    """Receipts of pages (here: documents) to receipts of files (here: tens)."""
    spans = _found(spark, sf_dir, _THREE).groupBy("doc_id").agg(F.collect_list(F.struct("entity", "pattern", "start", "end", "score")).alias("s"))
    pages = spans.select((F.col("doc_id") % 10).alias("doc_id"), resolve.places_in_row(F.col("s")).alias("receipt"))
    got = boxes.page_totals(pages)
    return got.select("doc_id", "entity", F.col("places").cast("bigint").alias("places"))


_NAMED = [(1, {"EMAIL": 2, "PHONE": 1, "IN_PHONE": 3}), (2, {"OPENAI_KEY": 1, "GITHUB_TOKEN": 2, "JWT": 1, "IN_PAN": 1, "UK_DRIVING_LICENCE": 4, "MEDICAL_HISTORY": 1}), (3, {})]


@query(f"""WITH r(id, entity, n) AS (VALUES {", ".join(f"({i}, '{e}', {n})" for i, m in _NAMED for e, n in m.items())}),
    k(entity, name) AS (VALUES {", ".join(f"('{e}', '{n}')" for e, n in catalogue.DISPLAY.items())}),
    p AS (SELECT id, n, CASE WHEN k.name IS NOT NULL THEN k.name WHEN r.entity LIKE '%\\_KEY' ESCAPE '\\' OR r.entity LIKE '%\\_TOKEN' ESCAPE '\\' THEN 'Secret' ELSE array_to_string(list_transform(string_split(regexp_replace(r.entity, '^(IN|US|UK)_', ''), '_'), lambda w: CASE WHEN length(w) <= 6 THEN w ELSE w[1] || lower(w[2:]) END), ' ') END AS name FROM r LEFT JOIN k USING (entity))
    SELECT id, name, CAST(SUM(n) AS BIGINT) AS n FROM p GROUP BY id, name""")
def display_receipts(spark, sf_dir):
    df = spark.createDataFrame(_NAMED, "id int, receipt map<string,int>")
    return df.select("id", F.explode(sinks.shown(F.col("receipt"))).alias("name", "n")).select("id", "name", F.col("n").cast("bigint").alias("n"))


@query(f"""WITH g AS (SELECT doc_id, COUNT(*) AS n, entity FROM ({_ALL}) GROUP BY doc_id, entity)
    SELECT entity, CAST(SUM(n) AS BIGINT) AS n FROM g GROUP BY entity UNION ALL SELECT 'POSITIVE', COUNT(DISTINCT doc_id) FROM g UNION ALL SELECT 'NEGATIVE', (SELECT COUNT(*) FROM documents) - (SELECT COUNT(DISTINCT doc_id) FROM g)""")
def labelled_statistics(spark, sf_dir):
    spans = _found(spark, sf_dir, _THREE).groupBy("doc_id").agg(F.collect_list(F.struct("entity", "start", "end")).alias("spans"))
    all_ = _docs(spark, sf_dir).select("doc_id").join(spans, "doc_id", "left")
    return evaluate.label_stats(all_.select(F.coalesce("spans", F.array().cast("array<struct<entity:string,start:int,end:int>>")).alias("spans")))


@query(f"""SELECT 'doc' || doc_id AS source, entity, start, CAST("end" - start AS INTEGER) AS length FROM ({_ALL}) WHERE doc_id % 2 = 1""")
def missed_places(spark, sf_dir):
    """Labels that were not found: where and how long, without the value."""
    spans = _found(spark, sf_dir, _THREE).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "entity"))).alias("gold"))
    e = spans.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), "gold", F.when(F.col("doc_id") % 2 == 1, F.slice("gold", 1, 0)).otherwise(F.col("gold")).alias("found"))
    return evaluate.misses(e)


@query("SELECT source, CAST(COUNT(*) AS BIGINT) AS n FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents) WHERE k <= 6 GROUP BY source")
def sampled_rows(spark, sf_dir):
    """How many rows a seeded sample takes of each source; which ones is Spark's hash and no SQL engine's."""
    return readers.sample_each(_docs(spark, sf_dir).select("source", "text"), "source", 6, text="text").groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN contains(text, chr(0)) THEN NULL ELSE 'text' END AS kind FROM documents UNION ALL SELECT page_id, 'pdf' FROM pages")
def content_kinds(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.lit("a/b.md").alias("path"), F.encode("text", "UTF-8").alias("content"))
    p = _docs(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.lit("x/y.PDF").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return d.union(p).select("doc_id", readers.kind_of(F.col("path"), F.col("content")).alias("kind"))


@query(f"""WITH l AS ({_LINE}), s AS (SELECT doc_id AS page_id, entity, start, "end", score FROM ({_PHONE}) WHERE doc_id % 2 = 0),
    w AS (SELECT page_id, off, text, regexp_extract_all(text, '[A-Z][a-z]+ [a-z]+', 0) AS f, string_split_regex(text, '[A-Z][a-z]+ [a-z]+') AS g FROM l WHERE length(trim(text)) >= 12),
    h AS (SELECT page_id, off, f, g, unnest(range(1, len(f) + 1)) AS k FROM w),
    p AS (SELECT page_id, 'PERSON' AS entity, off + COALESCE(list_sum(list_transform(g[1:k], lambda x: length(x))), 0) + COALESCE(list_sum(list_transform(f[1:k - 1], lambda x: length(x))), 0) AS start, length(f[k]) AS n, f[k] AS v FROM h)
    SELECT page_id, entity, CAST(start AS BIGINT) AS start, CAST("end" AS BIGINT) AS "end", score FROM s UNION ALL SELECT page_id, entity, CAST(start AS BIGINT), CAST(start + n AS BIGINT), CAST(0.4 AS DOUBLE) FROM p WHERE regexp_matches(v, '[A-Za-z]{{3}}')""")
def rescanned_lines(spark, sf_dir):
    """Lines scanned one by one by a stand-in for a model: two words of which the first has a capital."""
    lines = boxes.line_starts(_page_lines(spark, sf_dir))
    spans = _found(spark, sf_dir, ("intl",)).where("doc_id % 2 = 0").withColumnRenamed("doc_id", "page_id")
    find = lambda text, cut: detect.find_all(text, r"[A-Z][a-z]+ [a-z]+", "PERSON", "model", 0.4, flags="")
    got = resolve.rescan(spans, lines, find)
    return got.select("page_id", "entity", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "score")


_LICENCES = [(1, "driving licence MORGA657054SM9IJ of"), (2, "number MORGA657054SM9IJ of"), (3, "DVLA one two three four five MORGA657054SM9IJ"), (4, "dvla one two three MORGA657054SM9IJ")]


@query(f"""WITH t(id, text) AS (VALUES {", ".join(f"({i}, '{x}')" for i, x in _LICENCES)}), f AS (SELECT id, strpos(text, 'MORGA') - 1 AS start, lower(regexp_extract(left(text, strpos(text, 'MORGA') - 1), '(\\S+\\s+){{0,5}}$', 0)) AS b FROM t)
    SELECT id, CAST(start AS INTEGER) AS start, CASE WHEN {" OR ".join(f"contains(b, '{p.replace(chr(39), chr(39) * 2)}')" for p in catalogue.PHRASES["UK_DRIVING_LICENCE"])} THEN CAST(0.85 AS DOUBLE) ELSE 0.5 END AS score FROM f""")
def licence_phrases(spark, sf_dir):
    df = spark.createDataFrame(_LICENCES, "id int, text string")
    found = detect.detect(F.col("text"), _CONFIG, "uk_only", ["UK_DRIVING_LICENCE"])
    return df.select("id", F.explode(found).alias("s")).select("id", "s.start", F.round("s.score", 6).alias("score"))


_GREY = [(1, [200] * 64), (2, [0, 255] * 32), (3, [200] * 60 + [204] * 4), (4, [200] * 32 + [206] * 32), (5, [])]


@query(f"""WITH g(id, p) AS (VALUES {", ".join(f"({i}, CAST({p} AS INTEGER[]))" for i, p in _GREY)}) SELECT id, COALESCE(list_stddev_pop(p), 0) < 2 AS blank FROM g""")
def blank_pages(spark, sf_dir):
    return spark.createDataFrame(_GREY, "id int, p array<int>").select("id", boxes.is_blank(F.col("p")).alias("blank"))


_PASS1, _PASS2 = [(1, 0, "one"), (1, 1, "two"), (2, 0, "x")], [(1, 0, "eins"), (3, 0, "drei"), (1, 1, "zwei")]


@query(f"""WITH a(page_id, line_no, text) AS (VALUES {", ".join(map(str, _PASS1))}), b(page_id, line_no, text) AS (VALUES {", ".join(map(str, _PASS2))}), u AS (SELECT *, 0 AS k FROM a UNION ALL SELECT *, 1 FROM b)
    SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY k, line_no) - 1 AS INTEGER) AS line_no, text FROM u""")
def joined_passes(spark, sf_dir):
    df = lambda rows: spark.createDataFrame(rows, "page_id int, line_no int, text string")
    return boxes.passes(df(_PASS1), df(_PASS2))


@query(f"SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '(?i){_RX['email']}') THEN 1 ELSE 0 END AS INTEGER) AS hit FROM documents WHERE contains(text, '@')")
def guarded_rows(spark, sf_dir):
    """Rows that pass the guard of the email pattern, and whether it matches them."""
    d = _docs(spark, sf_dir).where(F.col("text").contains("@"))
    found = detect.detect(F.col("text"), _CONFIG, "default", ["EMAIL"])
    return d.select("doc_id", F.least(F.size(found), F.lit(1)).alias("hit"))
