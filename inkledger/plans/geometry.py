"""Queries of rules for glyphs, faces, blocks and reports; their inputs are put together from columns of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.functions import measures
from inkledger.operators import anomalies as an
from inkledger.operators import fonts, layout
from inkledger.operators import lines as ln
from inkledger.operators import quality as q
from inkledger.operators import segments as seg
from inkledger.plans.queries import _GLYPHS, _LINES, _ROWS, _glyphs, _rows
from inkledger.plans.registry import query
from inkledger.sources import files
from inkledger.sources import glyphs as gl
from inkledger.sources.files import table
from inkledger.sources.rounds import fresh_uri

#: A line of glyphs to each part: an equals sign with a digit that rises, marks with and without neighbours.
_RUNS = """SELECT p_partkey AS doc_id, 0 AS page_index, 0 AS line_no, CASE p_partkey % 3 WHEN 0 THEN concat('x=', p_size % 10) WHEN 1 THEN 'ab_' ELSE 'a_b' END AS text, p_partkey % 5 AS rise, p_partkey % 4 * 6 AS gap FROM part"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    rows = spark.sql(_RUNS).select("*", F.posexplode(F.split("text", "")).alias("pos", "unicode")).where("unicode <> ''")
    return rows.select("doc_id", "page_index", "line_no", F.col("pos").cast("long").alias("id"), "unicode", (5.0 * F.col("pos") + F.when(F.col("pos") == 2, F.col("gap")).otherwise(0)).alias("x"), F.when(F.col("pos") == 2, F.col("rise")).otherwise(0).cast("double").alias("y"), F.lit(10.0).alias("font_size"))


@query(f"SELECT doc_id, 2::BIGINT AS id, CAST(rise AS DOUBLE) AS rise FROM ({_RUNS}) WHERE text LIKE 'x=%' AND rise > 1.5")
def raised_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.raised_digits(_runs(spark, sf_dir))


@query(f"SELECT doc_id, CASE WHEN text = 'ab_' THEN 2 ELSE 1 END::BIGINT AS id FROM ({_RUNS}) WHERE (text = 'ab_' AND 5 + gap <= 14) OR (text = 'a_b' AND 5 + gap > 14)")
def split_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.split_marks(_runs(spark, sf_dir))


@query(f"""WITH {_ROWS}, r AS (SELECT doc_id, page_index, line_no, CASE WHEN line_no % 9 = 4 AND doc_id % 2 = 0 THEN text || '中' ELSE text END AS text FROM rows_), h AS (SELECT DISTINCT doc_id, page_index FROM r WHERE regexp_matches(text, '[\\x{{3400}}-\\x{{9FFF}}]'))
SELECT r.doc_id, r.page_index, CAST(r.line_no AS INTEGER) AS row FROM r JOIN h ON r.doc_id = h.doc_id AND r.page_index = h.page_index WHERE NOT regexp_matches(text, '[\\x{{3400}}-\\x{{9FFF}}]') AND contains(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'the') AND contains(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'an')""")
def untranslated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("text", F.when((F.col("row") % 9 == 4) & (F.col("doc_id") % 2 == 0), F.concat("text", F.lit("中"))).otherwise(F.col("text")))
    return an.untranslated(rows, ("the", "an")).select("doc_id", "page_index", "row")


_BLOCKS = "SELECT p_partkey, CAST(1 + p_partkey % 5 AS INTEGER) AS n, CAST(CASE p_partkey % 3 WHEN 0 THEN 306 - p_size WHEN 1 THEN 72 ELSE 100 END AS DOUBLE) AS l, CAST(CASE p_partkey % 3 WHEN 0 THEN 306 + p_size WHEN 1 THEN 540 ELSE 500 END AS DOUBLE) AS r, CAST(CASE p_partkey % 3 WHEN 2 THEN 20 WHEN 0 THEN p_partkey % 4 * 3 ELSE 0 END AS DOUBLE) AS step FROM part"


@query(f"""SELECT p_partkey, CASE WHEN n <= 4 AND abs((l + r) / 2 - 306) <= 10 AND abs((l + (n - 1) * step + r + CASE WHEN step < 20 THEN (n - 1) * step ELSE 0 END) / 2 - 306) <= 10 AND least(l, 612 - r - CASE WHEN step < 20 THEN (n - 1) * step ELSE 0 END) >= greatest(0.16 * 612, 40) THEN 'center'
  WHEN n >= 2 AND CASE WHEN step < 20 THEN (n - 1) * step ELSE 0 END <= 2.5 AND (n - 1) * step > 30 THEN 'end' ELSE 'start' END AS alignment FROM ({_BLOCKS})""")
def block_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    steps = F.sequence(F.lit(0), F.col("n") - 1)
    left, right = F.transform(steps, lambda i: F.col("l") + i * F.col("step")), F.transform(steps, lambda i: F.col("r") + F.when(F.col("step") < 20, i * F.col("step")).otherwise(0))
    return spark.sql(_BLOCKS).select("p_partkey", an.alignment(left, right, 612.0, F.col("n"), F.lit(10.0)).alias("alignment"))


@query("SELECT l_orderkey, l_linenumber, CAST(coalesce(500 + s_suppkey % 400, 1000) AS DOUBLE) AS width FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey % 2 = 0")
def glyph_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit("F").alias("font"), F.col("l_suppkey").alias("code"))
    listed = table(spark, sf_dir, "supplier").where("s_nationkey % 2 = 0").select(F.lit("F").alias("font"), F.col("s_suppkey").alias("code"), (500.0 + F.col("s_suppkey") % 400).alias("width"))
    return fonts.widths(codes, listed).select("l_orderkey", "l_linenumber", "width")


_FACES = ["CMMI10", "cmsy8", "ABCDEF+STIXGeneral", "Nimbus-Bold", "Nimbus-Italic", "CMBX12", "CMTI10", "CMTT9", "Courier-Oblique", "Heavy Display", "SemiBold", "Inconsolata", "LatinModernMath-Regular", "Helvetica", "", "Black-Italic"]
_FACE = "CASE p_partkey % 16 " + " ".join(f"WHEN {k} THEN '{f}'" for k, f in enumerate(_FACES)) + " END"


@query(f"""SELECT font, count(*) AS n, bool_or(regexp_matches(upper(font), 'CMMI|CMSY|CMEX|MSAM|MSBM|STIX|CAMBRIAMATH|LATINMODERNMATH|SYMBOL')) AS math, bool_or(regexp_matches(upper(font), 'COUR|CMTT|CONSOL|MONO')) AS mono, bool_or(regexp_matches(upper(font), 'BOLD|BLACK|CMB')) AS bold, bool_or(regexp_matches(upper(font), 'ITAL|OBLIQUE')) AS italic,
  bool_or(regexp_matches(upper(font), 'BOLD|CMBX|BLACK|HEAVY')) AS style_bold, bool_or(regexp_matches(upper(font), 'ITAL|OBLIQUE|CMTI|CMMI')) AS style_italic FROM (SELECT {_FACE} AS font FROM part) GROUP BY font""")
def face_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("font")
    rows = table(spark, sf_dir, "part").selectExpr(f"{_FACE} AS font").groupBy("font").agg(F.count("*").alias("n"))
    style = q.style_class(f)
    return rows.select("font", "n", q.face_is(f, q.MATH_FACES).alias("math"), q.face_is(f, q.MONO_FACES).alias("mono"), q.face_is(f, q.BOLD_FACES).alias("bold"), q.face_is(f, q.ITALIC_FACES).alias("italic"), style["bold"].alias("style_bold"), style["italic"].alias("style_italic"))


@query("""WITH m AS (SELECT p_partkey, CAST(p_size % 5 AS DOUBLE) AS a, CAST(p_size % 7 AS DOUBLE) AS b, CAST(p_partkey % 3 AS DOUBLE) AS c, CAST(p_partkey % 4 AS DOUBLE) AS d, 2.0::DOUBLE AS e, 3.0::DOUBLE AS f FROM part)
SELECT p_partkey, a * a + b * c || ' ' || (a * b + b * d) || ' ' || (c * a + d * c) || ' ' || (c * b + d * d) || ' ' || (e * a + f * c + e) || ' ' || (e * b + f * d + f) AS squared, abs(b) > 1 AND abs(c) > 1 AND abs(a) <= 0.25 * abs(b) AND abs(d) <= 0.25 * abs(c) AS sideways FROM m""")
def matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.array(*[c.cast("double") for c in (F.col("p_size") % 5, F.col("p_size") % 7, F.col("p_partkey") % 3, F.col("p_partkey") % 4, F.lit(2), F.lit(3))])
    rows = table(spark, sf_dir, "part").select("p_partkey", m.alias("m"))
    return rows.select("p_partkey", F.array_join(F.transform(measures.multiply(F.col("m"), F.col("m")), lambda v: v.cast("string")), " ").alias("squared"), measures.sideways(F.col("m")).alias("sideways"))


@query("""SELECT p_partkey, CAST(least(greatest(p_size / 10.0, 1.25), 2.2) AS DOUBLE) AS leading, CASE WHEN p_partkey % 3 = 0 AND p_partkey % 2 = 1 THEN 2.0 ELSE 0.0 END::DOUBLE AS indent FROM part""")
def line_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.when(F.col("p_partkey") % 3 == 0, "body").otherwise("title")
    return table(spark, sf_dir, "part").select("p_partkey", layout.leading_scale(F.col("p_size") / 10.0).alias("leading"), layout.indent(level, F.col("p_partkey") % 2 == 0).alias("indent"))


@query("""WITH t AS (SELECT conv_id, list_sort(list(CAST(length(text) AS BIGINT))) AS s FROM conversations GROUP BY conv_id), m AS (SELECT conv_id, s, s[len(s) // 2 + 1] AS m FROM t)
SELECT conv_id, list_sort(list_transform(s, lambda v: abs(v - m)))[len(s) // 2 + 1] AS deviation FROM m""")
def median_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.length("text").cast("long")).alias("sizes"))
    return rows.select("conv_id", measures.median_deviation(F.col("sizes")).alias("deviation"))


@query(f"""WITH {_GLYPHS}, g AS (SELECT doc_id, page_index, id, unicode, CASE WHEN doc_id % 4 = 1 AND pos >= 30 THEN x + 200 ELSE x END AS x, y FROM seen),
w AS (SELECT *, CASE WHEN abs(y - lag(y) OVER o) <= 2 AND x - (lag(x) OVER o + 5) BETWEEN -10 AND 24 THEN 0 ELSE 1 END AS new FROM g WINDOW o AS (PARTITION BY doc_id, page_index ORDER BY y DESC, x, id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page_index ORDER BY y DESC, x, id) AS island FROM w)
SELECT doc_id, CAST(page_index AS INTEGER) AS page_index, CAST(island AS BIGINT) AS island, md5(string_agg(unicode, '' ORDER BY x, id)) AS text, count(*) AS n_glyphs, min(x) AS x0, max(x) + 5 AS x1 FROM i GROUP BY ALL""")
def ink_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when((F.col("doc_id") % 4 == 1) & (F.col("pos") >= 30), 200.0).otherwise(0.0)
    shown = _glyphs(spark, sf_dir).where(F.trim("unicode") != "").withColumns({c: F.col(c) + moved for c in ("x", "x0", "x1")})
    return ln.ink_lines(shown).withColumn("text", F.md5("text"))


_REPORTS = """SELECT doc_id, source, CASE WHEN doc_id % 17 = 3 THEN 'error' WHEN doc_id % 23 = 5 THEN 'panic' WHEN doc_id % 29 = 7 THEN 'missing' ELSE 'ok' END AS status, n_chars AS glyphs, n_chars % 7 AS unmapped, doc_id % 5 <> 0 AS text_match, doc_id % 3 AS style_mismatches, CAST(doc_id % 2 AS DOUBLE) AS shift,
  CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 100 AS DOUBLE) / 128 END AS ours, CASE WHEN doc_id % 6 > 0 THEN CAST(doc_id % 64 AS DOUBLE) / 64 END AS theirs FROM documents"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "documents").createOrReplaceTempView("documents")
    return spark.sql(_REPORTS)


@query(f"""SELECT count(*) AS documents, count(*) FILTER (WHERE status = 'ok') AS extracted, count(*) FILTER (WHERE status IN ('error', 'missing')) AS open_failures, count(*) FILTER (WHERE status = 'panic') AS panics, CAST(sum(glyphs) AS BIGINT) AS glyphs, CAST(sum(unmapped) AS BIGINT) AS unmapped,
  count(*) FILTER (WHERE text_match) AS identity_text_matches, count(*) FILTER (WHERE style_mismatches = 0 AND shift = 0) AS identity_style_clean, round(avg(ours), 9) AS mean_ours_in_reference, round(avg(theirs), 9) AS mean_reference_in_ours FROM ({_REPORTS})""")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.corpus_summary(_reports(spark, sf_dir))
    return rows.withColumns({c: F.round(c, 9) for c in ("mean_ours_in_reference", "mean_reference_in_ours")})


@query(f"""SELECT row_number() OVER (ORDER BY count DESC, name) AS place, name, count FROM (SELECT source AS name, count(*) AS count FROM ({_REPORTS}) GROUP BY source)""")
def counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.sorted_counts(_reports(spark, sf_dir), "source").collect()  # a row to a source
    return spark.createDataFrame([(k, r.name, r["count"]) for k, r in enumerate(rows, 1)], "place long, name string, count long")


@query(f"""WITH s AS (SELECT source AS engine, ours, theirs FROM ({_REPORTS})), m AS (SELECT 'ours' AS metric, engine, avg(ours) AS mean FROM s GROUP BY engine UNION ALL SELECT 'theirs', engine, avg(theirs) FROM s GROUP BY engine),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY mean DESC, engine) AS k, count(*) OVER (PARTITION BY metric) AS n FROM m WHERE mean IS NOT NULL)
SELECT a.metric, a.engine AS best, round(a.mean, 9) AS mean, CAST(a.n AS INTEGER) AS engines, round(a.mean - b.mean, 9) AS lead FROM r a LEFT JOIN r b ON b.metric = a.metric AND b.k = 2 WHERE a.k = 1""")
def engine_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reports(spark, sf_dir).withColumnRenamed("source", "engine")
    return q.engine_comparison(rows, ["ours", "theirs"]).withColumns({c: F.round(c, 9) for c in ("mean", "lead")})


@query("SELECT text AS source, 'b' || min(doc_id) AS translated FROM documents WHERE doc_id % 3 = 0 GROUP BY text UNION ALL SELECT text, 'a' || min(doc_id) FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE doc_id % 3 = 0) GROUP BY text")
def checkpoint_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), fresh_uri(spark, "checkpoint")
    pairs = lambda rows, mark: rows.groupBy(F.col("text").alias("source")).agg(F.concat(F.lit(mark), F.min("doc_id").cast("string")).alias("translated"))
    files.append_checkpoint(pairs(docs, "a"), path)
    files.append_checkpoint(pairs(docs.where("doc_id % 3 = 0"), "b"), path)
    return files.checkpoint(spark, path)


@query(f"""WITH RECURSIVE {_LINES}, s AS (SELECT doc_id, line_no, line, length(line) + 9 AS extra, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS k FROM lines WHERE trim(line) <> ''),
p AS (SELECT doc_id, k, line_no, line, 0 AS request, 1 AS n, extra AS used FROM s WHERE k = 1
  UNION ALL SELECT s.doc_id, s.k, s.line_no, s.line, CASE WHEN n >= 8 OR used + extra > 1500 THEN request + 1 ELSE request END, CASE WHEN n >= 8 OR used + extra > 1500 THEN 1 ELSE n + 1 END, CASE WHEN n >= 8 OR used + extra > 1500 THEN extra ELSE used + extra END FROM p JOIN s ON s.doc_id = p.doc_id AND s.k = p.k + 1)
SELECT doc_id, request, string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY k) AS ids, md5(string_agg(line, chr(10) || 'XPHSEPX' || chr(10) ORDER BY k)) AS payload, CAST(count(*) AS INTEGER) AS n_back FROM p GROUP BY doc_id, request""")
def packed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gl.lines(table(spark, sf_dir, "documents")).where("trim(line) <> ''").select("doc_id", F.col("line_no").alias("id"), F.col("line").alias("text"))
    back = seg.unpacked(F.lower("payload"), F.size("ids"))
    return seg.packed_requests(rows).select("doc_id", "request", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"), F.md5("payload").alias("payload"), F.size(back).alias("n_back"))


@query(f"""WITH {_ROWS}, w AS (SELECT doc_id, page_index, x AS x0, x + width AS x1 FROM rows_ WHERE width >= 120)
SELECT doc_id, page_index, CAST(list_sort(list(x0))[count(*) // 2 + 1] AS DOUBLE) AS "left", CAST(list_sort(list(x1))[count(*) // 2 + 1] AS DOUBLE) AS "right" FROM w GROUP BY ALL HAVING count(*) >= 3 AND list_sort(list(x1))[count(*) // 2 + 1] - list_sort(list(x0))[count(*) // 2 + 1] > 80""")
def column_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return an.column_span(_rows(spark, sf_dir).select("doc_id", "page_index", "size", F.col("x").alias("x0"), (F.col("x") + F.col("width")).alias("x1")))
