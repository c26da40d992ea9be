"""Queries over texts, paths and documents of properties."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trackweave.functions import numbers as N
from trackweave.functions import text as T
from trackweave.plans.sql import LINE, q
from trackweave.sources import fixtures as X


def q37_text_leak_scan(spark, sf):
    found = T.scan(X.lines(spark, sf))
    return found.select("doc_id", "line_no", "severity", "rule", F.substring(F.trim("line"), 1, 180).alias("preview"))


def _sql_pattern(p):
    return p.replace("'", "''")


Q37 = q(LINE, "SELECT doc_id, line_no, severity, rule, substr(trim(line, ' '), 1, 180) AS preview FROM lines, (VALUES " + ", ".join(f"('{s}', '{n}', '{_sql_pattern(p)}')" for s, n, p in [*T.SCAN_RULES, *T.DOCUMENT_RULES]) + ") AS rules(severity, rule, pattern) WHERE regexp_matches(line, pattern)")


def _paths(spark, sf):
    k = F.col("page_id")
    lead = F.when(k % 4 == 0, F.lit("C:\\Users\\someone\\clips\\")).when(k % 4 == 1, F.lit("D:/runtime/tmp/")).otherwise(F.lit("/data/public/"))
    return X.read(spark, sf, "pages").select("page_id", F.concat(lead, F.lit("frame_"), k.cast("string"), F.when(k % 3 == 0, "_youtube.mp4").when(k % 3 == 1, "_brightness_pca.csv").otherwise("_motion.png")).alias("path"))


PATHS = r"paths AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'C:\Users\someone\clips\' WHEN 1 THEN 'D:/runtime/tmp/' ELSE '/data/public/' END || 'frame_' || page_id || CASE page_id % 3 WHEN 0 THEN '_youtube.mp4' WHEN 1 THEN '_brightness_pca.csv' ELSE '_motion.png' END AS path FROM pages)"


def q38_sanitise_paths(spark, sf):
    return _paths(spark, sf).select("page_id", T.public_path(F.col("path")).alias("shown"))


Q38 = q(PATHS, r"SELECT page_id, CASE WHEN replace(path, '/', '\') LIKE '%C:\Users\%' OR replace(path, '/', '\') LIKE '%\runtime\%' THEN list_last(string_split(replace(path, '/', '\'), '\')) ELSE path END AS shown FROM paths")


def q39_fingerprint_dups(spark, sf):
    marked = X.read(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return marked.groupBy("sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


Q39 = "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1"


def q40_slug_unique_id(spark, sf):
    names = X.read(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_brand", "p_type").alias("name"))
    return T.unique_ids(names, "name", "p_partkey").select("p_partkey", "slug", "unique_id")


Q40 = """WITH s AS (SELECT p_partkey, coalesce(nullif(regexp_replace(regexp_replace(lower(p_brand || ' ' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'case') AS slug FROM part), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY p_partkey) AS r FROM s)
SELECT p_partkey, slug, CASE WHEN r = 1 THEN slug ELSE slug || '_' || CASE WHEN r < 10 THEN '0' || r ELSE CAST(r AS VARCHAR) END END AS unique_id FROM n"""


def q41_source_quality(spark, sf):
    return _paths(spark, sf).groupBy(T.source_quality(F.col("path")).alias("quality"), T.path_class(F.col("path")).alias("target")).agg(F.count("*").alias("n"), F.min("page_id").alias("first_page"))


Q41 = q(PATHS, """SELECT CASE WHEN path LIKE '%youtube%' THEN 'secondary_copy' ELSE 'unknown' END AS quality, CASE page_id % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'mixed' ELSE 'entity' END AS target, count(*) AS n, min(page_id) AS first_page FROM paths GROUP BY 1, 2""")


def q57_jsonl_progress(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("log: "), F.col("props"))).otherwise(F.concat(F.lit('{"stage":"'), F.col("event_type"), F.lit('","frame":'), k.cast("string"), F.lit(',"total":100}')))
    rows = X.read(spark, sf, "events").select("event_id", line.alias("line")).withColumn("doc", F.try_parse_json("line"))
    stage, frame = F.try_variant_get("doc", "$.stage", "string"), F.try_variant_get("doc", "$.frame", "int")
    kind = F.when(stage.isNotNull(), "progress").otherwise("log")
    return rows.groupBy(kind.alias("kind"), stage.alias("stage")).agg(F.count("*").alias("n"), F.round(F.avg(frame * 100 / F.lit(100.0)), 6).alias("mean_percent"), F.max(frame).alias("last_frame"))


Q57 = """WITH l AS (SELECT CASE WHEN event_type = 'error' THEN 'log: ' || props ELSE '{"stage":"' || event_type || '","frame":' || json_extract_string(props, '$.k') || ',"total":100}' END AS line FROM events), d AS (SELECT TRY_CAST(line AS JSON) AS doc FROM l)
SELECT CASE WHEN doc ->> 'stage' IS NOT NULL THEN 'progress' ELSE 'log' END AS kind, doc ->> 'stage' AS stage, count(*) AS n, round(avg(CAST(doc ->> 'frame' AS INTEGER) * 100 / 100.0), 6) AS mean_percent, max(CAST(doc ->> 'frame' AS INTEGER)) AS last_frame FROM d GROUP BY 1, 2"""


def q61_probe_fields(spark, sf):
    base = 97 + F.col("l_linenumber") % 26
    code = (base + F.shiftleft(base, 8) + F.lit(0x34 * 65536 + 0x76 * 16777216)).cast("int")
    rows = X.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", N.fourcc(code).alias("codec"), N.media_time(F.col("l_partkey"), F.col("l_suppkey") % 3).alias("seconds"))
    return rows.groupBy("codec").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"))


Q61 = "SELECT repeat(chr(CAST(97 + l_linenumber % 26 AS INTEGER)), 2) || '4v' AS codec, count(*) AS n, round(sum(CASE WHEN l_suppkey % 3 > 0 THEN l_partkey / (l_suppkey % 3) ELSE 0.0 END), 3) AS seconds FROM lineitem GROUP BY 1"


def q73_text_rules(spark, sf):
    rows = _paths(spark, sf)
    colour = F.coalesce(F.element_at(F.create_map(F.lit("light"), F.lit("amber"), F.lit("mixed"), F.lit("grey"), F.lit("entity"), F.lit("green")), T.path_class(F.col("path"))), F.lit("debug"))
    return rows.select(
        "page_id", T.frame_number(F.col("path")).alias("frame"), F.format_string("frame_%06d", "page_id").alias("padded"), colour.alias("colour"), F.when(F.col("page_id") % 5 != 0, F.format_string("%.3f s", F.col("page_id") / F.lit(8.0))).otherwise("not available").alias("shown")
    )


Q73 = q(PATHS, """SELECT page_id, page_id AS frame, 'frame_' || lpad(CAST(page_id AS VARCHAR), 6, '0') AS padded, CASE page_id % 3 WHEN 0 THEN 'debug' WHEN 1 THEN 'grey' ELSE 'green' END AS colour, CASE WHEN page_id % 5 <> 0 THEN printf('%.3f s', page_id / 8.0) ELSE 'not available' END AS shown FROM paths""")


def q80_turn_order(spark, sf):
    """Ordered steps of a case: each turn with the size of the one before and the running share of the case's text."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = X.read(spark, sf, "conversations").withColumn("size", F.length("text"))
    total = F.sum("size").over(Window.partitionBy("conv_id"))
    return rows.select("conv_id", "turn", "role", "size", F.coalesce(F.lag("size").over(w), F.lit(0)).alias("before"), F.round(F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total, 6).alias("share"))


Q80 = """SELECT conv_id, turn, role, CAST(length(text) AS INTEGER) AS size, CAST(coalesce(lag(length(text)) OVER w, 0) AS INTEGER) AS before, round(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / sum(length(text)) OVER (PARTITION BY conv_id), 6) AS share FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)"""

QUERIES = {k: v for k, v in list(globals().items()) if k.startswith("q") and k[1:3].isdigit()}
ORACLE_SQL = {k: globals()["Q" + k[1:3]] for k in QUERIES}
