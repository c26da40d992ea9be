"""Common table expressions of the DuckDB twins, the adapters of sources.fixtures in SQL."""

TRACK = """
ev AS (SELECT user_id AS case_id, CAST(floor((epoch_us(ts) - 1704067200000000) / 60000000.0) AS BIGINT) AS frame, event_id, value, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
ev1 AS (SELECT *, row_number() OVER (PARTITION BY case_id, frame ORDER BY event_id) AS rn FROM ev),
track AS (SELECT case_id, frame, value AS cx, CAST(k AS DOUBLE) AS cy, CASE event_type WHEN 'view' THEN 'tracked' WHEN 'click' THEN 'TRACKING_ACTIVE' WHEN 'purchase' THEN 'auto_recovered' WHEN 'signup' THEN 'LOW_CONFIDENCE' WHEN 'error' THEN 'TRACK_LOST' END AS status,
  1 - least(value, 500.0) / 500 AS confidence, CAST(floor(value) AS INTEGER) AS x, k AS y, 8 + k % 24 AS w, 6 + k % 18 AS h FROM ev1 WHERE rn = 1),
valid AS (SELECT * FROM track WHERE status IN ('TRACKING_ACTIVE', 'TRACKING ACTIVE', 'tracked', 'auto_recovered'))"""
SERIES = TRACK + """,
steps AS (SELECT *, row_number() OVER w AS rn, lag(cx) OVER w AS px, lag(cy) OVER w AS py, lag(frame) OVER w AS pf FROM valid WINDOW w AS (PARTITION BY case_id ORDER BY frame)),
moved AS (SELECT *, CASE WHEN pf IS NULL THEN 0.0 ELSE sqrt((cx - px) * (cx - px) + (cy - py) * (cy - py)) / greatest(1, frame - pf) END AS velocity FROM steps),
motion AS (SELECT *, CASE WHEN pf IS NULL THEN 0.0 ELSE (velocity - lag(velocity) OVER (PARTITION BY case_id ORDER BY frame)) / greatest(1, frame - pf) END AS acceleration FROM moved)"""
PATCH = """
patch AS (SELECT vec_id % 4 AS case_id, vec_id AS frame, (['object', 'near_background', 'far_background', 'compression_noise', 'random_background', 'hud_artifact', 'dark_region', 'bright_region'])[label + 1] AS class_label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
pixel AS (SELECT case_id, frame, class_label, unnest(range(0, 64)) AS pos, unnest(v) AS val FROM patch)"""
CANDIDATE = """
candidate AS (SELECT l_orderkey AS frame, (l_linenumber, l_partkey, l_suppkey, l_extendedprice, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S')) AS ord, l_tax / 2 AS overlap, l_discount / 10 AS artifact_ratio, (l_partkey % 100) / 100 AS edge_score, l_extendedprice / 2000 AS texture, l_quantity * 5 AS luminance FROM lineitem)"""
BOX = """
box AS (SELECT l_orderkey AS frame, l_linenumber AS n, CAST(l_partkey % 640 - 20 AS INTEGER) AS x, CAST(l_suppkey % 360 - 20 AS INTEGER) AS y, CAST(trunc(l_quantity) AS INTEGER) AS w, CAST(l_linenumber * 8 AS INTEGER) AS h, l_returnflag = 'R' AS returned FROM lineitem)"""
CASE = """
cases AS (SELECT o_orderkey AS case_id, o_totalprice / 10000 AS duration, CAST(o_custkey % 5 * 320 AS INTEGER) AS width, CAST(o_custkey % 4 * 180 AS INTEGER) AS height, o_orderstatus AS quality, o_orderpriority AS hint, CAST(o_custkey % 30 AS DOUBLE) AS motion, (o_orderkey % 25) / 100.0 AS saturated, CAST(o_orderkey % 50 AS DOUBLE) AS contrast FROM orders)"""
LINE = """
lines AS (SELECT doc_id, p AS line_no, w[p] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS w, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS p FROM documents))"""
MODULE = """
own AS (SELECT o_custkey, count(*) AS n, sum(o_orderkey % 101) AS s, max(o_orderkey % 97) AS m FROM orders GROUP BY o_custkey),
module AS (SELECT c_custkey AS case_id, n, (s % 11) / 10.0 AS motion, (s % 7) / 6.0 AS stability, (m % 13) / 12.0 AS spectral, (s % 17) / 16.0 / 5 AS thermal, (m % 19) / 18.0 AS controls, (s % 23) / 22.0 AS pca, (m % 29) / 28.0 AS anomaly, CAST(m % 6 AS DOUBLE) AS max_z FROM customer LEFT JOIN own ON c_custkey = o_custkey)"""

FRAME = """
vecs AS (SELECT vec_id // 25 AS frame, CAST(vec_id % 25 AS INTEGER) AS block, [CAST(floor(CAST(x AS DOUBLE) * 10000 + 0.5) AS BIGINT) FOR x IN embedding] AS v FROM embeddings),
based AS (SELECT *, floor(list_sum(v[1:21]) * 4000 / 210000.0) AS bb, floor(list_sum(v[22:42]) * 4000 / 210000.0) AS bg, floor(list_sum(v[43:63]) * 4000 / 210000.0) AS br FROM vecs),
tex AS (SELECT frame, block, bb, bg, br, unnest(range(0, 64)) AS p, unnest(v) AS t FROM based),
painted AS (SELECT frame, (block // 5) * 8 + p // 8 AS y, (block % 5) * 8 + p % 8 AS x, greatest(0, least(255, 128 + bb + floor(t * 150 / 10000.0))) AS b, greatest(0, least(255, 128 + bg + floor(t * 150 / 10000.0))) AS g, greatest(0, least(255, 128 + br + floor(t * 150 / 10000.0))) AS r FROM tex),
places AS (SELECT frame, k // 40 AS y, k % 40 AS x FROM (SELECT DISTINCT frame FROM vecs), (SELECT unnest(range(0, 1600)) AS k)),
px AS (SELECT frame % 3 AS case_id, frame, y, x, CAST(coalesce(b, 0) AS INTEGER) AS b, CAST(coalesce(g, 0) AS INTEGER) AS g, CAST(coalesce(r, 0) AS INTEGER) AS r FROM places LEFT JOIN painted USING (frame, y, x)),
gray AS (SELECT *, (b * 1868 + g * 9617 + r * 4899 + 8192) // 16384 AS v FROM px)"""


def q(ctes: str, body: str) -> str:
    return f"WITH {ctes.strip()}{body}" if body.lstrip().startswith(",") else f"WITH {ctes.strip()}\n{body}"
