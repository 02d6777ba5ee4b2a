"""Queries on page layout. The items, lines and images are placed from the words and lines of all documents."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import functions as F

from quirefold.operators import layout as ly
from quirefold.plans import inputs, sql
from quirefold.plans.registry import query
from quirefold.session import kept_together, materialize

c = sql.compose


def by_page(make):
    """A query whose rows are dealt by page once: all its written tables, and so its steps, keep them where they lie."""

    @wraps(make)
    def run(spark, sf):
        with kept_together(spark, ly.PAGE):
            return materialize(make(spark, sf), make.__name__)

    return run

sql.CTES["qitems"] = ([], """words AS (SELECT doc_id, w - 1 AS w, str FROM (SELECT doc_id, unnest(ws) AS str, generate_subscripts(ws, 1) AS w FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM documents)) WHERE str <> ''),
placed AS (SELECT *, w % 400 // 10 AS r, w % 10 AS k, doc_id % 2 = 0 AS dual FROM words),
items AS MATERIALIZED (SELECT doc_id, CAST(w // 400 + 1 AS INTEGER) AS page, w AS item_no, str, CAST(CASE WHEN dual AND r % 10 = 9 AND k = 0 THEN 250 WHEN dual AND k >= 5 THEN 330 + (k - 5) * 50 ELSE 40 + k * 50 END AS DOUBLE) AS x,
 CAST(CASE WHEN dual AND r % 10 = 9 AND k = 0 THEN 100 ELSE 40 END AS DOUBLE) AS w, CAST(780 - r * 15 + CASE WHEN doc_id % 3 = 0 THEN k % 4 * 1.5 ELSE k % 3 END AS DOUBLE) AS y, CAST(CASE WHEN r = 0 THEN 16 WHEN length(str) > 9 THEN 9 ELSE 12 END AS DOUBLE) AS h,
 CASE WHEN r = 0 THEN 'Serif-Bold' ELSE 'Serif' END AS font FROM placed),
heights AS MATERIALIZED (SELECT doc_id, page, hs[len(hs) // 2 + 1] AS main_h FROM (SELECT doc_id, page, list(h ORDER BY h) AS hs FROM items WHERE h > 0 GROUP BY ALL))""")
sql.CTES["rowed"] = (["qitems"], """ys AS (SELECT doc_id, page, y, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC) AS k FROM (SELECT DISTINCT doc_id, page, y FROM items)),
walked AS MATERIALIZED (WITH RECURSIVE st AS (SELECT doc_id, page, y, k, y AS row_y FROM ys WHERE k = 1 UNION ALL SELECT s.doc_id, s.page, n.y, n.k, CASE WHEN s.row_y - n.y < h.main_h * CAST(0.28 AS DOUBLE) THEN s.row_y ELSE n.y END
 FROM st s JOIN ys n ON n.doc_id = s.doc_id AND n.page = s.page AND n.k = s.k + 1 JOIN heights h ON h.doc_id = s.doc_id AND h.page = s.page) SELECT * FROM st),
rowed AS MATERIALIZED (SELECT i.*, w.row_y, row_number() OVER (PARTITION BY i.doc_id, i.page, w.row_y ORDER BY i.x, i.item_no) AS nth FROM items i JOIN walked w ON w.doc_id = i.doc_id AND w.page = i.page AND w.y = i.y)""")
sql.CTES["gutters"] = (["rowed"], """gaps AS (SELECT r.*, h.main_h, lag(x + w) OVER (PARTITION BY r.doc_id, r.page, row_y ORDER BY nth) AS pend, lag(x) OVER (PARTITION BY r.doc_id, r.page, row_y ORDER BY nth) AS px FROM rowed r JOIN heights h ON h.doc_id = r.doc_id AND h.page = r.page),
wide AS (SELECT doc_id, page, list((pend + x) / 2 ORDER BY (pend + x) / 2) AS cs FROM gaps WHERE x - pend > main_h * CAST(1.8 AS DOUBLE) AND (pend + x) / 2 > 210 AND (pend + x) / 2 < 390 GROUP BY doc_id, page),
gutters AS MATERIALIZED (SELECT r.doc_id, r.page, r.n_rows, coalesce(len(cs), 0) AS n_gutters, cs[len(cs) // 2 + 1] AS cut, coalesce(len(cs), 0) >= 6 AND coalesce(len(cs), 0) >= r.n_rows * 0.35 AS dual FROM (SELECT doc_id, page, count(DISTINCT row_y) AS n_rows FROM rowed GROUP BY ALL) r LEFT JOIN wide w ON w.doc_id = r.doc_id AND w.page = r.page)""")
sql.CTES["columned"] = (["gutters"], """rowfacts AS (SELECT g.doc_id, g.page, g.row_y, any_value(q.cut) AS cut, bool_or(coalesce(x - pend > main_h * 1.5 AND x > cut AND px < cut, false)) AS gap, bool_or(x < cut - 5 AND x + w > cut + 5) AS spans, min(x) < any_value(cut) - 5 AND max_by(x + w, nth) > any_value(cut) + 5 AS crosses
 FROM gaps g JOIN gutters q ON q.doc_id = g.doc_id AND q.page = g.page AND q.dual GROUP BY g.doc_id, g.page, g.row_y),
columned AS MATERIALIZED (SELECT r.*, CASE WHEN f.cut IS NULL THEN '' WHEN spans OR (crosses AND NOT gap) THEN 'full' WHEN x >= cut THEN '1' ELSE '0' END AS col FROM rowed r LEFT JOIN rowfacts f ON f.doc_id = r.doc_id AND f.page = r.page AND f.row_y = r.row_y)""")
sql.CTES["based"] = (["qitems"], """srt AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, item_no) AS k FROM items),
based AS MATERIALIZED (WITH RECURSIVE st AS (SELECT doc_id, page, item_no, k, y AS cy, h AS ch, 1 AS line FROM srt WHERE k = 1
 UNION ALL SELECT doc_id, page, item_no, k, CASE WHEN new OR h > ch THEN y ELSE cy END, CASE WHEN new OR h > ch THEN h ELSE ch END, line + CASE WHEN new THEN 1 ELSE 0 END FROM (
 SELECT s.doc_id, s.page, n.item_no, n.k, n.y, n.h, s.cy, s.ch, s.line, abs(n.y - s.cy) > greatest(CAST(1.6 AS DOUBLE), CAST(0.34 AS DOUBLE) * greatest(n.h, s.ch)) AS new FROM st s JOIN srt n ON n.doc_id = s.doc_id AND n.page = s.page AND n.k = s.k + 1)) SELECT * FROM st),
lined AS MATERIALIZED (SELECT b.doc_id, b.page, b.line, i.item_no, i.str, i.x, i.w, i.h, i.font, (last_value(b.cy) OVER w) AS ly, (last_value(b.ch) OVER w) AS lh, h.main_h FROM based b JOIN items i ON i.doc_id = b.doc_id AND i.item_no = b.item_no JOIN heights h ON h.doc_id = b.doc_id AND h.page = b.page
 WINDOW w AS (PARTITION BY b.doc_id, b.page, b.line ORDER BY b.k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))""")
sql.CTES["rendered"] = (["based"], """chained AS (SELECT *, x - lag(x + w) OVER p AS gap FROM lined WINDOW p AS (PARTITION BY doc_id, page, line ORDER BY x, item_no)),
celled AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > greatest(10, main_h * 1.1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line ORDER BY x, item_no) AS cell FROM chained),
rendered AS (SELECT doc_id, page, ly AS y, any_value(lh) AS h, trim(regexp_replace(string_agg(CASE WHEN gap > greatest(1, 0.22 * main_h) THEN ' ' ELSE '' END || str, '' ORDER BY x, item_no), ' {2,}', ' ', 'g')) AS text, string_agg(str, '' ORDER BY x, item_no) AS plain, min(x) AS x0, max(x + w) AS x1, bool_or(font = 'Serif-Bold') AS bold, line FROM celled GROUP BY doc_id, page, line, ly),
cells AS (SELECT doc_id, page, ly AS y, CAST(cell AS BIGINT) AS cell, min(x) AS x, max_by(x + w, x) AS x1, string_agg(str, '' ORDER BY x, item_no) AS text FROM celled GROUP BY doc_id, page, line, ly, cell)""")


@query("P1_upper_median", c("qitems", "SELECT doc_id, page, main_h FROM heights"))
def upper_median(spark, sf):
    return ly.main_height(inputs.items(spark, sf))


@query("P2_thin_rules", "SELECT doc_id, x1, y1 FROM (SELECT doc_id, CAST(n_chars % 20 AS DOUBLE) AS x1, CAST(doc_id % 9 AS DOUBLE) AS y1 FROM documents) WHERE x1 >= 8 AND y1 <= 4")
def thin_rules(spark, sf):
    r = inputs.table(spark, sf, "documents").select("doc_id", F.lit(0.0).alias("x0"), (F.col("n_chars") % 20).cast("double").alias("x1"), F.lit(0.0).alias("y0"), (F.col("doc_id") % 9).cast("double").alias("y1"))
    return ly.thin_rules(r).select("doc_id", "x1", "y1")


def _rowed(spark, sf, *also):
    # Columns are found from places and sizes: every item is shuffled several times, and texts and fonts stay behind.
    items = materialize(inputs.page_items(spark, sf).drop("str", "font"), "items")
    heights = materialize(ly.main_height(items), "main_heights")
    rows = ly.row_cluster(items, heights).select(*ly.PAGE, "item_no", "x", "w", "page_width", "row_y", *also)
    # Both gutters and columns look at neighbours in a row, so these are found and written once.
    return materialize(ly.row_chain(rows), "chains"), heights


@query("P3_row_cluster", c("rowed", "SELECT doc_id, page, item_no, row_y FROM rowed"))
def row_cluster(spark, sf):
    return ly.row_cluster(materialize(inputs.items(spark, sf), "items")).select("doc_id", "page", "item_no", "row_y")


@query("P4_gutters", c("gutters", "SELECT doc_id, page, n_rows, n_gutters, coalesce(cut, -1) AS cut, dual FROM gutters"))
@by_page
def gutters(spark, sf):
    return ly.gutters(*_rowed(spark, sf)).withColumn("cut", F.coalesce("cut", F.lit(-1.0)))


def _columned(spark, sf, *also):
    rowed, heights = _rowed(spark, sf, *also)
    # One row a page, written: the plan that deals out the items stays small.
    return ly.assign_column(rowed, heights, materialize(ly.gutters(rowed, heights), "pages"))


@query("P5_assign_column", c("columned", "SELECT doc_id, page, item_no, col FROM columned"))
@by_page
def assign_column(spark, sf):
    return _columned(spark, sf).select("doc_id", "page", "item_no", F.coalesce("col", F.lit("")).alias("col"))


# Items stand for lines here: an order over the columns of P5.
_SIDED = """sided AS (SELECT *, item_no AS line_no, CASE WHEN col = '0' OR (col = '' AND x + w < 310) THEN 0 WHEN col = '1' OR (col = '' AND x > 290) THEN 1 ELSE 2 END AS side FROM columned),
pg AS (SELECT doc_id, page, count(*) FILTER (side = 0) < 4 OR count(*) FILTER (side = 1) < 4 AS plain FROM sided GROUP BY ALL),
keyed AS (SELECT s.*, p.plain, CASE WHEN side = 2 THEN row_number() OVER (PARTITION BY s.doc_id, s.page ORDER BY CASE WHEN side = 2 THEN 0 ELSE 1 END, y DESC, line_no) END AS fullrank FROM sided s JOIN pg p ON p.doc_id = s.doc_id AND p.page = s.page),
banded AS (SELECT k.*, CASE WHEN side = 2 THEN fullrank - 1 ELSE (SELECT count(*) FROM keyed f WHERE f.doc_id = k.doc_id AND f.page = k.page AND f.side = 2 AND f.y >= k.y) END AS above FROM keyed k)
SELECT doc_id, page, line_no, CAST(row_number() OVER (PARTITION BY doc_id, page ORDER BY CASE WHEN plain THEN 0 ELSE above * 2 + CASE WHEN side = 2 THEN 1 ELSE 0 END END, CASE WHEN plain OR side = 2 THEN 0 ELSE side END, y DESC, CASE WHEN plain THEN x ELSE 0 END, line_no) AS INTEGER) AS place FROM banded"""


@query("P6_reading_order", c("columned", "SELECT * FROM (WITH " + _SIDED + ")"))
@by_page
def reading_order(spark, sf):
    lines = materialize(_columned(spark, sf, "y").select("doc_id", "page", F.col("item_no").alias("line_no"), F.col("x").alias("x0"), (F.col("x") + F.col("w")).alias("x1"), "y", "col", "page_width"), "lines")
    placed = ly.line_places(materialize(ly.reading_order(lines), "ordered"))
    return placed.select("doc_id", "page", "line_no", (F.col("place") + 1).cast("int").alias("place"))


def _based(spark, sf):
    parts = materialize(inputs.parts(spark, sf).drop("x", "w", "page_width"), "parts")
    return ly.baseline_rows(parts), ly.main_height(parts)


@query("P7_baseline_rows", c("based", "SELECT doc_id, page, item_no, ly AS line_y, lh AS line_h FROM lined"))
@by_page
def baseline_rows(spark, sf):
    parts = inputs.parts(spark, sf).select("doc_id", "page", "item_no", "x0", "x1", "y", "h")
    return ly.baseline_rows(materialize(parts, "parts")).select("doc_id", "page", "item_no", "line_y", "line_h")


_LINE_KEYS = ["doc_id", "page", "band", "line"]


@query("P8_render_row", c("rendered", "SELECT doc_id, page, y, h, text, x0, x1, bold FROM rendered WHERE text <> ''"))
@by_page
def render_row(spark, sf):
    return ly.render_rows(*_based(spark, sf), _LINE_KEYS).select("doc_id", "page", "y", "h", "text", "x0", "x1", "bold")


@query("P9_split_cells", c("rendered", "SELECT doc_id, page, y, cell - 1 AS cell, x, x1, text FROM cells"))
@by_page
def split_cells(spark, sf):
    r = ly.render_rows(*_based(spark, sf), _LINE_KEYS)
    return r.select("doc_id", "page", "y", F.posexplode("cells").alias("n", "c")).select("doc_id", "page", "y", F.col("n").cast("long").alias("cell"), "c.x", "c.x1", "c.text")


_FORM = "CASE n % 5 WHEN 0 THEN 'E=mc^2+' || n WHEN 1 THEN '结论x=1' WHEN 2 THEN '\\frac{a}{b}' WHEN 3 THEN str || '=' || str ELSE str END"


@query("P10_is_math_row", c("qitems", f"""SELECT doc_id, item_no, t AS text, CASE WHEN length(t) = 0 THEN false WHEN han / CAST(length(t) AS DOUBLE) > 0.22 THEN false WHEN contains(t, '\\frac') THEN true WHEN han >= 2 THEN false
 ELSE (length(t) - length(regexp_replace(t, '[0-9A-Za-z_^()\\[\\]{{}}=+\\-*/<>.,]', '', 'g'))) / CAST(length(t) AS DOUBLE) > 0.75 AND regexp_matches(t, '[=≥≤≠≈±×÷∑∏∫√^_]') END AS math
 FROM (SELECT doc_id, item_no, t, length(t) - length(regexp_replace(t, '[一-鿿]', '', 'g')) AS han FROM (SELECT doc_id, item_no, {_FORM} AS t FROM (SELECT *, item_no AS n FROM items)))"""))
def is_math_row(spark, sf):
    n = F.col("item_no")
    t = F.when(n % 5 == 0, F.concat(F.lit("E=mc^2+"), n.cast("string"))).when(n % 5 == 1, "结论x=1").when(n % 5 == 2, "\\frac{a}{b}").when(n % 5 == 3, F.concat("str", F.lit("="), "str")).otherwise(F.col("str"))
    return inputs.items(spark, sf).select("doc_id", "item_no", t.alias("text")).withColumn("math", ly.is_math_row(F.col("text")))


@query("P11_drop_page_numbers", c("qitems", "SELECT doc_id, item_no, t AS text FROM (SELECT doc_id, item_no, y - 190 AS y, CASE item_no % 4 WHEN 0 THEN '- ' || item_no || ' -' WHEN 1 THEN CAST(item_no AS VARCHAR) ELSE str END AS t FROM items) WHERE NOT (y < 56 AND regexp_matches(t, '^\\s*[-–—]?\\s*[0-9]{1,4}\\s*[-–—]?\\s*$'))"))
def drop_page_numbers(spark, sf):
    n = F.col("item_no")
    t = F.when(n % 4 == 0, F.concat(F.lit("- "), n.cast("string"), F.lit(" -"))).when(n % 4 == 1, n.cast("string")).otherwise(F.col("str"))
    lines = inputs.items(spark, sf).select("doc_id", "item_no", (F.col("y") - 190).alias("y"), t.alias("text"), F.lit(800.0).alias("page_height"))
    return ly.drop_page_numbers(lines).select("doc_id", "item_no", "text")


# Lines as in inputs.lines, each page then read line by line as the rules say: every line is the first of a list line, a
# table, a formula group, a heading or a paragraph line, which tells the line where the next one is.
sql.CTES["plines"] = ([], """pwords AS (SELECT doc_id, w - 1 AS w, str FROM (SELECT doc_id, unnest(ws) AS str, generate_subscripts(ws, 1) AS w FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM documents)) WHERE str <> ''),
pw AS (SELECT doc_id, CAST(w // 8 AS BIGINT) AS n, list(str ORDER BY w) AS ws, CAST(any_value(w // 8 % 45) AS INTEGER) AS ln, any_value(w // 8 % 45) BETWEEN 26 AND 33 AS grid FROM pwords GROUP BY doc_id, w // 8),
pt AS (SELECT *, NOT grid AND n % 13 = 5 AS is_math, CASE WHEN NOT grid AND n % 13 = 5 THEN 'a = b + ' || n WHEN NOT grid AND n % 13 = 6 THEN 'x = y' WHEN NOT grid AND n % 13 = 4 THEN 'where E = mc' WHEN NOT grid AND n % 17 = 8 THEN array_to_string(ws, ' ') || ' ..... 12' WHEN NOT grid AND n % 5 = 1 THEN array_to_string(ws, ' ') || '-' ELSE array_to_string(ws, ' ') END AS text,
 CAST(CASE WHEN NOT grid AND ln % 7 = 3 THEN 54 ELSE 40 END AS DOUBLE) AS x0 FROM pw),
plines AS MATERIALIZED (SELECT doc_id, CAST(n // 45 + 1 AS INTEGER) AS page, n AS line_no, row_number() OVER (PARTITION BY doc_id, n // 45 ORDER BY n) - 1 AS i, text, x0, CAST(540 AS DOUBLE) AS x1, CAST(780 - ln * 15 - CASE WHEN grid THEN 0 ELSE ln // 6 * 10 END + CASE WHEN ln = 31 THEN 10 ELSE 0 END AS DOUBLE) AS y,
 CAST(CASE WHEN NOT grid AND ln % 15 = 14 THEN 15 ELSE 12 END AS DOUBLE) AS h, NOT grid AND ln % 11 = 10 AS bold, is_math, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN ln < 22 THEN '0' ELSE '1' END END AS col,
 CASE WHEN NOT grid THEN [{'x': CAST(x0 AS DOUBLE), 'x1': CAST(540 AS DOUBLE), 'text': text}] WHEN ln = 30 THEN [{'x': CAST(40 AS DOUBLE), 'x1': CAST(100 AS DOUBLE), 'text': W1}, {'x': CAST(200 AS DOUBLE), 'x1': CAST(260 AS DOUBLE), 'text': W2}] WHEN ln = 31 THEN [{'x': CAST(360 AS DOUBLE), 'x1': CAST(420 AS DOUBLE), 'text': W3}] ELSE [{'x': CAST(40 AS DOUBLE), 'x1': CAST(100 AS DOUBLE), 'text': W1}, {'x': CAST(200 AS DOUBLE), 'x1': CAST(260 AS DOUBLE), 'text': W2}, {'x': CAST(360 AS DOUBLE), 'x1': CAST(420 AS DOUBLE), 'text': W3}] END AS cells FROM pt)"""
    .replace("W1", "coalesce(ws[1], '-')").replace("W2", "coalesce(ws[2], '-')").replace("W3", "CASE WHEN ln > 26 THEN CAST(n AS VARCHAR) ELSE coalesce(ws[3], '-') END"))
_ROWS = "list_transform(rows, lambda r: list_transform(anchors, lambda a: array_to_string(list_transform(list_filter(r.c, lambda c: abs(c.x - a) < body * 1.2), lambda c: c.text), ' ')))"
_NUMBER = "regexp_matches(q, '^[-+]?[0-9]+(?:\\.[0-9]+)?%?$')"
sql.CTES["pread"] = (["plines"], f"""pbody AS (SELECT doc_id, page, coalesce(hs[len(hs) // 2 + 1], 10) AS body FROM (SELECT doc_id, page, list(h ORDER BY h) FILTER (h > 0) AS hs FROM plines GROUP BY ALL)),
pgap AS (SELECT b.doc_id, b.page, b.body, coalesce((list(g ORDER BY g) FILTER (g > body * 0.65 AND g < body * 4))[count(*) FILTER (g > body * 0.65 AND g < body * 4) // 2 + 1], b.body * 1.35) AS avg_gap
 FROM (SELECT doc_id, page, lag(y) OVER (PARTITION BY doc_id, page ORDER BY i) - y AS g FROM plines) l JOIN pbody b ON b.doc_id = l.doc_id AND b.page = l.page GROUP BY b.doc_id, b.page, b.body),
pflag AS MATERIALIZED (SELECT *, lead(is_math) OVER p AS next_math, y - lead(y) OVER p AS next_gap, (is_math OR neighbor) AND col IS NOT DISTINCT FROM lag(col) OVER p AND i > 0 AND lag(y) OVER p - y < avg_gap * 2.5 AS cont, count(*) OVER (PARTITION BY doc_id, page) AS n FROM (
 SELECT l.*, g.body, g.avg_gap, regexp_matches(text, '\\.{{4,}}|…{{3,}}|·{{5,}}') AS leader, NOT regexp_matches(text, '[一-鿿]{{2}}') AND length(text) < 160 AND regexp_matches(text, '[=≥≤∑∏∫√𝑎-𝑧𝛼-𝜔]|exp\\s*\\(') AS neighbor,
 NOT is_math AND len(cells) BETWEEN 1 AND 14 AND len(list_filter(cells, lambda c: length(c.text) > 60)) = 0 AND NOT regexp_matches(text, '[。；;!?！？]|\\.{{4,}}|…{{3,}}') AND NOT contains(text, '$') AS short,
 NOT is_math AND len(cells) BETWEEN 2 AND 14 AND x1 - x0 > body * 9 AND NOT regexp_matches(text, '\\.{{4,}}|…{{3,}}') AS candidate
 FROM plines l JOIN pgap g ON g.doc_id = l.doc_id AND g.page = l.page) WINDOW p AS (PARTITION BY doc_id, page ORDER BY i)),
prun AS (WITH RECURSIVE st AS (SELECT doc_id, page, i AS first, i AS j, y AS last_y, [{{'y': y, 'c': cells}}] AS rows FROM pflag WHERE candidate AND short
 UNION ALL SELECT doc_id, page, first, j, last_y, CASE WHEN same THEN list_concat(rows[1:len(rows) - 1], [{{'y': rows[len(rows)].y, 'c': list_concat(rows[len(rows)].c, cells)}}]) ELSE list_concat(rows, [{{'y': last_y, 'c': cells}}]) END FROM (
  SELECT s.doc_id, s.page, s.first, l.i AS j, l.y AS last_y, s.rows, l.cells, s.rows[len(s.rows)].y - l.y < l.body * 0.65 AND len(list_filter(l.cells, lambda c: len(list_filter(s.rows[len(s.rows)].c, lambda a: NOT (c.x >= a.x1 + 2 OR c.x1 <= a.x - 2))) > 0)) = 0 AS same
  FROM st s JOIN pflag l ON l.doc_id = s.doc_id AND l.page = s.page AND l.i = s.j + 1 JOIN pflag o ON o.doc_id = s.doc_id AND o.page = s.page AND o.i = s.first WHERE l.short AND l.col IS NOT DISTINCT FROM o.col AND s.last_y - l.y BETWEEN 0 AND l.avg_gap * 2.2)
  WHERE same OR len(cells) > 1) SELECT * FROM st),
ptab AS (SELECT *, list_sort(list_reduce(list_transform(flatten(list_transform(rows, lambda r: list_transform(r.c, lambda c: c.x))), lambda x: [x]), lambda known, x: CASE WHEN len(list_filter(known, lambda a: abs(a - x[1]) < body * 1.2)) > 0 THEN known ELSE list_concat(known, x) END)) AS anchors
 FROM (SELECT r.*, b.body FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, first ORDER BY j DESC) AS k FROM prun) r JOIN pbody b ON b.doc_id = r.doc_id AND b.page = r.page WHERE k = 1 AND len(rows) >= 3 AND len(list_filter(rows, lambda r: len(r.c) < 2)) = 0)),
pgrid AS MATERIALIZED (SELECT doc_id, page, first, j - first + 1 AS size, grid, len(list_filter(grid[1], lambda q: {_NUMBER})) = 0 AND len(list_filter(flatten(grid[2:]), lambda q: {_NUMBER})) > 0 AS header_row FROM (SELECT *, {_ROWS} AS grid FROM ptab
 WHERE len(anchors) <= 14 AND len(list_filter(anchors, lambda a: len(list_filter(rows, lambda r: len(list_filter(r.c, lambda c: abs(c.x - a) < body * 1.2)) > 0)) < 2)) = 0)),
pkind AS MATERIALIZED (SELECT *, CASE kind WHEN 'table' THEN i + size WHEN 'formula' THEN coalesce(stop, n) ELSE i + 1 END AS nxt FROM (SELECT f.*, t.size, t.grid, t.header_row, min(CASE WHEN NOT cont THEN i END) OVER (PARTITION BY f.doc_id, f.page ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop,
 CASE WHEN leader THEN 'list' WHEN t.size IS NOT NULL THEN 'table' WHEN is_math OR (neighbor AND next_math AND next_gap < avg_gap * 2.4) THEN 'formula'
 WHEN length(text) < 60 AND NOT regexp_matches(text, '[。．.,，;；]$') AND (regexp_matches(text, '^([0-9]+(?:\\.[0-9]+)+)\\s*\\S') OR regexp_matches(text, '^[一二三四五六七八九十]+[、．.]') OR ({sql.heading('text')} AND NOT regexp_matches(text, '^[0-9]+[.、]\\S')) OR h >= body * 1.16 OR bold) THEN 'heading' ELSE 'paragraph' END AS kind
 FROM pflag f LEFT JOIN pgrid t ON t.doc_id = f.doc_id AND t.page = f.page AND t.first = f.i)),
pwalk AS (WITH RECURSIVE st AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS i FROM pkind WHERE i = 0 UNION ALL SELECT k.doc_id, k.page, k.nxt FROM st s JOIN pkind k ON k.doc_id = s.doc_id AND k.page = s.page AND k.i = s.i) SELECT * FROM st),
pread AS MATERIALIZED (SELECT k.*, lag(k.kind) OVER p AS was, lag(k.nxt) OVER p - 1 AS prev FROM pwalk w JOIN pkind k ON k.doc_id = w.doc_id AND k.page = w.page AND k.i = w.i WINDOW p AS (PARTITION BY k.doc_id, k.page ORDER BY k.i))""")


@query("P12_table_runs", c("pread", "SELECT doc_id, page, line_no AS first_line, CAST(size AS INTEGER) AS n_lines, header_row, array_to_string(list_transform(grid, lambda r: array_to_string(r, ' | ')), chr(10)) AS text FROM pread WHERE kind = 'table'"))
def table_runs(spark, sf):
    lines = materialize(inputs.lines(spark, sf), "lines")
    t = ly.table_runs(ly.neighbours(lines), lines)
    return t.select("doc_id", "page", "first_line", "n_lines", "header_row", F.array_join(F.transform("cells", lambda r: F.array_join(r, " | ")), "\n").alias("text"))


_BLOCKS = f"""pstart AS (SELECT r.*, kind <> 'paragraph' OR was IS DISTINCT FROM 'paragraph' OR q.y - r.y > avg_gap * 1.6 OR q.y - r.y < -body OR q.col IS DISTINCT FROM r.col OR (r.x0 > q.x0 + body * 0.9 AND regexp_matches(q.text, '[。！？.!?；;:：]\\s*$')) AS opens
 FROM pread r LEFT JOIN (SELECT doc_id, page, i, y, col, x0, text FROM plines) q ON q.doc_id = r.doc_id AND q.page = r.page AND q.i = r.prev),
pnum AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY i) AS block FROM pstart),
pall AS (SELECT b.doc_id, b.page, b.block, b.kind, b.grid, b.header_row, b.body, b.i AS bi, l.* EXCLUDE (doc_id, page) FROM pnum b JOIN plines l ON l.doc_id = b.doc_id AND l.page = b.page AND l.i >= b.i AND l.i < b.nxt),
pjoin AS (SELECT doc_id, page, block, any_value(kind) AS kind, min(line_no) AS first_line, arg_min(y, line_no) AS y, any_value(body) AS body, arg_min(grid, line_no) AS grid, coalesce(bool_or(header_row), false) AS header_row, list(text ORDER BY line_no) AS ts, min(x0) AS x0, max(x1) AS x1, min(y - h * 0.45) AS y0, max(y + h * 1.35) AS y1 FROM pall GROUP BY doc_id, page, block),
ptext AS (SELECT *, CASE kind WHEN 'formula' THEN '$$' || array_to_string(ts, ' \\quad ') || '$$' WHEN 'table' THEN array_to_string(list_transform(grid, lambda r: array_to_string(r, ' | ')), chr(10)) ELSE
 list_reduce(ts, lambda a, b: CASE WHEN regexp_matches(right(a, 1), '[㐀-鿿]') AND regexp_matches(left(b, 1), '[㐀-鿿]') THEN a || b WHEN ends_with(a, '-') AND regexp_matches(b, '^[a-z]') THEN left(a, length(a) - 1) || b ELSE a || ' ' || b END) END AS t FROM pjoin),
ppiece AS (SELECT *, CASE WHEN kind = 'paragraph' THEN {sql.split_long(sql.trim('t'))} ELSE [t] END AS ps FROM ptext)
SELECT doc_id, page, first_line, CAST(part - 1 AS INTEGER) AS part, text, kind AS type, CASE WHEN kind = 'heading' THEN CAST(greatest(1, len(string_split(regexp_extract(t, '^([0-9]+(?:\\.[0-9]+)+)', 1), '.'))) AS INTEGER) ELSE 0 END AS level, y, x0, x1,
 y0 - CASE WHEN kind = 'formula' THEN body * 1.2 ELSE 0 END AS y0, y1 + CASE WHEN kind = 'formula' THEN body * 0.7 ELSE 0 END AS y1, header_row FROM (SELECT *, unnest(ps) AS text, generate_subscripts(ps, 1) AS part FROM ppiece)"""


@query("P13_lines_to_blocks", c("pread", "SELECT * FROM (WITH " + _BLOCKS + ")"))
@by_page
def lines_to_blocks(spark, sf):
    return ly.lines_to_blocks(materialize(inputs.lines(spark, sf), "lines"))


_IMAGES = """img AS (SELECT doc_id, CAST((n - 1) // 6 + 1 AS INTEGER) AS page, n - 1 AS image_no, 'k' || (length(line) % 50) AS key, length(line) % 300 AS width, length(line) % 170 + 20 AS height, CAST(length(line) * 37 % 800 AS DOUBLE) AS y FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))),
good AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY page, image_no) AS rn FROM img WHERE width >= 56 AND height >= 56 AND width * height >= 9000) WHERE rn = 1),
images AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, image_no) AS nth FROM good) WHERE nth <= 80)"""
sql.CTES["pimages"] = ([], _IMAGES)


@query("P14_usable_images", c("pimages", "SELECT doc_id, page, image_no, key, width, height FROM images"))
def usable_images(spark, sf):
    return ly.usable_images(inputs.images(spark, sf)).select("doc_id", "page", "image_no", "key", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"))


@query("P14_insert_images", c("pimages blocks", """SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, slot, k, down, n) - 1 AS idx, type, text, CASE WHEN k = 0 THEN n ELSE -1 END AS image_no FROM (
 SELECT doc_id, CAST(idx // 6 + 1 AS INTEGER) AS page, CAST(idx AS BIGINT) AS slot, 1 AS k, CAST(0 AS DOUBLE) AS down, CAST(0 AS BIGINT) AS n, type, text FROM blocks
 UNION ALL SELECT i.doc_id, i.page, coalesce((SELECT min(b.idx) FROM blocks b WHERE b.doc_id = i.doc_id AND b.idx // 6 + 1 = i.page AND 800 - b.idx % 6 * 130 + length(b.text) % 200 < i.y), 1099511627776), 0, -i.y, i.image_no, 'image', '［图片］' FROM images i)"""))
def insert_images(spark, sf):
    blocks = materialize(inputs.page_blocks(spark, sf), "blocks")
    images = materialize(ly.usable_images(inputs.images(spark, sf)), "images")
    return ly.insert_images(blocks, images)


@query("P15_parse_warnings", c("pimages blocks", """SELECT d.doc_id, CASE WHEN coalesce(b.ch, 0) < 30 THEN '未能从该 PDF 中提取到文字，可能是扫描件/纯图片 PDF。请先 OCR 后上传，或粘贴识别后的文字。' ELSE '共 ' || (d.filled + 2) || ' 页，其中 2 页未提取到文字（可能含图片/扫描页）。' END || CASE WHEN i.n > 0 THEN ' 已提取 ' || i.n || ' 张内嵌图片。' ELSE '' END AS warning
 FROM (SELECT docs.doc_id, coalesce(x.f, 0) AS filled FROM docs LEFT JOIN (SELECT doc_id, count(DISTINCT idx // 6) AS f FROM blocks GROUP BY doc_id) x ON x.doc_id = docs.doc_id) d LEFT JOIN (SELECT doc_id, sum(length(text)) AS ch FROM blocks GROUP BY doc_id) b ON b.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM images GROUP BY doc_id) i ON i.doc_id = d.doc_id"""))
def parse_warnings(spark, sf):
    b = materialize(inputs.page_blocks(spark, sf), "blocks")
    pages = b.groupBy("doc_id").agg((F.count_distinct("page") + 2).alias("pages"))
    docs = inputs.doc_meta(spark, sf).select("doc_id").join(pages, "doc_id", "left").withColumn("pages", F.coalesce("pages", F.lit(2)))
    return ly.parse_warnings(docs, b, ly.usable_images(inputs.images(spark, sf)))


# Words as Han text, of which many have raised marks: one on two of three words, too far off on every fifth, and a second
# one behind it on every sixth word.


def _marked(spark, sf):
    i = inputs.page_items(spark, sf)
    n, x = F.col("item_no"), F.col("x")
    part = lambda k, text, x0, x1, up, h: F.struct((n * 3 + k).alias("item_no"), text.alias("str"), x0.alias("x0"), x1.alias("x1"), (F.col("y") + up).alias("y"), F.lit(h).alias("h"))
    first = F.when(n % 3 != 0, part(1, F.concat(F.lit("["), n.cast("string"), F.lit("]")), (x + F.when(n % 5 == 0, 32).otherwise(22)).cast("double"), x + 26, 5, 8.0))
    second = F.when(n % 6 == 1, part(2, F.lit("[7]"), x + 27, x + 30, 5, 8.0))
    rows = F.array_compact(F.array(part(0, F.concat(F.lit("方法"), "str"), x, x + 20, 0, 12.0), first, second))
    return i.select("doc_id", "page", F.explode(rows).alias("r")).select("doc_id", "page", "r.*")


# The marks of a page attached one by one; the state of a page is the right edge of each of its texts.
_MARKS = """mparts AS MATERIALIZED (SELECT doc_id, page, item_no * 3 AS item_no, '方法' || str AS str, x AS x0, x + 20 AS x1, y, CAST(12 AS DOUBLE) AS h FROM items
 UNION ALL SELECT doc_id, page, item_no * 3 + 1, '[' || item_no || ']', x + CASE WHEN item_no % 5 = 0 THEN 32 ELSE 22 END, x + 26, y + 5, 8 FROM items WHERE item_no % 3 <> 0
 UNION ALL SELECT doc_id, page, item_no * 3 + 2, '[7]', x + 27, x + 30, y + 5, 8 FROM items WHERE item_no % 6 = 1),
mh AS (SELECT doc_id, page, hs[len(hs) // 2 + 1] AS m FROM (SELECT doc_id, page, list(h ORDER BY h) AS hs FROM mparts GROUP BY ALL)),
mkind AS (SELECT p.*, m, h >= m * 0.86 AS big FROM mparts p JOIN mh ON mh.doc_id = p.doc_id AND mh.page = p.page),
mbase AS MATERIALIZED (SELECT doc_id, page, any_value(m) AS m, list({'no': item_no, 'y': y} ORDER BY x0, item_no) AS bs, list(x1 ORDER BY x0, item_no) AS xs FROM mkind WHERE big AND regexp_matches(str, '[㐀-䶿一-鿿豈-﫿]') GROUP BY doc_id, page),
mmark AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY x0, item_no) AS k FROM mkind WHERE NOT big AND regexp_matches(str, '^(?:\\[[0-9]+\\])+$')),
mstep AS (WITH RECURSIVE st AS (SELECT doc_id, page, CAST(0 AS BIGINT) AS k, xs, CAST(NULL AS BIGINT) AS hit FROM mbase
 UNION ALL SELECT doc_id, page, k, CASE WHEN hit IS NULL THEN xs ELSE list_concat(list_concat(xs[1:hit - 1], [greatest(xs[hit], x1)]), xs[hit + 1:]) END, hit FROM (
  SELECT s.doc_id, s.page, p.k, s.xs, p.x1, list_min(list_transform(list_filter(list_transform(s.xs, lambda x, i: {'gap': p.x0 - x, 'i': i, 'dy': abs(p.y - b.bs[i].y)}), lambda z: z.gap >= -b.m * 0.2 AND z.gap <= b.m * 0.75 AND z.dy <= b.m * 0.95 AND z.dy >= b.m * 0.12), lambda z: {'gap': z.gap, 'i': z.i})).i AS hit
  FROM st s JOIN mbase b ON b.doc_id = s.doc_id AND b.page = s.page JOIN mmark p ON p.doc_id = s.doc_id AND p.page = s.page AND p.k = s.k + 1)) SELECT * FROM st),
mhit AS (SELECT s.doc_id, s.page, s.k, p.item_no, p.str, p.x1, b.bs[s.hit].no AS base FROM mstep s JOIN mbase b ON b.doc_id = s.doc_id AND b.page = s.page JOIN mmark p ON p.doc_id = s.doc_id AND p.page = s.page AND p.k = s.k WHERE s.hit IS NOT NULL)
SELECT p.doc_id, p.page, p.item_no, p.str || coalesce(h.t, '') AS plain, p.x0, greatest(p.x1, h.x1) AS x1, p.y, p.h FROM mparts p LEFT JOIN (SELECT doc_id, page, base, string_agg(str, '' ORDER BY k) AS t, max(x1) AS x1 FROM mhit GROUP BY ALL) h ON h.doc_id = p.doc_id AND h.page = p.page AND h.base = p.item_no
 WHERE NOT EXISTS (SELECT 1 FROM mhit g WHERE g.doc_id = p.doc_id AND g.page = p.page AND g.item_no = p.item_no)"""


@query("P16_attach_citation_marks", c("qitems", "SELECT * FROM (WITH " + _MARKS + ")"))
@by_page
def attach_citation_marks(spark, sf):
    return ly.attach_citation_marks(materialize(_marked(spark, sf), "parts"))


@query("P17_crop_box", "SELECT doc_id, greatest(0.0, x0 - 12) AS crop_x, greatest(0.0, 800 - y1 - 8) AS crop_y, least(600 - greatest(0.0, x0 - 12), x1 - greatest(0.0, x0 - 12) + 14) AS crop_w, least(800 - greatest(0.0, 800 - y1 - 8), y1 - y0 + 18) AS crop_h FROM (SELECT doc_id, CAST(n_chars % 40 AS DOUBLE) AS x0, CAST(n_chars % 620 AS DOUBLE) AS x1, CAST(doc_id % 500 AS DOUBLE) AS y0, CAST(doc_id % 500 + 300 AS DOUBLE) AS y1 FROM documents)")
def crop_box(spark, sf):
    d = lambda x: x.cast("double")
    b = inputs.table(spark, sf, "documents").select("doc_id", d(F.col("n_chars") % 40).alias("x0"), d(F.col("n_chars") % 620).alias("x1"), d(F.col("doc_id") % 500).alias("y0"), d(F.col("doc_id") % 500 + 300).alias("y1"), F.lit(600.0).alias("page_width"), F.lit(800.0).alias("page_height"))
    return ly.crop_box(b).select("doc_id", "crop_x", "crop_y", "crop_w", "crop_h")
