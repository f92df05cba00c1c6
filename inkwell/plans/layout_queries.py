"""Queries of the layout operators. Boxes come from the keys of lineitem, so that SQL can build the same ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as la
from .registry import query

X1, Y1 = "l_partkey * 37 % 900", "l_suppkey * 53 % 1200"
W, H = "20 + l_quantity::INT * 4", "15 + l_linenumber * 9"
LINES = f"SELECT l_orderkey // 8 AS page, l_orderkey * 8 + l_linenumber AS id, ({X1})::DOUBLE AS x1, ({Y1})::DOUBLE AS y1, ({X1} + 30 + l_linenumber)::DOUBLE AS x2, ({Y1} + 12)::DOUBLE AS y2 FROM lineitem WHERE l_linestatus = 'O'"
BLOCKS = f"SELECT l_orderkey // 8 AS page, 'b' || (l_orderkey * 8 + l_linenumber) || '_' || l_partkey AS block, l_orderkey * 8 + l_linenumber AS pos, ({X1})::DOUBLE AS x1, ({Y1})::DOUBLE AS y1, ({X1} + {W})::DOUBLE AS x2, ({Y1} + {H})::DOUBLE AS y2 FROM lineitem WHERE l_linestatus = 'F'"


def boxes(t):
    """lines and blocks: page, id or block and pos, x1, y1, x2, y2."""
    both = t("lineitem").selectExpr("l_linestatus", "l_partkey", "l_orderkey div 8 as page", "l_orderkey * 8 + l_linenumber as id", "l_partkey * 37 % 900 as x", "l_suppkey * 53 % 1200 as y", "cast(l_quantity as int) as q", "l_linenumber as n")
    lines = both.where("l_linestatus = 'O'").selectExpr("page", "id", "double(x) as x1", "double(y) as y1", "double(x + 30 + n) as x2", "double(y + 12) as y2")
    blocks = both.where("l_linestatus = 'F'").selectExpr("page", "concat('b', id, '_', l_partkey) as block", "id as pos", "double(x) as x1", "double(y) as y1", "double(x + 20 + q * 4) as x2", "double(y + 15 + n * 9) as y2")
    return lines, blocks


@query(f"""
WITH l AS (SELECT id AS line, row_number() OVER () AS nth, * FROM ({LINES})), b AS ({BLOCKS}),
p AS (SELECT l.page, line, nth, block, pos, (l.x1 + l.x2) / 2 AS cx, (l.y1 + l.y2) / 2 AS cy, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
  greatest(least(l.x2, b.x2) - greatest(l.x1, b.x1), 0) * greatest(least(l.y2, b.y2) - greatest(l.y1, b.y1), 0) / greatest((l.x2 - l.x1) * (l.y2 - l.y1), 1) AS share FROM l LEFT JOIN b ON l.page = b.page),
q AS (SELECT *, coalesce(cx >= bx1 AND cx <= bx2 AND cy >= by1 AND cy <= by2, false) AS inside, (cx - (bx1 + bx2) / 2) ** 2 + (cy - (by1 + by2) / 2) ** 2 AS far FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY nth ORDER BY inside DESC, CASE WHEN inside THEN share ELSE -far END DESC NULLS LAST, pos, block DESC) AS n FROM q)
SELECT page, line, coalesce(block, 'unmatched') AS block, CASE WHEN block IS NULL THEN 'none' WHEN inside THEN 'inside' ELSE 'nearest' END AS how FROM r WHERE n = 1
""")
def line_to_block(t):
    """The block of every line, also of those that share a box or a number."""
    lines, blocks = boxes(t)
    return la.place_lines(lines.withColumnRenamed("id", "line"), blocks, "page")


@query(f"""
WITH b AS ({BLOCKS}) SELECT a.page, a.block AS inner, b.block AS outer FROM b a JOIN b ON a.page = b.page AND a.block <> b.block AND a.x1 >= b.x1 - 50 AND a.y1 >= b.y1 - 50 AND a.x2 <= b.x2 + 50 AND a.y2 <= b.y2 + 50
""".replace("AS inner,", 'AS "inner",').replace("AS outer FROM", 'AS "outer" FROM'))
def rect_containment(t):
    return la.nested(boxes(t)[1], "page", "block", 50.0)


@query(f"""
WITH l AS ({LINES}), b AS ({BLOCKS}), p AS (SELECT l.page, id, block, greatest(least(l.x2, b.x2) - greatest(l.x1, b.x1), 0) * greatest(least(l.y2, b.y2) - greatest(l.y1, b.y1), 0) AS ov, (l.x2 - l.x1) * (l.y2 - l.y1) AS la, (b.x2 - b.x1) * (b.y2 - b.y1) AS ba FROM l JOIN b ON l.page = b.page)
SELECT page, id, block, round(ov / (la + ba - ov), 6) AS iou FROM p WHERE ov > 0
""")
def overlap_metrics(t):
    lines, blocks = boxes(t)
    b = blocks.withColumnsRenamed({c: f"b_{c}" for c in ("page", "x1", "y1", "x2", "y2")})
    pairs = lines.join(b, F.col("page") == F.col("b_page")).where(la.overlap_area(la.box(), la.box("b_")) > 0)
    return pairs.select("page", "id", "block", F.round(la.iou(la.box(), la.box("b_")), 6).alias("iou"))


@query(f"""
WITH l AS ({LINES}), o AS (SELECT *, CASE WHEN x1 - lag(x1) OVER w >= 100 THEN 1 ELSE 0 END AS new FROM l WINDOW w AS (PARTITION BY page ORDER BY x1, y1, x2, y2)),
i AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY x1, y1, x2, y2 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS island FROM o)
SELECT page, island, count(*) AS n, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM i GROUP BY page, island
""")
def column_islands(t):
    return la.column_islands(boxes(t)[0], "page", F.lit(100.0))


@query(f"""
WITH l AS (SELECT DISTINCT * FROM ({LINES})), o AS (SELECT *, -(x1 + x2) / 2 AS x FROM l), n AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY page ORDER BY x, y1, id) > 40 THEN 1 ELSE 0 END AS new FROM o),
c AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY x, y1, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS col FROM n)
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY col, y1, id) AS rank FROM c
""")
def reading_order(t):
    return la.reading_order(boxes(t)[0].distinct(), "page", 40.0)


@query(f"""
WITH l AS ({LINES}) SELECT page, id, least(999, greatest(0, floor(x1 * 1000 / 1000)))::BIGINT AS x1, least(999, greatest(0, floor(y1 * 1000 / 1300)))::BIGINT AS y1, least(999, greatest(0, floor(x2 * 1000 / 1000)))::BIGINT AS x2, least(999, greatest(0, floor(y2 * 1000 / 1300)))::BIGINT AS y2 FROM l
""")
def normalized_boxes(t):
    return boxes(t)[0].select("page", "id", la.normalized_box(la.box(), F.lit(1000), F.lit(1300)).alias("b")).select("page", "id", "b.*")


@query("""
WITH a AS (SELECT conv_id AS doc, turn AS page, CASE WHEN turn % 3 <> 1 THEN sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT END AS place FROM conversations),
b AS (SELECT *, last_value(CASE WHEN place IS NOT NULL THEN page END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp, last_value(place IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pa,
  first_value(CASE WHEN place IS NOT NULL THEN page END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np, first_value(place IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS na FROM a),
e AS (SELECT doc, page, coalesce(place, CASE WHEN np > pp THEN floor(pa + (na - pa) * (page - pp) / (np - pp))::BIGINT END, pa, na) AS est FROM b)
SELECT doc, page, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE floor((est + lag(est) OVER w) / 2)::BIGINT END AS start FROM e WINDOW w AS (PARTITION BY doc ORDER BY page)
""")
def page_boundaries(t):
    from pyspark.sql import Window

    upto = F.sum(F.char_length("text")).over(Window.partitionBy("conv_id").orderBy("turn"))
    anchors = t("conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.when(F.col("turn") % 3 != 1, upto).alias("at"))
    return la.midpoint_boundaries(anchors, "doc")


@query(f"""
WITH RECURSIVE b AS (SELECT page, pos % 2 AS class, row_number() OVER (PARTITION BY page, pos % 2 ORDER BY pos % 97 DESC, block) AS i, {{'id': block, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'a': (x2 - x1) * (y2 - y1)}} AS b FROM ({BLOCKS})),
r(page, class, i, kept) AS (
  SELECT page, class, i, [b] FROM b WHERE i = 1
  UNION ALL
  SELECT r.page, r.class, b.i, CASE WHEN len(list_filter(kept, lambda k: greatest(least(k.x2, b.b.x2) - greatest(k.x1, b.b.x1), 0) * greatest(least(k.y2, b.b.y2) - greatest(k.y1, b.b.y1), 0)
    / (k.a + b.b.a - greatest(least(k.x2, b.b.x2) - greatest(k.x1, b.b.x1), 0) * greatest(least(k.y2, b.b.y2) - greatest(k.y1, b.b.y1), 0)) >= 0.3)) > 0 THEN kept ELSE list_append(kept, b.b) END
  FROM r JOIN b ON b.page = r.page AND b.class = r.class AND b.i = r.i + 1)
SELECT page, class, unnest(kept).id AS id FROM (SELECT page, class, max_by(kept, i) AS kept FROM r GROUP BY page, class)
""")
def nms(t):
    rows = boxes(t)[1].selectExpr("page", "pos % 2 as class", "block as id", "double(pos % 97) / 97 as conf", "x1", "y1", "x2", "y2")
    return la.non_max_suppression(rows, ["page", "class"], 0.3).select("page", "class", "id")


@query()
def xy_cut_order(t):
    return la.xy_cut(boxes(t)[0].groupBy("page", "id").agg(*(F.min(c).alias(c) for c in ("x1", "y1", "x2", "y2"))), "page")
