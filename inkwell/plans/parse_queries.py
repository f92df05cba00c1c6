"""Queries of the parsers of catalogue texts, and of polygons."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ca
from ..operators import layout as la
from .layout_queries import LINES, boxes
from .registry import query


@query("""
SELECT p_partkey, p_size AS volumes, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 9)::INT END AS books, CASE WHEN p_partkey % 4 = 0 THEN '1-' || p_size END AS missing, p_partkey % 5 = 0 AS fragment FROM part
""")
def extents(t):
    text = F.expr("concat(p_size, '卷', if(p_partkey % 3 <> 0, concat(p_partkey % 9, '冊'), ''), if(p_partkey % 4 = 0, concat('(缺卷1-', p_size, ')'), ''), if(p_partkey % 5 = 0, '(零本)', ''))")
    return t("part").select("p_partkey", ca.extent_of(text).alias("e")).select("p_partkey", "e.*")


@query("SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS subject FROM customer")
def xml_records(t):
    xml = F.expr("concat('<item><title>', c_name, '</title>', if(c_custkey % 2 = 0, concat('<meta><subject>', c_mktsegment, '</subject></meta>'), ''), '</item>')")
    return t("customer").select("c_custkey", ca.xml_record(xml, {"title": "/item/title", "subject": "/item/meta/subject"}).alias("r")).select("c_custkey", "r.*")


@query("SELECT s_suppkey, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_nationkey END AS author FROM supplier")
def label_mapping(t):
    html = F.expr("concat('<table><tr><th>書名</th><td><b>', s_name, '</b></td></tr></table><dl>', if(s_suppkey % 2 = 0, concat('<dt>作成者</dt> <dd>n', s_nationkey, '</dd>'), '<dt>other</dt><dd>x</dd>'), '</dl>')")
    rows = t("supplier").select("s_suppkey", ca.page_rows(html).alias("pairs"))
    return ca.map_labels(rows, "s_suppkey", "pairs", {"title": ["書名", "タイトル", "title"], "author": ["著者", "作成者", "author"]})


@query(f"""
WITH l AS (SELECT page, id, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2 FROM ({LINES}) GROUP BY page, id),
g AS (SELECT page, id, x1 - (x2 - x1) * 0.5::DOUBLE AS x1, y1 - (y2 - y1) * 0.5::DOUBLE AS y1, x2 + (x2 - x1) * 0.5::DOUBLE AS x2, y2 + (y2 - y1) * 0.5::DOUBLE AS y2 FROM l)
SELECT a.page, a.id, min(b.id) AS seed FROM g a JOIN g b ON a.page = b.page AND b.id <= a.id AND a.x1 <= b.x2 AND a.x2 >= b.x1 AND a.y1 <= b.y2 AND a.y2 >= b.y1 GROUP BY ALL
""")
def touching_groups(t):
    lines = boxes(t)[0].groupBy("page", "id").agg(*(F.min(c).alias(c) for c in ("x1", "y1", "x2", "y2")))
    return la.touching_groups(lines, "page", 0.5)


@query("SELECT event_id, user_id % 20 + 0.5 > 4 AND user_id % 20 + 0.5 < 14 AND value / 10 > 2 AND value / 10 < 6 AS inside FROM events WHERE abs(value - 20) > 1e-6 AND abs(value - 60) > 1e-6")
def point_in_polygon(t):
    corner = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    polygon = F.array(corner(4, 2), corner(14, 2), corner(14, 6), corner(4, 6))
    rows = t("events").where("abs(value - 20) > 1e-6 and abs(value - 60) > 1e-6")
    return rows.select("event_id", la.in_polygon(polygon, F.col("user_id") % 20 + 0.5, F.col("value") / 10).alias("inside"))
