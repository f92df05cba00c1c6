"""Queries of the reading order operators. Pages are made of orders and their lines, so that SQL knows where they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import order as od
from ..operators import page_align as pg
from .registry import query

#: Lines in cells of three columns. By order: tall or wide lines, and the wider gap between columns or between rows.
CELLS = "SELECT l_orderkey AS page, l_linenumber AS id, (l_linenumber - 1) % 3 AS c, (l_linenumber - 1) // 3 AS r FROM lineitem"
CELL_ORDER = "CASE page % 4 WHEN 0 THEN -c * 10 + r WHEN 1 THEN c * 10 + r WHEN 2 THEN r * 10 - c ELSE r * 10 + c END"


def cells(t):
    rows = t("lineitem").selectExpr("l_orderkey as page", "l_linenumber as id", "(l_linenumber - 1) % 3 as c", "int((l_linenumber - 1) div 3) as r", "int(l_orderkey % 4) as kind")
    rows = rows.dropDuplicates(["page", "id"])
    step = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), F.col("kind") + 1)
    x, y = F.col("c") * step(100, 200, 30, 110), F.col("r") * step(110, 30, 300, 300)
    return rows.select("page", "id", F.col("id").alias("pos"), x.alias("x1"), y.alias("y1"), (x + step(20, 100, 20, 100)).alias("x2"), (y + step(100, 20, 100, 20)).alias("y2"), "c", "r", "kind")


@query(f"SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY {CELL_ORDER})::INTEGER AS rank FROM ({CELLS}) GROUP BY page, id, c, r")
def mesh_cut_order(t):
    """Tall lines are read from the right, wide ones from the left; columns first where their gap is the wider one."""
    return od.mesh_order(cells(t), ["page"])


@query(f"SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY CASE WHEN page % 4 IN (0, 2) THEN -c * 10 + r ELSE r * 10 + c END)::INTEGER AS rank FROM ({CELLS}) GROUP BY page, id, c, r")
def comparator_order(t):
    """Lines whose centres stray a little from their column's (or row's): columns of tall lines, rows of wide ones."""
    rows = cells(t)
    tall = F.col("kind").isin(0, 2)
    stray = (F.col("id") * 7 % 3 - 1) * 2
    moved = rows.withColumns({"x1": F.col("x1") + F.when(tall, stray).otherwise(0), "x2": F.col("x2") + F.when(tall, stray).otherwise(0), "y1": F.col("y1") + F.when(tall, 0).otherwise(stray), "y2": F.col("y2") + F.when(tall, 0).otherwise(stray)})
    return od.line_order(moved, ["page"])


@query("""
WITH g AS (SELECT l_orderkey AS page, l_linenumber AS id, l_linenumber % 3 * 60 + l_suppkey % 3 * 10 AS cx, l_linenumber * 100 + 50 AS cy FROM lineitem)
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY id % 3 DESC, cy)::INTEGER AS rank FROM g WHERE NOT EXISTS (SELECT 1 FROM g o WHERE o.page = g.page AND o.id % 3 <> g.id % 3 AND abs(o.cx - g.cx) < 50)
  AND page NOT IN (SELECT a.page FROM g a JOIN g b ON a.page = b.page AND a.id % 3 <> b.id % 3 AND abs(a.cx - b.cx) < 50)
""")
def group_order_pages(t):
    """Groups in three columns; pages on which groups of two columns are too near for SQL to order are left out."""
    rows = t("lineitem").selectExpr("l_orderkey as page", "l_linenumber as id", "l_linenumber as pos", "l_linenumber % 3 * 60 + l_suppkey % 3 * 10 as cx", "l_linenumber * 100 as y1")
    a, b = rows.alias("a"), rows.alias("b")
    near = a.join(b, (F.col("a.page") == F.col("b.page")) & (F.col("a.id") % 3 != F.col("b.id") % 3) & (F.abs(F.col("a.cx") - F.col("b.cx")) < 50)).select(F.col("a.page").alias("page")).distinct()
    clear = rows.join(near, "page", "left_anti").selectExpr("page", "id", "pos", "cx - 10 as x1", "y1", "cx + 10 as x2", "y1 + 100 as y2")
    return od.group_order(clear, ["page"])


@query("""
WITH h AS (SELECT event_type, user_id % 40 AS pos, count(*) AS seen FROM events WHERE value > 90 OR user_id % 7 > 1 GROUP BY ALL), p AS (SELECT event_type, unnest(range(0, 40)) AS pos FROM (SELECT DISTINCT event_type FROM events)),
c AS (SELECT event_type, pos, coalesce(seen, 0) AS n FROM p LEFT JOIN h USING (event_type, pos)), m AS (SELECT event_type, median(n) FILTER (n > 0) AS mid FROM c GROUP BY event_type),
i AS (SELECT event_type, pos, n, mid, n < mid AS low, pos - row_number() OVER (PARTITION BY event_type, n < mid ORDER BY pos) AS island FROM c JOIN m USING (event_type)),
r AS (SELECT event_type, min(pos) AS b, max(pos) + 1 AS e, sum(mid - n) AS depth FROM i WHERE low GROUP BY event_type, island)
SELECT event_type, b AS begin, e AS "end", round(depth, 6) AS depth FROM r QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY depth DESC, b) = 1
""")
def histogram_gap(t):
    """The run of users (by number modulo 40) of each event type that has most too few events."""
    e = t("events")
    counts = e.where("value > 90 or user_id % 7 > 1").groupBy("event_type", (F.col("user_id") % 40).alias("pos")).agg(F.count(F.lit(1)).alias("seen"))
    places = e.select("event_type").distinct().select("event_type", F.explode(F.sequence(F.lit(0), F.lit(39))).alias("pos"))
    full = places.join(counts, ["event_type", "pos"], "left").select("event_type", F.col("pos").cast("long").alias("pos"), F.coalesce("seen", F.lit(0)).alias("n"))
    return od.deepest_gaps(full, ["event_type"], "pos", "n").withColumn("depth", F.round("depth", 6))


NOTES = "l_suppkey * 7 % 60 AS x, l_partkey * 11 % 90 AS y, 10 + l_linenumber AS w, 30 + l_quantity::INT % 20 AS h"


@query(f"""
WITH RECURSIVE n AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS i, l_linenumber AS id, {NOTES} FROM lineitem),
p AS (SELECT page, list({{'i': i, 'id': id, 'x1': x - w * 0.1 / 2, 'x2': x + w + w * 0.1 / 2, 'y1': y, 'y2': y + h}} ORDER BY i) AS b FROM n GROUP BY page),
s(page, b, k, seed) AS (
  SELECT page, b, 1::BIGINT, list_transform(b, lambda x: 0::BIGINT) FROM p
  UNION ALL
  SELECT page, b, k + 1, CASE WHEN seed[k] > 0 THEN seed ELSE list_transform(seed, lambda v, j: CASE WHEN v > 0 THEN v WHEN j = k OR (least(b[j].x2, b[k].x2) > greatest(b[j].x1, b[k].x1) AND least(b[j].y2, b[k].y2) > greatest(b[j].y1, b[k].y1)) THEN k ELSE 0 END) END FROM s WHERE k <= len(b))
SELECT page, unnest(list_transform(b, lambda x: x.id)) AS id, unnest(list_transform(seed, lambda v: b[v].id)) AS seed FROM s WHERE k = len(b) + 1
""")
def inline_note_groups(t):
    rows = t("lineitem").selectExpr("l_orderkey as page", "l_linenumber as id", "struct(l_linenumber, l_partkey, l_suppkey, l_quantity) as pos", "l_suppkey * 7 % 60 as x1", "l_partkey * 11 % 90 as y1", "l_suppkey * 7 % 60 + 10 + l_linenumber as x2", "l_partkey * 11 % 90 + 30 + int(l_quantity) % 20 as y2")
    return od.inline_groups(rows, ["page"]).select("page", "id", "seed")


@query("""
WITH l AS (SELECT l_orderkey AS page, l_linenumber AS id, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 3 END AS container, l_linenumber % 5 = 4 AS inline, min(l_partkey) AS ord FROM lineitem WHERE l_orderkey % 2 = 0 GROUP BY l_orderkey, l_linenumber),
e AS (SELECT *, CASE WHEN container IS NULL THEN ord ELSE (SELECT list_sort(list(m.ord))[len(list(m.ord)) // 2 + 1] FROM l m WHERE m.page = l.page AND m.container = l.container) END AS outer_ord FROM l),
k AS (SELECT *, min(id) OVER (PARTITION BY page, coalesce(container::VARCHAR, 'l' || id)) AS first FROM e)
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY outer_ord, first, id)::INTEGER AS rank FROM k
""")
def page_reading_order(t):
    """Lines below each other, some of them inline notes, some of them in one of two containers."""
    rows = t("lineitem").where("l_orderkey % 2 = 0").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("l_partkey")).selectExpr(
        "l_orderkey as page", "l_linenumber as id", "l_linenumber as pos", "if(l_linenumber % 3 = 0, null, string(l_linenumber % 3)) as container", "double(l_partkey) as ord", "l_linenumber % 5 = 4 as inline", "0.5D as conf",
        "0 as x1", "l_linenumber * 50 as y1", "200 as x2", "l_linenumber * 50 + 20 as y2",
    )
    return od.page_order(rows, "page")


@query(r"""
WITH RECURSIVE c AS (SELECT conv_id, turn, text, regexp_replace(text, '[^\p{Latin}]', '', 'g') AS own FROM conversations),
d AS (SELECT conv_id, string_agg(text, '' ORDER BY turn) AS text, string_agg(own, '' ORDER BY turn) AS own FROM c GROUP BY conv_id),
l AS (SELECT conv_id, length(text) AS size, list_filter(list_transform(string_split(text, ''), lambda x, i: CASE WHEN regexp_matches(x, '^\p{Latin}$') THEN i - 1 END), lambda x: x IS NOT NULL) AS places FROM d),
b AS (SELECT conv_id, turn, own, length(own) AS n, coalesce(sum(length(own)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS base FROM c),
o AS (SELECT *, unnest(CASE WHEN n < 15 THEN [0] WHEN n < 30 THEN [0, n - 15] ELSE [0, n // 2 - 7, n - 15] END) AS off, unnest([1, 2, 3][1:least(greatest(n // 15 + 1, 1), 3)]) AS k FROM b),
a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn, k) AS i, substr(own, off + 1, 15) AS anchor, CASE WHEN n = 15 AND k = 2 THEN base + n END AS before FROM o),
g(conv_id, i, turn, place, last) AS (
  SELECT conv_id, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, -1::BIGINT FROM d
  UNION ALL
  SELECT conv_id, i, turn, CASE WHEN fits THEN spot END, CASE WHEN fits THEN spot ELSE last END FROM (SELECT *, spot > last AND (before IS NULL OR spot < before) AS fits
    FROM (SELECT a.conv_id, a.i, a.turn, a.before, g.last, g.last + instr(substr(d.own, g.last + 2), a.anchor) AS spot FROM g JOIN a ON a.conv_id = g.conv_id AND a.i = g.i + 1 JOIN d ON d.conv_id = g.conv_id))),
p AS (SELECT conv_id, turn, places[list_sort(list(place))[count(place) // 2 + 1] + 1] AS place, size FROM g JOIN l USING (conv_id) WHERE place IS NOT NULL GROUP BY conv_id, turn, places, size),
s AS (SELECT conv_id, turn, size, CASE WHEN row_number() OVER w = 1 THEN 0 ELSE (lag(place) OVER w + place) // 2 END AS start FROM p WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn::INTEGER AS page, start, coalesce(lead(start) OVER (PARTITION BY conv_id ORDER BY turn), size) AS "end", true AS found FROM s
""")
def chained_pages(t):
    """Conversations as texts and their turns as pages: where each turn lies, by the places of its anchors. Every anchor is
    in its text, so the heaviest chain has all of them, and of such chains the one with earlier places: each anchor where
    it first is after the one before it. A turn of 15 letters has the same anchor twice, and both only where they are
    twice there. Turns have five letters (an n-gram) or more."""
    c = t("conversations")
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("text"))
    out = pg.align_pages(c.select("conv_id", F.col("turn").alias("page"), "text"), whole, "conv_id", r"\p{IsLatin}")
    return out.select("conv_id", "page", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), (F.col("confidence") > 0.5).alias("found"))
