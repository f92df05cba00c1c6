"""Queries of the span operators. Spans over orders: line k of an order covers 10k to 10k + its quantity."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import spans as sp
from .registry import query

SPANS = "SELECT l_orderkey AS block, l_linenumber AS id, l_linestatus AS side, 10 * l_linenumber AS start, 10 * l_linenumber + l_quantity::INT AS \"end\" FROM lineitem"


def line_spans(t):
    return t("lineitem").selectExpr("l_orderkey as block", "l_linenumber as id", "l_linestatus as side", "cast(10 * l_linenumber as int) as start", "cast(10 * l_linenumber + cast(l_quantity as int) as int) as end")


@query("""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), 1) AS i FROM documents)
SELECT doc_id, i - 1 AS id, coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start,
       sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT - 1 AS "end" FROM p
""")
def sentence_split(t):
    return t("documents").select("doc_id", F.inline(sp.split_sentences(F.col("text"), ".!?")))


@query(f"""
WITH s AS ({SPANS})
SELECT a.block, a.id, b.id AS r_id, b.start AS r_start, b."end" AS r_end, a.start, a."end" FROM s a JOIN s b ON a.block = b.block AND a.side = 'O' AND b.side = 'F' AND b.start <= a."end" AND b."end" >= a.start
""")
def citation_context_overlap(t):
    s = line_spans(t)
    right = s.where("side = 'F'").selectExpr("block", "id as r_id", "start", "end")
    return sp.overlap_join(s.where("side = 'O'").drop("side"), right, "block")


@query(f"""
WITH s AS ({SPANS})
SELECT a.block, a.id, b.id AS r_id, b.start AS r_start, b."end" AS r_end, a.start, a."end" FROM s a JOIN s b ON a.block = b.block AND a.id <> b.id AND b.start >= a.start AND b."end" <= a."end"
""")
def contained_marks(t):
    s = line_spans(t).drop("side")
    return sp.overlap_join(s, s.withColumnRenamed("id", "r_id"), "block", contained=True).where("id <> r_id")


@query("""
WITH s AS (SELECT l_suppkey % 7 AS block, l_orderkey * 8 + l_linenumber AS id, (l_orderkey * 3)::BIGINT AS start, (l_orderkey * 3 + l_quantity::INT)::BIGINT AS "end", l_returnflag AS f FROM lineitem)
SELECT a.block, a.id, b.id AS r_id, a.start, a."end", b.start AS r_start, b."end" AS r_end FROM s a JOIN s b ON a.block = b.block AND a.f = 'A' AND b.f = 'R' AND b.start <= a."end" AND b."end" >= a.start
""")
def overlap_in_long_blocks(t):
    s = t("lineitem").selectExpr("l_suppkey % 7 as block", "l_orderkey * 8 + l_linenumber as id", "cast(l_orderkey * 3 as bigint) as start", "cast(l_orderkey * 3 + cast(l_quantity as int) as bigint) as end", "l_returnflag as f")
    return sp.overlap_join_long(s.where("f = 'A'").drop("f"), s.where("f = 'R'").drop("f").withColumnRenamed("id", "r_id"), "block", 64)


@query(f"""
WITH s AS ({SPANS}), n AS (SELECT o_orderkey AS block, 40 AS n FROM orders)
SELECT block, id, start, "end", start - 10 AS moved_start, "end" - 10 AS moved_end, least(greatest(least(start, "end"), 0), n - 1) AS clamped_start, least(greatest(greatest(start, "end"), 0), n - 1) AS clamped_end, start >= 0 AND "end" < n AND start <= "end" AS valid
FROM s JOIN n USING (block)
""")
def span_shift_and_clamp(t):
    n = t("orders").select(F.col("o_orderkey").alias("block"), F.lit(40).alias("n"))
    rows = line_spans(t).drop("side").join(n, "block")
    a, b = sp.clamp_span(F.col("start"), F.col("end"), F.col("n"))
    rows = rows.withColumns({"clamped_start": a, "clamped_end": b, "valid": sp.valid_span(F.col("start"), F.col("end"), F.col("n")), "moved_start": F.col("start"), "moved_end": F.col("end")})
    return sp.shift_spans(rows, F.lit(10), "moved_start", "moved_end").drop("n")


@query("""
WITH m AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, 7 * l_linenumber AS start, 7 * l_linenumber + (l_quantity::INT % 9) AS "end", '<' || l_linenumber AS before, CASE WHEN l_linenumber % 2 = 0 THEN '>' END AS after FROM lineitem),
v AS (SELECT m.*, text FROM m JOIN documents USING (doc_id) WHERE "end" < length(text)),
g AS (SELECT doc_id, text, "end" + 1 AS gap, 0 AS side, seq, coalesce(after, '') AS put FROM v UNION ALL SELECT doc_id, text, start, 1, seq, before FROM v),
o AS (SELECT *, coalesce(lag(gap) OVER w, 0) AS prev, row_number() OVER w AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY gap, side, seq)),
r AS (SELECT doc_id, string_agg(substring(text, prev + 1, gap - prev) || put || CASE WHEN i = n THEN substring(text, gap + 1) ELSE '' END, '' ORDER BY i) AS rendered FROM o GROUP BY doc_id)
SELECT doc_id, md5(coalesce(rendered, text)) AS rendered_md5 FROM documents LEFT JOIN r USING (doc_id)
""")
def render_marks(t):
    marks = t("lineitem").selectExpr("l_orderkey as doc_id", "l_linenumber as seq", "cast(7 * l_linenumber as int) as start", "cast(7 * l_linenumber + cast(l_quantity as int) % 9 as int) as end", "concat('<', l_linenumber) as before", "if(l_linenumber % 2 = 0, '>', null) as after")
    marks = marks.withColumns({"start": F.col("start").cast("int"), "seq": F.col("seq").cast("int")})
    return sp.render_marks(t("documents").select("doc_id", "text"), marks, "doc_id").select("doc_id", F.md5("rendered").alias("rendered_md5"))


@query(f"""
WITH s AS ({SPANS}), d AS (SELECT *, row_number() OVER (PARTITION BY block % 100, start, "end" ORDER BY block, id) AS n FROM s)
SELECT block % 100 AS page, start, "end", block, id FROM d WHERE n = 1
""")
def span_dedup(t):
    rows = line_spans(t).drop("side").withColumn("page", F.col("block") % 100)
    return sp.first_per_key(rows, ["page", "start", "end"], [F.col("block"), F.col("id")])


@query(f"""
WITH s AS ({SPANS}), k AS (SELECT block, start, "end", id::VARCHAR AS put FROM s WHERE side = 'F'), n AS (SELECT block, start, "end", 'new' AS put FROM s WHERE side = 'O' AND id % 2 = 1)
SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.block = k.block AND k.start <= n."end" AND k."end" >= n.start) UNION ALL SELECT * FROM n
""")
def replace_overlapping_marks(t):
    s = line_spans(t)
    old = s.where("side = 'F'").selectExpr("block", "start", "end", "cast(id as string) as put")
    return sp.replace_overlapping(old, s.where("side = 'O' and id % 2 = 1").selectExpr("block", "start", "end", "'new' as put"), "block")


@query("SELECT l_orderkey, count(*) AS n, max(l_linenumber) - min(l_linenumber) + 1 = count(*) AS contiguous FROM lineitem WHERE l_returnflag <> 'N' GROUP BY l_orderkey")
def contiguous_check(t):
    return sp.contiguous(t("lineitem").where("l_returnflag <> 'N'"), "l_orderkey", "l_linenumber")


@query("""
WITH b AS (SELECT conv_id AS work, turn AS seq, role AS status, conv_id * 100 + turn AS block FROM conversations WHERE role <> 'system'),
s AS (SELECT conv_id AS work, turn AS base, list_filter(regexp_split_to_array(text, '\\n'), lambda p: trim(p) <> '') AS pieces FROM conversations WHERE turn = 1),
k AS (SELECT * FROM s WHERE len(pieces) >= 2)
SELECT b.work, CASE WHEN seq > base THEN seq + len(pieces) - 1 ELSE seq END AS seq, block, NULL::VARCHAR AS piece FROM b LEFT JOIN k USING (work) WHERE base IS NULL OR seq <> base
UNION ALL SELECT work, base + i - 1, block, piece FROM (SELECT b.work, base, block, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM b JOIN k ON b.work = k.work AND seq = base)
""")
def renumber_after_split(t):
    c = t("conversations")
    blocks = c.where("role <> 'system'").selectExpr("conv_id as work", "turn as seq", "role as status", "conv_id * 100 + turn as block")
    splits = c.where("turn = 1").selectExpr("conv_id as work", "turn as seq", r"split(text, '\n') as pieces")
    return sp.renumber_after_split(blocks, splits)


@query("""
WITH o AS (SELECT doc_id, unnest(range(0, length(text))) AS p, text FROM documents),
f AS (SELECT doc_id, p FROM o WHERE substring(text, p + 1, 1) = 'q')
SELECT doc_id, min_by(p, abs(p - 100) * 1000000 + p) AS nearest FROM f GROUP BY doc_id
""")
def nearest_occurrence(t):
    d = t("documents").withColumns({"needle": F.lit("q"), "hint": F.lit(100)})
    return d.select("doc_id", sp.nearest_occurrence(d, F.col("needle"), F.col("hint")).alias("nearest")).where("nearest is not null")
