"""Queries of whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alignment as al
from ..operators import catalog as ca
from ..operators import flows as fl
from ..operators import reports as rp
from ..operators import selection as se
from ..operators import spans as sp
from ..operators import stewardship as st
from ..operators import texts as tx
from .catalog_queries import LINKS
from .layout_queries import BLOCKS, LINES, boxes
from .registry import query

#: Detections: one a line of an order; classes 1 to 3 are columns of text, seals and what is left out.
DETECTIONS = """
SELECT l_orderkey // 4 AS page, l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_linenumber < 5 THEN 1 WHEN l_linenumber < 7 THEN 2 ELSE 3 END AS cls, (min(l_partkey) * 37 % 900)::DOUBLE AS x1, (min(l_suppkey) % 4 * 40)::DOUBLE AS y1,
  (min(l_partkey) * 37 % 900 + 30)::DOUBLE AS x2, (min(l_suppkey) % 4 * 40 + 300 + l_linenumber)::DOUBLE AS y2 FROM lineitem GROUP BY l_orderkey, l_linenumber
"""
GROUPS = f"""
WITH d AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM ({DETECTIONS}) WHERE cls < 3), t AS (SELECT * FROM d WHERE cls = 1),
g AS (SELECT *, abs(lag(cx) OVER w - cx) AS gap, abs(lag(y1) OVER w - y1) AS step, y2 - y1 AS high FROM t WINDOW w AS (PARTITION BY page ORDER BY cx DESC, id)),
m AS (SELECT page, median(gap) AS mid_gap, median(high) AS mid_high FROM g GROUP BY page),
n AS (SELECT g.*, CASE WHEN gap IS NOT NULL AND NOT (gap < 2 * mid_gap AND step < 0.15 * mid_high) THEN 1 ELSE 0 END AS new FROM g JOIN m USING (page)),
k AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY cx DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS grp FROM n),
u AS (SELECT page, grp, count(*) AS n, avg(cx) AS cx, avg(cy) AS cy, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM k GROUP BY page, grp)
"""


def detections(t):
    rows = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    return rows.selectExpr("l_orderkey div 4 as page", "l_orderkey * 8 + l_linenumber as id", "if(l_linenumber < 5, 1, if(l_linenumber < 7, 2, 3)) as cls", "double(p * 37 % 900) as x1", "double(s % 4 * 40) as y1", "double(p * 37 % 900 + 30) as x2", "double(s % 4 * 40 + 300 + l_linenumber) as y2")


@query(GROUPS + "SELECT page, grp AS \"group\", n, round(cx, 4) AS cx, x1, y1, x2, y2 FROM u")
def column_groups(t):
    return fl.column_groups(detections(t).where("cls = 1").drop("cls"), "page").select("page", "group", "n", F.round("cx", 4).alias("cx"), "x1", "y1", "x2", "y2")


@query(GROUPS + """,
a AS (SELECT page, grp AS key, 'main_text' AS block_type, round(cx, 6) AS cx, round(cy, 6) AS cy, x1, y1, x2, y2 FROM u UNION ALL SELECT page, id + 4294967296, 'seal', cx, cy, x1, y1, x2, y2 FROM d WHERE cls = 2),
b AS (SELECT *, coalesce(lag(cx) OVER (PARTITION BY page ORDER BY cx DESC, key) - cx > 50, false)::INT AS begins FROM a),
c AS (SELECT *, sum(begins) OVER (PARTITION BY page ORDER BY cx DESC, key) AS col FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY col, cy, key) AS rank FROM c)
SELECT page, 'b' || lpad(rank::VARCHAR, greatest(2, length(rank::VARCHAR))::INT, '0') AS block_id, block_type, rank - 1 AS reading_order, block_type = 'seal' AS skip, round(least(x1, 800)) AS x1, round(least(y1, 390)) AS y1, round(least(x2, 800)) AS x2, round(least(y2, 390)) AS y2 FROM r
""")
def layout_blocks(t):
    return fl.layout_blocks(detections(t), "page", {1: "main_text", 2: "seal"}, 800.0, 390.0)


@query(f"""
WITH l AS (SELECT page, id AS line, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM ({LINES}) GROUP BY page, id), b AS (SELECT page, pos, min(block) AS block, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM ({BLOCKS}) WHERE pos % 5 <> 0 GROUP BY page, pos),
p AS (SELECT l.page, line, l.y1 AS top, block, pos, (l.x1 + l.x2) / 2 AS cx, (l.y1 + l.y2) / 2 AS cy, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2,
  greatest(least(l.x2, b.x2) - greatest(l.x1, b.x1), 0) * greatest(least(l.y2, b.y2) - greatest(l.y1, b.y1), 0) / greatest((l.x2 - l.x1) * (l.y2 - l.y1), 1) AS share FROM l JOIN b ON l.page = b.page),
q AS (SELECT *, cx >= bx1 AND cx <= bx2 AND cy >= by1 AND cy <= by2 AS inside, (cx - (bx1 + bx2) / 2) ** 2 + (cy - (by1 + by2) / 2) ** 2 AS far FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY inside DESC, CASE WHEN inside THEN share ELSE -far END DESC, pos) AS n FROM q),
f AS (SELECT page, block, string_agg('t' || line, chr(10) ORDER BY top, line) AS text FROM r WHERE n = 1 GROUP BY ALL),
o AS (SELECT page, block, 'old' AS was FROM (SELECT page, pos, min(block) AS block FROM ({BLOCKS}) GROUP BY ALL) WHERE pos % 3 = 0)
SELECT page, block, coalesce(text, was) AS text, CASE WHEN text IS NULL THEN 'kept' WHEN was IS NULL THEN 'added' ELSE 'replaced' END AS origin FROM f FULL JOIN o USING (page, block)
""")
def recognise_page(t):
    lines, blocks = boxes(t)
    lines = lines.groupBy("page", "id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).withColumn("text", F.concat(F.lit("t"), "id"))
    blocks = blocks.groupBy("page", "pos").agg(F.min("block").alias("block"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    old = blocks.where("pos % 3 = 0").select("page", "block", F.lit("old").alias("text"))
    return fl.recognise_page(blocks.withColumns({"skip": F.expr("pos % 5 = 0"), "reading_order": F.lit(None).cast("int")}), lines, old, "page")


@query("""
WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?]*[.!?]|[^.!?]+$'), 1) AS i FROM documents),
s AS (SELECT doc_id, i - 1 AS id, s, sum(length(s)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT - 1 AS e, length(s) AS n FROM p),
m AS (SELECT DISTINCT l_orderkey AS doc_id, l_partkey AS id, 9 * l_linenumber AS start, 9 * l_linenumber + l_quantity::INT AS e, 'note ' || l_partkey AS note FROM lineitem),
f AS (SELECT s.doc_id, s.id AS sentence, min(trim(s.s)) AS body, string_agg(note, chr(10) ORDER BY start, m.id, note) AS notes FROM s LEFT JOIN m ON m.doc_id = s.doc_id AND m.start <= s.e AND m.e >= s.e - s.n + 1 GROUP BY ALL)
SELECT doc_id, sentence, md5(body || coalesce(chr(10) || notes, '')) AS request_md5 FROM f
""")
def draft_requests(t):
    notes = t("lineitem").selectExpr("l_orderkey as doc_id", "l_partkey as id", "cast(9 * l_linenumber as int) as start", "cast(9 * l_linenumber + cast(l_quantity as int) as int) as end", "concat('note ', l_partkey) as note").distinct()
    out = fl.draft_requests(t("documents").select("doc_id", "text"), notes, "doc_id", ".!?")
    return out.select("doc_id", "sentence", F.md5("request").alias("request_md5"))


@query("""
SELECT p_partkey, p_brand AS headword, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name END AS meaning, CASE p_partkey % 4 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 2 THEN 19 ELSE 0 END AS start, CASE p_partkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 19 WHEN 2 THEN 19 ELSE 0 END AS "end" FROM part
""")
def staged_entries(t):
    """Answers in fences, with think tags, reversed and overlong spans, and cut off after the first entry."""
    item = F.expr("""concat('{"headword": "', p_brand, '", "meaning": ', if(p_partkey % 3 = 0, 'null', concat('"', p_name, '"')), case p_partkey % 4 when 0 then ', "start": 5, "end": 2}' when 1 then ', "start": -3, "end": 90}' when 2 then ', "start": 44}' else '}' end)""")
    raw = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<think>[1]</think>```json\n["), item, F.lit(', {"headword": "", "meaning": "x"}]\n```'))).otherwise(F.concat(F.lit("Here: ["), item, F.lit(', {"headword": "cut')))
    return fl.staged_entries(t("part").select("p_partkey", raw.alias("raw")), "p_partkey", "raw", F.lit(20))


@query("""
WITH r AS (SELECT l_orderkey AS page, l_linenumber * 1000000 + l_partkey AS id, min(CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_linenumber % 2 END) AS container, min(CASE WHEN l_partkey % 7 = 0 THEN NULL ELSE l_suppkey / 100 END) AS ord FROM lineitem GROUP BY ALL),
o AS (SELECT *, coalesce('c' || container, 'l' || id) AS own FROM r), m AS (SELECT page, own, list_sort(list(ord) FILTER (ord IS NOT NULL)) AS s FROM o GROUP BY ALL)
SELECT page, id, row_number() OVER (PARTITION BY page ORDER BY s[len(s) // 2 + 1] ASC NULLS LAST, own, ord ASC NULLS LAST, id) AS rank FROM o JOIN m USING (page, own)
""")
def container_order(t):
    rows = t("lineitem").groupBy(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("id")).agg(F.min(F.expr("if(l_linenumber % 3 = 0, null, l_linenumber % 2)")).alias("container"), F.min(F.expr("if(l_partkey % 7 = 0, null, l_suppkey / 100)")).alias("ord"))
    return fl.container_order(rows, "page")


@query()
def smooth_order(t):
    """Detections smoothed after their order in columns; the tests hold the paths against all permutations."""
    d = detections(t)
    ranked = se.groups_in_columns(d.selectExpr("page", "id", "(x1 + x2) / 2 as cx", "(y1 + y2) / 2 as cy"), "page", "id").select("page", "id", F.col("rank").cast("double").alias("ord"))
    return fl.smooth_order(d.join(ranked, ["page", "id"]), "page", 1500.0)


@query(f"""
WITH l AS (SELECT page, id AS line, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM ({LINES}) GROUP BY page, id), b AS (SELECT page, pos, min(block) AS block, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM ({BLOCKS}) GROUP BY page, pos),
k AS (SELECT * FROM l WHERE line % 10 >= 2), g AS (SELECT * FROM b WHERE x2 - x1 >= 60 AND y2 - y1 >= 60),
p AS (SELECT k.page, line, block, pos, (k.x1 + k.x2) / 2 AS cx, (k.y1 + k.y2) / 2 AS cy, g.x1 AS bx1, g.y1 AS by1, g.x2 AS bx2, g.y2 AS by2,
  greatest(least(k.x2, g.x2) - greatest(k.x1, g.x1), 0) * greatest(least(k.y2, g.y2) - greatest(k.y1, g.y1), 0) / greatest((k.x2 - k.x1) * (k.y2 - k.y1), 1) AS share FROM k LEFT JOIN g ON k.page = g.page AND (k.x1 + k.x2) / 2 BETWEEN g.x1 AND g.x2 AND (k.y1 + k.y2) / 2 BETWEEN g.y1 AND g.y2),
r AS (SELECT page, line, block, row_number() OVER (PARTITION BY page, line ORDER BY share DESC NULLS LAST, pos) AS n FROM p),
f AS (SELECT page, block, count(*) AS n FROM r WHERE n = 1 GROUP BY ALL),
pages AS (SELECT DISTINCT page FROM g UNION SELECT DISTINCT page FROM k)
SELECT page, (SELECT count(*) FROM g WHERE g.page = pages.page) AS n_blocks, coalesce((SELECT sum(n) FROM f WHERE f.page = pages.page AND block IS NOT NULL), 0)::BIGINT AS n_lines, coalesce((SELECT n FROM f WHERE f.page = pages.page AND block IS NULL), 0) AS n_loose FROM pages
""")
def page_tree(t):
    lines, blocks = boxes(t)
    lines = lines.groupBy("page", "id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2")).withColumn("conf", F.expr("id % 10 / 20"))
    blocks = blocks.groupBy("page", "pos").agg(F.min("block").alias("block"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    big = blocks.where("x2 - x1 >= 60 and y2 - y1 >= 60")  # the operator's own bound on sides is below every line's
    out = fl.page_tree(big, lines, "page")
    n = F.aggregate("blocks", F.lit(0), lambda a, b: a + F.size(b["lines"]))
    return out.select("page", F.size("blocks").cast("bigint").alias("n_blocks"), n.cast("bigint").alias("n_lines"), F.size("loose").cast("bigint").alias("n_loose"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
c AS (SELECT *, len(regexp_extract_all(line, '[à-ÿ]')) AS a, len(regexp_extract_all(line, '[th]')) AS b FROM l),
o AS (SELECT doc_id, line_no, line, CASE WHEN a + b = 0 THEN NULL WHEN a >= 0.8 * (a + b) THEN 'original' ELSE 'translation' END AS own FROM c),
k AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'original') AS class FROM o),
s AS (SELECT doc_id, CASE class WHEN 'original' THEN 'text' ELSE 'translation' END AS kind, string_agg(line, chr(10) ORDER BY line_no) AS content FROM k WHERE trim(line) <> '' GROUP BY ALL)
SELECT doc_id, kind, md5(content) AS content_md5 FROM s
""")
def import_text_flow(t):
    lines = tx.classify_lines(tx.lines_of(t("documents"), "doc_id"), "doc_id", "[à-ÿ]", "[th]")
    return fl.import_pages(lines, "doc_id").select("doc_id", "kind", F.md5("content").alias("content_md5"))


@query("""
WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, text FROM conversations)
SELECT conv_id, 5 + i AS page_num, length(regexp_replace(regexp_replace(text, '[.,]', '', 'g'), '\\s', '', 'g')) AS n_chars, len(regexp_extract_all(text, '[.,]')) AS n_marks FROM s
""")
def import_sections_flow(t):
    """Sections become pages from the fifth on; their texts are cleaned, and their marks counted."""
    c = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("sections"))
    pages = st.auto_pages(c.withColumn("n", F.size("sections")), "conv_id", "n", F.lit(5), F.lit("main"))
    rows = pages.join(c, "conv_id").select("conv_id", F.col("page_num").cast("bigint").alias("page_num"), F.get("sections", F.col("section_index"))["text"].alias("text"))
    cleaned = rows.withColumn("c", al.clean_text("text", F.lit(".,"), F.lit(True)))
    return cleaned.select("conv_id", "page_num", F.char_length("c.clean").cast("bigint").alias("n_chars"), F.size("c.marks").cast("bigint").alias("n_marks"))


@query("""
WITH b AS (SELECT conv_id, turn, regexp_replace(text, '\\s', '', 'g') AS x FROM conversations)
SELECT conv_id, turn::VARCHAR AS block, length(x) AS total, 1.0::DOUBLE AS accuracy FROM b WHERE x <> '' UNION ALL SELECT conv_id, '*', sum(length(x))::BIGINT, 1.0::DOUBLE FROM b GROUP BY conv_id HAVING sum(length(x)) > 0
""")
def page_alignment_report(t):
    """Pages whose text has its first letters wrong until the corrections are applied; then it is what was recognised."""
    c = t("conversations").select("conv_id", F.col("turn").alias("block"), F.col("turn").alias("pos"), F.lit(0).alias("line_no"), F.regexp_replace("text", r"\s", "").alias("text"))
    whole = se.joined_in_order(c, "conv_id", ["pos", "line_no"], "text")
    wrong = whole.select("conv_id", F.concat(F.lit("§"), F.substring("text", F.lit(2), F.char_length("text"))).alias("text"))
    fixes = whole.select("conv_id", F.lit(0).alias("char_index"), F.lit("§").alias("original"), F.substring("text", 1, 1).alias("corrected"))
    refs = tx.apply_corrections(wrong, fixes, "conv_id").select("conv_id", F.col("corrected").alias("text"))
    variants = t("nation").selectExpr("'é' as a", "'e' as b").distinct()
    return rp.page_alignment(c, refs, variants, "conv_id", "block").select("conv_id", "block", "total", "accuracy")


@query(LINKS + """,
p AS (SELECT page_id, CASE WHEN regexp_matches(url, '\\.org/') THEN 'org' ELSE 'generic' END AS parser, nullif(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '') AS title FROM pages),
b AS (SELECT page_id, regexp_extract(link, '^(https?://[^?#]*/)', 1) AS dir, count(*) AS n FROM d GROUP BY ALL),
k AS (SELECT page_id, count(*) AS n_bundles, sum(n)::BIGINT AS n_links FROM b GROUP BY page_id)
SELECT page_id, parser, title, coalesce(n_bundles, 0) AS n_bundles, coalesce(n_links, 0) AS n_links FROM p LEFT JOIN k USING (page_id)
""")
def bibliography_flow(t):
    """A page's URL picks the parser, which gives its record; its links are bundled into assets."""
    pages = t("pages")
    records = pages.select("page_id", ca.route(F.col("url"), [(r"\.org/", "org")], "generic").alias("parser"), F.nullif(F.trim(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("")).alias("title"))
    assets = ca.bundles(ca.html_links(pages, "page_id"), "page_id").groupBy("page_id").agg(F.count(F.lit(1)).alias("n_bundles"), F.sum("n").alias("n_links"))
    return records.join(assets, "page_id", "left").select("page_id", "parser", "title", F.coalesce("n_bundles", F.lit(0)).alias("n_bundles"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


@query("""
WITH e AS (SELECT event_type AS block, event_id AS id, CASE WHEN value > 50 THEN 'O' ELSE 'F' END AS side, event_id * 10 AS start, event_id * 10 + user_id % 40 AS "end" FROM events),
m AS (SELECT * FROM e WHERE side = 'O'), c AS (SELECT m.block, m.id, count(DISTINCT r.id) AS n_notes FROM m LEFT JOIN (SELECT * FROM e WHERE side = 'F') r ON r.block = m.block AND r.start <= m."end" AND r."end" >= m.start AND r.id BETWEEN m.id - 5 AND m.id + 5 GROUP BY ALL)
SELECT c.*, n_notes > 0 AND id % 4 <> 0 AND block <> left(block, 3) AS text_changed FROM c
""")
def citation_context(t):
    """Marks with the notes that overlap them, found by buckets in blocks of a fifth of all rows, and whether the text
    of their block has changed since."""
    e = t("events").selectExpr("event_type as block", "event_id as id", "if(value > 50, 'O', 'F') as side", "event_id * 10 as start", "event_id * 10 + user_id % 40 as end")
    notes = e.where("side = 'F'").selectExpr("block", "id as note", "start", "end")
    n = sp.overlap_join_long(e.where("side = 'O'").drop("side"), notes, "block", 64).groupBy("block", "id").agg(F.count_distinct("note").alias("n"))
    marks = e.where("side = 'O'").select("block", "id").join(n, ["block", "id"], "left").withColumn("n_notes", F.coalesce("n", F.lit(0)))
    changed = (F.col("n_notes") > 0) & se.text_changed(F.when(F.col("id") % 4 == 0, "").otherwise(F.col("block")), F.substring("block", 1, 3))
    return marks.select("block", "id", "n_notes", changed.alias("text_changed"))
