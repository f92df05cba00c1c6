"""Queries of the kept n-gram index, and of lines and blocks of any outline."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tasks import dealt
from ..operators import alignment as al
from ..operators import citations as ci
from ..operators import gram_index as gi
from ..operators import polygons as po
from ..operators import variants as va
from .registry import query


@query("""
WITH a AS (SELECT item_id, unnest([substring(text, 1, 15), substring(text, (length(text) - 15) // 2 + 1, 15), substring(text, length(text) - 14, 15)]) AS phrase, generate_subscripts([1, 2, 3], 1) - 1 AS k FROM benchmark WHERE length(text) >= 45)
SELECT item_id, k, doc_id, i - 1 AS start FROM (
  SELECT item_id, k, doc_id, d.text, phrase, unnest(list_filter(range(1, length(d.text) + 1), lambda i: substring(d.text, i, 15) = phrase)) AS i FROM a JOIN documents d ON contains(d.text, a.phrase))
""")
def anchor_phrases(t):
    """The three anchors of each benchmark item, looked up in an index of all documents."""
    docs = t("documents").select("doc_id", "text")
    index = gi.write_index(docs, "doc_id")
    items = t("benchmark").where(F.char_length("text") >= 45).select("item_id", F.posexplode(al.anchors_of(F.col("text"), 15)).alias("k", "phrase"))
    asked = items.select(F.struct("item_id", "k").alias("q"), "phrase")
    found = gi.find_phrases(docs.sparkSession, index, asked, "q", "doc_id")
    return found.select("q.item_id", F.col("q.k").cast("bigint").alias("k"), "doc_id", F.col("start").cast("bigint").alias("start"))


BLOCKS = "SELECT l_orderkey AS page, ['text_block', 'block_ad', 'block_table', 'figure'][l_partkey % 4 + 1] AS kind, l_linenumber AS block, l_suppkey * 37 % 900 AS x1, l_partkey * 53 % 900 AS y1, l_suppkey * 37 % 900 + 100 + l_quantity::BIGINT * 8 AS x2, l_partkey * 53 % 900 + 80 + l_quantity::BIGINT * 6 AS y2 FROM lineitem"


def page_blocks(t):
    rows = t("lineitem").selectExpr("l_orderkey as page", "element_at(array('text_block', 'block_ad', 'block_table', 'figure'), int(l_partkey % 4) + 1) as kind", "cast(l_linenumber as bigint) as block", "l_suppkey * 37 % 900 as x1", "l_partkey * 53 % 900 as y1",
                                    "l_suppkey * 37 % 900 + 100 + cast(l_quantity as bigint) * 8 as x2", "l_partkey * 53 % 900 + 80 + cast(l_quantity as bigint) * 6 as y2")
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return rows.select("page", "kind", "block", F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2")).alias("points"))


@query(f"""
WITH b AS ({BLOCKS}), l AS (SELECT l_orderkey AS page, l_partkey * 10 + l_linenumber AS id, (l_partkey * 29 % 1300 + l_partkey * 29 % 1300 + 41) // 2 AS px, (l_suppkey * 31 % 1200 + l_suppkey * 31 % 1200 + 20) // 2 AS py FROM lineitem WHERE l_discount >= 0.03),
m AS (SELECT l.page, l.id, kind, block, row_number() OVER (PARTITION BY l.page, l.id ORDER BY list_position(['text_block', 'block_ad', 'block_table'], kind), block, x1, y1, x2, y2) AS nth FROM l JOIN b ON b.page = l.page AND kind <> 'figure' AND px BETWEEN x1 AND x2 AND py BETWEEN y1 AND y2)
SELECT DISTINCT l.page, l.id, kind, block FROM l LEFT JOIN m ON m.page = l.page AND m.id = l.id AND nth = 1
""")
def lines_by_kind(t):
    lines = t("lineitem").selectExpr("l_orderkey as page", "l_partkey * 10 + l_linenumber as id", "double(l_discount) as conf", "l_partkey * 29 % 1300 as x1", "l_suppkey * 31 % 1200 as y1", "l_partkey * 29 % 1300 + 41 as x2", "l_suppkey * 31 % 1200 + 20 as y2")
    blocks = page_blocks(t).withColumn("pos", F.col("block"))
    return po.assign_by_kind(lines, blocks, "page", least=0.03).select("page", "id", "kind", "block").distinct()


@query(f"""
WITH b AS (SELECT page, block, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2 FROM ({BLOCKS}) GROUP BY page, block)
SELECT i.page, i.block AS inner, o.block AS outer FROM b i JOIN b o ON i.page = o.page AND i.block <> o.block
WHERE (SELECT bool_and(sqrt(pow(greatest(o.x1 - x, x - o.x2, 0), 2) + pow(greatest(o.y1 - y, y - o.y2, 0), 2)) <= 50) FROM (SELECT unnest([i.x1, i.x2, i.x2, i.x1]) AS x, unnest([i.y1, i.y1, i.y2, i.y2]) AS y))
""")
def blocks_in_blocks(t):
    at = lambda i, a: F.get("points", F.lit(i))[a]
    rows = page_blocks(t).select("page", "block", at(0, "x").alias("x1"), at(0, "y").alias("y1"), at(2, "x").alias("x2"), at(2, "y").alias("y2"))
    rows = dealt(rows, rows.count(), "page")  # the one shuffle: blocks and pairs are by page too
    b = rows.groupBy("page", "block").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    corner = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return po.blocks_within(b.select("page", "block", F.array(corner("x1", "y1"), corner("x2", "y1"), corner("x2", "y2"), corner("x1", "y2")).alias("points")), "page")


SPANS = "SELECT l_orderkey AS doc, l_linenumber AS n, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY l_orderkey, l_linenumber"


@query(f"""
WITH s AS ({SPANS}), t AS (SELECT doc_id AS doc, CASE WHEN doc_id % 2 = 0 THEN text ELSE left(text, 60) || '~' END AS text, source, lang FROM documents),
m AS (SELECT doc * 10 + n AS mark, doc, n, 7 * n AS a, 7 * n + q AS z, t.text, source, lang FROM s JOIN t USING (doc)),
o AS (SELECT *, CASE WHEN a >= length(text) THEN '' ELSE substring(text, a + 1, q2) END AS original FROM (SELECT *, z - a + 1 AS q2 FROM m)),
p AS (SELECT *, array_to_string(list_transform(string_split(original, ''), lambda c, i: c || CASE WHEN (a + i - 1) % 5 = 0 AND a + i - 1 BETWEEN 5 AND 50 THEN '.' ELSE '' END), '') AS punctuated FROM o),
tr AS (SELECT mark, string_agg(s.n || '=' || CASE WHEN s.n % 2 = 0 THEN 'ko' ELSE 'en' END, ',' ORDER BY s.n) AS said FROM p JOIN s ON s.doc = p.doc AND 11 * s.n <= z AND 11 * s.n + 20 >= a GROUP BY mark),
an AS (SELECT mark, string_agg(s.n::VARCHAR, ',' ORDER BY s.n) AS noted FROM p JOIN s ON s.doc = p.doc AND s.q > 10 AND 13 * s.n <= z AND 13 * s.n + 5 >= a GROUP BY mark)
SELECT mark, md5(original) AS original_md5, md5(CASE WHEN doc % 2 = 0 AND original <> '' THEN punctuated ELSE original END) AS punctuated_md5, coalesce(said, '') AS said, coalesce(noted, '') AS noted, source || '/' || lang AS book,
  n % 3 = 1 AND original <> '' AS text_changed FROM p LEFT JOIN tr USING (mark) LEFT JOIN an USING (mark)
""")
def citation_resolve(t):
    """Marks on documents, every other of which is a block of its own, with translations and notes that overlap them."""
    s = t("lineitem").groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").cast("long").alias("q"))
    docs = t("documents")
    s = s.join(docs.select(F.col("doc_id").alias("doc")), "doc", "left_semi").withColumns({"page": F.lit(1), "block": F.concat(F.lit("b"), "doc")})
    even, odd = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    blocks = even.select(F.concat(F.lit("b"), "doc_id").alias("block"), "text")
    pages = odd.select(F.col("doc_id").alias("doc"), F.lit(1).alias("page"), F.concat(F.substring("text", 1, 60), F.lit("~")).alias("text"))
    texts = blocks.unionByName(pages.select(F.concat(F.lit("b"), "doc").alias("block"), "text"))
    marks = s.join(texts, "block").selectExpr("doc * 10 + n as mark", "doc", "page", "block", "int(7 * n) as start", "int(7 * n + q) as end", "case n % 3 when 0 then '' when 1 then 'was otherwise' else substring(text, int(7 * n) + 1, int(q) + 1) end as snapshot")
    points = even.select(F.concat(F.lit("b"), "doc_id").alias("block"), F.explode(F.sequence(F.lit(1), F.lit(10))).alias("seq")).selectExpr("block", "seq", "5 * seq as start", "5 * seq as end", "cast(null as string) as before", "'.' as after")
    said = s.selectExpr("doc", "page", "block", "n as seq", "n as id", "int(11 * n) as start", "int(11 * n + 20) as end", "'s' as source_text", "'t' as translation", "if(n % 2 = 0, null, 'en') as language", "cast(null as string) as status")
    noted = s.where("q > 10").selectExpr("doc", "page", "block", "n as seq", "n as id", "int(13 * n) as start", "int(13 * n + 5) as end", "'term' as type", "'l' as label", "cast(null as string) as description")
    out = ci.resolve(marks, blocks, pages, points, said, noted, docs.select(F.col("doc_id").alias("doc"), "source", "lang"))
    joined = lambda rows, show: F.array_join(F.transform(rows, show), ",")
    return out.select(
        "mark", F.md5("original").alias("original_md5"), F.md5("punctuated").alias("punctuated_md5"), joined("translations", lambda x: F.concat_ws("=", x["id"].cast("string"), x["language"])).alias("said"),
        joined("annotations", lambda x: x["id"].cast("string")).alias("noted"), F.concat_ws("/", "bibliography.source", "bibliography.lang").alias("book"), "text_changed",
    )


@query("""
WITH p AS (SELECT l_orderkey AS file, 'p' || l_partkey % 40 AS a, 'p' || l_suppkey % 40 AS b FROM lineitem), k AS (SELECT DISTINCT least('p' || x, 'p' || y) AS a, greatest('p' || x, 'p' || y) AS b FROM (SELECT unnest(range(0, 40)) AS x), (SELECT unnest(range(0, 40)) AS y) WHERE (x + y) % 5 = 0),
n AS (SELECT file, count(DISTINCT (least(a, b), greatest(a, b))) AS added FROM p WHERE a <> b AND NOT EXISTS (SELECT 1 FROM k WHERE k.a = least(p.a, p.b) AND k.b = greatest(p.a, p.b)) GROUP BY file)
SELECT p.file, ['csv', 'tsv', 'text', 'json'][p.file % 4 + 1] AS format, coalesce(any_value(added), 0) AS added, count(*) - coalesce(any_value(added), 0) AS skipped, 1::BIGINT AS n_errors FROM p LEFT JOIN n USING (file) GROUP BY p.file
""")
def variant_files(t):
    """A file of variants for each order, in one of four forms, with remarks and one line that has no pair."""
    rows = t("lineitem").selectExpr("l_orderkey as file", "concat('p', l_partkey % 40) as a", "concat('p', l_suppkey % 40) as b")
    rows = dealt(rows, rows.count(), "file")
    rows = rows.select("file", F.expr("element_at(array(concat(a, ' , ', b), concat(a, '\\t', b), concat(a, if(a < b, ' ↔ ', '→'), b), concat('[\"', a, '\", \"', b, '\"]')), int(file % 4) + 1)").alias("line"))
    body = rows.groupBy("file").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    head = F.expr("element_at(array('# a,b\\n// c,d\\n', '# a\\tb\\n// c\\td\\n', '# a b\\n\\n', ''), int(file % 4) + 1)")
    text = F.when(F.col("file") % 4 == 3, F.concat(F.lit("[['x'], ".replace("'", '"')), F.array_join("lines", ", "), F.lit("]"))).otherwise(F.concat(head, F.array_join("lines", "\n"), F.lit("\nalone\n")))
    n = t("nation").selectExpr("explode(sequence(0, 39)) as x").distinct()
    known = n.join(n.selectExpr("x as y"), F.pmod(-F.col("x"), F.lit(5)) == F.col("y") % 5).selectExpr("concat('p', x) as a", "concat('p', y) as b")
    _, report = va.import_variants(body.select("file", text.alias("text")), known)
    return report.select("file", "format", "added", "skipped", F.size("errors").cast("long").alias("n_errors"))
