"""Queries of small operators, and of whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ca
from ..operators import dictionary as di
from ..operators import layout as la
from ..operators import lineage as li
from ..operators import records as rc
from ..operators import reports as rp
from ..operators import selection as se
from ..operators import spans as sp
from ..operators import texts as tx
from ..operators import usage as us
from .layout_queries import LINES, boxes
from .registry import query


@query("""
SELECT o_orderkey, i - 1 AS pos, k AS c_custkey, c_name, c_name IS NOT NULL AS found FROM (SELECT o_orderkey, unnest([o_custkey, o_custkey + 1000, o_custkey * 2]) AS k, unnest([1, 2, 3]) AS i FROM orders) LEFT JOIN customer ON c_custkey = k
""")
def mark_lookup_in_order(t):
    wanted = t("orders").select("o_orderkey", F.array(F.col("o_custkey"), F.col("o_custkey") + 1000, F.col("o_custkey") * 2).alias("ids"))
    return rc.lookup_in_order(wanted, t("customer").select("c_custkey", "c_name"), "c_custkey", "ids", "o_orderkey").select("o_orderkey", "pos", "c_custkey", "c_name", "found")


@query("""
SELECT page, coalesce(target, page) AS target FROM (SELECT DISTINCT l_partkey AS page FROM lineitem) LEFT JOIN (SELECT l_partkey AS page, min_by(l_suppkey, l_orderkey * 100000 + l_linenumber * 1000 + l_suppkey) AS target FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) USING (page)
""")
def page_target(t):
    li_ = t("lineitem")
    mapping = li_.where("l_returnflag = 'A'").selectExpr("l_partkey as page", "l_suppkey as target", "l_orderkey * 100000 + l_linenumber * 1000 + l_suppkey as pos")
    return rc.first_or_identity(li_.select(F.col("l_partkey").alias("page")).distinct(), mapping)


@query("""
WITH a AS (SELECT conv_id, max(text) AS text FROM conversations WHERE role = 'system' GROUP BY 1), b AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' AND turn > 2 GROUP BY 1), k AS (SELECT DISTINCT conv_id FROM conversations)
SELECT conv_id, coalesce(nullif(a.text, ''), nullif(b.text, ''), '') AS text, CASE WHEN nullif(a.text, '') IS NOT NULL THEN 0 WHEN nullif(b.text, '') IS NOT NULL THEN 1 END AS source FROM k LEFT JOIN a USING (conv_id) LEFT JOIN b USING (conv_id)
""")
def block_text_cascade(t):
    c = t("conversations")
    a = c.where("role = 'system'").groupBy("conv_id").agg(F.max("text").alias("text"))
    b = c.where("role = 'assistant' and turn > 2").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), " ").alias("text"))
    return rc.cascade(c.select("conv_id").distinct(), "conv_id", [a, b])


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = d.doc_id % 2)")
def uncomposed_blocks(t):
    done = t("labels").selectExpr("doc_id", "quality as page").distinct()
    return se.not_composed(t("documents").selectExpr("doc_id", "source", "cast(doc_id % 2 as int) as page"), done, ["doc_id", "page"]).select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) THEN 'accepted' WHEN doc_id % 3 = 0 THEN 'draft' ELSE 'reviewed' END AS status FROM documents")
def drafts_accepted(t):
    rows = t("documents").selectExpr("doc_id", "if(doc_id % 3 = 0, 'draft', 'reviewed') as status")
    return rc.accept_drafts(rows, t("labels").where("quality = 1"), "doc_id")


@query("SELECT conv_id, string_agg(role, ',' ORDER BY turn) FILTER (NOT (n = 2 AND role = 'user')) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) GROUP BY conv_id")
def delete_item(t):
    rows = t("conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))
    rows = rc.delete_at(rows, "roles", F.lit(1), lambda x: x == "user")
    return rows.select("conv_id", F.array_join("roles", ",").alias("roles"))


@query("SELECT event_type, count(value) AS num, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(median(value), 4) AS median FROM events GROUP BY event_type")
def timing_stats(t):
    return us.timing_stats(t("events"), "event_type", "value")


@query("SELECT l_orderkey, list_sort(list(l_quantity))[len(list(l_quantity)) // 2 + 1] AS upper FROM lineitem GROUP BY l_orderkey")
def order_median(t):
    return t("lineitem").groupBy("l_orderkey").agg(us.upper_median(F.col("l_quantity")).alias("upper"))


@query("""
WITH l AS (SELECT user_id, props, max((ts, event_id)) AS last FROM events GROUP BY ALL)
SELECT user_id, props, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY last DESC) AS rank FROM l) WHERE rank <= 5
""")
def recent_items(t):
    return us.recent(t("events"), "user_id", "props", "ts", "event_id", 5)


@query("""
WITH c AS (SELECT p_partkey, p_name, unnest(range(0, length(p_name))) AS i, (p_partkey % 50)::DOUBLE AS x1, (p_size)::DOUBLE AS y1, (p_partkey % 50 + 120)::DOUBLE AS x2, (p_size + CASE WHEN p_partkey % 2 = 0 THEN 300 ELSE 20 END)::DOUBLE AS y2, length(p_name) AS n, p_partkey % 2 = 0 AS tall FROM part)
SELECT p_partkey, i, substring(p_name, i + 1, 1) AS char, round(CASE WHEN tall THEN x1 ELSE x1 + (x2 - x1) * i / n END, 6) AS x1, round(CASE WHEN tall THEN y1 + (y2 - y1) * i / n ELSE y1 END, 6) AS y1, round(CASE WHEN tall THEN x2 ELSE x1 + (x2 - x1) * (i + 1) / n END, 6) AS x2, round(CASE WHEN tall THEN y1 + (y2 - y1) * (i + 1) / n ELSE y2 END, 6) AS y2 FROM c
""")
def char_boxes(t):
    lines = t("part").selectExpr("p_partkey", "p_name", "double(p_partkey % 50) as x1", "double(p_size) as y1", "double(p_partkey % 50 + 120) as x2", "double(p_size + if(p_partkey % 2 = 0, 300, 20)) as y2")
    return la.char_boxes(lines, "p_partkey", "p_name").select("p_partkey", "i", "char", *(F.round(c, 6).alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("SELECT l_orderkey, min(l_partkey) AS x1, min(l_suppkey) AS y1, max(l_partkey) AS x2, max(l_suppkey) AS y2 FROM lineitem GROUP BY l_orderkey")
def polygon_boxes(t):
    points = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("x"), F.col("l_suppkey").alias("y"))).alias("p"))
    return points.select("l_orderkey", la.polygon_box(F.col("p")).alias("b")).select("l_orderkey", "b.*")


@query("""
WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_partkey % 500 END AS a, CASE WHEN l_linenumber % 2 = 0 THEN l_tax ELSE l_suppkey % 400 END AS b, CASE WHEN l_linenumber % 2 = 0 THEN 0.5 ELSE l_partkey % 500 + l_quantity - 3 END AS c, CASE WHEN l_linenumber % 2 = 0 THEN 0.25 ELSE l_suppkey % 400 + 30 END AS d FROM lineitem),
s AS (SELECT *, a BETWEEN 0 AND 1 AND b BETWEEN 0 AND 1 AND c BETWEEN 0 AND 1 AND d BETWEEN 0 AND 1 AS s FROM b),
p AS (SELECT *, least(greatest(floor(CASE WHEN s THEN a * 480 ELSE a END - 2), 0), 480)::BIGINT AS x1, least(greatest(floor(CASE WHEN s THEN b * 360 ELSE b END - 2), 0), 360)::BIGINT AS y1, least(greatest(floor(CASE WHEN s THEN (a + c) * 480 ELSE c END + 2), 0), 480)::BIGINT AS x2, least(greatest(floor(CASE WHEN s THEN (b + d) * 360 ELSE d END + 2), 0), 360)::BIGINT AS y2 FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, x1, y1, x2, y2 FROM p WHERE x2 > x1 AND y2 > y1
""")
def crop_boxes(t):
    b = F.expr("if(l_linenumber % 2 = 0, array(l_discount, l_tax, 0.5D, 0.25D), array(double(l_partkey % 500), double(l_suppkey % 400), l_partkey % 500 + l_quantity - 3, double(l_suppkey % 400 + 30)))")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", la.crop_box(b, F.lit(480), F.lit(360), 2).alias("b")).where("b is not null")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "b.*")


@query(f"""
WITH RECURSIVE l AS (SELECT page, id, min(x1) AS x1, min(y1) AS y1, min(x2) AS x2, min(y2) AS y2 FROM ({LINES}) GROUP BY page, id), x AS (SELECT *, -((x1 + x2) / 2) AS x FROM l),
n AS (SELECT *, CASE WHEN x - lag(x) OVER w > 40 THEN 1 ELSE 0 END AS new FROM x WINDOW w AS (PARTITION BY page ORDER BY x, y1, id)),
c AS (SELECT *, sum(new) OVER (PARTITION BY page ORDER BY x, y1, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS col FROM n),
b AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY col, y1, id) AS i, {{'id': id, 'conf': id % 97 / 97.0, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 'a': (x2 - x1) * (y2 - y1)}} AS b FROM c),
r(page, i, kept) AS (
  SELECT page, i, [b] FROM b WHERE i = 1
  UNION ALL
  SELECT r.page, b.i, CASE WHEN NOT (least(kept[-1].a, b.b.a) > 0 AND greatest(least(kept[-1].x2, b.b.x2) - greatest(kept[-1].x1, b.b.x1), 0) * greatest(least(kept[-1].y2, b.b.y2) - greatest(kept[-1].y1, b.b.y1), 0) > 0.3 * least(kept[-1].a, b.b.a)) THEN list_append(kept, b.b)
    WHEN b.b.conf > kept[-1].conf THEN list_append(kept[1:len(kept) - 1], b.b) ELSE kept END
  FROM r JOIN b ON b.page = r.page AND b.i = r.i + 1)
SELECT page, unnest(kept).id AS id FROM (SELECT page, max_by(kept, i) AS kept FROM r GROUP BY page)
""")
def adjacent_duplicates(t):
    lines = boxes(t)[0].groupBy("page", "id").agg(*(F.min(c).alias(c) for c in ("x1", "y1", "x2", "y2")))
    ranked = la.reading_order(lines, "page", 40.0).join(lines, ["page", "id"]).withColumn("conf", F.col("id") % 97 / 97.0)
    return la.drop_adjacent(ranked.select("page", "id", "rank", "conf", "x1", "y1", "x2", "y2"), "page", 0.3).select("page", "id")


@query("SELECT doc_id, n_chars > 5000 AS too_large, contains(text, '@@') AS is_binary FROM documents")
def blob_guards(t):
    large, binary = li.blob_guards(F.col("n_chars"), F.col("text"), 5000, "@@")
    return t("documents").select("doc_id", large.alias("too_large"), binary.alias("is_binary"))


@query("SELECT doc_id, length(text) - length(replace(text, 'q', '')) AS matches FROM documents WHERE contains(text, 'q')")
def batch_correct_preview(t):
    return tx.search_char(t("documents").select("doc_id", "text"), "q", "doc_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("matches"))


@query("""
WITH s AS (SELECT l_orderkey AS block, l_linenumber AS id, l_partkey AS p, l_returnflag AS f, 10 * l_linenumber AS start, 10 * l_linenumber + l_quantity::INT AS "end" FROM lineitem),
m AS (SELECT DISTINCT block, id, start, "end" FROM s WHERE f = 'A'),
r AS (SELECT m.block, m.id, m.start, m."end", count(DISTINCT t.id) AS n FROM m LEFT JOIN (SELECT * FROM s WHERE f = 'R') t ON t.block = m.block AND t.start <= m."end" AND t."end" >= m.start GROUP BY ALL)
SELECT block, id, start, "end", array_to_string(['《order ' || block || '》', 'status ' || o_orderstatus, CASE WHEN n > 0 THEN n || ' notes' END], ', ') AS citation FROM r JOIN orders ON o_orderkey = block
""")
def citation_export(t):
    """Marks with the notes that overlap them and their work, as one citation each."""
    s = t("lineitem").selectExpr("l_orderkey as block", "l_linenumber as id", "l_returnflag as f", "10 * l_linenumber as start", "10 * l_linenumber + cast(l_quantity as int) as end")
    marks, notes = s.where("f = 'A'").drop("f").distinct(), s.where("f = 'R'").selectExpr("block", "id as note", "start", "end")
    found = sp.overlap_join(marks, notes, "block", "left").groupBy("block", "id", "start", "end").agg(F.count_distinct("note").alias("n"))
    works = t("orders").selectExpr("o_orderkey as block", "o_orderstatus as status")
    parts = [F.concat(F.lit("<order "), "block", F.lit(">")), F.concat(F.lit("status "), "status"), F.when(F.col("n") > 0, F.concat("n", F.lit(" notes")))]
    return found.join(works, "block").select("block", "id", "start", "end", ca.format_citation(parts).alias("citation"))


@query("""
WITH m AS (SELECT d.doc_id, b.item_id, instr(d.text, b.text) AS p FROM documents d JOIN (SELECT text, min(item_id) AS item_id FROM benchmark GROUP BY text) b ON contains(d.text, b.text))
SELECT doc_id, string_agg('item ' || item_id || ': known', chr(10) ORDER BY item_id) AS context FROM m GROUP BY doc_id
""")
def dictionary_context(t):
    """Each document's context lines: the dictionary entries that occur in it."""
    items = t("benchmark").groupBy("text").agg(F.min("item_id").alias("pos")).withColumnRenamed("text", "headword")
    m = di.substring_join(t("documents").select("doc_id", "text"), items.select("headword"), "doc_id").select("doc_id", "headword").distinct().join(items, "headword")
    return di.context_text(m.select("doc_id", "pos", F.concat(F.lit("item "), "pos").alias("headword"), F.lit("known").alias("meaning")), "doc_id")


@query("""
WITH r AS (SELECT conv_id, turn, 'm' || conv_id AS manifest FROM conversations)
SELECT manifest, turn AS canvas, 'https://x/' || conv_id || '/full/!800,800/' || turn AS image, 'title ' || conv_id AS label FROM r JOIN (SELECT DISTINCT conv_id FROM conversations) USING (conv_id)
""")
def iiif_flatten(t):
    """Manifests as JSON with values in two shapes, flattened to canvases."""
    c = t("conversations")
    made = c.groupBy("conv_id").agg(F.to_json(F.struct(F.concat(F.lit("m"), F.first("conv_id")).alias("id"), F.array(F.struct(F.concat(F.lit("title "), F.first("conv_id")).alias("@value"))).alias("label"), F.collect_list(F.struct("turn", F.concat(F.lit("https://x/"), "conv_id", F.lit("/full/full/"), "turn").alias("image"))).alias("canvases"))).alias("json"))
    parsed = made.select(F.parse_json("json").alias("v"), F.from_json("json", "canvases array<struct<turn: bigint, image: string>>").alias("s"))
    label = F.coalesce(F.try_variant_get("v", '$.label[0]["@value"]', "string"), F.try_variant_get("v", "$.label", "string"))
    rows = parsed.select(F.variant_get("v", "$.id", "string").alias("manifest"), label.alias("label"), F.inline("s.canvases"))
    return rows.select("manifest", F.col("turn").alias("canvas"), F.replace("image", F.lit("/full/full/"), F.lit("/full/!800,800/")).alias("image"), "label")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS n, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS holders FROM lineitem GROUP BY l_partkey")
def holdings(t):
    return rp.holdings(t("lineitem"), "l_partkey", "l_suppkey")


@query("SELECT count(DISTINCT a) AS size, count(DISTINCT (least(a, b), greatest(a, b))) AS pair_count FROM (SELECT l_suppkey % 90 AS a, l_partkey % 90 AS b FROM lineitem UNION SELECT l_partkey % 90, l_suppkey % 90 FROM lineitem)")
def variant_pair_count(t):
    return rp.dictionary_size(t("lineitem").selectExpr("l_suppkey % 90 as a", "l_partkey % 90 as b"))


@query("SELECT event_id, 'sha256:' || sha256(props) AS hash FROM events")
def content_hashes(t):
    return t("events").select("event_id", li.content_hash(F.col("props")).alias("hash"))
