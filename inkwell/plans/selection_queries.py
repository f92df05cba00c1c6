"""Queries of choosing, ordering, defaults, registration and dependencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as se
from ..operators import stewardship as st
from .registry import query


def annotated(t):
    """Orders as pages: blocks by line number, with their parts as annotations."""
    a = t("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.collect_list(F.struct(F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("type"), F.expr("if(l_linestatus = 'F', 'checked', null)").alias("current_stage"))).alias("annotations"))
    return a.groupBy(F.col("l_orderkey").alias("page")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("block_id"), "annotations")).alias("blocks"))


@query("SELECT l_orderkey AS page, l_linenumber AS block_id, l_partkey AS id FROM lineitem WHERE l_returnflag = 'R'")
def annotations_by_type(t):
    return se.annotations_of(annotated(t), "page", kind="R").select("page", "block_id", "id")


@query("SELECT l_orderkey AS page, l_linenumber AS block_id, l_partkey AS id FROM lineitem WHERE l_linestatus <> 'F'")
def annotations_by_stage(t):
    return se.annotations_of(annotated(t), "page", stage="none").select("page", "block_id", "id")


@query("""
SELECT o_custkey, o_orderkey AS block_id, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 999 ELSE o_orderkey * 7 % 50 END, o_orderkey) AS rank
FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 30)
""")
def blocks_to_run(t):
    blocks = t("orders").selectExpr("o_custkey", "o_orderkey as block_id", "if(o_orderkey % 5 = 0, true, if(o_orderkey % 5 = 1, null, false)) as skip", "if(o_orderstatus = 'P', null, o_orderkey * 7 % 50) as reading_order", "o_orderkey as pos")
    wanted = t("lineitem").where("l_quantity > 30").selectExpr("l_orderkey as block_id")
    return se.by_reading_order(se.blocks_to_run(blocks, wanted), "o_custkey").select("o_custkey", "block_id", "rank")


@query("SELECT event_id, event_type AS cls FROM events WHERE value / 100 >= 0.3 AND event_type NOT IN ('view') AND value IS NOT NULL")
def detections_above(t):
    rows = t("events").selectExpr("event_id", "event_type as cls", "value / 100 as conf")
    return se.detections_above(rows, 0.3, ["view"]).select("event_id", "cls")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 OR c_mktsegment IS NULL THEN false ELSE o_orderstatus <> left(c_mktsegment, 1) END AS changed FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def text_changed(t):
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select("o_orderkey", se.text_changed(F.expr("if(o_orderkey % 4 = 0, '', o_orderstatus)"), F.expr("left(c_mktsegment, 1)")).alias("changed"))


@query("SELECT 'c' || o_custkey AS repo, string_agg('.git/objects/' || o_orderkey, ',' ORDER BY '.git/objects/' || o_orderkey) AS files FROM orders WHERE o_orderkey % 9 = 0 GROUP BY o_custkey")
def contaminated_repos(t):
    paths = t("orders").selectExpr("concat('c', o_custkey) as repo", "concat(if(o_orderkey % 9 = 0, '.git/objects/', 'L4_text/.git/'), o_orderkey) as path")
    return se.contaminated(paths, "repo", "path").select("repo", F.array_join("files", ",").alias("files"))


@query("SELECT p_partkey, p_partkey % 6 IN (0, 1, 2) AS decorative FROM part")
def decorative_images(t):
    name = F.expr("concat('https://x.org/logo/', element_at(array('Site_LOGO_', 'nav-', 'bg', 'page_', 'scan', 'leaf'), int(p_partkey % 6) + 1), p_partkey, '.png?icon=1#menu')")
    return t("part").select("p_partkey", se.decorative(name).alias("decorative"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'image' WHEN 2 THEN 'pdf' WHEN 3 THEN 'image' END AS kind FROM part")
def download_kinds(t):
    url = F.expr("concat('https://x.org/a', p_partkey, element_at(array('.PDF', '.jpeg?x=.pdf', '/view', '/img.php', '/page.html'), int(p_partkey % 5) + 1))")
    kind = F.expr("element_at(array('text/html', 'application/pdf', 'Application/PDF; q=1', 'image/png', 'text/html'), int(p_partkey % 5) + 1)")
    return t("part").select("p_partkey", se.download_kind(url, kind).alias("kind"))


@query("""
WITH e AS (SELECT DISTINCT c_name AS a, n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey), s AS (SELECT * FROM e UNION SELECT b, a FROM e),
n AS (SELECT a, count(*) AS n FROM s GROUP BY a), p AS (SELECT a, b, n, row_number() OVER (ORDER BY n DESC, a, b) AS rank FROM s JOIN n USING (a) WHERE a < b AND (contains(a, '11') OR contains(b, '11')))
SELECT rank, a, b, n FROM p WHERE rank <= 500
""")
def variant_search(t):
    edges = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_name").alias("a"), F.col("n_name").alias("b"))
    return se.search_variants(edges, "11", by_count=True)


@query("SELECT c_custkey, c_name, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey")
def related_interpretations(t):
    return se.related(t("customer").select("c_custkey", "c_name"), t("orders").select("o_orderkey", "o_custkey"), "c_custkey", "o_custkey").select("c_custkey", "c_name", "o_orderkey")


@query("SELECT ps.l_orderkey, l_linenumber FROM lineitem ps WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 25)")
def selected_assets(t):
    return se.selected(t("lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("asset")), t("part").where("p_size > 25").select(F.col("p_partkey").alias("asset")), "asset").select("l_orderkey", "l_linenumber")


@query("SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY length(p_name) DESC, p_partkey) AS rank FROM part")
def longest_headwords(t):
    return se.longest_first(t("part").select("p_brand", "p_partkey", "p_name"), "p_brand", "p_name", "p_partkey").select("p_brand", "p_partkey", "rank")


@query("SELECT l_orderkey, string_agg(l_returnflag || l_partkey, ' ' ORDER BY l_quantity, l_linenumber, l_returnflag || l_partkey) AS text FROM lineitem GROUP BY l_orderkey")
def translations_in_order(t):
    rows = t("lineitem").selectExpr("l_orderkey", "l_quantity as start", "l_linenumber as seq", "concat(l_returnflag, l_partkey) as words")
    return se.joined_in_order(rows, "l_orderkey", ["start", "seq"], "words", " ").select("l_orderkey", "text")


@query("SELECT l_orderkey AS page, l_linenumber AS id, l_partkey AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey DESC, l_partkey * 10 + l_linenumber) AS rank FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)")
def lines_right_to_left(t):
    lines = t("lineitem").selectExpr("l_orderkey as page", "l_linenumber as id", "l_partkey as part", "l_suppkey as x1", "l_partkey * 10 + l_linenumber as key").distinct()
    return se.right_to_left(lines, "page", "key").select("page", "id", "part", "rank")


@query("""
WITH g AS (SELECT DISTINCT l_orderkey AS page, l_partkey * 10 + l_linenumber AS key, (l_partkey % 700)::DOUBLE AS cx, (l_suppkey % 90)::DOUBLE AS cy FROM lineitem),
b AS (SELECT *, coalesce(lag(cx) OVER (PARTITION BY page ORDER BY cx DESC, key) - cx > 50, false)::INT AS begins FROM g),
c AS (SELECT *, sum(begins) OVER (PARTITION BY page ORDER BY cx DESC, key) AS col FROM b)
SELECT page, key, row_number() OVER (PARTITION BY page ORDER BY col, cy, key) AS rank FROM c
""")
def groups_in_columns(t):
    g = t("lineitem").selectExpr("l_orderkey as page", "l_partkey * 10 + l_linenumber as key", "double(l_partkey % 700) as cx", "double(l_suppkey % 90) as cy").distinct()
    return se.groups_in_columns(g, "page", "key").select("page", "key", "rank")


@query("SELECT DISTINCT l_partkey AS headword, l_suppkey AS dict, l_linenumber AS pos FROM lineitem")
def distinct_matches(t):
    return se.distinct_matches(t("lineitem").selectExpr("l_partkey as headword", "l_suppkey as dict", "l_linenumber as pos", "l_orderkey")).select("headword", "dict", "pos")


@query("SELECT p_partkey, regexp_matches(v, '^[a-z][a-z0-9_]{0,63}$') AS document, regexp_matches('variant_' || v, '^variant_[a-zA-Z0-9_\\-]+$') AS variant FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN lower(replace(p_name, ' ', '_')) WHEN 1 THEN p_name ELSE p_brand END AS v FROM part)")
def valid_ids(t):
    rows = t("part").selectExpr("p_partkey", "case p_partkey % 3 when 0 then lower(replace(p_name, ' ', '_')) when 1 then p_name else p_brand end as v")
    return rows.select("p_partkey", se.valid_id(F.col("v"), "document").alias("document"), se.valid_id(F.concat(F.lit("variant_"), "v"), "variant").alias("variant"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'draft' ELSE o_orderstatus END AS status, 'ko' AS target_language, 'human' AS translator FROM orders")
def default_fill(t):
    rows = t("orders").selectExpr("o_orderkey", "if(o_orderstatus = 'P', null, o_orderstatus) as status")
    return st.with_defaults(rows, "translation").select("o_orderkey", "status", "target_language", F.col("translator.type").alias("translator"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'none' END AS current_stage, o_orderkey % 3 = 0 AS no_history, '2.0' AS schema_version FROM orders")
def annotation_migration(t):
    rows = t("orders").selectExpr("o_orderkey", "if(o_orderkey % 3 = 0, '2.0', if(o_orderkey % 3 = 1, '1.0', null)) as schema_version", "if(o_orderkey % 3 <> 0 and o_orderkey % 2 = 0, o_orderstatus, null) as current_stage", "cast(null as array<string>) as generation_history")
    return st.migrate_annotations(rows).select("o_orderkey", "current_stage", F.col("generation_history").isNull().alias("no_history"), "schema_version")


@query("""
SELECT c_custkey AS id, c_name AS title FROM customer WHERE c_nationkey < 12
UNION ALL SELECT o_custkey, 'order ' || min(o_orderkey) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 12) GROUP BY o_custkey
""")
def register_documents(t):
    known = t("customer").where("c_nationkey < 12").selectExpr("c_custkey as id", "c_name as title")
    return st.register(known, t("orders").selectExpr("o_custkey as id", "concat('order ', o_orderkey) as title", "o_orderkey as pos"), "id")


FILES = "SELECT l_orderkey AS base, l_partkey * 10 + l_linenumber AS path, CASE WHEN l_returnflag = 'A' THEN 'changed' WHEN l_returnflag = 'R' AND l_linenumber > 3 THEN 'updated' ELSE 'unchanged' END AS status, l_quantity FROM lineitem"


@query(f"""
WITH f AS (SELECT base, CASE WHEN status = 'changed' AND l_quantity > 20 THEN 'acknowledged' ELSE status END AS status FROM ({FILES}))
SELECT base, CASE WHEN bool_and(status IN ('unchanged', 'updated')) THEN 'current' WHEN bool_and(status IN ('unchanged', 'updated', 'acknowledged')) THEN 'acknowledged'
  WHEN bool_or(status = 'acknowledged') AND bool_or(status = 'changed') THEN 'partially_acknowledged' ELSE 'outdated' END AS status, count(*) FILTER (status = 'changed') AS n_changed FROM f GROUP BY base
""")
def acknowledge_changes(t):
    files = t("lineitem").selectExpr("l_orderkey as base", "l_partkey * 10 + l_linenumber as path", "case when l_returnflag = 'A' then 'changed' when l_returnflag = 'R' and l_linenumber > 3 then 'updated' else 'unchanged' end as status", "l_quantity").withColumn("row", F.struct("path", "l_quantity"))
    return st.dependency_status(st.acknowledge(files, files.where("l_quantity > 20").select("base", "row"), ["base", "row"]), "base")


@query("SELECT doc_id, 'd/L4_text/p' || doc_id || CASE doc_id % 2 WHEN 0 THEN '.txt' ELSE '.json' END AS path, 'sha256:' || sha256(text) AS hash, 'unchanged' AS status FROM documents WHERE doc_id % 4 <> 3 AND doc_id % 4 <> 2")
def tracked_files(t):
    path = F.expr("concat(if(doc_id % 4 = 2, 'd/L3_layout/p', 'd/L4_text/p'), doc_id, case doc_id % 4 when 0 then '.txt' when 1 then '.json' when 2 then '.txt' else '.png' end)")
    return st.tracked_files(t("documents").select("doc_id", path.alias("path"), "text"), "path", "text")


@query("SELECT path, 'sha256:' || sha256(text) AS hash_at_base, 'unchanged' AS status FROM (SELECT 'L4_text/p' || doc_id || '.txt' AS path, text FROM documents)")
def update_base(t):
    now = st.tracked_files(t("documents").select(F.concat(F.lit("L4_text/p"), "doc_id", F.lit(".txt")).alias("path"), "text"), "path", "text")
    return st.rebase(now, ["path"])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'order ' || o_orderkey || '  ' ELSE 'order ' || o_orderkey || chr(10) || chr(10) || 'Based-On-Original: ' || md5(o_custkey::VARCHAR) END AS message FROM orders")
def commit_trailer(t):
    message = F.concat(F.lit("order "), "o_orderkey", F.lit("  "))
    return t("orders").select("o_orderkey", st.with_trailer(message, F.when(F.col("o_orderkey") % 3 != 0, F.md5(F.col("o_custkey").cast("string")))).alias("message"))


@query("SELECT c_custkey, i::INT AS section_index, 10 + i AS page_num, c_mktsegment AS part_id FROM (SELECT *, unnest(range(0, c_custkey % 4)) AS i FROM customer)")
def auto_page_mapping(t):
    rows = t("customer").selectExpr("c_custkey", "c_mktsegment", "cast(c_custkey % 4 as int) as n")
    return st.auto_pages(rows, "c_custkey", "n", F.lit(10), F.col("c_mktsegment"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') AS iso FROM events")
def iso_times(t):
    return t("events").select("event_id", st.iso_time(F.col("ts")).alias("iso"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN l_quantity < 25 THEN 30 WHEN l_quantity + 10 < 45 THEN 50 ELSE 100 END WHEN 1 THEN CASE WHEN l_quantity + 10 < 45 THEN 50 ELSE 100 END ELSE 100 END AS size FROM lineitem
""")
def recogniser_routing(t):
    size = st.recogniser(F.expr("element_at(array(3, 2, 1), int(l_linenumber % 3) + 1)"), {30: F.col("l_quantity"), 50: F.col("l_quantity") + 10})
    return t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", size.alias("size"))


@query("SELECT o_orderkey, array_to_string(list_filter(['L1', 'L3', 'L4', 'L6'], lambda x: (x = 'L1' AND o_orderkey % 2 = 0) OR (x = 'L3' AND o_orderkey % 3 = 0) OR x = 'L4' OR (x = 'L6' AND o_orderstatus = 'F')), ',') AS layers FROM orders")
def snapshot_layers(t):
    flags = st.layer_flags({"L1": F.expr("int(o_orderkey % 2 = 0)"), "L3": F.expr("int(o_orderkey % 3 = 0)"), "L4": F.lit(1), "L6": F.expr("if(o_orderstatus = 'F', 5, 0)")})
    return t("orders").select("o_orderkey", F.array_join(flags, ",").alias("layers"))


@query("""
SELECT event_id, CASE WHEN event_id % 3 < 2 THEN 'doc_' || event_id END AS original_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') END AS trashed_at FROM events
""")
def trash_listing(t):
    name = F.expr("case event_id % 3 when 0 then concat(date_format(ts, \"yyyyMMdd'T'HHmmss\"), '_doc_', event_id) when 1 then concat('20261399T000000_doc_', event_id) else concat('doc', event_id) end")
    return t("events").select("event_id", st.trash_entry(name).alias("e")).select("event_id", "e.*")


@query("""
WITH f AS (SELECT o_custkey AS doc, o_orderkey % 5 AS k, (o_orderkey // 5 % 3)::INT AS p FROM orders),
n AS (SELECT DISTINCT doc, p, k, CASE k WHEN 0 THEN 'v1_page_' || lpad(p::VARCHAR, 3, '0') || '.tif' WHEN 1 THEN 'v1_page_' || lpad(p::VARCHAR, 3, '0') || '.PNG' WHEN 2 THEN 'page_' || lpad(p::VARCHAR, 3, '0') || '.jpg' WHEN 3 THEN 'scan_p' || lpad(p::VARCHAR, 4, '0') || '.png' ELSE 'scan_p' || lpad(p::VARCHAR, 3, '0') || '.txt' END AS name FROM f),
b AS (SELECT doc, p, min_by(name, k) AS name FROM n WHERE k IN (0, 2, 3) GROUP BY ALL)
SELECT c_custkey AS doc, w AS page_num, name FROM customer, (SELECT unnest([0, 1, 2, 3])::INT AS w) LEFT JOIN b ON doc = c_custkey AND p = w
""")
def page_image_lookup(t):
    files = t("orders").selectExpr("o_custkey as doc", "o_orderkey % 5 as k", "int(o_orderkey div 5 % 3) as p")
    name = F.expr("case k when 0 then format_string('v1_page_%03d.tif', p) when 1 then format_string('v1_page_%03d.PNG', p) when 2 then format_string('page_%03d.jpg', p) when 3 then format_string('scan_p%04d.png', p) else format_string('scan_p%03d.txt', p) end")
    wanted = t("customer").select(F.col("c_custkey").alias("doc"), F.lit("v1").alias("part_id"), F.explode(F.array(*(F.lit(i) for i in range(4)))).alias("page_num"))
    return st.page_image(wanted, files.select("doc", name.alias("name")).distinct()).select("doc", "page_num", "name")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 1 THEN 'body' END, CASE WHEN o_orderkey % 2 = 0 THEN 'query' END, o_orderstatus) AS block_id FROM orders")
def stage_block(t):
    body, asked = F.expr("if(o_orderkey % 4 = 1, 'body', '')"), F.expr("if(o_orderkey % 2 = 0, 'query', null)")
    return t("orders").select("o_orderkey", st.first_given(body, asked, F.col("o_orderstatus")).alias("block_id"))
