"""Queries of the source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tasks import dealt
from ..sources import packages as pk
from ..sources import pages as pg
from ..sources import work_snapshots as ws
from ..streaming.usage import shared_folder
from .registry import query


@query("SELECT conv_id, turn, 'docs/c' || conv_id || '/p1_page_' || lpad(turn::VARCHAR, 3, '0') || '.json' AS path, 'p1' AS part_id, turn::INT AS page_num FROM conversations")
def page_path_round_trip(t):
    rows = t("conversations").select("conv_id", "turn", pg.page_path(F.concat(F.lit("docs/c"), "conv_id"), F.lit("p1"), F.col("turn"), ".json").alias("path"))
    return rows.withColumn("k", pg.page_key(F.col("path"))).select("conv_id", "turn", "path", "k.part_id", "k.page_num")


@query("""
SELECT o_orderkey AS doc_id, '1' AS part_id, l.doc_id IS NOT NULL AS exists, coalesce(md5(text), md5('')) AS text_md5 FROM orders LEFT JOIN documents l ON l.doc_id = o_orderkey
""")
def page_point_read(t):
    pages = t("documents").select("doc_id", F.lit("1").alias("part_id"), F.lit(1).alias("page_num"), "text")
    wanted = t("orders").select(F.col("o_orderkey").alias("doc_id"), F.lit("1").alias("part_id"), F.lit(1).alias("page_num"))
    return pg.page_text(pages, wanted).select("doc_id", "part_id", "exists", F.md5("text").alias("text_md5"))


@query("""
WITH a AS (SELECT conv_id, turn, text, 0 AS priority FROM conversations WHERE role = 'assistant' UNION ALL SELECT conv_id, turn + 1, text, 1 FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id, turn, 'none', 2 FROM conversations)
SELECT conv_id, turn, text, priority FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY priority) AS n FROM a) WHERE n = 1
""")
def layer_fallback(t):
    c = t("conversations")
    layers = [c.where("role = 'assistant'").select("conv_id", "turn", "text"), c.where("role = 'user'").selectExpr("conv_id", "turn + 1 as turn", "text"), c.selectExpr("conv_id", "turn", "'none' as text")]
    return pg.prefer(layers, ["conv_id", "turn"])


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'hwp' WHEN 1 THEN 'hwpx' WHEN 2 THEN 'pdf' ELSE 'other' END AS format FROM documents")
def format_sniff(t):
    head = F.expr("case doc_id % 4 when 0 then unhex('D0CF11E0A1B11AE1') when 1 then unhex('504B0304') when 2 then unhex('25504446') else unhex('00') end")
    return t("documents").select("doc_id", pg.sniff_format(F.concat(head, F.encode("text", "UTF-8"))).alias("format"))


@query("""
WITH p AS (SELECT doc_id, generate_subscripts(s, 1) - 1 AS i, unnest(s) AS text FROM (SELECT doc_id, string_split(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\r]', '', 'g'), chr(10) || chr(10)) AS s FROM documents)),
l AS (SELECT doc_id, i, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)) AS text FROM p)
SELECT doc_id, 'section' AS kind, i AS nth, md5(trim(text)) AS text_md5 FROM l WHERE trim(text) <> ''
UNION ALL SELECT doc_id, 'footnote', 1, md5(trim(source)) FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'error', NULL, NULL FROM documents WHERE doc_id % 50 = 7
""")
def package_sections(t):
    """Documents written as packages and read again: sections at empty lines, a note in every third, and some that are cut
    off behind a whole copy."""
    docs = dealt(t("documents"), 0, "doc_id").select("doc_id", F.split(F.regexp_replace("text", r"[\x00-\x08\x0B\x0C\x0E-\x1F\r]", ""), "\n\n").alias("s"), F.when(F.col("doc_id") % 3 == 0, F.array("source")).alias("notes"))
    whole = pk.packages_of(docs, F.col("doc_id").cast("string"), F.col("s"), F.col("notes"))
    cut = whole.where("path % 50 = 7").withColumn("content", F.expr("substring(content, 1, length(content) - 40)"))
    rows = pk.parse_packages(whole.unionByName(cut))
    return rows.select(F.col("path").cast("long").alias("doc_id"), "kind", F.col("index").cast("long").alias("nth"), F.when(F.col("kind") != "error", F.md5(F.trim("text"))).alias("text_md5"))


@query("""
SELECT doc_id || '_new' AS work, 3 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS n_files, md5(text) AS text_md5, '{"block_id":"b' || doc_id % 4 || '","marks":[' || doc_id || ']}' AS marks, CASE WHEN doc_id % 4 > 1 THEN 1 ELSE 0 END AS n_warnings
FROM documents WHERE doc_id % 10 <> 9
""")
def work_snapshots(t):
    """Documents as works with a text, a layout, marks and some with corrections: written as snapshots, checked, and
    restored. Every tenth has no title and is refused; marks of some name a block that the layout doesn't have."""
    docs = t("documents").select(F.col("doc_id").cast("string").alias("work"), "doc_id", "text")
    manifest = F.when(F.col("doc_id") % 10 != 9, F.format_string('{"document_id": "d%d", "title": "t"}', "doc_id")).otherwise("{}")
    layout = F.lit('{"part_id": "v", "page_number": 1, "blocks": [{"block_id": "b0"}, {"block_id": "b1"}]}')
    files = [
        ("original", "manifest.json", manifest), ("original", "L4_text/pages/v_page_001.txt", F.col("text")), ("original", "L3_layout/v_page_001.json", layout),
        ("original", "L4_text/corrections/v_page_001_corrections.json", F.when(F.col("doc_id") % 3 == 0, '{"corrections": [1]}')), ("interpretation", "L5_reading/main_text/v_page_001_punctuation.json", F.format_string('{"marks": [%d], "block_id": "b%d"}', "doc_id", F.col("doc_id") % 4)),
    ]
    rows = docs.select("work", F.inline(F.array(*(F.struct(F.lit(a).alias("area"), F.lit(p).alias("path"), c.alias("content"), F.lit(1).cast("long").alias("size")) for a, p, c in files)))).where("content is not null")
    folder = shared_folder(rows.sparkSession)
    ws.build(rows).write.parquet(folder)
    made = rows.sparkSession.read.parquet(folder)
    warned = ws.validate(made).where("level = 'warning'").groupBy(F.concat("work", F.lit("_new")).alias("work")).agg(F.count(F.lit(1)).alias("n_warnings"))
    only = lambda path: F.max(F.when(F.col("path").endswith(path), F.col("content")))
    back = ws.restore(made, "_new").groupBy("work").agg(F.count(F.lit(1)).alias("n_files"), F.md5(only(".txt")).alias("text_md5"), only("_punctuation.json").alias("marks"))
    return back.join(warned, "work", "left").select("work", "n_files", "text_md5", "marks", F.coalesce("n_warnings", F.lit(0)).alias("n_warnings"))
