"""Queries of parsers of models' and catalogues' answers, summaries, and texts put together from layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import parsing as pa
from ..operators import reports as rp
from ..operators import texts as tx
from .registry import query


@query(r"""
WITH s AS (SELECT doc_id, 'x' || regexp_replace(text, '\s', '', 'g') AS s FROM documents),
p AS (SELECT doc_id, list_transform(string_split_regex(s, '[.,;!?]+'), lambda x: length(x)) AS n, regexp_extract_all(s, '[.,;!?]+') AS m FROM s),
e AS (SELECT doc_id, unnest(m) AS mark, generate_subscripts(m, 1) AS i, n FROM p)
SELECT doc_id, count(*) AS n, sum(length(mark))::BIGINT AS chars, sum(list_sum(n[1:i]) - 1)::BIGINT AS places FROM e GROUP BY doc_id
""")
def marks_from_punctuated(t):
    marked = F.concat(F.lit("x"), "text")
    rows = t("documents").select("doc_id", F.explode(pa.marks_between(F.regexp_replace(marked, "[.,;!?]", ""), marked)).alias("m"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("m.after")).alias("chars"), F.sum("m.start").alias("places"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN l_partkey WHEN 1 THEN l_suppkey WHEN 2 THEN 0 END AS start, CASE l_linenumber % 4 WHEN 0 THEN l_partkey WHEN 1 THEN l_suppkey + 2 WHEN 2 THEN 0 END AS "end",
  CASE l_linenumber % 4 WHEN 0 THEN '.' WHEN 1 THEN l_returnflag END AS after FROM lineitem WHERE l_linenumber % 4 <> 3
""")
def normalize_marks(t):
    json = F.expr("""case l_linenumber % 4
      when 0 then concat('["x", {"after_char_index": "', l_partkey, '", "mark": "."}]')
      when 1 then concat('[{"start": ', l_suppkey, ', "end": "', l_suppkey + 2, '", "after": "', l_returnflag, '", "before": null}, {"start": "one"}]')
      when 2 then '[{"start": null}, 7, {"after_char_index": null, "mark": "!"}]' else '{"start": 1}' end""")
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(pa.normalize_marks(json)).alias("m"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.col("m.start").cast("bigint").alias("start"), F.col("m.end").cast("bigint").alias("end"), "m.after")


@query("""
SELECT p_partkey, ['사주쌍변', '사주단변', '좌우쌍변', NULL][p_partkey % 4 + 1] AS frame, CASE WHEN p_partkey % 3 <> 0 THEN p_size || '.5 × ' || p_size || ' cm' END AS frame_size, CASE p_partkey % 5 WHEN 0 THEN '유계' WHEN 1 THEN '무계' END AS rules,
  CASE WHEN p_partkey % 2 = 0 THEN '반엽 ' || p_size || '행 20자' END AS layout, CASE p_partkey % 3 WHEN 0 THEN '주쌍행' WHEN 1 THEN '주단행' END AS notes, ['대흑구', '소흑구', '백구', NULL][p_partkey % 4 + 1] AS mouth,
  ['상하내향흑어미', '상흑어미', '무어미', '상하백어미', NULL][p_partkey % 5 + 1] AS tails, CASE WHEN p_partkey % 7 = 0 THEN p_name END AS centre FROM part
""")
def printing_info(t):
    text = F.expr("""concat_ws(' ', element_at(array('四周雙邊', '四周單邊', '左右雙邊', '?'), int(p_partkey % 4) + 1), if(p_partkey % 3 <> 0, concat('半郭 ', p_size, '.5 X ', p_size, ' CM'), '半郭'), case p_partkey % 5 when 0 then '有界' when 1 then '無界' end,
      if(p_partkey % 2 = 0, concat(p_size, ' 行20字'), ''), case p_partkey % 3 when 0 then '注雙行' when 1 then '注單行' end, element_at(array('大黑口', '小黑口', '白口', ''), int(p_partkey % 4) + 1),
      element_at(array('上下內向黑魚尾', '上黑魚尾', '無魚尾', '上下白魚尾', ''), int(p_partkey % 5) + 1), if(p_partkey % 7 = 0, concat('版心題: ', p_name, '  end'), ''))""")
    return pa.printing_info(t("part").select("p_partkey", text.alias("text")), "text").select("p_partkey", "frame", "frame_size", "rules", "layout", "notes", "mouth", "tails", "centre")


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_name || ':' || CASE WHEN c_custkey % 2 = 0 THEN 'author' ELSE '-' END END AS people, CASE c_custkey % 4 WHEN 0 THEN 'kor' WHEN 1 THEN 'zh' END AS language FROM customer
""")
def contributors(t):
    fields = F.expr("if(c_custkey % 3 = 0, array(map('e', 'x')), array(if(c_custkey % 2 = 0, map('a', c_name, 'e', 'author'), map('a', c_name)), map('a', '')))")
    field = F.expr("concat(repeat('0', 35), element_at(array('kor  ', 'zh   ', '     ', 'k'), int(c_custkey % 4) + 1))")
    people = F.transform(pa.contributors(fields), lambda p: F.concat(p["name"], F.lit(":"), F.coalesce(p["role"], F.lit("-"))))
    return t("customer").select("c_custkey", F.when(people.isNotNull(), F.array_join(people, ",")).alias("people"), pa.language_of(field).alias("language"))


@query("""
SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN '978' || c_custkey END AS isbn, 'j' || c_custkey AS jpno, CASE WHEN c_custkey % 3 = 0 THEN '9' || c_nationkey END AS ndc9, c_mktsegment || ',free' AS subjects, 'book' AS material, 'https://x/' || c_custkey AS see_also,
  c_name || CASE WHEN c_custkey % 5 = 0 THEN ' (19' || c_nationkey || ')' ELSE '' END || ' [book]' AS summary FROM customer
""")
def search_items(t):
    xml = F.expr("""concat('<item><dc:title>', c_name, '</dc:title><dc:identifier xsi:type="dcndl:JPNO">j', c_custkey, '</dc:identifier>', if(c_custkey % 2 = 0, concat('<dc:identifier xsi:type="dcndl:ISBN">978', c_custkey, '</dc:identifier>'), ''),
      '<dc:subject>', c_mktsegment, '</dc:subject>', if(c_custkey % 3 = 0, concat('<dc:subject xsi:type="dcndl:NDC9">9', c_nationkey, '</dc:subject>'), ''), '<dc:subject>free</dc:subject>', if(c_custkey % 5 = 0, concat('<dcterms:issued>19', c_nationkey, '</dcterms:issued>'), ''),
      '<dcndl:materialType rdfs:label="book">x</dcndl:materialType><rdfs:seeAlso rdf:resource="https://x/', c_custkey, '"/></item>')""")
    rows = t("customer").select("c_custkey", pa.search_item(xml).alias("i"))
    return rows.select("c_custkey", "i.title", "i.isbn", "i.jpno", "i.ndc9", F.array_join("i.subjects", ",").alias("subjects"), "i.material", "i.see_also", pa.item_summary(F.col("i")).alias("summary"))


@query("""
SELECT s_suppkey, i::INT AS pos, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'n' || i END AS title, '/detail?BID=' || s_suppkey || i AS link FROM (SELECT *, unnest([0, 1]) AS i FROM supplier) WHERE s_suppkey % 2 = 1 OR i = 0
""")
def search_result_rows(t):
    html = F.expr("""if(s_suppkey % 2 = 0, concat('<a href="/detail?BID=0">menu</a><div class="resultData"><b>', s_nationkey, '</b><a class="t" href="/detail?BID=', s_suppkey, '0"><i>', s_name, '</i></a><a href="/x">y</a></div>'),
      concat('<p><a href="/detail?BID=', s_suppkey, '0">n0</a><a href="/detail?BID=', s_suppkey, '1"> n1 </a><a href="/detail?q"></a><a href="/other">z</a></p>'))""")
    return pa.search_rows(t("supplier").select("s_suppkey", html.alias("html")), "s_suppkey", "html").select("s_suppkey", "pos", "title", "link")


@query("""
WITH c AS (SELECT doc_id, list_filter(list_transform(string_split(text, ''), lambda x, i: CASE WHEN regexp_full_match(x, '[à-ÿ]') THEN {'c': x, 'i': i - 1} END), lambda p: p IS NOT NULL) AS p FROM documents)
SELECT doc_id, array_to_string(list_transform(p, lambda x: x.c), '') AS letters, md5(array_to_string(list_transform(p, lambda x: x.i), ',')) AS places FROM c
""")
def script_projection(t):
    rows = t("documents").select("doc_id", pa.project_script(F.col("text"), "[à-ÿ]").alias("p"))
    return rows.select("doc_id", F.col("p.text").alias("letters"), F.md5(F.array_join("p.places", ",")).alias("places"))


@query("SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'a=b' ELSE c_mktsegment END AS segment, 2::BIGINT AS n FROM customer")
def settings_files(t):
    lines = F.expr("""concat('# settings\\n\\nNAME = \\'', c_name, '\\'\\nno value\\nSEGMENT=old\\n SEGMENT="', if(c_custkey % 2 = 0, 'a=b', c_mktsegment), '"')""")
    rows = t("customer").select("c_custkey", pa.settings(lines).alias("m"))
    return rows.select("c_custkey", F.col("m")["NAME"].alias("name"), F.col("m")["SEGMENT"].alias("segment"), F.size("m").cast("bigint").alias("n"))


@query("""
SELECT s_suppkey, pos, label, link FROM (SELECT s_suppkey, 0 AS pos, s_name AS label, 'https://a.org/' || s_suppkey AS link FROM supplier UNION ALL SELECT s_suppkey, 1, NULL, 'http://b.org/x?y=' || s_nationkey FROM supplier)
""")
def markdown_link_extract(t):
    md = F.expr("concat('See [', s_name, '](https://a.org/', s_suppkey, '#p1), http://b.org/x?y=', s_nationkey, ' and https://a.org/', s_suppkey, '#p2 or [mail](mailto:x)')")
    return pa.markdown_links(t("supplier").select("s_suppkey", md.alias("md")), "s_suppkey", "md").select("s_suppkey", "pos", "label", "link")


@query("""
SELECT page_id, 0 AS pos, 'the book' AS label, 'https://lib.org/a/' || page_id || '/vol/b.pdf' AS link FROM pages UNION ALL SELECT page_id, 1, 'scan', 'https://lib.org/img/p' || page_id % 7 || '.jpg' FROM pages
UNION ALL SELECT page_id, 2, NULL, 'https://other.org/x.png' FROM pages UNION ALL SELECT page_id, 4, NULL, regexp_replace(url, '#.*$', '') FROM pages
""")
def markdown_relative_links(t):
    """Links with titles, images, relative and repeated ones, resolved against the page they are on."""
    md = F.expr("""concat('[the book](vol/b.pdf "a title") and ![scan](/img/p', page_id % 7, '.jpg) [](//other.org/x.png "t") [again](./vol/b.pdf#p2) [m](mailto:a@b) ', url, ' (', 'https://lib.org/in/brackets', ')')""")
    rows = t("pages").select("page_id", md.alias("md"), F.concat(F.lit("https://lib.org/a/"), "page_id", F.lit("/index.html")).alias("base"))
    return pa.markdown_links(rows, "page_id", "md", "base").select("page_id", "pos", "label", "link")


@query("""
WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line FROM documents),
c AS (SELECT lang, line, len(regexp_extract_all(line, '[à-ÿ]')) > len(regexp_extract_all(line, '[th]')) AS orig FROM l)
SELECT lang, count(*) AS total_lines, count(*) FILTER (orig AND trim(line) <> '') AS original_lines, count(*) FILTER (NOT orig AND trim(line) <> '') AS translation_lines, count(*) FILTER (trim(line) = '') AS skipped_lines FROM c GROUP BY lang
""")
def separation_stats(t):
    a, b = tx.script_counts(F.col("line"), "[à-ÿ]", "[th]")
    lines = tx.lines_of(t("documents").select("doc_id", "lang", "text"), "lang").withColumn("class", F.when(a > b, "original").otherwise("translation"))
    return rp.separation_stats(lines, "lang")


@query("""
SELECT l_orderkey, round(coalesce(sum(CASE WHEN l_linenumber % 2 = 0 THEN l_discount + l_tax ELSE 0 END) / nullif(sum(CASE WHEN l_linenumber % 2 = 0 THEN 2 ELSE 0 END), 0), 0), 6) AS avg_confidence, sum(length(l_partkey::VARCHAR))::BIGINT AS char_count, string_agg(l_partkey::VARCHAR, chr(10) ORDER BY l_linenumber, l_partkey::VARCHAR) AS full_text FROM lineitem GROUP BY l_orderkey
""")
def block_texts(t):
    lines = t("lineitem").selectExpr("l_orderkey", "l_linenumber as line_no", "cast(l_partkey as string) as text", "if(l_linenumber % 2 = 0, array(double(l_discount), double(l_tax)), cast(array() as array<double>)) as conf")
    return rp.block_texts(lines, "l_orderkey").withColumn("avg_confidence", F.round("avg_confidence", 6))


@query("""
SELECT l_orderkey, count(*) AS total_blocks, count(*) FILTER (l_linenumber % 3 <> 0 AND l_returnflag <> 'R') AS processed_blocks, count(*) FILTER (l_linenumber % 3 = 0) AS skipped_blocks, CASE WHEN bool_or(l_returnflag = 'R') THEN 'partial' ELSE 'completed' END AS status FROM lineitem GROUP BY l_orderkey
""")
def page_summary(t):
    return rp.page_summary(t("lineitem").selectExpr("l_orderkey", "l_linenumber % 3 = 0 as skip", "if(l_returnflag = 'R', 'failed', null) as error"), "l_orderkey")


@query("SELECT 'l_returnflag' AS kind, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY ALL UNION ALL SELECT 'l_linestatus', l_linestatus, count(*) FROM lineitem GROUP BY ALL")
def class_histogram(t):
    return rp.class_histogram(t("lineitem"), ("l_returnflag", "l_linestatus"))


@query("SELECT (c // 2)::BIGINT AS bin, count(*) AS n FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def boxes_per_page(t):
    return rp.boxes_per_page(t("lineitem"), "l_orderkey", 2)


@query("SELECT l_suppkey, round(avg(l_quantity / 64) * 100)::INT AS percent FROM lineitem GROUP BY l_suppkey")
def confidence_percent(t):
    return rp.confidence_percent(t("lineitem").selectExpr("l_suppkey", "l_quantity / 64 as conf"), "l_suppkey", "conf")


@query("""
WITH m AS (SELECT DISTINCT l_orderkey AS page, l_suppkey AS block_id, l_partkey * 10 + l_linenumber AS seq, l_linenumber AS s, l_linenumber + 1 AS e, CASE WHEN l_linestatus = 'F' THEN '(' END AS b, CASE WHEN l_returnflag = 'A' THEN '' ELSE l_returnflag END AS a FROM lineitem),
l AS (SELECT *, '  [' || s || '-' || e || '] ' || CASE WHEN b IS NULL AND a = '' THEN '(empty)' ELSE concat_ws(' ', 'before:' || b, CASE WHEN a <> '' THEN 'after:' || a END) END AS line FROM m),
k AS (SELECT page, block_id, '[block ' || block_id || ']' || chr(10) || string_agg(line, chr(10) ORDER BY seq, line) AS t FROM l GROUP BY page, block_id)
SELECT page, string_agg(t, chr(10) || chr(10) ORDER BY block_id) AS summary FROM k GROUP BY page
""")
def marks_summary(t):
    marks = t("lineitem").selectExpr("l_orderkey as page", "l_suppkey as block_id", "l_partkey * 10 + l_linenumber as seq", "l_linenumber as start", "l_linenumber + 1 as end", "if(l_linestatus = 'F', '(', null) as before", "if(l_returnflag = 'A', '', l_returnflag) as after").distinct()
    return rp.marks_summary(marks, "page")


@query("""
SELECT l_orderkey * 100000 + l_partkey AS id, l_orderkey AS image_id, l_returnflag AS category, 5 + l_linenumber AS w, (5 + l_linenumber) * 20 AS area, CASE WHEN ('0x' || left(md5(l_orderkey::VARCHAR), 8))::BIGINT % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM lineitem
""")
def coco_export(t):
    objects = t("lineitem").selectExpr("l_orderkey * 100000 + l_partkey as id", "l_orderkey as page", "l_returnflag as cls", "l_suppkey as x1", "l_partkey as y1", "l_suppkey + 5 + l_linenumber as x2", "l_partkey + 20 as y2")
    return rp.coco(objects, "page").select("id", "image_id", "category", F.element_at("bbox", 3).alias("w"), "area", "split")


@query("""
WITH p AS (SELECT o_orderkey, 'head' || o_orderkey AS h, o_orderkey % 3 AS k FROM orders),
c AS (SELECT l_orderkey AS o, count(*) FILTER (l_linenumber = 1) > 0 AS one FROM lineitem GROUP BY 1)
SELECT o_orderkey, pos::INT AS pos, CASE WHEN k = 0 THEN (CASE pos WHEN 0 THEN 'b1' ELSE 'b2' END) ELSE ['b1', 'b2', 'extra_b03'][pos + 1] END AS block_id,
  CASE WHEN k = 0 THEN (CASE pos WHEN 0 THEN h || chr(10) || 'second abc' ELSE '' END) ELSE [h, 'second abc', 'note'][pos + 1] END AS original_text,
  CASE WHEN k = 0 THEN (CASE pos WHEN 0 THEN CASE WHEN coalesce(one, false) THEN 'H' ELSE 'h' END || substr(h, 2) || chr(10) || 'SECOND abc' ELSE '' END) ELSE [CASE WHEN coalesce(one, false) THEN 'H' ELSE 'h' END || substr(h, 2), 'second ABC', 'note'][pos + 1] END AS corrected_text,
  CASE WHEN pos = 0 AND k = 0 THEN 1 WHEN pos = 0 THEN coalesce(one, false)::INT WHEN pos = 1 AND k <> 0 THEN 1 ELSE 0 END::BIGINT AS n_applied
FROM p LEFT JOIN c ON o = o_orderkey, (SELECT unnest([0, 1, 2]) AS pos) WHERE (k = 0 AND pos < 2) OR k <> 0
""")
def corrected_blocks(t):
    """Pages with and without markers; corrections of the page (with and without a line) and of a block."""
    k = F.expr("if(o_orderkey % 3 = 0, concat('head', o_orderkey, '\\nsecond abc'), concat('head', o_orderkey, ' [本文] second abc [注釈]note '))")
    texts = t("orders").select("o_orderkey", k.alias("text"))
    blocks = texts.select("o_orderkey", F.inline(F.expr("array(named_struct('pos', 0, 'block_id', 'b1', 'block_type', 'main_text'), named_struct('pos', 1, 'block_id', 'b2', 'block_type', 'main_text'))")))
    first = t("lineitem").where("l_linenumber = 1").select("l_orderkey").distinct().selectExpr("l_orderkey as o_orderkey", "cast(null as string) as block_id", "cast(null as int) as line", "0 as char_index", "'h' as original", "'H' as corrected")
    line = texts.where("o_orderkey % 3 = 0").selectExpr("o_orderkey", "cast(null as string) as block_id", "1 as line", "0 as char_index", "'second' as original", "'SECOND' as corrected")
    inner = texts.where("o_orderkey % 3 <> 0").selectExpr("o_orderkey", "'b2' as block_id", "0 as line", "7 as char_index", "'abc' as original", "'ABC' as corrected")
    out = rp.corrected_blocks(texts, blocks, first.unionByName(line).unionByName(inner), "o_orderkey")
    return out.select("o_orderkey", "pos", "block_id", "original_text", "corrected_text", F.col("n_applied").cast("bigint").alias("n_applied"))


@query("""
WITH b AS (SELECT conv_id, turn, replace(replace(text, chr(10), ''), chr(13), '') AS x FROM conversations)
SELECT conv_id, turn::VARCHAR AS block, length(x) AS total, 1.0::DOUBLE AS accuracy FROM b WHERE x <> '' UNION ALL SELECT conv_id, '*', sum(length(x))::BIGINT, 1.0::DOUBLE FROM b GROUP BY conv_id HAVING sum(length(x)) > 0
""")
def page_alignment(t):
    """Turns as blocks of a page, their lines recognised without a fault."""
    c = t("conversations").select("conv_id", F.col("turn").alias("block"), F.col("turn").alias("pos"), "text")
    lines = c.select("conv_id", "block", "pos", F.posexplode(F.split("text", "[\n\r]")).alias("line_no", "line")).withColumnRenamed("line", "text")
    refs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n").alias("text"))
    variants = t("nation").selectExpr("'é' as a", "'e' as b").distinct()
    return rp.page_alignment(lines, refs, variants, "conv_id", "block").select("conv_id", "block", "total", "accuracy")


CHUNKS = """SELECT conv_id, turn, k, substring(x, 90 * k + 1, 90) AS block, right(substring(x, 1, 90 * k), 40) || regexp_replace(substring(x, 90 * k + 1, 90), '(.{5}).(.{4})', '\\1~\\2', 'g') || substring(x, 90 * k + 91, 40) AS ref
  FROM (SELECT *, unnest(range(0, (length(x) + 89) // 90)) AS k FROM (SELECT conv_id, turn, regexp_replace(text, '\\s', '', 'g') AS x FROM conversations))"""


def matched(name: str, windows: str) -> str:
    """A recursive table of the stretches that SequenceMatcher meets in a and b of windows (id, low, a, b): id, low, i, j, n
    where met. Of a pair of ranges that is the longest stretch, of those the first in a, and of those the first in b; then
    the ranges before it and behind it. starts are where stretches of n letters begin in a that b has too."""
    return f"""{name}(id, low, met, i, j, n, a, b, starts) AS (
  SELECT id, low, false, 0::BIGINT, 0::BIGINT, 0::BIGINT, a, b, range(1, length(a) + 1) FROM {windows}
  UNION ALL
  SELECT id, low, part = 1, CASE part WHEN 0 THEN i WHEN 1 THEN i + p - 1 WHEN 2 THEN i ELSE i + p - 1 + n END, CASE part WHEN 0 THEN j WHEN 1 THEN j + q - 1 WHEN 2 THEN j ELSE j + q - 1 + n END, CASE part WHEN 0 THEN n + 1 WHEN 1 THEN n ELSE 0 END,
    CASE part WHEN 0 THEN a WHEN 1 THEN '' WHEN 2 THEN left(a, p - 1) ELSE substr(a, p + n) END, CASE part WHEN 0 THEN b WHEN 1 THEN '' WHEN 2 THEN left(b, q - 1) ELSE substr(b, q + n) END,
    CASE part WHEN 0 THEN longer WHEN 2 THEN range(1, p) WHEN 3 THEN range(1, length(a) - p - n + 2) END
  FROM (SELECT *, starts[1] AS p, instr(b, substr(a, starts[1], n)) AS q, unnest(CASE WHEN len(longer) > 0 THEN [0] WHEN n > 0 THEN [1, 2, 3] ELSE [] END) AS part
    FROM (SELECT *, list_filter(starts, lambda x: x + n <= length(a) AND contains(b, substr(a, x, n + 1))) AS longer FROM {name} WHERE NOT met AND a <> '' AND b <> '')))"""


@query(f"""
WITH RECURSIVE t AS MATERIALIZED (SELECT row_number() OVER (ORDER BY conv_id, turn, k) AS id, conv_id, turn, k, nfc_normalize(block) AS a, nfc_normalize(ref) AS r, length(a) AS size, length(r) - length(a) AS last FROM ({CHUNKS}) WHERE length(block) >= 30),
e AS MATERIALIZED (SELECT DISTINCT id, size, last, probe, unnest(list_filter(range(0, length(r) - 4), lambda x: substr(r, x + 1, 5) = substr(a, probe + 1, 5))) AS i FROM (SELECT *, unnest([0, size // 2, size - 5]) AS probe FROM t WHERE last > 0)),
v AS MATERIALIZED (SELECT DISTINCT id, least(greatest(i - probe, 0), last) AS low, true AS voted FROM e),
c AS (SELECT id, unnest(range(greatest(i - size + 5, 0), least(i, last) + 1)) AS low FROM e UNION SELECT id, low FROM v),
g AS MATERIALIZED (SELECT id, a, r, size, list_transform(list_distinct(string_split(a, '')), lambda x: {{'c': x, 'n': size - length(replace(a, x, ''))}}) AS own FROM t WHERE last > 0),
w AS MATERIALIZED (SELECT id, low, size, a, b, coalesce(voted, false) AS voted, list_sum(list_transform(own, lambda x: least(x.n, size - length(replace(b, x.c, '')))))::BIGINT AS most FROM (SELECT *, substr(r, low + 1, size) AS b FROM c JOIN g USING (id)) LEFT JOIN v USING (id, low)),
w1 AS MATERIALIZED (SELECT * FROM w WHERE voted QUALIFY row_number() OVER (PARTITION BY id ORDER BY most DESC, low) = 1),
{matched("m1", "w1")},
n1 AS MATERIALIZED (SELECT id, low, coalesce(sum(n) FILTER (met), 0)::BIGINT AS n FROM m1 GROUP BY id, low),
w2 AS MATERIALIZED (SELECT w.* FROM w JOIN n1 USING (id) WHERE w.low <> n1.low AND (most > n OR most = n AND voted AND w.low < n1.low)),
{matched("m2", "w2")},
n2 AS (SELECT id, low, coalesce(sum(n) FILTER (met), 0)::BIGINT AS n FROM m2 GROUP BY id, low),
best AS MATERIALIZED (SELECT id, low, size, n FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2) JOIN w USING (id, low) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, voted DESC, low) = 1),
w3 AS MATERIALIZED (SELECT id, greatest(low - 2, 0) AS low, best.low AS inner_low, t.size, n, a, substr(r, greatest(low - 2, 0) + 1, least(low + t.size + 2, length(r)) - greatest(low - 2, 0)) AS b FROM best JOIN t USING (id) WHERE 10 * n >= 3 * t.size),
{matched("m3", "w3")},
n3 AS (SELECT id, coalesce(sum(n) FILTER (met), 0)::BIGINT AS n FROM m3 GROUP BY id),
wider AS MATERIALIZED (SELECT id, w3.b FROM w3 JOIN n3 USING (id) WHERE 2 * n3.n * size > w3.n * (size + length(b))),
w4 AS MATERIALIZED (SELECT id, 0 AS low, a, r AS b FROM t WHERE last <= 0 OR id IN (SELECT id FROM best WHERE 10 * n < 3 * size)),
{matched("m4", "w4")},
x AS (SELECT id, i, j, n FROM m3 SEMI JOIN wider USING (id) WHERE met UNION ALL SELECT id, i, j, n FROM m4 WHERE met
  UNION ALL SELECT id, i, j, m.n FROM (SELECT * FROM m1 UNION ALL SELECT * FROM m2) m JOIN best USING (id, low) ANTI JOIN wider USING (id) ANTI JOIN w4 USING (id) WHERE met),
y AS (SELECT id, a, b FROM w JOIN best USING (id, low) ANTI JOIN wider USING (id) ANTI JOIN w4 USING (id) UNION ALL SELECT id, a, wider.b FROM wider JOIN t USING (id) UNION ALL SELECT id, a, b FROM w4),
z AS (SELECT id, a, b, n, coalesce(lag(i + n) OVER p, 0) AS i0, coalesce(lag(j + n) OVER p, 0) AS j0, i - i0 AS di, j - j0 AS dj FROM (SELECT * FROM x UNION ALL SELECT id, length(a), length(b), 0 FROM y) JOIN y USING (id) WINDOW p AS (PARTITION BY id ORDER BY i, j, n DESC)),
s AS (SELECT id, sum(n + greatest(di, dj))::BIGINT AS total, sum(n)::BIGINT AS exact, sum(least(di, dj))::BIGINT AS wrong,
  sum(len(list_filter(range(1, least(di, dj) + 1), lambda x: substr(a, i0 + x, 1) || substr(b, j0 + x, 1) IN ('ée', 'eé'))))::BIGINT AS variants FROM z GROUP BY id)
SELECT conv_id, turn, k, total, wrong - variants AS n_mismatch, round((exact + variants) / total, 4) AS accuracy FROM s JOIN t USING (id)
""")
def page_alignment_altered(t):
    """Turns in blocks of 90 letters, each found again in a page that has its text with every tenth letter wrong, between
    40 letters of what comes before and behind it. Last blocks of fewer than 30 letters are left out. What a text that
    repeats itself is met with is not its own letters alone, so SQL finds the window and the stretches as the operator
    does: w are the windows around the places of the probes (the first is in every page), of which those are tried (w1,
    w2) whose letters in common would do for more than the most of the first; w3 is the best one with the margin, w4 the
    whole page. A probe of three letters is never needed."""
    x = t("conversations").select("conv_id", "turn", F.regexp_replace("text", r"\s", "").alias("x"))
    rows = x.select("*", F.explode(F.expr("filter(sequence(0, (length(x) + 89) div 90), k -> 90 * k < length(x))")).alias("k"))
    piece = F.expr("substring(x, int(90 * k + 1), 90)")
    before = F.expr("right(substring(x, 1, int(90 * k)), 40)")
    ref = F.concat(before, F.regexp_replace(piece, "(.{5}).(.{4})", "$1~$2"), F.expr("substring(x, int(90 * k + 91), 40)"))
    rows = rows.select(F.struct("conv_id", "turn", "k").alias("page"), piece.alias("text"), ref.alias("ref")).where("length(text) >= 30")
    lines = rows.select("page", F.lit(1).alias("block"), F.lit(1).alias("pos"), F.lit(1).alias("line_no"), "text")
    variants = t("nation").selectExpr("'é' as a", "'e' as b").distinct()
    out = rp.page_alignment(lines, rows.select("page", F.col("ref").alias("text")), variants, "page", "block").where("block = '1'")
    return out.select("page.conv_id", "page.turn", F.col("page.k").cast("long").alias("k"), "total", "n_mismatch", "accuracy")


@query("""
SELECT o_orderkey, 'text' AS kind, o_orderstatus AS content FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'marks', '[' || o_custkey || ']' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, 'translation', 't' FROM orders WHERE o_orderkey % 5 = 0
""")
def import_sidecars(t):
    pages = t("orders").selectExpr("o_orderkey", "if(o_orderkey % 2 = 0, o_orderstatus, '') as text", "if(o_orderkey % 3 = 0, array(o_custkey), cast(array() as array<bigint>)) as marks", "cast(null as array<int>) as formatting", "if(o_orderkey % 5 = 0, 't', ' ') as translation")
    return rp.sidecars(pages, "o_orderkey")


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_custkey::VARCHAR END AS title, CASE WHEN c_custkey % 3 = 0 THEN 40 ELSE c_custkey % 4 END AS n FROM customer")
def dictionary_list(t):
    json = F.expr("to_json(named_struct('title', if(c_custkey % 2 = 0, c_name, null), 'statistics', if(c_custkey % 3 = 0, named_struct('total_entries', 40), null), 'entries', transform(if(c_custkey % 4 = 0, array(), sequence(1, int(c_custkey % 4))), i -> named_struct('headword', string(i)))))")
    return rp.dictionary_list(t("customer").select("c_custkey", json.alias("json")), "c_custkey", "json")


@query("SELECT DISTINCT least(a, b) || ',' || greatest(a, b) AS line FROM (SELECT 'p' || l_partkey AS a, 's' || l_suppkey AS b FROM lineitem UNION SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem)")
def variant_csv(t):
    one = t("lineitem").selectExpr("concat('p', l_partkey) as a", "concat('s', l_suppkey) as b")
    return rp.variant_lines(one.unionByName(one.selectExpr("b as a", "a as b")))


@query("""
SELECT 'main_page_' || o_orderkey AS path, i::INT AS pos, CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE o_custkey END::INT AS page_number, 'm' || i AS id, o_orderstatus AS status FROM (SELECT *, unnest(range(0, o_orderkey % 3)) AS i FROM orders) WHERE o_orderkey % 5 <> 0
""")
def citation_scan(t):
    json = F.expr("if(o_orderkey % 5 = 0, '{broken', to_json(named_struct('page_number', if(o_orderkey % 4 = 0, null, o_custkey), 'marks', transform(if(o_orderkey % 3 = 0, array(), sequence(1, int(o_orderkey % 3))), i -> named_struct('id', concat('m', i - 1), 'status', o_orderstatus)))))")
    files = t("orders").select(F.concat(F.lit("main_page_"), "o_orderkey").alias("path"), json.alias("json"))
    return rp.citation_scan(files, "path", "json").select("path", "pos", "page_number", "id", "status")


@query("SELECT conv_id, bool_or(length(trim(text)) > 60 AND turn <= 2) AS has_text FROM conversations GROUP BY conv_id")
def text_layer(t):
    return rp.has_text_layer(t("conversations").select("conv_id", F.col("turn").alias("page_num"), "text"), "conv_id", 2, 60)


@query("""
WITH v AS (SELECT user_id AS page, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS block, event_id AS version, props FROM events),
n AS (SELECT page, block, max(version) AS version, max_by(props, version) AS content FROM v WHERE version <= (SELECT max(event_id) // 2 FROM events) GROUP BY ALL)
SELECT page, block, version, content FROM n a WHERE block IS NOT NULL OR NOT EXISTS (SELECT 1 FROM n b WHERE b.page = a.page AND b.block IS NOT NULL)
""")
def layers_as_of(t):
    e = t("events")
    half = e.agg(F.expr("max(event_id) div 2").alias("cut"))
    rows = e.selectExpr("concat_ws('/', user_id, if(event_type = 'view', null, event_type)) as path", "event_id as version", "props as content").crossJoin(F.broadcast(half))
    page, block = F.split_part("path", F.lit("/"), F.lit(1)).cast("bigint"), F.nullif(F.split_part("path", F.lit("/"), F.lit(2)), F.lit(""))
    return rp.layers_as_of(rows, "path", block, page, F.col("cut")).select("page", "block", "version", "content")
