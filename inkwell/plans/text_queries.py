"""Queries of the text, alignment and dictionary operators. A document's lines are its page lines; the driver's texts
are in Latin script, so character classes are given as parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tasks import dealt
from ..operators import alignment as al
from ..operators import dictionary as di
from ..operators import texts as tx
from .registry import query

ACCENT, PLAIN = "[à-ÿ]", "[th]"


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
c AS (SELECT *, len(regexp_extract_all(line, '[à-ÿ]')) AS a, len(regexp_extract_all(line, '[th]')) AS b FROM l),
o AS (SELECT doc_id, line_no, length(line) AS n, CASE WHEN a + b = 0 THEN NULL WHEN a >= 0.8 * (a + b) THEN 'original' ELSE 'translation' END AS own FROM c)
SELECT doc_id, line_no, n, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'original') AS class FROM o
""")
def script_carry_forward(t):
    rows = tx.classify_lines(tx.lines_of(t("documents"), "doc_id"), "doc_id", ACCENT, PLAIN)
    return rows.select("doc_id", "line_no", F.char_length("line").alias("n"), "class")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents),
c AS (SELECT *, len(regexp_extract_all(line, '[à-ÿ]')) AS a, len(regexp_extract_all(line, '[th]')) AS b FROM l),
o AS (SELECT doc_id, line_no, line, CASE WHEN a + b = 0 THEN NULL WHEN a >= 0.8 * (a + b) THEN 'original' ELSE 'translation' END AS own FROM c),
k AS (SELECT *, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'original') AS class FROM o)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (class = 'original' AND trim(line) <> ''), '') AS original_text, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (class = 'translation' AND trim(line) <> ''), '') AS translation_text FROM k GROUP BY doc_id
""")
def separate_by_script(t):
    return tx.split_by_class(tx.classify_lines(tx.lines_of(t("documents"), "doc_id"), "doc_id", ACCENT, PLAIN), "doc_id")


@query("SELECT doc_id, translate(text, '.,;:?!', '。，；：？！') AS text FROM documents")
def normalize_punctuation(t):
    return t("documents").select("doc_id", tx.normalize_punctuation(F.col("text")).alias("text"))


@query("""
WITH d AS (SELECT doc_id, regexp_replace(text, '\\. ', '.' || chr(10) || '  ', 'g') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM d),
p AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS raw_pos FROM l)
SELECT doc_id, line_no, length(regexp_extract(line, '^( {1,3})[A-Z]', 1)) AS raise_count, raw_pos FROM p WHERE length(regexp_extract(line, '^( {1,3})[A-Z]', 1)) > 0
""")
def leading_spaces(t):
    d = t("documents").select("doc_id", F.regexp_replace("text", r"\. ", ".\n  ").alias("text"))
    return tx.leading_spaces(d, "doc_id", "[A-Z]")


CORRECTIONS = "SELECT DISTINCT l_orderkey AS doc_id, 5 * l_linenumber AS i, CASE WHEN l_partkey % 2 = 0 THEN 'e' ELSE 't' END AS original, '#' || l_linenumber AS corrected FROM lineitem"


@query(f"""
WITH c AS ({CORRECTIONS}), v AS (SELECT c.*, text FROM c JOIN documents USING (doc_id) WHERE substring(text, i + 1, 1) = original),
o AS (SELECT *, coalesce(lag(i) OVER w + 1, 0) AS prev, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, string_agg(substring(text, prev + 1, i - prev) || corrected || CASE WHEN k = n THEN substring(text, i + 2) ELSE '' END, '' ORDER BY k) AS done, count(*) AS n FROM o GROUP BY doc_id)
SELECT doc_id, md5(coalesce(done, text)) AS corrected_md5, coalesce(n, 0) AS n_applied FROM documents LEFT JOIN r USING (doc_id)
""")
def apply_corrections(t):
    c = t("lineitem").selectExpr("l_orderkey as doc_id", "cast(5 * l_linenumber as int) as char_index", "if(l_partkey % 2 = 0, 'e', 't') as original", "concat('#', l_linenumber) as corrected")
    return tx.apply_corrections(t("documents").select("doc_id", "text"), c, "doc_id").select("doc_id", F.md5("corrected").alias("corrected_md5"), "n_applied")


@query("""
WITH g AS (SELECT doc_id, text, string_split(text, 'q') AS p FROM documents),
o AS (SELECT doc_id, text, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda s: length(s)))::BIGINT + i - 1)) AS i FROM g WHERE len(p) > 1)
SELECT doc_id, i AS char_index, substring(text, greatest(i - 5, 0) + 1, i + 6 - greatest(i - 5, 0)) AS context FROM o
WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = doc_id AND 5 * l_linenumber = i)
""")
def char_search(t):
    done = t("lineitem").selectExpr("l_orderkey as doc_id", "cast(5 * l_linenumber as int) as char_index")
    return tx.search_char(t("documents").select("doc_id", "text"), "q", "doc_id", done)


@query("""
WITH s AS (SELECT page_id, regexp_extract_all(html, '<(?:p|h1|nav)>') AS h, string_split_regex(html, '<(?:p|h1|nav)>') AS p, html FROM pages)
SELECT page_id, 0 AS ordinal, NULL::VARCHAR AS marker, trim(html) AS segment FROM s WHERE len(h) = 0
UNION ALL SELECT page_id, i - 1, h[i], trim(p[i + 1]) FROM (SELECT page_id, h, p, unnest(range(1, len(h) + 1)) AS i FROM s)
""")
def split_by_markers(t):
    return tx.split_by_markers(t("pages").select("page_id", "html"), "<(?:p|h1|nav)>", "page_id", "html")


@query("""
WITH e AS (SELECT l_orderkey AS doc_id, CASE WHEN l_linenumber % 2 = 0 THEN 'insert' ELSE 'delete' END AS type, 9 * l_linenumber AS pos FROM lineitem),
s AS (SELECT o_orderkey AS doc_id, 20 AS start, 45 AS "end" FROM orders)
SELECT doc_id, start + coalesce((SELECT sum(CASE WHEN type = 'insert' AND pos <= start THEN 1 WHEN type = 'delete' AND pos < start THEN -1 ELSE 0 END) FROM e WHERE e.doc_id = s.doc_id), 0)::BIGINT AS start,
       "end" + coalesce((SELECT sum(CASE WHEN type = 'insert' AND pos <= "end" THEN 1 WHEN type = 'delete' AND pos < "end" THEN -1 ELSE 0 END) FROM e WHERE e.doc_id = s.doc_id), 0)::BIGINT AS "end" FROM s
""")
def reclean_after_edits(t):
    edits = t("lineitem").selectExpr("l_orderkey as doc_id", "if(l_linenumber % 2 = 0, 'insert', 'delete') as type", "cast(9 * l_linenumber as int) as pos")
    return tx.reclean_shift(edits, t("orders").selectExpr("o_orderkey as doc_id", "20 as start", "45 as end"), "doc_id")


@query("""
SELECT doc_id, text AS headword, i - 1 AS start, i + length(text) - 2 AS "end" FROM (
  SELECT d.doc_id, b.text, unnest(list_filter(range(1, length(d.text) + 1), lambda i: substring(d.text, i, length(b.text)) = b.text)) AS i
  FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b ON contains(d.text, b.text))
""")
def dict_substring_join(t):
    return di.substring_join(t("documents").select("doc_id", "text"), t("benchmark").select(F.col("text").alias("headword")), "doc_id")


@query("""
WITH w AS (SELECT DISTINCT unnest([left(text, 1), left(text, 2), 'ñ', 'qu']) AS headword FROM benchmark WHERE left(text, 1) <> substring(text, 2, 1))
SELECT doc_id, headword, (length(text) - length(replace(text, headword, ''))) // length(headword) AS n FROM documents JOIN w ON contains(text, headword)
""")
def dict_short_headwords(t):
    """Headwords of one and two characters, as in scripts without spaces."""
    b = t("benchmark").where("left(text, 1) <> substring(text, 2, 1)")
    words = b.select(F.explode(F.array(F.substring("text", 1, 1), F.substring("text", 1, 2), F.lit("ñ"), F.lit("qu"))).alias("headword")).distinct()
    return di.substring_join(t("documents").select("doc_id", "text"), words, "doc_id").groupBy("doc_id", "headword").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH m AS (SELECT b.text AS headword, d.doc_id AS block, instr(d.text, b.text) - 1 AS start FROM documents d JOIN (SELECT DISTINCT text FROM benchmark) b ON contains(d.text, b.text))
SELECT headword, count(*) AS n, string_agg(block || ':' || start, ',' ORDER BY block, start) AS positions FROM m GROUP BY headword
""")
def dict_match_merged(t):
    m = di.substring_join(t("documents").select("doc_id", "text"), t("benchmark").select(F.col("text").alias("headword")), "doc_id").groupBy("doc_id", "headword").agg(F.min("start").alias("start"))
    return di.merge_matches(m.withColumnRenamed("doc_id", "block")).select("headword", "n", F.array_join("positions", ",").alias("positions"))


@query("""
WITH e AS (SELECT props AS headword, event_id AS pos, event_type || event_id % 5 AS meaning, user_id AS place FROM events)
SELECT headword, min_by(meaning, pos) AS meaning, string_agg(place::VARCHAR, ',' ORDER BY pos) AS places FROM e GROUP BY headword
""")
def dict_export_dedup(t):
    e = t("events").selectExpr("props as headword", "event_id as pos", "concat(event_type, event_id % 5) as meaning", "array(event_type) as related", "user_id as place")
    return di.dedup_entries(e).select("headword", "meaning", F.array_join(F.transform("places", lambda p: p.cast("string")), ",").alias("places"))


@query("""
WITH o AS (SELECT c_name AS headword, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_mktsegment END AS meaning FROM customer WHERE c_nationkey < 12),
n AS (SELECT c_name AS headword, 'in ' || c_mktsegment AS meaning, c_custkey AS pos FROM customer WHERE c_nationkey > 6)
SELECT o.headword, coalesce(nullif(o.meaning, ''), n.meaning, o.meaning) AS meaning, CASE WHEN n.headword IS NULL THEN 'kept' ELSE 'merged' END AS action FROM o LEFT JOIN n USING (headword)
UNION ALL SELECT headword, meaning, 'added' FROM n WHERE headword NOT IN (SELECT headword FROM o)
""")
def dict_import_merge(t):
    c = t("customer")
    old = c.where("c_nationkey < 12").selectExpr("c_name as headword", "if(c_custkey % 3 = 0, '', c_mktsegment) as meaning")
    return di.import_entries(old, c.where("c_nationkey > 6").selectExpr("c_name as headword", "concat('in ', c_mktsegment) as meaning", "c_custkey as pos"), "merge")


@query("""
WITH o AS (SELECT c_name AS headword, c_mktsegment AS meaning FROM customer WHERE c_nationkey < 12), n AS (SELECT c_name AS headword, 'in ' || c_mktsegment AS meaning FROM customer WHERE c_nationkey > 6)
SELECT headword, meaning, 'kept' AS action FROM o UNION ALL SELECT headword, meaning, 'added' FROM n WHERE headword NOT IN (SELECT headword FROM o)
""")
def dict_import_skip_existing(t):
    c = t("customer")
    return di.import_entries(c.where("c_nationkey < 12").selectExpr("c_name as headword", "c_mktsegment as meaning"), c.where("c_nationkey > 6").selectExpr("c_name as headword", "concat('in ', c_mktsegment) as meaning", "c_custkey as pos"), "skip_existing")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context FROM conversations GROUP BY conv_id")
def context_text(t):
    return di.context_text(t("conversations").selectExpr("conv_id", "turn as pos", "role as headword", "text as meaning"), "conv_id")


@query("""
WITH g AS (SELECT item_id, unnest(range(0, length(text) - 4)) AS p, text FROM benchmark WHERE length(text) >= 5)
SELECT item_id, substring(text, p + 1, 5) AS gram, string_agg(p::VARCHAR, ',' ORDER BY p) AS positions FROM g GROUP BY ALL
""")
def ngram_index(t):
    return di.ngram_index(t("benchmark"), "item_id").select("item_id", "gram", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query("""
WITH i AS (SELECT item_id, substring(text, p + 1, 5) AS gram, p AS place FROM (SELECT item_id, text, unnest(range(0, length(text) - 4)) AS p FROM benchmark)),
a AS (SELECT item_id, substring(text, 11, 6) || 'x' || substring(text, 18, 8) AS anchor FROM benchmark),
g AS (SELECT item_id, length(anchor) AS len, substring(anchor, o + 1, 5) AS gram, o FROM (SELECT item_id, anchor, unnest(range(0, length(anchor) - 4)) AS o FROM a WHERE length(anchor) >= 5)),
v AS (SELECT item_id, place - o AS est_start, count(*) AS votes, max(len) AS len FROM g JOIN i USING (item_id, gram) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY votes DESC, est_start) AS r, max(votes) OVER (PARTITION BY item_id) AS top FROM v)
SELECT item_id, est_start, votes FROM b WHERE votes >= greatest(1, len // 2) OR (top < greatest(1, len // 2) AND r = 1)
""")
def anchor_votes(t):
    b = t("benchmark").select("item_id", "text")
    anchors = b.selectExpr("item_id", "concat(substring(text, 11, 6), 'x', substring(text, 18, 8)) as anchor")
    return di.anchor_votes(b, anchors, "item_id")


@query("""
SELECT doc_id, CASE WHEN length(text) >= 45 THEN substring(text, 1, 15) || '|' || substring(text, (length(text) - 15) // 2 + 1, 15) || '|' || substring(text, length(text) - 14, 15)
  WHEN length(text) >= 30 THEN substring(text, 1, 15) || '|' || substring(text, length(text) - 14, 15) ELSE substring(text, 1, 15) END AS anchors FROM documents
""")
def multi_anchors(t):
    return t("documents").select("doc_id", F.array_join(al.anchors_of(F.col("text"), 15), "|").alias("anchors"))


@query()
def align_pairs_stats(t):
    """Each conversation's turns against the turn before: kinds of pairs, with e and é as variants."""
    c = t("conversations")
    prev = c.selectExpr("conv_id", "turn + 1 as turn", "text as ref")
    rows = c.join(prev, ["conv_id", "turn"]).select((F.col("conv_id") * 100 + F.col("turn")).alias("pair"), F.col("text").alias("ocr"), "ref")
    variants = t("conversations").sparkSession.createDataFrame([("e", "é"), ("a", "à"), ("u", "ü"), ("n", "ñ")], "a string, b string")
    return al.text_stats(rows, ["pair"], variants)


@query()
def best_window(t):
    """Where each benchmark item is in the documents that contain it, found again from its altered text."""
    m = di.substring_join(t("documents").select("doc_id", "text"), t("benchmark").select(F.col("text").alias("headword")), "doc_id")
    both = dealt(m.join(t("documents").select("doc_id", "text"), "doc_id"), 0, "doc_id", "start")  # few bytes, and much work
    rows = both.select("doc_id", "start", F.col("end").alias("stop"), al.best_window(F.regexp_replace("headword", "e", "é"), F.col("text")).alias("w"))
    return rows.select("doc_id", F.col("start").alias("true_start"), "stop", "w.start", "w.length", F.round("w.ratio", 6).alias("ratio"))


@query("""
SELECT conv_id, turn::INT AS page, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, true AS found FROM conversations
""")
def page_mapping(t):
    """Conversations as documents and their turns as pages, with every 15th character altered: where each turn begins in
    the whole text."""
    c = t("conversations")
    whole = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "").alias("text"))
    return al.map_pages(c.select("conv_id", F.col("turn").cast("int").alias("page"), F.regexp_replace("text", "(?s)(.{14}).", "$1~").alias("text")), whole, "conv_id").select("conv_id", "page", "start", (F.col("confidence") > 0.6).alias("found"))


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents), c AS (SELECT doc_id, i > 1 AND regexp_matches(line, '^[A-Z]') AS changed FROM l)
SELECT doc_id, count(*) FILTER (NOT changed) AS unchanged, count(*) FILTER (changed) AS removed, count(*) FILTER (changed) AS added FROM c GROUP BY doc_id
""")
def line_diff(t):
    """Line changes between an item and its text in upper case from the second line on."""
    b = t("documents").select("doc_id", "text", F.regexp_replace("text", r"\n([A-Z])", "\n-$1").alias("new"))
    ops = b.select("doc_id", F.explode(al.diff_lines("text", "new")).alias("d"))
    return ops.groupBy("doc_id").agg(*(F.count_if(F.col("d.op") == k).alias(k) for k in ("unchanged", "removed", "added")))


@query("SELECT doc_id, nfc_normalize(text) AS text FROM documents")
def nfc_normalize(t):
    return t("documents").select("doc_id", al.nfc("text").alias("text"))


@query(r"""
SELECT doc_id, md5(regexp_replace(text, '[.,;:!?]|\s', '', 'g')) AS clean_md5, len(regexp_extract_all(text, '[.,;:!?]')) AS n_marks, 0 AS n_glosses FROM documents
""")
def clean_text(t):
    """Texts without punctuation and white space, and the places of their marks."""
    rows = t("documents").select("doc_id", al.clean_text(F.col("text"), F.lit(".,;:!?"), F.lit(False)).alias("c"))
    return rows.select("doc_id", F.md5("c.clean").alias("clean_md5"), F.size("c.marks").alias("n_marks"), F.size("c.glosses").alias("n_glosses"))


@query("SELECT user_id, count(props) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE props IS NOT NULL GROUP BY user_id")
def json_salvage(t):
    """Answers of an object whose second array is cut off: thinking and half a fence before it, brackets in strings and
    in arrays within the items."""
    item = F.concat(F.lit('{"id": '), "event_id", F.lit(', "p": '), "props", F.lit(', "q": ["]", [{"x": "}{"}]]}'))
    e = t("events").where("props is not null").groupBy("user_id").agg(F.array_join(F.sort_array(F.collect_list(item)), ",\n ").alias("all"))
    raw = F.concat(F.lit('<think>{"annotations": [</think> answer:\n```json\n{"notes": [1, {"n": 2}], "annotations": [ '), "all", F.lit(', {"id": 5, "cut": "x'))
    rows = e.select("user_id", F.from_json(al.salvage_json(raw), "annotations array<struct<id: bigint>>").alias("j"))
    return rows.select("user_id", F.size("j.annotations").cast("bigint").alias("n"), F.aggregate("j.annotations", F.lit(0).cast("bigint"), lambda acc, x: acc + x["id"]).alias("ids"))


GLOSS_MARKS = ".,;:!?()"


@query(f"""
WITH d AS (SELECT doc_id, translate(text, 'anoti', '天地는은x') AS x FROM documents),
r AS (SELECT doc_id, regexp_extract_all(x, '[가-힣]+|[{GLOSS_MARKS}]|[ \n\r\t]+|[^가-힣{GLOSS_MARKS} \n\r\t]+') AS r FROM d),
e AS (SELECT doc_id, unnest(r) AS run, generate_subscripts(r, 1) AS i FROM r),
k AS (SELECT *, CASE WHEN regexp_matches(run, '^[가-힣]') THEN 'g' WHEN regexp_matches(run, '^[{GLOSS_MARKS}]$') THEN 'm' WHEN regexp_matches(run, '^[ \n\r\t]') THEN 's' ELSE 't' END AS kind FROM e),
c AS (SELECT *, coalesce(last_value(CASE WHEN kind = 't' THEN regexp_matches(run, '[天地]$') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS on_han, lag(run) OVER w AS before, lead(run) OVER w AS behind FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT d.doc_id, count(*) FILTER (kind = 'm') AS n_marks, coalesce(sum((length(run) + 3) // 4) FILTER (kind = 'g' AND on_han), 0)::BIGINT AS n_taken,
  count(*) FILTER (kind = 'g' AND length(run) <= 4 AND regexp_matches(before, '[天地]$') AND (behind IS NULL OR regexp_matches(behind, '^[天地{GLOSS_MARKS} \n]'))) AS n_found,
  md5(coalesce(string_agg(run, '' ORDER BY i) FILTER (kind = 't' OR (kind = 'g' AND NOT on_han)), '')) AS clean_md5
FROM d LEFT JOIN c USING (doc_id) GROUP BY d.doc_id
""")
def gloss_scan(t):
    """Texts with some letters made ideographs and some made syllables: glosses that are found where they stand, and those
    that cleaning takes out."""
    rows = t("documents").select("doc_id", F.translate("text", "anoti", "天地는은x").alias("x"))
    rows = rows.select("doc_id", al.clean_text("x", F.lit(GLOSS_MARKS), F.lit(True)).alias("c"), F.size(al.find_glosses("x")).cast("bigint").alias("n_found"))
    taken = F.size("c.glosses").cast("bigint")
    return rows.select("doc_id", F.size("c.marks").cast("bigint").alias("n_marks"), taken.alias("n_taken"), "n_found", F.md5("c.clean").alias("clean_md5"))


@query("""
WITH RECURSIVE o AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS j, o_orderpriority AS p FROM orders),
ab AS (SELECT o_custkey, list(p ORDER BY i) AS a, list(p ORDER BY j) AS b FROM o GROUP BY o_custkey),
lcs(o_custkey, a, b, i, best) AS (
  SELECT o_custkey, a, b, 0, list_transform(range(0, len(b) + 1), lambda x: 0::BIGINT) FROM ab
  UNION ALL SELECT o_custkey, a, b, i + 1, list_transform(range(0, len(b) + 1), lambda k: list_max(list_transform(range(0, k + 1), lambda m: CASE WHEN m > 0 AND b[m] = a[i + 1] THEN best[m] + 1 ELSE best[m + 1] END))) FROM lcs WHERE i < len(a))
SELECT o_custkey, best[len(b) + 1] AS unchanged, len(a) - best[len(b) + 1] AS removed, len(b) - best[len(b) + 1] AS added FROM lcs WHERE i = len(a)
""")
def line_diff_moved(t):
    """A customer's priorities by date and by price, one a line: lines that moved, and many that are equal."""
    lines = lambda by: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(by, "o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]), "\n")
    rows = t("orders").groupBy("o_custkey").agg(lines("o_orderdate").alias("old"), lines("o_totalprice").alias("new"))
    ops = rows.select("o_custkey", F.explode(al.diff_lines("old", "new")).alias("d"))
    return ops.groupBy("o_custkey").agg(*(F.count_if(F.col("d.op") == k).alias(k) for k in ("unchanged", "removed", "added")))
