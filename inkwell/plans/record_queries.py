"""Queries of the record, lineage and usage operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.tasks import dealt
from ..operators import lineage as li
from ..operators import records as rc
from ..operators import stewardship as st
from ..operators import reports as rp
from ..operators import selection as se
from ..operators import usage as us
from .registry import query


@query("SELECT conv_id, turn, text FROM conversations WHERE role IS NOT DISTINCT FROM 'user' AND turn IS NOT DISTINCT FROM 2")
def filter_equal(t):
    return rc.where_equal(t("conversations"), {"role": "user", "turn": 2}).select("conv_id", "turn", "text")


@query("SELECT o_orderkey, count(*) FILTER (l_suppkey = 3) > 0 AS refers FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def exists_in_refs(t):
    refs = t("lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("document_id"), F.lit(1).alias("page"))).alias("refs"))
    rows = t("orders").join(refs, F.col("o_orderkey") == F.col("l_orderkey"))
    none = F.struct(F.lit(None).cast("bigint").alias("document_id"), F.lit(None).cast("int").alias("page"))
    return rows.select("o_orderkey", rc.refers_to(F.col("refs"), none, 3, 1).alias("refers"))


@query("""
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN l.doc_id IS NULL OR d.source = 'src3' THEN d.lang ELSE 'q' || l.quality END AS lang,
  CASE WHEN d.doc_id IS NULL THEN 'added' WHEN l.doc_id IS NULL THEN 'kept' WHEN d.source = 'src3' THEN 'protected' ELSE 'replaced' END AS origin,
  CASE WHEN d.doc_id IS NULL OR (l.doc_id IS NOT NULL AND d.source <> 'src3') THEN 'label' ELSE d.source END AS source
FROM (SELECT * FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN labels l ON l.doc_id = d.doc_id
""")
def upsert_protected(t):
    old = t("documents").where("doc_id % 3 <> 0").select("doc_id", "lang", "source")
    new = t("labels").selectExpr("doc_id", "concat('q', quality) as lang", "'label' as source")
    return rc.upsert(old, new, "doc_id", ["lang", "source"], F.col("o_source") == "src3")


@query("SELECT 'labels' AS layer, doc_id, count(*) AS n FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en') GROUP BY doc_id")
def referential_violations(t):
    return rc.dangling(t("labels"), "doc_id", t("documents").where("lang = 'en'"), "labels")


@query("""
WITH n AS (SELECT conv_id AS block, string_agg(text, ' ' ORDER BY turn) AS now FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
a AS (SELECT conv_id AS block, turn AS id, text AS snapshot FROM conversations)
SELECT block, id FROM a LEFT JOIN n USING (block) WHERE snapshot IS NOT NULL AND snapshot <> coalesce(now, '')
""")
def translation_drift(t):
    c = t("conversations")
    return rc.drifted(c.selectExpr("conv_id as block", "turn as id", "text as snapshot"), c.where("role = 'assistant'").selectExpr("conv_id as block", "turn as seq", "text"), "block")


@query("""
WITH b AS (SELECT o_orderkey AS id FROM orders WHERE o_orderstatus = 'P'),
g AS (SELECT 1000000000 + l_orderkey * 10 + l_linenumber AS id, l_orderkey AS block_id FROM lineitem WHERE l_linenumber = 1),
r AS (SELECT 2000000000 + l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN l_orderkey ELSE 1000000001 + l_orderkey * 10 END AS subject_id, 3000000000 + l_partkey AS object_id, l_orderkey + 1 AS evidence FROM lineitem WHERE l_returnflag = 'R'),
t AS (SELECT DISTINCT id FROM g WHERE block_id IN (SELECT id FROM b)),
e AS (SELECT id FROM b UNION SELECT id FROM t),
f AS (SELECT * FROM r WHERE subject_id IN (SELECT id FROM e) OR object_id IN (SELECT id FROM e) OR evidence IN (SELECT id FROM b))
SELECT 'block' AS kind, id FROM b UNION SELECT 'tag', id FROM t UNION SELECT 'relation', id FROM f UNION SELECT 'entity', subject_id FROM f UNION SELECT 'entity', object_id FROM f
""")
def entity_one_hop(t):
    lines = t("lineitem")
    blocks = t("orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    tags = lines.where("l_linenumber = 1").selectExpr("1000000000 + l_orderkey * 10 + l_linenumber as id", "l_orderkey as block_id")
    rel = lines.where("l_returnflag = 'R'").selectExpr("2000000000 + l_orderkey * 10 + l_linenumber as id", "if(l_linenumber % 2 = 0, l_orderkey, 1000000001 + l_orderkey * 10) as subject_id", "3000000000 + l_partkey as object_id", "array(l_orderkey + 1) as evidence")
    return rc.one_hop(blocks, tags, rel)


@query("""
WITH c AS (SELECT o_orderkey AS id, o_orderstatus AS old, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS new FROM orders)
SELECT id, old, new, old = new OR (old || '>' || new) IN ('O>F', 'O>P', 'P>F') AS ok FROM c WHERE new IS NOT NULL
""")
def status_transitions(t):
    from pyspark.sql import Window

    c = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("old"), F.lead("o_orderstatus").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("new"))
    return rc.check_transitions(c.where("new is not null"), [("O", "F"), ("O", "P"), ("P", "F")])


@query("""
WITH p AS (SELECT DISTINCT p_brand AS type FROM part WHERE p_size < 13), c AS (SELECT DISTINCT p_brand AS type FROM part), h AS (SELECT DISTINCT p_brand AS type FROM part WHERE p_size = 7)
SELECT * FROM (SELECT type, 'preset' AS origin FROM p UNION ALL SELECT type, 'custom' FROM c WHERE type NOT IN (SELECT type FROM p)) WHERE type NOT IN (SELECT type FROM h)
""")
def visible_types(t):
    brand = lambda where: t("part").where(where).select(F.col("p_brand").alias("type")).distinct()
    return rc.visible_types(brand("p_size < 13"), brand("true"), brand("p_size = 7"), "type")


@query("""
WITH m AS (SELECT DISTINCT a.l_partkey AS a, b.l_partkey AS b FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey),
f AS (SELECT l_orderkey, max(l_partkey) FILTER (l_linenumber = 1) AS x, max(l_partkey) FILTER (l_linenumber = 2) AS y FROM lineitem GROUP BY l_orderkey),
k AS (SELECT DISTINCT least(x, y) AS a, greatest(x, y) AS b FROM f WHERE x IS NOT NULL AND y IS NOT NULL)
SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = m.a AND k.b = m.b)
""")
def variant_bulk_import(t):
    """The parts of every order as a group of variants; pairs of first and second lines are known already."""
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    lines = dealt(lines, lines.count(), "l_orderkey")
    at = lambda n: F.max(F.when(F.col("l_linenumber") == n, F.col("l_partkey")))
    known = lines.groupBy("l_orderkey").agg(at(1).alias("a"), at(2).alias("b")).where("a is not null and b is not null")
    return rc.variant_pairs(lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("chars")), "chars", known)


EVENTS = "SELECT event_id, ts, user_id, event_type, value, 'Change L' || event_id % 5 || CASE WHEN event_id % 3 = 0 THEN ' punctuation' ELSE '' END || chr(10) || 'body' || chr(10) || CASE WHEN event_id % 4 = 0 THEN 'Based-On-Original: h' || event_id ELSE 'none' END AS message FROM events"


def commits(t):
    return t("events").selectExpr("event_id", "ts", "user_id", "event_type", "value", r"concat('Change L', event_id % 5, if(event_id % 3 = 0, ' punctuation', ''), '\nbody\n', if(event_id % 4 = 0, concat('Based-On-Original: h', event_id), 'none')) as message")


@query(f"""
WITH e AS ({EVENTS})
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'h' || event_id END AS linked, 'L' || event_id % 5 || CASE WHEN event_id % 3 = 0 THEN ',L' || event_id % 5 || '_punctuation' ELSE '' END AS layers FROM e
""")
def trailers_and_layers(t):
    return commits(t).select("event_id", li.trailer(F.col("message"), "Based-On-Original").alias("linked"), F.array_join(li.layers_of(F.col("message")), ",").alias("layers"))


@query("""
WITH l AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'click'), e AS (SELECT user_id, ts, event_id FROM events WHERE event_type = 'view'),
o AS (SELECT user_id, min_by(event_id, (ts, event_id)) AS oldest FROM e GROUP BY user_id),
j AS (SELECT l.user_id, l.event_id, l.ts, max_by(e.event_id, (e.ts, e.event_id)) AS before FROM l LEFT JOIN e ON e.user_id = l.user_id AND e.ts <= l.ts GROUP BY ALL)
SELECT user_id, event_id, ts, coalesce(before, oldest) AS linked, before IS NOT NULL AS preceded FROM j LEFT JOIN o USING (user_id)
""")
def asof_estimated_link(t):
    e = t("events")
    return li.as_of_link(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "ts", "event_id")


@query("SELECT event_type, event_id, (row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) - 1) * 48 + 50 AS y FROM events")
def ladder_layout(t):
    return li.ladder(t("events"), "ts", "event_id", "event_type")


@query("""
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT *, total > 15 AS has_more FROM r WHERE rn > 10 AND rn <= 15
""")
def paginate(t):
    return li.page_of(t("events"), "user_id", "ts", "event_id", 10, 5)


@query("""
WITH s AS (SELECT *, coalesce(sum(CASE WHEN event_type = 'purchase' OR value > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS segment FROM events)
SELECT user_id, segment, count(*) AS n, max_by(event_id, (ts, event_id)) AS last_id FROM s GROUP BY ALL
""")
def push_milestones(t):
    return li.milestones(t("events"), "user_id", "ts", "event_id", (F.col("event_type") == "purchase") | (F.col("value") > 90))


@query("""
WITH d AS (SELECT doc_id, source, 'sha256:' || sha256(replace(text, chr(13) || chr(10), chr(10))) AS h FROM documents),
c AS (SELECT doc_id, source, CASE WHEN doc_id % 10 = 3 THEN 'acknowledged' WHEN doc_id % 7 = 0 OR doc_id % 5 = 1 THEN 'changed' ELSE 'unchanged' END AS status FROM d)
SELECT source, CASE WHEN bool_and(status IN ('unchanged', 'updated')) THEN 'current' WHEN bool_and(status IN ('unchanged', 'updated', 'acknowledged')) THEN 'acknowledged'
  WHEN bool_or(status = 'acknowledged') AND bool_or(status = 'changed') THEN 'partially_acknowledged' ELSE 'outdated' END AS status, count(*) FILTER (status = 'changed') AS n_changed FROM c GROUP BY source
""")
def dependency_rollup(t):
    d = t("documents")
    tracked = d.select("doc_id", "source", li.content_hash(F.col("text")).alias("hash_at_base"), F.when(F.col("doc_id") % 10 == 3, "acknowledged").otherwise("unchanged").alias("status"))
    now = d.where("doc_id % 5 <> 1").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "sha256:other").otherwise(li.content_hash(F.col("text"))).alias("hash_now"))
    return st.dependency_status(li.check_dependencies(tracked, now, "doc_id").join(d.select("doc_id", "source"), "doc_id"), "source")


@query("""
WITH v AS (SELECT props AS path, event_id AS seq, value AS content FROM events), l AS (SELECT path, max_by(content, seq) AS content FROM v WHERE seq <= (SELECT max(event_id) // 2 FROM events) GROUP BY path),
p AS (SELECT DISTINCT user_id AS layer, props AS path, user_id % 3 AS priority FROM events)
SELECT layer, min_by(path, (priority, path)) AS path, min_by(content, (priority, path)) AS content FROM p JOIN l USING (path) GROUP BY layer
""")
def layer_as_of_version(t):
    e = t("events")
    half = e.agg(F.max("event_id")).first()[0] // 2
    return li.as_of_version(e.selectExpr("props as path", "event_id as seq", "value as content"), e.selectExpr("user_id as layer", "props as path", "user_id % 3 as priority").distinct(), half, "layer")


LOG = "SELECT ts, CASE WHEN event_type = 'error' THEN 'error' ELSE 'call' END AS type, event_type AS provider, 'p' || user_id % 4 AS purpose, CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS cost FROM events"


def usage_log(t):
    return t("events").selectExpr("ts", "if(event_type = 'error', 'error', 'call') as type", "event_type as provider", "concat('p', user_id % 4) as purpose", "if(event_id % 10 = 0, null, value) as cost")


@query(f"""
WITH l AS ({LOG}), m AS (SELECT * FROM l WHERE type = 'call' AND strftime(ts, '%Y-%m') = '2024-01')
SELECT 'provider' AS dimension, provider AS name, count(*) AS calls, round(sum(coalesce(cost, 0)), 4) AS cost, NULL::DOUBLE AS remaining FROM m GROUP BY provider
UNION ALL SELECT 'purpose', purpose, count(*), round(sum(coalesce(cost, 0)), 4), NULL FROM m GROUP BY purpose
UNION ALL SELECT 'all', NULL, count(*), round(sum(coalesce(cost, 0)), 4), round(1e6 - sum(coalesce(cost, 0)), 4) FROM m
""")
def monthly_usage(t):
    return us.monthly_usage(usage_log(t), "2024-01", 1e6)


@query("""
SELECT 'role' AS dimension, role AS name, count(*) AS n FROM conversations GROUP BY role UNION ALL SELECT 'turn', turn::VARCHAR, count(*) FROM conversations GROUP BY turn UNION ALL SELECT 'all', NULL, count(*) FROM conversations
""")
def annotation_summary(t):
    return us.counts_by(t("conversations"), ["role", "turn"])


@query("SELECT conv_id, count(*) AS total, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant FROM conversations GROUP BY conv_id")
def status_counts(t):
    return us.status_counts(t("conversations"), "conv_id", "role", ["user", "assistant"])


@query("""
SELECT conv_id, turn, round(CASE WHEN turn % 3 = 0 THEN 0 ELSE length(text) END / 1000 * CASE role WHEN 'user' THEN 0.5 WHEN 'assistant' THEN 1.5 ELSE 1.0 END + turn / 1000 * CASE role WHEN 'user' THEN 1.0 WHEN 'assistant' THEN 2.0 ELSE 3.0 END, 6) AS cost,
  role || CASE turn % 4 WHEN 0 THEN '|auto|m|' WHEN 1 THEN '|stub|auto|' WHEN 2 THEN '|auto|auto|' ELSE '|stub|m|' END || length(text) || '|' || sha256(text) AS key FROM conversations
""")
def cost_and_cache_key(t):
    """Tokens are not known for every third turn; a provider or model is not asked for, or is empty, for others."""
    n = F.when(F.col("turn") % 3 != 0, F.char_length("text"))
    cost = us.cost_estimate(n, F.col("turn"), F.col("role"), {"user": (0.5, 1.0), "assistant": (1.5, 2.0)}, (1.0, 3.0))
    provider, model = F.expr("case turn % 4 when 0 then '' when 2 then null else 'stub' end"), F.expr("case when turn % 4 in (1, 2) then null else 'm' end")
    return t("conversations").select("conv_id", "turn", cost.alias("cost"), us.cache_key(F.col("role"), provider, model, F.col("text")).alias("key"))


@query("""
WITH d AS (SELECT doc_id, ['punctuation', 'translation', 'annotation', 'other'][doc_id % 4 + 1] AS purpose, length(text) AS n FROM documents),
b AS (SELECT *, CASE purpose WHEN 'punctuation' THEN least(greatest(768 + floor(n * 0.35::DOUBLE), 768), 2048) WHEN 'translation' THEN least(greatest(1400 + floor(n * 0.8::DOUBLE), 1400), 4096)
  WHEN 'annotation' THEN least(greatest(2800 + floor(n * 1.6::DOUBLE), 4096), 16384) ELSE 4096 END::BIGINT AS budget FROM d)
SELECT doc_id, budget, CASE purpose WHEN 'annotation' THEN least(greatest(floor(budget * 1.5::DOUBLE), 4096), 24576) WHEN 'translation' THEN least(greatest(floor(budget * 1.35::DOUBLE), 1400), 8192)
  ELSE least(greatest(floor(budget * 1.25::DOUBLE), 768), 4096) END::BIGINT AS next_budget, least(greatest(n // 8, 6), 24) AS most_items FROM b
""")
def token_budgets(t):
    purpose = F.expr("element_at(array('punctuation', 'translation', 'annotation', 'other'), int(doc_id % 4) + 1)")
    rows = t("documents").select("doc_id", purpose.alias("purpose"), F.char_length("text").alias("n"))
    rows = rows.withColumn("budget", us.token_budget(F.col("purpose"), F.col("n")))
    return rows.select("doc_id", "budget", us.next_budget(F.col("purpose"), F.col("budget")).alias("next_budget"), us.most_items(F.col("n")).alias("most_items"))


@query("""
WITH n AS (SELECT max(ts) AS now FROM events), f AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS nth FROM events, n WHERE ts >= now - INTERVAL 864000 SECOND)
SELECT * FROM f WHERE nth <= 12
""")
def cache_prune(t):
    e = t("events").selectExpr("user_id", "event_id as id", "ts")
    now = e.agg(F.max("ts").alias("now"))
    rows = us.prune_cache(e, "user_id", F.lit(now.first()["now"]).cast("timestamp"), 864_000, 12)
    return rows.select("user_id", F.col("id").alias("event_id"), "nth")


#: Messages of errors; the first twelve may pass when tried again.
MESSAGES = "['HTTP 503', 'Service Unavailable', 'Read timeout', 'temporarily down', 'Rate limit hit', '429', 'Connection reset by peer', 'bad JSON', 'cannot parse', 'truncated', 'Empty response', '빈 응답', 'timed out', 'overloaded', 'connection refused', 'key missing']"


@query(f"SELECT event_id, event_id % 16 < 12 AS retryable FROM (SELECT event_id, ({MESSAGES})[event_id % 16 + 1] AS m FROM events)")
def retryable_flag(t):
    message = F.expr(f"element_at(array({MESSAGES[1:-1]}), int(event_id % 16) + 1)")
    return t("events").select("event_id", us.retryable(F.concat_ws(": ", "event_type", message)).alias("retryable"))


@query("""
SELECT source, count(*) AS pages_saved, sum(n_chars)::BIGINT AS chars, bool_or(contains(text, '!!')) AS shouting, max(doc_id) AS page_count, round(avg(n_chars), 4) AS mean_chars FROM documents GROUP BY source
""")
def import_stats(t):
    pages = t("documents").select("source", F.col("doc_id").alias("page"), F.col("n_chars").alias("chars"), F.contains(F.col("text"), F.lit("!!")).alias("flag"))
    return rp.import_stats(pages, "source").withColumnRenamed("flagged", "shouting")


@query("SELECT doc_id FROM documents WHERE lang <> 'en' UNION SELECT doc_id FROM labels WHERE toxic = 1")
def page_set_union(t):
    return se.any_of([t("documents").where("lang <> 'en'"), t("labels").where("toxic = 1")], ["doc_id"])


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def revert_path_set(t):
    return li.paths_to_remove(t("documents"), t("labels"), "doc_id")


@query("""
SELECT conv_id, to_json({'conv': conv_id, 'turns': list({'turn': turn, 'role': role, 'text': text} ORDER BY turn)})::VARCHAR AS snapshot FROM conversations GROUP BY conv_id
""")
def snapshot_export(t):
    from ..sources import snapshots

    return snapshots.export_rows(t("conversations"))


@query("SELECT conv_id, turn, role, text FROM conversations")
def snapshot_round_trip(t):
    from ..sources import snapshots

    return snapshots.import_rows(snapshots.export_rows(t("conversations")))


@query("""
SELECT o_orderkey, list_filter(['clerk' || CASE WHEN o_orderkey % 2 = 0 THEN '=c' END, 'status=' || o_orderstatus, 'note' || CASE WHEN o_orderkey % 5 = 0 THEN '=n' END], lambda x: x IS NOT NULL) AS kept FROM orders
""")
def null_values_dropped(t):
    """Fields of a draft as a map; those without a value are left out."""
    m = F.expr("map('clerk', if(o_orderkey % 2 = 0, 'c', null), 'status', o_orderstatus, 'note', if(o_orderkey % 5 = 0, 'n', null))")
    return t("orders").select("o_orderkey", F.transform(F.map_entries(rc.drop_null_values(m)), lambda e: F.concat_ws("=", e["key"], e["value"])).alias("kept"))


@query("""
SELECT p_partkey, p_partkey % 2 = 0 OR p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS place, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS inner_place, p_partkey % 7 = 0 AS other FROM part
""")
def empty_structs(t):
    """A struct within a struct: each is null once all below it are."""
    tree = F.expr("named_struct('place', named_struct('city', if(p_partkey % 2 = 0, 'c', null), 'more', named_struct('lat', if(p_partkey % 3 = 0, 1, null), 'lon', if(p_partkey % 5 = 0, 2D, null))), 'other', named_struct('x', if(p_partkey % 7 = 0, true, null)))")
    rows = t("part").select("p_partkey", tree.alias("v")).select("p_partkey", rc.collapse_nested("v", t("part").select(tree.alias("v")).schema["v"].dataType).alias("v"))
    return rows.select("p_partkey", F.col("v.place").isNotNull().alias("place"), F.col("v.place.more").isNotNull().alias("inner_place"), F.col("v.other").isNotNull().alias("other"))
