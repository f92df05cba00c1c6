"""Queries of the catalogue, page and source operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog as ca
from .registry import query


@query("""
SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))) AS text_md5 FROM pages
""")
def html_to_text(t):
    return t("pages").select("page_id", F.md5(ca.html_text(F.col("html"))).alias("text_md5"))


LINKS = """
WITH r AS (SELECT page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS root, regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS folder, regexp_extract_all(html, '(?i)\\bhref="([^"]*)"', 1) AS h FROM pages),
e AS (SELECT page_id, root, folder, regexp_replace(unnest(h), '#.*$', '') AS raw, generate_subscripts(h, 1) - 1 AS pos FROM r),
l AS (SELECT page_id, pos, CASE WHEN regexp_matches(raw, '^https?://') THEN raw WHEN raw LIKE '/%' THEN root || raw ELSE folder || raw END AS link FROM e WHERE raw <> ''),
d AS (SELECT page_id, link, min(pos) AS pos FROM l GROUP BY ALL)
"""


@query(LINKS + "SELECT * FROM d")
def link_extract(t):
    return ca.html_links(t("pages"), "page_id")


@query(LINKS + """, b AS (SELECT page_id, regexp_extract(link, '^(https?://[^?#]*/)', 1) AS dir, count(*) AS n, min(link) AS first FROM d GROUP BY ALL)
SELECT page_id, dir, CASE WHEN n >= 2 THEN 'bundle' ELSE 'single' END AS kind, n, substring(md5(first), 1, 12) || CASE WHEN n >= 2 THEN '_bundle' ELSE '' END AS bundle_id FROM b
""")
def asset_bundles(t):
    return ca.bundles(ca.html_links(t("pages"), "page_id"), "page_id")


@query("""
SELECT page_id, lower(regexp_extract(url, '^https?://([^/?#:]*)', 1)) AS host, CASE WHEN regexp_matches(url, '^https?://m\\.') THEN 'mobile' WHEN regexp_matches(url, '\\.org/') THEN 'org' WHEN regexp_matches(url, '^https?://') THEN 'generic' END AS parser,
  nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page_param,
  substring(CASE WHEN regexp_matches(s, '^[0-9]') THEN 'doc_' || s ELSE s END, 1, 64) AS slug, substring(md5(url), 1, 12) AS asset_id
FROM (SELECT *, trim(regexp_replace(regexp_replace(lower(CASE page_id % 3 WHEN 0 THEN page_id || ' -- ' ELSE '' END || regexp_extract(html, '<title>([^<]*)</title>', 1) || ' 論語_'), '[^a-z0-9 _-]', '', 'g'), '[ _-]+', '_', 'g'), '_') AS s FROM pages)
""")
def url_route_and_slug(t):
    url = F.col("url")
    return t("pages").select(
        "page_id", ca.host_of(url).alias("host"), ca.route(url, [(r"^https?://m\.", "mobile"), (r"\.org/", "org"), ("^https?://", "generic")]).alias("parser"),
        F.nullif(F.regexp_extract(url, "[?&]page=([^&#]*)", 1), F.lit("")).alias("page_param"), ca.slug(F.concat(F.when(F.col("page_id") % 3 == 0, F.concat("page_id", F.lit(" -- "))).otherwise(""), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" 論語_"))).alias("slug"), ca.asset_id(url).alias("asset_id"),
    )


@query("""
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 0 THEN 'short' ELSE rpad(substring(strftime(o_orderdate, '%y%m%d'), 1, 6), 6, ' ') || CASE WHEN o_orderstatus = 'O' THEN 's' WHEN o_orderstatus = 'F' THEN 'm' ELSE 'x' END || strftime(o_orderdate, '%Y') || CASE WHEN o_orderkey % 3 = 0 THEN '19##' ELSE '    ' END || 'ko ' || repeat('0', 17) || 'chi  ' END AS x FROM orders)
SELECT o_orderkey, CASE substring(x, 7, 1) WHEN 's' THEN 'single' WHEN 'm' THEN 'multiple' END AS date_type, nullif(regexp_replace(substring(x, 8, 4), '[# ]', '', 'g'), '') AS year_1, nullif(regexp_replace(substring(x, 12, 4), '[# ]', '', 'g'), '') AS year_2, trim(substring(x, 16, 3)) AS country, substring(x, 36, 3) AS language FROM f WHERE length(x) >= 35
""")
def marc_008(t):
    field = F.expr("if(o_orderkey % 20 = 0, 'short', concat(date_format(o_orderdate, 'yyMMdd'), case o_orderstatus when 'O' then 's' when 'F' then 'm' else 'x' end, date_format(o_orderdate, 'yyyy'), if(o_orderkey % 3 = 0, '19##', '    '), 'ko ', repeat('0', 17), 'chi  '))")
    rows = t("orders").select("o_orderkey", ca.decode_008(field).alias("r"))
    return rows.where("r is not null").select("o_orderkey", "r.*")


@query("""
SELECT c_custkey, c_name || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE ' /' END AS a, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE c_nationkey::VARCHAR END AS b FROM customer
""")
def marc_subfields(t):
    text = F.expr("concat('▼a', c_name, if(c_custkey % 2 = 0, ' /', ' / ;.,  '), ' ▼ b ', c_nationkey, ' . ▼c /', if(c_custkey % 3 = 0, concat('▼b', c_mktsegment), ''))")
    rows = t("customer").select("c_custkey", ca.subfields(text).alias("m"))
    return rows.select("c_custkey", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"))


@query("SELECT s_suppkey, 'author' AS role, s_name AS name, 'c' || s_nationkey AS period FROM supplier UNION ALL SELECT s_suppkey, NULL, 'n' || s_nationkey, NULL FROM supplier")
def creators(t):
    text = F.expr("concat('author:', s_name, '（c', s_nationkey, '）／ n', s_nationkey)")
    return t("supplier").select("s_suppkey", F.inline(ca.creators(text)))


@query("""
SELECT 'customer' AS source, c_name AS title, c_mktsegment AS subject, NULL::VARCHAR AS place, 'title,subject' AS given FROM customer
UNION ALL SELECT 'supplier', s_name, NULL, s_nationkey::VARCHAR, 'title,place' FROM supplier
UNION ALL SELECT 'part', p_name, p_type, NULL, 'title,subject' FROM part
""")
def bibliography_union(t):
    sources = [("customer", t("customer"), {"title": "c_name", "subject": "c_mktsegment"}), ("supplier", t("supplier"), {"title": "s_name", "place": "s_nationkey"}), ("part", t("part"), {"title": "p_name", "subject": "p_type"})]
    return ca.unify(sources, ["title", "subject", "place"])


@query("""
SELECT p_partkey, array_to_string(list_filter(['《' || p_name || '》', p_brand, CASE WHEN p_size % 2 = 0 THEN 'p. ' || p_size END], lambda x: x IS NOT NULL AND trim(x) <> ''), ', ') AS citation FROM part
""")
def citation_format(t):
    return t("part").select("p_partkey", ca.format_citation([F.concat(F.lit("<"), "p_name", F.lit(">")), F.col("p_brand"), F.expr("if(p_size % 2 = 0, concat('p. ', p_size), null)")]).alias("citation"))
