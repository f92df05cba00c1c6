"""Queries op1 to op13 over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import contaminated
from .exact_dedup import exact_dedup
from .jaccard_join import jaccard_components
from .lexical_search import lexical_search
from .line_dedup import LINE_TAGS, NOT_TEXT, line_dedup
from .lm_scoring import lm_scores
from .mixing import mix
from .quality import quality
from .quality_rules import quality_rules
from .secrets import scan_secrets
from .substring_dedup import substring_dedup
from .token_output import token_output
from .whitening import whiten

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


OP4_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, any_value(a.n) AS m, any_value(b.n) AS n FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 90 * (m + n - shared)), u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id)
SELECT doc_id, len(s) AS n_shingles, min(c) AS component_id FROM s JOIN r USING (doc_id) GROUP BY ALL
"""


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "pages"))


OP7_SQL = f"""
WITH t AS (
  SELECT page_id, coalesce(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host,
         regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '{NOT_TEXT}', '', 'g'), '{LINE_TAGS}', chr(10), 'g'), '<[^>]*>', '', 'g') AS body
  FROM pages),
l AS (SELECT page_id, host, list_filter(list_transform(string_split_regex(body, '[\\r\\n]+'), lambda x: trim(x)), lambda x: x <> '') AS lines FROM t),
n AS (SELECT host, count(*) AS total FROM l GROUP BY host),
c AS (SELECT host, line, count(*) AS seen FROM (SELECT page_id, host, unnest(list_distinct(lines)) AS line FROM l) GROUP BY host, line),
b AS (SELECT host, list(line) AS boiler FROM c JOIN n USING (host) WHERE seen >= 3 AND seen > 0.3 * total GROUP BY host),
k AS (SELECT page_id, host, len(lines) AS n_lines, list_filter(lines, lambda x: NOT list_contains(coalesce(boiler, []), x)) AS kept FROM l LEFT JOIN b USING (host))
SELECT page_id, host, n_lines, n_lines - len(kept) AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
"""

#: Parts of the sources of documents; sources that are not named have one.
MIX_PARTS = {"src0": 4, "src1": 2}


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), MIX_PARTS)


OP8_SQL = f"""
WITH RECURSIVE s AS (SELECT DISTINCT coalesce(source, '') AS source FROM documents),
p AS (SELECT source, CASE source {' '.join(f"WHEN '{k}' THEN {v}" for k, v in MIX_PARTS.items())} ELSE 1 END AS part FROM s),
q AS (SELECT sum(part)::BIGINT AS parts, greatest(1000, 4 * sum(part))::BIGINT AS q FROM p),
f AS (SELECT source, part * q // parts AS least, part * q % parts AS rest, q FROM p, q),
w AS (SELECT source, q, least + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= q - sum(least) OVER () THEN 1 ELSE 0 END AS w,
             row_number() OVER (ORDER BY source) AS i FROM f),
a AS (SELECT list(w ORDER BY i) AS ws, max(q) AS q FROM w),
edf(t, js, pick, picked_j) AS (
  SELECT -1::BIGINT, list_transform(ws, lambda x: 0::BIGINT), 0::BIGINT, 0::BIGINT FROM a
  UNION ALL
  SELECT t, list_transform(js, lambda j, i: CASE WHEN i = pick THEN j + 1 ELSE j END), pick, js[pick] FROM (
    SELECT e.t + 1 AS t, e.js, list_min(list_filter(list_transform(e.js, lambda j, i: CASE WHEN j < a.ws[i] AND j * a.q // a.ws[i] <= e.t + 1 THEN ((j + 1) * a.q + a.ws[i] - 1) // a.ws[i] * 1000000 + i END), lambda x: x IS NOT NULL)) % 1000000 AS pick
    FROM edf e, a WHERE e.t + 1 < a.q)),
d AS (SELECT doc_id, coalesce(source, '') AS source, greatest(coalesce(length(text), 1), 1) AS size FROM documents),
b AS (SELECT doc_id, source, coalesce(sum(size) OVER (PARTITION BY source ORDER BY doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d)
SELECT doc_id, b.source, start, start // 65536 AS block, start // 65536 // w.w * w.q + edf.t AS slot
FROM b JOIN w USING (source) JOIN edf ON edf.pick = w.i AND edf.t >= 0 AND edf.picked_j = start // 65536 % w.w
"""


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP10_SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm)
"""


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


_TERMS = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"

OP11_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
tf AS (SELECT doc_id, any_value(n_terms) AS n_terms, term, count(*) AS tf FROM (SELECT doc_id, len(t) AS n_terms, unnest(t) AS term FROM d) GROUP BY doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), s),
q AS (SELECT DISTINCT item_id, unnest(list_distinct({_TERMS})) AS term FROM benchmark),
f AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n_terms * n) // l))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term), s GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM f WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability", "band")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_quality_classifier": op2_quality_classifier,
        "op3_benchmark_decontamination": op3_benchmark_decontamination,
        "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
        "op5_secret_scans": op5_secret_scans,
        "op6_token_output": op6_token_output,
        "op7_line_dedup": op7_line_dedup,
        "op8_mix_sources": op8_mix_sources,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_lexical_search": op11_lexical_search,
        "op12_embedding_whitening": op12_embedding_whitening,
        "op13_quality_rules": op13_quality_rules,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_ngram_jaccard_join": OP4_SQL, "op7_line_dedup": OP7_SQL, "op8_mix_sources": OP8_SQL, "op10_exact_dedup": OP10_SQL, "op11_lexical_search": OP11_SQL}
