"""Every operator on nulls in any column, empty and very long texts, repeated rows, shared ids and clashing columns."""

import random
import re

import pytest
from pyspark.sql import functions as F

from inkwell.llm.decontaminate import contaminated
from inkwell.llm.exact_dedup import exact_dedup
from inkwell.llm.jaccard_join import jaccard_components
from inkwell.llm.line_dedup import line_dedup
from inkwell.llm.lm_scoring import lm_scores
from inkwell.llm.mixing import mix
from inkwell.llm.quality import quality
from inkwell.llm.secrets import scan_secrets
from inkwell.llm.substring_dedup import substring_dedup
from inkwell.llm.token_output import token_output

CLASH = ("n", "key", "node", "fp", "norm", "tie", "h", "first", "block", "line", "host_", "salt_", "text_key", "row", "part", "spans", "runs", "base", "item", "perplexity")


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(21)
    prose = lambda n: " ".join(rng.choice(("the", "of", "and", "Word", "naïve", f"w{rng.randrange(900)}")) + ("." if rng.random() < 0.1 else "") for _ in range(n))
    long = prose(60_000)
    rows = [(i, prose(rng.randrange(5, 90)), "en", "s1") for i in range(40)]
    rows += [(50, long, "en", "s1"), (51, long, "en", None), (None, long + " end", None, None), (None, None, None, None), (52, None, "en", "s2"), (53, "", None, "s2"), (None, "", "en", "s1"), (54, "\U00020000" * 40, "", "")]
    rows += [rows[3]] * 3 + [(7, "another text of seven " + prose(30), "en", "s1")] * 2 + [(None, rows[5][1], "en", "s1")] * 2
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("x") for c in CLASH}).repartition(6)


def test_all_operators_give_every_row_its_result(spark, table):
    rows, df = table
    ids = sorted(r[0] if r[0] is not None else -1 for r in rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, None), (3, None, 1), (3, 1, 0)], "doc_id long, quality int, toxic int").withColumns({"trusted": F.lit(1), "lang": F.lit("x")})
    got = lambda out: sorted(r.doc_id if r.doc_id is not None else -1 for r in out)
    for op in (lambda: substring_dedup(df), lambda: quality(df, labels), lambda: jaccard_components(df), lambda: scan_secrets(df), lambda: token_output(df), lambda: mix(df, {"s1": 2}), lambda: lm_scores(df), lambda: exact_dedup(df)):
        assert got(op().collect()) == ids
    pages = df.select(F.col("doc_id").alias("page_id"), F.when(F.col("source").isNotNull(), F.concat(F.lit("https://h/"), "source")).alias("url"), F.col("text").alias("html")).withColumns({"host": F.lit("x"), "lines": F.lit("y"), "n": F.lit(1), "boiler": F.lit(2)})
    assert sorted(r.page_id if r.page_id is not None else -1 for r in line_dedup(pages).collect()) == ids


def test_long_texts_are_searched_to_their_ends(spark, table):
    rows, df = table
    long = rows[40][1]
    items = spark.createDataFrame([(1, long[-400:]), (1, long[-400:]), (2, None), (None, "Not in there at all, this one. Nor this."), (3, "")], "item_id long, text string").withColumns({"doc_id": F.lit(9), "item": F.lit("z")})
    found = sorted((r.doc_id if r.doc_id is not None else -1, r.item_id) for r in contaminated(df, items).collect())
    assert found == [(-1, 1)] * 2 + [(50, 1)] * 2 + [(51, 1)] * 2
    kept = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_components(df).collect()}
    assert {c for (i, n), c in kept.items() if i in (50, 51) or n > 30_000} == {50}
    n_words = {r.doc_id: r.n_words for r in lm_scores(df).collect()}
    assert n_words[50] == n_words[51] == len(re.findall(r"[^\x20\x09-\x0D]+", long))
    left = {r.doc_id: r.text for r in substring_dedup(df).collect()}
    assert left[50] is not None and (len(left[50] or "") > 100_000 or len(left[51] or "") < 1000)


def test_empty_tables(spark, table):
    _, df = table
    none = df.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (substring_dedup(none), quality(none, labels), jaccard_components(none), scan_secrets(none), token_output(none), mix(none), lm_scores(none), exact_dedup(none), contaminated(none, spark.createDataFrame([], "item_id long, text string"))):
        assert out.collect() == []
