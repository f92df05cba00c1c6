"""Line dedup by site-relative frequency, in DataFrame operations alone.

Pages are grouped by host. For each line the pages of the host that contain it are divided by the host's page total;
lines over the boilerplate ratio are dropped from all pages of that host. A host has at most (mean lines a page /
ratio) such lines, which bounds the list that goes to its pages, and pages of a large host are dealt over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import join_skewed

#: What is not text in a page, and the tags that end a line.
NOT_TEXT = r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->"
LINE_TAGS = r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def page_lines(html, is_html: bool = True):
    """The lines of a page, trimmed of spaces, without empty ones."""
    text = F.coalesce(html, F.lit(""))
    if is_html:
        text = F.regexp_replace(text, NOT_TEXT, "")
        text = F.regexp_replace(F.regexp_replace(text, LINE_TAGS, "\n"), "<[^>]*>", "")
    return F.filter(F.transform(F.split(text, "[\r\n]+"), lambda x: F.trim(x)), lambda x: x != "")


def line_dedup(pages: DataFrame, ratio: float = 0.3, min_pages: int = 3, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", is_html: bool = True) -> DataFrame:
    """One row per row of pages: page_id, host, n_lines, n_dropped, text (the lines left, joined by line breaks).

    A line goes where at least min_pages pages of the host, and more than ratio of all its pages, contain it.

    Defined results: a null url, or one without a host, has the host ''; null and empty pages have no lines and the
    text ''; a line that a page repeats counts once for it; rows that repeat a page count as pages; an empty table
    gives an empty result; other columns are ignored.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.lower(F.coalesce(F.regexp_extract(url_col, HOST, 1), F.lit(""))).alias("host"), page_lines(F.col(text_col), is_html).alias("lines"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    # lines of a host are told apart by 64-bit hashes
    seen = rows.select("host", F.explode(F.array_distinct("lines")).alias("line")).select("host", F.xxhash64("line").alias("line"))
    counts = seen.groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    n_pages = pages.count()
    often = join_skewed(counts, totals.withColumn("all", F.col("n")), "host", n_pages, "line").where(F.col("pages") > ratio * F.col("all"))
    boiler = often.groupBy("host").agg(F.collect_set("line").alias("boiler"))
    by_host = totals.join(boiler, "host", "left")
    out = join_skewed(rows, by_host, "host", n_pages, "page_id", how="left")
    kept = F.when(F.col("boiler").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("boiler", F.xxhash64(x))))
    out = out.select("page_id", "host", F.size("lines").alias("n_lines"), kept.alias("kept"))
    return out.select("page_id", "host", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("text"))
