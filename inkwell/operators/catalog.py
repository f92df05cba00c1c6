"""Catalogue records, pages and links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Codes of the 008 field.
DATE_TYPES = {"s": "single", "m": "multiple", "c": "continuing", "d": "ceased", "q": "questionable", "n": "unknown", "r": "reprint", "t": "publication and copyright"}


def html_text(html: Column, most: int | None = None) -> Column:
    """The text of a page: scripts, styles and tags out, white space squeezed."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>", " ")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, r"(?s)<[^>]+>", " "), r"[ \t\r\n]+", " "))
    return t if most is None else F.substring(t, 1, most)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^https?://([^/?#:]*)", 1))


def route(url: Column, rules: list[tuple[str, str]], default: str | None = None) -> Column:
    """The name of the first rule (pattern, name) that matches."""
    out = F.lit(default)
    for pattern, name in reversed(rules):
        out = F.when(url.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def slug(title: Column, most: int = 64) -> Column:
    """An id from a title: ASCII letters and digits in lower case, one underscore for spaces, underscores and hyphens
    between them; all else is dropped. What doesn't begin with a letter gets the prefix doc_; empty if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace(title, "[^A-Za-z0-9 _-]", "")), "[ _-]+", "_"), "^_|_$", "")
    return F.substring(F.when(kept.rlike("^[0-9]"), F.concat(F.lit("doc_"), kept)).otherwise(kept), 1, most)


def asset_id(url: Column) -> Column:
    return F.substring(F.md5(url), 1, 12)


def html_links(pages: DataFrame, key: str, url: str = "url", html: str = "html") -> DataFrame:
    """key, pos, link: absolute links in order; a page's fragment is cut off and the first of equal links stays."""
    root = F.regexp_extract(url, r"^(https?://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), r"^(https?://[^/]+(?:/.*)?/)[^/]*$|^(https?://[^/]+)$", "$1$2")
    rows = pages.select(key, root.alias("root"), folder.alias("folder"), F.posexplode(F.regexp_extract_all(html, F.lit(r'(?i)\bhref="([^"]*)"'), 1)).alias("pos", "raw"))
    raw = F.regexp_replace("raw", "#.*$", "")
    link = F.when(raw.rlike("^https?://"), raw).when(raw.startswith("/"), F.concat("root", raw)).otherwise(F.concat("folder", raw))
    rows = rows.where(raw != "").select(key, "pos", link.alias("link"))
    return rows.groupBy(key, "link").agg(F.min("pos").alias("pos"))


def bundles(links: DataFrame, key: str, least: int = 2) -> DataFrame:
    """key, dir, kind, n, bundle_id: links of one page in one folder are a bundle from `least` on, else single."""
    folder = F.regexp_extract("link", r"^(https?://[^?#]*/)", 1)
    g = links.select(key, "link", folder.alias("dir")).groupBy(key, "dir").agg(F.count(F.lit(1)).alias("n"), F.min("link").alias("first"))
    many = F.col("n") >= least
    return g.select(key, "dir", F.when(many, "bundle").otherwise("single").alias("kind"), "n", F.concat(asset_id(F.col("first")), F.when(many, F.lit("_bundle")).otherwise(F.lit(""))).alias("bundle_id"))


def decode_008(field: Column) -> Column:
    """Struct of a 40-character fixed field; an error below 35 characters."""
    at = lambda a, n: F.substring(field, a + 1, n)
    year = lambda a: F.nullif(F.regexp_replace(at(a, 4), "[# ]", ""), F.lit(""))
    kind = F.create_map(*(F.lit(x) for kv in DATE_TYPES.items() for x in kv))
    return F.when(F.char_length(field) >= 35, F.struct(kind[at(6, 1)].alias("date_type"), year(7).alias("year_1"), year(11).alias("year_2"), F.trim(at(15, 3)).alias("country"), at(35, 3).alias("language")))


def subfields(text: Column, mark: str = "▼") -> Column:
    """map code -> value of a field `▼aValue /▼bOther`: parts and values are trimmed, as is the run of / ; . , that ends a
    value; the last of a code counts and empty values are left out. Text without a mark takes its first character for
    the code."""
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    parts = F.filter(F.transform(F.split(text, mark), strip), lambda p: p != "")
    pairs = F.transform(parts, lambda p: F.struct(F.substring(p, 1, 1).alias("k"), strip(F.regexp_replace(p.substr(F.lit(2), F.char_length(p)), r"[/;.,]+\s*$", "")).alias("v")))
    pairs = F.filter(pairs, lambda p: p["v"] != "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    return F.map_from_entries(last)


def creators(field: Column) -> Column:
    """array<struct<role, name, period>> of `role:name（period）／role:name`."""
    part = lambda p: F.struct(
        F.nullif(F.regexp_extract(p, r"^([^:：]*)[:：]", 1), F.lit("")).alias("role"),
        F.trim(F.regexp_replace(F.regexp_replace(p, r"^[^:：]*[:：]", ""), r"[（(][^）)]*[）)]", "")).alias("name"),
        F.nullif(F.regexp_extract(p, r"[（(]([^）)]*)[）)]", 1), F.lit("")).alias("period"),
    )
    return F.transform(F.filter(F.split(field, "[／|]"), lambda p: F.trim(p) != ""), lambda p: part(F.trim(p)))


def unify(sources: list[tuple[str, DataFrame, dict[str, str]]], fields: list[str]) -> DataFrame:
    """One table of all sources: each maps the common fields to SQL over its own columns; with the source's name, and a
    map of which fields it gave."""
    out = None
    for name, df, mapping in sources:
        cols = [F.expr(mapping[f]).cast("string").alias(f) if f in mapping else F.lit(None).cast("string").alias(f) for f in fields]
        rows = df.select(F.lit(name).alias("source"), *cols)
        given = F.array_join(F.filter(F.array(*(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields)), lambda x: x.isNotNull()), ",")
        rows = rows.withColumn("given", given)
        out = rows if out is None else out.unionByName(rows)
    return out


def format_citation(parts: list[Column], separator: str = ", ") -> Column:
    """The parts that are there, in order, with angle brackets for titles swapped for corner ones."""
    return F.translate(F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (F.trim(p) != "")), separator), "<>", "《》")


def extent_of(text: Column) -> Column:
    """struct<volumes, books, missing, fragment> of an extent such as `3卷2冊(零本)` or `5卷(缺卷1)`."""
    n = lambda p: F.try_to_number(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit("999999")).cast("int")
    return F.struct(n(r"(\d+)\s*卷").alias("volumes"), n(r"(\d+)\s*[冊册]").alias("books"), F.nullif(F.regexp_extract(text, r"缺卷?\s*([0-9,-]+)", 1), F.lit("")).alias("missing"), text.rlike("零本|殘本").alias("fragment"))


def xml_record(xml: Column, fields: dict[str, str]) -> Column:
    """struct of the first value at each path; null where there is none."""
    return F.struct(*(F.try_element_at(F.xpath(xml, F.lit(f"{path}/text()")), F.lit(1)).alias(name) for name, path in fields.items()))


def map_labels(rows: DataFrame, key: str, pairs: str, synonyms: dict[str, list[str]]) -> DataFrame:
    """key and a column per field: the first value whose label is one of the field's synonyms (array<struct<label,
    value>>, in order)."""
    first = lambda names: F.try_element_at(F.filter(pairs, lambda p: F.trim(p["label"]).isin(names) & (F.trim(p["value"]) != "")), F.lit(1))
    return rows.select(key, *(F.trim(first(names)["value"]).alias(field) for field, names in synonyms.items()))


def page_rows(html: Column) -> Column:
    """array<struct<label, value>> of the th/td and dt/dd pairs of a page, tags off."""
    clean = lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))
    pattern = F.lit(r"(?is)<(?:th|dt)\b[^>]*>(.*?)</(?:th|dt)>\s*<(?:td|dd)\b[^>]*>(.*?)</(?:td|dd)>")
    both = F.arrays_zip(F.regexp_extract_all(html, pattern, 1).alias("label"), F.regexp_extract_all(html, pattern, 2).alias("value"))
    return F.transform(both, lambda p: F.struct(clean(p["label"]).alias("label"), clean(p["value"]).alias("value")))
